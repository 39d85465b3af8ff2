"""The pN_ results as plain SQL over whole tables, where SQL can express them."""

from __future__ import annotations

_MACRO = """
cleaned as (
  select upper(trim(series_id)) as series_id, observation_date as d, released_at, value,
         case upper(trim(frequency)) when 'D' then 'DAILY' when 'W' then 'WEEKLY' when 'M' then 'MONTHLY' when 'Q' then 'QUARTERLY' when 'A' then 'ANNUAL' else upper(trim(frequency)) end as frequency,
         lower(trim(source)) as source, trim(source_record_id) as rid, ingested_at
  from macro_readings),
freq as (
  select series_id, frequency from (
    select series_id, frequency, row_number() over (partition by series_id order by count(*) desc, case frequency when 'DAILY' then 1 when 'WEEKLY' then 2 when 'MONTHLY' then 3 when 'QUARTERLY' then 4 else 5 end) as r
    from cleaned where frequency in ('DAILY','WEEKLY','MONTHLY','QUARTERLY','ANNUAL') and series_id is not null group by series_id, frequency) where r = 1),
last as (
  select *, row_number() over (partition by source, rid order by ingested_at desc, series_id desc, d desc, value desc) as r
  from cleaned where d is not null and (released_at is null or released_at <= ingested_at)),
readings as (
  select l.series_id, l.source, f.frequency, l.value,
         case f.frequency when 'DAILY' then l.d when 'WEEKLY' then cast(date_trunc('week', l.d) as date) when 'MONTHLY' then cast(date_trunc('month', l.d) as date)
              when 'QUARTERLY' then cast(date_trunc('quarter', l.d) as date) else cast(date_trunc('year', l.d) as date) end as p
  from last l join freq f on l.series_id = f.series_id
  where l.r = 1 and l.value is not null and (f.frequency <> 'DAILY' or l.d in (select trade_date from trading_days))),
bounds as (select series_id, source, frequency, min(p) as a, max(p) as b from readings group by all),
grid as (
  select series_id, source, t.trade_date as p from bounds join trading_days t on t.trade_date between a and b where frequency = 'DAILY'
  union all
  select series_id, source, cast(unnest(generate_series(cast(a as timestamp), cast(b as timestamp),
         case frequency when 'WEEKLY' then interval 7 day when 'MONTHLY' then interval 1 month when 'QUARTERLY' then interval 3 month else interval 1 year end)) as date) as p
  from bounds where frequency <> 'DAILY')
"""

P1_FOUND = f"""with {_MACRO}
select g.series_id, g.source, strftime(g.p, '%Y-%m-%d') as period_start from grid g
left join (select distinct series_id, source, p from readings) r on r.series_id = g.series_id and r.source is not distinct from g.source and r.p = g.p
where r.p is null"""

P1_GRID = f"""with {_MACRO}, held as (select series_id, source, frequency, p, count(*) as n, avg(value) as mean from readings group by all)
select g.series_id, g.source, b.frequency, g.p as period_start, coalesce(h.n, 0) as readings, round(h.mean, 6) as observed, h.n is null as is_missing
from grid g join bounds b on b.series_id = g.series_id and b.source is not distinct from g.source
left join held h on h.series_id = g.series_id and h.source is not distinct from g.source and h.p = g.p"""

P2_FOUND = """with f as (
  select compaction_id as c, lower(trim(file_role)) as role, file_name, upper(trim(symbol)) as s, date as d, lower(trim(source)) as src, close, volume, ingested_at, trim(source_record_id) as rid
  from lake_fragments where compaction_id is not null),
ins as (select * from (select *, row_number() over (partition by c, s, d, src order by ingested_at desc, rid desc) as r from f where role = 'input') where r = 1),
outs as (select c, s, d, src, count(*) as n, min(close) as close, min(volume) as volume, max(close) as close2, max(volume) as volume2 from f where role = 'output' group by all),
wrong as (
  select coalesce(i.c, o.c) as c from ins i full join outs o on i.c = o.c and i.s is not distinct from o.s and i.d is not distinct from o.d and i.src is not distinct from o.src
  where i.c is null or o.c is null or o.n <> 1 or i.close is distinct from o.close or i.volume is distinct from o.volume or o.close is distinct from o.close2 or o.volume is distinct from o.volume2),
held as (select c, count(distinct file_name) filter (where role = 'input') as fi, count(distinct file_name) filter (where role = 'output') as fo,
         count(*) filter (where role = 'input') as ri, count(*) filter (where role = 'output') as ro from f group by c)
select distinct k.compaction_id from compactions k left join held h on h.c = k.compaction_id
where k.compaction_id in (select c from wrong) or k.files_before is distinct from coalesce(fi, 0) or k.files_after is distinct from coalesce(fo, 0)
   or k.rows_before is distinct from coalesce(ri, 0) or k.rows_after is distinct from coalesce(ro, 0)"""

P3_FOUND = """with runs as (select arrival_time, max(prior_event_watermark) as w from ingestion_runs where arrival_time is not null group by 1),
first as (select upper(trim(symbol)) as symbol, date as d, lower(trim(source)) as source, min(ingested_at) as a from prices where symbol is not null and date is not null group by all)
select symbol, strftime(d, '%Y-%m-%d') as event_date, source from first join runs on a = arrival_time where d <= w and d >= w - 30"""

P2_FILES = """with f as (
  select coalesce(dataset, '__null__') as dataset, coalesce(partition_path, '__null__') as partition_path, coalesce(file_name, '__null__') as file_name, upper(trim(symbol)) as s, date as d, lower(trim(source)) as src
  from lake_fragments where compaction_id is null and lower(trim(file_role)) = 'input'),
once as (select dataset, partition_path, count(*) as n from (select distinct dataset, partition_path, s, d, src from f) group by 1, 2)
select f.dataset, f.partition_path, count(distinct file_name) as files_before, count(*) as rows_before, max(n) as rows_after, count(*) - max(n) as duplicate_rows_removed, true as well_sized
from f join once o on f.dataset = o.dataset and f.partition_path = o.partition_path group by 1, 2"""

_P3 = """with runs as (select arrival_time, max(prior_event_watermark) as w from ingestion_runs where arrival_time is not null group by 1),
timed as (
  select upper(trim(symbol)) as symbol, date as event_date, lower(trim(source)) as source, close, cast(volume as double) as volume, trim(source_record_id) as source_record_id, ingested_at as arrival, w as watermark,
         case when w is null or date > w then 'on_time' when date >= w - 30 then 'late' else 'too_late' end as timing
  from prices left join runs on ingested_at = arrival_time where symbol is not null and date is not null and ingested_at is not null),
entry as (select symbol, event_date, source, timing as first_timing from (select *, row_number() over (partition by symbol, event_date, source order by arrival, timing) as r from timed) where r = 1),
kept as (select * from (
  select *, cast(arrival as date) as day, row_number() over (partition by symbol, event_date, source, cast(arrival as date) order by arrival desc, source_record_id desc nulls last, close desc nulls last, volume desc nulls last) as r from timed where timing <> 'too_late') where r = 1),
state as (select *, lag(close) over w as was_close, lag(volume) over w as was_volume, row_number() over w = 1 as fresh from kept window w as (partition by symbol, event_date, source order by day)),
changes as (
  select s.source, cast(date_trunc('month', s.event_date) as date) as window_start, day as arrival_date, count(*) filter (where fresh) as a, count(*) filter (where fresh and first_timing = 'late') as b, count(*) filter (where not fresh) as c,
         sum(coalesce(close, 0) - coalesce(was_close, 0)) as e, sum(coalesce(volume, 0) - coalesce(was_volume, 0)) as f
  from state s join entry y on s.symbol = y.symbol and s.event_date = y.event_date and s.source is not distinct from y.source group by 1, 2, 3),
updates as (
  select source, window_start, arrival_date, cast(row_number() over w as int) as version, cast(sum(a) over w as bigint) as records, cast(sum(b) over w as bigint) as late_arriving_rows, cast(sum(c) over w as bigint) as revised_rows,
         round(sum(e) over w, 4) as close_sum, round(sum(f) over w, 4) as volume_sum
  from changes window w as (partition by source, window_start order by arrival_date rows unbounded preceding))"""
P3_UPDATES = f"{_P3} select * from updates"
P3_CURRENT = f"{_P3} select * exclude (r) from (select *, row_number() over (partition by source, window_start order by version desc) as r from updates) where r = 1"
P3_DROPPED = f"{_P3} select * from timed where timing = 'too_late'"

P4_AS_KNOWN = """with rows_ as (
  select upper(trim(symbol)) as symbol, lower(trim(metric_name)) as metric_name, period_start, period_end, filed_at, value, lower(trim(source)) as source, trim(source_record_id) as source_record_id, ingested_at
  from fundamentals),
valid as (
  select *, greatest(period_end, cast(filed_at as date)) as known from (
    select *, row_number() over (partition by source, source_record_id order by ingested_at desc, symbol desc, metric_name desc, period_start desc, period_end desc, filed_at desc, value desc) as r
    from rows_ where filed_at is not null and filed_at <= ingested_at and (period_start is null or period_start <= period_end))
  where r = 1 and period_end is not null),
asked as (select distinct request_id, upper(trim(symbol)) as symbol, trade_date, lower(trim(metric_name)) as metric_name, lower(trim(source)) as source from snapshot_requests),
ranked as (
  select a.*, v.period_end, v.filed_at, v.ingested_at, v.source_record_id, v.value,
         row_number() over (partition by a.request_id, a.symbol, a.trade_date, a.metric_name, a.source order by v.period_end desc nulls last, v.filed_at desc nulls last, v.ingested_at desc nulls last, v.source_record_id desc nulls last) as r
  from asked a left join valid v on v.symbol = a.symbol and v.metric_name = a.metric_name and v.source = a.source and v.known <= a.trade_date)
"""
P4_FOUND = f"{P4_AS_KNOWN} select request_id, source_record_id from ranked where r = 1 and source_record_id is not null"
P4_ALL = f"{P4_AS_KNOWN} select request_id, symbol, metric_name, source, trade_date, period_end, filed_at, ingested_at, source_record_id, value from ranked where r = 1"

P6_FOUND = """with last_ as (select symbol, d, source, close, volume from (
  select upper(trim(symbol)) as symbol, date as d, lower(trim(source)) as source, close, cast(volume as double) as volume, row_number() over (partition by upper(trim(symbol)), date, lower(trim(source)) order by ingested_at desc, trim(source_record_id) desc, close desc nulls last, volume desc nulls last) as r
  from prices where symbol is not null and date is not null) where r = 1),
readings as (select symbol, source, 'close' as field, d, close as v from last_ where close is not null and not isnan(close) union all select symbol, source, 'volume', d, volume from last_ where volume is not null),
runs as (select *, sum(fresh) over (partition by symbol, source, field order by d) as run from (
  select *, case when v = lag(v) over (partition by symbol, source, field order by d) then 0 else 1 end as fresh from readings)),
marked as (select *, count(*) over (partition by symbol, source, field, run) as run_length, case field when 'close' then v <= 0 else v < 0 end as impossible from runs),
logs as (select symbol, source, field, d, case when v = 0 then cast('-infinity' as double) else ln(v) end as x, row_number() over w - 1 as pos, count(*) over (partition by symbol, source, field) as n from marked where not impossible window w as (partition by symbol, source, field order by d)),
moves as (select symbol, source, field, abs(x - lag(x) over (partition by symbol, source, field order by d)) as move from logs),
sizes as (select symbol, source, field, median(move) as m, median(move) filter (where move > 0) as positive from moves where move is not null and isfinite(move) group by all),
usual as (select symbol, source, field, greatest(coalesce(case when m is null or m = 0 then least(positive, 0.01) else m end, 0.0001) * 0.7979 / 0.6745, 0.0001) as u from sizes),
around as (select a.symbol, a.source, a.field, a.d, quantile_disc(b.x, 0.5) as low, -quantile_disc(-b.x, 0.5) as high from logs a join logs b on a.symbol = b.symbol and a.source is not distinct from b.source and a.field = b.field
  and b.pos between least(greatest(a.pos - 4, 0), greatest(a.n - 9, 0)) and least(greatest(a.pos - 4, 0), greatest(a.n - 9, 0)) + 8 where a.n > 4 group by a.symbol, a.source, a.field, a.d),
far as (select l.*, u, case when l.x = low and l.x = high then 0 else greatest(least((l.x - (low + high) / 2) / u, 1000), -1000) end as away from logs l
  join around using (symbol, field, d) join usual using (symbol, field) where around.source is not distinct from l.source and usual.source is not distinct from l.source),
sides as (select *, case when away > 9 then 1 when away < -9 then -1 else 0 end as side from far),
grouped as (select *, sum(step) over (partition by symbol, source, field order by d) as g from (select *, case when side = lag(side) over (partition by symbol, source, field order by d) then 0 else 1 end as step from sides)),
spans as (select symbol, source, field, g, side, min(pos) as a, max(pos) + 1 as b, min(abs(away)) as least_away, max(n) as n, max(u) as u from grouped where side <> 0 group by all having count(*) <= 3),
edges as (select s.*, (greatest(fx.x, -1e6 * s.u) - greatest(bx.x, -1e6 * s.u)) / s.u * side as back, (greatest(lx.x, -1e6 * s.u) - greatest(ax.x, -1e6 * s.u)) / s.u * side as forth from spans s
  left join logs fx on fx.symbol = s.symbol and fx.source is not distinct from s.source and fx.field = s.field and fx.pos = s.a left join logs bx on bx.symbol = s.symbol and bx.source is not distinct from s.source and bx.field = s.field and bx.pos = s.a - 1
  left join logs lx on lx.symbol = s.symbol and lx.source is not distinct from s.source and lx.field = s.field and lx.pos = s.b - 1 left join logs ax on ax.symbol = s.symbol and ax.source is not distinct from s.source and ax.field = s.field and ax.pos = s.b),
spikes as (select g.symbol, g.source, g.field, g.d from grouped g join edges e on g.symbol = e.symbol and g.source is not distinct from e.source and g.field = e.field and g.g = e.g
  where (e.a >= 4 and e.n - e.b >= 4) or ((back is null or back * 1.5 > least_away) and (forth is null or forth * 1.5 > least_away)))
select distinct symbol, strftime(d, '%Y-%m-%d') as event_date, source, field from (
  select symbol, source, field, d from marked where impossible or run_length >= 5 union all select symbol, source, field, d from spikes)"""

_BARS = """
bars as (
  select symbol, d, source, close, volume from (
    select *, row_number() over (partition by symbol, d, source order by ingested_at desc, rid desc) as r from (
      select upper(trim(symbol)) as symbol, date as d, lower(trim(source)) as source, open, high, low, close, volume, trim(source_record_id) as rid, ingested_at from prices)
    where symbol is not null and d is not null and open > 0 and high > 0 and low > 0 and close > 0 and volume >= 0 and high >= greatest(low, open, close) and low <= least(open, close))
  where r = 1),
days as (select trade_date as d, row_number() over (order by trade_date) as n from trading_days),
span as (select symbol, source, min(n) as a, max(n) as b from bars join days using (d) group by symbol, source),
dense as (
  select s.symbol, s.source, y.d, y.n, b.d is not null as is_active, coalesce(b.volume, 0) as volume,
         last_value(b.close ignore nulls) over (partition by s.symbol, s.source order by y.n rows unbounded preceding) as close
  from span s join days y on y.n between s.a and s.b left join bars b on b.symbol = s.symbol and b.source is not distinct from s.source and b.d = y.d),
returns as (select *, close / lag(close) over (partition by symbol, source order by n) - 1 as daily_return from dense),
figures as (
  select symbol, source, d, n, is_active, close, volume, daily_return,
         close / lag(close, 20) over (partition by symbol, source order by n) - 1 as rolling_20d_return,
         case when count(daily_return) over w = 20 then stddev_samp(daily_return) over w end as rolling_20d_volatility,
         case when count(*) over w = 20 then cast(sum(volume) over w as double) / 20 end as average_volume_20d
  from returns window w as (partition by symbol, source order by n rows between 19 preceding and current row))
"""
P7_FOUND = f"""with {_BARS},
given as (select distinct upper(trim(symbol)) as symbol, lower(trim(source)) as source, trade_date, rolling_20d_return as a, rolling_20d_volatility as b, average_volume_20d as c from expected_metrics)
select distinct g.symbol, strftime(g.trade_date, '%Y-%m-%d') as trade_date, g.source from given g
left join figures f on f.symbol = g.symbol and f.source = g.source and f.d = g.trade_date
where a is null or b is null or c is null or rolling_20d_return is null or rolling_20d_volatility is null or average_volume_20d is null
   or (abs(a - rolling_20d_return) > 0.001 * abs(rolling_20d_return) and abs(a - rolling_20d_return) > 0.00001)
   or (abs(b - rolling_20d_volatility) > 0.001 * abs(rolling_20d_volatility) and abs(b - rolling_20d_volatility) > 0.00001)
   or (abs(c - average_volume_20d) > 0.001 * abs(average_volume_20d) and abs(c - average_volume_20d) > 0.00001)"""

P7_ROLLING = f"""with {_BARS}
select symbol, source, is_active, close, volume, round(daily_return, 8) as daily_return, round(rolling_20d_return, 8) as rolling_20d_return, round(rolling_20d_volatility, 8) as rolling_20d_volatility, round(average_volume_20d, 8) as average_volume_20d, d as trade_date from figures"""

P7_TOTALS = f"""with {_BARS.split('days as')[0].rstrip().rstrip(',')},
span as (select symbol, source, min(d) as a, max(d) as b from bars group by symbol, source),
dense as (
  select s.symbol, s.source, cast(y.d as date) as trade_date, b.d is not null as is_active, coalesce(b.volume, 0) as volume
  from (select symbol, source, unnest(generate_series(cast(a as timestamp), cast(b as timestamp), interval 1 day)) as d from span) s2
  join span s on s.symbol = s2.symbol and s.source is not distinct from s2.source
  cross join lateral (select s2.d as d) y
  left join bars b on b.symbol = s.symbol and b.source is not distinct from s.source and b.d = cast(y.d as date))
select symbol, source, trade_date, is_active, volume,
       cast(sum(volume) over w7 as bigint) as volume_total_7d, cast(sum(volume) over w7 as double) / 7 as volume_average_7d,
       cast(sum(volume) over w30 as bigint) as volume_total_30d, cast(sum(volume) over w30 as double) / 30 as volume_average_30d
from dense
window w7 as (partition by symbol, source order by trade_date rows between 6 preceding and current row),
       w30 as (partition by symbol, source order by trade_date rows between 29 preceding and current row)"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_FOUND, "p1_grid": P1_GRID, "p2_found": P2_FOUND, "p2_files": P2_FILES, "p3_found": P3_FOUND, "p3_updates": P3_UPDATES, "p3_current": P3_CURRENT, "p3_dropped": P3_DROPPED, "p4_found": P4_FOUND, "p4_as_known": P4_ALL, "p6_found": P6_FOUND, "p7_found": P7_FOUND, "p7_rolling": P7_ROLLING, "p7_totals": P7_TOTALS}
