"""Queries over the relational operators, each beside the SQL that states its result.

Inputs: prices, fundamentals, macro_readings, ingestion_runs, stream_events and
documents feed the models directly; where a model needs a dataset the tables lack
(earnings, a sector dimension, news urls), a small adapter makes it from the
order tables, in the same way on both sides.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import arg_max_nn, lower_key, md5_key, safe_ratio, upper_key
from ..operators.asof import asof_join, interval_join
from ..operators.latest import keep_latest
from ..plans import models
from ..session import table
from ..sources.contracts import CONTRACTS

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}
AS_OF = "2026-03-01 00:00:00"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        REGISTRY[f.__name__] = (f, sql)
        return f

    return add


def as_of():
    return F.lit(AS_OF).cast("timestamp")


# --- adapters -------------------------------------------------------------------------------------------------


def staged_prices(s: SparkSession, d: str) -> DataFrame:
    return models.stg_prices(table(s, d, "prices"))


def returns(s: SparkSession, d: str) -> DataFrame:
    return models.int_daily_returns(staged_prices(s, d))


def daily(s: SparkSession, d: str) -> DataFrame:
    return models.mart_security_daily(models.int_rolling_volatility(returns(s, d)))


def sectors(s: SparkSession, d: str) -> DataFrame:
    """symbol, sector: the sector of a symbol is a region, by the letter it ends with."""
    symbols = table(s, d, "prices").select(upper_key("symbol").alias("symbol")).where("symbol is not null").distinct()
    return symbols.withColumn("r_regionkey", F.pmod(F.ascii(F.substring("symbol", 3, 1)), F.lit(6)).cast("int")).join(table(s, d, "region"), "r_regionkey").select("symbol", F.col("r_name").alias("sector"))


def raw_earnings(s: SparkSession, d: str) -> DataFrame:
    """Earnings events made of fundamentals: the filing is the event, the prior value of the metric the estimate."""
    f = table(s, d, "fundamentals")
    return f.select("symbol", F.col("filed_at").alias("event_timestamp"), F.col("period_end").alias("fiscal_period_end"), F.when(F.col("currency").isNull(), "estimate").otherwise(" reported ").alias("event_status"), F.when(F.month("period_end") != 3, F.round(F.col("value") / 1e6, 2)).alias("eps_estimate"), F.round(F.col("value") / 9e5, 2).alias("eps_actual"), "source", "source_record_id", "ingested_at")


def raw_news(s: SparkSession, d: str) -> DataFrame:
    """News made of documents: the text is the headline, the url is made of the identifier."""
    doc = table(s, d, "documents")
    return doc.select(F.col("published_at").alias("event_timestamp"), F.col("text").alias("headline"), F.concat(F.lit("https://n/"), F.col("doc_id").cast("string")).alias("url"), F.col("lang").alias("publisher"), "source", F.col("doc_id").cast("string").alias("source_record_id"), F.col("published_at").alias("ingested_at"))


_STG = """
p_ranked as (
  select *, row_number() over (partition by symbol, trade_date, source order by ingested_at desc, source_record_id desc) as rn from (
    select upper(trim(symbol)) as symbol, date as trade_date, open, high, low, close, volume, lower(trim(source)) as source, trim(source_record_id) as source_record_id, ingested_at from prices)
  where symbol is not null and trade_date is not null and open > 0 and high > 0 and low > 0 and close > 0 and volume >= 0 and high >= greatest(low, open, close) and low <= least(open, close)),
stg_prices as (select md5(source || '|' || symbol || '|' || cast(trade_date as varchar)) as price_bar_key, symbol, trade_date, open, high, low, close, volume, source, source_record_id, ingested_at from p_ranked where rn = 1)"""
_RET = f"""{_STG},
lagged as (select *, lag(close) over (partition by symbol, source order by trade_date) as previous_close from stg_prices),
returns_ as (select price_bar_key, symbol, trade_date, close, volume, source, previous_close, case when previous_close > 0 then close / previous_close - 1.0 end as daily_return from lagged)"""
_VOL = f"""{_RET},
vol as (select price_bar_key, symbol, trade_date, close, volume, source, daily_return, count(daily_return) over w as return_observations_20d, stddev_samp(daily_return) over w as rolling_20d_volatility,
  stddev_samp(daily_return) over w * sqrt(252.0) as annualized_20d_volatility, close / nullif(lag(close, 20) over (partition by symbol, source order by trade_date), 0) - 1.0 as rolling_20d_return
  from returns_ window w as (partition by symbol, source order by trade_date rows between 19 preceding and current row)),
daily_ as (select price_bar_key, md5(source || '|' || symbol) as source_security_key, trade_date, symbol, source, close, daily_return, rolling_20d_return, rolling_20d_volatility, annualized_20d_volatility, volume,
  avg(volume) over w as average_volume_20d, volume / nullif(avg(volume) over w, 0) as relative_volume, return_observations_20d
  from vol window w as (partition by symbol, source order by trade_date rows between 19 preceding and current row))"""
_MARKET = """market_ as (select trade_date, avg(daily_return) as mean_return, median(daily_return) as median_return, stddev_samp(daily_return) as cross_sectional_volatility,
  count(*) filter (where daily_return > 0) as advancers, count(*) filter (where daily_return < 0) as decliners, count(*) filter (where daily_return = 0) as unchanged,
  (count(*) filter (where daily_return > 0) - count(*) filter (where daily_return < 0))::double / nullif(count(daily_return), 0) as market_breadth, count(daily_return) as securities_with_returns from returns_ group by trade_date)"""
_SECTORS = """sectors_ as (select symbol, r_name as sector from (select distinct upper(trim(symbol)) as symbol from prices where symbol is not null) join region on r_regionkey = ascii(substring(symbol, 3, 1)) % 6)"""
_SECTOR_DAILY = f"""{_SECTORS}, sector_daily_ as (select trade_date, sector, avg(daily_return) as sector_average_return, count(daily_return) as securities_with_returns from returns_ join sectors_ using (symbol) group by trade_date, sector)"""
_FUND = """
f_rows as (select upper(trim(symbol)) as symbol, lower(trim(metric_name)) as metric_name, period_start, period_end, upper(trim(period_type)) as period_type, filed_at, value, upper(trim(unit)) as unit, upper(trim(currency)) as currency,
  lower(trim(source)) as source, trim(source_record_id) as source_record_id, ingested_at from fundamentals),
stg_fund as (select * exclude (rn) from (select *, row_number() over (partition by source, source_record_id order by ingested_at desc, symbol desc nulls last, metric_name desc, period_start desc nulls last, period_end desc, period_type desc, filed_at desc nulls last, value desc) as rn from f_rows
  where symbol is not null and metric_name is not null and period_end is not null and (period_start is null or period_end >= period_start) and (filed_at is null or filed_at <= ingested_at)) where rn = 1)"""
_EARN = """
e_raw as (select symbol, filed_at as event_timestamp, period_end as fiscal_period_end, case when currency is null then 'estimate' else ' reported ' end as event_status, case when month(period_end) <> 3 then round(value / 1e6, 2) end as eps_estimate, round(value / 9e5, 2) as eps_actual, source, source_record_id, ingested_at
  from fundamentals),
e_rows as (select upper(trim(symbol)) as symbol, event_timestamp, fiscal_period_end, case upper(trim(event_status)) when 'ESTIMATE' then 'SCHEDULED' else upper(trim(event_status)) end as event_status, eps_estimate, eps_actual, lower(trim(source)) as source, trim(source_record_id) as source_record_id, ingested_at from e_raw),
stg_earn as (select * exclude (rn) from (select *, row_number() over (partition by source, source_record_id order by ingested_at desc, symbol desc, event_timestamp desc, fiscal_period_end desc, event_status desc, eps_estimate desc nulls last, eps_actual desc) as rn from e_rows where symbol is not null and event_timestamp is not null and event_status is not null) where rn = 1),
surp as (select *, eps_actual - eps_estimate as eps_surprise, case when eps_estimate is not null and abs(eps_estimate) > 0.000000001 then (eps_actual - eps_estimate) / abs(eps_estimate) end as eps_surprise_percent from stg_earn)"""
_MACRO = """
m_rows as (select upper(trim(series_id)) as series_id, observation_date, released_at, value, upper(trim(unit)) as unit, case upper(trim(frequency)) when 'D' then 'DAILY' when 'W' then 'WEEKLY' when 'M' then 'MONTHLY' when 'Q' then 'QUARTERLY' when 'A' then 'ANNUAL' else upper(trim(frequency)) end as frequency,
  lower(trim(source)) as source, trim(source_record_id) as source_record_id, ingested_at from macro_readings),
stg_mac as (select md5(source || '|' || source_record_id) as macro_observation_key, * exclude (rn) from (select *, row_number() over (partition by source, source_record_id order by ingested_at desc, series_id desc, observation_date desc, released_at desc nulls last, value desc nulls last, unit desc nulls last, frequency desc nulls last) as rn from m_rows
  where series_id is not null and observation_date is not null and (released_at is null or released_at <= ingested_at)) where rn = 1)"""
_NEWS = """
n_raw as (select published_at as event_timestamp, text as headline, 'https://n/' || doc_id as url, lang as publisher, source, cast(doc_id as varchar) as source_record_id, published_at as ingested_at from documents),
n_rows as (select event_timestamp, trim(headline) as headline, trim(url) as url, trim(publisher) as publisher, lower(trim(source)) as source, trim(source_record_id) as source_record_id, ingested_at from n_raw),
stg_new as (select * exclude (rn) from (select *, row_number() over (partition by source, source_record_id order by ingested_at desc) as rn from n_rows where event_timestamp is not null and headline is not null and length(headline) > 0 and (url is null or starts_with(url, 'http://') or starts_with(url, 'https://'))) where rn = 1)"""


def r6(df: DataFrame, *columns: str) -> DataFrame:
    """Round doubles, whose last bits differ between engines."""
    return df.withColumns({c: F.round(c, 6) for c in columns})


# --- models ---------------------------------------------------------------------------------------------------


@query(f"with {_STG} select * from stg_prices")
def stg_prices(s, d):
    return staged_prices(s, d)


@query(f"with {_FUND} select md5(source || '|' || source_record_id) as fundamental_observation_key, * from stg_fund")
def stg_fundamentals(s, d):
    return models.stg_fundamentals(table(s, d, "fundamentals"))


@query(f"with {_EARN} select md5(source || '|' || source_record_id) as earnings_event_key, * from stg_earn")
def stg_earnings(s, d):
    return models.stg_earnings(raw_earnings(s, d))


@query(f"with {_MACRO} select * from stg_mac")
def stg_macro(s, d):
    return models.stg_macro(table(s, d, "macro_readings"))


@query(f"with {_NEWS} select md5(source || '|' || source_record_id) as news_event_key, * from stg_new")
def stg_news(s, d):
    return models.stg_news(raw_news(s, d))


@query("select upper(trim(symbol)) as symbol, date as trade_date, open, high, low, close, volume, lower(trim(source)) as source, trim(source_record_id) as source_record_id from prices where symbol is not null and volume >= 0 and open > 0 and high >= greatest(low, open, close)")
def stg_normalize(s, d):
    p = table(s, d, "prices").where("symbol is not null and volume >= 0 and open > 0 and high >= greatest(low, open, close)")
    return p.select(upper_key("symbol").alias("symbol"), F.col("date").alias("trade_date"), "open", "high", "low", "close", "volume", lower_key("source").alias("source"), F.trim("source_record_id").alias("source_record_id"))


@query(f"with {_RET} select price_bar_key, symbol, trade_date, close, volume, source, previous_close, round(daily_return, 6) as daily_return from returns_")
def daily_returns(s, d):
    return r6(returns(s, d), "daily_return")


@query(f"with {_VOL} select price_bar_key, symbol, trade_date, source, return_observations_20d, round(rolling_20d_volatility, 6) as rolling_20d_volatility, round(annualized_20d_volatility, 6) as annualized_20d_volatility, round(rolling_20d_return, 6) as rolling_20d_return from vol")
def rolling_volatility(s, d):
    v = models.int_rolling_volatility(returns(s, d))
    return r6(v.select("price_bar_key", "symbol", "trade_date", "source", "return_observations_20d", "rolling_20d_volatility", "annualized_20d_volatility", "rolling_20d_return"), "rolling_20d_volatility", "annualized_20d_volatility", "rolling_20d_return")


@query(f"with {_VOL} select price_bar_key, source_security_key, trade_date, symbol, source, close, round(daily_return, 6) as daily_return, round(rolling_20d_return, 6) as rolling_20d_return, round(rolling_20d_volatility, 6) as rolling_20d_volatility, round(annualized_20d_volatility, 6) as annualized_20d_volatility, volume, round(average_volume_20d, 4) as average_volume_20d, round(relative_volume, 6) as relative_volume, return_observations_20d from daily_")
def security_daily(s, d):
    out = daily(s, d).withColumn("average_volume_20d", F.round("average_volume_20d", 4))
    return r6(out, "daily_return", "rolling_20d_return", "rolling_20d_volatility", "annualized_20d_volatility", "relative_volume")


@query(f"with {_FUND}, eff as (select md5(source || '|' || source_record_id) as fundamental_observation_key, *, coalesce(filed_at, cast(period_end as timestamp)) as effective_from from stg_fund) select *, lead(effective_from) over (partition by symbol, metric_name, period_end, source order by effective_from, ingested_at, source_record_id) as effective_to from eff")
def effective_ranges(s, d):
    return models.int_security_fundamentals(models.stg_fundamentals(table(s, d, "fundamentals")))


@query(f"with {_EARN} select md5(source || '|' || source_record_id) as earnings_event_key, symbol, event_timestamp, fiscal_period_end, event_status, eps_estimate, eps_actual, round(eps_surprise, 6) as eps_surprise, round(eps_surprise_percent, 6) as eps_surprise_percent, source, source_record_id, ingested_at from surp")
def surprise_pct(s, d):
    return r6(models.int_earnings_surprises(models.stg_earnings(raw_earnings(s, d))), "eps_surprise", "eps_surprise_percent")


@query(f"""with {_MACRO}, avail as (select *, greatest(observation_date, cast(coalesce(released_at, cast(observation_date as timestamp)) as date)) as available_date from stg_mac),
one as (select * from (select *, row_number() over (partition by series_id, source, available_date order by observation_date desc, ingested_at desc, macro_observation_key desc) as r from avail) where r = 1)
select t.trade_date, g.series_id, g.source, m.macro_observation_key, m.observation_date, m.released_at, m.available_date, m.value, m.unit, m.frequency
from trading_days t cross join (select distinct series_id, source from stg_mac) g asof left join one m on g.series_id = m.series_id and g.source = m.source and t.trade_date >= m.available_date""")
def macro_aligned(s, d):
    return models.int_macro_aligned(models.stg_macro(table(s, d, "macro_readings")), table(s, d, "trading_days"))


@query(f"with {_RET}, {_MARKET} select trade_date, round(mean_return, 6) as mean_return, round(median_return, 6) as median_return, round(cross_sectional_volatility, 6) as cross_sectional_volatility, advancers, decliners, unchanged, round(market_breadth, 6) as market_breadth, securities_with_returns from market_")
def market_daily(s, d):
    return r6(models.mart_market_daily(returns(s, d)), "mean_return", "median_return", "cross_sectional_volatility", "market_breadth")


@query(f"with {_RET}, {_SECTOR_DAILY} select trade_date, sector, round(sector_average_return, 6) as sector_average_return, securities_with_returns from sector_daily_")
def sector_daily(s, d):
    return r6(models.mart_sector_daily(returns(s, d), sectors(s, d)), "sector_average_return")


@query(f"with {_RET}, {_SECTOR_DAILY} select sector, max(trade_date) as latest_date, round(arg_max(sector_average_return, trade_date), 6) as latest_return, arg_max(securities_with_returns, trade_date) as latest_securities from sector_daily_ group by sector")
def sector_latest(s, d):
    return r6(models.sector_latest(models.mart_sector_daily(returns(s, d), sectors(s, d))), "latest_return")


@query(f"with {_RET}, {_SECTOR_DAILY} select trade_date, sector, round(sector_average_return, 6) as sector_average_return, securities_with_returns from sector_daily_ where lower(sector) = lower('europe') order by trade_date desc limit 252")
def sector_history(s, d):
    m = models.mart_sector_daily(returns(s, d), sectors(s, d)).where(F.lower("sector") == F.lower(F.lit("europe")))
    return r6(m.orderBy(F.desc("trade_date")).limit(252), "sector_average_return")


@query(f"""with {_STG}, {_FUND}, {_EARN},
lp as (select * from (select *, row_number() over (partition by symbol, source order by trade_date desc) as r from stg_prices) where r = 1),
fs as (select symbol, source, max(period_end) as latest_fundamental_period_end, max(filed_at) as latest_fundamental_filed_at, count(distinct metric_name) as available_fundamental_metrics from stg_fund group by symbol, source),
le as (select * from (select *, row_number() over (partition by symbol, source order by event_timestamp desc, source_record_id desc) as r from surp) where r = 1)
select md5(lp.source || '|' || lp.symbol) as source_security_key, lp.symbol, lp.source, lp.trade_date as latest_price_date, lp.close as latest_price, latest_fundamental_period_end, latest_fundamental_filed_at, available_fundamental_metrics,
  le.event_timestamp as latest_earnings_timestamp, le.eps_actual as latest_eps_actual, round(le.eps_surprise, 6) as latest_eps_surprise, date_diff('minute', cast(lp.trade_date as timestamp), timestamp '{AS_OF}') as price_freshness_minutes
from lp left join fs using (symbol, source) left join le using (symbol, source)""")
def company_snapshot(s, d):
    f, e = models.stg_fundamentals(table(s, d, "fundamentals")), models.int_earnings_surprises(models.stg_earnings(raw_earnings(s, d)))
    return r6(models.mart_company_snapshot(staged_prices(s, d), f, e, as_of()), "latest_eps_surprise")


@query(f"with {_FUND} select symbol, source, max(period_end) as latest_period_end, max(filed_at) as latest_filed_at, count(distinct metric_name) as metrics from stg_fund group by symbol, source")
def fundamental_summary(s, d):
    f = models.stg_fundamentals(table(s, d, "fundamentals"))
    return f.groupBy("symbol", "source").agg(F.max("period_end").alias("latest_period_end"), F.max("filed_at").alias("latest_filed_at"), F.count_distinct("metric_name").alias("metrics"))


@query(f"""with {_STG}, {_FUND}, {_EARN}, {_MACRO}, {_NEWS},
metrics as (
  select 'prices' as dataset, max(trade_date)::timestamp as latest_event_time, count(*) as row_count, avg(case when symbol is null or close is null then 1.0 else 0.0 end) as null_rate, count(*) - count(distinct price_bar_key) as duplicate_count from stg_prices
  union all select 'fundamentals', max(period_end)::timestamp, count(*), avg(case when symbol is null or metric_name is null or value is null then 1.0 else 0.0 end), count(*) - count(distinct md5(source || '|' || source_record_id)) from stg_fund
  union all select 'earnings', max(event_timestamp)::timestamp, count(*), avg(case when symbol is null or event_timestamp is null then 1.0 else 0.0 end), count(*) - count(distinct md5(source || '|' || source_record_id)) from stg_earn
  union all select 'macro', max(observation_date)::timestamp, count(*), avg(case when series_id is null or value is null then 1.0 else 0.0 end), count(*) - count(distinct macro_observation_key) from stg_mac
  union all select 'news', max(event_timestamp)::timestamp, count(*), avg(case when headline is null or event_timestamp is null then 1.0 else 0.0 end), count(*) - count(distinct md5(source || '|' || source_record_id)) from stg_new),
latest as (select * from (select *, row_number() over (partition by dataset order by completed_at desc, run_id desc) as r from ingestion_runs) where r = 1),
good as (select * from (select *, row_number() over (partition by dataset order by completed_at desc, run_id desc) as r from ingestion_runs where status = 'success') where r = 1)
select m.dataset, g.run_id as last_successful_run, g.completed_at as last_successful_run_at, m.latest_event_time, date_diff('minute', m.latest_event_time, timestamp '{AS_OF}') as freshness_minutes, m.row_count, round(m.null_rate, 6) as null_rate, m.duplicate_count, coalesce(l.quarantined_rows, 0) as quarantine_count,
  case when m.row_count = 0 then 'empty' when m.duplicate_count > 0 or m.null_rate > 0 or coalesce(l.quarantined_rows, 0) > 0 then 'degraded' when g.run_id is null then 'unknown' else 'healthy' end as status
from metrics m left join latest l using (dataset) left join good g using (dataset)""")
def dataset_health(s, d):
    staged = {"prices": staged_prices(s, d), "fundamentals": models.stg_fundamentals(table(s, d, "fundamentals")), "earnings": models.stg_earnings(raw_earnings(s, d)), "macro": models.stg_macro(table(s, d, "macro_readings")), "news": models.stg_news(raw_news(s, d))}
    return r6(models.mart_pipeline_dataset_health(staged, table(s, d, "ingestion_runs"), as_of()), "null_rate")


_CONTEXT = f"""with {_VOL},
ctx as (select symbol, trade_date, source, last_value(close ignore nulls) over w as prior_daily_close, last_value(daily_return ignore nulls) over w as prior_daily_return, last_value(rolling_20d_volatility ignore nulls) over w as prior_20d_volatility,
  last_value(relative_volume ignore nulls) over w as prior_relative_volume, last_value(close ignore nulls) over w / nullif(first_value(close ignore nulls) over w, 0) - 1.0 as recent_5d_return
  from daily_ window w as (partition by symbol order by trade_date, source rows between 4 preceding and current row)),
ctx1 as (select * from (select *, row_number() over (partition by symbol, trade_date order by source desc) as r from ctx) where r = 1)"""


@query(f"""{_CONTEXT}, ev as (select delivery_id, upper(symbol) as symbol, event_timestamp, cast(event_timestamp as date) as day from stream_events)
select e.delivery_id, c.trade_date as context_trade_date, c.prior_daily_close, round(c.prior_daily_return, 6) as prior_daily_return, round(c.prior_20d_volatility, 6) as prior_20d_volatility, round(c.prior_relative_volume, 6) as prior_relative_volume, round(c.recent_5d_return, 6) as recent_5d_return
from ev e asof left join ctx1 c on e.symbol = c.symbol and e.day > c.trade_date""")
def asof_context(s, d):
    e = table(s, d, "stream_events").select("delivery_id", F.upper("symbol").alias("symbol"), F.to_date("event_timestamp").alias("day"))
    c = models.trailing_context(daily(s, d)).withColumnRenamed("trade_date", "context_trade_date").withColumnRenamed("source", "_source")
    out = asof_join(e, c, ["symbol"], "day", "context_trade_date", strict=True, tie_break=["_source"])
    return r6(out.drop("symbol", "day", "_source"), "prior_daily_return", "prior_20d_volatility", "prior_relative_volume", "recent_5d_return")


@query(f"""with {_RET}, {_MARKET}, five as (select trade_date, product(1.0 + mean_return) over (order by trade_date rows between 4 preceding and current row) - 1.0 as r5 from market_),
ev as (select delivery_id, cast(event_timestamp as date) as day from stream_events) select e.delivery_id, round(f.r5, 6) as recent_5d_market_return from ev e asof left join five f on e.day > f.trade_date""")
def asof_market_5d(s, d):
    e = table(s, d, "stream_events").select("delivery_id", F.to_date("event_timestamp").alias("day"))
    m = models.market_context(models.mart_market_daily(returns(s, d)))
    days = asof_join(e.select("day").distinct().withColumn("k", F.lit(1)), m.withColumn("k", F.lit(1)), ["k"], "day", "trade_date", strict=True)
    return r6(e.join(days.select("day", "recent_5d_market_return"), "day", "left").drop("day"), "recent_5d_market_return")


@query(f"""with {_EARN}, one as (select * from (select *, row_number() over (partition by symbol, event_timestamp order by source_record_id desc) as r from surp) where r = 1),
ev as (select delivery_id, upper(symbol) as symbol, event_timestamp from stream_events)
select e.delivery_id, o.event_timestamp as latest_earnings_timestamp, o.event_status as latest_earnings_status, round(o.eps_surprise, 6) as latest_eps_surprise from ev e asof left join one o on e.symbol = o.symbol and e.event_timestamp > o.event_timestamp""")
def asof_prior_event(s, d):
    e = table(s, d, "stream_events").select("delivery_id", F.upper("symbol").alias("symbol"), F.col("event_timestamp").cast("timestamp").alias("t"))
    p = models.int_earnings_surprises(models.stg_earnings(raw_earnings(s, d))).select("symbol", F.col("event_timestamp").alias("latest_earnings_timestamp"), F.col("event_status").alias("latest_earnings_status"), F.col("eps_surprise").alias("latest_eps_surprise"), F.col("source_record_id").alias("_r"))
    out = asof_join(e, p, ["symbol"], "t", "latest_earnings_timestamp", strict=True, tie_break=["_r"])
    return r6(out.drop("symbol", "t", "_r"), "latest_eps_surprise")


@query(f"""{_CONTEXT}, {_MARKET}, {_EARN},
five as (select trade_date, product(1.0 + mean_return) over (order by trade_date rows between 4 preceding and current row) - 1.0 as recent_5d_market_return from market_),
one as (select * from (select *, row_number() over (partition by symbol, event_timestamp order by source_record_id desc) as r from surp) where r = 1),
ev as (select event_id, upper(symbol) as symbol, event_timestamp, event_type, price as event_price, anomaly_score, details_json, detected_at, source_topic, kafka_partition, kafka_offset, ingested_at, cast(event_timestamp as date) as day from stream_events),
a as (select e.*, c.trade_date as context_trade_date, c.prior_daily_close, c.prior_daily_return, c.prior_20d_volatility, c.prior_relative_volume, c.recent_5d_return from ev e asof left join ctx1 c on e.symbol = c.symbol and e.day > c.trade_date),
b as (select a.*, f.recent_5d_market_return from a asof left join five f on a.day > f.trade_date)
select b.* exclude (day, event_price, anomaly_score, prior_daily_return, prior_20d_volatility, prior_relative_volume, recent_5d_return, recent_5d_market_return), case when isnan(event_price) then null else event_price end as event_price, case when isnan(anomaly_score) then null else anomaly_score end as anomaly_score,
  round(prior_daily_return, 6) as prior_daily_return, round(prior_20d_volatility, 6) as prior_20d_volatility, round(prior_relative_volume, 6) as prior_relative_volume, round(recent_5d_return, 6) as recent_5d_return, round(recent_5d_market_return, 6) as recent_5d_market_return,
  round(recent_5d_return - recent_5d_market_return, 6) as recent_factor_excess_return, o.event_timestamp as latest_earnings_timestamp, o.event_status as latest_earnings_status, round(o.eps_surprise, 6) as latest_eps_surprise, round(o.eps_surprise_percent, 6) as latest_eps_surprise_percent
from b asof left join one o on b.symbol = o.symbol and b.event_timestamp > o.event_timestamp""")
def stream_anomalies(s, d):
    v = models.int_rolling_volatility(returns(s, d))
    out = models.mart_stream_anomalies(table(s, d, "stream_events"), models.mart_security_daily(v), models.mart_market_daily(returns(s, d)), models.int_earnings_surprises(models.stg_earnings(raw_earnings(s, d))))
    out = out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("event_price", "anomaly_score")})
    return r6(out, "prior_daily_return", "prior_20d_volatility", "prior_relative_volume", "recent_5d_return", "recent_5d_market_return", "recent_factor_excess_return", "latest_eps_surprise", "latest_eps_surprise_percent")


# --- scans, projections, filters ------------------------------------------------------------------------------


@query("select o_orderkey, o_custkey, o_totalprice, year(o_orderdate) as y, month(o_orderdate) as m from orders where year(o_orderdate) = 1997 and month(o_orderdate) = 6")
def scan_partition_pruned(s, d):
    """Write the orders by year and month once, then read one month: the scan lists one directory."""
    from ..sources.storage import scratch

    path = scratch(s, "orders-by-month")
    o = table(s, d, "orders")
    o.withColumn("year", F.date_format("o_orderdate", "yyyy")).withColumn("month", F.date_format("o_orderdate", "MM")).repartition("year", "month").write.partitionBy("year", "month").parquet(path)
    part = s.read.option("basePath", path).parquet(path).where("year = '1997' and month = '06'")
    return part.select("o_orderkey", "o_custkey", "o_totalprice", F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"))


@query("select cast(null as varchar) as dataset, cast(null as bigint) as row_count, cast(null as date) as day where false")
def empty_relation(s, d):
    return s.createDataFrame([], "dataset string, row_count bigint, day date")


@query("with names(dataset) as (values ('prices'), ('fundamentals'), ('earnings'), ('macro'), ('news')) select n.dataset, coalesce(r.n, 0) as runs from names n left join (select dataset, count(*) as n from ingestion_runs group by dataset) r using (dataset)")
def values_left_join(s, d):
    names = s.sql("select * from values ('prices'), ('fundamentals'), ('earnings'), ('macro'), ('news') as t(dataset)")
    runs = table(s, d, "ingestion_runs").groupBy("dataset").agg(F.count("*").alias("n"))
    return names.join(runs, "dataset", "left").select("dataset", F.coalesce("n", F.lit(0)).alias("runs"))


@query("""select 'S' || lpad(cast(i as varchar), 3, '0') as symbol, cast(day as date) as day, row_number() over (partition by i order by day) as day_no
from range(20) t(i), generate_series(timestamp '2021-01-01', timestamp '2021-03-31', interval 1 day) g(day) where dayofweek(day) between 1 and 5""")
def calendar_generate(s, d):
    days = s.sql("select explode(sequence(date'2021-01-01', date'2021-03-31', interval 1 day)) as day").where("weekday(day) between 0 and 4")
    grid = s.range(20).crossJoin(F.broadcast(days))  # a generator of two fixed ranges
    return grid.select(F.concat(F.lit("S"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("symbol"), "day", F.row_number().over(Window.partitionBy("id").orderBy("day")).alias("day_no"))


@query("select l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) as net, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) as gross from lineitem")
def lateral_alias(s, d):
    one = table(s, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_extendedprice * (1 - l_discount) as net0", "round(net0, 4) as net", "round(net0 * (1 + l_tax), 6) as gross")
    return one.drop("net0")


@query("select case upper(trim(frequency)) when 'D' then 'DAILY' when 'W' then 'WEEKLY' when 'M' then 'MONTHLY' when 'Q' then 'QUARTERLY' when 'A' then 'ANNUAL' else upper(trim(frequency)) end as frequency, count(*) as n from macro_readings group by 1")
def case_map(s, d):
    from ..functions.columns import frequency_name

    return table(s, d, "macro_readings").groupBy(frequency_name("frequency").alias("frequency")).agg(F.count("*").alias("n"))


@query("select source_record_id, symbol, filed_at from fundamentals where (period_start is null or period_end >= period_start) and (filed_at is null or filed_at <= ingested_at)")
def null_guard_filter(s, d):
    return table(s, d, "fundamentals").where("(period_start is null or period_end >= period_start) and (filed_at is null or filed_at <= ingested_at)").select("source_record_id", "symbol", "filed_at")


@query(f"with {_NEWS} select source_record_id, url from n_rows where length(headline) > 0 and (starts_with(url, 'http://') or starts_with(url, 'https://'))")
def url_filter(s, d):
    n = raw_news(s, d).withColumn("url", F.trim("url"))
    web = F.startswith("url", F.lit("http://")) | F.startswith("url", F.lit("https://"))
    return n.where((F.length(F.trim("headline")) > 0) & web).select("source_record_id", "url")


@query("select symbol, cast(date as varchar) as date, source_record_id from prices where date is null or date between date '2025-03-01' and date '2025-03-31'")
def event_window_filter(s, d):
    """Ingestion's own window: rows in it and, for quarantine, those without a readable date."""
    from ..plans.ingest import in_window

    picked = in_window(price_payloads(s, d), CONTRACTS["prices"], dt.date(2025, 3, 1), dt.date(2025, 3, 31))
    return picked.select(*[F.get_json_object("payload", f"$.{c}").alias(c) for c in ("symbol", "date", "source_record_id")])


@query("select symbol, date, close from prices, (select max(date) as latest from prices) where date > latest - interval 12 month and date <= latest")
def one_year_history(s, d):
    p = table(s, d, "prices")
    latest = p.agg(F.max("date").alias("latest"))
    return p.join(F.broadcast(latest), (F.col("date") > F.add_months("latest", -12)) & (F.col("date") <= F.col("latest"))).select("symbol", "date", "close")


@query(f"with {_VOL} select (select count(*) from stg_prices) as staged, (select count(*) from daily_) as mart, (select count(*) from stg_prices) = (select count(*) from daily_) as equal")
def row_count_reconcile(s, d):
    a, b = staged_prices(s, d).agg(F.count("*").alias("staged")), daily(s, d).agg(F.count("*").alias("mart"))
    return a.join(F.broadcast(b)).withColumn("equal", F.col("staged") == F.col("mart"))


# --- deduplication, keys, conflicts ---------------------------------------------------------------------------


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate from (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_shipdate desc, l_partkey desc, l_suppkey desc) as r from lineitem) where r = 1")
def dedup_latest(s, d):
    return keep_latest(table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey"], ["l_partkey", "l_suppkey", "l_shipdate"])


@query("select o_custkey, o_orderkey, o_orderdate, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as r from orders) where r = 1")
def latest_per_key(s, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return table(s, d, "orders").withColumn("r", F.row_number().over(w)).where("r = 1").drop("r").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")


@query("select dataset, run_id, status, completed_at from (select *, row_number() over (partition by dataset order by completed_at desc, run_id desc) as r from ingestion_runs) where r = 1")
def latest_run(s, d):
    return keep_latest(table(s, d, "ingestion_runs"), ["dataset"], ["completed_at", "run_id"], ["run_id", "status", "completed_at"])


@query("select run_id, dataset, status, completed_at from (select distinct run_id, dataset, status, completed_at from ingestion_runs) order by completed_at desc, run_id desc limit 100")
def runs_latest(s, d):
    return table(s, d, "ingestion_runs").select("run_id", "dataset", "status", "completed_at").distinct().orderBy(F.desc("completed_at"), F.desc("run_id")).limit(100)


_CLASSIFY = """with rows_ as (select upper(trim(symbol)) as symbol, date, lower(trim(source)) as source, open, high, low, close, volume, ingested_at from prices where symbol is not null and date is not null),
cut as (select max(ingested_at) - interval 90 day as t from rows_),
old as (select symbol, date, source, max((open, high, low, close, volume)) as held, count(distinct (open, high, low, close, volume)) as variants from rows_, cut where ingested_at <= t group by all),
fresh as (select symbol, date, source, (open, high, low, close, volume) as now from rows_, cut where ingested_at > t)
"""


@query(_CLASSIFY + "select case when o.symbol is null then 'new' when o.variants = 1 and f.now is not distinct from o.held then 'duplicate' else 'conflict' end as kind, count(*) as n from fresh f left join old o on f.symbol = o.symbol and f.date = o.date and f.source = o.source group by 1")
def dedup_classify(s, d):
    """Ingestion's own classification of incoming rows against retained ones: new, duplicate (same values) or conflict."""
    from ..plans.ingest import classify

    rows = table(s, d, "prices").select(upper_key("symbol").alias("symbol"), "date", "open", "high", "low", "close", "volume", lower_key("source").alias("source"), "source_record_id", "ingested_at").where("symbol is not null and date is not null")
    cut = rows.agg((F.max("ingested_at") - F.expr("interval 90 days")).alias("t"))
    marked = rows.join(F.broadcast(cut))  # one row
    old, fresh = marked.where("ingested_at <= t").drop("t"), marked.where("ingested_at > t").drop("t")
    return classify(fresh, old, CONTRACTS["prices"]).groupBy("kind").agg(F.count("*").alias("n"))


@query("select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2 having count(*) > 1")
def duplicate_keys(s, d):
    return table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


@query("select upper(trim(symbol)) as symbol, date, lower(trim(source)) as source, count(distinct (close, volume)) as variants from prices where symbol is not null group by all having count(distinct (close, volume)) > 1")
def conflict_keys(s, d):
    p = table(s, d, "prices").where("symbol is not null")
    return p.groupBy(upper_key("symbol").alias("symbol"), "date", lower_key("source").alias("source")).agg(F.count_distinct(F.struct("close", "volume")).alias("variants")).where("variants > 1")


@query("select distinct upper(trim(series_id)) as series_id, lower(trim(source)) as source from macro_readings")
def distinct_pairs(s, d):
    return table(s, d, "macro_readings").select(upper_key("series_id").alias("series_id"), lower_key("source").alias("source")).distinct()


@query("select count(distinct (source, currency, period_start)) as n, count(*) as total from fundamentals")
def distinct_struct(s, d):
    return table(s, d, "fundamentals").agg(F.count_distinct(F.struct("source", "currency", "period_start")).alias("n"), F.count("*").alias("total"))


@query("""select compaction_id, symbol, date, source, close, volume, ingested_at from (
  select compaction_id, upper(trim(symbol)) as symbol, date, lower(trim(source)) as source, close, volume, ingested_at, row_number() over (partition by compaction_id, upper(trim(symbol)), date, lower(trim(source)) order by ingested_at desc, source_record_id desc, close desc, volume desc) as r
  from lake_fragments where file_role = 'input') where r = 1""")
def compact_dedup(s, d):
    f = table(s, d, "lake_fragments").where("file_role = 'input'").select("compaction_id", upper_key("symbol").alias("symbol"), "date", lower_key("source").alias("source"), "close", "volume", "source_record_id", "ingested_at")
    return keep_latest(f, ["compaction_id", "symbol", "date", "source"], ["ingested_at", "source_record_id"], ["close", "volume", "ingested_at"])


# --- joins ----------------------------------------------------------------------------------------------------


@query(f"with {_FUND}, eff as (select symbol, metric_name, source, source_record_id, coalesce(filed_at, cast(period_end as timestamp)) as f, lead(coalesce(filed_at, cast(period_end as timestamp))) over (partition by symbol, metric_name, period_end, source order by coalesce(filed_at, cast(period_end as timestamp)), ingested_at, source_record_id) as t from stg_fund), req as (select distinct request_id, upper(trim(symbol)) as symbol, lower(trim(metric_name)) as metric_name, lower(trim(source)) as source, cast(trade_date as timestamp) as at from snapshot_requests) select r.request_id, e.source_record_id from req r join eff e on r.symbol = e.symbol and r.metric_name = e.metric_name and r.source = e.source and r.at >= e.f and (e.t is null or r.at < e.t)")
def interval_join_(s, d):
    eff = models.int_security_fundamentals(models.stg_fundamentals(table(s, d, "fundamentals"))).select("symbol", "metric_name", "source", "source_record_id", "effective_from", "effective_to")
    req = table(s, d, "snapshot_requests").select("request_id", upper_key("symbol").alias("symbol"), lower_key("metric_name").alias("metric_name"), lower_key("source").alias("source"), F.col("trade_date").cast("timestamp").alias("at")).distinct()
    return interval_join(req, eff, ["symbol", "metric_name", "source"], "at", "effective_from", "effective_to").select("request_id", "source_record_id")


@query("select o.o_orderkey from orders o left join lineitem l on o.o_orderkey = l.l_orderkey where l.l_orderkey is null")
def anti_missing(s, d):
    return table(s, d, "orders").join(table(s, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query("select count(*) as violations from lineitem where l_orderkey is not null and l_orderkey not in (select o_orderkey from orders)")
def fk_violations(s, d):
    from ..plans import checks

    return checks.relationships(table(s, d, "lineitem"), "l_orderkey", table(s, d, "orders"), "o_orderkey").agg(F.count("*").alias("violations"))


@query("select distinct upper(trim(symbol)) as symbol from stream_events where symbol is not null and upper(trim(symbol)) not in (select upper(trim(symbol)) from fundamentals where symbol is not null)")
def unknown_symbols(s, d):
    from ..plans import quality

    return quality.unknown_symbols(table(s, d, "stream_events"), table(s, d, "fundamentals").select("symbol"))


# --- aggregates -----------------------------------------------------------------------------------------------


@query("select lower(trim(source)) as source, count(*) as n, cast(sum(volume) as bigint) as volume, min(close) as low, max(close) as high, round(avg(close), 4) as mean from prices group by 1")
def full_history_agg(s, d):
    return table(s, d, "prices").groupBy(lower_key("source").alias("source")).agg(F.count("*").alias("n"), F.sum("volume").alias("volume"), F.min("close").alias("low"), F.max("close").alias("high"), F.round(F.avg("close"), 4).alias("mean"))


@query("select l_orderkey % 11 as bucket, count(*) as n, round(sum(l_extendedprice), 2) as total from lineitem group by 1")
def bucket_agg(s, d):
    return table(s, d, "lineitem").groupBy((F.col("l_orderkey") % 11).alias("bucket")).agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query(f"""with {_STG}, marks as (select *, md5(concat_ws('|', symbol, strftime(trade_date, '%Y-%m-%d'), source, cast(cast(round(close * 10000) as bigint) as varchar), cast(volume as varchar))) as m from stg_prices)
select count(*) as n, cast(sum(cast(('0x' || substring(m, 1, 8)) as bigint)) as bigint) as hash, cast(sum(volume) as bigint) as volume, min(trade_date) as first, max(trade_date) as last from marks""")
def fingerprint(s, d):
    """An order-insensitive fingerprint of the staged bars: the sum of 32 bits of each row's md5."""
    mark = F.md5(F.concat_ws("|", "symbol", F.date_format("trade_date", "yyyy-MM-dd"), "source", F.round(F.col("close") * 10000).cast("bigint").cast("string"), F.col("volume").cast("string")))
    p = staged_prices(s, d).withColumn("_m", F.conv(F.substring(mark, 1, 8), 16, 10).cast("bigint"))
    return p.agg(F.count("*").alias("n"), F.sum("_m").alias("hash"), F.sum("volume").alias("volume"), F.min("trade_date").alias("first"), F.max("trade_date").alias("last"))


@query(f"with {_RET}, {_MARKET} select cast(date_trunc('month', trade_date) as date) as month, round(product(1.0 + mean_return) - 1.0, 6) as compounded from market_ group by 1")
def compound_return(s, d):
    m = models.mart_market_daily(returns(s, d))
    return m.groupBy(F.to_date(F.date_trunc("month", "trade_date")).alias("month")).agg(F.round(F.product(1.0 + F.col("mean_return")) - 1.0, 6).alias("compounded"))


_PROFILE = """with rows_ as (select lower(trim(source)) as source, date as event_date, upper(trim(symbol)) as symbol, open, high, low, close, volume, ingested_at, trim(source_record_id) as rid from prices where date is not null),
counted as (select source, event_date, count(*) as row_count, avg(case when symbol is null or close is null or volume is null or open is null or high is null or low is null then 1.0 else 0.0 end) as null_rate, median(close) as median_close, median(volume) as median_volume, avg(case when volume = 0 then 1.0 else 0.0 end) as zero_volume_fraction from rows_ group by source, event_date),
last_ as (select source, symbol, event_date, close from (select *, row_number() over (partition by source, symbol, event_date order by ingested_at desc, rid desc, close desc nulls last) as r from rows_ where symbol is not null) where r = 1),
before as (select *, lag(close) over (partition by source, symbol order by event_date) as previous from last_),
moved as (select source, event_date, stddev_pop(case when previous > 0 then close / previous - 1 end) as return_dispersion, count(*) as symbols from before group by source, event_date),
profile as (select c.*, return_dispersion, coalesce(symbols, 0) as symbols from counted c left join moved m on c.source is not distinct from m.source and c.event_date = m.event_date)"""


@query(_PROFILE + " select source, event_date, row_count, round(null_rate, 6) as null_rate, round(median_close, 6) as median_close, round(median_volume, 2) as median_volume, round(zero_volume_fraction, 6) as zero_volume_fraction, round(return_dispersion, 4) as return_dispersion, symbols from profile")
def daily_profile(s, d):
    from ..plans import quality

    out = quality.daily_profile(table(s, d, "prices"))
    return out.select("source", "event_date", "row_count", F.round("null_rate", 6).alias("null_rate"), F.round("median_close", 6).alias("median_close"), F.round("median_volume", 2).alias("median_volume"), F.round("zero_volume_fraction", 6).alias("zero_volume_fraction"), F.round("return_dispersion", 4).alias("return_dispersion"), "symbols")


_BASELINE = _PROFILE + """, numbered as (select *, row_number() over (partition by source order by event_date) as n from profile),
medians as (select a.source, a.event_date, count(*) as days, median(b.row_count) as rc, count(b.median_volume) as nv, median(b.median_volume) as mv, count(b.median_close) as nc, median(b.median_close) as mc, count(b.return_dispersion) as nd, median(b.return_dispersion) as rd
  from numbered a join numbered b on a.source is not distinct from b.source and b.n between a.n - 60 and a.n - 1 group by a.source, a.event_date),
mads as (select a.source, a.event_date, median(abs(b.row_count - rc)) as rc_d, median(abs(b.median_volume - mv)) as mv_d, median(abs(b.median_close - mc)) as mc_d, median(abs(b.return_dispersion - rd)) as rd_d
  from numbered a join medians m on a.source is not distinct from m.source and a.event_date = m.event_date join numbered b on a.source is not distinct from b.source and b.n between a.n - 60 and a.n - 1 group by a.source, a.event_date),
scored as (select p.*, coalesce(days, 0) as baseline_days, abs(row_count - rc) / greatest(1.4826 * rc_d, 0.01 * abs(rc), 1e-9) as z_rows, case when nv >= 20 then abs(p.median_volume - mv) / greatest(1.4826 * mv_d, 0.01 * abs(mv), 1e-9) end as z_volume,
  case when nc >= 20 then abs(p.median_close - mc) / greatest(1.4826 * mc_d, 0.01 * abs(mc), 1e-9) end as z_close, case when nd >= 20 then abs(p.return_dispersion - rd) / greatest(1.4826 * rd_d, 0.01 * abs(rd), 1e-9) end as z_dispersion
  from profile p left join medians m on p.source is not distinct from m.source and p.event_date = m.event_date left join mads d on p.source is not distinct from d.source and p.event_date = d.event_date)"""


@query(_BASELINE + " select source, event_date, baseline_days, round(z_rows, 6) as robust_z from scored")
def robust_z(s, d):
    from ..plans import quality

    return quality.with_baseline(quality.daily_profile(table(s, d, "prices")), ["row_count"]).select("source", "event_date", "baseline_days", F.round("row_count_z", 6).alias("robust_z"))


@query(_BASELINE + """ select source, event_date, baseline_days, symbols, case when null_rate >= 0.01 or zero_volume_fraction >= 0.2 or (baseline_days >= 20 and greatest(z_rows, z_volume, z_close, z_dispersion) >= 8) then 'FAILED'
  when null_rate >= 0.001 or zero_volume_fraction >= 0.05 or (baseline_days >= 20 and greatest(z_rows, z_volume, z_close, z_dispersion) >= 4) then 'DEGRADED' when baseline_days < 20 then 'UNKNOWN' else 'HEALTHY' end as status from scored""")
def quality_status(s, d):
    from ..plans import quality

    return quality.judge_days(quality.daily_profile(table(s, d, "prices"))).select("source", "event_date", "baseline_days", "symbols", "status")


@query("select lower(trim(source)) as source, percentile_disc(0.95) within group (order by close) as p95 from (select source, close from prices where close is not null) group by 1")
def p95_nearest_rank(s, d):
    from ..operators.ranks import nearest_rank

    return nearest_rank(table(s, d, "prices").select(lower_key("source").alias("source"), "close"), "source", "close", 0.95, "p95")


@query("select date_trunc('hour', event_timestamp) as window_start, event_type, count(*) as n from stream_events group by 1, 2")
def hourly_event_buckets(s, d):
    e = table(s, d, "stream_events")
    w = F.window(F.col("event_timestamp").cast("timestamp"), "1 hour")
    return e.where("event_timestamp is not null").groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")


_GOOD_EVENT = "trim(event_id) <> '' and trim(symbol) <> '' and trim(event_type) <> '' and event_timestamp is not null"


@query(f"""with good as (select *, row_number() over (partition by lower(trim(event_id)) order by source_topic, delivery_id) as r from stream_events where {_GOOD_EVENT})
select count(*) as polled_messages, (select count(*) from good where r = 1) as accepted_events, (select count(*) from good where r > 1) as duplicate_events, count(*) - (select count(*) from good) as quarantined_events from stream_events""")
def stream_dedup(s, d):
    """All messages as one batch of the event lake, at positions of their own, so that event_id alone decides. The rule with both identities is p5_found."""
    from ..sources.storage import scratch
    from ..streaming.bridge import EventLake

    e = table(s, d, "stream_events")
    at = F.date_format("event_timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    value = F.to_json(F.struct("event_id", "symbol", at.alias("event_timestamp"), "event_type", F.when(~F.isnan("price"), F.col("price")).alias("price"), F.when(~F.isnan("anomaly_score"), F.col("anomaly_score")).alias("anomaly_score")))
    r = EventLake(s, scratch(s, "event-lake")).take_batch(e.select(F.col("source_topic").alias("topic"), F.lit(0).alias("partition"), F.col("delivery_id").alias("offset"), value.alias("value")), "all")
    return s.createDataFrame([(r.polled_messages, r.accepted_events, r.duplicate_events, r.quarantined_events)], "polled_messages bigint, accepted_events bigint, duplicate_events bigint, quarantined_events bigint")


@query("select p.source, count(*) as late_rows, min(p.date) as earliest from (select lower(trim(source)) as source, date, ingested_at from prices where date is not null and symbol is not null) p join (select arrival_time, max(prior_event_watermark) as w from ingestion_runs group by 1) r on p.ingested_at = r.arrival_time where p.date <= r.w group by 1")
def late_arrivals(s, d):
    """Deliveries of the late-window operator that came at or before the watermark, within the cut-off or not."""
    from ..operators.latewindow import deliveries

    late = deliveries(table(s, d, "prices"), table(s, d, "ingestion_runs")).where("timing <> 'on_time'")
    return late.groupBy("source").agg(F.count("*").alias("late_rows"), F.min("event_date").alias("earliest"))


# --- contracts and quarantine ---------------------------------------------------------------------------------


def price_payloads(s: SparkSession, d: str) -> DataFrame:
    """The price rows as JSON payloads, sources by their cleaned names."""
    p = table(s, d, "prices").withColumn("source", lower_key("source")).withColumn("ingested_at", F.date_format("ingested_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    row = F.struct("symbol", F.col("date").cast("string").alias("date"), "open", "high", "low", "close", "volume", "source", "source_record_id", "ingested_at")
    return p.select("source", F.to_json(row, {"ignoreNullFields": "false"}).alias("payload"), F.monotonically_increasing_id().alias("position"))


def validated_prices(s: SparkSession, d: str) -> list[tuple[str, DataFrame]]:
    """Per source the price payloads judged by the contract."""
    from ..sources.contracts import validate

    payloads = price_payloads(s, d)
    sources = sorted(r.source for r in payloads.select("source").distinct().collect() if r.source is not None)  # data providers
    return [(name, validate(CONTRACTS["prices"], payloads.where(F.col("source") == name).select("payload", "position"), name)) for name in sources]


_JUDGED = """with rows_ as (select lower(trim(source)) as source, upper(trim(symbol)) as s, date as d, open, high, low, close, volume, trim(source_record_id) as rid, ingested_at from prices where source is not null),
first_ as (select *, case when s is null or s = '' then 'symbol' when d is null then 'date' when open is null or isnan(open) then 'open' when high is null or isnan(high) then 'high' when low is null or isnan(low) then 'low' when close is null or isnan(close) then 'close' when volume is null then 'volume'
  when rid is null or rid = '' then 'source_record_id' when ingested_at is null then 'ingested_at' when open <= 0 then 'open' when high <= 0 then 'high' when low <= 0 then 'low' when close <= 0 then 'close' when volume < 0 then 'volume' when high < greatest(low, open, close) then 'high' when low > least(open, close) then 'low' end as field from rows_),
judged as (select source, coalesce(field, case when row_number() over (partition by source, field is null, s, d) > 1 then 'duplicate' end) as field from first_)"""


@query(_JUDGED + " select source, field, count(*) as n from judged where field is not null group by 1, 2")
def contract_violations(s, d):
    """Rows that the price contract quarantines, by source and the field of the first error."""
    out = None
    for name, judged in validated_prices(s, d):
        first = F.get("errors", 0)
        field = F.when(F.startswith(first, F.lit("duplicate")), "duplicate").otherwise(F.substring_index(first, ":", 1))
        one = judged.where(F.size("errors") > 0).groupBy(field.alias("field")).agg(F.count("*").alias("n")).select(F.lit(name).alias("source"), "field", "n")
        out = one if out is None else out.unionByName(one)
    return out if out is not None else s.createDataFrame([], "source string, field string, n bigint")


@query(_JUDGED + " select source, 'contract_violation' as error_type, count(*) as records from judged where field is not null group by 1")
def quarantine_summary(s, d):
    """The quarantined rows written as ingestion does, and summed up by the service's own reader."""
    from ..plans.serving import summarize_quarantine
    from ..sources.contracts import quarantined
    from ..sources.storage import HadoopFiles, scratch

    root = scratch(s, "quarantine")
    for name, judged in validated_prices(s, d):
        quarantined(judged, name, "run", AS_OF).hint("rebalance").write.json(f"{root}/source={name}/run=run")
    files = [p for p, _, _ in HadoopFiles(s, root).list(root, recursive=True) if p.endswith(".json")]
    groups = summarize_quarantine(s, files)["groups"]
    return s.createDataFrame([(g["source"], g["error_type"], g["records"]) for g in groups], "source string, error_type string, records bigint")


# --- serving --------------------------------------------------------------------------------------------------


def service(s: SparkSession, d: str, *marts: str):
    """The query service over freshly published marts."""
    from ..plans.serving import QueryService
    from ..sources.storage import publish_table, scratch

    root = scratch(s, "marts")
    made = {
        "mart_company_snapshot": lambda: models.mart_company_snapshot(staged_prices(s, d), models.stg_fundamentals(table(s, d, "fundamentals")), models.int_earnings_surprises(models.stg_earnings(raw_earnings(s, d))), as_of()),
        "mart_security_daily": lambda: daily(s, d),
        "mart_market_daily": lambda: models.mart_market_daily(returns(s, d)),
        "mart_sector_daily": lambda: models.mart_sector_daily(returns(s, d), sectors(s, d)),
    }
    for name in marts:
        publish_table(made[name](), f"{root}/{name}")
    return QueryService(s, root)


def answer(s: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """An endpoint's bounded result with the columns of the schema."""
    names = [c.split()[0] for c in schema.split(", ")]
    return s.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)


@query(f"with {_STG} select symbol, source, max(trade_date) as latest_price_date from stg_prices group by symbol, source order by symbol, source limit 100")
def securities_list(s, d):
    return answer(s, service(s, d, "mart_company_snapshot").securities(100), "symbol string, source string, latest_price_date date")


@query(f"with {_STG} select symbol, source, trade_date as latest_price_date, close as latest_price from stg_prices where symbol = upper('qvelta') order by source, trade_date desc limit 1")
def security_detail(s, d):
    found = service(s, d, "mart_company_snapshot").security("qvelta")
    return answer(s, [found] if found else [], "symbol string, source string, latest_price_date date, latest_price double")


@query(f"with {_VOL} select symbol, source, trade_date, close, round(daily_return, 6) as daily_return from daily_ where symbol = 'QVELTA' and source = 'barstream' order by trade_date desc limit 252")
def security_history(s, d):
    return r6(answer(s, service(s, d, "mart_security_daily").history("qvelta", "barstream", 252), "symbol string, source string, trade_date date, close double, daily_return double"), "daily_return")


@query(f"with {_RET}, {_MARKET} select trade_date, advancers, decliners, unchanged, round(market_breadth, 6) as market_breadth from market_ order by trade_date desc limit 90")
def market_breadth(s, d):
    return r6(answer(s, service(s, d, "mart_market_daily").market_breadth(90), "trade_date date, advancers bigint, decliners bigint, unchanged bigint, market_breadth double"), "market_breadth")


@query(f"with {_RET}, {_SECTOR_DAILY} select sector, max(trade_date) as latest_date, round(arg_max(sector_average_return, trade_date), 6) as sector_average_return, arg_max(securities_with_returns, trade_date) as securities_with_returns from sector_daily_ group by sector order by sector limit 100")
def sectors_list(s, d):
    return r6(answer(s, service(s, d, "mart_sector_daily").sectors(100), "sector string, latest_date date, sector_average_return double, securities_with_returns bigint"), "sector_average_return")


# --- ranks, layouts, dimensions, formats ----------------------------------------------------------------------


@query("select o_orderkey, o_orderdate, row_number() over (order by o_orderdate, o_orderkey) as row_no from orders")
def global_row_number(s, d):
    from ..operators.ranks import global_row_number as numbered

    return numbered(table(s, d, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], "row_no")


@query("select row_number() over () as row_no from region")
def row_number_over_nothing(s, d):
    """Rows numbered in no particular order, so only the numbers are compared."""
    from ..operators.ranks import global_row_number as numbered

    return numbered(table(s, d, "region").select("r_name"), ["r_name"], "row_no").select("row_no")


@query("select o_orderstatus, o_orderpriority, count(*) as n from orders group by 1, 2 order by 1, 2")
def ordinal_group_by(s, d):
    table(s, d, "orders").createOrReplaceTempView("ordinal_orders")
    return s.sql("select o_orderstatus, o_orderpriority, count(*) as n from ordinal_orders group by 1, 2 order by 1, 2")


@query("select s_name as symbol, n_name as industry, r_name as sector from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey order by s_name")
def security_dimension(s, d):
    """Security, industry and sector: a seed file for the sectors, foreign keys from each level to the next, ordered output."""
    from ..plans import checks
    from ..sources.readers import read_seed
    from ..sources.storage import scratch

    seed = scratch(s, "sectors")
    table(s, d, "region").select(F.col("r_regionkey").alias("sector_id"), F.col("r_name").alias("sector")).write.option("header", True).csv(seed)
    sector = read_seed(s, seed, "sector_id int, sector string", ["sector_id"])
    industry = table(s, d, "nation").select(F.col("n_nationkey").alias("industry_id"), F.col("n_name").alias("industry"), F.col("n_regionkey").alias("sector_id"))
    security = table(s, d, "supplier").select(F.col("s_name").alias("symbol"), F.col("s_nationkey").alias("industry_id"))
    for child, key, parent in ((industry, "sector_id", sector), (security, "industry_id", industry)):
        if checks.relationships(child, key, parent, key).limit(1).count():
            raise ValueError(f"{key} has no parent")
    return security.join(industry, "industry_id").join(sector, "sector_id").select("symbol", "industry", "sector").orderBy("symbol")


@query("select f.format, count(*) as n, round(sum(o_totalprice), 2) as total, min(o_orderdate) as first from orders, (values ('csv'), ('json'), ('parquet none'), ('parquet snappy'), ('parquet zstd')) f(format) group by 1")
def storage_formats(s, d):
    """The orders written and read again as CSV, JSON lines and Parquet in three codecs."""
    from ..plans.layouts import FORMATS, read_format, write_format
    from ..sources.storage import scratch

    rows, out = table(s, d, "orders").select("o_orderkey", "o_totalprice", "o_orderdate"), None
    for name in FORMATS:
        at = scratch(s, "format")
        write_format(rows, at, name)
        one = read_format(s, at, name, rows.schema).agg(F.lit(name).alias("format"), F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.min("o_orderdate").alias("first"))
        out = one if out is None else out.unionByName(one)
    return out


def queries() -> dict[str, Query]:
    return {n.rstrip("_"): f for n, (f, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {n.rstrip("_"): sql for n, (_, sql) in REGISTRY.items() if sql}
