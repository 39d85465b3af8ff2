import datetime as dt
import math
import random
import statistics

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidegrid.operators import asknown, spikes, trailing

D, T = dt.date, dt.datetime
FUND = "symbol string, metric_name string, period_start date, period_end date, period_type string, filed_at timestamp, value double, unit string, currency string, source string, source_record_id string, ingested_at timestamp"
REQ = "request_id bigint, symbol string, trade_date date, metric_name string, source string"
PRICE = "symbol string, date date, open double, high double, low double, close double, volume bigint, source string, source_record_id string, ingested_at timestamp"
METRIC = "symbol string, source string, trade_date date, daily_return double, rolling_20d_return double, rolling_20d_volatility double, average_volume_20d double"


@pytest.mark.parametrize("every", [1, 7, 91])
def test_as_known_equals_brute_force(spark, every):
    random.seed(every)
    base = D(2020, 1, 1)
    funds, reqs = [], []
    for i in range(300):
        end = base + dt.timedelta(days=random.randint(0, 400))
        filed = random.choice([None, T(2020, 1, 1) + dt.timedelta(days=random.randint(0, 600), hours=random.randint(0, 23))])
        start = random.choice([None, end - dt.timedelta(days=random.randint(-3, 90))])
        funds.append((random.choice(["a", " A", "B", None]), random.choice(["m", "M ", "n"]), start, random.choice([end, end, end, None]), "Q", filed, float(i), "u", None, random.choice(["x", "X"]), f"r{random.randint(0, 200)}", T(2020, 1, 1) + dt.timedelta(days=random.randint(0, 700))))
    funds += funds[:20]
    for i in range(200):
        reqs.append((i, random.choice(["A", "b ", None, "Q"]), random.choice([None, *(base + dt.timedelta(days=random.randint(-10, 800)) for _ in range(9))]), random.choice(["m", "N"]), "x"))
    reqs += reqs[:10]
    clean = {}
    for f in funds:
        s, m = (f[0].strip().upper() if f[0] else None), f[1].strip().lower()
        if f[5] is None or f[5] > f[11] or (f[2] is not None and (f[3] is None or f[2] > f[3])):
            continue
        k = ("x", f[10])
        row = (f[11], s or "", m, str(f[2]), str(f[3]), f[5], f[6])
        if k not in clean or row > clean[k][0]:
            clean[k] = (row, (s, m, f[3], f[5], f[11], f[10]))
    want = {}
    for rid, s, d, m, _ in reqs:
        best = None
        for _, (fs, fm, end, filed, ing, rec) in clean.values():
            if s is None or d is None or end is None or fs != s.strip().upper() or fm != m.strip().lower() or max(end, filed.date()) > d:
                continue
            best = max(filter(None, [best, (end, filed, ing, rec)]))
        want[rid] = best[3] if best else None
    out = asknown.fundamentals_as_known(spark.createDataFrame(reqs, REQ).withColumn("period", F.lit("clash")).withColumn("known", F.lit(0)), spark.createDataFrame(funds, FUND).withColumn("version", F.lit(1)), every).collect()
    assert len(out) == len(want)
    ties = 0
    for r in out:
        if r.source_record_id != want[r.request_id]:
            ties += 1
    assert ties == 0


def test_as_known_empty(spark):
    r, f = spark.createDataFrame([], REQ), spark.createDataFrame([], FUND)
    assert rows(asknown.fundamentals_as_known(r, f)) == []
    one = spark.createDataFrame([(1, "a", D(2020, 1, 1), "m", "x")], REQ)
    assert [x.source_record_id for x in asknown.fundamentals_as_known(one, f).collect()] == [None]
    assert [x.source_record_id for x in asknown.fundamentals_as_known(spark.createDataFrame([(None,) * 5], REQ), f).collect()] == [None]


def bar(symbol, day, close, volume=100, source="s", rid="r", at=T(2024, 12, 1), **bad):
    o = {"open": close, "high": close, "low": close} | bad
    return (symbol, day, o["open"], o["high"], o["low"], close, volume, source, rid, at)


def weekdays(n, start=D(2024, 1, 1)):
    out = []
    while len(out) < n:
        if start.weekday() < 5:
            out.append(start)
        start += dt.timedelta(days=1)
    return out


def test_rolling_bars_equal_brute_force(spark):
    random.seed(9)
    days = weekdays(60)
    closes, volumes, data = {}, {}, []
    for i, d in enumerate(days[3:55]):
        if i in (5, 6, 20, 40):
            continue
        closes[d], volumes[d] = 100 + random.random() * 10, random.randint(0, 1000)
        data.append(bar(" ab", d, closes[d], volumes[d], "S "))
    data += [bar("AB", days[10], 5.0, 5, at=T(2024, 1, 1)), bar("AB", days[8], 50.0, 5, high=1.0), bar("AB", days[8], 50.0, -5), bar(None, days[9], 1.0), bar("AB", None, 1.0), bar("AB", D(2024, 1, 6), 9.0)]
    got = {r.trade_date: r for r in trailing.rolling_bars(spark.createDataFrame(data, PRICE).withColumn("day_no", F.lit("clash")), spark.createDataFrame([(d,) for d in days], "trade_date date")).collect()}
    span = days[3:55]
    assert sorted(got) == span
    c, v, last = [], [], None
    for d in span:
        last = closes.get(d, last)
        c.append(last)
        v.append(volumes.get(d, 0))
    for i, d in enumerate(span):
        r = got[d]
        assert r.is_active == (d in closes)
        if i >= 20:
            rets = [c[j] / c[j - 1] - 1 for j in range(i - 19, i + 1)]
            assert math.isclose(r.rolling_20d_return, c[i] / c[i - 20] - 1, abs_tol=1e-12)
            assert math.isclose(r.rolling_20d_volatility, statistics.stdev(rets), rel_tol=1e-9)
        else:
            assert r.rolling_20d_return is None and r.rolling_20d_volatility is None
        assert (r.average_volume_20d is None) == (i < 19)
        if i >= 19:
            assert math.isclose(r.average_volume_20d, sum(v[i - 19 : i + 1]) / 20)


def test_trailing_totals_count_inactive_days(spark):
    data = [("e", D(2024, 1, 1), 5.0), ("e", D(2024, 1, 1), 1.0), ("e", D(2024, 1, 5), 2.0), ("e", None, 9.0), (None, D(2024, 1, 1), 3.0), ("e", D(2024, 1, 9), None)]
    out = trailing.trailing_totals(spark.createDataFrame(data, "k string, d date, x double").withColumn("_next", F.lit(1)), ["k"], "d", {"x": "x"}, (3, 7)).where("k = 'e'").orderBy("d").collect()
    assert [r.x_total_3d for r in out] == [6, 6, 6, 0, 2, 2, 2, 0, 0]
    assert [r.x_total_7d for r in out] == [6, 6, 6, 6, 8, 8, 8, 2, 2]
    assert out[1].x_average_7d == 6 / 7 and [r.is_active for r in out] == [True, False, False, False, True, False, False, False, True]
    assert rows(trailing.trailing_totals(spark.createDataFrame([], "k string, d date, x double"), ["k"], "d", {"x": "x"}, (7,))) == []


def test_wrong_figures(spark):
    right = spark.createDataFrame([("A", "s", D(2024, 1, 1), 0.5), ("A", "s", D(2024, 1, 2), None)], "symbol string, source string, trade_date date, f double")
    given = [("a ", "S", D(2024, 1, 1), 0.5004), ("a", "s", D(2024, 1, 1), 0.51), ("a", "s", D(2024, 1, 1), None), ("a", "s", D(2024, 1, 2), 1.0), ("zz", "s", D(2024, 1, 2), 1.0)]
    out = lambda rows_: rows(trailing.wrong_figures(spark.createDataFrame(rows_, "symbol string, source string, trade_date date, f double"), right, ["f"]))
    assert out(given[:1]) == []
    assert len(out([given[1], given[1]])) == 1 and len(out([given[2]])) == 1 and len(out([given[3]])) == 1 and len(out([given[4]])) == 1
    assert out([]) == []


def series(n=120, seed=0, scale=0.02):
    rng = np.random.default_rng(seed)
    return np.exp(np.cumsum(rng.normal(0, scale, n)) + 4)


def test_store_appends_and_reaches_later_periods(spark, tmp_path):
    """Several loads, and events beyond the snapshots written, equal one load of all versions."""
    random.seed(11)
    schema = "k string, known_day int, version struct<v:int>"
    data = [(random.choice("ab"), random.randint(0, 60), (random.randint(0, 99),)) for _ in range(60)]
    events = spark.createDataFrame([(k, d) for k in ("a", "b", "c", None) for d in (0, 7, 25, 59, 90, None)], "k string, event_day int")
    store = asknown.AsKnownStore(spark, f"file://{tmp_path}/known", ["k"], 10)
    for part, through in ((data[:20], 2), (data[20:50], 1), (data[50:], 4)):
        store.append(spark.createDataFrame(part, schema), through)

    def best(k, d):
        return max((v for kk, known, (v,) in data if kk == k and d is not None and known <= d), default=None)

    for _ in range(2):
        got = {(r.k, r.event_day): r.known and r.known.v for r in store.lookup(events).collect()}
        assert got == {(r.k, r.event_day): best(r.k, r.event_day) for r in events.collect()}
    assert store.snapshots(F.col("period") == 9).count() == 2
    none = asknown.AsKnownStore(spark, f"file://{tmp_path}/none", ["k"], 10)
    assert none.lookup(events).where("known is not null").count() == 0


def test_spikes_stuck_and_impossible(spark):
    days = weekdays(120)
    data, want = [], set()
    for k in range(6):
        c, v = series(seed=k), np.exp(np.random.default_rng(50 + k).normal(8, 0.4, 120)).astype(int)
        c[30] *= 3
        want.add((f"S{k}", days[30], "close"))
        c[60:63] *= 0.3
        want |= {(f"S{k}", days[i], "close") for i in (60, 61, 62)}
        c[80:] *= 2.5  # a level that stays
        v[40] = -4
        want.add((f"S{k}", days[40], "volume"))
        v[90:95] = 777
        want |= {(f"S{k}", days[i], "volume") for i in range(90, 95)}
        v[50] = 0  # possible, but nowhere near the others on a log scale
        want.add((f"S{k}", days[50], "volume"))
        c[100] = 0.0
        want.add((f"S{k}", days[100], "close"))
        for d, x, y in zip(days, c, v):
            data.append(bar(f" s{k}", d, float(x), int(y), rid="b"))
        data.append(bar(f"S{k}", days[5], 9999.0, 1, at=T(2024, 1, 1)))  # superseded
        data.append((f"S{k}", D(2025, 1, 1), None, None, None, None, None, "s", "n", T(2024, 12, 1)))
    data += [bar(None, days[0], 1.0), bar("S0", None, 1.0), bar("short", days[0], 1.0, source=None), bar("short", days[1], 100.0, source=None)]
    df = spark.createDataFrame(data, PRICE).withColumn("series", F.lit("clash")).withColumn("score", F.lit(1))
    got = {(r.symbol, r.event_date, r.field) for r in spikes.score_readings(df, only_flagged=True).collect()}
    assert got == want
    every = spikes.score_readings(df)
    assert every.count() == 6 * 240 + 4
    plain = every.where("not (is_spike or is_stuck or is_impossible)").agg(F.avg(F.when(F.col("score") >= F.col("score_limit"), 1.0).otherwise(0.0)), F.avg("score"), F.avg("score_limit")).first()
    assert plain[0] < 0.05 and plain[1] < plain[2]
    assert every.where("is_spike and score < score_limit").count() == 0


@pytest.mark.parametrize("at", [(0,), (0, 1, 2), (119,), (117, 118, 119), (1, 2), (116, 117)])
def test_spikes_at_the_ends_of_a_series(at):
    """Also where most of the near readings are the spike; a trend or a level that stays is none."""
    day = np.arange(120)
    x = series(scale=0.01)
    x[list(at)] *= 1.6
    calm = series(seed=3, scale=0.01)
    trend = np.exp(4 + np.r_[np.zeros(110), np.arange(10) * 0.03] + np.random.default_rng(1).normal(0, 0.004, 120))
    level = calm.copy()
    level[112:] *= 2
    value, seg = np.concatenate([x, calm, trend, level]), np.repeat([0, 1, 2, 3], 120)
    f = spikes.features(value, seg, np.tile(day, 4), "close")
    assert np.flatnonzero(f["brief"]).tolist() == list(at)


def test_zeros_among_zeros_are_ordinary():
    v = np.where(np.arange(60) % 2, 0.0, 1000.0 + np.arange(60))
    v[40:45] = 500.0, 0.0, 0.0, 0.0, 0.0
    f = spikes.features(v, np.zeros(60, int), np.arange(60), "volume")
    assert not f["impossible"].any() and np.isfinite(f["deviation"]).all() and f["x"].max() < 100


def test_spikes_of_a_field_that_few_series_have(spark):
    names = [f"N{k}" for k in range(60)]
    last = spark.createDataFrame([(n,) for n in names], "symbol string").orderBy(F.xxhash64("symbol").desc()).first().symbol
    days = weekdays(120)
    v = np.exp(np.random.default_rng(7).normal(8, 0.4, 120)).astype(int)
    v[50] *= 10_000
    data = [(n, days[0], 1.0, 1.0, 1.0, 1.0, None, "x", "r", T(2024, 12, 1)) for n in names if n != last]
    data += [(last, d, 1.0, 1.0, 1.0, None, int(x), "x", "r", T(2024, 12, 1)) for d, x in zip(days, v)]
    got = [(r.symbol, r.event_date, r.field) for r in spikes.score_readings(spark.createDataFrame(data, PRICE), only_flagged=True).collect()]
    assert got == [(last, days[50], "volume")]


def test_series_cut_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        days = weekdays(120)
        c = series()
        c[50] *= 4
        data = [bar(s, d, float(x)) for s in ("A", "B", "C") for d, x in zip(days, c)]
        got = {(r.symbol, r.event_date) for r in spikes.score_readings(spark.createDataFrame(data, PRICE), only_flagged=True).where("field = 'close'").collect()}
        assert got == {(s, days[50]) for s in "ABC"}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def test_spikes_empty(spark):
    assert rows(spikes.score_readings(spark.createDataFrame([], PRICE))) == []
    assert rows(spikes.score_readings(spark.createDataFrame([(None,) * 10] * 2, PRICE))) == []


def test_forest_isolates_the_odd_one():
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(0, 2, (2000, 4))).astype(np.int16)
    model = spikes.train_forest(x)
    s = spikes.score_forest(model, np.vstack([x[:50], [[30, 30, 30, 8]]]).astype(np.int16))
    assert s[-1] > 0.7 > s[:-1].max()
