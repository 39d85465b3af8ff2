import datetime as dt
import json
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidegrid.operators.asof import asof_join, interval_join
from tidegrid.plans import checks, dag, models, quality
from tidegrid.sources.readers import payload_rows

D, T = dt.date, dt.datetime
PRICE = "symbol string, date date, open double, high double, low double, close double, volume bigint, source string, source_record_id string, ingested_at timestamp"

# The published golden figures of the 21-bar series.
GOLDEN = {
    "daily_return": 0.008403361344537785, "rolling_20d_return": 0.2, "rolling_20d_volatility": 0.000496425826732139, "annualized_20d_volatility": 0.00788051569153728,
    "average_volume_20d": 105.0, "relative_volume": 1.9047619047619047, "return_observations_20d": 20,
}


@pytest.fixture(scope="module")
def golden_prices(spark):
    first, data = D(2026, 7, 20), []
    for i in range(21):
        c = 100.0 + i
        data.append(("AAPL", first + dt.timedelta(days=i), c, c + 1, c - 1, c, 200 if i == 20 else 100, "test", f"a{i}", T(2026, 8, 10)))
    for s, a, b in (("MSFT", 200.0, 190.0), ("XOM", 50.0, 50.0)):
        for i, c in ((19, a), (20, b)):
            data.append((s, first + dt.timedelta(days=i), c, c + 1, c - 1, c, 100, "test", f"{s}{i}", T(2026, 8, 10)))
    return spark.createDataFrame(data, PRICE)


def test_golden_security_day(golden_prices):
    r = models.mart_security_daily(models.int_rolling_volatility(models.int_daily_returns(models.stg_prices(golden_prices)))).where("symbol = 'AAPL' and trade_date = date'2026-08-09'").first()
    for name, want in GOLDEN.items():
        assert getattr(r, name) == pytest.approx(want, abs=1e-12), name


def test_golden_market_and_sector(spark, golden_prices):
    returns = models.int_daily_returns(models.stg_prices(golden_prices))
    m = models.mart_market_daily(returns).where("trade_date = date'2026-08-09'").first()
    assert (m.market_breadth, m.advancers, m.decliners, m.unchanged) == (0.0, 1, 1, 1)
    sectors = spark.createDataFrame([("AAPL", "Information Technology"), ("MSFT", "Information Technology")], "symbol string, sector string")
    s = models.mart_sector_daily(returns, sectors).where("trade_date = date'2026-08-09'").first()
    assert s.sector_average_return == pytest.approx(-0.02079831932773113, abs=1e-12)


@pytest.mark.parametrize("strict,bucket", [(True, 32), (False, 32), (True, 1), (False, 3)])
def test_asof_equals_brute_force(spark, strict, bucket):
    random.seed(11)
    base = D(2024, 1, 1)
    left = [(random.choice(["a", "b", None]), random.choice([None, *(base + dt.timedelta(days=random.randint(-5, 120)) for _ in range(9))]), i) for i in range(200)]
    right = [(random.choice(["a", "b", None]), random.choice([None, *(base + dt.timedelta(days=random.randint(0, 100)) for _ in range(9))]), random.choice([None, float(i)]), i) for i in range(80)]
    out = asof_join(spark.createDataFrame(left, "k string, t date, i int"), spark.createDataFrame(right, "k string, rt date, v double, n int"), ["k"], "t", "rt", strict, ["n"], bucket_days=bucket).collect()
    assert len(out) == len(left)
    for r in out:
        fit = [x for x in right if r.k is not None and r.t is not None and x[0] == r.k and x[1] is not None and (x[1] < r.t or (not strict and x[1] == r.t))]
        best = max(fit, key=lambda x: (x[1], x[3])) if fit else (None, None, None, None)
        assert (r.rt, r.v, r.n) == (best[1], best[2], best[3])


def test_interval_join_is_half_open(spark):
    left = spark.createDataFrame([("a", 1), ("a", 2), ("a", 5)], "k string, t int")
    right = spark.createDataFrame([("a", 1, 2, "x"), ("a", 2, None, "y")], "k string, s int, e int, v string")
    assert [(r.t, r.v) for r in interval_join(left, right, ["k"], "t", "s", "e").orderBy("t").collect()] == [(1, "x"), (2, "y"), (5, "y")]


def test_effective_ranges_version_one_period(spark):
    f = [("A", "rev", None, D(2024, 3, 31), "Q", T(2024, 5, 1 + i), float(i), "u", None, "s", f"r{i}", T(2024, 6, 1)) for i in range(2)]
    schema = "symbol string, metric_name string, period_start date, period_end date, period_type string, filed_at timestamp, value double, unit string, currency string, source string, source_record_id string, ingested_at timestamp"
    out = models.int_security_fundamentals(models.stg_fundamentals(spark.createDataFrame(f, schema))).orderBy("effective_from").collect()
    assert out[0].effective_to == out[1].effective_from and out[1].effective_to is None


def test_macro_is_never_known_early(spark):
    schema = "series_id string, observation_date date, released_at timestamp, value double, unit string, frequency string, source string, source_record_id string, ingested_at timestamp"
    m = models.stg_macro(spark.createDataFrame([("cpi", D(2024, 1, 1), T(2024, 2, 10), 1.0, "i", "m", "s", "a", T(2024, 3, 1)), ("cpi", D(2024, 2, 1), None, 2.0, "i", "m", "s", "b", T(2024, 3, 1))], schema))
    dates = spark.createDataFrame([(D(2024, 1, 31),), (D(2024, 2, 1),), (D(2024, 2, 10),)], "trade_date date")
    out = models.int_macro_aligned(m, dates)
    assert [r.value for r in out.orderBy("trade_date").collect()] == [None, 2.0, 1.0]
    assert checks.no_lookahead(out).count() == 0


def test_earnings_surprises(spark):
    schema = "symbol string, event_timestamp timestamp, fiscal_period_end date, event_status string, eps_estimate double, eps_actual double, source string, source_record_id string, ingested_at timestamp"
    e = [("a", T(2024, 1, 1), None, "Estimate", 1.0, 1.1, "s", "1", T(2024, 1, 2)), ("a", T(2024, 1, 2), None, "reported", 0.0, 1.1, "s", "2", T(2024, 1, 2)), ("a", T(2024, 1, 3), None, "reported", None, 1.1, "s", "3", T(2024, 1, 2))]
    out = models.int_earnings_surprises(models.stg_earnings(spark.createDataFrame(e, schema))).orderBy("event_timestamp").collect()
    assert out[0].event_status == "SCHEDULED" and out[0].eps_surprise_percent == pytest.approx(0.1)
    assert out[1].eps_surprise_percent is None and out[2].eps_surprise is None


def test_context_uses_earlier_days_only(spark, golden_prices):
    returns = models.int_daily_returns(models.stg_prices(golden_prices))
    daily = models.mart_security_daily(models.int_rolling_volatility(returns))
    events = spark.createDataFrame([("e1", "aapl", T(2026, 8, 9, 12), "x", 1.0, 1.0, "{}", None, "t", 0, 1, T(2026, 8, 9)), ("e2", "none", T(2026, 8, 9), "x", None, None, "{}", None, "t", 0, 2, T(2026, 8, 9))], "event_id string, symbol string, event_timestamp timestamp, event_type string, price double, anomaly_score double, details_json string, detected_at timestamp, source_topic string, kafka_partition int, kafka_offset bigint, ingested_at timestamp")
    e = models.int_earnings_surprises(models.stg_earnings(spark.createDataFrame([], "symbol string, event_timestamp timestamp, fiscal_period_end date, event_status string, eps_estimate double, eps_actual double, source string, source_record_id string, ingested_at timestamp")))
    out = {r.event_id: r for r in models.mart_stream_anomalies(events, daily, models.mart_market_daily(returns), e).collect()}
    assert out["e1"].context_trade_date == D(2026, 8, 8) and out["e1"].prior_daily_close == 119.0
    assert out["e1"].recent_5d_return == pytest.approx(119 / 115 - 1)
    assert out["e2"].context_trade_date is None and out["e2"].recent_5d_market_return is not None


def test_graph_order_selectors_and_cycles():
    m = dag.market_models(F.lit)
    order = dag.topological(m)
    assert all(order.index(a) < order.index(b) for a, b in dag.edges(m) if a in m)
    assert dag.descendants(m, "raw_macro") == {"stg_macro", "int_macro_aligned", "mart_pipeline_dataset_health"}
    assert dag.ancestors(m, "mart_market_daily") == {"int_daily_returns", "stg_prices", "raw_prices"}
    assert set(dag.select(m, "source:raw_news+")) == {"stg_news", "mart_pipeline_dataset_health"} - set() | set()
    with pytest.raises(ValueError):
        dag.select(m, "nothing")
    with pytest.raises(ValueError):
        dag.topological({"a": dag.Model("a", ("b",), None), "b": dag.Model("b", ("a",), None)})
    assert json.dumps(dag.lineage(m))


def test_build_stops_at_a_failing_check(spark, tmp_path):
    good = dag.Model("good", ("src",), lambda d: d, "table", {"unique": lambda df, _: checks.unique(df, "id")})
    bad = dag.Model("bad", ("good",), lambda d: d.union(d), "table", {"unique": lambda df, _: checks.unique(df, "id")})
    target = f"file://{tmp_path}/t"
    report = dag.build(spark, {"good": good}, {"src": spark.range(3)}, target)
    assert report["good"]["rows"] == 3
    with pytest.raises(dag.CheckFailed):
        dag.build(spark, {"good": good, "bad": bad}, {"src": spark.range(3)}, target)
    assert not (tmp_path / "t" / "bad").exists()


def test_checks(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (None, "z")], "id int, c string")
    assert checks.not_null(df, "id").count() == 1 and checks.unique(df, "id").count() == 1
    assert checks.accepted_values(df, "c", ["a"]).count() == 1
    assert checks.expression_is_true(df, "id > 1").count() == 2  # null passes
    assert checks.relationships(df, "id", spark.createDataFrame([(2,)], "p int"), "p").count() == 2
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    loaded = spark.createDataFrame([(T(2024, 1, 1),)], "at timestamp")
    assert checks.stale(loaded, "at", now, 12, 48).first().freshness == "warn"
    assert checks.stale(loaded.limit(0), "at", now, 12, 48).first().freshness == "error"


def bar_days(spark, days=31, odd=None):
    """Two symbols a day of ordinary bars; odd(i, symbol, row) may change a row or leave it out."""
    data = []
    for i in range(days):
        for s in ("AAPL", "MSFT"):
            c = 100.0 + i % 3
            row = [s, D(2024, 1, 1) + dt.timedelta(days=i), c, c, c, c, 100 + i % 5, "s", f"{s}{i}", T(2024, 3, 1)]
            row = odd(i, s, row) if odd else row
            if row:
                data.append(tuple(row))
    return quality.daily_profile(spark.createDataFrame(data, PRICE))


def test_quality_ladder(spark):
    p = bar_days(spark)
    held = quality.evaluate(p, D(2024, 1, 30), 2).first()
    assert (held.status, held.baseline_days, held.findings, held.reason) == ("HEALTHY", 29, [], "nothing found")
    assert quality.evaluate(p, D(2024, 1, 6), 2).first().status == "UNKNOWN"
    assert quality.evaluate(p, D(2024, 3, 6)).count() == 0 and quality.evaluate(p).first().event_date == D(2024, 1, 31)

    def zero_and_missing(i, s, row):
        if i == 30:
            row[6] = 0
        return None if i == 30 and s == "MSFT" else row

    last = quality.evaluate(bar_days(spark, odd=zero_and_missing), D(2024, 1, 31), 2).first()
    assert (last.status, last.missing_symbols) == ("FAILED", 1)
    assert {"zero_volume_fraction", "missing_symbol_fraction", "row_count", "median_volume"} == {f.metric for f in last.findings}
    by = {f.metric: f for f in last.findings}
    assert by["row_count"].baseline_median == 2 and by["row_count"].baseline_mad == 0 and by["row_count"].robust_z == 50


def test_quality_rates_have_limits_not_scores(spark):
    """A null close on one of two rows fails by its rate; a rate has no robust score, and a short metric isn't compared."""

    def one_null(i, s, row):
        if i == 30 and s == "MSFT":
            row[5] = None
        return row

    last = quality.evaluate(bar_days(spark, odd=one_null)).first()
    assert [(f.metric, f.severity, f.robust_z) for f in last.findings] == [("null_rate", "FAILED", None)]
    mild = quality.evaluate(bar_days(spark, odd=one_null), thresholds={"null_rate_fail": 0.9}).first()
    assert mild.status == "DEGRADED"
    none = quality.evaluate(bar_days(spark, odd=lambda i, s, row: [*row[:6], None if i < 15 else row[6], *row[7:]])).first()
    assert not [f for f in none.findings if f.metric == "median_volume"]


def test_small_driver_utilities():
    utc = dt.timezone.utc
    assert quality.expected_close(dt.datetime(2024, 1, 8, 21, 0, tzinfo=utc)).date() == D(2024, 1, 5)  # Monday, before publication
    assert quality.expected_close(dt.datetime(2024, 1, 8, 22, 30, tzinfo=utc)).date() == D(2024, 1, 8)
    assert quality.freshness(None, dt.datetime.now(utc), dt.timedelta(1))["status"] == "unknown"
    assert quality.freshness(dt.datetime(2024, 1, 5, 22, tzinfo=utc), dt.datetime(2024, 1, 7, 12, tzinfo=utc), dt.timedelta(hours=1), market_days=True)["status"] == "fresh"
    assert quality.reconcile(3, 1, 1, 1, 1, 5, 6).status == "passed" and len(quality.reconcile(3, 1, 1, 0, 0, 5, 5).problems) == 3
    assert quality.read_universe([" a # x", "", "#", "B"]) == ["A", "B"] and quality.shard(["a", "b", "c"], 0, 2) == ["a", "c"]
    with pytest.raises(ValueError):
        quality.read_universe(["# none"])
    assert quality.assess_storage(0, 100, 100)["status"] == "blocked" and quality.assess_storage(0, 10, 100)["status"] == "safe"
    drill = quality.recovery_record({"a": True, "b": False}, {"id": 1}, "crash", failure="kill")
    assert drill["recovered"] is False and drill["injected_failure"] == "kill" and drill["recorded_at"]
    with pytest.raises(ValueError):
        quality.recovery_record({}, {})


@pytest.mark.parametrize("dataset,event,check,status", [
    ("prices", "2024-01-05", None, "HEALTHY"), ("prices", "2024-01-04", None, "DEGRADED"), ("prices", "2024-01-03", None, "FAILED"), ("prices", None, "2024-01-08T00:00:00Z", "UNKNOWN"),
    ("macro", None, "2024-01-07T00:00:00Z", "HEALTHY"), ("macro", "2024-01-08", "2024-01-05T00:00:00Z", "DEGRADED"), ("macro", None, "2023-12-01T00:00:00Z", "FAILED"), ("macro", "2024-01-08", None, "UNKNOWN"),
    ("news", "2024-01-08T00:00:00Z", None, "HEALTHY"), ("news", "2024-01-07T12:00:00+00:00", None, "DEGRADED"), ("news", "2024-01-06T21:00:00+00:00", None, "FAILED"), ("news", D(2024, 1, 1), None, "FAILED"),
])
def test_freshness_by_policy(dataset, event, check, status):
    """Monday, before the day's close is published: the last expected close is Friday's."""
    got = quality.assess_freshness(dataset, event, check, dt.datetime(2024, 1, 8, 21, tzinfo=dt.timezone.utc))
    assert got["status"] == status and (got["lag_seconds"] is None) == (status == "UNKNOWN") and (got["expected_event_time"] is not None) == (dataset == "prices")
    with pytest.raises(ValueError):
        quality.assess_freshness("news", dt.datetime(2024, 1, 1), None, dt.datetime.now(dt.timezone.utc))
    with pytest.raises(KeyError):
        quality.assess_freshness("weather", None, None, dt.datetime.now(dt.timezone.utc))


def test_unknown_symbols(spark):
    a = payload_rows(spark, [{"x": 1}])
    assert a.count() == 1
    seen = spark.createDataFrame([(" q",), ("Q",), ("w",), (None,)], "symbol string")
    assert rows(quality.unknown_symbols(seen, spark.createDataFrame([("W",)], "symbol string"))) == [("Q",)]
