import datetime as dt
import io
import json
import random
import threading
import urllib.error
from concurrent.futures import ThreadPoolExecutor

import pyarrow.parquet as pq
import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidegrid.plans import ingest, lake as lake_mod
from tidegrid.plans.ingest import Checkpoints, IdempotencyConflictError, Lake, backfill, fetch_window, incremental, range_backfill
from tidegrid.plans.serving import ArtifactMissing, QueryService, ResultCache, bounded
from tidegrid.sources import contracts, readers
from tidegrid.sources.contracts import CONTRACTS, MissingRequiredFieldError, validate, with_defaults
from tidegrid.sources.readers import payload_rows

D = dt.date
NOW = dt.datetime(2026, 8, 12, tzinfo=dt.timezone.utc)
BASE = {"symbol": "AAPL", "date": "2026-08-10", "open": 100, "high": 102, "low": 99, "close": 101, "volume": 10, "source": "test", "source_record_id": "p1", "ingested_at": "2026-08-11T00:00:00Z"}


def judged(spark, items, dataset="prices", source="test"):
    out = validate(CONTRACTS[dataset], payload_rows(spark, items), source).orderBy("position").collect()
    return out


def message(row):
    return "; ".join(row.errors)


BROKEN = [
    ({"volume": -1}, "volume"), ({"high": 98, "low": 99}, "high"), ({"date": {}}, "date"), ({"vendor_surprise": 1}, "does not know"), ({"open": "one hundred"}, "open"),
    ({"close": None}, "close: null"), ({"symbol": "  "}, "symbol"), ({"symbol": 5}, "symbol"), ({"volume": 1.5}, "volume"), ({"volume": "7.0"}, "volume"), ({"open": True}, "open"), ({"open": "NaN"}, "open"),
    ({"date": "2026-8-1"}, "date"), ({"ingested_at": "2026-08-11T00:00:00"}, "time zone"), ({"source": "other"}, "expected 'test'"), ({"low": 101.5, "close": 101}, "low"), ({"ticker": "X"}, "the same column"), ({"open": 0}, "greater than zero"),
]


def test_rows_are_quarantined_with_a_reason(spark):
    out = judged(spark, [BASE, *({**BASE, **change} for change, _ in BROKEN)])
    assert out[0].errors == []
    for row, (_, text) in zip(out[1:], BROKEN, strict=True):
        assert text in message(row), message(row)


def test_accepted_rows_are_normalised(spark):
    item = {"ticker": " aapl ", "trade_date": "2026-08-10", "open": "225.0", "high": 230, "low": 224, "close": 228.5, "volume": "1000", "source": "test", "source_record_id": "x", "ingested_at": "2026-08-11T02:00:00+02:00"}
    r = judged(spark, [item])[0]
    assert r.errors == [] and (r.symbol, r.date, r.open, r.volume) == ("AAPL", D(2026, 8, 10), 225.0, 1000)
    assert judged(spark, [{**BASE, "volume": 7.0}])[0].volume == 7


def test_missing_columns(spark):
    lacks = {k: v for k, v in BASE.items() if k != "symbol"}
    with pytest.raises(MissingRequiredFieldError, match="symbol"):
        judged(spark, [lacks])
    out = judged(spark, [BASE, {**lacks, "date": "2026-08-11"}])
    assert out[0].errors == [] and "columns left out: symbol" in message(out[1])


def test_duplicates_of_a_batch_and_broken_payloads(spark):
    df = payload_rows(spark, [BASE, BASE, {**BASE, "date": "2026-08-11", "volume": -1}, {**BASE, "date": "2026-08-11"}]).unionByName(spark.createDataFrame([("not json", 9), ("[1]", 10), (None, 11)], "payload string, position bigint"))
    out = validate(CONTRACTS["prices"], df, "test").orderBy("position").collect()
    assert out[0].errors == [] and "duplicate batch key" in message(out[1]) and out[3].errors == []
    assert all("not a JSON object" in message(r) for r in out[4:])
    assert validate(CONTRACTS["prices"], df.limit(0), "test").count() == 0


def test_other_contracts(spark):
    f = {"symbol": "A", "metric_name": "Revenue", "period_start": "2026-04-01", "period_end": "2026-03-01", "period_type": "Q", "filed_at": None, "value": 1, "unit": "usd", "currency": None, "source": "test", "source_record_id": "f", "ingested_at": "2026-08-11T00:00:00Z"}
    assert "period_end" in message(judged(spark, [f], "fundamentals")[0])
    n = {"published_at": "2026-08-10T00:00:00Z", "title": " t ", "url": "ftp://x/y", "publisher": None, "source": "test", "source_record_id": "n", "ingested_at": "2026-08-11T00:00:00Z"}
    assert "url" in message(judged(spark, [n], "news")[0])
    assert judged(spark, [{**n, "url": "https://x.org/y"}], "news")[0].headline == "t"
    m = {"series_id": "cpi", "date": "2026-07-01", "release_timestamp": "2026-09-01T00:00:00Z", "value": 1, "unit": "i", "frequency": "m", "source": "test", "source_record_id": "m", "ingested_at": "2026-08-11T00:00:00Z"}
    assert "released_at" in message(judged(spark, [m], "macro")[0])
    e = {"ticker": "a", "event_time": "2026-08-01T00:00:00Z", "fiscal_period_end": None, "event_status": "reported", "eps_estimate": None, "eps_actual": 1.1, "source": "test", "source_record_id": "e", "ingested_at": "2026-08-11T00:00:00Z"}
    assert judged(spark, [e], "earnings")[0].errors == []


def test_defaults_fill_absent_keys_only(spark):
    a = {"symbol": "A", "date": "2026-08-10", "x": 1}
    b = {"x": 1, "date": "2026-08-10", "symbol": "A"}
    out = [json.loads(r.payload) for r in with_defaults(payload_rows(spark, [a, b, {**a, "source_record_id": None}, {}]), "test", "2026-01-01T00:00:00Z").orderBy("position").collect()]
    assert out[0]["source_record_id"] == out[1]["source_record_id"] and len(out[0]["source_record_id"]) == 64
    assert out[2]["source_record_id"] is None and out[0]["source"] == "test" and set(out[3]) == {"source", "source_record_id", "ingested_at"}


# --- ingestion ------------------------------------------------------------------------------------------------


def bars(*days, **change):
    return [{k: v for k, v in {**BASE, "date": d, "source_record_id": f"p{d}", **change}.items()} for d in days]


def take(spark, lake, items, **options):
    return backfill(lake, "prices", payload_rows(spark, items), "test", now=NOW, **options)


@pytest.fixture
def lake(spark, tmp_path):
    return Lake(spark, f"file://{tmp_path}/lake")


def held(spark, lake):
    return readers.read_dataset(spark, lake.raw, "prices", CONTRACTS["prices"].ddl())


def test_replay_and_overlap(spark, lake):
    r = take(spark, lake, bars("2026-01-05", "2026-02-05", "2026-03-05"), run_id="one")
    assert (r.accepted_rows, r.files_written, r.status, r.max_event_date) == (3, 3, "success", "2026-03-05")
    r = take(spark, lake, bars("2026-02-05", "2026-03-05", "2026-04-05"), run_id="two")
    assert (r.accepted_rows, r.duplicate_rows, r.pre_write_row_count, r.post_write_row_count) == (1, 2, 3, 4)
    assert held(spark, lake).count() == 4
    assert lake.files.list(f"{lake.raw}/prices/year=2026/month=04")
    with pytest.raises(IdempotencyConflictError):
        take(spark, lake, bars("2026-02-05", close=100), run_id="three")


def test_quarantine_and_health_of_a_run(spark, lake):
    r = take(spark, lake, [*bars("2026-01-05"), *bars("2026-01-06", volume=-1)], run_id="q")
    assert (r.status, r.quarantined_rows, r.accepted_rows) == ("degraded", 1, 1)
    assert QueryService(spark, f"{lake.root}/marts", lake).quarantine_summary()["groups"] == [{"source": "test", "error_type": "contract_violation", "records": 1}]


def test_a_crash_between_promotions_is_healed_by_replay(spark, lake):
    calls = []

    def crash(step, _):
        calls.append(step)
        if calls.count("after_promotion") == 1:
            raise RuntimeError("power cut")

    items = bars("2026-01-05", "2026-02-05")
    with pytest.raises(RuntimeError):
        take(spark, lake, items, run_id="a", hook=crash)
    assert held(spark, lake).count() == 1 and not lake.files.exists(f"{lake.runs}/a.json")
    r = take(spark, lake, items, run_id="b")
    assert (r.accepted_rows, r.duplicate_rows, held(spark, lake).count()) == (1, 1, 2)


def test_incremental_late_rows_and_checkpoint(spark, lake):
    go = lambda items, **o: incremental(lake, "prices", payload_rows(spark, items), "test", D(2026, 7, 31), now=NOW, **o)
    with pytest.raises(ValueError):
        go(bars("2026-07-17"))
    _, mark = go(bars("2026-07-16", "2026-07-17"), initial=D(2026, 7, 16))
    assert mark == D(2026, 7, 17)
    r, mark = go(bars("2026-07-15", "2026-07-18"), overlap=5)
    assert (r.late_arriving_rows, r.earliest_late_event_date, mark) == (1, "2026-07-15", D(2026, 7, 18))
    r, mark = go([])
    assert r.accepted_rows == 0 and mark == D(2026, 7, 18)
    range_backfill(lake, "prices", payload_rows(spark, bars("2026-01-05", "2025-01-01")), "test", D(2026, 1, 1), D(2026, 1, 31), now=NOW)
    assert Checkpoints(lake).get("prices", "test") == D(2026, 7, 18) and held(spark, lake).count() == 5


def test_fetch_windows():
    assert fetch_window(D(2026, 8, 10), None, D(2026, 8, 12), 0) == (D(2026, 8, 11), D(2026, 8, 12))
    assert fetch_window(D(2026, 8, 10), None, D(2026, 8, 12), 3) == (D(2026, 8, 8), D(2026, 8, 12))
    assert fetch_window(D(2026, 8, 10), None, D(2026, 8, 1), 0)[0] == D(2026, 8, 11)
    for bad in ((None, None, D(2026, 1, 1), 0), (None, D(2026, 2, 1), D(2026, 1, 1), 0), (D(2026, 1, 1), None, D(2026, 1, 1), -1)):
        with pytest.raises(ValueError):
            fetch_window(*bad)


@settings(max_examples=2, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 28), st.booleans()), max_size=8), st.integers(0, 1000))
def test_every_row_is_accounted_for(spark, tmp_path, items, n):
    lake = Lake(spark, f"file://{tmp_path}/p{n}{random.random()}")
    batch = [{**BASE, "date": f"2026-01-{d:02d}", "source_record_id": str(i), "volume": 5 if ok else -5} for i, (d, ok) in enumerate(items)]
    r = take(spark, lake, batch)
    assert r.input_rows == len(batch) == r.accepted_rows + r.quarantined_rows + r.duplicate_rows
    again = take(spark, lake, batch)
    assert again.accepted_rows == 0 and again.post_write_row_count == r.post_write_row_count


# --- maintenance, time travel, serving ------------------------------------------------------------------------


def test_compaction_archive_build_and_time_travel(spark, lake):
    for d in ("2026-08-03", "2026-08-04", "2026-08-05"):
        take(spark, lake, bars(d))
    build = lake_mod.create_build(lake, ["prices", "news"], "abc")
    assert lake_mod.create_build(lake, ["prices", "news"], "abc")["build_id"] == build["build_id"]
    r = lake_mod.compact_partition(lake, "prices", 2026, 8)
    assert (r.files_before, r.files_after, r.rows_before, r.rows_after) == (3, 1, 3, 3)
    assert held(spark, lake).count() == 3 and len(lake.files.list(r.archive)) >= 3
    assert lake_mod.verify_build(lake, build["build_id"]) == []
    take(spark, lake, bars("2026-08-06"))
    assert lake_mod.time_travel(lake, build["build_id"])["prices"].count() == 3
    with pytest.raises(lake_mod.CompactionError):
        lake_mod.compact_partition(lake, "prices", 2026, 7)
    lake.files.create_exclusive(lake.lock("prices/year=2026/month=08"))
    with pytest.raises(lake_mod.CompactionError):
        lake_mod.compact_partition(lake, "prices", 2026, 8)
    with pytest.raises(ingest.PartitionLockedError):
        take(spark, lake, bars("2026-08-07"))
    old = lake_mod.cleanup(lake, dt.datetime(2100, 1, 1), ["archive"])
    assert len(old) >= 3 and lake_mod.cleanup(lake, dt.datetime(2000, 1, 1)) == []
    with pytest.raises(ValueError):
        lake_mod.load_build(lake, "build-1")


def test_compaction_copies_the_files_without_surplus_copies(spark, lake):
    for d in ("2026-08-03", "2026-08-04", "2026-08-05"):
        take(spark, lake, bars(d))
    at = f"{lake.raw}/prices/year=2026/month=08"
    first = held(spark, lake).select(*contracts.CONTRACTS["prices"].columns).where("date = date'2026-08-03'")
    first.withColumn("ingested_at", F.expr("ingested_at + interval 1 day")).coalesce(1).write.mode("append").parquet(at)
    newest = spark.read.parquet(at).agg(F.max("ingested_at")).first()[0]
    r = lake_mod.compact_partition(lake, "prices", 2026, 8)
    assert (r.rows_before, r.rows_after, r.duplicate_rows_removed) == (4, 3, 1)
    after = held(spark, lake).orderBy("date").collect()
    assert [x.date.day for x in after] == [3, 4, 5] and after[0].ingested_at == newest
    made = [p for p, _, _ in lake.files.list(at) if p.endswith(".parquet")]
    assert sum(pq.ParquetFile(p.removeprefix("file:")).num_row_groups for p in made) == 3  # one decoded file would have one


@pytest.mark.parametrize("step", ["placed", "published"])
def test_a_crash_of_a_compaction_leaves_the_old_or_the_new_state(spark, lake, step):
    for d in ("2026-08-03", "2026-08-04"):
        take(spark, lake, bars(d))

    def crash(at, folder):
        if at == step:
            assert held(spark, lake).count() == 2  # readers see each record once, before and after the switch
            raise RuntimeError("stop")

    with pytest.raises(RuntimeError):
        lake_mod.compact_partition(lake, "prices", 2026, 8, hook=crash)
    assert held(spark, lake).count() == 2
    take(spark, lake, bars("2026-08-05"))
    assert held(spark, lake).count() == 3 and lake_mod.compact_partition(lake, "prices", 2026, 8).rows_after == 3


def test_compaction_bounds(spark, lake):
    for bad in ({"year": 1, "month": 1}, {"year": 2026, "month": 13}):
        with pytest.raises(ValueError):
            lake_mod.compact_partition(lake, "prices", **bad)
    for bad in ((1, 10), (2, 0)):
        with pytest.raises(ValueError):
            lake_mod.Policy(*bad)


def test_a_build_knows_contents(spark, lake):
    take(spark, lake, bars("2026-08-03"))
    build = lake_mod.create_build(lake, ["prices"], lake_mod.code_hash(lake_mod.__file__.rsplit("/", 1)[0]), revision="abc")
    assert build["datasets"]["prices"]["files"] == 1 and build["datasets"]["prices"]["rows"] == 1
    path = lake_mod.dataset_files(spark, lake.raw, "prices")[0].removeprefix("file:")
    data = bytearray(open(path, "rb").read())
    data[10] ^= 1
    open(path, "wb").write(bytes(data))
    assert lake_mod.verify_build(lake, build["build_id"]) == [f"changed: {path.split('/raw/', 1)[1]}"]


def test_audit_is_idempotent(spark, lake):
    take(spark, lake, bars("2026-08-03"), run_id="a")
    take(spark, lake, bars("2026-08-04"), run_id="b")
    assert lake_mod.sync_audit(lake).count() == lake_mod.sync_audit(lake).count() == 2
    assert lake_mod.dataset_versions(lake).first().accepted_rows == 2
    assert {r["run_id"] for r in QueryService(spark, f"{lake.root}/marts", lake).runs(10)} == {"a", "b"}


def test_all_audit_tables(spark, lake):
    incremental(lake, "prices", payload_rows(spark, bars("2026-07-16")), "test", D(2026, 7, 31), initial=D(2026, 7, 16), now=NOW)
    lake.files.publish_json(f"{lake.root}/metadata/quality/prices-test.json", {"dataset": "prices", "source": "test", "event_date": "2026-07-16", "status": "FAILED", "reason": "null_rate", "findings": [{"metric": "null_rate", "severity": "FAILED", "value": 0.5, "reason": "too many"}]})
    lake.files.publish_json(f"{lake.root}/metadata/freshness/prices.json", {"dataset": "prices", "status": "stale", "lag_seconds": 7200.0, "evaluated_at": "2026-07-18"})
    want = {"pipeline_runs": 1, "dataset_versions": 1, "quality_results": 3, "checkpoints": 1}
    assert lake_mod.sync_all(lake) == want and lake_mod.sync_all(lake) == want
    s = QueryService(spark, f"{lake.root}/marts", lake)
    assert [(r["check_name"], r["status"], r["observed_value"]) for r in s.quality(10)] == [("freshness", "stale", 2.0), ("statistical_quality", "FAILED", None), ("null_rate", "FAILED", 0.5)]
    version = lake_mod.audit_table(lake, "dataset_versions").first()
    assert (version.dataset, version.partition, version.row_count, len(version.content_hash)) == ("prices", "year=2026/month=07", 1, 64)
    assert s.readiness()["metadata_store"] is True
    with pytest.raises(ArtifactMissing):
        s.benchmarks()
    lake.files.publish_json(f"{lake.root}/metadata/benchmarks.json", {"q": 1})
    assert s.benchmarks() == {"q": 1}


def test_cache():
    now = [0.0]
    c = ResultCache(2, 10, lambda: now[0])
    made = []
    get = lambda k: c.get(k, lambda: made.append(k) or [k])
    get("a").append("changed")
    assert get("a") == ["a"] and c.stats()["hits"] == 1
    get("b"), get("c")
    assert c.stats()["evictions"] == 1 and c.stats()["entries"] == 2
    now[0] = 11
    get("c")
    assert made == ["a", "b", "c", "c"]
    with pytest.raises(ZeroDivisionError):
        c.get("bad", lambda: 1 / 0)
    assert c.get("bad", lambda: 2) == 2 and c.stats()["uncached"]["p95_ms"] is not None
    c.clear()
    assert c.stats()["entries"] == 0 and c.stats()["hits"] == 0


def test_cache_computes_a_wanted_key_once():
    c, made, go = ResultCache(), [], threading.Event()

    def slow():
        go.wait(5)
        made.append(1)
        return {"x": 1}

    with ThreadPoolExecutor(4) as pool:
        jobs = [pool.submit(c.get, "k", slow) for _ in range(4)]
        go.set()
        assert [j.result() for j in jobs] == [{"x": 1}] * 4
    assert len(made) == 1


def test_service(spark, tmp_path):
    target = f"file://{tmp_path}/marts"
    day = D(2026, 8, 10)
    spark.createDataFrame([("A", "s", day, 1.0), ("A", "t", day, 2.0)], "symbol string, source string, trade_date date, close double").write.parquet(f"{target}/mart_security_daily")
    spark.createDataFrame([("A", "s"), ("B", "s")], "symbol string, source string").write.parquet(f"{target}/mart_company_snapshot")
    spark.createDataFrame([("Tech", day, 0.1, 2), ("Tech", D(2026, 8, 11), None, 3)], "sector string, trade_date date, sector_average_return double, securities_with_returns bigint").write.parquet(f"{target}/mart_sector_daily")
    s = QueryService(spark, target)
    assert [r["symbol"] for r in s.securities(1)] == ["A"] and s.security(" a ")["source"] == "s" and s.security("zz") is None
    assert len(s.history("a")) == 2 and s.history("a", "T")[0]["close"] == 2.0
    assert s.sectors()[0] == {"sector": "Tech", "latest_date": D(2026, 8, 11), "sector_average_return": 0.1, "securities_with_returns": 3}
    assert len(s.sector_history("TECH", 1)) == 1
    assert not s.readiness()["ready"] and "mart_market_daily" in s.readiness()["missing"]
    assert s.dataset_schema("prices")[0]["name"] == "symbol" and "mart_market_daily" in s.lineage("prices")
    for bad in (0, 501):
        with pytest.raises(ValueError):
            bounded("limit", bad, 500)
    s.securities(1)
    assert s.cache_stats()["hits"] == 1


# --- readers --------------------------------------------------------------------------------------------------


def test_file_formats(spark, tmp_path):
    (tmp_path / "a.csv").write_text("symbol,close\nA,1\nB,\n")
    (tmp_path / "a.jsonl").write_text('{"symbol":"A"}\n\n{"symbol":"B"}\n')
    (tmp_path / "a.json").write_text('[{"symbol":"A","n":{"x":1}},{"symbol":"B"}]')
    (tmp_path / "b.json").write_text('[{"symbol":"A"}, 3]')
    (tmp_path / "c.xml").write_text("")
    get = lambda n: [json.loads(r.payload) for r in readers.read_payloads(spark, f"file://{tmp_path}/{n}").orderBy("position").collect()]
    assert get("a.csv") == [{"symbol": "A", "close": "1"}, {"symbol": "B", "close": None}]
    assert [x["symbol"] for x in get("a.jsonl")] == ["A", "B"] and get("a.json")[0]["n"] == {"x": 1}
    with pytest.raises(ValueError):
        get("b.json")
    with pytest.raises(ValueError):
        get("c.xml")
    with pytest.raises(readers.MissingDatasetError):
        readers.read_dataset(spark, str(tmp_path), "none")
    (tmp_path / "u.txt").write_text("# all\n aapl \nMSFT # x\n")
    assert rows(readers.read_universe(spark, str(tmp_path / "u.txt"))) == [("AAPL",), ("MSFT",)]
    assert readers.month_predicate(D(2024, 12, 5), D(2025, 1, 2)) == "(year = '2024' and month = '12') or (year = '2025' and month = '01')"


def test_fetched_files_are_bounded_and_retried(spark):
    import gzip

    calls = []

    class Packed(io.BytesIO):
        headers = {"Content-Encoding": "gzip"}

    def opener(request, timeout):
        calls.append(request.full_url)
        if len(calls) == 1:
            raise urllib.error.HTTPError(request.full_url, 503, "x", {}, None)
        return Packed(gzip.compress(b'[{"symbol":"A"}, {"symbol":"B"}]'))

    at = readers._fetched(spark, "http://x/a.json", opener, sleep=lambda _: None)
    assert [json.loads(r.payload)["symbol"] for r in readers.read_payloads(spark, at).orderBy("position").collect()] == ["A", "B"]
    with pytest.raises(ValueError):
        readers._fetched(spark, "http://x/a.json", opener, most=10)


def test_record_ids_are_those_of_canonical_json(spark):
    import hashlib

    items = [{"b": 1.50, "a": "Zürich", "n": None, "l": [1, {"y": 2, "x": 1e3}]}, {"a": 1, "source": "given"}, {"a": 1, "source_record_id": "mine"}]
    out = [json.loads(r.payload) for r in with_defaults(payload_rows(spark, items), "test", NOW.isoformat()).orderBy("position").collect()]
    want = [hashlib.sha256(json.dumps({"source": "test", **i}, sort_keys=True, separators=(",", ":")).encode()).hexdigest() for i in items[:2]]
    assert [o["source_record_id"] for o in out] == [*want, "mine"] and out[1]["source"] == "given"


def test_http_client_retries():
    waits, calls = [], []

    class Answer(io.BytesIO):
        headers = {}

    def opener(request, timeout):
        calls.append(request.full_url)
        if len(calls) == 1:
            raise urllib.error.HTTPError(request.full_url, 503, "x", {}, None)
        if len(calls) == 2:
            raise urllib.error.HTTPError(request.full_url, 429, "x", {"Retry-After": "7"}, None)
        return Answer(b'{"ok": 1}')

    assert readers.get_json("http://x/y", {"a": "b"}, opener=opener, sleep=waits.append) == {"ok": 1}
    assert waits == [0.25, 7.0] and calls[0].endswith("?a=b")

    def refuse(request, timeout):
        raise urllib.error.HTTPError(request.full_url, 404, "x", {}, None)

    with pytest.raises(urllib.error.HTTPError):
        readers.get_json("http://x", opener=refuse, sleep=waits.append)


def test_provider_mappings(spark):
    def get(df):
        return [json.loads(r.payload) for r in df.collect()]

    bars_ = spark.createDataFrame([("a", '[{"date":"2026-08-10T00:00:00Z","open":1,"high":2,"low":1,"close":2,"volume":5},{"date":"2026-08-10","open":1,"high":2,"low":1,"close":2,"volume":5}]')], "ticker string, document string")
    assert [(x["symbol"], x["date"], x["volume"]) for x in get(readers.map_daily_bars(bars_))] == [("A", "2026-08-10", 5)]
    facts = json.dumps({"facts": {"us-gaap": {"Revenues": {"units": {"USD": [{"start": "2026-01-01", "end": "2026-03-31", "val": 5, "accn": "n", "fp": "Q1", "form": "10-Q", "filed": "2026-05-01"}, {"end": "2026-03-31", "val": 5, "accn": "m", "form": "8-K", "filed": "2026-05-01"}]}}}}})
    got = get(readers.map_company_facts(spark.createDataFrame([("A", facts)], "symbol string, document string"), ["Revenues"]))
    assert len(got) == 1 and got[0]["source_record_id"] == "n:Revenues:2026-03-31:USD" and got[0]["currency"] == "USD"
    eps = get(readers.map_estimates(spark.createDataFrame([("A", '[{"quarter":"Q1 26","estimate":1.0,"reported":"2026-05-01"},{"quarter":"bad"}]')], "symbol string, document string")))
    assert [(e["fiscal_period_end"], e["event_status"]) for e in eps] == [("2026-03-31", "estimate")]
    obs = spark.createDataFrame([("CPI", None, "Index", "M", '{"observations":[{"date":"2026-01-01","value":".","realtime_start":"2026-02-01"},{"date":"2026-02-01","value":"3.5","realtime_start":"2026-03-01"}]}')], "series_id string, units_short string, units string, frequency_short string, document string")
    assert [(o["value"], o["unit"]) for o in get(readers.map_macro_series(obs))] == [(3.5, "Index")]
    news = spark.createDataFrame([('{"articles":[{"title":"t","url":"u","publishedAt":"2026-01-01T00:00:00Z","source":{"name":"p"}}]}',)], "document string")
    assert get(readers.map_news(news))[0]["publisher"] == "p"
    an = readers.map_anomalies(spark.createDataFrame([('[{"ticker":"A","window_start":"2026-01-01T00:00:00Z","anomaly_type":"x","details":"{\\"price\\":2}","detected_at":null}]',)], "document string")).first()
    assert json.loads(an.value)["price"] == 2.0 and an.offset > 0


def test_registry_is_complete():
    assert set(contracts.CONTRACTS) == {"prices", "fundamentals", "earnings", "macro", "news"}
    assert F is not None
