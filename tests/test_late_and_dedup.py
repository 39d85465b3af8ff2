import datetime as dt
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidegrid.operators import latewindow, msgdedup
from tidegrid.sources.storage import ConcurrentWriteError
from tidegrid.streaming.late_stream import LateWindows

D, T = dt.date, dt.datetime
PRICE = "symbol string, date date, open double, high double, low double, close double, volume bigint, source string, source_record_id string, ingested_at timestamp"
RUN = "run_id string, arrival_time timestamp, prior_event_watermark date"
MESSAGE = "delivery_id bigint, event_id string, symbol string, event_timestamp timestamp, source_topic string, kafka_partition int, kafka_offset bigint, ingested_at timestamp"


def bar(symbol, day, at, close=1.0, volume=1, source="s", rid="r"):
    return (symbol, day, 1.0, 1.0, 1.0, close, volume, source, rid, at)


def test_first_delivery_decides(spark):
    a1, a2, a3 = T(2024, 3, 1), T(2024, 3, 2), T(2024, 4, 20)
    runs = spark.createDataFrame([("r1", a1, None), ("r2", a2, D(2024, 3, 1)), ("r2", a2, D(2024, 3, 1)), ("r3", a3, D(2024, 4, 19))], RUN)
    prices = spark.createDataFrame([
        bar(" aa", D(2024, 3, 1), a1), bar("AA", D(2024, 3, 1), a2),  # seen before
        bar("b", D(2024, 3, 1), a2),  # late, on the watermark
        bar("b", D(2024, 3, 2), a2),  # on time
        bar("c", D(2024, 3, 20), a3),  # exactly 30 days before
        bar("d", D(2024, 3, 19), a3),  # 31 days before
        bar(None, D(2024, 3, 1), a2), bar("e", None, a2), bar("f", D(2024, 3, 1), T(2020, 1, 1)), bar("g", D(2024, 3, 1), a2, source=None),
    ], PRICE).withColumn("watermark", F.lit("clash")).withColumn("timing", F.lit(1))
    out = latewindow.replay(prices, runs)
    got = rows(out.first.where("timing = 'late'").select("symbol", "event_date", "source"))
    assert out.current.agg(F.sum("late_arriving_rows")).first()[0] == len(got)
    assert got == [("B", D(2024, 3, 1), "s"), ("C", D(2024, 3, 20), "s"), ("G", D(2024, 3, 1), None)]


def brute_replay(prices, runs, lateness=30):
    """Aggregates in force, keys whose first delivery was late, and diverted deliveries, one delivery after the other."""
    marks = {}
    for _, a, w in runs:
        marks[a] = max(filter(None, [marks.get(a), w]), default=None)
    state, verdict, dropped = {}, {}, 0
    for r in sorted(prices, key=lambda r: (r[9], r[8])):
        key, w = (r[0], r[1], r[7]), marks.get(r[9])
        timing = "on_time" if not w or r[1] > w else "late" if r[1] >= w - dt.timedelta(days=lateness) else "too_late"
        verdict.setdefault(key, timing)
        if timing == "too_late":
            dropped += 1
        else:
            state[key] = r
    out = {}
    for key, r in state.items():
        k = (key[2], key[1].replace(day=1))
        n, l, c, v = out.get(k, (0, 0, 0.0, 0.0))
        out[k] = (n + 1, l + (verdict[key] == "late"), c + r[5], v + r[6])
    return out, {k for k, v in verdict.items() if v == "late"}, dropped


@pytest.mark.parametrize("runs_a_day", [1, 3])
def test_replay_equals_brute_force(spark, runs_a_day):
    """Also with several runs, and so several watermarks, on one day."""
    random.seed(5 + runs_a_day)
    arrivals = [T(2024, 3, 1) + dt.timedelta(hours=24 * i // runs_a_day) for i in range(40)]
    runs = [(f"r{i}", a, None if i % 13 == 0 else a.date() + dt.timedelta(days=random.choice([-20, -2, 0, 12]))) for i, a in enumerate(arrivals)]
    prices = []
    for i in range(600):
        a = random.choice(arrivals)
        prices.append(bar(random.choice("AB"), a.date() - dt.timedelta(days=random.choice([0, 1, 3, 10, 29, 33, 50])), a, float(random.randint(1, 9)), random.randint(1, 9), random.choice("xy"), f"r{i:04d}"))
    current, late, dropped = brute_replay(prices, runs)
    r = latewindow.replay(spark.createDataFrame(prices, PRICE), spark.createDataFrame(runs, RUN))
    got = {(x.source, x.window_start): (x.records, x.late_arriving_rows, x.close_sum, x.volume_sum) for x in r.current.collect()}
    assert got == current and late and dropped
    assert {(x.symbol, x.event_date, x.source) for x in r.first.where("timing = 'late'").collect()} == late
    assert sum(x[1] for x in got.values()) == len(late) and r.dropped.count() == dropped
    versions = {}
    for x in r.updates.orderBy("source", "window_start", "version").collect():
        versions.setdefault((x.source, x.window_start), []).append(x.version)
    assert all(v == list(range(1, len(v) + 1)) for v in versions.values())


def test_two_watermarks_on_one_day(spark):
    """On time in the morning, too late by the evening's watermark: the record stays in force with its first value; the reverse enters, but not as a late one."""
    a, b = T(2024, 5, 1, 8), T(2024, 5, 1, 20)
    runs = spark.createDataFrame([("m", a, D(2024, 4, 1)), ("e", b, D(2024, 6, 20))], RUN)
    out = latewindow.replay(spark.createDataFrame([bar("A", D(2024, 4, 2), a, 3.0), bar("A", D(2024, 4, 2), b, 9.0), bar("B", D(2024, 3, 20), a, 5.0), bar("B", D(2024, 3, 20), b, 7.0)], PRICE), runs)
    assert rows(out.current.select("window_start", "records", "late_arriving_rows", "close_sum")) == [(D(2024, 3, 1), 1, 1, 5.0), (D(2024, 4, 1), 1, 0, 3.0)]
    assert rows(out.first.select("symbol", "timing")) == [("A", "on_time"), ("B", "late")] and out.dropped.count() == 2


def test_late_empty_tables(spark):
    p, r = spark.createDataFrame([], PRICE), spark.createDataFrame([], RUN)
    out = latewindow.replay(p, r)
    assert rows(out.current) == rows(out.updates) == rows(out.dropped) == rows(out.first) == []
    nulls = spark.createDataFrame([(None,) * 10], PRICE)
    assert rows(latewindow.replay(nulls, spark.createDataFrame([(None, None, None)], RUN)).current) == []


def test_late_stream_diverts_and_corrects(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    import json
    import os
    import time

    def put(n, *items):
        p = src / f"{n}.json"
        p.write_text("\n".join(json.dumps(dict(zip(("symbol", "event_date", "source", "close", "volume", "arrival"), i))) for i in items))
        os.utime(p, (time.time() - 100 + n, time.time() - 100 + n))

    put(0, ("A", "2024-03-01", "s", 1.0, 1.0, "2024-03-01T00:00:00Z"), ("B", "2024-03-20", "s", 2.0, 1.0, "2024-03-20T00:00:00Z"))
    put(1, ("A", "2024-03-05", "s", 5.0, 1.0, "2024-03-21T00:00:00Z"), ("A", "2024-02-01", "s", 9.0, 1.0, "2024-03-21T00:00:00Z"), ("B", "2024-03-20", "s", 3.0, 1.0, "2024-03-21T00:00:00Z"))
    from tidegrid.streaming.late_stream import ROW

    windows = LateWindows(spark, f"file://{tmp_path}/state")
    stream = spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).json(str(src))
    windows.run(stream, f"file://{tmp_path}/check")
    assert [(r.records, r.late_arriving_rows, r.close_sum) for r in windows.aggregates().collect()] == [(3, 1, 9.0)]
    assert [r.symbol for r in windows.diverted().collect()] == ["A"]
    windows.take_batch(spark.createDataFrame([("Z", D(2024, 3, 1), "s", 1.0, 1.0, T(2024, 3, 22))], ROW), 1)  # taken before
    assert windows.aggregates().first().records == 3


def message(i, eid, off, at, topic="t", part=0, ts=T(2024, 1, 1)):
    return (i, eid, "S", ts, topic, part, off, at)


def brute_repeats(data):
    ids, places, out = set(), set(), set()
    for r in sorted(data, key=lambda r: (r[7] or T(1970, 1, 1), r[0])):
        e = r[1].strip(" ").lower() if r[1] is not None else None
        c = (r[4], r[5], r[6]) if None not in (r[4], r[5], r[6]) else None
        if (e is not None and e in ids) or (c is not None and c in places):
            out.add(r[0])
            continue
        if e is not None:
            ids.add(e)
        if c is not None:
            places.add(c)
    return out


@pytest.mark.parametrize("seed,loads,most", [(2, 2, 3), (3, 2, 200_000)])
def test_repeats_equal_the_greedy_rule(spark, monkeypatch, seed, loads, most):
    monkeypatch.setattr(msgdedup, "COMPONENT_PAIRS", most)
    random.seed(seed)
    data = []
    for i in range(200):
        eid = random.choice([None, " E1 ", "e1", *(f"e{random.randint(2, 120)}" for _ in range(8))])
        off = random.choice([None, 7, *(random.randint(8, 150) for _ in range(8))])
        data.append(message(i, eid, off, random.choice([None, *(T(2024, 1, 1) + dt.timedelta(hours=random.randint(0, 9)) for _ in range(9))]), random.choice(["t", "u"]), ts=random.choice([None, T(2024, 1, 1), T(2024, 1, 2)])))
    df = spark.createDataFrame(data, MESSAGE).withColumn("e", F.lit("clash")).withColumn("part", F.lit("clash"))
    store, merges = msgdedup.dedup_in_batches(df, loads)
    got = {r.delivery_id for m in merges for r in m.repeats.collect()}
    assert got == brute_repeats(data)
    assert {r.delivery_id for r in store.kept().collect()} == {r[0] for r in data} - got
    assert sum(m.duplicate_events for m in merges) == len(got)
    assert store.kept().columns == df.columns
    want = {r[0]: tuple(r) for r in df.collect()}
    assert all(tuple(r) == want[r.delivery_id] for r in store.kept().collect())


def test_components_of_a_long_chain(spark):
    pairs = spark.range(300).select(F.concat(F.lit("e"), F.floor((F.col("id") + 1) / 2)).alias("e"), F.concat(F.lit("c"), F.floor(F.col("id") / 2)).alias("c"), F.struct(F.lit(T(2024, 1, 1)).alias("arrived"), ((F.col("id") * 7) % 300).alias("delivery_id")).alias("o"))
    two = pairs.unionByName(spark.sql("select 'x' as e, 'y' as c, struct(timestamp'2024-01-01' as arrived, 1000L as delivery_id) as o"))
    assert rows(msgdedup.components(two).groupBy("label").count()) == [(0, 300), (1000, 1)]


def test_chain_of_dependencies(spark, monkeypatch):
    """Each message shares something with the next: every second one stays."""
    monkeypatch.setattr(msgdedup, "ROUNDS", 1)
    data = [message(i, f"e{(i + 1) // 2}", i // 2, T(2024, 1, 1) + dt.timedelta(minutes=i)) for i in range(40)]
    df = spark.createDataFrame(data, MESSAGE)
    assert {r.delivery_id for r in msgdedup.repeats(msgdedup.nodes(df)).collect()} == brute_repeats(data)


def test_only_affected_partitions_are_overwritten(spark, tmp_path):
    store = msgdedup.MessageStore(spark, f"file://{tmp_path}/store")
    d1, d2, d3 = T(2024, 1, 1), T(2024, 1, 2), T(2024, 1, 3)
    store.merge(msgdedup.nodes(spark.createDataFrame([message(1, "a", 1, d1, ts=d1), message(2, "b", 2, d1, ts=d2)], MESSAGE)))
    again = store.merge(msgdedup.nodes(spark.createDataFrame([message(3, "A", 9, d2, ts=d1), message(4, "c", 3, d2, ts=d3)], MESSAGE)))
    dates = store.manifest()["dates"]
    assert {d: [int(m[2:8]) for m in ms] for d, ms in dates.items()} == {"2024-01-01": [2], "2024-01-02": [1], "2024-01-03": [2]}
    assert (again.partitions_overwritten, again.duplicate_events, again.accepted_events) == (1, 1, 1)
    assert {r.delivery_id for r in store.kept().collect()} == {1, 2, 4}


def test_two_writers_and_old_folders(spark, tmp_path, monkeypatch):
    store, late = (msgdedup.MessageStore(spark, f"file://{tmp_path}/store", keep=1) for _ in range(2))
    one = msgdedup.nodes(spark.createDataFrame([message(1, "a", 1, T(2024, 1, 1), ts=T(2024, 1, 1))], MESSAGE))
    store.merge(one)
    seen = late.versions.read()
    monkeypatch.setattr(late.versions, "read", lambda: seen)
    store.merge(msgdedup.nodes(spark.createDataFrame([message(2, "a", 2, T(2024, 1, 2), ts=T(2024, 1, 1))], MESSAGE)))
    with pytest.raises(ConcurrentWriteError):
        late.merge(msgdedup.nodes(spark.createDataFrame([message(3, "b", 3, T(2024, 1, 2), ts=T(2024, 1, 1))], MESSAGE)))
    assert [r.delivery_id for r in store.kept().collect()] == [1]
    held = [p for p in (tmp_path / "store" / "data").glob("m=*/event_date=*")]
    assert len(held) == 2  # the current one and that of the writer who was late


def test_index_is_pruned_and_folded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(msgdedup, "INDEX_LOADS", 2)
    store = msgdedup.MessageStore(spark, f"file://{tmp_path}/store")
    for i in range(4):
        store.merge(msgdedup.nodes(spark.createDataFrame([message(i, "same" if i in (0, 3) else f"e{i}", None, T(2024, 1, 1 + i))], MESSAGE)))
    assert sorted(r.delivery_id for r in store.kept().collect()) == [0, 1, 2]
    assert all(len(ms) <= 2 for ms in store.manifest()["index"].values())
    with pytest.raises(ValueError):
        store.merge(msgdedup.nodes(spark.createDataFrame([message(9, "z", None, T(2024, 2, 1))], MESSAGE).withColumn("more", F.lit(1))))


def test_an_earlier_message_that_arrives_later_wins(spark, tmp_path):
    store = msgdedup.MessageStore(spark, f"file://{tmp_path}/store")
    store.merge(msgdedup.nodes(spark.createDataFrame([message(5, "a", 1, T(2024, 1, 5))], MESSAGE)))
    store.merge(msgdedup.nodes(spark.createDataFrame([message(1, "a", 2, T(2024, 1, 1))], MESSAGE)))
    assert [r.delivery_id for r in store.kept().collect()] == [1]


def test_dedup_empty(spark):
    df = spark.createDataFrame([], MESSAGE)
    store, merges = msgdedup.dedup_in_batches(df)
    assert store.kept().count() == 0 and all(m.repeats.count() == 0 for m in merges)
    nulls = spark.createDataFrame([(i, None, None, None, None, None, None, None) for i in range(3)], MESSAGE)
    assert msgdedup.repeats(msgdedup.nodes(nulls)).count() == 0
