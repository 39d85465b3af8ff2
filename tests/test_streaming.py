import datetime as dt
import json
import os
import time

import pytest

from tidegrid.streaming.bridge import MESSAGE, EventLake, PageConsumer, message_files

T = dt.datetime


def value(eid="e1", symbol="aapl", at="2026-08-10T14:05:00Z", **more):
    return json.dumps({"event_id": eid, "symbol": symbol, "event_timestamp": at, "event_type": "price_jump", "price": 1.5, "details": {"z": 3}, **more})


def batch(spark, *messages):
    return spark.createDataFrame([(m[0], 0, m[1], m[2]) for m in messages], MESSAGE)


@pytest.fixture
def lake(spark, tmp_path):
    return EventLake(spark, f"file://{tmp_path}/lake")


def test_accept_quarantine_and_repeat(spark, lake):
    first = lake.take_batch(batch(spark, ("t", 1, value()), ("t", 2, value("e2", at="2026-08-10T15:00:00+02:00")), ("t", 3, '{"symbol":"AAPL"}'), ("t", 4, "nope"), ("t", 5, value("e5", at="2026-08-10T15:00:00")), ("t", 6, value("E1"))), "b0")
    assert (first.polled_messages, first.accepted_events, first.quarantined_events, first.duplicate_events, first.status) == (6, 2, 3, 1, "degraded")
    got = {r.event_id: r for r in lake.events().collect()}
    assert got["e1"].symbol == "AAPL" and got["e1"].date == "2026-08-10" and got["e2"].hour == "13" and json.loads(got["e1"].details_json) == {"z": 3}
    again = lake.take_batch(batch(spark, ("t", 1, value("other")), ("u", 9, value(" e1 ")), ("t", 7, value("e7"))), "b1")
    assert (again.accepted_events, again.duplicate_events) == (1, 2)


def test_a_crash_before_the_commit_changes_nothing_on_replay(spark, lake):
    def crash(step, _):
        if step == "after_write_before_commit":
            raise RuntimeError("stop")

    messages = batch(spark, ("t", 1, value()), ("t", 2, value("e2")))
    with pytest.raises(RuntimeError):
        lake.take_batch(messages, "b0", hook=crash)
    assert lake.manifests() == []
    r = lake.take_batch(messages, "b0")
    assert (r.accepted_events, r.duplicate_events, lake.events().count()) == (0, 2, 2)


def test_stream_of_files_is_drained_in_batches(spark, lake, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for n, ids in enumerate((("a", "b"), ("b", "c"))):
        p = src / f"{n}.json"
        p.write_text("\n".join(json.dumps({"topic": "t", "partition": 0, "offset": 10 * n + i, "value": value(e)}) for i, e in enumerate(ids)))
        os.utime(p, (time.time() - 50 + n,) * 2)
    lake.run(message_files(spark, str(src)), f"file://{tmp_path}/check")
    assert sorted(r.event_id for r in lake.events().collect()) == ["a", "b", "c"]
    assert [m["accepted_events"] for m in lake.manifests()] == [2, 1]
    lake.run(message_files(spark, str(src)), f"file://{tmp_path}/check")
    assert len(lake.manifests()) == 2


def test_empty_batch(spark, lake):
    r = lake.take_batch(spark.createDataFrame([], MESSAGE), "b0")
    assert (r.polled_messages, r.accepted_events, r.status) == (0, 0, "success") and lake.events().count() == 0


def test_history_is_read_through_the_index(spark, lake):
    lake.take_batch(batch(spark, ("t", 1, value("a", at="2026-08-10T14:05:00Z")), ("t", 2, value("b", at="2026-08-11T09:00:00Z"))), "b0")
    asked = []
    whole = lake.events
    lake.events = lambda hours=None: asked.append(hours) or whole(hours)
    r = lake.take_batch(batch(spark, ("t", 3, value("A", at="2026-08-12T09:00:00Z")), ("t", 2, value("c", at="2026-08-12T09:00:00Z")), ("t", 4, value("d", at="2026-08-12T09:00:00Z"))), "b1")
    assert (r.accepted_events, r.duplicate_events) == (1, 2)
    assert asked == [["date=2026-08-10/hour=14", "date=2026-08-11/hour=09"]]
    lake.take_batch(batch(spark, ("t", 9, value("new", at="2026-08-12T09:00:00Z"))), "b2")
    assert len(asked) == 1  # no identifier of the batch is held, so no event is read


def test_a_crash_between_index_and_data_loses_nothing(spark, lake):
    def crash(step, _):
        if step == "before_write":
            raise RuntimeError("stop")

    messages = batch(spark, ("t", 1, value()), ("t", 2, value("e2")))
    with pytest.raises(RuntimeError):
        lake.take_batch(messages, "b0", hook=crash)
    assert lake.events().count() == 0
    assert lake.take_batch(messages, "b0").accepted_events == 2 and lake.take_batch(messages, "b1").duplicate_events == 2


def test_consumer_is_bounded_and_committed_last(spark, lake):
    page = PageConsumer([("t", 0, i, value(f"e{i}", details={"b": 1, "a": [2, {"d": 1, "c": 2}]})) for i in range(5)])
    with pytest.raises(ValueError):
        lake.poll(page, "p", max_records=0)

    def crash(step, _):
        if step == "after_write_before_commit":
            raise RuntimeError("stop")

    with pytest.raises(RuntimeError):
        lake.poll(PageConsumer([("t", 0, 0, value("e0"))]), "p0", hook=crash)
    r = lake.poll(page, "p1", max_records=3)
    assert (r.polled_messages, r.accepted_events, r.duplicate_events, len(page.committed)) == (3, 2, 1, 3)
    ticks = iter([0.0, 0.0, 5.0, 5.0])
    assert lake.poll(page, "p2", clock=lambda: next(ticks)).polled_messages == 1 and len(page.committed) == 4
    assert {x.details_json for x in lake.events().where("event_id = 'e1'").collect()} == {'{"a":[2,{"c":2,"d":1}],"b":1}'}
