import datetime as dt
import json

import pytest

from tidegrid.sources import providers
from tidegrid.streaming.bridge import EventLake, PageConsumer

D = dt.date


def answering(pages):
    """An opener that gives the first document whose text is in the address, or 404."""

    import io
    import json
    import urllib.error

    class Answer(io.BytesIO):  # here, so that executors needn't import this module
        headers = {}

    def opener(request, timeout):
        for part, document in pages.items():
            if part in request.full_url:
                return Answer(json.dumps(document).encode())
        raise urllib.error.HTTPError(request.full_url, 404, "not found", {}, None)

    return opener


def payloads(df):
    return sorted((json.loads(r.payload) for r in df.collect()), key=str)


def test_bars_are_fetched_per_ticker(spark):
    bar = lambda day, c: {"date": f"{day}T00:00:00Z", "open": c, "high": c, "low": c, "close": c, "volume": 5}
    pages = {"/AAA/prices?startDate=2026-01-01&endDate=2026-01-31": [bar("2026-01-02", 1.0)], "/BBB/prices": [bar("2026-01-02", 2.0), bar("2026-01-05", 3.0)]}
    df = providers.daily_bars(spark, "http://x/daily", "t", [" aaa", "BBB", "AAA"], D(2026, 1, 1), D(2026, 1, 31), opener=answering(pages))
    assert df.rdd.getNumPartitions() >= 1
    assert [(p["symbol"], p["date"], p["close"]) for p in payloads(df)] == [("AAA", "2026-01-02", 1.0), ("BBB", "2026-01-02", 2.0), ("BBB", "2026-01-05", 3.0)]
    with pytest.raises(ValueError):
        providers.daily_bars(spark, "http://x", "t", ["AAA"], D(2026, 2, 1), D(2026, 1, 1))
    for bad in ([], ["A/B"], [""]):
        with pytest.raises(ValueError):
            providers.daily_bars(spark, "http://x", "t", bad, D(2026, 1, 1), D(2026, 1, 1))


def test_a_failing_key_is_an_error_or_a_row(spark):
    plan = lambda k: [providers.Call(f"http://x/{k}")]
    with pytest.raises(Exception, match="404"):
        providers.fetch(spark, [("a",), ("b",)], "k string", plan, opener=answering({"/a": 1})).collect()
    got = {r.k: (r.document, r.error is None) for r in providers.fetch(spark, [("a",), ("b",)], "k string", plan, opener=answering({"/a": 1}), keep_errors=True).collect()}
    assert got == {"a": ("1", True), "b": (None, False)}
    assert providers.fetch(spark, [], "k string", plan).count() == 0


def test_other_providers(spark):
    facts = {"facts": {"us-gaap": {"Revenues": {"units": {"USD": [{"start": "2026-01-01", "end": "2026-03-31", "val": 5, "accn": "n", "fp": "Q1", "form": "10-Q", "filed": "2026-05-01"}]}}}}}
    got = payloads(providers.company_facts(spark, "http://x", "me", {"AAA": "123"}, ["Revenues"], opener=answering({"CIK0000000123.json": facts})))
    assert [(p["symbol"], p["value"]) for p in got] == [("AAA", 5.0)]
    got = payloads(providers.estimates(spark, "http://x/e", "k", ["AAA"], opener=answering({"ticker=AAA": [{"quarter": "Q1 26", "estimate": 1.0, "actual": 1.5, "reported": "2026-05-01"}]})))
    assert [(p["symbol"], p["event_status"]) for p in got] == [("AAA", "reported")]
    series = {"observations?": {"observations": [{"date": "2026-01-01", "value": "2.5", "realtime_start": "2026-02-01"}]}, "series?": {"seriess": [{"units_short": "Index", "frequency_short": "M"}]}}
    got = payloads(providers.macro_series(spark, "http://x/series", "k", ["cpi"], D(2026, 1, 1), D(2026, 1, 31), opener=answering(series)))
    assert [(p["series_id"], p["value"], p["unit"], p["frequency"]) for p in got] == [("CPI", 2.5, "Index", "M")]
    page = {"articles": [{"title": "t", "url": "http://u", "publishedAt": "2026-01-01T00:00:00Z", "source": {"name": "p"}}]}
    assert len(payloads(providers.news(spark, "http://x/n", "k", ["bees"], D(2026, 1, 1), D(2026, 1, 2), opener=answering({"q=bees": page})))) == 1
    for bad in (lambda: providers.news(spark, "u", "k", ["q"], D(2026, 1, 1), D(2026, 1, 2), 101), lambda: providers.company_facts(spark, "u", " ", {"A": "1"}, []), lambda: providers.anomaly_page(spark, "u"), lambda: providers.anomaly_page(spark, "http://u", 0)):
        with pytest.raises(ValueError):
            bad()


def test_a_page_of_anomalies_is_consumed_once(spark, tmp_path):
    items = [{"ticker": "aaa", "window_start": "2026-01-01T00:00:00Z", "anomaly_type": "jump", "detected_at": "2026-01-01T00:01:00Z", "details": {"price": 2.0}}]
    lake = EventLake(spark, f"file://{tmp_path}/lake")
    for want in ((1, 0), (0, 1)):
        page = [tuple(r) for r in providers.anomaly_page(spark, "http://x", opener=answering({"/anomalies?limit=500": items})).collect()]
        consumer = PageConsumer(page)
        r = lake.poll(consumer, f"run{want[0]}")
        assert (r.accepted_events, r.duplicate_events) == want and len(consumer.committed) == 1
