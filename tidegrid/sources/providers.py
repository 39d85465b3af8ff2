"""Readers of data providers: requests spread over executors, one document per request, mapped to contract rows.

A provider is the shape of its requests and the mapping of its documents. Requests
are rows (a symbol, a series, a query); each is fetched where its row lies, with
bounded retries, so a thousand symbols are a thousand parallel downloads and no
document passes the driver. Failed requests are errors or, if wanted, rows of
their own. Secrets and base addresses come from the caller; an ``opener`` in place
of the network makes it testable offline.
"""

from __future__ import annotations

import datetime as dt
import json
import re
import urllib.request
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import readers

Opener = Callable[..., object]
TICKER = re.compile(r"^[A-Za-z][A-Za-z0-9.\-]{0,14}$")
FETCHED = "document string, error string"


@dataclass(frozen=True)
class Call:
    """One GET: address, parameters and headers."""

    url: str
    params: tuple[tuple[str, str], ...] = ()
    headers: tuple[tuple[str, str], ...] = ()


def fetch(spark: SparkSession, keys: Sequence[tuple], schema: str, plan: Callable[..., Sequence[Call]], opener: Opener = urllib.request.urlopen, combine: Callable[[list], object] | None = None, keep_errors: bool = False, retries: int = 2, timeout: float = 60) -> DataFrame:
    """A row per key with its document (JSON text), fetched in tasks of one key each.

    plan(*key) gives the calls of a key; with several, ``combine`` makes one document
    of their answers. An error of one key fails the job unless keep_errors keeps it
    as a row with ``error`` and no document. No keys give no rows.
    """
    frame = spark.createDataFrame(list(keys), schema)
    names = frame.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            documents, errors = [], []
            for key in pdf.itertuples(index=False, name=None):
                try:
                    answers = [readers.get_json(c.url, dict(c.params), dict(c.headers), timeout, retries, opener) for c in plan(*key)]
                    documents.append(json.dumps(combine(answers) if combine else answers[0]))
                    errors.append(None)
                except Exception as e:
                    if not keep_errors:
                        raise RuntimeError(f"{key}: {e}") from e
                    documents.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pdf.assign(document=pd.Series(documents, dtype="object", index=pdf.index), error=pd.Series(errors, dtype="object", index=pdf.index))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields)
    return frame.repartition(max(1, len(keys)), *names).mapInPandas(run, f"{kinds}, {FETCHED}")


def _tickers(symbols: Sequence[str]) -> list[str]:
    """Clean, distinct tickers in order; none, or one with other characters, is an error."""
    out = list(dict.fromkeys(s.strip().upper() for s in symbols))
    bad = [s for s in out if not TICKER.match(s)]
    if bad or not out:
        raise ValueError(f"no tickers: {bad or symbols!r}")
    return out


def _range(start: dt.date, end: dt.date) -> None:
    if end < start:
        raise ValueError("the end precedes the start")


def daily_bars(spark: SparkSession, base: str, token: str, symbols: Sequence[str], start: dt.date, end: dt.date, **options) -> DataFrame:
    """Payload rows of the prices contract: one request per ticker."""
    _range(start, end)
    head = (("Authorization", f"Token {token}"),)
    plan = lambda ticker: [Call(f"{base}/{ticker}/prices", (("startDate", start.isoformat()), ("endDate", end.isoformat())), head)]
    return readers.map_daily_bars(fetch(spark, [(s,) for s in _tickers(symbols)], "ticker string", plan, **options).where("document is not null"))


def company_facts(spark: SparkSession, base: str, agent: str, companies: dict[str, str], metrics: Sequence[str], **options) -> DataFrame:
    """Payload rows of the fundamentals contract: one request per company (symbol to register number). The agent names who asks."""
    if not agent.strip():
        raise ValueError("the register wants to know who asks")
    keys = [(s, companies[s].strip().zfill(10)) for s in companies]
    if any(not number.isdigit() for _, number in keys):
        raise ValueError("register numbers are digits")
    plan = lambda symbol, number: [Call(f"{base}/CIK{number}.json", (), (("User-Agent", agent),))]
    return readers.map_company_facts(fetch(spark, keys, "symbol string, number string", plan, **options).where("document is not null"), metrics)


def estimates(spark: SparkSession, url: str, key: str, symbols: Sequence[str], **options) -> DataFrame:
    """Payload rows of the earnings contract: one request per ticker."""
    plan = lambda symbol: [Call(url, (("ticker", symbol), ("mode", "eps"), ("api_key", key)))]
    return readers.map_estimates(fetch(spark, [(s,) for s in _tickers(symbols)], "symbol string", plan, **options).where("document is not null"))


def macro_series(spark: SparkSession, base: str, key: str, series: Sequence[str], start: dt.date, end: dt.date, **options) -> DataFrame:
    """Payload rows of the macro contract: per series its description and its observations."""
    _range(start, end)
    common = (("api_key", key), ("file_type", "json"))
    plan = lambda one: [Call(base, (*common, ("series_id", one))), Call(f"{base}/observations", (*common, ("series_id", one), ("observation_start", start.isoformat()), ("observation_end", end.isoformat())))]
    both = lambda answers: {"about": (answers[0].get("seriess") or [{}])[0], "observations": answers[1].get("observations") or []}
    got = fetch(spark, [(s.strip().upper(),) for s in dict.fromkeys(series)], "series_id string", plan, combine=both, **options).where("document is not null")
    about = lambda name: F.get_json_object("document", f"$.about.{name}")
    return readers.map_macro_series(got.select("series_id", about("units_short").alias("units_short"), about("units").alias("units"), about("frequency_short").alias("frequency_short"), "document"))


def news(spark: SparkSession, url: str, key: str, queries: Sequence[str], start: dt.date, end: dt.date, page_size: int = 100, **options) -> DataFrame:
    """Payload rows of the news contract: one page of at most 100 articles per query."""
    _range(start, end)
    if not 1 <= page_size <= 100:
        raise ValueError("page_size must lie between 1 and 100")
    plan = lambda q: [Call(url, (("q", q), ("from", start.isoformat()), ("to", end.isoformat()), ("language", "en"), ("sortBy", "publishedAt"), ("pageSize", str(page_size))), (("X-Api-Key", key),))]
    return readers.map_news(fetch(spark, [(q,) for q in dict.fromkeys(queries)], "query string", plan, **options).where("document is not null"))


def anomaly_page(spark: SparkSession, base: str, limit: int = 500, ticker: str | None = None, kind: str | None = None, **options) -> DataFrame:
    """Messages (topic, partition, offset, value) of one page of anomalies, to be taken by ``EventLake.take_batch`` or a ``PageConsumer``."""
    if not 1 <= limit <= 10_000:
        raise ValueError("limit must lie between 1 and 10000")
    if not re.match(r"^https?://[^/]+", base):
        raise ValueError("the base must be an absolute http(s) address")
    asked = [("limit", str(limit)), *([("ticker", ticker.upper())] if ticker else []), *([("anomaly_type", kind)] if kind else [])]
    plan = lambda _: [Call(f"{base.rstrip('/')}/anomalies", tuple(asked))]
    return readers.map_anomalies(fetch(spark, [(0,)], "page int", plan, **options).where("document is not null"))
