"""Readers: files as payload rows, lake datasets, manifests; the bounded HTTP client and provider mappings."""

from __future__ import annotations

import gzip
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterable, Mapping, Sequence
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import HadoopFiles, PartitionLog, arrow_fs, scratch


class MissingDatasetError(FileNotFoundError):
    """A dataset that a model needs has no file."""


def _numbered(df: DataFrame) -> DataFrame:
    return df.withColumn("position", F.monotonically_increasing_id())


def read_payloads(spark: SparkSession, location: str) -> DataFrame:
    """payload, position of a .csv, .json (array of objects) or .jsonl file or folder, by its suffix; http(s) locations are fetched first.

    CSV values are strings. Blank lines of JSONL are skipped. A JSON array with an
    element that is no object is an error.
    """
    if location.startswith(("http://", "https://")):
        location = _fetched(spark, location)
    suffix = PurePosixPath(urllib.parse.urlparse(location).path).suffix.lower()
    if suffix == ".jsonl":
        lines = spark.read.text(location).where(F.trim("value") != "")
        return _numbered(lines.select(F.col("value").alias("payload")))
    if suffix == ".csv":
        rows = spark.read.option("header", True).csv(location)
        return _numbered(rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("payload")))
    if suffix == ".json":
        # an array can't be split, so a file is one task; large feeds come as JSONL
        whole = spark.read.option("wholetext", True).text(location)
        items = whole.select(F.from_json("value", "array<variant>").alias("a"))
        bad = items.where(F.col("a").isNull() | F.exists("a", lambda x: ~F.startswith(F.schema_of_variant(x), F.lit("OBJECT")))).limit(1).count()
        if bad:
            raise ValueError(f"{location}: expected an array of objects")
        return _numbered(items.select(F.explode("a").alias("v")).select(F.to_json("v").alias("payload")))
    raise ValueError(f"unsupported file type {suffix!r}; use .csv, .json or .jsonl")


#: Bytes a fetched file may have, and of one piece of it.
FETCH_BYTES, FETCH_PIECE = 4 << 30, 8 << 20


def _fetched(spark: SparkSession, url: str, opener: Callable = urllib.request.urlopen, retries: int = 2, most: int = FETCH_BYTES, sleep: Callable[[float], None] = time.sleep) -> str:
    """Copy a remote file to the shared folder piece by piece, unpacked if it comes gzipped; the copy is a file Spark can split."""
    target = f"{scratch(spark, 'fetched')}{PurePosixPath(urllib.parse.urlparse(url).path).suffix}"
    fs, at = arrow_fs(target)
    for attempt in range(retries + 1):
        try:
            with opener(urllib.request.Request(url, headers={"Accept-Encoding": "gzip"}), timeout=60) as r, fs.open_output_stream(at) as out:
                source = gzip.GzipFile(fileobj=r) if (r.headers.get("Content-Encoding") or "").lower() == "gzip" else r
                size = 0
                while piece := source.read(FETCH_PIECE):
                    size += len(piece)
                    if size > most:
                        raise ValueError(f"{url} has more than {most} bytes")
                    out.write(piece)
            return target
        except urllib.error.HTTPError as e:
            if e.code not in RETRY_STATUS or attempt == retries:
                raise
        except urllib.error.URLError:
            if attempt == retries:
                raise
        sleep(min(2.0, 0.25 * 2**attempt))
    raise AssertionError("not reached")


def partition_files(spark: SparkSession, root: str, dataset: str, partition: str) -> list[str]:
    """The files of a partition (year=…/month=…) that count."""
    files = HadoopFiles(spark, root)
    held = [p for p, _, _ in files.list(f"{root}/{dataset}/{partition}") if p.endswith(".parquet")]
    return PartitionLog(files, root.rsplit("/", 1)[0], dataset).live(partition, held)


def dataset_files(spark: SparkSession, root: str, dataset: str) -> list[str]:
    """All files of a dataset that count."""
    files = HadoopFiles(spark, root)
    log = PartitionLog(files, root.rsplit("/", 1)[0], dataset)
    by_partition: dict[str, list[str]] = {}
    for p, _, _ in files.list(f"{root}/{dataset}", recursive=True):
        if p.endswith(".parquet") and "/_" not in p:
            by_partition.setdefault("/".join(p.rsplit("/", 3)[1:3]), []).append(p)
    compacted = set(log.compacted())
    return sorted(p for part, paths in by_partition.items() for p in (log.live(part, paths) if part in compacted else paths))


def read_dataset(spark: SparkSession, root: str, dataset: str, ddl: str | None = None, partitions: Sequence[str] | None = None) -> DataFrame:
    """A partitioned dataset with its year and month as strings; an absent one is a MissingDatasetError, or empty if ddl is given.

    partitions: year=…/month=… folders to read; the others aren't even listed.
    Folders that were never compacted are read as folders, so that Spark lists and
    prunes them; of the others the files that count are named.
    """
    path = f"{root}/{dataset}"
    files = HadoopFiles(spark, root)
    log = PartitionLog(files, root.rsplit("/", 1)[0], dataset)
    compacted = set(log.compacted())
    if partitions is not None:
        there = [p for p in partitions if files.exists(f"{path}/{p}")]
    elif compacted:
        there = ["/".join(m.rsplit("/", 2)[1:]) for y in files.directories(path) for m in files.directories(y)]
    else:
        there = None
    if there is None:
        paths = [path] if dataset_files(spark, root, dataset) else []
    else:
        paths = [x for p in there for x in (partition_files(spark, root, dataset, p) if p in compacted else [f"{path}/{p}"] if files.list(f"{path}/{p}") else [])]
    if not paths:
        if ddl is None:
            raise MissingDatasetError(path)
        return spark.createDataFrame([], f"{ddl}, year string, month string")
    reader = spark.read.option("basePath", path)
    if ddl is not None:
        reader = reader.schema(f"{ddl}, year string, month string")
    return reader.parquet(*paths)


def read_files(spark: SparkSession, files: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Files by name, columns merged by name and partition columns left out."""
    df = spark.read.option("mergeSchema", True).parquet(*files)
    return df.select(*columns) if columns else df


def month_predicate(start, end) -> str:
    """Partition predicate for a range of dates: Spark can't derive year and month from a date by itself."""
    months = []
    y, m = start.year, start.month
    while (y, m) <= (end.year, end.month):
        months.append(f"(year = '{y:04d}' and month = '{m:02d}')")
        y, m = (y, m + 1) if m < 12 else (y + 1, 1)
    return " or ".join(months) or "false"


def read_manifests(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """JSON manifests of a folder, fields by name; none gives a typed empty relation."""
    files = [p for p, _, _ in HadoopFiles(spark, folder).list(folder) if p.endswith(".json")]
    return spark.read.schema(schema).option("multiLine", True).json(files) if files else spark.createDataFrame([], schema)


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    """symbol of a universe text; comments start with #."""
    lines = spark.read.text(path).select(F.upper(F.trim(F.regexp_replace("value", "#.*$", ""))).alias("symbol")).where("symbol <> ''").distinct()
    if not lines.limit(1).count():
        raise ValueError(f"{path}: the universe is empty")
    return lines


def read_seed(spark: SparkSession, path: str, schema: str, key: Sequence[str]) -> DataFrame:
    """A small CSV table with header, typed by the schema; a value that doesn't fit, or a key that is null or repeated, is an error."""
    seed = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).csv(path)
    bad = F.lit(False)
    for k in key:
        bad = bad | F.col(k).isNull()
    if seed.where(bad).limit(1).count() or seed.groupBy(*key).count().where("count > 1").limit(1).count():
        raise ValueError(f"{path}: {list(key)} is no key")
    return seed


RETRY_STATUS = (429, 500, 502, 503, 504)


def get_json(url: str, params: Mapping[str, str] | None = None, headers: Mapping[str, str] | None = None, timeout: float = 60, retries: int = 2, opener: Callable = urllib.request.urlopen, sleep: Callable[[float], None] = time.sleep):
    """GET a JSON document; 429, 5xx and connection errors are tried again with bounded backoff, a Retry-After is honoured."""
    full = url + ("?" + urllib.parse.urlencode(params) if params else "")
    for attempt in range(retries + 1):
        try:
            request = urllib.request.Request(full, headers={"Accept": "application/json", "Accept-Encoding": "gzip", **(headers or {})})
            with opener(request, timeout=timeout) as r:
                data = r.read()
                return json.loads(gzip.decompress(data) if (r.headers.get("Content-Encoding") or "").lower() == "gzip" else data)
        except urllib.error.HTTPError as e:
            if e.code not in RETRY_STATUS or attempt == retries:
                raise
            after = e.headers.get("Retry-After") if e.headers else None
            sleep(float(after) if after and after.isdigit() else min(2.0, 0.25 * 2**attempt))
        except urllib.error.URLError:
            if attempt == retries:
                raise
            sleep(min(2.0, 0.25 * 2**attempt))


# --- provider documents to canonical payload rows; each takes a DataFrame with the provider's JSON documents ---


def map_daily_bars(documents: DataFrame) -> DataFrame:
    """document: JSON array of bars (date, open, high, low, close, volume), ticker. Rows of the prices contract."""
    bar = "array<struct<date:string,open:double,high:double,low:double,close:double,volume:bigint>>"
    one = documents.select("ticker", F.explode(F.from_json("document", bar)).alias("b"))
    day = F.substring("b.date", 1, 10)
    return _payload(one.select(F.upper(F.trim("ticker")).alias("symbol"), day.alias("date"), "b.open", "b.high", "b.low", "b.close", "b.volume", F.concat_ws(":", F.upper(F.trim("ticker")), day).alias("source_record_id")).dropDuplicates(["source_record_id"]))


# Forms whose facts count.
ANNUAL_AND_QUARTERLY = ("10-K", "10-Q")


def map_company_facts(documents: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """document: facts by metric and unit, symbol. Annual and quarterly reports only, one row per report, metric, period and unit."""
    fact = "map<string,struct<units:map<string,array<struct<start:string,`end`:string,val:double,accn:string,fp:string,form:string,filed:string>>>>>"
    facts = documents.select("symbol", F.explode(F.from_json(F.get_json_object("document", "$.facts.us-gaap"), fact)).alias("metric", "m"))
    units = facts.where(F.col("metric").isin(*metrics)).select("symbol", "metric", F.explode("m.units").alias("unit", "rows"))
    rows = units.select("symbol", "metric", "unit", F.explode("rows").alias("r")).where(F.col("r.form").isin(*ANNUAL_AND_QUARTERLY))
    record = F.concat_ws(":", "r.accn", "metric", "r.end", "unit")
    return _payload(rows.select("symbol", F.col("metric").alias("metric_name"), F.col("r.start").alias("period_start"), F.col("r.end").alias("period_end"), F.col("r.fp").alias("period_type"), F.concat("r.filed", F.lit("T00:00:00Z")).alias("filed_at"), F.col("r.val").alias("value"), F.lower("unit").alias("unit"), F.when(F.length("unit") == 3, F.upper("unit")).alias("currency"), record.alias("source_record_id")).dropDuplicates(["source_record_id"]))


def map_estimates(documents: DataFrame) -> DataFrame:
    """document: rows with quarter 'Qn YY', estimate, actual, reported; symbol. The quarter's last day is the fiscal period end."""
    rows = documents.select("symbol", F.explode(F.from_json("document", "array<struct<quarter:string,estimate:double,actual:double,reported:string>>")).alias("r"))
    q, y = F.regexp_extract("r.quarter", r"^Q([1-4]) (\d{2})$", 1).try_cast("int"), F.regexp_extract("r.quarter", r"^Q([1-4]) (\d{2})$", 2).try_cast("int")
    end = F.last_day(F.make_date(F.lit(2000) + y, q * 3, F.lit(1)))
    return _payload(rows.where(q.isNotNull()).select("symbol", F.concat("r.reported", F.lit("T00:00:00Z")).alias("event_timestamp"), end.cast("string").alias("fiscal_period_end"), F.when(F.col("r.actual").isNull(), "estimate").otherwise("reported").alias("event_status"), F.col("r.estimate").alias("eps_estimate"), F.col("r.actual").alias("eps_actual"), F.concat_ws(":", "symbol", "r.quarter").alias("source_record_id")))


def map_macro_series(documents: DataFrame) -> DataFrame:
    """document: observations (date, value, realtime_start) with '.' for missing; series_id, units_short, units, frequency_short."""
    rows = documents.select("series_id", "units_short", "units", "frequency_short", F.explode(F.from_json(F.get_json_object("document", "$.observations"), "array<struct<date:string,value:string,realtime_start:string>>")).alias("o"))
    value = F.col("o.value").try_cast("double")
    return _payload(rows.where(value.isNotNull()).select("series_id", F.col("o.date").alias("observation_date"), F.concat("o.realtime_start", F.lit("T00:00:00Z")).alias("released_at"), value.alias("value"), F.coalesce("units_short", "units", F.lit("UNKNOWN")).alias("unit"), F.coalesce("frequency_short", F.lit("UNKNOWN")).alias("frequency"), F.concat_ws(":", "series_id", "o.date", "o.realtime_start").alias("source_record_id")))


def map_news(documents: DataFrame) -> DataFrame:
    """document: articles (title, url, publishedAt, source.name). The identity is a hash of url and time."""
    rows = documents.select(F.explode(F.from_json(F.get_json_object("document", "$.articles"), "array<struct<title:string,url:string,publishedAt:string,source:struct<name:string>>>")).alias("a"))
    return _payload(rows.select(F.col("a.publishedAt").alias("event_timestamp"), F.col("a.title").alias("headline"), "a.url", F.col("a.source.name").alias("publisher"), F.sha2(F.concat("a.url", F.lit("\u0000"), "a.publishedAt"), 256).alias("source_record_id")).dropDuplicates(["source_record_id"]))


def map_anomalies(documents: DataFrame, topic: str = "anomalies.http") -> DataFrame:
    """document: one page of anomalies. Messages in the form of the stream: topic, partition, offset (from a hash of the content), value."""
    rows = documents.select(F.explode(F.from_json("document", "array<struct<ticker:string,window_start:string,anomaly_type:string,details:string,detected_at:string>>")).alias("a"))
    identity = F.sha2(F.concat_ws("\u0000", "a.ticker", "a.window_start", "a.anomaly_type"), 256)
    value = F.to_json(F.struct(identity.alias("event_id"), F.col("a.ticker").alias("symbol"), F.col("a.window_start").alias("event_timestamp"), F.col("a.anomaly_type").alias("event_type"), F.get_json_object("a.details", "$.price").try_cast("double").alias("price"), F.get_json_object("a.details", "$.score").try_cast("double").alias("anomaly_score"), F.col("a.details").alias("details"), F.col("a.detected_at").alias("detected_at")))
    offset = F.conv(F.substring(identity, 1, 15), 16, 10).cast("bigint")
    return rows.select(F.lit(topic).alias("topic"), F.lit(0).alias("partition"), offset.alias("offset"), value.alias("value"))


def _payload(df: DataFrame) -> DataFrame:
    return _numbered(df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("payload")))


def payload_rows(spark: SparkSession, rows: Iterable[Mapping]) -> DataFrame:
    """Python mappings as payload rows, for tests and small callers."""
    return spark.createDataFrame([(json.dumps(r, default=str), i) for i, r in enumerate(rows)], "payload string, position bigint")
