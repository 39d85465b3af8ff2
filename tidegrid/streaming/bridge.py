"""Bounded micro-batches of messages: decode, validate, quarantine, deduplicate, write by event hour, then acknowledge.

A Structured Streaming query calls ``take_batch`` from ``foreachBatch``; offsets are
committed by Spark after it returns, so files are durable before an offset is, and
a batch that is repeated after a crash finds its own events by their identities.

History is looked up through an identifier index in buckets: a batch reads only the
buckets of its identifiers and only the hours that hold one of them, so its cost
doesn't grow with the history. The index is written before the data and decides
nothing: an entry whose event isn't in its hour (a crash in between) is no repeat.
"""

from __future__ import annotations

import datetime as dt
import json
import time
from collections import deque
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import canonical_json
from ..operators import msgdedup
from ..session import python_tasks
from ..sources.contracts import ZONED
from ..sources.storage import ConcurrentWriteError, HadoopFiles, Versions, small_side, stash

MESSAGE = "topic string, partition int, offset bigint, value string"
EVENT = "event_id string, symbol string, event_timestamp timestamp, event_type string, price double, anomaly_score double, details_json string, detected_at timestamp, source_topic string, kafka_partition int, kafka_offset bigint, ingested_at timestamp"
#: Rows of one file of an hour at most.
FILE_ROWS = 1_000_000
PLACE = ["source_topic", "kafka_partition", "kafka_offset"]
REQUIRED = ("event_id", "symbol", "event_timestamp", "event_type")


Message = tuple[str, int, int, str]


class Consumer(Protocol):
    """Hands out one message (topic, partition, offset, value) at a time, or None, and is told what is durable."""

    def poll(self, seconds: float) -> Message | None: ...

    def commit(self, messages: Sequence[Message]) -> None: ...


class PageConsumer:
    """One page of messages fetched by HTTP as a consumer; ``committed`` holds what was acknowledged."""

    def __init__(self, page: Sequence[Message]):
        self.waiting, self.committed = deque(page), []

    def poll(self, seconds: float) -> Message | None:
        return self.waiting.popleft() if self.waiting else None

    def commit(self, messages: Sequence[Message]) -> None:
        self.committed += messages


@dataclass(frozen=True)
class BatchResult:
    run_id: str
    status: str
    polled_messages: int
    accepted_events: int
    duplicate_events: int
    quarantined_events: int
    files_written: int
    committed_messages: int
    started_at: str
    completed_at: str


def decode(messages: DataFrame, ingested_at: str) -> DataFrame:
    """messages: MESSAGE. Adds the event's columns and ``error`` (null: valid)."""
    def get(name: str):
        return F.get_json_object("value", f"$.{name}")

    v = F.try_parse_json("value")
    is_object = F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False))
    blank = F.filter(F.array(*[F.when(F.coalesce(F.trim(get(r)), F.lit("")) == "", F.lit(r)) for r in REQUIRED]), lambda x: x.isNotNull())
    bad_number = [F.when(get(c).isNotNull() & get(c).try_cast("double").isNull(), F.lit(f"{c}: expected a number")) for c in ("price", "anomaly_score")]
    error = F.coalesce(
        F.when(~is_object, F.lit("not a JSON object")),
        F.when(F.size(blank) > 0, F.concat(F.lit("missing fields: "), F.array_join(blank, ", "))),
        F.when(~get("event_timestamp").rlike(ZONED) | get("event_timestamp").try_cast("timestamp").isNull(), F.lit("event_timestamp: expected an ISO timestamp with a time zone")),
        F.when(get("detected_at").isNotNull() & ~F.coalesce(get("detected_at").rlike(ZONED), F.lit(False)), F.lit("detected_at: expected an ISO timestamp with a time zone")),
        *bad_number,
    )
    return messages.select(
        "topic", "partition", "offset", "value", error.alias("error"),
        F.trim(get("event_id")).alias("event_id"), F.upper(F.trim(get("symbol"))).alias("symbol"), get("event_timestamp").try_cast("timestamp").alias("event_timestamp"), F.trim(get("event_type")).alias("event_type"),
        get("price").try_cast("double").alias("price"), get("anomaly_score").try_cast("double").alias("anomaly_score"), F.coalesce(canonical_json(get("details")), F.lit("{}")).alias("details_json"), get("detected_at").try_cast("timestamp").alias("detected_at"),
        F.col("topic").alias("source_topic"), F.col("partition").alias("kafka_partition"), F.col("offset").alias("kafka_offset"), F.lit(ingested_at).cast("timestamp").alias("ingested_at"),
    )


class EventLake:
    """stream_events/date=…/hour=… below root, with an identifier index, quarantine and batch manifests beside it."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), HadoopFiles(spark, root)
        self.index = msgdedup.IdentifierIndex(spark, f"{self.root}/metadata/event_index")
        self.index_state = Versions(self.files, f"{self.root}/metadata/event_index_versions")

    @property
    def data(self) -> str:
        return f"{self.root}/raw/stream_events"

    def events(self, hours: list[str] | None = None) -> DataFrame:
        """All events, or those of the given date=…/hour=… folders."""
        schema = f"{EVENT}, date string, hour string"
        paths = self.files.directories(self.data)[:1] and [self.data] if hours is None else [f"{self.data}/{h}" for h in hours if self.files.exists(f"{self.data}/{h}")]
        return self.spark.read.option("basePath", self.data).schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _unseen(self, good: DataFrame) -> DataFrame:
        """Rows of which no event in the lake has the event_id or the position."""
        ids = stash(msgdedup.identifiers(msgdedup.nodes(good)).distinct(), "batch-ids")
        hits = self.index.find(self.index_state.read()[1] or {}, ids)
        hours = [] if hits is None else sorted(r.place for r in hits.select("place").distinct().collect())  # hours that hold an identifier of the batch
        if not hours:
            return good
        held = self.events(hours)
        fresh = small_side(stash(good.select(F.lower(F.trim("event_id")).alias("e"), *PLACE), "batch-identities"))
        known_ids = held.select(F.lower(F.trim("event_id")).alias("e")).join(fresh.select("e"), "e", "left_semi").distinct()
        known_at = held.select(*PLACE).join(fresh.select(*PLACE), PLACE, "left_semi").distinct()
        return good.withColumn("e", F.lower(F.trim("event_id"))).join(known_ids, "e", "left_anti").join(known_at, PLACE, "left_anti").drop("e")

    def _index(self, new: DataFrame, run_id: str) -> None:
        hour = F.concat(F.lit("date="), F.date_format("message.event_timestamp", "yyyy-MM-dd"), F.lit("/hour="), F.date_format("message.event_timestamp", "HH"))
        added = stash(msgdedup.identifiers(msgdedup.nodes(new), hour.alias("place")), "index-rows")
        for attempt in range(5):
            version, state = self.index_state.read()
            try:
                self.index_state.replace(version, self.index.extend(state or {}, f"{run_id}-{attempt}", added, self.files))
                return
            except ConcurrentWriteError:
                continue
        raise ConcurrentWriteError(self.root)

    def take_batch(self, messages: DataFrame, run_id: str, now: dt.datetime | None = None, hook: Callable[[str, str], None] | None = None) -> BatchResult:
        """One micro-batch. Repeating a run_id is safe: its events are recognised, its quarantine is rewritten. One writer at a time."""
        say, started = hook or (lambda *_: None), (now or dt.datetime.now(dt.timezone.utc)).astimezone(dt.timezone.utc)
        decoded = stash(decode(messages, started.isoformat()), "decoded")
        counted = decoded.agg(F.count("*").alias("n"), F.count("error").alias("bad")).first()
        n_all, n_bad = counted.n, counted.bad
        if n_bad:
            bad = decoded.where("error is not null").select("topic", "partition", "offset", "error", F.col("value").alias("raw_value"), F.lit(started.isoformat()).alias("received_at"))
            bad.hint("rebalance").write.mode("overwrite").json(f"{self.root}/quarantine/stream/run={run_id}")
        columns = [c.split()[0] for c in EVENT.split(", ")]
        good = stash(decoded.where("error is null").select(*columns).orderBy(*PLACE).withColumn("delivery_id", F.monotonically_increasing_id()), "batch")  # the first in the order of the log wins
        unseen = stash(self._unseen(good), "unseen")
        again = msgdedup.repeats(msgdedup.nodes(unseen).select(*msgdedup.NODE)).select("delivery_id")
        new = stash(unseen.join(again, "delivery_id", "left_anti"), "new-events")
        accepted = new.count()
        staged = f"{self.root}/_staging/{run_id}"
        self.files.delete(staged)
        written = 0
        if accepted:
            self._index(new, run_id)
            say("before_write", staged)
            rows = new.withColumn("date", F.date_format("event_timestamp", "yyyy-MM-dd")).withColumn("hour", F.date_format("event_timestamp", "HH"))
            full = rows.groupBy("date", "hour").agg(F.count("*").alias("_n")).where(F.col("_n") > FILE_ROWS)
            split = rows.join(full, ["date", "hour"], "left").withColumn("_part", F.pmod(F.xxhash64("delivery_id"), F.ceil(F.coalesce("_n", F.lit(1)) / FILE_ROWS)))
            # many small hours are written side by side, a full one by several tasks
            split.repartition(python_tasks(self.spark), "date", "hour", "_part").select(*columns, "date", "hour").write.partitionBy("date", "hour").option("compression", "zstd").parquet(staged)
            made = [p for p, _, _ in self.files.list(staged, recursive=True) if p.endswith(".parquet")]

            def promote(numbered: tuple[int, str]) -> None:
                n, p = numbered
                into = f"{self.data}/{p.split(f'/_staging/{run_id}/', 1)[1].rsplit('/', 1)[0]}"
                self.files.mkdirs(into)
                self.files.rename(p, f"{into}/part-{run_id}-{n}.parquet")

            with ThreadPoolExecutor(16) as pool:
                written = len(list(pool.map(promote, enumerate(made))))
            self.files.delete(staged)
        say("after_write_before_commit", run_id)
        result = BatchResult(run_id, "degraded" if n_bad else "success", n_all, accepted, n_all - n_bad - accepted, n_bad, written, n_all, started.isoformat(), dt.datetime.now(dt.timezone.utc).isoformat())
        self.files.publish_json(f"{self.root}/metadata/stream_batches/{run_id}.json", asdict(result))
        return result

    def poll(self, consumer: Consumer, run_id: str, max_records: int = 500, max_wait_seconds: float = 1.0, hook: Callable[[str, str], None] | None = None, clock: Callable[[], float] = time.monotonic) -> BatchResult:
        """Take one batch from a consumer, bounded by records and by time, and commit it after its files are durable."""
        if max_records < 1 or max_wait_seconds < 0:
            raise ValueError("the bounds of a batch must be positive")
        until, taken = clock() + max_wait_seconds, []
        while len(taken) < max_records:
            left = until - clock()
            if taken and left <= 0:
                break
            message = consumer.poll(max(left, 0.0))
            if message is None:
                break
            taken.append(message)
        result = self.take_batch(self.spark.createDataFrame(taken, MESSAGE), run_id, hook=hook)
        if taken:
            consumer.commit(taken)
        return result

    def manifests(self) -> list[dict]:
        return [json.loads(self.files.read_text(p)) for p, _, _ in self.files.list(f"{self.root}/metadata/stream_batches") if p.endswith(".json")]

    def run(self, stream: DataFrame, checkpoint: str, prefix: str = "batch") -> None:
        """Drain a stream of messages (MESSAGE columns) in bounded micro-batches and stop."""
        query = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, n: self.take_batch(df, f"{prefix}-{n:09d}") and None).start()
        query.awaitTermination()


def message_files(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """A stream over JSON message files, a bounded number per micro-batch."""
    return spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", files_per_batch).json(folder)


def kafka_messages(spark: SparkSession, servers: str, topic: str, max_records: int = 500) -> DataFrame:
    """A stream over a topic from the earliest offset, at most max_records per micro-batch; needs Spark's Kafka connector."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").option("maxOffsetsPerTrigger", max_records).load()
    return raw.select("topic", "partition", "offset", F.col("value").cast("string").alias("value"))
