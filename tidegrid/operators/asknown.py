"""Attributes as they were known at event time.

Method: materialised periodic as-known snapshots plus a change log. Per key the
versions known in a snapshot period are folded to that period's best one; a
running maximum over the periods (at most as many as the calendar has) gives the
snapshot at the start of each period. Both are written once, in folders by load and
period, and later loads append theirs. An event joins the snapshot of the period
it lies in by equality, and replays only the changes of that same period known
by its day.

Scale: the fold has map-side combine, the running window sees one row per key
and period, and the events are folded to distinct (key, day) before any join, so
neither a hot key nor repeated events make a large group. No range join over the
whole history and no as-of window over raw versions is used.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.columns import epoch_day, lower_key, trim_key, upper_key
from ..sources.storage import HadoopFiles, Versions, scratch, stash
from .latest import keep_latest

#: Days between two snapshots; about one change per key and period keeps both sides small.
SNAPSHOT_DAYS = 91


def period_of(day: Column, every: int = SNAPSHOT_DAYS) -> Column:
    return F.floor(day / F.lit(every)).cast("int")


def change_log(versions: DataFrame, keys: Sequence[str], every: int = SNAPSHOT_DAYS) -> DataFrame:
    """versions: keys, known_day int, version struct (greatest wins). One row per key and known day."""
    return (
        versions.where(F.col("known_day").isNotNull())
        .groupBy(*keys, "known_day")
        .agg(F.max("version").alias("version"))
        .withColumn("period", period_of(F.col("known_day"), every))
    )


def snapshots(changes: DataFrame, keys: Sequence[str], last_period: int | None = None) -> DataFrame:
    """keys, period, snapshot: the best version known before the first day of the period.

    Written for every period from the first change on, to ``last_period`` (the
    last one an event needs) or to the key's last change plus one.
    """
    w = Window.partitionBy(*keys).orderBy("period")
    folded = (
        changes.repartition(*keys)  # one row a key and day by now; the fold and the window share this partitioning
        .groupBy(*keys, "period")
        .agg(F.max("version").alias("version"))
        .withColumn("until", F.lead("period").over(w))
        .withColumn("snapshot", F.max("version").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    )
    end = F.coalesce("until", F.lit(last_period).cast("int") if last_period is not None else F.col("period") + 1)
    return (
        folded.where(end > F.col("period"))
        .select(*keys, F.explode(F.sequence(F.col("period") + 1, end)).alias("period"), "snapshot")
    )


class AsKnownStore:
    """Change log and snapshots under ``root``, both in folders by load and period, with versions of one manifest.

    Each ``append`` writes the changes of its own versions, and their snapshots for the
    periods up to ``through``; nothing written before is touched, as the best of several
    loads is the greatest of their bests. ``reach`` adds snapshots of later periods.
    """

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], every: int = SNAPSHOT_DAYS):
        self.spark, self.root, self.keys, self.every = spark, root.rstrip("/"), list(keys), every
        self.manifest = Versions(HadoopFiles(spark, root), f"{self.root}/manifest")

    def _state(self) -> tuple[int, dict]:
        number, held = self.manifest.read()
        return number, held or {"loads": [], "through": None, "kinds": None}

    def _write(self, df: DataFrame, kind: str, load: str) -> None:
        # a period's rows lie together; AQE splits a period that is large
        df.hint("rebalance", "period").write.partitionBy("period").option("compression", "zstd").parquet(f"{self.root}/{kind}/load={load}")

    def _read(self, kind: str, column: str, periods: Column | None = None) -> DataFrame | None:
        _, held = self._state()
        if not held["loads"]:
            return None
        reader = self.spark.read.option("basePath", f"{self.root}/{kind}").schema(f"{held['kinds'][column]}, load string, period int")
        rows = reader.parquet(*[f"{self.root}/{kind}/load={x}" for x in held["loads"]]).drop("load")
        return rows if periods is None else rows.where(periods)

    def changes(self, periods: Column | None = None) -> DataFrame | None:
        """keys, known_day, version, period: one row per key, known day and load."""
        return self._read("changes", "changes", periods)

    def snapshots(self, periods: Column | None = None) -> DataFrame | None:
        """keys, snapshot, period: the best of each load known before the period's first day."""
        return self._read("snapshots", "snapshots", periods)

    def append(self, versions: DataFrame, through: int) -> None:
        """Add a load of versions (keys, known_day, version struct); snapshots go to period ``through``, or as far as they went before."""
        number, held = self._state()
        last = max(through, held["through"]) if held["through"] is not None else through
        load = f"{number + 1:06d}-{uuid.uuid4().hex[:8]}"
        changes = change_log(versions, self.keys, self.every)
        self._write(changes, "changes", load)
        kinds = {"changes": StructType([f for f in changes.schema.fields if f.name != "period"]).toDDL()}
        written = self.spark.read.option("basePath", f"{self.root}/changes").schema(f"{kinds['changes']}, load string, period int").parquet(f"{self.root}/changes/load={load}").drop("load")
        taken = snapshots(written.where(F.col("period") <= last), self.keys, last)
        self._write(taken, "snapshots", load)
        kinds["snapshots"] = StructType([f for f in taken.schema.fields if f.name != "period"]).toDDL()
        self.manifest.replace(number, {"loads": [*held["loads"], load], "through": last, "kinds": kinds})

    def reach(self, period: int) -> None:
        """Materialise the snapshots of the periods that are missing up to ``period``."""
        number, held = self._state()
        if not held["loads"] or period <= held["through"]:
            return
        load = f"{number + 1:06d}-{uuid.uuid4().hex[:8]}"
        later = snapshots(self.changes(F.col("period") <= period), self.keys, period).where(F.col("period") > held["through"])
        self._write(later, "snapshots", load)
        empty = self.changes(F.lit(False))
        self._write(empty, "changes", load)
        self.manifest.replace(number, {**held, "loads": [*held["loads"], load], "through": period})

    def lookup(self, events: DataFrame) -> DataFrame:
        """``as_known`` of events against the store; only the periods that events lie in are read."""
        keys = self.keys
        asked = stash(events.where(F.col("event_day").isNotNull()).select(*keys, "event_day").distinct().withColumn("period", period_of(F.col("event_day"), self.every)), "asked")
        span = asked.agg(F.min("period").alias("a"), F.max("period").alias("b")).first()
        _, held = self._state()
        if span.a is None or not held["loads"]:
            kind = StructType.fromDDL(held["kinds"]["changes"])["version"].dataType if held["kinds"] else None
            return events.withColumn("known", F.lit(None).cast(kind) if kind else F.lit(None))
        self.reach(span.b)
        inside = F.col("period").between(span.a, span.b)
        # one relation of what may be known in a period: its snapshot, known before its first day, and its changes
        held_then = self.snapshots(inside).select(*keys, "period", F.lit(None).cast("int").alias("known_day"), F.col("snapshot").alias("version"))
        candidates = held_then.unionByName(self.changes(inside).select(*keys, "period", "known_day", "version"))
        known = asked.join(candidates, [*keys, "period"]).where(F.col("known_day").isNull() | (F.col("known_day") <= F.col("event_day")))
        # grouped by what it is partitioned by already (a day has one period)
        best = known.groupBy(*keys, "period", "event_day").agg(F.max("version").alias("known")).drop("period")
        return events.join(best, [*keys, "event_day"], "left")


def as_known(events: DataFrame, versions: DataFrame, keys: Sequence[str], every: int = SNAPSHOT_DAYS) -> DataFrame:
    """events: keys, event_day int. Adds ``known``: the best version known on that day, or null.

    Never uses a version whose known_day is after event_day. Null keys match
    nothing; events without a day get null; repeated events stay repeated; an
    empty side gives nulls or no rows. Change log and snapshots are written to a store
    in the shared folder first; a pipeline keeps one and appends.
    """
    spark = events.sparkSession
    last = events.agg(F.max(period_of(F.col("event_day"), every))).first()[0]
    store = AsKnownStore(spark, scratch(spark, "as-known"), keys, every)
    store.append(versions, last if last is not None else 0)
    return store.lookup(events)


def clean_fundamentals(raw: DataFrame) -> DataFrame:
    """The filed rows that count, last delivery per (source, source_record_id), with the day they became known."""
    cleaned = raw.select(
        upper_key("symbol").alias("symbol"),
        lower_key("metric_name").alias("metric_name"),
        F.col("period_start").cast("date").alias("period_start"),
        F.col("period_end").cast("date").alias("period_end"),
        F.col("filed_at").cast("timestamp").alias("filed_at"),
        F.col("value").cast("double").alias("value"),
        lower_key("source").alias("source"),
        trim_key("source_record_id").alias("source_record_id"),
        F.col("ingested_at").cast("timestamp").alias("ingested_at"),
    ).where(
        F.col("filed_at").isNotNull()
        & (F.col("filed_at") <= F.col("ingested_at"))
        & (F.col("period_start").isNull() | (F.col("period_start") <= F.col("period_end")))
    )
    last = keep_latest(cleaned, ["source", "source_record_id"], ["ingested_at"])
    return last.withColumn("known_day", F.greatest(epoch_day("period_end"), epoch_day("filed_at")))


def fundamentals_as_known(requests: DataFrame, fundamentals: DataFrame, every: int = SNAPSHOT_DAYS) -> DataFrame:
    """request_id, symbol, metric_name, source, trade_date and the known row's columns (null: none was known).

    requests: request_id, symbol, trade_date, metric_name, source; exact copies
    give one row. Of several known rows the one with the latest period_end, then
    filed_at, ingested_at, source_record_id is taken; rows without a period_end
    are never known.
    """
    keys = ["symbol", "metric_name", "source"]
    rows = clean_fundamentals(fundamentals).where(F.col("period_end").isNotNull())
    versions = rows.select(
        *keys,
        "known_day",
        F.struct("period_end", "filed_at", "ingested_at", "source_record_id", "value").alias("version"),
    )
    asked = requests.select(
        "request_id",
        upper_key("symbol").alias("symbol"),
        F.col("trade_date").cast("date").alias("trade_date"),
        lower_key("metric_name").alias("metric_name"),
        lower_key("source").alias("source"),
    ).distinct().withColumn("event_day", epoch_day("trade_date"))
    out = as_known(asked, versions, keys, every)
    return out.select("request_id", *keys, "trade_date", *[F.col(f"known.{c}").alias(c) for c in ("period_end", "filed_at", "ingested_at", "source_record_id", "value")])
