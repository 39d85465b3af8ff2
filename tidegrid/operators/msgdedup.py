"""Messages delivered more than once: exactly one copy of each.

Method: a store of kept messages partitioned by event date, with an identifier
index. Incoming messages look up the historical partitions that hold one of their
identifiers; the rows there and the incoming ones are combined, single winners
are computed again, and only those partitions are overwritten, atomically: new
files are written aside and a new version of the manifest makes them current,
unless another writer was first. The index is cut into buckets by hash; a load
reads only the buckets of its identifiers, and buckets written by many loads are
folded.

A message has two identities: its event_id (letter case and outer blanks ignored)
and its (topic, partition, offset). In order of (ingested_at, delivery_id) a
delivery is a repeat if an earlier one that is kept shares either; a repeat
registers nothing. This greedy rule is computed without ordering all rows:

* identifiers are counted as 64-bit hashes (16 bytes a row are shuffled); only
  deliveries with an identifier that occurs twice are candidates, others are kept.
  A hash collision can only add a candidate, and candidates compare whole values.
* candidates fold to the first delivery of each (event_id, coordinates) pair: a
  later one of the pair can't be kept, whatever happens to the first.
* per round, a row that is first in both its groups is kept and everything else
  in those groups is dropped. Groups are folded by aggregation and joined back,
  so a hot identifier never sits in one task as rows.
* what two rounds leave is labelled by connected component (minimum labels with
  pointer jumping, so in about the logarithm of the longest chain of steps) and
  each component is finished in order, all of them in parallel; a component of more
  than COMPONENT_PAIRS pairs goes through rounds again.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.storage import HadoopFiles, Versions, scratch, small_side, stash

#: Rounds before components are labelled, and pairs of a component that one task may take in order (about 40 MB).
ROUNDS, COMPONENT_PAIRS = 2, 200_000
#: Buckets of the identifier index, and loads a bucket may be spread over before it is folded.
INDEX_BUCKETS, INDEX_LOADS = 64, 8
NODE = ["delivery_id", "event_id", "topic", "part", "pos", "arrived", "event_date"]


def nodes(messages: DataFrame) -> DataFrame:
    """The identities of each delivery, and ``message``, the delivery itself with all its columns.

    Null event_ids, and coordinates with a null part, are no identity; a delivery
    with neither is always kept. A null ingested_at orders first.
    """
    return messages.select(
        F.col("delivery_id").cast("bigint").alias("delivery_id"),
        F.lower(F.trim("event_id")).alias("event_id"),
        F.col("source_topic").alias("topic"),
        F.col("kafka_partition").cast("int").alias("part"),
        F.col("kafka_offset").cast("bigint").alias("pos"),
        F.coalesce(F.col("ingested_at").cast("timestamp"), F.timestamp_seconds(F.lit(0))).alias("arrived"),
        F.coalesce(F.to_date("event_timestamp"), F.lit("1970-01-01").cast("date")).alias("event_date"),
        F.struct(*[F.col(f"`{c}`") for c in messages.columns]).alias("message"),
    )


def identifiers(rows: DataFrame, *more: str | Column) -> DataFrame:
    """h and further columns of rows of ``nodes``: one row per identity of each."""
    return _identifiers(_hashes(rows), *more)


def _hashes(df: DataFrame) -> DataFrame:
    has_place = F.col("topic").isNotNull() & F.col("part").isNotNull() & F.col("pos").isNotNull()
    return df.withColumn("h_id", F.when(F.col("event_id").isNotNull(), F.xxhash64(F.lit("e"), "event_id"))).withColumn(
        "h_at", F.when(has_place, F.xxhash64(F.lit("c"), "topic", "part", "pos"))
    )


def _identifiers(hashed: DataFrame, *more: str | Column) -> DataFrame:
    return hashed.select(F.explode(F.array("h_id", "h_at")).alias("h"), *more).where("h is not null")


def _with_identifier(hashed: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows one of whose identifiers is in ``wanted`` (h)."""
    side = small_side(wanted)
    one = side.select(F.col("h").alias("h_id"), F.lit(True).alias("_i"))
    two = side.select(F.col("h").alias("h_at"), F.lit(True).alias("_a"))
    return hashed.join(one, "h_id", "left").join(two, "h_at", "left").where("_i or _a").drop("_i", "_a")


def _in_order(pairs: DataFrame) -> DataFrame:
    """The greedy rule within each component (label, e, c, arrived, delivery_id): components stream through tasks, one after the other."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, ids, places = None, set(), set()
        for pdf in batches:
            kept = []
            for label, e, c, delivery in zip(pdf["label"], pdf["e"], pdf["c"], pdf["delivery_id"]):
                if label != current:
                    current, ids, places = label, set(), set()
                if e not in ids and c not in places:
                    ids.add(e)
                    places.add(c)
                    kept.append(delivery)
            yield pd.DataFrame({"delivery_id": pd.Series(kept, dtype="int64")})

    ordered = pairs.repartition("label").sortWithinPartitions("label", "arrived", "delivery_id")
    return ordered.mapInPandas(run, "delivery_id bigint")


def _round(undecided: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round over pairs (e, c, o): (delivery_id kept, pairs still undecided)."""
    by_e = undecided.groupBy("e").agg(F.min("o").alias("me"))
    by_c = undecided.groupBy("c").agg(F.min("o").alias("mc"))
    judged = stash(undecided.join(by_e, "e").join(by_c, "c").select("e", "c", "o", ((F.col("o") == F.col("me")) & (F.col("o") == F.col("mc"))).alias("keep")), "dedup-round")
    now = judged.where("keep")
    left = judged.where("not keep").join(now.select("e"), "e", "left_anti").join(now.select("c"), "c", "left_anti").select("e", "c", "o")
    return now.select("o.delivery_id"), stash(left, "dedup-left")


def components(pairs: DataFrame) -> DataFrame:
    """Adds ``label``, the least delivery_id of the pair's connected component. Pairs (e, c, o) are connected by an equal e or c."""
    labelled = pairs.withColumn("label", F.col("o.delivery_id"))
    while True:
        by_e = labelled.groupBy("e").agg(F.min("label").alias("le"))
        by_c = labelled.groupBy("c").agg(F.min("label").alias("lc"))
        near = stash(labelled.join(by_e, "e").join(by_c, "c").select("e", "c", "o", "label", F.least("le", "lc").alias("near")), "dedup-near")
        root = near.select(F.col("o.delivery_id").alias("near"), F.col("near").alias("root"))
        moved = stash(near.join(root, "near").select("e", "c", "o", F.col("label").alias("before"), F.least("near", "root").alias("label")), "dedup-labels")
        labelled = moved.drop("before")
        if not moved.where("label <> before").limit(1).count():
            return labelled


def greedy_kept(candidates: DataFrame) -> DataFrame:
    """delivery_id of the candidates the rule keeps. candidates: NODE columns, each with an identity."""
    place = F.concat_ws("|", "topic", F.col("part").cast("string"), F.col("pos").cast("string"))
    has_place = F.col("topic").isNotNull() & F.col("part").isNotNull() & F.col("pos").isNotNull()
    alone = F.concat(F.lit("\u0000"), F.col("delivery_id").cast("string"))
    pairs = (
        candidates.select("delivery_id", "arrived", F.coalesce("event_id", alone).alias("e"), F.coalesce(F.when(has_place, place), alone).alias("c"))
        .groupBy("e", "c")
        .agg(F.min(F.struct("arrived", "delivery_id")).alias("o"))
    )
    undecided, kept = stash(pairs, "dedup-pairs"), []
    while undecided.limit(1).count():
        for _ in range(ROUNDS):
            now, undecided = _round(undecided)
            kept.append(now)
        if not undecided.limit(1).count():
            break
        labelled = components(undecided)
        large = stash(labelled.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") > COMPONENT_PAIRS).select("label"), "dedup-large")
        kept.append(_in_order(labelled.join(large, "label", "left_anti").select("label", "e", "c", "o.arrived", "o.delivery_id")))
        undecided = stash(labelled.join(large, "label", "left_semi").select("e", "c", "o"), "dedup-left")
    return reduce(DataFrame.unionByName, kept) if kept else candidates.select("delivery_id").limit(0)


def repeats(df: DataFrame) -> DataFrame:
    """NODE rows of df that the rule drops. An empty table gives none."""
    hashed = _hashes(df)
    twice = stash(_identifiers(hashed).groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "dedup-ids")
    candidates = stash(_with_identifier(hashed, twice).select(*NODE), "dedup-candidates")
    return candidates.join(greedy_kept(candidates), "delivery_id", "left_anti")


@dataclass(frozen=True)
class MergeResult:
    repeats: DataFrame
    duplicate_events: int
    accepted_events: int
    partitions_overwritten: int
    partitions_appended: int


class IdentifierIndex:
    """(identifier hash, place) rows in buckets by hash: ``root``/m=<load>/b=<bucket>. The state, bucket -> loads, is kept by the owner."""

    SCHEMA = "h bigint, place string, b int"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    @staticmethod
    def bucket() -> Column:
        return F.pmod("h", F.lit(INDEX_BUCKETS)).cast("int")

    def _read(self, state: dict[str, list], buckets: list[str]) -> DataFrame | None:
        paths = [f"{self.root}/m={m}/b={b}" for b in buckets for m in state.get(b, [])]
        return self.spark.read.option("basePath", self.root).schema(f"{self.SCHEMA}, m string").parquet(*paths).select("h", "place") if paths else None

    def find(self, state: dict[str, list], ids: DataFrame) -> DataFrame | None:
        """(h, place) of the wanted identifiers (h, distinct); only their buckets are read. None: none of them is held."""
        buckets = sorted(str(r.b) for r in ids.select(self.bucket().alias("b")).distinct().collect())  # INDEX_BUCKETS at most
        held = self._read(state, buckets)
        return None if held is None else stash(held.join(ids, "h", "left_semi").distinct(), "dedup-hits")

    def extend(self, state: dict[str, list], number: str, rows: DataFrame, files: HadoopFiles) -> dict[str, list]:
        """The state with the rows (h, place) written as load ``number``; buckets that INDEX_LOADS loads wrote are folded into it."""
        full = sorted(b for b, ms in state.items() if len(ms) >= INDEX_LOADS)
        old = self._read(state, full)
        rows = rows.select("h", "place")
        whole = (rows if old is None else rows.unionByName(old)).distinct().withColumn("b", self.bucket())
        at = f"{self.root}/m={number}"
        whole.hint("rebalance", "b").write.mode("overwrite").partitionBy("b").option("compression", "zstd").parquet(at)
        written = [d.rsplit("=", 1)[1] for d in files.directories(at) if "/b=" in d]
        out = {b: ms for b, ms in state.items() if b not in full}
        for b in written:
            out[b] = [*out.get(b, []), number]
        return out


class MessageStore:
    """Kept messages under ``root``: data/m=<merge>/event_date=…, index/m=<merge>/b=<bucket>, versions of one manifest.

    The manifest names, for each event date, the merges whose files hold it, and
    for each bucket of the index the merges that wrote it. A reader sees the old or
    the new version; of two writers at once the second gets ConcurrentWriteError.
    Folders that the last ``keep`` versions don't name are deleted.
    """

    def __init__(self, spark: SparkSession, root: str, keep: int = 2):
        self.spark, self.root, self.files, self.keep = spark, root.rstrip("/"), HadoopFiles(spark, root), keep
        self.versions = Versions(self.files, f"{self.root}/manifest", keep)
        self.index = IdentifierIndex(spark, f"{self.root}/index")

    def manifest(self) -> dict:
        return self.versions.read()[1] or {"dates": {}, "index": {}, "schema": None, "unused": []}

    def _data(self, dates: dict[str, list[str]], schema: str) -> DataFrame | None:
        paths = [f"{self.root}/data/{m}/event_date={d}" for d, ms in dates.items() for m in ms]
        if not paths:
            return None
        return self.spark.read.option("basePath", f"{self.root}/data").schema(f"{schema}, m string, event_date date").parquet(*paths).drop("m")

    def kept(self) -> DataFrame:
        """The kept messages with all their columns; before the first merge a table without rows or columns."""
        held = self.manifest()
        if held["schema"] is None:
            return self.spark.range(0).select()
        rows = self._data(held["dates"], held["schema"])
        return self.spark.createDataFrame([], held["schema"]).select("message.*") if rows is None else rows.select("message.*")

    def merge(self, incoming: DataFrame) -> MergeResult:
        """Fold incoming rows of ``nodes`` into the store; ``repeats`` are the deliveries the rule drops.

        With arrivals in order, history is never dethroned; if an incoming row is
        earlier than a kept one of the same identity, the kept one goes. Later loads
        must have the columns of the first.
        """
        version, old = self.versions.read()
        old = old or {"dates": {}, "index": {}, "schema": None, "unused": []}
        schema = StructType([f for f in incoming.schema.fields if f.name != "event_date"]).toDDL()
        if old["schema"] not in (None, schema):
            raise ValueError("the columns differ from those of the loads before")
        number = f"{version + 1:06d}-{uuid.uuid4().hex[:8]}"  # a writer that comes too late leaves other folders alone
        narrow = incoming.select(*NODE)
        ids = stash(_identifiers(_hashes(narrow)).distinct(), "dedup-incoming")
        hits = self.index.find(old["index"], ids) if old["index"] else None
        touched = {} if hits is None else {d: old["dates"][d] for d in sorted(r.place for r in hits.select("place").distinct().collect()) if d in old["dates"]}  # calendar days
        history = self._data(touched, schema)
        before = None if history is None else _with_identifier(_hashes(history.select(*NODE)), stash(hits.select("h").distinct(), "dedup-hit-ids")).select(*NODE)
        dropped = stash(repeats(narrow if before is None else before.unionByName(narrow)), "dedup-repeats")
        out_ids = small_side(dropped.select("delivery_id"))
        new_rows = incoming.join(out_ids, "delivery_id", "left_anti")
        written = f"{self.root}/data/m={number}"
        # a hot date is split over files, small ones share a task; history lies in files by date already and is rewritten where it is read
        new_rows.hint("rebalance", "event_date").write.partitionBy("event_date").option("compression", "zstd").parquet(written)
        if history is not None:
            history.join(out_ids, "delivery_id", "left_anti").select(*new_rows.columns).write.mode("append").partitionBy("event_date").option("compression", "zstd").parquet(written)
        added = _identifiers(_hashes(new_rows.select(*NODE)), F.col("event_date").cast("string").alias("place"))
        index = self.index.extend(old["index"], number, added, self.files)
        now = {d.rsplit("=", 1)[1] for d in self.files.directories(written)}
        dates = {d: ms for d, ms in old["dates"].items() if d not in touched}
        for d in now:
            dates[d] = [*dates.get(d, []), f"m={number}"]
        freed = [f"{m}/event_date={d}" for d, ms in touched.items() for m in ms]
        kept_back = [[version + 1, freed], *old["unused"]] if freed else old["unused"]
        done = [x for x in kept_back if x[0] <= version + 2 - self.keep]
        gone, all_rows = dropped.count(), narrow.count()
        self.versions.replace(version, {"dates": dates, "index": index, "schema": schema, "unused": [x for x in kept_back if x not in done]})
        for _, folders in done:
            for f in folders:
                self.files.delete(f"{self.root}/data/{f}")
        return MergeResult(dropped, gone, all_rows - gone, len(touched), len(now - set(touched)))


def dedup_in_batches(messages: DataFrame, loads: int = 2, root: str | None = None) -> tuple[MessageStore, list[MergeResult]]:
    """Fold a whole table into a store as ``loads`` consecutive loads, cut between batches by time of receipt."""
    spark = messages.sparkSession
    all_rows = nodes(messages)
    store = MessageStore(spark, root or scratch(spark, "message-store"), keep=2 if root else 1)
    cuts = all_rows.agg(F.percentile_approx(F.unix_micros("arrived"), [(i + 1) / loads for i in range(loads - 1)], 1000)).first()[0] if loads > 1 else []
    done, low = [], None
    for high in [*(cuts or []), None]:
        part = all_rows
        if low is not None:
            part = part.where(F.unix_micros("arrived") > low)
        if high is not None:
            part = part.where(F.unix_micros("arrived") <= high)
        done.append(store.merge(part))
        low = high if high is not None else low
    return store, done
