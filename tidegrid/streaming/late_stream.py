"""Late-aware window aggregates as a Structured Streaming query.

Each micro-batch is judged against the watermark of the batches before it. Rows
within the allowed lateness change the keyed state and the aggregates of their
windows are upserted; later ones are diverted. Spark's own watermark isn't used on
this path, as it drops late rows silently. State and aggregates are kept per window;
a batch reads and replaces those of its own windows only, and an atomic manifest
makes both current at once.
"""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.latest import keep_latest
from ..sources.storage import HadoopFiles

ROW = "symbol string, event_date date, source string, close double, volume double, arrival timestamp"
AGGREGATE = "source string, records bigint, late_arriving_rows bigint, close_sum double, volume_sum double, version int"
KEYS = ["symbol", "event_date", "source"]


class LateWindows:
    """Keyed state, current aggregates and diverted rows under ``root``."""

    def __init__(self, spark: SparkSession, root: str, lateness_days: int = 30, window: str = "month"):
        self.spark, self.root, self.lateness, self.window = spark, root.rstrip("/"), lateness_days, window
        self.files = HadoopFiles(spark, root)

    def manifest(self) -> dict:
        at = f"{self.root}/CURRENT.json"
        return json.loads(self.files.read_text(at)) if self.files.exists(at) else {"batch": -1, "watermark": None, "windows": {}}

    def _kept(self, kind: str, windows: dict[str, int], schema: str) -> DataFrame:
        paths = [f"{self.root}/{kind}/b={b}/window_start={w}" for w, b in windows.items()]
        if not paths:
            return self.spark.createDataFrame([], f"{schema}, window_start date")
        # one read over all batches: the partition columns b and window_start come from the paths
        return self.spark.read.option("basePath", f"{self.root}/{kind}").schema(f"{schema}, b int, window_start date").parquet(*paths).drop("b")

    def _state(self, windows: dict[str, int]) -> DataFrame:
        return self._kept("state", windows, f"{ROW}, is_late boolean")

    def take_batch(self, rows: DataFrame, batch: int) -> None:
        """A batch that was already taken is skipped, so a repeated one changes nothing."""
        held = self.manifest()
        if batch <= held["batch"]:
            return
        mark = F.lit(held["watermark"]).cast("date")
        usable = rows.where("symbol is not null and event_date is not null").withColumn("window_start", F.to_date(F.date_trunc(self.window, "event_date")))
        too_late = F.coalesce(F.col("event_date") < F.date_sub(mark, self.lateness), F.lit(False))
        usable.where(too_late).withColumn("watermark", mark).write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/diverted/b={batch}")
        kept = keep_latest(usable.where(~too_late), KEYS, ["arrival"]).withColumn("is_late", F.coalesce(F.col("event_date") <= mark, F.lit(False)))
        touched = [str(r[0]) for r in kept.select("window_start").distinct().collect()]  # windows of the batch: calendar periods
        before = {w: b for w, b in held["windows"].items() if w in touched}
        old = self._state(before)
        columns = [*KEYS, "close", "volume", "arrival", "window_start", "is_late"]
        merged = old.select(*columns, F.lit(0).alias("_new")).unionByName(kept.select(*columns, F.lit(1).alias("_new")))
        best = keep_latest(merged, [*KEYS, "window_start"], ["arrival", "_new"], [*KEYS, "window_start", "close", "volume", "arrival"])
        first = merged.groupBy(*KEYS).agg(F.min_by("is_late", F.struct("_new", "arrival")).alias("is_late"))
        same = F.lit(True)
        for k in KEYS:
            same = same & F.col(f"b.{k}").eqNullSafe(F.col(f"f.{k}"))
        after = best.alias("b").join(first.alias("f"), same).select("b.*", "f.is_late")
        after.repartition("window_start").write.mode("overwrite").partitionBy("window_start").option("compression", "zstd").parquet(f"{self.root}/state/b={batch}")
        state = self._state({w: batch for w in touched})
        totals = state.groupBy("source", "window_start").agg(F.count("*").alias("records"), F.count_if("is_late").alias("late_arriving_rows"), F.sum("close").alias("close_sum"), F.sum("volume").alias("volume_sum"))
        totals.withColumn("version", F.lit(batch)).write.mode("overwrite").partitionBy("window_start").option("compression", "zstd").parquet(f"{self.root}/aggregates/b={batch}")
        last = usable.agg(F.max("event_date")).first()[0]
        days = [dt.date.fromisoformat(d) for d in (held["watermark"], last.isoformat() if last else None) if d]
        self.files.publish_json(f"{self.root}/CURRENT.json", {"batch": batch, "watermark": max(days).isoformat() if days else None, "windows": {**held["windows"], **{w: batch for w in touched}}})

    def aggregates(self) -> DataFrame:
        """The aggregates in force, one row per source and window; ``version`` is the batch that upserted them last."""
        return self._kept("aggregates", self.manifest()["windows"], AGGREGATE)

    def diverted(self) -> DataFrame:
        folders = self.files.directories(f"{self.root}/diverted")
        schema = f"{ROW}, window_start date, watermark date"
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def run(self, stream: DataFrame, checkpoint: str) -> None:
        """Drain a stream of ROW and stop."""
        query = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, n: self.take_batch(df, n)).start()
        query.awaitTermination()
