"""Queries pN_… of the general operators, with production parameters on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import iso_day
from ..operators import asknown, compaction, latewindow, msgdedup, regrid, spikes, trailing
from ..session import table

FIGURES = ["rolling_20d_return", "rolling_20d_volatility", "average_volume_20d"]
Query = Callable[[SparkSession, str], DataFrame]


def p1_regular(spark: SparkSession, d: str) -> DataFrame:
    return regrid.regrid(table(spark, d, "macro_readings"), table(spark, d, "trading_days"))


def p1_grid(spark: SparkSession, d: str) -> DataFrame:
    """The grid without what the smoother estimates."""
    return p1_regular(spark, d).select("series_id", "source", "frequency", "period_start", "readings", F.round("observed", 6).alias("observed"), "is_missing")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_regular(spark, d).where("is_missing").select("series_id", "source", iso_day("period_start").alias("period_start"))


def p2_compacted(spark: SparkSession, d: str) -> DataFrame:
    return compaction.compact_waiting(table(spark, d, "lake_fragments"))


def p2_files(spark: SparkSession, d: str) -> DataFrame:
    """The waiting fragments as real files, compacted by copying blocks; file and byte counts depend on the encoding, so only their relation is given."""
    out = compaction.compact_small_files(table(spark, d, "lake_fragments"))
    well_sized = (F.col("files_after") < F.col("files_before")) | (F.col("files_before") <= 1 + F.floor(F.col("bytes_before") / compaction.TARGET_BYTES))
    return out.select("dataset", "partition_path", "files_before", "rows_before", "rows_after", "duplicate_rows_removed", well_sized.alias("well_sized"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return compaction.wrong_compactions(table(spark, d, "lake_fragments"), table(spark, d, "compactions"))


def _replay(spark: SparkSession, d: str) -> latewindow.LateReplay:
    return latewindow.replay(table(spark, d, "prices"), table(spark, d, "ingestion_runs"))


def _sums(df: DataFrame) -> DataFrame:
    """Sums rounded, as the last bits of a double depend on the order of addition."""
    return df.withColumns({c: F.round(c, 4) for c in ("close_sum", "volume_sum")})


def p3_updates(spark: SparkSession, d: str) -> DataFrame:
    return _sums(_replay(spark, d).updates)


def p3_current(spark: SparkSession, d: str) -> DataFrame:
    return _sums(_replay(spark, d).current)


def p3_dropped(spark: SparkSession, d: str) -> DataFrame:
    return _replay(spark, d).dropped


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _replay(spark, d).first.where("timing = 'late'").select("symbol", iso_day("event_date").alias("event_date"), "source")


def p4_as_known(spark: SparkSession, d: str) -> DataFrame:
    return asknown.fundamentals_as_known(table(spark, d, "snapshot_requests"), table(spark, d, "fundamentals"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_as_known(spark, d).where("source_record_id is not null").select("request_id", "source_record_id")


def p5_deduplicated(spark: SparkSession, d: str) -> DataFrame:
    store, _ = msgdedup.dedup_in_batches(table(spark, d, "stream_events"))
    return store.kept()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    _, merges = msgdedup.dedup_in_batches(table(spark, d, "stream_events"))
    out = merges[0].repeats
    for m in merges[1:]:
        out = out.unionByName(m.repeats)
    return out.select("delivery_id")


def p6_scored(spark: SparkSession, d: str) -> DataFrame:
    return spikes.score_readings(table(spark, d, "prices"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return spikes.score_readings(table(spark, d, "prices"), only_flagged=True).select("symbol", iso_day("event_date").alias("event_date"), "source", "field")


def _figures(spark: SparkSession, d: str) -> DataFrame:
    return trailing.rolling_bars(table(spark, d, "prices"), table(spark, d, "trading_days"))


def p7_rolling(spark: SparkSession, d: str) -> DataFrame:
    return _figures(spark, d).withColumns({c: F.round(c, 8) for c in ("daily_return", *FIGURES)})


def p7_totals(spark: SparkSession, d: str) -> DataFrame:
    bars = trailing.contract_bars(table(spark, d, "prices"))
    return trailing.trailing_totals(bars, ["symbol", "source"], "trade_date", {"volume": "volume"}, (7, 30))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    wrong = trailing.wrong_figures(table(spark, d, "expected_metrics"), _figures(spark, d), FIGURES)
    return wrong.select("symbol", iso_day("trade_date").alias("trade_date"), "source")


def queries() -> dict[str, Query]:
    return {
        f.__name__: f
        for f in (p1_found, p1_regular, p1_grid, p2_found, p2_compacted, p2_files, p3_found, p3_updates, p3_current, p3_dropped, p4_found, p4_as_known, p5_found, p5_deduplicated, p6_found, p6_scored, p7_found, p7_rolling, p7_totals)
    }
