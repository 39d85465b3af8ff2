"""Late and out-of-order events: per-period aggregates corrected as records arrive.

Method: event-time windows with a watermark and an allowed lateness. Each delivery
is judged, before anything is folded, against the watermark that held when its run
arrived: on time, late (kept and counted) or beyond the cut-off (diverted, as it
is, for reporting). The keyed state per record key is its first delivery's verdict
and the value in force after each arrival day; a change emits the difference it
makes, the differences per window and arrival day are folded, and their running
sums are the upserts a downstream table receives, the last one per window being
current.

``streaming.late_stream`` runs the same steps as a Structured Streaming query.

Scale: runs are few beside deliveries, so Catalyst broadcasts their watermarks while
they are small and AQE splits a hot run otherwise. Judged deliveries of one key and
arrival day then fold to one row with map-side combine, so a key's history and a
window's history have at most one row per arrival day.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import lower_key, trim_key, upper_key
from .latest import keep_latest

KEYS = ["symbol", "event_date", "source"]
LATENESS_DAYS = 30


@dataclass(frozen=True)
class LateReplay:
    """first: one row per key with its first arrival and that delivery's verdict. dropped: every delivery beyond the cut-off.
    updates: upserts per window and arrival day. current: the last upsert per window."""

    first: DataFrame
    dropped: DataFrame
    updates: DataFrame
    current: DataFrame


def watermarks(runs: DataFrame) -> DataFrame:
    """arrival, watermark: one row per arrival (a manifest written twice counts once)."""
    return (
        runs.select(F.col("arrival_time").cast("timestamp").alias("arrival"), F.col("prior_event_watermark").cast("date").alias("watermark"))
        .where("arrival is not null")
        .groupBy("arrival")
        .agg(F.max("watermark").alias("watermark"))
    )


def judged(df: DataFrame, lateness_days: int = LATENESS_DAYS) -> DataFrame:
    """Adds ``timing``: on_time, late or too_late, from event_date and watermark (null: on time)."""
    return df.withColumn(
        "timing",
        F.when(F.col("watermark").isNull() | (F.col("event_date") > F.col("watermark")), "on_time")
        .when(F.col("event_date") >= F.date_sub("watermark", lateness_days), "late")
        .otherwise("too_late"),
    )


def deliveries(prices: DataFrame, runs: DataFrame, lateness_days: int = LATENESS_DAYS) -> DataFrame:
    """Every delivery that has a key and an arrival, judged against its own run's watermark.

    Rows without a symbol or date have no key; a null source is a source; an
    arrival without a run, or a run without a watermark, is on time.
    """
    cleaned = prices.select(
        upper_key("symbol").alias("symbol"),
        F.col("date").cast("date").alias("event_date"),
        lower_key("source").alias("source"),
        F.col("close").cast("double").alias("close"),
        F.col("volume").cast("double").alias("volume"),
        trim_key("source_record_id").alias("source_record_id"),
        F.col("ingested_at").cast("timestamp").alias("arrival"),
    ).where("symbol is not null and event_date is not null and arrival is not null")
    return judged(cleaned.join(watermarks(runs), "arrival", "left"), lateness_days)


def keyed_state(timed: DataFrame) -> DataFrame:
    """The state of each key after each of its arrival days.

    first_arrival and first_timing are those of the key's first delivery of all;
    kept: whether the day brought one within the cut-off; close and volume: the last
    of these; was: the value in force before the day (null: none).
    """
    kept = F.col("timing") != "too_late"
    held = F.struct("arrival", "source_record_id", "close", "volume")
    days = (
        timed.withColumn("arrival_date", F.to_date("arrival"))
        .groupBy(*KEYS, "arrival_date")
        .agg(F.min(F.struct("arrival", "timing")).alias("_first"), F.max(F.when(kept, held)).alias("_last"))
    )
    order = Window.partitionBy(*KEYS).orderBy("arrival_date")
    value = F.when(F.col("_last").isNotNull(), F.struct("_last.close", "_last.volume"))
    return days.select(
        *KEYS,
        "arrival_date",
        (F.row_number().over(order) == 1).alias("is_entry"),
        F.first("_first").over(order).alias("_entry"),
        F.col("_last").isNotNull().alias("kept"),
        F.col("_last.close").alias("close"),
        F.col("_last.volume").alias("volume"),
        F.last(value, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("was"),
    ).select("*", F.col("_entry.arrival").alias("first_arrival"), F.col("_entry.timing").alias("first_timing")).drop("_entry")


def replay(prices: DataFrame, runs: DataFrame, lateness_days: int = LATENESS_DAYS, window: str = "month") -> LateReplay:
    """Replay all deliveries in order of arrival.

    A later delivery of a key revises it, unless it is too late itself.
    late_arriving_rows counts the records whose first delivery was late, so over all
    windows it equals the late rows of ``first``; revised_rows counts keys and arrival
    days. Null closes and volumes count as 0 in sums. window: a unit ``date_trunc``
    knows. Empty tables give empty results; other columns are ignored.
    """
    timed = deliveries(prices, runs, lateness_days)
    state = keyed_state(timed)
    zero = F.lit(0.0)
    new = F.col("was").isNull()
    changes = (
        state.where("kept")
        .groupBy("source", F.to_date(F.date_trunc(window, "event_date")).alias("window_start"), "arrival_date")
        .agg(
            F.count_if(new).alias("d_records"),
            F.count_if(new & (F.col("first_timing") == "late")).alias("d_late"),
            F.count_if(~new).alias("d_revised"),
            F.sum(F.coalesce("close", zero) - F.coalesce("was.close", zero)).alias("d_close"),
            F.sum(F.coalesce("volume", zero) - F.coalesce("was.volume", zero)).alias("d_volume"),
        )
    )
    by_window = Window.partitionBy("source", "window_start").orderBy("arrival_date")
    running = by_window.rowsBetween(Window.unboundedPreceding, 0)
    updates = changes.select(
        "source",
        "window_start",
        "arrival_date",
        F.row_number().over(by_window).alias("version"),
        F.sum("d_records").over(running).alias("records"),
        F.sum("d_late").over(running).alias("late_arriving_rows"),
        F.sum("d_revised").over(running).alias("revised_rows"),
        F.sum("d_close").over(running).alias("close_sum"),
        F.sum("d_volume").over(running).alias("volume_sum"),
    )
    current = keep_latest(updates, ["source", "window_start"], ["version"])
    first = state.where("is_entry").select(*KEYS, F.col("first_arrival").alias("arrival"), F.col("first_timing").alias("timing"))
    return LateReplay(first, timed.where("timing = 'too_late'"), updates, current)
