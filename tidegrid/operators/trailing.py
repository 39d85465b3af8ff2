"""Rolling totals and averages over trailing periods, inactive days included.

Method: sparse daily rows per entity, a calendar row for every inactive day
between the first and the last active one, then range frames over integer day
numbers with fixed denominators.

Scale: the daily totals are folded with map-side combine first; after that an
entity has at most one row per calendar day. The calendar rows are made from the
gap to the entity's next row (``lead`` and ``sequence``) inside the partitioning
the windows need anyway, so no join with a calendar and one exchange serve all
frames.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import epoch_day, lower_key, trim_key, upper_key
from .latest import keep_latest

#: A calendar is a set of dates; more than this is no calendar.
CALENDAR_DAYS = 400_000


def number_days(calendar: DataFrame) -> DataFrame:
    """trade_date, day_no: running number of the calendar's days (a small table by its type)."""
    days = calendar.select(F.col("trade_date").cast("date").alias("trade_date")).where("trade_date is not null").distinct()
    if days.limit(CALENDAR_DAYS + 1).count() > CALENDAR_DAYS:
        raise ValueError("the calendar has more days than a calendar can have")
    return days.withColumn("day_no", F.row_number().over(Window.orderBy("trade_date")).cast("int"))


def fill_calendar(df: DataFrame, entity: Sequence[str], day: str) -> DataFrame:
    """Adds a row for each inactive day between active ones.

    Every column is repeated from the last active row; ``is_active`` tells the
    two apart. df: one row per entity and integer day.
    """
    w = Window.partitionBy(*entity).orderBy(day)
    return (
        df.withColumn("_next", F.coalesce(F.lead(day).over(w), F.col(day) + 1))
        .withColumn("_day", F.explode(F.sequence(F.col(day), F.col("_next") - 1)))
        .withColumn("is_active", F.col("_day") == F.col(day))
        .drop(day, "_next")
        .withColumnRenamed("_day", day)
    )


def trailing_totals(df: DataFrame, entity: Sequence[str], day: str, measures: Mapping[str, str], lengths: Sequence[int]) -> DataFrame:
    """Totals and averages of each measure over the trailing ``lengths`` days, per entity and day.

    df: any number of rows per entity and date column ``day``; measures maps an
    output name to a numeric column. Null measures count as 0, rows without a day
    are left out, null entities form one entity. Averages divide by the length of
    the period, not by the number of active days. Totals before an entity's first
    day are 0, so early periods aren't null.
    """
    daily = (
        df.where(F.col(day).isNotNull())
        .groupBy(*entity, epoch_day(day).alias("_n"))
        .agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(m) for m, c in measures.items()])
    )
    full = fill_calendar(daily, entity, "_n").select(*entity, "_n", "is_active", *[F.when(F.col("is_active"), F.col(m)).otherwise(0).alias(m) for m in measures])
    out = [*[F.col(e) for e in entity], F.date_from_unix_date(F.col("_n").cast("int")).alias(day), F.col("is_active"), *[F.col(m) for m in measures]]
    for n in lengths:
        w = Window.partitionBy(*entity).orderBy("_n").rangeBetween(-(n - 1), 0)
        for m in measures:
            out += [F.sum(m).over(w).alias(f"{m}_total_{n}d"), (F.sum(m).over(w) / n).alias(f"{m}_average_{n}d")]
    return full.select(*out)


def contract_bars(prices: DataFrame) -> DataFrame:
    """Cleaned price bars that keep the price contract, last ingested per symbol, day and source."""
    cleaned = prices.select(
        upper_key("symbol").alias("symbol"),
        F.col("date").cast("date").alias("trade_date"),
        lower_key("source").alias("source"),
        *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close")],
        F.col("volume").cast("bigint").alias("volume"),
        trim_key("source_record_id").alias("source_record_id"),
        F.col("ingested_at").cast("timestamp").alias("ingested_at"),
    ).where(
        F.expr(
            "symbol is not null and trade_date is not null and open > 0 and high > 0 and low > 0 and close > 0 and volume >= 0 "
            "and high >= greatest(low, open, close) and low <= least(open, close)"
        )
    )
    return keep_latest(cleaned, ["symbol", "trade_date", "source"], ["ingested_at", "source_record_id"], ["symbol", "trade_date", "source", "close", "volume"])


def rolling_bars(prices: DataFrame, calendar: DataFrame, length: int = 20) -> DataFrame:
    """Per symbol, source and calendar day from its first to its last bar: return, volatility and average volume.

    A day without a bar has volume 0 and the previous close. A figure is null
    until the series has the days it needs. Bars off the calendar are left out.
    """
    days = F.broadcast(number_days(calendar))  # bounded by CALENDAR_DAYS
    bars = contract_bars(prices).join(days, "trade_date").select("symbol", "source", "day_no", "close", "volume")
    full = fill_calendar(bars, ["symbol", "source"], "day_no")
    w = Window.partitionBy("symbol", "source").orderBy("day_no")
    span = w.rangeBetween(-(length - 1), 0)
    point = w.rangeBetween(-length, -length)
    figures = (
        full.withColumn("volume", F.when(F.col("is_active"), F.col("volume")).otherwise(F.lit(0)))
        .withColumn("daily_return", F.col("close") / F.lag("close").over(w) - 1)
        .withColumn("_n", F.count("daily_return").over(span))
        .withColumn("_days", F.count("*").over(span))
        .select(
            "symbol",
            "source",
            "day_no",
            "is_active",
            "close",
            "volume",
            "daily_return",
            (F.col("close") / F.max("close").over(point) - 1).alias(f"rolling_{length}d_return"),
            F.when(F.col("_n") == length, F.stddev_samp("daily_return").over(span)).alias(f"rolling_{length}d_volatility"),
            F.when(F.col("_days") == length, F.sum("volume").over(span) / length).alias(f"average_volume_{length}d"),
        )
    )
    return figures.join(days, "day_no").drop("day_no")


def wrong_figures(expected: DataFrame, right: DataFrame, columns: Sequence[str], relative: float = 1e-3, absolute: float = 1e-5) -> DataFrame:
    """Distinct symbol, trade_date, source of expected rows of which a figure is null or off.

    Off: different from the right one by more than ``relative`` of it and by more
    than ``absolute``, or given where there is no right one.
    """
    keys = ["symbol", "source", "trade_date"]
    given = expected.select(
        upper_key("symbol").alias("symbol"), lower_key("source").alias("source"), F.col("trade_date").cast("date").alias("trade_date"),
        *[F.col(c).cast("double").alias(f"given_{c}") for c in columns],
    ).distinct()
    joined = given.join(right.select(*keys, *columns), keys, "left")
    off = F.lit(False)
    for c in columns:
        g, r = F.col(f"given_{c}"), F.col(c)
        gap = F.abs(g - r)
        off = off | g.isNull() | F.isnan(g) | r.isNull() | ((gap > relative * F.abs(r)) & (gap > absolute))
    return joined.where(off).select(*keys).distinct()
