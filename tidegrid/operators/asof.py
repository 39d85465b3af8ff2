"""As-of and interval joins as compositions of DataFrame operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


def _bucket(time: Column, days: int) -> Column:
    return F.floor(F.unix_date(time.cast("date")) / F.lit(days))


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    left_time: str,
    right_time: str,
    strict: bool = False,
    tie_break: Sequence[str | Column] = (),
    prefix: str = "",
    bucket_days: int = 32,
    distinct: bool = False,
) -> DataFrame:
    """Left join to the last right row of the same keys at or (strict) before the left row's time.

    The left side is folded to its distinct keys and times, these are looked up, and
    the whole left rows join the result by equality, so that only keys and times are
    sorted and repeated ones of a hot key count once. ``distinct``: the left side
    holds nothing but distinct keys and times, so it is the lookup itself.

    Time is cut into buckets of bucket_days. The last right row per key and bucket
    is folded and carried over the buckets (one row per key and bucket), so each
    bucket knows what came before it; inside a bucket both sides are one relation
    ordered by time and the right row is carried forward as one struct, so that a
    null field of the matched row isn't skipped. A window thus holds one key's rows
    of one bucket, however many the key has; there is no range join.

    Several right rows of one time: the last by tie_break (nulls first), then by
    value. Null keys and null times match nothing. Columns out: the left's, then
    the right's others (with prefix), which must not clash.
    """
    on = list(on)
    carried = [c for c in right.columns if c not in on]
    known = F.lit(True)
    for k in on:
        known = known & F.col(k).isNotNull()
    packed = (
        right.where(known & F.col(right_time).isNotNull())
        .select(*on, F.col(right_time).alias("_time"), F.struct(*[F.col(c).alias(c) for c in carried]).alias("_right"), F.struct(F.lit(0).alias("t"), *[(F.col(c) if isinstance(c, str) else c).alias(f"b{i}") for i, c in enumerate(tie_break)]).alias("_tie"))
        .groupBy(*on, "_time")
        .agg(F.max(F.struct("_tie", "_right")).alias("_best"))
        .select(*on, "_time", F.col("_best._right").alias("_right"))
        .withColumn("_bucket", _bucket(F.col("_time"), bucket_days))
    )
    kind = packed.schema["_right"].dataType
    asked = left.select(*on, F.col(left_time).alias("_time")).where(known & F.col("_time").isNotNull())
    asked = (asked if distinct else asked.distinct()).withColumn("_bucket", _bucket(F.col("_time"), bucket_days))
    time_kind = asked.schema["_time"].dataType
    ends = packed.groupBy(*on, "_bucket").agg(F.max_by("_right", "_time").alias("_end"))
    places = ends.unionByName(asked.select(*on, "_bucket").distinct().withColumn("_end", F.lit(None).cast(kind))).groupBy(*on, "_bucket").agg(F.max_by("_end", F.when(F.col("_end").isNotNull(), 1)).alias("_end"))
    over = Window.partitionBy(*on).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = places.select(*on, "_bucket", F.last("_end", ignorenulls=True).over(over).alias("_right")).where("_right is not null")
    both = (
        asked.select(*on, "_bucket", "_time", F.lit(None).cast(kind).alias("_right"), F.lit(1 if strict else 2).alias("_ord"), F.lit(True).alias("_asked"))
        .unionByName(packed.select(*on, "_bucket", F.col("_time").cast(time_kind).alias("_time"), "_right", F.lit(2 if strict else 1).alias("_ord"), F.lit(False).alias("_asked")))
        .unionByName(carry.select(*on, "_bucket", F.lit(None).cast(time_kind).alias("_time"), "_right", F.lit(0).alias("_ord"), F.lit(False).alias("_asked")))
    )
    w = Window.partitionBy(*on, "_bucket").orderBy(F.col("_time").asc_nulls_first(), "_ord").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_found", F.last("_right", ignorenulls=True).over(w)).where("_asked").select(*on, "_time", "_found")
    fields = [F.col(f"_found.{c}").alias(f"{prefix}{c}") for c in carried]
    if distinct:
        return found.select(*[F.col("_time").alias(c) if c == left_time else F.col(c) for c in left.columns], *fields)
    matched = found.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(on)], "_time", "_found")
    same = F.col(left_time) == F.col("_time")
    for i, k in enumerate(on):
        same = same & (F.col(k) == F.col(f"_k{i}"))
    return left.join(matched, same, "left").select(*[F.col(f"`{c}`") for c in left.columns], *fields)


def interval_join(left: DataFrame, right: DataFrame, on: Sequence[str], time: str, start: str, end: str, bucket_days: int = 366) -> DataFrame:
    """Inner join to the right rows of the same keys with start <= time < end (null end: open); times are dates, timestamps or numbers.

    Intervals are entered into each bucket of bucket_days they reach into, up to the
    last one the left side has; rows meet by key and bucket, so a hot key's versions
    aren't all tried for each of its rows.
    """
    kept = [F.col(f"r.{c}") for c in right.columns if c not in on]

    def bucket(c: str) -> Column:
        """Days are counted by bucket_days, plain numbers as they are."""
        return F.floor(F.col(c) / F.lit(bucket_days)) if isinstance(left.schema[time].dataType, NumericType) else _bucket(F.col(c), bucket_days)

    last = left.agg(F.max(bucket(time))).first()[0]
    if last is None:
        return left.alias("l").join(right.alias("r").limit(0), F.lit(False)).select("l.*", *kept)
    first, until = bucket(start), F.least(F.coalesce(bucket(end), F.lit(last)), F.lit(last))
    spread = right.where(first <= until).withColumn("_bucket", F.explode(F.sequence(first, until)))
    cond = F.col("l._bucket") == F.col("r._bucket")
    for k in on:
        cond = cond & (F.col(f"l.{k}") == F.col(f"r.{k}"))
    t = F.col(f"l.{time}")
    cond = cond & (t >= F.col(f"r.{start}")) & (F.col(f"r.{end}").isNull() | (t < F.col(f"r.{end}")))
    return left.withColumn("_bucket", bucket(time)).alias("l").join(spread.alias("r"), cond).select(*[F.col(f"l.{c}") for c in left.columns], *kept)
