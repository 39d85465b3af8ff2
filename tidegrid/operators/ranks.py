"""Ranks over whole tables without one task that sees them all: global row numbers and exact nearest-rank percentiles."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import small_side, stash

#: Ranges a group's values are cut into before one of them is ranked.
RANGES = 200


def global_row_number(df: DataFrame, order: Sequence[Column | str], name: str = "row_number") -> DataFrame:
    """df with ``row_number() over (order by …)``: 1, 2, … in the given order.

    Rows are range-partitioned and sorted once; each partition numbers its own rows
    and adds the count of those before it (one number per partition). Nulls come
    first; rows equal in the order are numbered in any order; an empty table stays so.
    """
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    numbered = stash(ordered.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "numbered")
    counts = numbered.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))  # one row a partition
    return numbered.join(small_side(stash(offsets, "offsets")), "_part").withColumn(name, F.col("_offset") + F.col("_at") + 1).drop("_part", "_at", "_offset")


def nearest_rank(df: DataFrame, group: str, value: str, share: float, name: str = "value") -> DataFrame:
    """group, name: the exact nearest-rank percentile of the group's values (the value at rank ceil(share * n)); nulls don't count.

    A group's values are cut into RANGES by approximate quantiles, ranges are counted
    with map-side combine, and only the values of the one range that holds the rank
    are ranked, equal ones folded. No task sees a group's distinct values. A null
    group is a group; NaN is the greatest value; groups without values give no row.
    """
    rows = df.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).where("v is not null")
    cuts = [i / RANGES for i in range(1, RANGES)]
    edges = stash(rows.groupBy("g").agg(F.percentile_approx("v", cuts, 20 * RANGES).alias("edges"), F.count("*").alias("n")).withColumn("rank", F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(share) - F.lit(1e-9)))), "edges")
    placed = rows.alias("r").join(small_side(edges).alias("e"), F.col("r.g").eqNullSafe(F.col("e.g"))).select("r.g", "v", "rank", F.aggregate("edges", F.lit(0), lambda a, x: a + F.when(x < F.col("v"), 1).otherwise(0)).alias("range"))
    folded = stash(placed.groupBy("g", "range").agg(F.count("*").alias("c"), F.max("rank").alias("rank")), "ranges")
    before = F.sum("c").over(Window.partitionBy("g").orderBy("range"))  # RANGES rows a group at most
    aim = folded.withColumn("upto", before).where("upto >= rank").groupBy("g").agg(F.min(F.struct("range", (F.col("upto") - F.col("c")).alias("before"), "rank")).alias("a")).select("g", "a.*")
    aim = stash(aim, "aims")
    inside = placed.alias("p").join(small_side(aim).alias("a"), F.col("p.g").eqNullSafe(F.col("a.g")) & (F.col("p.range") == F.col("a.range"))).groupBy("p.g", "v").agg(F.count("*").alias("c"), F.max("a.rank").alias("rank"), F.max("a.before").alias("before"))
    upto = F.sum("c").over(Window.partitionBy("g").orderBy("v"))
    return inside.withColumn("upto", F.col("before") + upto).where("upto >= rank").groupBy("g").agg(F.min("v").alias(name)).withColumnRenamed("g", group)


def rank_of(share: float, n: int) -> int:
    """The nearest rank of a share among n values."""
    return max(1, math.ceil(share * n - 1e-9))
