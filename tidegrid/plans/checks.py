"""Data checks. Each returns the failing rows, so a check holds if its DataFrame is empty."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def unique(df: DataFrame, column: str) -> DataFrame:
    return unique_combination(df.where(F.col(column).isNotNull()), [column])


def unique_combination(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("copies")).where("copies > 1")


def accepted_values(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(*values))


def relationships(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose key has no parent; null keys pass."""
    known = parent.select(F.col(parent_key).alias("_key")).distinct()
    return child.where(F.col(key).isNotNull()).join(known, F.col(key) == F.col("_key"), "left_anti")


def expression_is_true(df: DataFrame, condition: str | Column) -> DataFrame:
    """Rows for which the condition is false; null passes."""
    c = F.expr(condition) if isinstance(condition, str) else condition
    return df.where(~c)


def no_lookahead(aligned: DataFrame) -> DataFrame:
    return aligned.where("available_date > trade_date")


def counts_reconcile(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row with both counts if they differ."""
    return a.agg(F.count("*").alias("left_rows")).join(F.broadcast(b.agg(F.count("*").alias("right_rows")))).where("left_rows <> right_rows")


def every_dataset(health: DataFrame, names: Sequence[str]) -> DataFrame:
    wanted = health.sparkSession.createDataFrame([(n,) for n in names], "dataset string")
    return wanted.join(health, "dataset", "left_anti")


def prices_resolve(snapshot: DataFrame, prices: DataFrame) -> DataFrame:
    return snapshot.join(prices.select("symbol", "source").distinct(), ["symbol", "source"], "left_anti")


def stale(df: DataFrame, loaded_at: str, now: Column, warn_hours: float, error_hours: float) -> DataFrame:
    """One row: the last load and pass, warn or error by its age. An empty table is an error."""
    age = (F.unix_timestamp(now) - F.unix_timestamp(F.max(loaded_at))) / 3600
    return df.agg(F.max(loaded_at).alias("last_loaded"), F.when(F.max(loaded_at).isNull() | (age > error_hours), "error").when(age > warn_hours, "warn").otherwise("pass").alias("freshness"))
