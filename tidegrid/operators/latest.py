"""Keep-latest deduplication as one aggregation with map-side combine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_latest(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], keep: Sequence[str] | None = None) -> DataFrame:
    """One row per key: the one with the greatest ``order`` tuple (nulls lowest).

    An aggregation instead of ``row_number() = 1``: repeated rows of a hot key
    are folded on the map side, so no task ever sees the whole group. Ties on
    ``order`` are broken by the kept values, so the result is deterministic.
    Null keys form a group of their own; an empty table gives an empty table.
    """
    rest = [c for c in (keep or df.columns) if c not in keys]
    orders = [F.col(o) if isinstance(o, str) else o for o in order]
    best = F.max(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(orders)], F.struct(*[F.col(c) for c in rest]).alias("v"))).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_best.v.{c}").alias(c) for c in rest])
