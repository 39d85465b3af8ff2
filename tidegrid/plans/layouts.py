"""Sink formats and partition layouts, written, read and measured side by side."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..sources.storage import HadoopFiles

FORMATS = ("csv", "json", "parquet none", "parquet snappy", "parquet zstd")


def write_format(df: DataFrame, path: str, name: str, partition_by: Sequence[str] = ()) -> None:
    """Write df in one of FORMATS; CSV with header, JSON as lines."""
    kind, _, codec = name.partition(" ")
    if name not in FORMATS:
        raise ValueError(f"unknown format {name!r}; choose from {FORMATS}")
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    if kind == "csv":
        writer.option("header", True).csv(path)
    elif kind == "json":
        writer.option("ignoreNullFields", False).json(path)
    else:
        writer.option("compression", codec).parquet(path)


def read_format(spark: SparkSession, path: str, name: str, schema: StructType) -> DataFrame:
    kind = name.partition(" ")[0]
    reader = spark.read.schema(schema)
    return reader.option("header", True).csv(path) if kind == "csv" else reader.json(path) if kind == "json" else reader.parquet(path)


def _timed(work: Callable[[], object]) -> float:
    began = time.perf_counter()
    work()
    return round((time.perf_counter() - began) * 1000, 3)


def compare(df: DataFrame, root: str, queries: Mapping[str, Callable[[DataFrame], DataFrame]], layouts: Mapping[str, tuple[str, Sequence[str]]]) -> list[dict]:
    """Per layout (format, partition columns): files, bytes, milliseconds of the write and of each query (the better of two)."""
    spark, out = df.sparkSession, []
    files = HadoopFiles(spark, root)
    for label, (name, columns) in layouts.items():
        at = f"{root}/{label}"
        ordered = df.hint("rebalance", *columns) if columns else df.hint("rebalance")
        row = {"layout": label, "write_ms": _timed(lambda: write_format(ordered, at, name, columns))}
        held = [n for p, n, _ in files.list(at, recursive=True) if not p.rsplit("/", 1)[1].startswith(("_", "."))]
        row |= {"files": len(held), "bytes": sum(held)}
        rows = read_format(spark, at, name, df.schema)
        for q, f in queries.items():
            row[f"{q}_ms"] = min(_timed(lambda: f(rows).write.format("noop").mode("overwrite").save()) for _ in range(2))
        out.append(row)
    return out
