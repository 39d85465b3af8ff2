"""Queries p8_…, p9_… and p10_… over the whole documents table, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from . import mixing, packing, residue

Query = Callable[[SparkSession, str], DataFrame]


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), table(spark, d, "container_sizes"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.report(p8_packed(spark, d))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mixture_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mixture_targets"))[1]


def p10_judged(spark: SparkSession, d: str) -> DataFrame:
    return residue.judge(table(spark, d, "documents"))


def p10_kept(spark: SparkSession, d: str) -> DataFrame:
    return residue.exclude(table(spark, d, "documents"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_judged(spark, d).where("residue is not null").select("doc_id")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p8_packed, p8_report, p9_mixture, p9_shares, p10_found, p10_judged, p10_kept)}
