"""Column expressions shared by the operators. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of a frequency and the name they stand for.
FREQUENCIES = {
    "D": "DAILY",
    "W": "WEEKLY",
    "M": "MONTHLY",
    "Q": "QUARTERLY",
    "A": "ANNUAL",
}


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def upper_key(c: str | Column) -> Column:
    return F.upper(F.trim(col(c)))


def lower_key(c: str | Column) -> Column:
    return F.lower(F.trim(col(c)))


def trim_key(c: str | Column) -> Column:
    return F.trim(col(c))


def strip_all(c: str | Column) -> Column:
    """Strip every Unicode white space at both ends (SQL trim strips blanks only)."""
    return F.regexp_replace(col(c), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def frequency_name(c: str | Column) -> Column:
    key = upper_key(c)
    out = key
    for short, full in FREQUENCIES.items():
        out = F.when(key == short, F.lit(full)).otherwise(out)
    return out


def epoch_day(c: str | Column) -> Column:
    return F.unix_date(col(c).cast("date"))


def iso_day(c: str | Column) -> Column:
    return F.date_format(col(c), "yyyy-MM-dd")


def md5_key(*parts: str | Column) -> Column:
    """md5 of the parts joined by a pipe; null if any part is null."""
    joined: list[Column] = []
    for i, p in enumerate(parts):
        joined += ([F.lit("|")] if i else []) + [col(p).cast("string")]
    return F.md5(F.concat(*joined))


def minutes_between(start: str | Column, end: str | Column) -> Column:
    """Minute boundaries crossed from start to end (not whole elapsed minutes)."""
    def minute(c: str | Column) -> Column:
        return F.unix_timestamp(F.date_trunc("minute", col(c).cast("timestamp")))

    return ((minute(end) - minute(start)) / 60).cast("bigint")


def arg_max_nn(value: str | Column, order: str | Column) -> Column:
    """``max_by`` that skips rows whose value is null."""
    return F.max_by(col(value), F.when(col(value).isNotNull(), col(order)))


def arg_min_nn(value: str | Column, order: str | Column) -> Column:
    return F.min_by(col(value), F.when(col(value).isNotNull(), col(order)))


def safe_ratio(a: str | Column, b: str | Column) -> Column:
    return col(a) / F.nullif(col(b), F.lit(0))


def canonical_json(c: str | Column) -> Column:
    """A JSON text with sorted keys and without blanks; null if it can't be read."""
    return F.to_json(F.try_parse_json(col(c)))
