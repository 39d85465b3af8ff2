"""Versioned source contracts as Column expressions: every row is accepted or quarantined, in one pass.

A raw row is its JSON payload. Its keys and values are read as a variant, so a
missing key, a null and a wrong type can be told apart, and the payload stays
untouched for quarantine. Errors are an array of messages built stage by stage: a
later stage only speaks where the earlier ones were silent.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.columns import strip_all
from .storage import stash


class MissingRequiredFieldError(ValueError):
    """A column of the contract is absent from the whole batch."""


#: A normalizer gets the value as text and its JSON type and returns (value, message or null).
Normalizer = Callable[[Column, Column], tuple[Column, Column]]

ISO_DATE = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?)?$"
ZONED = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})$"


def _fail(bad: Column, message: str) -> Column:
    return F.when(bad, F.lit(message))


def text(v: Column, kind: Column) -> tuple[Column, Column]:
    clean = strip_all(v)
    return clean, F.when(kind != "STRING", F.lit("expected text")).when(clean == "", F.lit("must not be blank"))


def upper_text(v: Column, kind: Column) -> tuple[Column, Column]:
    clean, error = text(v, kind)
    return F.upper(clean), error


def finite_float(v: Column, kind: Column) -> tuple[Column, Column]:
    n = strip_all(v).try_cast("double")
    bad = n.isNull() | F.isnan(n) | (F.abs(n) == F.lit(float("inf"))) | (kind == "BOOLEAN")
    return n, _fail(F.coalesce(bad, F.lit(True)), "expected a finite number")


def integer(v: Column, kind: Column) -> tuple[Column, Column]:
    trimmed = strip_all(v)
    number = trimmed.try_cast("decimal(38,10)")
    whole = trimmed.rlike(r"^[+-]?\d+$") | ((kind != "STRING") & (number == F.floor(number)))
    n = F.when(whole, number).try_cast("bigint")
    return n, _fail(n.isNull() | (kind == "BOOLEAN"), "expected a whole number")


def iso_date(v: Column, kind: Column) -> tuple[Column, Column]:
    d = F.when(v.rlike(ISO_DATE), F.substring(v, 1, 10).try_cast("date"))
    return d, _fail(d.isNull() | (kind != "STRING"), "expected an ISO date")


def utc_datetime(v: Column, kind: Column) -> tuple[Column, Column]:
    t = F.when(v.rlike(ZONED), v.try_cast("timestamp"))
    return t, F.when(kind != "STRING", F.lit("expected an ISO timestamp")).when(v.rlike(ISO_DATE) & ~v.rlike(ZONED), F.lit("timestamp must carry a time zone")).when(t.isNull(), F.lit("expected an ISO timestamp"))


def url(v: Column, kind: Column) -> tuple[Column, Column]:
    clean, error = text(v, kind)
    web = F.lower(F.try_parse_url(clean, F.lit("PROTOCOL"))).isin("http", "https") & F.try_parse_url(clean, F.lit("HOST")).isNotNull()
    return clean, F.coalesce(error, _fail(~F.coalesce(web, F.lit(False)), "expected an absolute http(s) url"))


@dataclass(frozen=True)
class Field:
    kind: str
    normalizer: Normalizer
    nullable: bool = False


@dataclass(frozen=True)
class Contract:
    """Fields in order, the key that must be unique in a batch and in the lake, aliases, and row rules (condition that must hold, message)."""

    name: str
    fields: Mapping[str, Field]
    key: tuple[str, ...]
    event_time: str
    aliases: Mapping[str, str] = field(default_factory=dict)
    rules: tuple[tuple[str, str], ...] = ()
    version: int = 1

    @property
    def columns(self) -> list[str]:
        return list(self.fields)

    @property
    def values(self) -> list[str]:
        """Columns whose difference between two rows of a key is a conflict."""
        return [c for c in self.fields if c not in self.key and c not in ("ingested_at", "source_record_id")]

    def ddl(self) -> str:
        return ", ".join(f"`{n}` {f.kind}" for n, f in self.fields.items())


def _get(payload: Column, name: str) -> Column:
    return F.try_variant_get(payload, f"$['{name}']", "variant")


def validate(contract: Contract, payloads: DataFrame, source: str) -> DataFrame:
    """payloads: payload string (one JSON object), position bigint. Adds the contract's columns and ``errors`` (empty: accepted).

    Raises MissingRequiredFieldError if a column is absent from every row. A
    payload that is no JSON object is quarantined; of several error-free rows of
    one key the first by position is accepted; an empty batch is valid.
    """
    v = F.try_parse_json("payload")
    raw = payloads.withColumn("_v", v)
    is_object = F.coalesce(F.startswith(F.schema_of_variant("_v"), F.lit("OBJECT")), F.lit(False))
    keys = F.when(is_object, F.coalesce(F.json_object_keys("payload"), F.array().cast("array<string>")))
    rename = F.create_map(*[F.lit(x) for kv in contract.aliases.items() for x in kv]) if contract.aliases else None
    canonical = F.transform("_keys", lambda k: F.coalesce(rename[k], k)) if rename is not None else F.col("_keys")
    named = raw.withColumn("_keys", keys).withColumn("_names", canonical)
    present = named.select(F.explode("_names").alias("n")).distinct()
    wanted = set(contract.fields)
    seen = {r.n for r in present.where(F.col("n").isin(*wanted)).collect()}  # at most the contract's columns
    if wanted - seen and named.limit(1).count():
        raise MissingRequiredFieldError(f"{contract.name} v{contract.version}: no row of the batch has {sorted(wanted - seen)}")
    expected = F.array(*[F.lit(c) for c in contract.fields])
    missing, unknown = F.array_sort(F.array_except(expected, "_names")), F.array_sort(F.array_except("_names", expected))
    errors: list[Column] = [
        F.when(~is_object, F.lit("payload is not a JSON object")),
        F.when(F.size(F.array_distinct("_names")) != F.size("_names"), F.lit("two keys stand for the same column")),
        F.when(F.size(missing) > 0, F.concat(F.lit("columns left out: "), F.array_join(missing, ", "))),
        F.when(F.size(unknown) > 0, F.concat(F.lit("columns the contract does not know: "), F.array_join(unknown, ", "))),
    ]
    # values and types first, as columns, so that the checks below stay small expressions
    taken: list[Column] = []
    for name in contract.fields:
        options = [name, *[a for a, c in contract.aliases.items() if c == name]]
        value = F.coalesce(*[_get(F.col("_v"), o) for o in options])
        taken += [F.try_variant_get(value, "$", "string").alias(f"_t_{name}"), F.when(~F.is_variant_null(value), F.schema_of_variant(value)).alias(f"_k_{name}")]
    named = named.select("*", *taken)
    columns: dict[str, Column] = {}
    for name, spec in contract.fields.items():
        kind = F.col(f"_k_{name}")
        normal, message = spec.normalizer(F.col(f"_t_{name}"), kind)
        absent, null = ~F.array_contains("_names", name), kind.isNull()
        columns[name] = F.when(~null, normal).cast(spec.kind)
        errors.append(F.when(absent, F.lit(None)).when(null, F.lit(None) if spec.nullable else F.lit(f"{name}: null is not allowed")).when(message.isNotNull(), F.concat(F.lit(f"{name}: "), message)))
    said = named.select(*payloads.columns, F.filter(F.array(*[e.cast("string") for e in errors]), lambda e: e.isNotNull()).alias("errors"), *[c.alias(n) for n, c in columns.items()])
    silent = F.size("errors") == 0
    if contract.rules:
        broken = F.coalesce(*[F.when(~F.coalesce(F.expr(c), F.lit(True)), F.lit(m)) for c, m in contract.rules])
        said = said.withColumn("errors", F.when(silent & broken.isNotNull(), F.array(broken)).otherwise(F.col("errors")))
    wrong = F.concat(F.lit(f"source: expected {source!r}, got "), F.col("source"))
    said = said.withColumn("errors", F.when(silent & (F.col("source") != source), F.array(wrong)).otherwise(F.col("errors")))
    said = stash(said, "validated")  # parsed once; read for the keys and for the rows
    firsts = said.where(silent).groupBy(*contract.key).agg(F.min("position").alias("_first")).select(*[F.col(k).alias(f"_k_{k}") for k in contract.key], "_first")
    on = silent
    for k in contract.key:
        on = on & (F.col(k) == F.col(f"_k_{k}"))
    repeated = silent & (F.col("position") > F.col("_first"))
    label = F.concat(F.lit(f"duplicate batch key ({', '.join(contract.key)}): "), F.concat_ws(", ", *[F.col(k).cast("string") for k in contract.key]))
    return said.join(firsts, on, "left").withColumn("errors", F.when(repeated, F.array(label)).otherwise(F.col("errors"))).drop("_first", *[f"_k_{k}" for k in contract.key])


def quarantined(validated: DataFrame, source: str, run_id: str, received_at: str) -> DataFrame:
    return validated.where(F.size("errors") > 0).select(
        F.lit(source).alias("source"), F.lit(run_id).alias("ingestion_run_id"), F.lit("contract_violation").alias("error_type"),
        F.array_join("errors", "; ").alias("error_message"), F.col("payload").alias("raw_payload"), F.lit(received_at).alias("received_at"),
    )


@F.pandas_udf(StringType())
def _record_id(payloads: pd.Series, sources: pd.Series) -> pd.Series:
    def one(payload: str | None, source: str) -> str | None:
        if payload is None:
            return None
        try:
            row = json.loads(payload)
        except ValueError:
            return None
        if not isinstance(row, dict):
            return None
        row.setdefault("source", source)
        return hashlib.sha256(json.dumps(row, sort_keys=True, separators=(",", ":")).encode()).hexdigest()

    return pd.Series([one(p, s) for p, s in zip(payloads, sources)], dtype="object")


def with_defaults(payloads: DataFrame, source: str, ingested_at: str) -> DataFrame:
    """Add source, source_record_id and ingested_at to payloads that lack the key; a key that is there, null or not, stays.

    The record id is the SHA-256 of the payload, with its source, as JSON with sorted
    keys and without blanks, so it doesn't depend on how the object was written down.
    """
    keys = F.json_object_keys("payload")
    # only payloads without an id leave the JVM: their ids must equal those of Python's own JSON writer
    identity = _record_id(F.when(~F.array_contains(keys, "source_record_id"), F.col("payload")), F.lit(source))
    for name, value in (("source", F.lit(source)), ("source_record_id", identity), ("ingested_at", F.lit(ingested_at))):
        lacks = ~F.coalesce(F.array_contains(keys, name), F.lit(True))
        addition = F.concat(F.lit(f',"{name}":"'), value, F.lit('"'))
        columns = F.when(lacks, addition).otherwise(F.lit(""))
        payloads = payloads.withColumn(f"_add_{name}", columns)
    body = F.expr("substring(rtrim(payload), 1, length(rtrim(payload)) - 1)")
    added = F.concat("_add_source", "_add_source_record_id", "_add_ingested_at")
    empty = F.size(keys) == 0
    full = F.concat(body, F.when(empty, F.substring(added, 2, 1_000_000)).otherwise(added), F.lit("}"))
    return payloads.withColumn("payload", F.when(keys.isNotNull() & (added != ""), full).otherwise(F.col("payload"))).drop("_add_source", "_add_source_record_id", "_add_ingested_at")


_META = {"source": Field("string", text), "source_record_id": Field("string", text), "ingested_at": Field("timestamp", utc_datetime)}
_RECORD = ("source", "source_record_id")

# The five contracts.
PRICES = Contract(
    "prices",
    {"symbol": Field("string", upper_text), "date": Field("date", iso_date), "open": Field("double", finite_float), "high": Field("double", finite_float), "low": Field("double", finite_float), "close": Field("double", finite_float), "volume": Field("bigint", integer), **_META},
    ("symbol", "date", "source"),
    "date",
    {"trade_date": "date", "ticker": "symbol"},
    (
        *((f"{c} > 0", f"{c}: must be greater than zero") for c in ("open", "high", "low", "close")),
        ("volume >= 0", "volume: must be non-negative"),
        ("high >= greatest(low, open, close)", "high: must be at least low, open and close"),
        ("low <= least(open, close)", "low: must be at most open and close"),
    ),
)
FUNDAMENTALS = Contract(
    "fundamentals",
    {"symbol": Field("string", upper_text), "metric_name": Field("string", text), "period_start": Field("date", iso_date, True), "period_end": Field("date", iso_date), "period_type": Field("string", text), "filed_at": Field("timestamp", utc_datetime, True), "value": Field("double", finite_float), "unit": Field("string", text), "currency": Field("string", text, True), **_META},
    _RECORD,
    "period_end",
    {"ticker": "symbol", "fiscal_period_end": "period_end"},
    (("period_start is null or period_end >= period_start", "period_end: must not precede period_start"), ("filed_at is null or filed_at <= ingested_at", "filed_at: must not be after ingested_at")),
)
EARNINGS = Contract(
    "earnings",
    {"symbol": Field("string", upper_text), "event_timestamp": Field("timestamp", utc_datetime), "fiscal_period_end": Field("date", iso_date, True), "event_status": Field("string", text), "eps_estimate": Field("double", finite_float, True), "eps_actual": Field("double", finite_float, True), **_META},
    _RECORD,
    "event_timestamp",
    {"ticker": "symbol", "event_time": "event_timestamp"},
)
MACRO = Contract(
    "macro",
    {"series_id": Field("string", upper_text), "observation_date": Field("date", iso_date), "released_at": Field("timestamp", utc_datetime, True), "value": Field("double", finite_float), "unit": Field("string", text), "frequency": Field("string", text), **_META},
    _RECORD,
    "observation_date",
    {"date": "observation_date", "release_timestamp": "released_at"},
    (("released_at is null or released_at <= ingested_at", "released_at: must not be after ingested_at"),),
)
NEWS = Contract(
    "news",
    {"event_timestamp": Field("timestamp", utc_datetime), "headline": Field("string", text), "url": Field("string", url, True), "publisher": Field("string", text, True), **_META},
    _RECORD,
    "event_timestamp",
    {"published_at": "event_timestamp", "title": "headline"},
)
CONTRACTS = {c.name: c for c in (PRICES, FUNDAMENTALS, EARNINGS, MACRO, NEWS)}

