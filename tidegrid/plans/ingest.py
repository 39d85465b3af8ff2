"""Ingestion: validate, deduplicate against the lake, stage, promote, reconcile, manifest, checkpoint.

The order of durability is the argument: data files, then the reconciliation, then
the manifest, then the checkpoint. A replay after a crash anywhere finds what is
there by key and adds only what is missing.
"""

from __future__ import annotations

import datetime as dt
import json
import re
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import contracts
from ..sources.contracts import CONTRACTS, Contract
from ..sources.readers import read_dataset
from ..sources.storage import ConcurrentWriteError, HadoopFiles, Versions, stash
from .quality import reconcile

# Fixed value: what a run may be called.
RUN_ID = re.compile(r"^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$")
Hook = Callable[[str, str], None]


class IdempotencyConflictError(ValueError):
    """A key arrives again with other values."""


class ReconciliationError(RuntimeError):
    """Counts of a run don't add up."""


class PartitionLockedError(RuntimeError):
    """A compaction holds the partition."""


@dataclass(frozen=True)
class Lake:
    """Folders of a lake."""

    spark: SparkSession
    root: str

    @property
    def raw(self) -> str:
        return f"{self.root}/raw"

    def lock(self, partition: str) -> str:
        """Lock file of a partition (dataset/year=…/month=…); outside the data, where readers would take it for a file of theirs."""
        return f"{self.root}/_locks/{partition.replace('/', '--')}.lock"

    @property
    def runs(self) -> str:
        return f"{self.root}/metadata/ingestion_runs"

    @property
    def files(self) -> HadoopFiles:
        return HadoopFiles(self.spark, self.root)


@dataclass(frozen=True)
class RunResult:
    run_id: str
    dataset: str
    status: str
    input_rows: int
    accepted_rows: int
    quarantined_rows: int
    duplicate_rows: int
    files_written: int
    input_bytes: int
    output_bytes: int
    wall_clock_seconds: float
    started_at: str
    completed_at: str
    max_event_date: str | None
    run_type: str
    requested_start: str | None
    requested_end: str | None
    late_arriving_rows: int
    earliest_late_event_date: str | None
    arrival_time: str
    prior_event_watermark: str | None
    contract_version: int
    records_written: int
    pre_write_row_count: int
    post_write_row_count: int
    expected_row_delta: int
    actual_row_delta: int
    reconciliation_status: str


def classify(accepted: DataFrame, retained: DataFrame, contract: Contract) -> DataFrame:
    """Adds ``kind`` to accepted rows: new, duplicate or conflict with the retained row of the key. Null values equal null values."""
    values = F.struct(*[F.col(c) for c in contract.values])
    held = retained.groupBy(*contract.key).agg(F.max(values).alias("_held"), F.count_distinct(values).alias("_variants"))
    held = held.select(*[F.col(k).alias(f"_k_{k}") for k in contract.key], "_held", "_variants")
    on = F.lit(True)
    for k in contract.key:
        on = on & (F.col(k) == F.col(f"_k_{k}"))
    same = F.col("_held").eqNullSafe(values) & (F.col("_variants") == 1)
    return accepted.join(held, on, "left").withColumn("kind", F.when(F.col("_held").isNull(), "new").when(same, "duplicate").otherwise("conflict")).drop("_held", "_variants", *[f"_k_{k}" for k in contract.key])


def key_count(retained: DataFrame, contract: Contract) -> int:
    """Distinct keys; a key retained with different values is a conflict."""
    values = F.struct(*[F.col(c) for c in contract.values])
    per_key = retained.groupBy(*contract.key).agg(F.count_distinct(values).alias("v"))
    row = per_key.agg(F.count("*").alias("n"), F.coalesce(F.count_if(F.col("v") > 1), F.lit(0)).alias("bad")).first()
    if row.bad:
        raise IdempotencyConflictError(f"{row.bad} retained keys hold different values")
    return row.n


def backfill(
    lake: Lake,
    dataset: str,
    payloads: DataFrame,
    source: str,
    run_id: str | None = None,
    now: dt.datetime | None = None,
    input_bytes: int = 0,
    run_type: str = "historical_backfill",
    requested: tuple[dt.date, dt.date] | None = None,
    watermark: dt.date | None = None,
    hook: Hook | None = None,
) -> RunResult:
    """Take one batch of payload rows into the lake. See the module's text for the order of its steps."""
    if dataset not in CONTRACTS:
        raise ValueError(f"unknown dataset {dataset!r}; choose from {sorted(CONTRACTS)}")
    contract, run_id = CONTRACTS[dataset], run_id or str(uuid.uuid4())
    if not RUN_ID.fullmatch(run_id):
        raise ValueError("run_id: at most 128 letters, digits, dots, underscores and hyphens, a letter or digit first")
    if requested and requested[1] < requested[0] and run_type != "incremental":
        raise ValueError("the requested end precedes the start")
    now = now or dt.datetime.now(dt.timezone.utc)
    if now.tzinfo is None:
        raise ValueError("now must carry a time zone")
    say = hook or (lambda *_: None)
    began, started = time.monotonic(), now.astimezone(dt.timezone.utc)
    files, spark = lake.files, lake.spark
    validated = stash(contracts.validate(contract, contracts.with_defaults(payloads, source, started.isoformat()), source), "validated")
    rejected = contracts.quarantined(validated, source, run_id, started.isoformat())
    fetched, bad = validated.count(), rejected.count()
    if bad:
        safe = re.sub(r"[^\w-]", "_", source)
        rejected.hint("rebalance").write.mode("errorifexists").json(f"{lake.root}/quarantine/source={safe}/run={re.sub(r'[^A-Za-z0-9_-]', '_', run_id)}")
    event_date = F.to_date(contract.event_time)
    # where the key holds the event date, only the batch's own months can hold one of its keys
    months = None
    if contract.event_time in contract.key:
        named = validated.where(F.size("errors") == 0).select(F.concat(F.lit("year="), F.date_format(event_date, "yyyy"), F.lit("/month="), F.date_format(event_date, "MM")).alias("m")).distinct()
        months = sorted(r.m for r in named.collect())  # calendar months

    def held_now() -> DataFrame:
        return read_dataset(spark, lake.raw, dataset, contract.ddl(), months).select(*contract.columns)

    retained = held_now()
    elsewhere = read_dataset(spark, lake.raw, dataset, contract.ddl()).count() - retained.count() if months is not None else 0  # counts come from the footers
    before = elsewhere + key_count(retained, contract)
    judged = stash(classify(validated.where(F.size("errors") == 0).select(*contract.columns), retained, contract), "classified")
    kinds = {r["kind"]: r["count"] for r in judged.groupBy("kind").count().collect()}
    if kinds.get("conflict"):
        raise IdempotencyConflictError(f"{kinds['conflict']} keys arrive with values that differ from the retained ones")
    new = judged.where("kind = 'new'").drop("kind")
    staged = f"{lake.root}/_staging/{run_id}"
    new.withColumn("year", F.date_format(event_date, "yyyy")).withColumn("month", F.date_format(event_date, "MM")).repartition("year", "month").write.partitionBy("year", "month").option("compression", "zstd").parquet(staged)
    partitions = [(y, m) for y in files.directories(staged) for m in files.directories(y)]
    if partitions:
        again = spark.read.option("basePath", staged).parquet(staged)
        if again.count() != kinds.get("new", 0) or [c for c in again.columns if c not in ("year", "month")] != contract.columns:
            raise ReconciliationError("staged files don't hold what was accepted")
    written: list[str] = []
    for _, month in partitions:
        inner = "/".join(month.rsplit("/", 2)[1:])
        into = f"{lake.raw}/{dataset}/{inner}"
        lock = lake.lock(f"{dataset}/{inner}")
        if not files.create_exclusive(lock, run_id):
            raise PartitionLockedError(into)
        try:  # no compaction starts while files move in
            files.mkdirs(into)
            for i, (path, _, _) in enumerate(files.list(month)):
                if path.endswith(".parquet"):
                    target = f"{into}/part-{run_id}-{i}.parquet"
                    say("before_promotion", target)
                    if files.exists(target):
                        raise FileExistsError(target)
                    files.rename(path, target)
                    written.append(target)
                    say("after_promotion", target)
        finally:
            files.delete(lock)
    files.delete(staged)
    after = elsewhere + key_count(held_now(), contract)
    accepted, repeated = kinds.get("new", 0), kinds.get("duplicate", 0)
    balance = reconcile(fetched, accepted, bad, repeated, accepted, before, after)
    files.publish_json(f"{lake.root}/metadata/reconciliation/{run_id}.json", asdict(balance))
    if balance.status != "passed":
        raise ReconciliationError("; ".join(balance.problems))
    say("before_manifest", run_id)
    late = F.col("d") <= F.lit(watermark) if watermark else F.lit(False)
    days = judged.select(event_date.alias("d"), "kind").agg(
        F.max("d").alias("last"), F.coalesce(F.count_if((F.col("kind") == "new") & late), F.lit(0)).alias("late"), F.min(F.when((F.col("kind") == "new") & late, F.col("d"))).alias("earliest")
    ).first()
    tail = {t.split("/raw/", 1)[1] for t in written}
    sizes = {p: n for folder in {t.rsplit("/", 1)[0] for t in written} for p, n, _ in files.list(folder)}
    result = RunResult(
        run_id, dataset, "degraded" if bad else "success", fetched, accepted, bad, repeated, len(written), input_bytes, sum(n for p, n in sizes.items() if p.split("/raw/", 1)[1] in tail), round(time.monotonic() - began, 6),
        started.isoformat(), dt.datetime.now(dt.timezone.utc).isoformat(), days.last.isoformat() if days.last else None, run_type, requested[0].isoformat() if requested else None, requested[1].isoformat() if requested else None,
        days.late, days.earliest.isoformat() if days.earliest else None, started.isoformat(), watermark.isoformat() if watermark else None, contract.version, accepted, before, after, accepted, after - before, balance.status,
    )
    files.publish_json(f"{lake.runs}/{run_id}.json", asdict(result))
    return result


def fetch_window(checkpoint: dt.date | None, initial: dt.date | None, through: dt.date, overlap: int) -> tuple[dt.date, dt.date]:
    """From the day after the checkpoint, or overlap days back including it; a legal window may be empty once a checkpoint exists."""
    if overlap < 0:
        raise ValueError("the overlap must not be negative")
    if checkpoint is None:
        if initial is None:
            raise ValueError("without a checkpoint an initial start is needed")
        if through < initial:
            raise ValueError("the end precedes the start")
        return initial, through
    return checkpoint + dt.timedelta(days=1 - overlap), through


class Checkpoints:
    """Last successful event date per dataset and source; only moves forward, also if two runs advance it at once."""

    def __init__(self, lake: Lake):
        self.files, self.folder = lake.files, f"{lake.root}/metadata/checkpoints"

    def _name(self, dataset: str, source: str) -> str:
        return f"{dataset}--{re.sub(r'[^A-Za-z0-9_-]', '_', source)}"

    def _versions(self, dataset: str, source: str) -> Versions:
        return Versions(self.files, f"{self.folder}/{self._name(dataset, source)}")

    def get(self, dataset: str, source: str) -> dt.date | None:
        _, held = self._versions(dataset, source).read()
        return dt.date.fromisoformat(held["event_date"]) if held else None

    def advance(self, dataset: str, source: str, day: dt.date, run_id: str) -> dt.date:
        versions = self._versions(dataset, source)
        while True:
            number, held = versions.read()
            if held and dt.date.fromisoformat(held["event_date"]) >= day:
                return dt.date.fromisoformat(held["event_date"])
            now = {"dataset": dataset, "source": source, "event_date": day.isoformat(), "run_id": run_id, "updated_at": dt.datetime.now(dt.timezone.utc).isoformat()}
            try:
                versions.replace(number, now)
            except ConcurrentWriteError:
                continue
            self.files.publish_json(f"{self.folder}/{self._name(dataset, source)}.json", now)
            return day


def in_window(payloads: DataFrame, contract: Contract, start: dt.date, end: dt.date) -> DataFrame:
    """Rows whose event date lies in the window; rows without a readable date stay, for quarantine."""
    names = [contract.event_time, *[a for a, c in contract.aliases.items() if c == contract.event_time]]
    value = F.coalesce(*[F.get_json_object("payload", f"$.{n}") for n in names])
    day = F.when(value.rlike(contracts.ISO_DATE), F.substring(value, 1, 10).try_cast("date"))
    return payloads.where(day.isNull() | day.between(F.lit(start), F.lit(end)))


def incremental(lake: Lake, dataset: str, payloads: DataFrame, source: str, through: dt.date, initial: dt.date | None = None, overlap: int = 0, **options) -> tuple[RunResult, dt.date | None]:
    """Take the window after the checkpoint; the checkpoint moves only if a row was accepted, and after the manifest."""
    store = Checkpoints(lake)
    held = store.get(dataset, source)
    start, end = fetch_window(held, initial, through, overlap)
    picked = in_window(payloads, CONTRACTS[dataset], start, end)
    result = backfill(lake, dataset, picked, source, run_type="incremental", requested=(start, end), watermark=held, **options)
    if result.max_event_date is not None:
        held = store.advance(dataset, source, dt.date.fromisoformat(result.max_event_date), result.run_id)
    return result, held


def range_backfill(lake: Lake, dataset: str, payloads: DataFrame, source: str, start: dt.date, end: dt.date, rebuild: Callable[[str], None] | None = None, **options) -> RunResult:
    """Take a range of dates without touching the checkpoint; ``rebuild`` is called with the dataset if rows were added."""
    result = backfill(lake, dataset, in_window(payloads, CONTRACTS[dataset], start, end), source, run_type="range_backfill", requested=(start, end), **options)
    if rebuild and result.accepted_rows:
        rebuild(dataset)
    return result

