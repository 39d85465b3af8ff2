"""Statistical quality, universe, freshness, reconciliation and storage guardrails."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import asdict, dataclass
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import lower_key, upper_key

# The quality ladder's thresholds.
MAD_SCALE = 1.4826
RELATIVE_FLOOR = 0.01
ABSOLUTE_FLOOR = 1e-9
THRESHOLDS = {
    "robust_z_warn": 4.0,
    "robust_z_fail": 8.0,
    "null_rate_warn": 0.001,
    "null_rate_fail": 0.01,
    "zero_volume_warn": 0.05,
    "zero_volume_fail": 0.20,
    "missing_symbol_warn": 0.01,
    "missing_symbol_fail": 0.05,
    "minimum_baseline_days": 20,
    "baseline_days": 60,
}
#: Metrics compared with the days before; rates have limits of their own.
COMPARED = ("row_count", "median_volume", "median_close", "return_dispersion")


def daily_profile(prices: DataFrame) -> DataFrame:
    """Per source and day: rows, null rate, medians, share of zero volumes, dispersion of returns, symbols.

    Rows without a date are left out. Returns are between the last delivered
    closes of a symbol's consecutive days: deliveries fold to one row per day, with
    map-side combine, before the window, so that it holds one symbol's calendar and
    never the rows without a symbol, which have no return.
    """
    wanted = prices.select(
        lower_key("source").alias("source"), F.col("date").alias("event_date"), upper_key("symbol").alias("symbol"), F.col("close").cast("double").alias("close"), F.col("volume").cast("double").alias("volume"),
        F.greatest(*[F.when(F.col(c).isNull(), 1.0).otherwise(0.0) for c in ("symbol", "close", "volume", "open", "high", "low")]).alias("_null"), "ingested_at", "source_record_id",
    ).where("event_date is not null")
    counted = wanted.groupBy("source", "event_date").agg(
        F.count("*").alias("row_count"),
        F.avg("_null").alias("null_rate"),
        F.median("close").alias("median_close"),
        F.median("volume").alias("median_volume"),
        F.avg(F.when(F.col("volume") == 0, 1.0).otherwise(0.0)).alias("zero_volume_fraction"),
    )
    last = wanted.where("symbol is not null").groupBy("source", "symbol", "event_date").agg(F.max_by("close", F.struct("ingested_at", F.trim("source_record_id"), "close")).alias("close"))
    prior = F.lag("close").over(Window.partitionBy("source", "symbol").orderBy("event_date"))
    moved = last.withColumn("change", F.when(prior > 0, F.col("close") / prior - 1)).groupBy("source", "event_date").agg(F.stddev_pop("change").alias("return_dispersion"), F.count("*").alias("symbols"))
    same = F.col("c.source").eqNullSafe(F.col("m.source")) & (F.col("c.event_date") == F.col("m.event_date"))
    return counted.alias("c").join(moved.alias("m"), same, "left").select("c.*", "return_dispersion", F.coalesce("symbols", F.lit(0)).alias("symbols"))


def _middle(values: Column) -> Column:
    """Median of an array; null if it is empty."""
    s, n = F.sort_array(values), F.size(values)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2


def _apart(values: Column, centre: Column) -> Column:
    return F.transform(values, lambda x: F.abs(x - centre))


def with_baseline(profile: DataFrame, metrics: Sequence[str], days: int = THRESHOLDS["baseline_days"]) -> DataFrame:
    """Adds, per metric m, m_n, m_median, m_mad and m_z against up to ``days`` profiled days before, and baseline_days.

    A window holds one source's days. Values that are null or not finite are no baseline.
    """
    w = Window.partitionBy("source").orderBy("event_date").rowsBetween(-int(days), -1)
    out = profile.withColumn("baseline_days", F.count("*").over(w))
    for m in metrics:
        v = F.col(m).cast("double")
        out = out.withColumn("_held", F.collect_list(F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)).over(w))
        out = out.withColumn(f"{m}_n", F.size("_held")).withColumn(f"{m}_median", _middle(F.col("_held")))
        out = out.withColumn(f"{m}_mad", _middle(_apart(F.col("_held"), F.col(f"{m}_median")))).drop("_held")
        scale = F.greatest(MAD_SCALE * F.col(f"{m}_mad"), RELATIVE_FLOOR * F.abs(f"{m}_median"), F.lit(ABSOLUTE_FLOOR))
        out = out.withColumn(f"{m}_z", F.abs(v - F.col(f"{m}_median")) / scale)
    return out


def _worse(value: Column, warn: float, fail: float) -> Column:
    return F.when(value >= fail, "FAILED").when(value >= warn, "DEGRADED")


FINDING = "struct<metric:string,severity:string,value:double,reason:string,baseline_median:double,baseline_mad:double,robust_z:double>"


def judge_days(profile: DataFrame, expected_symbols: int | None = None, thresholds: Mapping[str, float] | None = None) -> DataFrame:
    """The status of every source and day, with the findings behind it.

    Rates are held against absolute limits, COMPARED metrics against the median
    and scaled MAD of up to ``baseline_days`` profiled days before, each only where
    it has ``minimum_baseline_days`` finite values. The worst finding gives the status;
    without any, a short history is UNKNOWN and a sufficient one HEALTHY. Columns:
    source, event_date, status, reason, baseline_days, symbols, missing_symbols,
    findings (FINDING).
    """
    t = {**THRESHOLDS, **(thresholds or {})}
    least = int(t["minimum_baseline_days"])
    nothing = F.lit(None).cast("double")
    missing = F.greatest(F.lit(expected_symbols) - F.col("symbols"), F.lit(0)) if expected_symbols else F.lit(0)

    def rate(metric: str, value: Column, limit: str) -> Column:
        level = _worse(value, t[f"{limit}_warn"], t[f"{limit}_fail"])
        return F.when(level.isNotNull(), F.struct(F.lit(metric), level, value, F.format_string(f"{metric} of %.4f is past the limit", value), nothing, nothing, nothing).cast(FINDING))

    def compared(m: str) -> Column:
        z = F.col(f"{m}_z")
        level = F.when((F.col("baseline_days") >= least) & (F.col(f"{m}_n") >= least), _worse(z, t["robust_z_warn"], t["robust_z_fail"]))
        return F.when(level.isNotNull(), F.struct(F.lit(m), level, F.col(m).cast("double"), F.format_string(f"{m} lies %.2f robust deviations off", z), F.col(f"{m}_median"), F.col(f"{m}_mad"), z).cast(FINDING))

    rates = [rate("null_rate", F.col("null_rate"), "null_rate"), rate("zero_volume_fraction", F.col("zero_volume_fraction"), "zero_volume"), rate("missing_symbol_fraction", missing / F.lit(float(expected_symbols or 1)), "missing_symbol")]
    judged = with_baseline(profile, COMPARED, int(t["baseline_days"])).withColumn("findings", F.array_compact(F.array(*rates, *[compared(m) for m in COMPARED])))
    worst = F.array_max(F.transform("findings", lambda f: f.severity))  # FAILED sorts after DEGRADED
    status = F.coalesce(worst, F.when(F.col("baseline_days") < least, "UNKNOWN").otherwise("HEALTHY"))
    reason = F.when(worst.isNotNull(), F.concat_ws("; ", F.transform("findings", lambda f: f.reason))).when(status == "UNKNOWN", F.format_string("%d days before, too few to compare with", "baseline_days")).otherwise("nothing found")
    return judged.select("source", "event_date", status.alias("status"), reason.alias("reason"), "baseline_days", "symbols", missing.cast("bigint").alias("missing_symbols"), "findings")


def evaluate(profile: DataFrame, day: dt.date | None = None, expected_symbols: int | None = None, thresholds: Mapping[str, float] | None = None) -> DataFrame:
    """``judge_days`` of one day, by default each source's last; a source without a profile of the day gives no row."""
    all_days = judge_days(profile, expected_symbols, thresholds)
    if day is not None:
        return all_days.where(F.col("event_date") == F.lit(day))
    newest = F.max("event_date").over(Window.partitionBy("source"))
    return all_days.withColumn("_newest", newest).where("event_date = _newest").drop("_newest")


def unknown_symbols(records: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct cleaned symbols of records that known lacks."""
    seen = records.select(upper_key("symbol").alias("symbol")).where("symbol is not null").distinct()
    return seen.join(known.select(upper_key("symbol").alias("symbol")).distinct(), "symbol", "left_anti")


def read_universe(lines: Iterable[str]) -> list[str]:
    """Symbols of a universe text, one per line, # starts a comment; an empty universe is an error."""
    out = sorted({x for line in lines if (x := line.split("#", 1)[0].strip().upper())})
    if not out:
        raise ValueError("the universe is empty")
    return out


def shard(symbols: list[str], index: int, size: int) -> list[str]:
    if size < 1 or not 0 <= index < size:
        raise ValueError("shard index out of range")
    return [s for i, s in enumerate(symbols) if i % size == index]


@dataclass(frozen=True)
class Reconciliation:
    fetched: int
    accepted: int
    rejected: int
    deduplicated: int
    written: int
    pre_write: int
    post_write: int
    status: str
    problems: tuple[str, ...]


def reconcile(fetched: int, accepted: int, rejected: int, deduplicated: int, written: int, pre_write: int, post_write: int) -> Reconciliation:
    """accepted: new rows. Every row fetched is accepted, rejected or a duplicate; what was accepted was written and is there."""
    problems = []
    if fetched != accepted + rejected + deduplicated:
        problems.append(f"fetched {fetched}, accounted for {accepted + rejected + deduplicated}")
    if written != accepted:
        problems.append(f"written {written}, accepted {accepted}")
    if post_write - pre_write != accepted:
        problems.append(f"rows grew by {post_write - pre_write}, accepted {accepted}")
    return Reconciliation(fetched, accepted, rejected, deduplicated, written, pre_write, post_write, "failed" if problems else "passed", tuple(problems))


MARKET_ZONE = ZoneInfo("America/Chicago")
CLOSE, PUBLISHED = dt.time(16, 0), dt.time(16, 15)


def expected_close(now: dt.datetime) -> dt.datetime:
    """The last weekday close that data can be expected for at ``now``."""
    local = now.astimezone(MARKET_ZONE)
    day = local.date()
    if local.time() < PUBLISHED:
        day -= dt.timedelta(days=1)
    while day.weekday() > 4:
        day -= dt.timedelta(days=1)
    return dt.datetime.combine(day, CLOSE, MARKET_ZONE).astimezone(dt.timezone.utc)


def freshness(observed: dt.datetime | None, now: dt.datetime, allowed: dt.timedelta, market_days: bool = False) -> dict:
    """Age of the newest event against the clock or, for market data, against the last expected close."""
    if observed is None:
        return {"status": "unknown", "lag_seconds": None}
    reference = expected_close(now) if market_days else now
    lag = max((reference - observed).total_seconds(), 0.0)
    return {"status": "fresh" if lag <= allowed.total_seconds() else "stale", "lag_seconds": lag}


@dataclass(frozen=True)
class FreshnessPolicy:
    """basis: ``expected_market_event`` (newest event against the last expected close), ``source_check`` (last look at the source) or ``event_age`` (newest event), against now."""

    basis: str
    degraded: dt.timedelta
    failed: dt.timedelta


# What each dataset's freshness rests on, and after how many hours it degrades and fails.
POLICIES = {
    "prices": FreshnessPolicy("expected_market_event", dt.timedelta(hours=24), dt.timedelta(hours=48)),
    "fundamentals": FreshnessPolicy("source_check", dt.timedelta(days=7), dt.timedelta(days=14)),
    "earnings": FreshnessPolicy("source_check", dt.timedelta(days=1), dt.timedelta(days=2)),
    "macro": FreshnessPolicy("source_check", dt.timedelta(days=2), dt.timedelta(days=7)),
    "news": FreshnessPolicy("event_age", dt.timedelta(hours=24), dt.timedelta(hours=48)),
}


def _instant(value: dt.datetime | dt.date | str | None, market: bool) -> dt.datetime | None:
    """An instant in UTC; a day is its market close where the market's events are meant, else its first instant. A time without a zone is an error."""
    if value is None:
        return None
    if isinstance(value, str):
        value = dt.date.fromisoformat(value) if len(value) == 10 else dt.datetime.fromisoformat(value.replace("Z", "+00:00"))
    if not isinstance(value, dt.datetime):
        value = dt.datetime.combine(value, CLOSE, MARKET_ZONE) if market else dt.datetime.combine(value, dt.time(), dt.timezone.utc)
    if value.tzinfo is None:
        raise ValueError("a time must carry a time zone")
    return value.astimezone(dt.timezone.utc)


def assess_freshness(dataset: str, latest_event: dt.datetime | dt.date | str | None, last_check: dt.datetime | str | None, now: dt.datetime) -> dict:
    """HEALTHY, DEGRADED, FAILED or (without evidence) UNKNOWN by the dataset's policy, with what it rests on; JSON-ready, for the audit."""
    policy = POLICIES[dataset]
    market = policy.basis == "expected_market_event"
    at = _instant(now, False)
    expected = expected_close(at) if market else None
    seen = _instant(last_check, False) if policy.basis == "source_check" else _instant(latest_event, market)
    lag = None if seen is None else max((expected or at) - seen, dt.timedelta())
    status = "UNKNOWN" if lag is None else "FAILED" if lag >= policy.failed else "DEGRADED" if lag >= policy.degraded else "HEALTHY"
    reason = f"nothing to judge the {policy.basis} by" if lag is None else f"{policy.basis} lies {lag.total_seconds() / 3600:.1f} h back, {policy.degraded.total_seconds() / 3600:.0f} h degrade, {policy.failed.total_seconds() / 3600:.0f} h fail"
    return {"dataset": dataset, "status": status, "basis": policy.basis, "lag_seconds": None if lag is None else lag.total_seconds(), "expected_event_time": expected.isoformat() if expected else None, "reason": reason, "evaluated_at": at.isoformat()}


ESTIMATE_FACTOR = 1.25


def assess_storage(used: int, incoming_json_bytes: int, budget: int, warn_share: float = 0.8) -> dict:
    projected = used + int(incoming_json_bytes * ESTIMATE_FACTOR)
    status = "blocked" if projected > budget else "warning" if projected > warn_share * budget else "safe"
    return {"status": status, "projected_bytes": projected, "budget_bytes": budget}


def recovery_record(checks: Mapping[str, bool], run: Mapping, scenario: str = "", before: Mapping | None = None, failure: str = "", observed: Mapping | None = None, retry: str = "", now: dt.datetime | None = None) -> dict:
    """What a recovery drill did and proved: every invariant by name, and whether all hold. A drill without invariants proves nothing and is an error."""
    if not checks:
        raise ValueError("a recovery is judged by one invariant or more")
    at = (now or dt.datetime.now(dt.timezone.utc)).isoformat()
    return {"scenario": scenario, "initial_state": dict(before or {}), "injected_failure": failure, "observed_behavior": dict(observed or {}), "retry_action": retry, "run": dict(run), "invariants": dict(checks), "recovered": all(checks.values()), "recorded_at": at}


def as_dict(r: Reconciliation) -> dict:
    return asdict(r)
