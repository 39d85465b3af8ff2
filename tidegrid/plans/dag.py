"""Model graph: registry, selectors, topological build, lineage."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import publish_table
from . import checks, models

Check = Callable[[DataFrame, Mapping[str, DataFrame]], DataFrame]


class CheckFailed(RuntimeError):
    pass


@dataclass(frozen=True)
class Model:
    """fn gets the DataFrames of ``deps`` in order. A view stays lazy, a table is written. ``shared``: several models read it."""

    name: str
    deps: tuple[str, ...]
    fn: Callable[..., DataFrame]
    kind: str = "view"
    checks: Mapping[str, Check] = field(default_factory=dict)
    shared: bool = False


def topological(models_: Mapping[str, Model]) -> list[str]:
    """Names so that each comes after what it reads; a cycle is an error. Unknown names are sources."""
    order: list[str] = []
    state: dict[str, int] = {}

    def visit(name: str) -> None:
        if name not in models_ or state.get(name) == 2:
            return
        if state.get(name) == 1:
            raise ValueError(f"cycle through {name}")
        state[name] = 1
        for d in models_[name].deps:
            visit(d)
        state[name] = 2
        order.append(name)

    for name in models_:
        visit(name)
    return order


def edges(models_: Mapping[str, Model]) -> set[tuple[str, str]]:
    return {(d, m.name) for m in models_.values() for d in m.deps}


def _closure(start: str, links: Mapping[str, set[str]]) -> set[str]:
    seen: set[str] = set()
    todo = [start]
    while todo:
        for n in links.get(todo.pop(), ()):
            if n not in seen:
                seen.add(n)
                todo.append(n)
    return seen


def ancestors(models_: Mapping[str, Model], name: str) -> set[str]:
    up: dict[str, set[str]] = {}
    for a, b in edges(models_):
        up.setdefault(b, set()).add(a)
    return _closure(name, up)


def descendants(models_: Mapping[str, Model], name: str) -> set[str]:
    down: dict[str, set[str]] = {}
    for a, b in edges(models_):
        down.setdefault(a, set()).add(b)
    return _closure(name, down)


def select(models_: Mapping[str, Model], selector: str | None) -> list[str]:
    """'x', '+x' (with ancestors), 'x+' (with descendants), 'source:x+' (descendants of a source); several by blanks."""
    if not selector:
        return topological(models_)
    wanted: set[str] = set()
    for part in selector.split():
        name = part.strip("+").removeprefix("source:")
        known = set(models_) | {d for m in models_.values() for d in m.deps}
        if name not in known:
            raise ValueError(f"nothing is named {name!r}")
        wanted.add(name)
        if part.startswith("+"):
            wanted |= ancestors(models_, name)
        if part.endswith("+"):
            wanted |= descendants(models_, name)
    return [n for n in topological(models_) if n in wanted]


def build(spark: SparkSession, models_: Mapping[str, Model], sources: Mapping[str, DataFrame], target: str, selector: str | None = None) -> dict[str, dict]:
    """Build the selected models in order. Tables become versions of target/<name>, after their checks; readers always find one.

    A failing check stops the build before its model is published. Models that
    several others read are persisted for the length of the build.
    """
    chosen, frames, report, held = select(models_, selector), dict(sources), {}, []
    needed = set(chosen) | {a for n in chosen for a in ancestors(models_, n)}
    try:
        for name in topological(models_):
            if name not in needed:
                continue
            m = models_[name]
            df = m.fn(*[frames[d] for d in m.deps])
            if m.shared:
                df = df.persist()
                held.append(df)
            if m.kind == "table" and name in chosen:
                began = time.monotonic()
                df = publish_table(df, f"{target}/{name}", lambda made, name=name, m=m: _hold(name, m, made, frames))
                report[name] = {"kind": "table", "rows": df.count(), "seconds": round(time.monotonic() - began, 3)}
            elif name in chosen:
                _hold(name, m, df, frames)
                report[name] = {"kind": "view"}
            df.createOrReplaceTempView(name)
            frames[name] = df
    finally:
        for df in held:
            df.unpersist()
    return report


#: Selectors of the jobs one runs by name; None builds everything.
JOBS: Mapping[str, str | None] = {
    "daily_incremental": None,
    "historical_backfill": None,
    "rebuild_marts": "mart_security_daily mart_market_daily mart_sector_daily mart_company_snapshot mart_pipeline_dataset_health mart_stream_anomalies",
    "quality_validation": "mart_pipeline_dataset_health+",
    **{f"{name}_ingestion": f"source:raw_{name}+" for name in ("prices", "macro", "fundamentals", "earnings", "news")},
}


def run_job(spark: SparkSession, job: str, models_: Mapping[str, Model], sources: Mapping[str, DataFrame], target: str, before: Callable[[], object] | None = None) -> dict[str, dict]:
    """Build what a job selects; ``before`` (ingestion, say) runs first, and its failure keeps the build from starting."""
    if job not in JOBS:
        raise ValueError(f"unknown job {job!r}; choose from {sorted(JOBS)}")
    if before:
        before()
    return build(spark, models_, sources, target, JOBS[job])


def _hold(name: str, m: Model, df: DataFrame, frames: Mapping[str, DataFrame]) -> None:
    for label, check in m.checks.items():
        if check(df, frames).limit(1).count():
            raise CheckFailed(f"{name}: {label}")


def market_models(as_of) -> dict[str, Model]:
    """The engine's own models over the sources raw_prices, raw_fundamentals, raw_earnings, raw_macro, raw_news, ingestion_runs, stream_events and security_sectors."""
    def key(c: str) -> dict[str, Check]:
        return {f"unique {c}": lambda df, _: checks.unique(df, c), f"not null {c}": lambda df, _: checks.not_null(df, c)}

    listed: Iterable[Model] = (
        Model("stg_prices", ("raw_prices",), models.stg_prices, checks=key("price_bar_key"), shared=True),
        Model("stg_fundamentals", ("raw_fundamentals",), models.stg_fundamentals, checks=key("fundamental_observation_key")),
        Model("stg_earnings", ("raw_earnings",), models.stg_earnings, checks=key("earnings_event_key")),
        Model("stg_macro", ("raw_macro",), models.stg_macro, checks=key("macro_observation_key")),
        Model("stg_news", ("raw_news",), models.stg_news, checks=key("news_event_key")),
        Model("int_daily_returns", ("stg_prices",), models.int_daily_returns, checks={"returns are sane": lambda df, _: checks.expression_is_true(df, "abs(daily_return) <= 10.0")}, shared=True),
        Model("int_rolling_volatility", ("int_daily_returns",), models.int_rolling_volatility),
        Model("int_security_fundamentals", ("stg_fundamentals",), models.int_security_fundamentals, checks={"ranges are ordered": lambda df, _: checks.expression_is_true(df, "effective_to is null or effective_to >= effective_from")}),
        Model("int_earnings_surprises", ("stg_earnings",), models.int_earnings_surprises),
        Model("int_macro_aligned", ("stg_macro", "stg_prices"), models.int_macro_aligned, checks={"no look-ahead": lambda df, _: checks.no_lookahead(df)}),
        Model("mart_security_daily", ("int_rolling_volatility",), models.mart_security_daily, "table", {**key("price_bar_key"), "rows reconcile": lambda df, f: checks.counts_reconcile(df, f["stg_prices"])}),
        Model("mart_market_daily", ("int_daily_returns",), models.mart_market_daily, "table", key("trade_date")),
        Model("mart_sector_daily", ("int_daily_returns", "security_sectors"), models.mart_sector_daily, "table", {"unique day and sector": lambda df, _: checks.unique_combination(df, ["trade_date", "sector"])}),
        Model("mart_company_snapshot", ("stg_prices", "stg_fundamentals", "int_earnings_surprises"), lambda p, f, e: models.mart_company_snapshot(p, f, e, as_of), "table", {"prices resolve": lambda df, f: checks.prices_resolve(df, f["stg_prices"])}),
        Model(
            "mart_pipeline_dataset_health", ("stg_prices", "stg_fundamentals", "stg_earnings", "stg_macro", "stg_news", "ingestion_runs"),
            lambda p, f, e, m, n, r: models.mart_pipeline_dataset_health({"prices": p, "fundamentals": f, "earnings": e, "macro": m, "news": n}, r, as_of), "table",
            {"every dataset": lambda df, _: checks.every_dataset(df, list(models.HEALTH)), "known status": lambda df, _: checks.accepted_values(df, "status", ["empty", "degraded", "unknown", "healthy"])},
        ),
        Model("mart_stream_anomalies", ("stream_events", "mart_security_daily", "mart_market_daily", "int_earnings_surprises"), models.mart_stream_anomalies, "table", {"only earlier bars": lambda df, _: checks.expression_is_true(df, F.col("context_trade_date") < F.to_date("event_timestamp"))}),
        Model("mart_intraday_anomalies", ("mart_stream_anomalies",), lambda df: df),
    )
    return {m.name: m for m in listed}


def lineage(models_: Mapping[str, Model]) -> dict:
    """Nodes and edges as plain data, for a lineage document."""
    sources = {d for m in models_.values() for d in m.deps} - set(models_)
    return {
        "nodes": [*({"name": s, "type": "source"} for s in sorted(sources)), *({"name": m.name, "type": "model", "kind": m.kind} for m in models_.values())],
        "edges": [{"from": a, "to": b} for a, b in sorted(edges(models_))],
    }
