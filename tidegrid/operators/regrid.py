"""Irregular readings onto a regular grid.

Method: a Kalman filter and Rauch-Tung-Striebel smoother per series and source
with a continuous-time local linear trend (state: level and slope, white noise
on both in continuous time), evaluated at the grid times. Every grid period
gets a level with its standard deviation and a mark where no reading exists.

Scale: deliveries are folded to one row per record, then to one row per
(series, source, day) holding mean and count, both with map-side combine. This
is exact for the smoother (n readings of a day equal one with variance R/n), and
it bounds a series by the number of days of its span, however many rows a hot
series has. Many series are filtered and smoothed at once as NumPy arrays, time
step by time step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import frequency_name, lower_key, trim_key, upper_key
from ..session import python_tasks
from .chunks import whole_groups
from .latest import keep_latest

GRID_SCHEMA = (
    "series_id string, source string, frequency string, period_start date, "
    "readings bigint, observed double, level double, level_sd double, is_missing boolean"
)
FREQUENCY_ORDER = ("DAILY", "WEEKLY", "MONTHLY", "QUARTERLY", "ANNUAL")
#: Candidate ratios of level noise (per day) to reading noise, tried by likelihood.
LEVEL_RATIOS = (1e-4, 1e-2, 0.1, 1.0, 10.0)
#: Candidate ratios of slope noise to level noise.
SLOPE_RATIOS = (1e-6, 1e-4, 1e-2)
#: Series that show no noise: reading noise as a share of the level, and the ratios.
PRIOR_NOISE, PRIOR_RATIOS = 1e-3, (1.0, 1e-4)
#: Readings whose series are smoothed together.
CHUNK_READINGS = 20_000
#: Most calendar days (a calendar is a set of dates, so it is small by its type).
CALENDAR_DAYS = 400_000


def clean_readings(raw: DataFrame) -> DataFrame:
    """Cleaned rows of a macro_readings table; other columns are left out."""
    return raw.select(
        upper_key("series_id").alias("series_id"),
        F.col("observation_date").cast("date").alias("observation_date"),
        F.col("released_at").cast("timestamp").alias("released_at"),
        F.col("value").cast("double").alias("value"),
        frequency_name("frequency").alias("frequency"),
        lower_key("source").alias("source"),
        trim_key("source_record_id").alias("source_record_id"),
        F.col("ingested_at").cast("timestamp").alias("ingested_at"),
    )


def stated_frequency(cleaned: DataFrame) -> DataFrame:
    """series_id, frequency: the known one most rows state; on a tie the finer one."""
    rank = F.array_position(F.array(*[F.lit(f) for f in FREQUENCY_ORDER]), F.col("frequency"))
    counted = (
        cleaned.where(F.col("frequency").isin(*FREQUENCY_ORDER) & F.col("series_id").isNotNull())
        .groupBy("series_id", "frequency")
        .agg(F.count("*").alias("n"))
    )
    return counted.groupBy("series_id").agg(F.max_by("frequency", F.struct(F.col("n"), -rank)).alias("frequency"))


def valid_readings(cleaned: DataFrame) -> DataFrame:
    """The readings that count: known by their ingestion, last delivery of each record, not null."""
    known = cleaned.where(
        F.col("observation_date").isNotNull() & (F.col("released_at").isNull() | (F.col("released_at") <= F.col("ingested_at")))
    ).drop("released_at", "frequency")
    last = keep_latest(known, ["source", "source_record_id"], ["ingested_at"])
    return last.where(F.col("series_id").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value"))


def period_starts(days: np.ndarray, frequency: str) -> np.ndarray:
    """First day (days since 1970) of the period each day lies in."""
    if frequency == "DAILY":
        return days
    if frequency == "WEEKLY":
        return days - (days + 3) % 7  # day 0 was a Thursday
    months = days.astype("datetime64[D]").astype("datetime64[M]").astype(np.int64)
    step = {"MONTHLY": 1, "QUARTERLY": 3, "ANNUAL": 12}[frequency]
    return (months // step * step).astype("datetime64[M]").astype("datetime64[D]").astype(np.int64)


def all_periods(first: int, last: int, frequency: str, calendar: np.ndarray) -> np.ndarray:
    """Every period start from first to last."""
    if frequency == "DAILY":
        return calendar[(calendar >= first) & (calendar <= last)]
    if frequency == "WEEKLY":
        return np.arange(first, last + 1, 7)
    step = {"MONTHLY": 1, "QUARTERLY": 3, "ANNUAL": 12}[frequency]
    a, b = (np.array([first, last]).astype("datetime64[D]").astype("datetime64[M]").astype(np.int64)).tolist()
    return np.arange(a, b + 1, step).astype("datetime64[M]").astype("datetime64[D]").astype(np.int64)


@dataclass
class Steps:
    """Moments per time and series (time first): predicted and filtered level, slope and covariance."""

    predicted: np.ndarray  # (5, times, series)
    filtered: np.ndarray
    gap: np.ndarray
    active: np.ndarray  # series, longest first, that have a time


def kalman_filter(gap: np.ndarray, y: np.ndarray, n: np.ndarray, active: np.ndarray, q_level: np.ndarray, q_slope: np.ndarray, keep: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, Steps | None]:
    """Filter many series at once, with reading noise 1.

    gap, y, n: (times, series), the days since the time before, the mean of n
    readings (0: none); a series has a reading at its first time or its level starts
    at y there. active: how many series, ordered by length from the longest, reach
    each time. q_level, q_slope: (candidates, series). Gives the log determinant, the
    sum of squares and the readings used, per candidate and series, and with ``keep``
    (one candidate) the moments. The prior is vague: the first level with a variance
    far above the data's.
    """
    times, series = y.shape
    m, s = np.broadcast_to(y[0], q_level.shape).copy(), np.zeros(q_level.shape)
    p00, p01, p11 = np.full(q_level.shape, 1e6), np.zeros(q_level.shape), 100.0 * (q_level + q_slope + 1e-9)
    log_det, square, used = np.zeros(q_level.shape), np.zeros(q_level.shape), np.zeros(series)
    begun = np.zeros(series, dtype=bool)
    steps = Steps(np.zeros((5, times, series)), np.zeros((5, times, series)), gap, active) if keep else None
    with np.errstate(divide="ignore", invalid="ignore"):
        for t in range(times):
            a = int(active[t])
            d, has = gap[t, :a], n[t, :a] > 0
            ql, qs = q_level[:, :a], q_slope[:, :a]
            M, S, A, B, C = m[:, :a], s[:, :a], p00[:, :a], p01[:, :a], p11[:, :a]
            M = M + d * S
            A = A + d * (2 * B + d * C) + ql * d + qs * d**3 / 3
            B = B + d * C + qs * d**2 / 2
            C = C + qs * d
            if keep:
                steps.predicted[:, t, :a] = M[0], S[0], A[0], B[0], C[0]
            v = A + np.where(has, 1.0 / np.maximum(n[t, :a], 1e-300), np.inf)  # no reading: infinite noise, no change
            e = y[t, :a] - M
            k0, k1 = A / v, B / v
            counts = has & begun[:a]  # the first reading only sets the vague prior
            log_det[:, :a] += np.where(counts, np.log(np.where(has, v, 1.0)), 0.0)
            square[:, :a] += np.where(counts, e * e / v, 0.0)
            used[:a] += counts
            begun[:a] |= has
            M, S = M + k0 * e, S + k1 * e
            A, B, C = np.maximum(A - k0 * A, 0.0), B - k0 * B, np.maximum(C - k1 * B, 0.0)
            m[:, :a], s[:, :a], p00[:, :a], p01[:, :a], p11[:, :a] = M, S, A, B, C
            if keep:
                steps.filtered[:, t, :a] = M[0], S[0], A[0], B[0], C[0]
    return log_det, square, used, steps


def rts_smooth(steps: Steps) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed level and its variance (times, series)."""
    _, times, series = steps.filtered.shape
    level, variance = np.zeros((times, series)), np.zeros((times, series))
    now = np.zeros((5, series))
    for t in range(times - 1, -1, -1):
        a, later = int(steps.active[t]), int(steps.active[t + 1]) if t + 1 < times else 0
        now[:, later:a] = steps.filtered[:, t, later:a]  # a series' last time
        if later:
            d = steps.gap[t + 1, :later]
            pm, ps, q00, q01, q11 = steps.predicted[:, t + 1, :later]
            fm, fs, f00, f01, f11 = steps.filtered[:, t, :later]
            m, s, p00, p01, p11 = now[:, :later]
            det = q00 * q11 - q01 * q01
            # gain G = P F' Q^-1 with F = [[1, d], [0, 1]]
            c00, c10 = f00 + d * f01, f01 + d * f11
            g00, g01 = (c00 * q11 - f01 * q01) / det, (f01 * q00 - c00 * q01) / det
            g10, g11 = (c10 * q11 - f11 * q01) / det, (f11 * q00 - c10 * q01) / det
            dm, ds = m - pm, s - ps
            d00, d01, d11 = p00 - q00, p01 - q01, p11 - q11
            h00, h01 = g00 * d00 + g01 * d01, g00 * d01 + g01 * d11
            h10, h11 = g10 * d00 + g11 * d01, g10 * d01 + g11 * d11
            now[:, :later] = fm + g00 * dm + g01 * ds, fs + g10 * dm + g11 * ds, f00 + h00 * g00 + h01 * g01, f01 + h00 * g10 + h01 * g11, f11 + h10 * g10 + h11 * g11
        level[t, :a], variance[t, :a] = now[0, :a], np.maximum(now[2, :a], 0.0)
    return level, variance


def _stacked(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(times, values, counts) of series, longest first, as arrays (times, series): gap, y, n, active."""
    longest, series = len(parts[0][0]), len(parts)
    gap, y, n = np.zeros((longest, series)), np.zeros((longest, series)), np.zeros((longest, series))
    for j, (t, v, c) in enumerate(parts):
        k = len(t)
        gap[1:k, j], y[:k, j], n[:k, j] = np.diff(t), v, c
    lengths = np.array([len(p[0]) for p in parts])
    return gap, y, n, np.searchsorted(-lengths, -np.arange(1, longest + 1), side="right")


def smooth_many(series: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Level and standard deviation at each grid day of many series (days, mean, count, grid).

    Each series' noises are its own: the ratios of level and slope noise to reading
    noise are the likeliest of LEVEL_RATIOS x SLOPE_RATIOS, reading noise is
    concentrated out. Of a series whose readings are one or all equal no noise can be
    estimated; it takes PRIOR_NOISE of its level and PRIOR_RATIOS, so its doubt grows
    with the distance to a reading as well.
    """
    out: list = [None] * len(series)
    order = sorted(range(len(series)), key=lambda i: -len(series[i][0]))
    ratios = np.array([(a, a * b) for a in LEVEL_RATIOS for b in SLOPE_RATIOS])
    centre, spread, flat = np.zeros(len(series)), np.zeros(len(series)), np.zeros(len(series), dtype=bool)
    for i, (_, mean, _, _) in enumerate(series):
        centre[i], spread[i] = float(np.mean(mean)), float(np.std(mean))
        flat[i] = len(mean) < 2 or float(np.ptp(mean)) == 0.0
        if flat[i]:
            spread[i] = PRIOR_NOISE * (abs(centre[i]) or 1.0)
    chosen, scale = np.zeros((2, len(series))), np.ones(len(series))
    gap, y, n, active = _stacked([(series[i][0], (series[i][1] - centre[i]) / spread[i], series[i][2]) for i in order])
    shape = (len(ratios), len(order))
    log_det, square, used, _ = kalman_filter(gap, y, n, active, np.broadcast_to(ratios[:, :1], shape), np.broadcast_to(ratios[:, 1:], shape))
    held = np.maximum(square / np.maximum(used, 1), 1e-12)
    best = np.argmax(-0.5 * (log_det + used * np.log(held)), axis=0)
    for j, i in enumerate(order):
        chosen[:, i] = (PRIOR_RATIOS[0], PRIOR_RATIOS[0] * PRIOR_RATIOS[1]) if flat[i] else ratios[best[j]]
        scale[i] = 1.0 if flat[i] else held[best[j], j]
    times = []
    for i, (days, mean, count, grid) in enumerate(series):
        t = np.union1d(days, grid)
        at = np.searchsorted(t, days)
        v, c = np.full(len(t), (mean[0] - centre[i]) / spread[i]), np.zeros(len(t))
        v[at], c[at] = (mean - centre[i]) / spread[i], count
        times.append((t, v, c))
    order = sorted(range(len(series)), key=lambda i: -len(times[i][0]))
    gap, y, n, active = _stacked([times[i] for i in order])
    _, _, _, steps = kalman_filter(gap, y, n, active, chosen[:1, order], chosen[1:, order], keep=True)
    level, variance = rts_smooth(steps)
    for j, i in enumerate(order):
        where = np.searchsorted(times[i][0], series[i][3])
        out[i] = level[where, j] * spread[i] + centre[i], np.sqrt(variance[where, j] * scale[i]) * spread[i]
    return out


def smooth_series(days: np.ndarray, mean: np.ndarray, count: np.ndarray, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``smooth_many`` of one series."""
    return smooth_many([(days, mean, count, grid)])[0]


def _calendar(calendar: DataFrame) -> np.ndarray:
    rows = calendar.select(F.unix_date(F.col("trade_date").cast("date")).alias("d")).where("d is not null").distinct().limit(CALENDAR_DAYS + 1).toPandas()
    if len(rows) > CALENDAR_DAYS:
        raise ValueError("the calendar has more days than a calendar can have")
    return np.sort(rows["d"].to_numpy(dtype=np.int64))


def regrid(raw: DataFrame, calendar: DataFrame) -> DataFrame:
    """One row per series, source and period from its first to its last reading.

    raw: series_id, observation_date, released_at, value, frequency, source,
    source_record_id, ingested_at. calendar: trade_date, the days daily series
    have. Columns out: GRID_SCHEMA; ``observed`` is the mean of the period's
    readings (null where none), ``level`` the smoothed level on the period's
    first day.

    Defined cases: rows without series or date, with a null or NaN value, or
    released after ingestion are no readings; a series none of whose rows states
    a known frequency gives no rows; daily readings off the calendar don't count;
    null sources are one source; repeated rows count once; an empty table gives
    an empty grid; other columns of the input are ignored.
    """
    days = _calendar(calendar)
    cleaned = clean_readings(raw)
    spark = raw.sparkSession
    daily = (
        valid_readings(cleaned)
        .groupBy("series_id", "source", "observation_date")
        .agg(F.avg("value").alias("mean"), F.count("*").alias("n"))
        .join(stated_frequency(cleaned), "series_id")
    )
    shared = spark.sparkContext.broadcast(days)  # bounded by CALENDAR_DAYS

    def series_of(pdf: pd.DataFrame) -> pd.DataFrame | None:
        edges = np.flatnonzero(np.r_[True, pdf["series"].to_numpy()[1:] != pdf["series"].to_numpy()[:-1], True])
        seen_all, mean_all, n_all = pdf["day"].to_numpy(dtype=np.int64), pdf["mean"].to_numpy(dtype=float), pdf["n"].to_numpy(dtype=np.int64)
        jobs, heads = [], []
        for a, b in zip(edges, edges[1:]):
            frequency = pdf["frequency"].iloc[a]
            seen, mean, n = seen_all[a:b], mean_all[a:b], n_all[a:b]
            if frequency == "DAILY":
                keep = np.isin(seen, shared.value)
                seen, mean, n = seen[keep], mean[keep], n[keep]
            if not len(seen):
                continue
            starts = period_starts(seen, frequency)
            grid = all_periods(int(starts[0]), int(starts[-1]), frequency, shared.value)
            at = np.searchsorted(grid, starts)
            readings = np.bincount(at, n, len(grid)).astype(np.int64)
            total = np.bincount(at, mean * n, len(grid))
            jobs.append((seen, mean, n, grid))
            heads.append((a, frequency, readings, total))
        if not jobs:
            return None
        sizes = [len(j[3]) for j in jobs]
        smoothed = smooth_many(jobs)
        first = np.repeat([h[0] for h in heads], sizes)
        readings, total = np.concatenate([h[2] for h in heads]), np.concatenate([h[3] for h in heads])
        with np.errstate(invalid="ignore", divide="ignore"):
            observed = np.where(readings > 0, total / readings, np.nan)
        return pd.DataFrame({
            "series_id": pdf["series_id"].to_numpy()[first],
            "source": pdf["source"].to_numpy()[first],
            "frequency": np.repeat([h[1] for h in heads], sizes),
            "period_start": np.concatenate([j[3] for j in jobs]).astype("datetime64[D]").astype(object),
            "readings": readings,
            "observed": pd.array(observed, dtype="Float64"),
            "level": np.concatenate([x[0] for x in smoothed]),
            "level_sd": np.concatenate([x[1] for x in smoothed]),
            "is_missing": readings == 0,
        })

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows = [], 0
        for pdf in whole_groups(batches, "series"):
            held.append(pdf)
            rows += len(pdf)
            if rows >= CHUNK_READINGS:
                out = series_of(pd.concat(held, ignore_index=True))
                held, rows = [], 0
                if out is not None:
                    yield out
        if held and (out := series_of(pd.concat(held, ignore_index=True))) is not None:
            yield out

    keyed = daily.select(F.xxhash64("series_id", "source").alias("series"), "series_id", "source", "frequency", F.unix_date("observation_date").alias("day"), "mean", "n")
    arranged = keyed.repartition(python_tasks(spark), "series_id", "source").sortWithinPartitions("series", "series_id", "source", "day")
    return arranged.mapInPandas(run, GRID_SCHEMA)
