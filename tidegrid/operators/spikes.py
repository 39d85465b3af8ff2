"""Implausible spikes, stuck values and impossible readings, judged per series.

Method: an isolation forest per source and field on level, difference, seasonal and
run-length features that are scaled by each series' own usual variation; every
reading is scored. A reading is a spike if its score reaches the least score its own
forest gives to readings SPIKE_LIMIT or more usual variations away; the exact
distance and duration are checked after that. Explicit limits find the
impossible (by their value) and the stuck (by the length of their run).

Scale: the last delivery per (symbol, date, source) is an aggregation with
map-side combine; after it a series has at most one reading per calendar day.
Series then stream through ``mapInPandas`` in sorted partitions, many at a time,
as NumPy arrays. Feature values are rounded to a grid, in training and scoring
alike, so that equal feature rows are scored once per batch. Forests are trained
on a bounded sample of the readings of all series of a source and field (the
TREES x TREE_ROWS lowest in a hash order). Sources are taken in groups of about
SOURCES_AT_ONCE, so that the forests broadcast at once are bounded too.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import lower_key, trim_key, upper_key
from ..session import python_tasks
from ..sources.storage import stash
from .chunks import whole_groups
from .latest import keep_latest

FIELDS = ("close", "volume")
#: A reading at or below the limit is impossible: (limit, limit itself is impossible).
PHYSICAL = {"close": (0.0, True), "volume": (0.0, False)}
STUCK_RUN = 5
SPIKE_LIMIT = 9.0
AROUND = 4  # readings on either side
SEASON = 5  # days of a trading week
TREES, TREE_ROWS, SEED = 50, 256, 20240229
#: Readings that reach a forest's task before the lowest in the hash order are taken, as a multiple of those taken.
DRAWN = 4
#: A spike is over after so many readings.
SPIKE_READINGS = 3
#: Usual variations at which distances end, those of a 0 on the log scale among them.
FAR = 1000.0
#: Sources whose forests (about 0.4 MB a field) are broadcast together.
SOURCES_AT_ONCE = 64
#: The mean absolute change of normal noise over its median absolute change.
MEAN_OVER_MEDIAN = 0.7979 / 0.6745
LEAST_VARIATION = 1e-4
SCORED_SCHEMA = "symbol string, event_date date, source string, field string, value double, score double, score_limit double, deviation double, run_length int, is_impossible boolean, is_stuck boolean, is_spike boolean"


def clean_bars(prices: DataFrame) -> DataFrame:
    """Cleaned rows that have a symbol and a date; other columns are left out."""
    return prices.select(
        upper_key("symbol").alias("symbol"),
        F.col("date").cast("date").alias("event_date"),
        lower_key("source").alias("source"),
        F.col("close").cast("double").alias("close"),
        F.col("volume").cast("double").alias("volume"),
        trim_key("source_record_id").alias("source_record_id"),
        F.col("ingested_at").cast("timestamp").alias("ingested_at"),
    ).where("symbol is not null and event_date is not null")


def last_readings(cleaned: DataFrame) -> DataFrame:
    """symbol, event_date, source, close, volume: the last ingested row per key; no contract filter."""
    return keep_latest(cleaned, ["symbol", "event_date", "source"], ["ingested_at", "source_record_id"], ["symbol", "event_date", "source", "close", "volume"])


def _segment_median(values: np.ndarray, seg: np.ndarray, n_seg: int) -> np.ndarray:
    """Median of values per segment; NaN where a segment has none."""
    out = np.full(n_seg, np.nan)
    if not len(values):
        return out
    order = np.lexsort((values, seg))
    v, s = values[order], seg[order]
    first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    size = np.diff(np.r_[first, len(s)])
    out[s[first]] = 0.5 * (v[first + (size - 1) // 2] + v[first + size // 2])
    return out


def _around_median(values: np.ndarray, seg: np.ndarray) -> np.ndarray:
    """Median of the 2 x AROUND + 1 readings of the same series nearest to each: at the ends of a series the window moves inwards
    and keeps its size, so that a spike there doesn't fill most of it. Itself where a series has under AROUND + 1 readings."""
    n, width = len(values), 2 * AROUND + 1
    first = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
    length = np.diff(np.r_[first, n])
    begin, size = np.repeat(first, length), np.repeat(length, length)
    start = begin + np.clip(np.arange(n) - begin - AROUND, 0, np.maximum(size - width, 0))
    columns = np.full((n, width), np.nan)
    for k in range(width):
        inside = start + k < begin + size
        columns[inside, k] = values[start[inside] + k]
    columns.sort(axis=1)  # NaN last
    count = np.minimum(size, width)
    rows = np.arange(n)
    median = 0.5 * (columns[rows, (count - 1) // 2] + columns[rows, count // 2])
    return np.where(count > AROUND, median, values)


def _grid(level: np.ndarray, difference: np.ndarray, seasonal: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Feature rows on the grid that training and scoring share."""
    return np.column_stack([np.round(np.arcsinh(np.abs(level)) * 4), np.round(np.arcsinh(np.abs(difference)) * 4), np.round(np.arcsinh(np.abs(seasonal)) * 3), np.round(np.log2(np.minimum(run, 64)) * 2)]).astype(np.int16)


def _brief(x: np.ndarray, away: np.ndarray, seg: np.ndarray) -> np.ndarray:
    """Readings further away than SPIKE_LIMIT, in runs on one side of at most SPIKE_READINGS.

    Within AROUND readings of an end of the series the surroundings lie on one side, as
    in a trend; there the reading next to the run must also be back by more than two thirds.
    """
    n = len(x)
    side = np.sign(away) * (np.abs(away) > SPIKE_LIMIT)
    start = np.flatnonzero(np.r_[True, (side[1:] != side[:-1]) | (seg[1:] != seg[:-1])])
    size = np.diff(np.r_[start, n])
    keep = (side[start] != 0) & (size <= SPIKE_READINGS)
    series = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
    ends = np.r_[series[1:], n]
    for k in np.flatnonzero(keep):
        a, b = int(start[k]), int(start[k] + size[k])
        j = int(np.searchsorted(series, a, side="right")) - 1
        if a - series[j] < AROUND or ends[j] - b < AROUND:
            beside = [(x[a] - x[a - 1]) if a > series[j] else None, (x[b - 1] - x[b]) if b < ends[j] else None]
            keep[k] = all(v is None or v * side[a] * 1.5 > np.abs(away[a:b]).min() for v in beside)
    return np.repeat(keep, size)


def features(value: np.ndarray, seg: np.ndarray, day: np.ndarray, field: str) -> dict[str, np.ndarray]:
    """Features of the readings of one field (no nulls), ordered by series and day. seg: 0, 1, … per series."""
    n, n_seg = len(value), int(seg[-1]) + 1 if len(seg) else 0
    new_run = np.r_[True, (value[1:] != value[:-1]) | (seg[1:] != seg[:-1])] if n else np.array([], dtype=bool)
    run_id = np.cumsum(new_run) - 1
    run = np.bincount(run_id)[run_id] if n else np.array([], dtype=int)
    limit, included = PHYSICAL[field]
    impossible = (value < limit) | ((value == limit) & included)
    out = {"run": run, "impossible": impossible, "deviation": np.zeros(n), "brief": np.zeros(n, dtype=bool)}
    level, difference, seasonal = np.full(n, FAR), np.full(n, FAR), np.full(n, FAR)
    at = np.flatnonzero(~impossible)
    if len(at):
        with np.errstate(divide="ignore", invalid="ignore"):
            x, s = np.log(value[at]), seg[at]  # an allowed 0 lies infinitely low
            within = np.r_[False, s[1:] == s[:-1]]
            change = np.where(within, np.diff(x, prepend=x[0]), 0.0)
            away = x - _around_median(x, s)
        change[np.isnan(change)], away[np.isnan(away)] = 0.0, 0.0  # 0 among zeros
        real = within & np.isfinite(change)
        usual = _segment_median(np.abs(change[real]), s[real], n_seg)
        flat = np.isnan(usual) | (usual == 0)
        if flat.any():  # mostly unchanged series: the usual size of a change that isn't zero
            moved = real & (change != 0) & flat[s]
            usual = np.where(flat, np.minimum(_segment_median(np.abs(change[moved]), s[moved], n_seg), 0.01), usual)
        usual = np.maximum(np.nan_to_num(usual, nan=LEAST_VARIATION) * MEAN_OVER_MEDIAN, LEAST_VARIATION)[s]
        away, change = np.clip(away / usual, -FAR, FAR), np.clip(change / usual, -FAR, FAR)
        week = s * SEASON + (day[at] % 7) % SEASON
        mean = np.bincount(week, away.clip(-3, 3), n_seg * SEASON) / np.maximum(np.bincount(week, minlength=n_seg * SEASON), 1)
        after = np.r_[np.where(within[1:], change[1:], change[:-1]), change[-1]]  # the change to the next reading, at the end of a series the one before
        before = np.where(within, change, after)
        # the return from a spike is as large a change as the spike: what sets a reading off is the smaller of its two changes
        level[at], difference[at], seasonal[at] = away, np.minimum(np.abs(before), np.abs(after)), away - mean[week]
        out["deviation"][at] = away
        out["brief"][at] = _brief(np.nan_to_num(x, neginf=-1e6) / usual, away, s)
    out["x"] = _grid(level, difference, seasonal, run) if n else np.zeros((0, 4), dtype=np.int16)
    return out


def path_length(n: float) -> float:
    """Mean depth of an unsuccessful search in a tree of n rows."""
    if n <= 1:
        return 0.0
    return 2.0 * (np.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n if n > 2 else 1.0


def train_forest(x: np.ndarray, seed: int = SEED) -> dict:
    """An isolation forest as flat arrays: per node feature (-1: leaf), threshold, children and depth at a leaf."""
    rng = np.random.default_rng(seed)
    rows = min(TREE_ROWS, len(x))
    most = int(np.ceil(np.log2(max(rows, 2))))
    feature, threshold, left, right, depth, roots = [], [], [], [], [], []

    def grow(own: np.ndarray, d: int) -> int:
        me = len(feature)
        for a, v in ((feature, -1), (threshold, 0.0), (left, me), (right, me), (depth, 0.0)):
            a.append(v)
        low, high = own.min(axis=0), own.max(axis=0)
        open_ = np.flatnonzero(high > low)
        if d >= most or len(own) <= 1 or not len(open_):
            depth[me] = d + path_length(len(own))
            return me
        f = int(rng.choice(open_))
        t = rng.uniform(low[f], high[f])
        feature[me], threshold[me] = f, t
        left[me] = grow(own[own[:, f] <= t], d + 1)
        right[me] = grow(own[own[:, f] > t], d + 1)
        return me

    for _ in range(TREES):
        roots.append(grow(x[rng.choice(len(x), rows, replace=False)].astype(float), 0))
    return {"feature": np.array(feature, np.int8), "threshold": np.array(threshold, np.float32), "left": np.array(left, np.int32), "right": np.array(right, np.int32), "depth": np.array(depth, np.float32), "roots": roots, "most": most, "norm": max(path_length(rows), 1.0)}


def score_forest(model: dict, x: np.ndarray) -> np.ndarray:
    """2^(-mean depth / expected depth); equal feature rows are walked once."""
    if not len(x):
        return np.zeros(0)
    code = x.astype(np.int64) @ np.array([1 << 36, 1 << 24, 1 << 12, 1])
    _, first, back = np.unique(code, return_index=True, return_inverse=True)
    u = x[first].astype(np.float32)
    rows, total = np.arange(len(u)), np.zeros(len(u))
    for root in model["roots"]:
        at = np.full(len(u), root, dtype=np.int32)
        for _ in range(model["most"]):
            f = model["feature"][at]
            go_left = u[rows, np.maximum(f, 0)] <= model["threshold"][at]
            at = np.where(go_left, model["left"][at], model["right"][at])  # a leaf's children are itself
        total += model["depth"][at]
    return (2.0 ** (-total / len(model["roots"]) / model["norm"]))[back]


def _by_series(readings: DataFrame) -> DataFrame:
    return (
        readings.select(F.struct("symbol", "source").alias("k"), F.unix_date("event_date").alias("day"), "close", "volume")
        .select(F.xxhash64("k.symbol", "k.source").alias("series"), "k.symbol", "k.source", "day", "close", "volume")
        .repartition(python_tasks(readings.sparkSession), "symbol", "source")
        .sortWithinPartitions("symbol", "source", "day")
    )


def _per_field(pdf: pd.DataFrame) -> Iterator[tuple[str, np.ndarray, dict[str, np.ndarray], np.ndarray]]:
    series, day = pdf["series"].to_numpy(), pdf["day"].to_numpy()
    seg_all = np.cumsum(np.r_[False, series[1:] != series[:-1]])
    for field in FIELDS:
        raw = pdf[field].to_numpy(dtype=float)
        at = np.flatnonzero(~np.isnan(raw))
        if not len(at):
            continue
        _, seg = np.unique(seg_all[at], return_inverse=True)
        yield field, at, features(raw[at], seg, day[at], field), raw[at]


def _order(series: np.ndarray, day: np.ndarray) -> np.ndarray:
    """A hash of each reading, even over all 64 bits."""
    with np.errstate(over="ignore"):
        h = series.astype(np.uint64) + (day.astype(np.int64).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def score_limit(model: dict) -> float:
    """The least score the forest gives to a reading SPIKE_LIMIT or more usual variations away.

    Tried are all levels of the grid from there on, with a season that agrees, runs
    too short to be stuck and all differences up to one as large as the level.
    """
    tried = []
    for cell in range(int(np.round(np.arcsinh(SPIKE_LIMIT) * 4)), int(np.round(np.arcsinh(FAR) * 4)) + 1):
        away = np.sinh(cell / 4)
        for season in {int(np.round(np.arcsinh(max(away + d, 0)) * 3)) for d in (-3, 0, 3)}:
            for run in range(1, STUCK_RUN):
                tried += [(cell, difference, season, int(np.round(np.log2(run) * 2))) for difference in range(cell + 1)]
    return float(score_forest(model, np.unique(np.array(tried, dtype=np.int16), axis=0)).min())


def train(last: DataFrame) -> dict:
    """Forests by (source, field), each from the TREES x TREE_ROWS readings of the source and field that are lowest in a hash order.

    last: the readings of about SOURCES_AT_ONCE sources at most, as all forests come to the driver.
    """
    most = TREES * TREE_ROWS
    held = last.groupBy("source").agg(*[F.count_if(F.col(c).isNotNull() & ~F.isnan(c)).alias(c) for c in FIELDS]).collect()
    share = {(r.source, c): DRAWN * most / max(r[c], 1) for r in held for c in FIELDS}

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(batches, "series"):
            series, source, day = pdf["series"].to_numpy(), pdf["source"].to_numpy(), pdf["day"].to_numpy()
            code, names = pd.factorize(source, use_na_sentinel=False)
            for field, at, f, _ in _per_field(pdf):
                bound = np.array([share[(name if isinstance(name, str) else None, field)] for name in names])[code[at]]
                h = _order(series[at], day[at])
                drawn = np.flatnonzero(h / 2.0**64 < bound)
                if len(drawn):
                    x = f["x"][drawn]
                    yield pd.DataFrame({"source": source[at][drawn], "field": field, "h": (h[drawn] >> np.uint64(1)).astype(np.int64), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "d": x[:, 3]})

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(["h", "a", "b", "c", "d"])[["a", "b", "c", "d"]].to_numpy()[:most]  # the order of arrival must not matter
        model = train_forest(x)
        return pd.DataFrame({"source": [pdf["source"].iloc[0]], "field": [pdf["field"].iloc[0]], "model": [pickle.dumps({**model, "limit": score_limit(model)})]})

    found = (
        _by_series(last).mapInPandas(rows, "source string, field string, h bigint, a int, b int, c int, d int")
        .groupBy("source", "field").applyInPandas(fit, "source string, field string, model binary")
        .collect()
    )
    return {(r.source, r.field): pickle.loads(bytes(r.model)) for r in found}


def _scored(last: DataFrame, only_flagged: bool) -> DataFrame:
    """SCORED_SCHEMA rows of the readings of one group of sources."""
    models = last.sparkSession.sparkContext.broadcast(train(last))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(batches, "series"):
            symbol, source, day = pdf["symbol"].to_numpy(), pdf["source"].to_numpy(), pdf["day"].to_numpy()
            code, names = pd.factorize(source, use_na_sentinel=False)
            for field, at, f, value in _per_field(pdf):
                scores, limits = np.zeros(len(at)), np.zeros(len(at))
                for k, name in enumerate(names):
                    mine = code[at] == k
                    if mine.any():  # a field with readings has a forest; a KeyError rather than lost spikes
                        model = models.value[(name if isinstance(name, str) else None, field)]
                        scores[mine], limits[mine] = score_forest(model, f["x"][mine]), model["limit"]
                stuck = f["run"] >= STUCK_RUN
                spike = (scores >= limits) & f["brief"] & ~f["impossible"]
                keep = np.flatnonzero(stuck | spike | f["impossible"]) if only_flagged else np.arange(len(at))
                if len(keep):
                    yield pd.DataFrame({
                        "symbol": symbol[at][keep], "event_date": day[at][keep].astype("datetime64[D]").astype(object), "source": source[at][keep], "field": field, "value": value[keep], "score": scores[keep], "score_limit": limits[keep],
                        "deviation": f["deviation"][keep], "run_length": f["run"][keep].astype(np.int32), "is_impossible": f["impossible"][keep], "is_stuck": stuck[keep], "is_spike": spike[keep],
                    })

    return _by_series(last).mapInPandas(score, SCORED_SCHEMA)


def score_readings(prices: DataFrame, only_flagged: bool = False) -> DataFrame:
    """Every reading of close and volume with its score and flags (SCORED_SCHEMA), or the flagged ones.

    Defined cases: rows without symbol or date are left out, a null source is a
    source, null and NaN readings are no readings; a volume of 0 is possible,
    but infinitely low on the log scale, so a spike unless the readings around it are
    mostly 0 as well; a series of under AROUND + 1 readings has no
    spikes; an empty table gives no rows; other columns are ignored. A spike is a
    reading whose score reaches the score_limit of its source and field and which, as
    exact check, is one of at most SPIKE_READINGS in a row that lie more than
    SPIKE_LIMIT usual variations off to one side; stuck and impossible readings are
    explicit rules on the run-length feature and the value.
    """
    last = stash(last_readings(clean_bars(prices)), "last-readings")
    sources = last.agg(F.approx_count_distinct("source")).first()[0]
    groups = 1 + sources // SOURCES_AT_ONCE
    if groups == 1:
        return _scored(last, only_flagged)
    mine = F.pmod(F.xxhash64(F.coalesce("source", F.lit("\u0000"))), F.lit(groups))
    return reduce(DataFrame.unionByName, [_scored(last.where(mine == g), only_flagged) for g in range(groups)])
