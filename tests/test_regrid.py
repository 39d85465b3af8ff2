import datetime as dt
import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidegrid.operators import regrid

COLUMNS = "series_id string, observation_date date, released_at timestamp, value double, unit string, frequency string, source string, source_record_id string, ingested_at timestamp"
D = dt.date
T = dt.datetime


def reading(day, value=1.0, freq="D", sid="s1", source="a", rid=None, released=None, ingested=T(2024, 6, 1)):
    return (sid, day, released, value, "u", freq, source, rid or f"{sid}{source}{day}", ingested)


def calendar(spark, days):
    return spark.createDataFrame([(d,) for d in days], "trade_date date")


def dense_smoother(days, mean, count, grid, q_level, q_slope):
    """Brute force: condition the joint normal of level and slope at all times on the readings."""
    times = np.union1d(days, grid).astype(float)
    n = len(times)
    F_, Q = [], []
    cov = np.zeros((2 * n, 2 * n))
    p = np.array([[1e6, 0.0], [0.0, 100.0 * (q_level + q_slope + 1e-9)]])
    blocks = [p]
    for i in range(1, n):
        d = times[i] - times[i - 1]
        f = np.array([[1, d], [0, 1]])
        q = q_level * np.array([[d, 0], [0, 0]]) + q_slope * np.array([[d**3 / 3, d**2 / 2], [d**2 / 2, d]])
        F_.append(f)
        Q.append(q)
        blocks.append(f @ blocks[-1] @ f.T + q)
    for i in range(n):
        c = blocks[i]
        cov[2 * i : 2 * i + 2, 2 * i : 2 * i + 2] = c
        for j in range(i + 1, n):
            c = F_[j - 1] @ c
            cov[2 * j : 2 * j + 2, 2 * i : 2 * i + 2] = c
            cov[2 * i : 2 * i + 2, 2 * j : 2 * j + 2] = c.T
    at = [2 * int(np.searchsorted(times, d)) for d in days]
    prior = mean[0]
    s = cov[np.ix_(at, at)] + np.diag(1.0 / np.asarray(count, float))
    g = [2 * int(np.searchsorted(times, d)) for d in grid]
    k = cov[np.ix_(g, at)] @ np.linalg.inv(s)
    level = prior + k @ (np.asarray(mean) - prior)
    var = np.diag(cov[np.ix_(g, g)]) - np.sum(k * cov[np.ix_(g, at)], axis=1)
    return level, var


def test_smoother_equals_joint_normal():
    rng = np.random.default_rng(1)
    days = np.array([0, 1, 4, 5, 9, 20, 21])
    mean, count = rng.normal(size=7), np.array([1, 2, 1, 1, 3, 1, 1])
    grid = np.arange(0, 22)
    times = np.union1d(days, grid)
    y, n = np.zeros(len(times)), np.zeros(len(times))
    y[np.searchsorted(times, days)], n[np.searchsorted(times, days)] = mean, count
    # a shorter series is filtered beside it
    gap, ys, ns, active = regrid._stacked([(times, y, n), (days[:3], mean[:3], count[:3])])
    _, _, used, steps = regrid.kalman_filter(gap, ys, ns, active, np.full((1, 2), 0.1), np.full((1, 2), 1e-3), keep=True)
    level, variance = regrid.rts_smooth(steps)
    want, want_var = dense_smoother(days, mean, count, grid, 0.1, 1e-3)
    assert used.tolist() == [6, 2]
    assert np.allclose(level[:, 0], want, atol=1e-4) and np.allclose(variance[:, 0], want_var, atol=1e-3)
    want, want_var = dense_smoother(days[:3], mean[:3], count[:3], days[:3], 0.1, 1e-3)
    assert np.allclose(level[:3, 1], want, atol=1e-4) and np.allclose(variance[:3, 1], want_var, atol=1e-3)


def test_series_smoothed_together_are_as_alone():
    rng = np.random.default_rng(4)
    many = []
    for k in (5, 1, 40, 12, 40):
        days = np.sort(rng.choice(100, k, replace=False))
        many.append((days, rng.normal(size=k).cumsum() + 50, rng.integers(1, 4, k), np.arange(days[0], days[-1] + 1)))
    for one, (level, sd) in zip(many, regrid.smooth_many(many)):
        alone = regrid.smooth_series(*one)
        assert np.allclose(level, alone[0]) and np.allclose(sd, alone[1]) and (sd > 0).all()


def test_several_readings_of_a_day_equal_their_mean():
    days, grid = np.array([0, 1, 2, 5]), np.arange(6)
    a = regrid.smooth_series(days, np.array([1.0, 2.0, 1.5, 4.0]), np.array([1, 1, 1, 1]), grid)
    b = regrid.smooth_series(days, np.array([1.0, 2.0, 1.5, 4.0]), np.array([1, 1, 50, 1]), grid)
    assert b[1][2] < a[1][2]  # more readings, less doubt
    assert a[1][4] > a[1][2]  # a gap, more doubt


def test_one_and_constant_readings():
    level, sd = regrid.smooth_series(np.array([3]), np.array([7.0]), np.array([1]), np.array([3]))
    assert level.tolist() == [7.0] and 0 < sd[0] < 0.01
    level, sd = regrid.smooth_series(np.array([0, 9]), np.array([7.0, 7.0]), np.array([1, 1]), np.arange(10))
    assert np.allclose(level, 7.0) and (sd > 0).all() and sd[5] > 1.2 * sd[0]  # nothing was seen in between


@pytest.mark.parametrize("freq,day,start", [("DAILY", "2024-02-29", "2024-02-29"), ("WEEKLY", "2024-03-03", "2024-02-26"), ("WEEKLY", "2024-03-04", "2024-03-04"), ("MONTHLY", "2024-02-29", "2024-02-01"), ("QUARTERLY", "2024-06-30", "2024-04-01"), ("ANNUAL", "1969-12-31", "1969-01-01")])
def test_period_starts(freq, day, start):
    got = regrid.period_starts(np.array([day], "datetime64[D]").astype(np.int64), freq)
    assert str(got.astype("datetime64[D]")[0]) == start


def test_grid_marks_gaps_and_ignores_what_does_not_count(spark):
    days = [D(2024, 1, d) for d in (2, 3, 4, 5, 8, 9)]
    data = [
        reading(D(2024, 1, 2)), reading(D(2024, 1, 5), 2.0), reading(D(2024, 1, 9), 3.0, freq=None),
        reading(D(2024, 1, 3), None), reading(D(2024, 1, 4), float("nan")),
        reading(D(2024, 1, 6), 5.0),  # closed day
        reading(D(2024, 1, 8), 5.0, released=T(2025, 1, 1)),  # released after ingestion
        reading(None), reading(D(2024, 1, 8), sid=None),
        reading(D(2024, 1, 4), 9.0, rid="late", ingested=T(2024, 6, 2)), reading(D(2024, 1, 4), None, rid=" late ", ingested=T(2024, 6, 3)),
        reading(D(2024, 1, 2)), reading(D(2024, 1, 2)),
        reading(D(2024, 2, 1), sid="none", freq="fortnightly"),
    ]
    raw = spark.createDataFrame(data, COLUMNS).withColumn("frequency_", F.lit(1)).withColumn("level", F.lit("clash")).withColumn("mean", F.lit(3)).withColumn("n", F.lit(3))
    got = rows(regrid.regrid(raw, calendar(spark, [*days, None])).select("series_id", "source", "period_start", "readings", "is_missing"))
    assert [(r[2].day, r[3], r[4]) for r in got] == [(2, 1, False), (3, 0, True), (4, 0, True), (5, 1, False), (8, 0, True), (9, 1, False)]
    assert {r[0] for r in got} == {"S1"}


def test_empty_and_null_tables(spark):
    empty = spark.createDataFrame([], COLUMNS)
    assert rows(regrid.regrid(empty, calendar(spark, []))) == []
    nulls = spark.createDataFrame([(None,) * 9] * 3, COLUMNS)
    assert rows(regrid.regrid(nulls, calendar(spark, [D(2024, 1, 2)]))) == []
    null_source = spark.createDataFrame([reading(D(2024, 1, 1), freq="m", source=None, rid="x"), reading(D(2024, 3, 1), freq="m", source=None, rid="y")], COLUMNS)
    assert [r[1] for r in rows(regrid.regrid(null_source, calendar(spark, [])).select("period_start", "is_missing"))] == [False, True, False]


def test_missing_levels_lie_near_a_line(spark):
    random.seed(3)
    days = [D(2024, 1, 1) + dt.timedelta(days=i) for i in range(200)]
    data = [reading(d, 0.5 * i + random.gauss(0, 0.2)) for i, d in enumerate(days) if not 80 <= i < 90]
    got = regrid.regrid(spark.createDataFrame(data, COLUMNS), calendar(spark, days)).where("is_missing").collect()
    assert len(got) == 10
    for r in got:
        assert abs(r.level - 0.5 * (r.period_start - days[0]).days) < max(4 * r.level_sd, 0.6)
