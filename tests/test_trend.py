"""Trends with changes of slope: planted ones, optimality, least squares without a penalty."""

from __future__ import annotations

import numpy as np
import pytest

from tidemark.operators import trend as T
from tidemark.plans.base import setting
from tidemark.plans.catalog import QUERIES
from tidemark.plans.forecast_queries import full

MONTHS = np.arange(24_000, 24_072)


def _series(breaks: dict[int, float], slope: float = 0.0, noise: float = 0.004, seed: int = 1) -> np.ndarray:
    t = (MONTHS - MONTHS[0]) / 12
    y = 5 + slope * t + 0.1 * np.sin(2 * np.pi * MONTHS / 12) + noise * np.random.default_rng(seed).normal(size=len(t))
    return y + sum(v * np.maximum(t - k / 12, 0) for k, v in breaks.items())


def test_planted_changes_are_found():
    y = np.stack([_series({}, 0.1), _series({24: 0.4}, 0.05), _series({20: -0.3, 40: 0.5})])
    at, change, slope, ahead = T.fit(MONTHS, y, 6)
    yearly = change * 12 / (MONTHS[-1] - MONTHS[0])
    assert np.abs(yearly[0]).sum() < 0.02
    for row, planted in ((yearly[1], {24: 0.4}), (yearly[2], {20: -0.3, 40: 0.5})):
        for k, v in planted.items():
            near = np.abs(at - MONTHS[0] - k) <= 4
            assert row[near].sum() == pytest.approx(v, rel=0.15)
        assert (np.abs(row) < 1e-9).sum() >= 12  # most months keep the slope
    assert slope * 12 / 71 == pytest.approx([0.1, 0.45, 0.2], abs=0.04)
    want = 5 + 0.05 * 72 / 12 + 0.4 * 48 / 12 + 0.1 * np.sin(2 * np.pi * (MONTHS[-1] + 1) / 12)
    assert ahead[1, 0] == pytest.approx(want, abs=0.03)


def test_lasso_is_optimal():
    """The conditions of a minimum, for each series: the slope of the loss is the penalty where a change is not zero, and within it elsewhere."""
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(40, 8)), rng.normal(size=(40, 5))
    penalty = np.array([0.0, 0.5, 2.0, 8.0, 1e6])
    gram, cross = x.T @ x, x.T @ y
    d = T.lasso(gram, cross, penalty)
    slope = cross - gram @ d
    assert np.allclose(np.where(d != 0, slope - np.sign(d) * penalty, 0), 0, atol=1e-6)
    assert (np.abs(slope) <= penalty + 1e-6).all() and not d[:, 4].any()
    assert np.allclose(d[:, 0], np.linalg.lstsq(x, y[:, 0], rcond=None)[0], atol=1e-7)


def test_no_penalty_is_least_squares():
    y = np.stack([_series({24: 0.4}), _series({30: -0.2}, seed=2)])
    at, _, _, ahead = T.fit(MONTHS, y, 3, count=4, flexibility=np.inf)
    m, future, span = MONTHS.astype(float), MONTHS[-1] + np.arange(1.0, 4), float(MONTHS[-1] - MONTHS[0])
    design = lambda k: np.column_stack([T.free(k, m[0], span, 3), T.hinges(k, at, span)])
    want = design(future) @ np.linalg.lstsq(design(m), y.T, rcond=None)[0]
    assert np.allclose(ahead, want.T, atol=1e-5)


def test_series_of_a_batch_dont_touch_each_other():
    y = np.stack([_series({24: 0.4}), _series({}, seed=5), _series({40: -0.6}, noise=0.05)])
    both = T.fit(MONTHS, y, 3)[3]
    for i in range(3):
        assert np.allclose(both[i], T.fit(MONTHS, y[i : i + 1], 3)[3][0], atol=1e-6)


def test_gaps_and_short_histories(spark):
    rows = [(1, int(m), float(np.exp(v))) for m, v in zip(MONTHS, _series({24: 0.4}), strict=True)]
    rows += [(2, *r[1:]) for r in rows if r[1] % 7] + [(3, *r[1:]) for r in rows[:10]] + [(4, r[1], -1.0) for r in rows]
    rows += [(5, *r[1:]) for r in rows[:40]]  # none at the origin
    df = spark.createDataFrame(rows, "entity long, month long, value double")
    got = T.changepoint_trend(df, [24_060, 24_071], 2).toPandas()
    assert set(map(tuple, got[["entity", "origin"]].drop_duplicates().to_numpy())) == {(1, 24_060), (1, 24_071), (2, 24_060), (2, 24_071)}
    assert (got.month == got.origin + got.h).all() and set(got.h) == {1, 2} and np.isfinite(got.yhat).all()
    assert T.changepoint_trend(df.limit(0), [24_060], 2).count() == 0


def test_queries(spark, sf_dir):
    at = setting(spark, sf_dir)
    p = full(at).toPandas()
    rows = QUERIES["changepoint_trend_forecast"](spark, sf_dir).toPandas()
    assert len(rows) == p.entity.nunique() * len(at.origins) * 3
    for r in rows[rows.h == 2].iloc[:5].itertuples():
        hist = p[(p.entity == r.entity) & (p.month <= r.origin)].sort_values("month")
        assert r.yhat == pytest.approx(np.exp(T.fit(hist.month.to_numpy(), np.log(hist.value.to_numpy())[None], 2)[3][0, 1]), rel=1e-6)
    ends = QUERIES["trend_changes"](spark, sf_dir).toPandas()
    assert set(ends.entity) == set(p.entity) and ends.last_change.isna().equals(ends.changes == 0)
