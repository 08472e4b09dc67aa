"""The six forms against loops over one series, and against every point of a grid."""

from __future__ import annotations

import itertools

import numpy as np
import pytest

from tidemark.operators import smoothing as S


def plain(form, p, y):
    """Deviance and last states, a value at a time."""
    alpha, beta, phi = p[0], p[1] if form.trend else 0.0, p[2] if form.damped else 1.0
    level, slope = (p[-2], p[-1]) if form.trend else (p[-1], 0.0)
    errors, logs = [], 0.0
    for v in y:
        expect = level + phi * slope
        if form.multiplicative:
            if expect <= 0:
                return S.OUTSIDE, None, None
            e = v / expect - 1
            level, slope, logs = expect * (1 + alpha * e), phi * slope + beta * expect * e, logs + np.log(expect)
        else:
            e = v - expect
            level, slope = expect + alpha * e, phi * slope + beta * e
        errors.append(e)
    return len(y) * np.log(max(sum(e * e for e in errors), 1e-12)) + 2 * logs, level, slope


def series(seed: int, n: int = 30) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.array([np.cumsum(rng.normal(0.1, 1, n)) + 50, 5 + rng.normal(0, 0.5, n), np.exp(np.cumsum(rng.normal(0.02, 0.1, n))), 10 + np.arange(n) * 0.7 + rng.normal(0, 1, n), rng.normal(0, 1, n)])


@pytest.mark.parametrize("form", S.FORMS, ids=str)
def test_deviance_and_states(form):
    y = series(1)
    p = np.array([[0.4, *([0.1] if form.trend else []), *([0.9] if form.damped else []), v[0], *([0.2] if form.trend else [])] for v in y])
    got = S.run(form, p, y)
    for i in range(len(y)):
        want = plain(form, p[i], y[i])
        assert got[0][i] == pytest.approx(want[0])
        if want[1] is not None:
            assert (got[1][i], got[2][i]) == pytest.approx(want[1:])


def test_outside_of_the_bounds():
    form, y = S.FORMS[2], series(2)[:1]
    for p in ([0.0, 0.1, 0.9, 50, 0], [0.3, 0.4, 0.9, 50, 0], [0.3, 0.1, 0.7, 50, 0], [0.3, 0.1, 0.99, 50, 0]):
        assert S.run(form, np.array([p]), y)[0][0] == S.OUTSIDE


@pytest.mark.parametrize("form", S.FORMS, ids=str)
def test_never_worse_than_the_grid_nor_than_points_nearby(form):
    y = series(3)[:4]
    p, deviance = S.fit(form, y)
    rng = np.random.default_rng(4)
    for i, v in enumerate(y):
        step = (v[3] - v[0]) / 3
        for a, b in itertools.product(S.GRID, S.GRID[:4] if form.trend else [0.0]):
            damp = 0.9 if form.damped else 1.0
            point = [a, *([a * b] if form.trend else []), *([damp] if form.damped else []), v[0] - step if form.trend else v[0], *([step / damp] if form.trend else [])]
            assert deviance[i] <= S.run(form, np.array([point]), v[None])[0][0] + 1e-9
        near = p[i] + rng.normal(size=(300, len(p[i]))) * 0.02 * np.maximum(np.abs(p[i]), 0.01)
        assert deviance[i] <= S.run(form, near, np.repeat(v[None], 300, axis=0))[0].min() + 0.02


def test_simplex_finds_minima_of_many_functions():
    goal = np.random.default_rng(5).normal(size=(40, 3))
    scale = np.array([1.0, 10.0, 0.1])
    found, value = S.simplex(lambda rows, x: (((x - goal[rows]) * scale) ** 2).sum(axis=1) + rows, np.zeros((40, 3)), np.full((40, 3), 0.1))
    assert np.abs(found - goal).max() < 1e-2 and np.allclose(value, np.arange(40), atol=1e-4)


def test_forecasts():
    line, flat = np.arange(24.0)[None] + 3, np.full((1, 15), 2.0)
    assert np.allclose(S.forecast(line, 3)[0], [[27, 28, 29]], atol=1e-3) and np.allclose(S.forecast(flat, 3)[0], 2, atol=1e-6)
    assert np.allclose(S.forecast(np.array([[1.0, 5.0, 2.0]]), 2)[0], 2) and S.forecast(np.array([[1.0, 5.0, 2.0]]), 2)[1][0] == -1
    y = series(6)
    together, chosen = S.forecast(y, 4)
    for i in range(len(y)):
        one, form = S.forecast(y[i : i + 1], 4)
        assert np.allclose(one[0], together[i]) and form[0] == chosen[i]
    assert chosen[4] < 3  # it has values below zero
    mixed = [y[0], y[1, :12], y[2, :20], y[3, :5], y[4, :3]]
    padded = S.forecast(mixed, 2)[0]
    for i, v in enumerate(mixed):
        assert np.allclose(S.forecast(v[None], 2)[0], padded[i])
    rng = np.random.default_rng(7)
    shares = np.exp(np.cumsum(rng.normal(0, 0.3, (30, 40)), axis=1))  # errors in proportion to the level
    assert (S.forecast(shares, 1)[1] >= 3).mean() > 0.8
