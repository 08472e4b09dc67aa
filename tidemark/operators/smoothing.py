"""Exponential smoothing without seasons: six state-space forms, fitted to many series at once.

A form has additive or multiplicative errors, and no trend, a trend, or a damped one. Its weights, damping and initial states are free and are found by the
simplex method, which runs as array code on all series of a batch: each keeps its own simplex, and drops out when that has shrunk. Series of
different lengths are padded with NaN at their ends; a state isn't moved there.
The simplex starts from the better of two points, a line through the first values and the best of a coarse grid, and twice more from
where it ended, so the likelihood is never worse than the grid's. The form is chosen by AICc.

Cases: multiplicative errors are tried only where all values are positive; a form with too many parameters for the length is left out; where none is
left, the last value is repeated; ties go to the simpler form, additive first; a constant series is forecast as itself.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

#: The bounds of the level's weight, the trend's weight and the damping.
LOWER, UPPER = np.array([1e-4, 1e-4, 0.8]), np.array([0.9999, 0.9999, 0.98])
#: What a point outside of the bounds costs.
OUTSIDE = 1e10
GRID = np.array([0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9])
#: Series that are worked on at a time.
WIDTH = 8192
_LEAST = 1e-12  #: of a sum of squares, so that a perfect fit has a logarithm


@dataclass(frozen=True)
class Form:
    multiplicative: bool
    trend: bool
    damped: bool

    @property
    def size(self) -> int:
        """Parameters: weights, damping, initial states."""
        return 2 + 2 * self.trend + self.damped

    def parts(self, p: np.ndarray) -> tuple[np.ndarray, ...]:
        """(level's weight, trend's weight, damping, level, slope) of parameter rows."""
        n, zero, one = len(p), np.zeros(len(p)), np.ones(len(p))
        if not self.trend:
            return p[:, 0], zero, one, p[:, 1], zero
        return p[:, 0], p[:, 1], p[:, 2] if self.damped else np.ones(n), p[:, -2], p[:, -1]


FORMS = [Form(m, t, d) for m in (False, True) for t, d in ((False, False), (True, False), (True, True))]


class Block:
    """Series (rows, padded with NaN at their ends) laid out by time, so that a step in time reads neighbours in memory."""

    def __init__(self, y: np.ndarray) -> None:
        self.values = np.ascontiguousarray(y.T)
        self.known = ~np.isnan(self.values)
        self.whole = self.known.all(axis=1)
        self.count = self.known.sum(axis=0)

    def run(self, form: Form, p: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As the function ``run``, for some of the series. Arrays are reused from step to step."""
        alpha, beta, phi, level, slope = (np.array(c) for c in form.parts(p))
        n, seen, valid = len(rows), np.ones(len(rows), bool), np.ones(len(rows), bool)
        squares, logs, e, step = np.zeros(n), np.zeros(n), np.empty(n), np.empty(n)
        with np.errstate(all="ignore"):
            for t, y in enumerate(self.values):
                whole = self.whole[t]
                if not whole:
                    seen, before = self.known[t, rows], (level.copy(), slope.copy())
                if form.damped:
                    slope *= phi
                if form.trend:
                    level += slope
                y.take(rows, out=e, mode="clip")
                e -= level
                if form.multiplicative:
                    expect = level.copy()
                np.multiply(alpha, e, out=step)
                level += step
                if form.trend:
                    np.multiply(beta, e, out=step)
                    slope += step
                if form.multiplicative:
                    valid &= (expect > 0) | ~seen
                    e /= expect
                    np.log(np.abs(expect, out=expect), out=expect)
                    logs += expect if whole else np.where(seen, expect, 0.0)
                if not whole:
                    level, slope, e = np.where(seen, level, before[0]), np.where(seen, slope, before[1]), np.where(seen, e, 0.0)
                np.multiply(e, e, out=step)
                squares += step
            deviance = self.count[rows] * np.log(np.maximum(squares, _LEAST)) + 2 * logs
        inside = (alpha >= LOWER[0]) & (alpha <= UPPER[0])
        if form.trend:
            inside &= (beta >= LOWER[1]) & (beta <= np.minimum(UPPER[1], alpha))
        if form.damped:
            inside &= (phi >= LOWER[2]) & (phi <= UPPER[2])
        return np.where(inside & valid & np.isfinite(deviance), np.minimum(deviance, OUTSIDE), OUTSIDE), level, slope


def run(form: Form, p: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(deviance, level, slope) of each series (a row of y) under its parameters; the states are those after the last value."""
    return Block(y).run(form, p, np.arange(len(y)))


def simplex(cost, start: np.ndarray, steps: np.ndarray, limit: int = 500, close: float = 1e-6, again=None, rounds: int = 1, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Minima of many functions at once by the simplex method: (points, values).

    ``cost(rows, points)`` gives the values of the functions ``rows`` at ``points``, a row each. ``steps`` are the sizes of the first simplex. A
    function drops out when its simplex and its values have shrunk below ``close``; ``rounds`` above one begin anew from where it ended, at the point and
    with the steps that ``again(points)`` gives. About ``width`` functions are worked on at a time, and others take the place of those that drop
    out: arrays stay long enough for their calls and short enough for the cache, and only the last functions of all are few. What a function
    finds doesn't depend on the others.
    """
    n, k = start.shape
    out, least = np.empty((n, k)), np.empty(n)
    points, values = np.empty((k + 1, k, 0)), np.empty((k + 1, 0))  # by vertex and parameter
    rows, age, turn = np.empty(0, int), np.empty(0, int), np.empty(0, int)
    waiting, first, size_of, number = np.arange(n), start, steps, np.zeros(n, int)  # to begin: functions, points, steps, rounds done
    while True:
        room = width - len(rows)
        if len(waiting) and min(room, len(waiting)) >= len(rows) // 4:
            new, at, by = waiting[:room], first[:room], size_of[:room]
            p = np.repeat(at.T[None], k + 1, axis=0)
            p[np.arange(1, k + 1), np.arange(k)] += by.T
            v = cost(np.tile(new, k + 1), p.transpose(0, 2, 1).reshape(-1, k)).reshape(k + 1, -1)
            points, values = np.concatenate([points, p], axis=2), np.concatenate([values, v], axis=1)
            rows, age, turn = np.concatenate([rows, new]), np.concatenate([age, np.zeros(len(new), int)]), np.concatenate([turn, number[:room]])
            waiting, first, size_of, number = waiting[room:], first[room:], size_of[room:], number[room:]
        if not len(rows):
            return out, least
        order = np.argsort(values, axis=0, kind="stable")
        points, values = np.take_along_axis(points, order[:, None], axis=0), np.take_along_axis(values, order, axis=0)
        size = np.abs(points[1:] - points[0]).max(axis=(0, 1)) / (1 + np.abs(points[0]).max(axis=0))
        open_ = ((size > close) | (values[-1] - values[0] > close)) & (age < limit)
        if not open_.all():
            done, found = rows[~open_], points[0][:, ~open_].T
            out[done], least[done] = found, values[0, ~open_]
            more = turn[~open_] + 1 < rounds
            if more.any():
                at, by = again(found[more])
                waiting, number = np.concatenate([waiting, done[more]]), np.concatenate([number, turn[~open_][more] + 1])
                first, size_of = np.concatenate([first, at]), np.concatenate([size_of, by])
            points, values, rows, age, turn = points[:, :, open_], values[:, open_], rows[open_], age[open_], turn[open_]
            if not len(rows):
                continue
        age += 1
        centre, worst = points[:-1].mean(axis=0), points[-1]
        mirrored = 2 * centre - worst
        at_mirror = cost(rows, mirrored.T)
        best, second = at_mirror < values[0], at_mirror < values[-2]
        outside = ~second & (at_mirror < values[-1])
        # farther where the mirror image is the best, halfway to it or back where it is hardly better than the worst, or no better
        factor = np.where(best, 2.0, np.where(outside, 0.5, -0.5))
        tried = centre + factor * (centre - worst)
        ask = best | ~second
        at_tried = np.full(len(rows), np.inf)
        at_tried[ask] = cost(rows[ask], tried[:, ask].T)
        take = np.where(best, at_tried < at_mirror, ask & (at_tried < np.minimum(at_mirror, values[-1])))
        keep = ~take & second  # the mirror image itself
        points[-1] = np.where(take, tried, np.where(keep, mirrored, worst))
        values[-1] = np.where(take, at_tried, np.where(keep, at_mirror, values[-1]))
        if len(shrink := np.flatnonzero(~take & ~keep)):
            p = (points[1:, :, shrink] + points[:1, :, shrink]) / 2
            points[1:, :, shrink] = p
            values[1:, shrink] = cost(np.tile(rows[shrink], k), p.transpose(0, 2, 1).reshape(-1, k)).reshape(k, -1)


def starts(form: Form, y: np.ndarray) -> list[np.ndarray]:
    """Points to begin from: a line through the first ten values; and every point of a grid that begins at the first value."""
    n, m = y.shape[0], min(10, y.shape[1])
    x = np.arange(1, m + 1) - (m + 1) / 2
    mean = y[:, :m].mean(axis=1)
    slope = (y[:, :m] @ x) / max((x * x).sum(), 1e-300)
    row = lambda a, b, phi, level, b0: np.column_stack([np.full(n, a), *([np.full(n, b)] if form.trend else []), *([np.full(n, phi)] if form.damped else []), level, *([b0] if form.trend else [])])
    alpha = LOWER[0] + 0.2 * (UPPER[0] - LOWER[0])
    beta, phi = LOWER[1] + 0.1 * (alpha - LOWER[1]), LOWER[2] + 0.99 * (UPPER[2] - LOWER[2])
    out = [row(alpha, beta, phi, mean - slope * (m + 1) / 2 if form.trend else mean, slope)]
    step = min(3, y.shape[1] - 1)
    first = (y[:, step] - y[:, 0]) / max(1, step)
    damp = 0.9 if form.damped else 1.0
    for a in GRID:
        for b in GRID[:4] if form.trend else (0.0,):
            out.append(row(a, a * b, damp, y[:, 0] - first if form.trend else y[:, 0], first / damp))
    return out


def bounded(form: Form, p: np.ndarray) -> np.ndarray:
    """The nearest parameters inside of the bounds, so that a simplex can lie along one."""
    p = p.copy()
    p[:, 0] = p[:, 0].clip(LOWER[0], UPPER[0])
    if form.trend:
        p[:, 1] = np.minimum(p[:, 1].clip(LOWER[1], UPPER[1]), p[:, 0])
    if form.damped:
        p[:, 2] = p[:, 2].clip(LOWER[2], UPPER[2])
    return p


def fit(form: Form, y: np.ndarray, rounds: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(parameters, deviance) of the form for each series."""
    begin, value, block = None, np.full(len(y), np.inf), Block(y)
    for p in starts(form, y):
        found = block.run(form, p, np.arange(len(y)))[0]
        begin = p if begin is None else np.where((found < value)[:, None], p, begin)
        value = np.minimum(value, found)

    def again(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin = bounded(form, p)
        steps = np.where(begin != 0, 0.05 * np.abs(begin), 0.00025)
        steps[:, 0] = np.where(begin[:, 0] > 0.5, -steps[:, 0], steps[:, 0])  # towards the inside
        return begin, steps

    p, value = simplex(lambda rows, p: block.run(form, bounded(form, p), rows)[0], *again(begin), again=again, rounds=rounds)
    return bounded(form, p), value


def forecast(series: Sequence[np.ndarray], horizon: int) -> tuple[np.ndarray, np.ndarray]:
    """(forecasts (series, horizon), number of the chosen form or -1) of series of any lengths."""
    lengths = np.array([len(v) for v in series])
    out, chosen = np.zeros((len(series), horizon)), np.full(len(series), -1)
    heads = np.minimum(lengths, 10)  # a simplex starts from as many values
    for head in np.unique(heads):
        at = np.flatnonzero(heads == head)
        y = np.full((len(at), lengths[at].max()), np.nan)
        for row, i in enumerate(at.tolist()):
            y[row, : lengths[i]] = series[i]
        out[at], chosen[at] = _forecast(y, lengths[at], horizon)
    return out, chosen


def _forecast(y: np.ndarray, n: np.ndarray, horizon: int) -> tuple[np.ndarray, np.ndarray]:
    best, chosen = np.full(len(y), np.inf), np.full(len(y), -1)
    out = np.repeat(y[np.arange(len(y)), n - 1][:, None], horizon, axis=1)
    positive = np.where(np.isnan(y), 1, y).min(axis=1) > 0
    for number, form in enumerate(FORMS):
        k = form.size + 1
        some = np.flatnonzero((n - k - 1 > 0) & (positive if form.multiplicative else True))
        if not len(some):
            continue
        p, deviance = fit(form, y[some])
        score = deviance + 2 * k + 2 * k * (k + 1) / (n[some] - k - 1)
        better = (deviance < OUTSIDE) & (score < best[some] - 1e-9)
        _, level, slope = run(form, p, y[some])
        phi = form.parts(p)[2]
        ahead = np.cumsum(phi[:, None] ** np.arange(1, horizon + 1), axis=1)
        at = some[better]
        best[at], chosen[at], out[at] = score[better], number, (level[:, None] + slope[:, None] * ahead)[better]
    return out, chosen
