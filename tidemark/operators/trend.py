"""A trend whose slope changes at a few months, found by an L1 penalty on the changes, with yearly Fourier terms.

The level, the first slope and the seasons are free; a change of slope may happen at each of ``knots`` months in the first part of a
history and costs in proportion to its size, so most stay zero. Histories of a batch that cover the same months share one matrix
and are solved together by coordinate descent; a series is done when its solution meets the conditions of the minimum exactly.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .forecast import log_histories

#: Knots, the part of a history that they cover, the prior scale of a change and the order of the seasons.
KNOTS, COVERED, FLEXIBILITY, ORDER = 25, 0.8, 0.05, 3


def knots(months: np.ndarray, count: int = KNOTS) -> np.ndarray:
    """Evenly spread months of the first part of a history, without its first."""
    last = int(np.floor(len(months) * COVERED)) - 1
    return months[np.unique(np.round(np.linspace(0, max(last, 0), count + 1)).astype(int))[1:]].astype(float)


def free(m: np.ndarray, first: float, span: float, order: int) -> np.ndarray:
    """Level, slope and seasons; time runs from 0 to 1 over the history."""
    k = np.arange(1, order + 1) * 2 * np.pi / 12
    return np.column_stack([np.ones(len(m)), (m - first) / span, np.sin(np.outer(m, k)), np.cos(np.outer(m, k))])


def hinges(m: np.ndarray, at: np.ndarray, span: float) -> np.ndarray:
    return np.maximum(m[:, None] - at, 0.0) / span


def _polished(gram: np.ndarray, cross: np.ndarray, penalty: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, found): the exact least of each series if the signs of ``d`` are its signs, and whether they are."""
    sign = np.sign(d).T
    on = sign != 0
    system = np.where(on[:, :, None] & on[:, None, :], gram, np.eye(len(gram)))
    system += np.eye(len(gram)) * 1e-13 * np.trace(gram)
    least = np.linalg.solve(system, np.where(on, cross.T - penalty[:, None] * sign, 0.0)[:, :, None])[:, :, 0]
    slack = np.abs(cross.T - least @ gram) <= penalty[:, None] + 1e-9 * (1 + np.abs(cross.T))
    return least.T, ((np.sign(least) == sign) & (on | slack)).all(axis=1)


def lasso(gram: np.ndarray, cross: np.ndarray, penalty: np.ndarray, rounds: int = 2_000, check: int = 20) -> np.ndarray:
    """For every column of ``cross`` the least of d'Gd/2 - c'd + penalty * sum |d|.

    Cyclic coordinate descent finds which changes are zero and the signs of the others; every ``check`` rounds the least with those
    signs is solved for, and a series for which it meets the conditions of the minimum leaves the rounds.
    """
    out = np.zeros_like(cross)
    live, use = np.arange(cross.shape[1]), np.flatnonzero(np.diag(gram) > 1e-12)
    for i in range(rounds):
        if not len(live):
            break
        d, c, p = out[:, live], cross[:, live], penalty[live]
        for j in use:
            r = c[j] - gram[j] @ d + gram[j, j] * d[j]
            d[j] = np.sign(r) * np.maximum(np.abs(r) - p, 0.0) / gram[j, j]
        out[:, live] = d
        if i % check == check - 1:
            left = []
            for at in np.array_split(live, -(-len(live) // 1_000)):
                least, found = _polished(gram, cross[:, at], penalty[at], out[:, at])
                out[:, at[found]] = least[:, found]
                left.append(at[~found])
            live = np.concatenate(left)
    return out


def fit(m: np.ndarray, y: np.ndarray, horizon: int, count: int = KNOTS, flexibility: float = FLEXIBILITY, order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(knots, changes, last slopes, forecast) of series (rows of y) over the same months. ``flexibility`` is the prior scale of a change of slope;
    infinite means no penalty, that is least squares.

    The penalty is the noise variance over that scale. The variance comes from second differences, which a changing slope hardly moves;
    residuals of a straight fit would count the changes as noise and so hide them."""
    m = np.asarray(m, float)
    span, at = max(m[-1] - m[0], 1.0), knots(m, count)
    z, h = free(m, m[0], span, order), hinges(m, at, span)
    q = np.linalg.svd(z, full_matrices=False)
    q = q[0][:, q[1] > 1e-10 * q[1][0]]  # a short history may not tell all seasons apart
    clean = lambda a: a - q @ (q.T @ a)
    rest, bent = clean(y.T), clean(h)
    gram, cross = bent.T @ bent, bent.T @ rest
    spread = (np.diff(rest, 2, axis=0) ** 2).mean(axis=0) / 6 * len(m) / max(len(m) - q.shape[1], 1)
    change = lasso(gram, cross, spread / flexibility)
    coef = np.linalg.lstsq(z, y.T - h @ change, rcond=None)[0]
    ahead = m[-1] + np.arange(1.0, horizon + 1)
    return at, change.T, coef[1] + change.sum(axis=0), (free(ahead, m[0], span, order) @ coef + hinges(ahead, at, span) @ change).T


def trend_fits(panel: DataFrame, origins: Sequence[int], horizon: int, min_train: int = 24, **options) -> DataFrame:
    """(entity, origin, last, f, slope, changes): forecasts of the ``horizon`` months after ``last``, the last month of the history; the
    slope there, and the changes of slope (month, change) that are not zero, both as log level a year."""
    kind = panel.schema["entity"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, part in frame.groupby(frame["m"].map(lambda m: np.asarray(m).tobytes()), sort=False):
                m = np.asarray(part["m"].iloc[0])
                at, change, slope, ahead = fit(m, np.stack(part["l"].to_numpy()), horizon, **options)
                year = 12 / max(m[-1] - m[0], 1)
                changes = [[{"month": int(k), "change": float(v)} for k, v in zip(at, row, strict=True) if abs(v) > 1e-6] for row in change * year]
                shown = {"last": m[-1], "f": list(np.exp(ahead)), "slope": slope * year, "changes": changes}
                yield pd.DataFrame({"entity": part["entity"].to_numpy(), "origin": part["origin"].to_numpy(), **shown})

    hist = log_histories(panel, origins, min_train)
    return hist.mapInPandas(run, f"entity {kind}, origin long, last long, f array<double>, slope double, changes array<struct<month: long, change: double>>")


def changepoint_trend(panel: DataFrame, origins: Sequence[int], horizon: int, min_train: int = 24, **options) -> DataFrame:
    """(entity, origin, h, month, yhat) of the series that have a value at their origin."""
    found = trend_fits(panel, origins, horizon, min_train, **options).where("last = origin")
    out = found.select("entity", "origin", F.posexplode("f").alias("h", "yhat"))
    return out.select("entity", "origin", (F.col("h") + 1).alias("h"), (F.col("origin") + F.col("h") + 1).alias("month"), "yhat")
