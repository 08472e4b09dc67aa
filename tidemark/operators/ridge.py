"""Ridge regression for all origins at once, from sums over rows.

A fit needs only weighted sums of features by features and by target. Rows are added up where they lie, apart by the first origin that knows them; an
origin's sums are those of its part and of all parts before. A missing value is a zero with a mark beside it, so the sums serve every
origin's own medians. What reaches the driver depends on origins and features, not on rows.

The model: features filled by their median in an origin's rows (the lower one, exact, however the rows are stored), months of the year as indicators, weighted
least squares with a penalty on the weights of standardised inputs, relative to the target's deviation. Features without a value or without variance have no weight.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quantiles import column_ranks

PENALTY = 0.1
MONTHS = 12
#: A variance below this share of the mean square is rounding.
_FLAT = 1e-12


def _solved(total: np.ndarray, shift: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
    """(intercept, weights) from the sums over (1, features, marks, months, target); ``shift`` is what a mark adds to its feature."""
    p = len(shift)
    design = np.zeros((1 + p + MONTHS + 1, len(total)))
    design[0, 0] = design[-1, -1] = 1
    design[range(1, p + 1), range(1, p + 1)] = 1
    design[range(1, p + 1), range(p + 1, 2 * p + 1)] = shift
    design[range(p + 1, p + 1 + MONTHS), range(2 * p + 1, 2 * p + 1 + MONTHS)] = 1
    square = design @ total @ design.T / total[0, 0]
    mean = square[0, 1:]
    spread = square[1:, 1:] - np.outer(mean, mean)
    scale = np.sqrt(np.where(np.diag(spread) > _FLAT * np.diag(square)[1:], np.diag(spread), 0))
    weights, use = np.zeros(len(scale) - 1), np.flatnonzero(scale[:-1])
    if scale[-1] and len(use):
        like = spread[np.ix_(use, use)] / np.outer(scale[use], scale[use]) + penalty / scale[-1] * np.eye(len(use))
        weights[use] = np.linalg.solve(like, spread[use, -1] / scale[use]) / scale[use]
    return float(mean[-1] - weights @ mean[:-1]), weights


def ridge(rows: DataFrame, origins: Sequence[int], features: Sequence[str], target: str = "g", penalty: float = PENALTY) -> DataFrame:
    """The rows at the origins (t) with a base, and ``prediction``, which is null where an origin knows no target.

    ``rows``, a stored table: t, month, base (the weight), the target and the features; ``moy`` among them is a month of the year, from 0. Few passes, whatever
    the number of origins: scales, medians, and sums.
    """
    origins, numeric = sorted(origins), [c for c in features if c != "moy"]
    clean = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in numeric}
    known = rows.where((F.col("month") <= origins[-1]) & F.col(target).isNotNull() & (F.col("base") > 0))
    moy = F.col("moy").cast("int") if "moy" in features else F.lit(-1)
    known = known.select("month", "base", F.col(target).alias("target"), moy.alias("moy"), *(clean[c].alias(f"x{i}") for i, c in enumerate(numeric)))
    first = sum(((F.col("month") > o).cast("int") for o in origins[:-1]), F.lit(0))  # the first origin that knows a row
    medians = column_ranks(known.withColumn("part", first), [f"x{i}" for i in range(len(numeric))], lambda n: [(n - 1) // 2], "part", len(origins))
    row = known.agg(F.lit(0), *(f(f"x{i}").alias(f"{n}{i}") for n, f in (("a", F.avg), ("d", F.stddev_pop)) for i in range(len(numeric)))).first()
    centre = np.array([row[f"a{i}"] or 0.0 for i in range(len(numeric))])
    width = np.array([row[f"d{i}"] or 1.0 for i in range(len(numeric))])
    size = 2 + 2 * len(numeric) + MONTHS

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for frame in frames:
            x = (frame[[f"x{i}" for i in range(len(centre))]].to_numpy(float) - centre) / width
            lost = np.isnan(x)
            a = np.column_stack([np.ones(len(x)), np.where(lost, 0.0, x), lost, frame["moy"].to_numpy()[:, None] == np.arange(MONTHS), frame["target"]])
            part, w = np.searchsorted(origins, frame["month"]), frame["base"].to_numpy(float)[:, None]
            for k in np.unique(part).tolist():
                some = a[part == k]
                total[k] = total.get(k, 0.0) + (some * w[part == k]).T @ some
        if total:
            yield pd.DataFrame({"part": list(total), "m": [m.ravel() for m in total.values()]})

    sums = known.mapInPandas(add, "part long, m array<double>").select("part", F.posexplode("m").alias("at", "v")).groupBy("part", "at").agg(F.sum("v").alias("v"))
    parts = np.zeros((len(origins), size * size))
    for r in sums.collect():  # parts x size x size
        parts[r["part"], r["at"]] = r["v"]
    models = []
    for k, total in enumerate(np.cumsum(parts, axis=0).reshape(len(origins), size, size)):
        if total[0, 0] > 0:
            middle = np.array([medians[k][i][1][0] if medians[k][i][0] else c for i, c in enumerate(centre)])
            start, w = _solved(total, (middle - centre) / width, penalty)
            own = w[: len(numeric)] / width
            models.append((origins[k], float(start - own @ centre), own.tolist(), middle.tolist(), w[len(numeric) :].tolist()))
    table = rows.sparkSession.createDataFrame(models, "t long, _start double, _w array<double>, _fill array<double>, _moy array<double>")
    guess = F.col("_start") + F.coalesce(F.get("_moy", moy), F.lit(0.0))
    for i, c in enumerate(numeric):
        guess = guess + F.col("_w")[i] * F.coalesce(clean[c], F.col("_fill")[i])
    test = rows.where(F.col("t").isin(origins) & (F.col("base") > 0))
    return test.join(F.broadcast(table), "t", "left").withColumn("prediction", guess).drop("_start", "_w", "_fill", "_moy")
