"""Random forests of a weighted mean, for many training windows and seeds at once.

Rows are binned and packed into blocks in order of their months, as for boosting. A *tree* belongs to an origin and a seed; it sees the rows whose target month
is known at the origin, each as often as a Poisson draw from its key, seed and number says, so nothing is written for a tree. All trees of all origins grow
a level in one pass: a task adds up weights and weighted targets by tree, node, drawn feature and bin; Spark adds up the tasks' sums, and only these (trees x nodes x
drawn features x bins, whatever the number of rows) reach the driver, which picks the splits. Nothing is cached.

Cuts lie at quantiles of the rows that the earliest origin knows, to about one part in two thousand of a value, counted in one pass. A missing value takes the bin of its feature's median
in the rows that the origin knows. A node may split on a third of the features, drawn anew for each; a leaf's value is its weighted mean; a forest's that of its trees.

Cases: rows without a target or with a weight that isn't positive aren't learned from; an origin without rows predicts null; ties go to the feature drawn first and the lowest cut.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import delete, stored
from .boosting import KINDS, STORAGE, by_feature, coded, packed


@dataclass(frozen=True)
class Params:
    trees: int = 30
    depth: int = 6
    bins: int = 32


def _draws() -> np.ndarray:
    """How often a row is drawn, for each value of 16 random bits: Poisson with mean one."""
    k = np.arange(9)
    chance = np.exp(-1) / np.cumprod(np.maximum(k, 1))
    return np.searchsorted(np.cumsum(chance), (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


DRAWS = _draws()


def drawn(keys: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often a tree of a seed sees each row; four trees share a hash."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64(seed + 1) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(tree // 4 + 1) * np.uint64(0xD1B54A32D192ED03)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    return DRAWS[(x >> np.uint64(16 * (tree % 4))).astype(np.uint16)]


def edges_of(rows: DataFrame, features: Sequence[str], known: str, bins: int) -> dict[int, np.ndarray]:
    """Each feature's cuts, at quantiles of the rows for which ``known`` holds. Values are counted by their sign, exponent and first eleven binary
    digits, in order; a cut is the largest value of its cell. One pass; what is kept of a feature are some thousand cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, c in enumerate(features):
                x = b.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False)
                x = np.sort(x[~np.isnan(x)]) + 0.0
                bits = x.astype(np.float32).view(np.int32).astype(np.int64)
                cell = np.where(bits < 0, -(bits & 0x7FFFFFFF), bits) >> 12
                if len(cell):
                    last = np.flatnonzero(np.r_[cell[1:] != cell[:-1], True])
                    yield pa.RecordBatch.from_pydict({"i": np.full(len(last), i, np.int32), "cell": cell[last], "n": np.diff(last, prepend=-1), "top": x[last]})

    found = rows.where(known).select(*features).mapInArrow(run, "i int, cell long, n long, top double").groupBy("i", "cell").agg(F.sum("n").alias("n"), F.max("top").alias("top")).toArrow()
    i, cell, n, top = (found[c].to_numpy() for c in ("i", "cell", "n", "top"))
    out = {}
    for k in np.unique(i).tolist():
        own = np.flatnonzero(i == k)
        own = own[np.argsort(cell[own])]
        upto = np.cumsum(n[own])
        places = np.searchsorted(upto, np.arange(1, bins) / bins * upto[-1])
        out[k] = np.unique(top[own][places])
    return out


class Grower:
    """Trees of all (origin, seed) on rows (codes, month, target, weight, key), which hold only what may be learned from."""

    def __init__(self, rows: DataFrame, usable: Sequence[int], features: int, missing: int, groups: Sequence[tuple[int, int]], params: Params):
        self.features, self.missing, self.params, self.usable = features, missing, params, np.asarray(usable, int)
        self.origins = sorted({o for o, _ in groups})
        self.trees = [(o, s, k) for s in sorted({s for _, s in groups}) for k in range(params.trees) for o in self.origins if (o, s) in set(groups)]
        self.blocks, self.folder = stored(packed(rows, features), **STORAGE)
        nodes = 2**params.depth - 1
        self.feature, self.cut = np.zeros((len(self.trees), nodes), np.int64), np.full((len(self.trees), nodes), 255, np.int64)
        self.gain = np.zeros((len(self.trees), nodes))
        self.value = np.full((len(self.trees), 2 * nodes + 1), np.nan)
        self.fill = np.full((len(self.origins), features), missing)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "blocks"}  # what tasks need

    def _read(self, batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
        for b in batches:
            for i in range(b.num_rows):
                own = {c: np.frombuffer(b.column(c)[i].as_buffer(), k) for c, k in KINDS.items()}
                yield own | {"codes": own["codes"].reshape(self.features, -1)}

    def filled(self, codes: np.ndarray, origin: int) -> np.ndarray:
        """Codes by feature, then row, with the origin's medians in place of missing values."""
        return np.where(codes == self.missing, self.fill[self.origins.index(origin)][:, None].astype(np.uint8), codes)

    def descend(self, t: int, flat: np.ndarray, size: int, rows: np.ndarray, levels: int) -> np.ndarray:
        """The place of rows among the nodes of a level; ``flat``: codes of ``size`` rows, feature after feature."""
        at = np.zeros(len(rows), np.intp)
        for level in range(levels):
            own = slice(2**level - 1, 2 ** (level + 1) - 1)
            codes = flat.take((self.feature[t, own] * size).take(at) + rows)
            at = 2 * at + (codes > self.cut[t, own].take(at))
        return at

    def _medians(self) -> None:
        """The bin of each feature's median, by origin."""
        cells = self.missing + 1

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = np.zeros((len(self.origins), self.features, cells), np.int64)
            for r in self._read(batches):
                for o, end in enumerate(np.searchsorted(r["month"], self.origins, "right").tolist()):
                    for f in range(self.features):
                        n[o, f] += np.bincount(r["codes"][f, :end], minlength=cells)
            yield pa.RecordBatch.from_pydict({"cell": np.arange(n.size), "n": n.ravel()})

        found = self.blocks.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        n = np.zeros(len(self.origins) * self.features * cells, np.int64)
        n[found["cell"].to_numpy()] = found["n"].to_numpy()
        upto = n.reshape(len(self.origins), self.features, cells)[:, :, : self.missing].cumsum(axis=2)
        half = (upto[:, :, -1:] + 1) // 2
        self.fill = np.where(upto[:, :, -1] > 0, (upto < half).sum(axis=2), 0)

    def _level(self, level: int, drawn_features: np.ndarray) -> np.ndarray:
        """(tree, draw, node, bin, (weight, weighted target)) of a level."""
        nodes, bins, draws = 2**level, self.missing, drawn_features.shape[2]
        shape = (len(self.trees), draws, nodes, bins)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((2, *shape))
            for r in self._read(batches):
                size = r["codes"].shape[1]
                ends = np.searchsorted(r["month"], self.origins, "right")
                flats = [self.filled(r["codes"][:, :e], o).ravel() for o, e in zip(self.origins, ends, strict=True)]
                before = None
                for t, (origin, seed, number) in enumerate(self.trees):
                    if before != (seed, number):
                        times = drawn(r["key"], seed, number)
                        seen = np.flatnonzero(times)
                        w = r["weight"][seen] * times[seen]
                        s, before = w * r["target"][seen], (seed, number)
                    o = self.origins.index(origin)
                    if not (n := int(np.searchsorted(seen, ends[o]))):
                        continue
                    rows, flat, size = seen[:n], flats[o], int(ends[o])
                    at = self.descend(t, flat, size, rows, level)
                    for j in range(draws):
                        cell = at * bins + flat.take((drawn_features[t, :, j] * size).take(at) + rows)
                        total[0, t, j] += np.bincount(cell, w[:n], nodes * bins).reshape(nodes, bins)
                        total[1, t, j] += np.bincount(cell, s[:n], nodes * bins).reshape(nodes, bins)
            w, s = total.reshape(2, -1)
            at = np.flatnonzero(w)
            for i in range(0, len(at), 1 << 16):
                some = at[i : i + (1 << 16)]
                yield pa.RecordBatch.from_pydict({"cell": some, "w": w[some], "s": s[some]})

        out = np.zeros((int(np.prod(shape)), 2))
        found = self.blocks.mapInArrow(run, "cell long, w double, s double").groupBy("cell").agg(F.sum("w").alias("w"), F.sum("s").alias("s")).toArrow()
        out[found["cell"].to_numpy()] = np.column_stack([found[c].to_numpy() for c in "ws"])
        return out.reshape(*shape, 2)

    def _split(self, level: int, draws: np.ndarray, sums: np.ndarray) -> None:
        nodes, first = 2**level, 2**level - 1
        left = sums.cumsum(axis=3)
        total = left[:, :1, :, -1:]
        right = total - left
        score = lambda x: np.divide(x[..., 1] ** 2, x[..., 0], where=x[..., 0] > 0, out=np.zeros(x.shape[:-1]))
        least = 1e-12 * total[..., 0]
        gain = np.where((left[..., 0] > least) & (right[..., 0] > least), score(left) + score(right) - score(total), -np.inf)
        gain = gain.transpose(0, 2, 1, 3).reshape(len(self.trees), nodes, -1)  # tree, node, (draw, bin)
        best = gain.argmax(axis=2)
        t, node = np.indices(best.shape)
        j, cut = best // self.missing, best % self.missing
        top = gain[t, node, best]
        own = sums[:, 0].sum(axis=2)
        mean = np.divide(own[..., 1], own[..., 0], where=own[..., 0] > 0, out=np.full(own.shape[:-1], np.nan))
        at = slice(first, first + nodes)
        mean = self.value[:, at] = np.where(own[..., 0] > 0, mean, self.value[:, at])
        goes = top > 1e-12 * np.maximum(score(total)[:, 0, :, 0], 1e-300)
        self.feature[:, at] = np.where(goes, draws[t, node, j], 0)
        self.cut[:, at] = np.where(goes, cut, 255)
        self.gain[:, at] = np.where(goes, top, 0.0)
        ends = [np.divide(x[t, j, node, cut][..., 1], x[t, j, node, cut][..., 0], where=goes, out=mean.copy()) for x in (left, right)]
        self.value[:, 2 * first + 1 : 2 * first + 1 + 2 * nodes] = np.stack(ends, axis=2).reshape(len(self.trees), -1)

    def grow(self) -> None:
        self._medians()
        several = -(-len(self.usable) // 3)
        for level in range(self.params.depth):
            draws = np.zeros((len(self.trees), 2**level, several), np.int64)
            for t, (origin, seed, number) in enumerate(self.trees):
                rng = np.random.default_rng([seed, number, level, abs(origin)])
                draws[t] = self.usable[rng.random((2**level, len(self.usable))).argsort(axis=1)[:, :several]]
            self._split(level, draws, self._level(level, draws))
        delete(self.blocks, self.folder)

    def predict(self, codes: np.ndarray, origin: int, seeds: Sequence[int]) -> np.ndarray:
        flat, rows = self.filled(codes, origin).ravel(), np.arange(codes.shape[1])
        own = [t for t, (o, s, _) in enumerate(self.trees) if o == origin and s in seeds]
        last = 2**self.params.depth - 1
        return np.mean([self.value[t, last + self.descend(t, flat, len(rows), rows, self.params.depth)] for t in own], axis=0)

    def shares(self, features: Sequence[str]) -> dict[str, float]:
        """Shares of the gain: each tree's add up to one."""
        total = np.zeros(len(features))
        for f, g in zip(self.feature, self.gain, strict=True):
            if g.sum() > 0:
                np.add.at(total, f, g / g.sum())
        return {features[i]: float(total[i] / max(total.sum(), 1e-300)) for i in self.usable.tolist()}


def forest(
    rows: DataFrame, origins: Sequence[int], features: Sequence[str], seeds: Sequence[int] = (1,), params: Params | None = None, target: str = "g", weight: str = "base",
    month: str = "month", made: str = "t", key: Sequence[str] = ("entity", "t", "h"),
) -> tuple[DataFrame, dict[str, float]]:
    """``rows`` of the origins (their month ``made`` is an origin) with ``prediction``, the mean over seeds of the forests trained at it; and the features' shares of the gain.
    ``rows`` is a stored table."""
    params, origins = params or Params(), sorted(origins)
    learn = rows.where(F.col(target).isNotNull() & (F.col(weight) > 0) & (F.col(month) <= origins[-1]))
    numbers = learn.select(*(F.col(c).cast("double").alias(c) for c in features), F.col(month).alias("_month"))
    edges, missing = edges_of(numbers, features, f"_month <= {origins[0]}", params.bins), params.bins
    given = {"_month": F.col(month).cast("long"), "_target": F.col(target).cast("double"), "_weight": F.col(weight).cast("double"), "_key": F.xxhash64(*key)}
    learn = learn.select(*(F.col(c).cast("double").alias(f"_f{i}") for i, c in enumerate(features)), *(c.alias(k) for k, c in given.items()))
    learn = coded(learn, [f"_f{i}" for i in range(len(features))], edges, missing).select("codes", *(F.col(k).alias(k[1:]) for k in given))
    trees = Grower(learn, sorted(edges) or [0], len(features), missing, [(o, s) for o in origins for s in seeds], params)
    trees.grow()
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = by_feature(b.column("codes"), len(features))
            at, out = b.column(made).to_numpy(zero_copy_only=False), np.full(b.num_rows, np.nan)
            for o in np.unique(at).tolist():
                out[at == o] = trees.predict(codes[:, at == o], int(o), seeds)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(out, from_pandas=True)], names=[*names, "prediction"])

    schema = ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes), "prediction double"])
    return coded(rows.where(F.col(made).isin(list(origins))), features, edges, missing).mapInArrow(run, schema), trees.shares(features)
