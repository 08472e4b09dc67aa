"""Gradient boosting of the absolute error on histograms, for many training windows and seeds at once.

Features are cut once, at quantiles of the rows that the earliest origin knows, and become one byte each. A *group* is an origin with a seed: its model is
trained on the rows whose target month is known at the origin, weighted, with a share of the rows drawn anew for each tree. All groups go through
the same passes over the binned rows, which are packed into blocks: a block is one row of a Spark table that holds some ten thousand rows by column, in order of
their months, so that a pass costs copies of arrays and what an origin knows is the first part of a block. A level of the trees is one pass: every task adds up counts,
weights and signs of the residuals by group, node, feature and bin; Spark sums these rows, and only the sums (groups x nodes x features x bins, whatever the
number of rows) reach the driver, which picks the splits. Features of few bins are counted together, and their sums taken from the joint counts. A block carries
its groups' predictions so far and the signs of their residuals, which are all that a level reads; both are brought up to date with each
tree, and the table before is deleted.

Missing values have a bin of their own, and a split sends them to the side where they do better. A leaf's value is the weighted median of its
residuals, found exactly by refining histograms of them in further passes. Weights are scaled to a mean of one in each group, so that the penalty
doesn't depend on their scale.

Cases: rows without a target or with a weight that isn't positive aren't learned from; a group without rows predicts null; a feature
without known values isn't split on; ties go to the first feature and the lowest cut; of weighted medians the lower one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import delete, stored
from .quantiles import column_ranks


@dataclass(frozen=True)
class Params:
    trees: int = 15
    depth: int = 3
    rate: float = 0.3
    bins: int = 32
    least: int = 10  #: rows in a leaf
    penalty: float = 1.0
    share: float = 0.8  #: of the rows that a tree sees; all of them at 1


@dataclass
class Tree:
    """A complete binary tree: node i has children 2i + 1 and 2i + 2; feature -1 sends every row left."""

    feature: np.ndarray
    cut: np.ndarray  #: bins up to it go left
    missing_left: np.ndarray
    gain: np.ndarray
    values: np.ndarray | None = None

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 2**depth - 1
        return cls(np.full(n, -1), np.zeros(n, int), np.zeros(n, bool), np.zeros(n))

    def descend(self, codes: np.ndarray, missing: int, levels: int) -> np.ndarray:
        """The place of each row among the nodes of a level; ``codes`` by feature, then row. Node by node, as comparisons of bytes are cheap."""
        at = np.zeros(codes.shape[1], np.uint16)
        for level in range(levels):
            right = np.zeros(codes.shape[1], bool)
            for node in range(2**level):
                i = 2**level - 1 + node
                if (f := self.feature[i]) >= 0:
                    goes = codes[f] > self.cut[i]
                    if self.missing_left[i]:
                        goes &= codes[f] != missing
                    right |= goes & (at == node)
            at = 2 * at + right
        return at.astype(np.intp)


@dataclass
class Ensemble:
    start: float | None = None  #: None: there was nothing to learn from
    trees: list[Tree] = field(default_factory=list)

    def predict(self, codes: np.ndarray, missing: int, depth: int, rate: float) -> np.ndarray:
        out = np.full(codes.shape[1], np.nan if self.start is None else self.start)
        for t in self.trees:
            out += rate * t.values[t.descend(codes, missing, depth)]
        return out


def drawn(keys: np.ndarray, seed: int, tree: int, share: float) -> np.ndarray:
    """Which rows a tree of a seed sees, by a hash of their keys."""
    if share >= 1:
        return np.ones(len(keys), bool)
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64(seed + 1) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(tree + 1) * np.uint64(0xD1B54A32D192ED03)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(float) < share * 2**53


def edges_of(rows: DataFrame, features: Sequence[str], known: str, bins: int) -> dict[int, np.ndarray]:
    """Each feature's cuts, at quantiles of the rows for which ``known`` holds. ``rows`` is a stored table."""
    levels = [k / bins for k in range(1, bins)]
    ends = lambda n: sorted({int(f(p * (n - 1))) for p in levels for f in (np.floor, np.ceil)})
    out = {}
    for i, (n, found) in enumerate(column_ranks(rows.where(known), features, ends)[0]):
        if n:
            value, places = dict(zip(ends(n), found, strict=True)), [p * (n - 1) for p in levels]
            cuts = [(value[int(np.floor(x))], value[int(np.ceil(x))], x - np.floor(x)) for x in places]
            out[i] = np.unique([low if low == high else (1 - part) * low + part * high for low, high, part in cuts])
    return out


def coded(rows: DataFrame, features: Sequence[str], edges: dict[int, np.ndarray], bins: int) -> DataFrame:
    """``rows`` with ``codes``, a byte a feature: the bin of its value, or ``bins`` where it is missing."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.empty((batch.num_rows, len(features)), np.uint8)
            for i, c in enumerate(features):
                x = batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False)
                codes[:, i] = np.where(np.isnan(x), bins, np.searchsorted(edges.get(i, np.zeros(0)), x, "left"))  # bin k holds values up to the k-th cut
            data = pa.array([codes[k].tobytes() for k in range(len(codes))], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), data], names=[*names, "codes"])

    schema = ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes), "codes binary"])
    return rows.mapInArrow(run, schema)


def binned(rows: DataFrame, features: Sequence[str], known: str, bins: int) -> tuple[DataFrame, int]:
    """``rows`` with ``codes``, cut at quantiles of the rows for which ``known`` holds; and the code of missing values."""
    return coded(rows, features, edges_of(rows, features, known, bins), bins), bins


def by_feature(column: pa.Array, features: int) -> np.ndarray:
    """Codes of a batch of rows, by feature, then row."""
    return np.ascontiguousarray(np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, features).T)


#: The columns of a block, and what its bytes are.
KINDS = {"codes": np.uint8, "month": np.int32, "target": np.float64, "weight": np.float64, "key": np.int64}
BLOCK_SCHEMA = ", ".join(f"{c} binary" for c in KINDS)
#: Few blocks a file, so that neither a writer nor a reader holds many at once.
STORAGE = {"maxRecordsPerFile": "8", "parquet.enable.dictionary": "false", "compression": "lz4_raw"}


def packed(rows: DataFrame, features: int, size: int = 1 << 15) -> DataFrame:
    """Rows (codes, month, target, weight, key) in blocks of ``size`` or a little more, each in order of its months."""

    def block(parts: list[dict[str, np.ndarray]]) -> pa.RecordBatch:
        whole = {c: np.concatenate([p[c] for p in parts], axis=-1) for c in KINDS}
        order = np.argsort(whole["month"], kind="stable")
        return pa.RecordBatch.from_pydict({c: pa.array([np.ascontiguousarray(x[..., order]).tobytes()], pa.binary()) for c, x in whole.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            own = {c: b.column(c).to_numpy(zero_copy_only=False).astype(k) for c, k in KINDS.items() if c != "codes"}
            parts.append(own | {"codes": by_feature(b.column("codes"), features)})
            n += b.num_rows
            if n >= size:
                yield block(parts)
                parts, n = [], 0
        if parts:
            yield block(parts)

    return rows.mapInArrow(run, BLOCK_SCHEMA)


@dataclass
class _Block:
    codes: np.ndarray  #: (feature, row)
    month: np.ndarray  #: ascending
    weight: np.ndarray
    key: np.ndarray
    target: np.ndarray | None = None  #: None where signs are read in its place
    made: np.ndarray | None = None  #: (group, row): predictions so far; None before the first tree
    signs: np.ndarray | None = None  #: (group, row): of the residuals, from 0 to 2


@dataclass
class Joint:
    """Some features whose codes are counted as one number. ``values``: the codes that each of them has."""

    features: list[int]
    values: list[np.ndarray]

    @property
    def shape(self) -> tuple[int, ...]:
        return tuple(len(v) for v in self.values)

    def code(self, codes: np.ndarray, bins: int, cells: int) -> np.ndarray:
        """The number of each row's combination, times ``cells``."""
        out, step = np.zeros(codes.shape[1], np.intp), cells
        for f, values in reversed(list(zip(self.features, self.values, strict=True))):
            place = np.zeros(bins, np.intp)
            place[values] = np.arange(len(values)) * step
            out += place[codes[f]]
            step *= len(values)
        return out


def joints(values: Sequence[np.ndarray], most: int = 1200) -> list[Joint]:
    """The features, by the codes that each has, in sets that have ``most`` combinations or one feature: that of most codes, then such as there is room for."""
    order, out = sorted(range(len(values)), key=lambda f: len(values[f])), []
    while order:
        own = [order.pop()]
        while fitting := [f for f in order if np.prod([len(values[i]) for i in (*own, f)]) <= most]:
            order.remove(fitting[-1])
            own.append(fitting[-1])
        out.append(Joint(own, [values[f] for f in own]))
    return out


def near(x: np.ndarray, low: np.ndarray, high: np.ndarray, cells: int = 1024) -> np.ndarray:
    """Places of all values that lie between a low and its high, where it is above it, and of few others: values are looked up in a table of cells."""
    low, high = low[low < high], high[low < high]
    least, most = low.min(), high.max()
    some = np.flatnonzero((x >= least) & (x <= most))
    if not np.isfinite(most - least):
        return some
    scale = cells / (most - least)
    cell = lambda v: np.minimum((v - least) * scale, cells - 1).astype(np.intp)  # noqa: E731  never falls where values rise
    held = np.zeros(cells, bool)
    for a, b in zip(cell(low), cell(high), strict=True):
        held[a : b + 1] = True
    return some[held[cell(x[some])]]


class Trainer:
    """Trees of all groups (origin, seed) on rows (codes, month, target, weight, key), which hold only what may be learned from."""

    def __init__(self, rows: DataFrame, features: int, missing: int, groups: Sequence[tuple[int, int]], params: Params):
        self.features, self.missing, self.groups, self.params = features, missing, list(groups), params
        self.blocks, self.folder = stored(packed(rows, features), **STORAGE)
        self.models = [Ensemble() for _ in self.groups]
        self.scale = [1.0] * len(self.groups)
        self.joints: list[Joint] = []
        self.bounds = np.zeros((2, len(self.groups)))  # between which a group's residuals lie

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "blocks"}  # what tasks need

    def _read(self, batches: Iterator[pa.RecordBatch]) -> Iterator[_Block]:
        for b in batches:
            for i in range(b.num_rows):
                own = {c: np.frombuffer(b.column(c)[i].as_buffer(), k) for c, k in KINDS.items() if c in b.schema.names}
                own["codes"] = own["codes"].reshape(self.features, -1)
                for c, k in (("made", np.float64), ("signs", np.uint8)):
                    if c in b.schema.names:
                        own[c] = np.frombuffer(b.column(c)[i].as_buffer(), k).reshape(len(self.groups), -1)
                yield _Block(**own)

    def _seen(self, r: _Block, number: int | None) -> Iterator[tuple[int, slice | np.ndarray, np.ndarray, np.ndarray, int]]:
        """(group, rows, codes, weights, end): the rows that each group's tree sees, of which the first, up to the end, are known at its origin; without a
        number all rows. What groups of one seed share is made once."""
        seen: dict[int, tuple] = {}
        for g, (origin, seed) in enumerate(self.groups):
            if number is not None and self.models[g].start is None:
                continue
            if seed not in seen:
                some = slice(None) if number is None or self.params.share >= 1 else np.flatnonzero(drawn(r.key, seed, number, self.params.share))
                seen[seed] = some, np.ascontiguousarray(r.codes[:, some]), r.month[some], r.weight[some]
            some, codes, month, weight = seen[seed]
            if end := int(np.searchsorted(month, origin, "right")):  # months ascend
                yield g, some, codes, weight, end

    def _parts(self, r: _Block, number: int | None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(group, codes, weights, residuals) of the rows that each group's tree sees; without a number all that its origin knows, with targets."""
        of = lambda x, some, end: x[:end] if isinstance(some, slice) else x.take(some[:end])
        for g, some, codes, weight, end in self._seen(r, number):
            x = of(r.target, some, end)
            if number is not None:
                x = x - (self.models[g].start if r.made is None else of(r.made[g], some, end))
            yield g, codes[:, :end], weight[:end] / self.scale[g], x

    def _signs(self, r: _Block, number: int, cells: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
        """(group, codes, weights, signs of the residuals from 0 to 2, joint codes times ``cells``) of the rows that each group's tree sees."""
        joint: dict[int, list[np.ndarray]] = {}  # by seed
        for g, some, codes, weight, end in self._seen(r, number):
            if (seed := self.groups[g][1]) not in joint:
                joint[seed] = [j.code(codes, self.missing + 1, cells) for j in self.joints]
            if r.signs is None:
                signs = (np.sign(r.target[some][:end] - self.models[g].start) + 1).astype(np.uint8)
            else:
                signs = r.signs[g][some][:end]
            yield g, codes[:, :end], weight[:end] / self.scale[g], signs, [c[:end] for c in joint[seed]]

    def _summed(self, run, columns: str, by: Sequence[str], read: Sequence[str] = (), **aggregates) -> pa.Table:
        """The rows that ``run`` makes of each task, aggregated: as many as there are keys. Tasks get the columns to ``read``, or all that residuals need."""
        names = self.blocks.columns
        blocks = self.blocks.select(*(read if set(read) <= set(names) and read else [c for c in names if c != "signs"]))
        return blocks.mapInArrow(run, columns).groupBy(*by).agg(*(a.alias(k) for k, a in aggregates.items())).toArrow()

    def _advanced(self, trees: list[Tree]) -> None:
        """Bring the rows' predictions up to date with a tree of each group."""
        p = self.params

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i, r in enumerate(self._read([b])):
                    made, signs = np.empty((len(trees), len(r.month))), np.empty((len(trees), len(r.month)), np.uint8)
                    for g, (t, m) in enumerate(zip(trees, self.models, strict=True)):
                        start = r.made[g] if r.made is not None else np.nan if m.start is None else m.start
                        made[g] = start + p.rate * t.values[t.descend(r.codes, self.missing, p.depth)]
                        signs[g] = (r.target >= made[g]).view(np.uint8) + (r.target > made[g])
                    own = {c: b.column(c).slice(i, 1) for c in KINDS}
                    yield pa.RecordBatch.from_pydict(own | {c: pa.array([x.tobytes()], pa.binary()) for c, x in (("made", made), ("signs", signs))})

        before, names = self.folder, [c for c in self.blocks.columns if c != "signs"]
        self.blocks, self.folder = stored(self.blocks.select(names).mapInArrow(run, f"{BLOCK_SCHEMA}, made binary, signs binary"), **STORAGE)
        delete(self.blocks, before)

    def _level(self, trees: list[Tree], number: int, level: int) -> np.ndarray:
        """(group, node, feature, bin, (rows, weight, weighted signs)) of a level of the trees being grown."""
        nodes, bins = 2**level, self.missing + 1
        shape = (len(self.groups), self.features, 3, nodes, bins)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((2, *shape))
            held = [np.zeros((2, len(self.groups), *j.shape, 3, nodes)) for j in self.joints]
            for r in self._read(batches):
                for g, codes, w, signs, joint in self._signs(r, number, 3 * nodes):
                    at = signs.astype(np.intp) * nodes + trees[g].descend(codes, self.missing, level)
                    for code, sums in zip(joint, held, strict=True):
                        cell = code + at
                        for k, weights in enumerate((None, w)):
                            own = sums[k, g].ravel()  # a view
                            own += np.bincount(cell, weights, own.size)
            for j, sums in zip(self.joints, held, strict=True):
                for i, (f, values) in enumerate(zip(j.features, j.values, strict=True)):
                    of = sums.sum(axis=tuple(2 + x for x in range(len(j.features)) if x != i))  # (.., group, value, sign, node)
                    total[:, :, f][..., values] = np.moveaxis(of, 2, -1)
            n, w = total.sum(axis=3)
            s = total[1, :, :, 2] - total[1, :, :, 0]
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"cell": at, "n": n.ravel()[at], "w": w.ravel()[at], "s": s.ravel()[at]})

        out = np.zeros((len(self.groups) * self.features * nodes * bins, 3))
        found = self._summed(run, "cell long, n double, w double, s double", ["cell"], [c for c in KINDS if c != "target"] + ["signs"], n=F.sum("n"), w=F.sum("w"), s=F.sum("s"))
        out[found["cell"].to_numpy()] = np.column_stack([found[c].to_numpy() for c in "nws"])
        return out.reshape(len(self.groups), self.features, nodes, bins, 3).swapaxes(1, 2)

    def _split(self, tree: Tree, level: int, sums: np.ndarray) -> None:
        """The best split of each node of a level from (node, feature, bin, 3)."""
        p, known = self.params, sums[:, :, : self.missing].cumsum(axis=2)
        absent, total = sums[:, :, self.missing], sums.sum(axis=2)
        score = lambda x: x[..., 2] ** 2 / (x[..., 1] + p.penalty)
        left = np.stack([known, known + absent[:, :, None]], axis=3)  # missing values right, or left
        right = total[:, :, None, None] - left
        gain = score(left) + score(right) - score(total)[:, :, None, None]
        gain = np.where((left[..., 0] >= p.least) & (right[..., 0] >= p.least), gain, -np.inf)
        for node in range(len(sums)):
            best = int(gain[node].argmax())
            f, cut, side = np.unravel_index(best, gain[node].shape)
            if gain[node][f, cut, side] > 1e-9:
                at = 2**level - 1 + node
                tree.feature[at], tree.cut[at], tree.missing_left[at], tree.gain[at] = f, cut, side == 1, gain[node][f, cut, side]

    def _medians(self, leaf_of, leaves: int, number: int | None, bins: int = 512, listed: int = 50_000) -> np.ndarray:
        """(group, leaf): the lower weighted median of the residuals (without ``number``: of the targets); NaN where there are none.

        ``leaf_of(group, codes)`` gives the rows' leaves. Each pass counts the residuals between a leaf's bounds in bins and keeps the bin
        in which half of the weight is reached, until a leaf's bounds meet; when ``listed`` residuals at most are left in all, they are listed. Without
        bounds the first pass only finds them.
        """
        size = len(self.groups) * leaves
        low, high, left = np.full(size, -np.inf), np.full(size, np.inf), np.full(size, np.inf)
        if number is not None:
            slack = 1e-9 * (1 + np.abs(self.bounds))  # the bounds are sums, which are rounded
            low, high = np.repeat(self.bounds[0] - slack[0], leaves), np.repeat(self.bounds[1] + slack[1], leaves)
        below, whole = np.zeros(size), np.full(size, np.nan)
        first = True
        while first or (low < high).any():
            few, first_ = left[low < high].sum() <= listed, first
            bounds = (low.copy(), high.copy(), not np.isfinite(low).any())

            def inside(r: _Block, bounds=bounds) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
                lo, hi, _ = bounds
                for g, codes, w, x in self._parts(r, number):
                    own = slice(g * leaves, (g + 1) * leaves)
                    lo_, hi_ = lo[own], hi[own]
                    if not (lo_ < hi_).any():
                        continue
                    if (lo_ == lo_[0]).all() and (hi_ == hi_[0]).all() and x.min() >= lo_[0] and x.max() <= hi_[0]:  # a tree's first pass
                        yield g * leaves + leaf_of(g, codes), x, w
                        continue
                    some = near(x, lo_, hi_)  # most rows lie outside of all bounds
                    leaf, x, w = leaf_of(g, codes[:, some]), x[some], w[some]
                    some = np.flatnonzero((lo_[leaf] < hi_[leaf]) & (x >= lo_[leaf]) & (x <= hi_[leaf]))
                    if len(some):
                        yield g * leaves + leaf[some], x[some], w[some]

            def histogram(batches: Iterator[pa.RecordBatch], bounds=bounds) -> Iterator[pa.RecordBatch]:
                lo, hi, all_of_it = bounds
                n, weight, least, most = np.zeros(size * bins, np.int64), np.zeros(size * bins), np.full(size * bins, np.inf), np.full(size * bins, -np.inf)
                scale = None if all_of_it else np.divide(bins, hi - lo, where=lo < hi, out=np.zeros(size))
                for r in self._read(batches):
                    for leaf, x, w in inside(r):
                        g = leaf[0] // leaves  # of one group
                        own = slice(g * leaves * bins, (g + 1) * leaves * bins)
                        cell = (leaf - g * leaves) * bins
                        if not all_of_it:
                            same = first_ and number is not None  # the leaves of a group have the same bounds
                            low_, scale_ = (lo[g * leaves], scale[g * leaves]) if same else (lo[leaf], scale[leaf])
                            cell = cell + np.minimum((x - low_) * scale_, bins - 1).astype(np.intp)
                        n[own] += np.bincount(cell, minlength=leaves * bins)
                        weight[own] += np.bincount(cell, w, leaves * bins)
                        np.minimum.at(least[own], cell, x)
                        np.maximum.at(most[own], cell, x)
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_pydict({"cell": at, "n": n[at], "w": weight[at], "a": least[at], "b": most[at]})

            def listing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for r in self._read(batches):
                    for leaf, x, w in inside(r):
                        yield pa.RecordBatch.from_pydict({"cell": leaf * bins, "n": np.ones(len(x), np.int64), "w": w, "a": x, "b": x})

            found = self._summed(
                listing if few else histogram, "cell long, n long, w double, a double, b double", ["cell", "a"] if few else ["cell"],
                n=F.sum("n"), w=F.sum("w"), b=F.max("b"), **({} if few else {"a": F.min("a")}),
            )
            cell, n, w, a, b = (found[c].to_numpy() for c in ("cell", "n", "w", "a", "b"))
            order = np.lexsort((a, cell))
            cell, n, w, a, b = (x[order] for x in (cell // bins, n, w, a, b))
            for leaf in np.flatnonzero(low < high).tolist():
                begin, end = np.searchsorted(cell, [leaf, leaf + 1])
                if begin == end:
                    low[leaf] = high[leaf] = np.nan
                    continue
                if np.isnan(whole[leaf]):
                    whole[leaf] = w[begin:end].sum()
                if number is None and first:  # one cell: of all targets
                    self.bounds[:, leaf] = a[begin], b[begin]
                upto = below[leaf] + np.cumsum(w[begin:end])
                k = min(int(np.searchsorted(upto, whole[leaf] / 2 * (1 - 1e-12))), end - begin - 1)
                below[leaf] = upto[k - 1] if k else below[leaf]
                low[leaf], high[leaf], left[leaf] = a[begin + k], b[begin + k], n[begin + k]
            first = False
        return low.reshape(len(self.groups), leaves)

    def train(self) -> list[Ensemble]:
        counts: dict[int, tuple[int, float]] = {}
        origins = sorted({o for o, _ in self.groups})

        def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for r in self._read(batches):
                ends = np.searchsorted(r.month, origins, "right")
                yield pa.RecordBatch.from_pydict({"origin": origins, "n": ends, "w": [float(r.weight[:e].sum()) for e in ends]})

        for r in self._summed(known, "origin long, n long, w double", ["origin"], n=F.sum("n"), w=F.sum("w")).to_pylist():
            if r["n"]:
                counts[r["origin"]] = r["n"], r["w"]
        bins = self.missing + 1

        def occurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = np.zeros((self.features, bins), np.int64)
            for r in self._read(batches):
                seen += [np.bincount(c, minlength=bins) for c in r.codes]
            at = np.flatnonzero(seen)
            yield pa.RecordBatch.from_pydict({"cell": at, "n": seen.ravel()[at]})

        held = np.zeros((self.features, bins), bool)
        held.ravel()[self._summed(occurring, "cell long, n long", ["cell"], [c for c in KINDS if c != "target"], n=F.sum("n"))["cell"].to_numpy()] = True
        self.joints = joints([np.flatnonzero(x) for x in held])
        self.scale = [counts[o][1] / counts[o][0] if o in counts else 1.0 for o, _ in self.groups]
        start = self._medians(lambda g, codes: np.zeros(codes.shape[1], np.intp), 1, None)[:, 0]
        for model, value in zip(self.models, start.tolist(), strict=True):
            model.start = None if np.isnan(value) else value
        self.bounds -= np.nan_to_num(start)
        p = self.params
        for number in range(p.trees):
            trees = [Tree.empty(p.depth) for _ in self.groups]
            for level in range(p.depth):
                sums = self._level(trees, number, level)
                for g, tree in enumerate(trees):
                    self._split(tree, level, sums[g])
            values = self._medians(lambda g, codes, trees=trees: trees[g].descend(codes, self.missing, p.depth), 2**p.depth, number)
            for g, tree in enumerate(trees):
                tree.values = np.nan_to_num(values[g])
                if self.models[g].start is not None:
                    self.models[g].trees.append(tree)
                    self.bounds[0, g] -= p.rate * tree.values.max()
                    self.bounds[1, g] -= p.rate * tree.values.min()
            if number < p.trees - 1:
                self._advanced(trees)
        delete(self.blocks, self.folder)
        return self.models


def boosted(
    rows: DataFrame, origins: Sequence[int], features: Sequence[str], seeds: Sequence[int] = (1,), params: Params | None = None, target: str = "g", weight: str = "base",
    month: str = "month", made: str = "t", key: Sequence[str] = ("entity", "t", "h"),
) -> tuple[DataFrame, dict[str, float]]:
    """``rows`` of the origins (their month ``made`` is an origin) with ``prediction``, the mean over seeds of the models trained at it; and the features' shares of the gain."""
    params, origins = params or Params(), sorted(origins)
    groups = [(o, s) for o in origins for s in seeds]
    missing, edges = params.bins, edges_of(rows, features, f"{made} <= {origins[0]}", params.bins)
    learn = rows.where(F.col(target).isNotNull() & (F.col(weight) > 0) & (F.col(month) <= origins[-1]))
    given = {"_month": F.col(month).cast("long"), "_target": F.col(target).cast("double"), "_weight": F.col(weight).cast("double"), "_key": F.xxhash64(*key)}
    learn = learn.select(*(F.col(c).cast("double").alias(f"_f{i}") for i, c in enumerate(features)), *(c.alias(k) for k, c in given.items()))
    learn = coded(learn, [f"_f{i}" for i in range(len(features))], edges, missing).select("codes", *(F.col(k).alias(k[1:]) for k in given))
    models = Trainer(learn, len(features), missing, groups, params).train()
    by_origin = {o: [m for (at, _), m in zip(groups, models, strict=True) if at == o] for o in origins}
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = by_feature(b.column("codes"), len(features))
            at, out = b.column(made).to_numpy(zero_copy_only=False), np.full(b.num_rows, np.nan)
            for o in np.unique(at).tolist():
                some = at == o
                out[some] = np.mean([m.predict(codes[:, some], missing, params.depth, params.rate) for m in by_origin[o]], axis=0)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(out, from_pandas=True)], names=[*names, "prediction"])

    schema = ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes), "prediction double"])
    gains = np.zeros(len(features))
    for m in models:
        for t in m.trees:
            np.add.at(gains, t.feature[t.feature >= 0], t.gain[t.feature >= 0])
    shares = dict(zip(features, (gains / max(gains.sum(), 1e-300)).tolist(), strict=True))
    return coded(rows.where(F.col(made).isin(list(origins))), features, edges, missing).mapInArrow(run, schema), shares
