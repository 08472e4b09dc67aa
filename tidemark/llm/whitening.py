"""Embedding whitening: principal components by mixed-precision refinement of a distributed covariance.

Entries become integers x = floor(scale * entry). The components are those of the fit list, which holds each distinct x vector once.

1. The fit list is made by a pre-aggregated grouping of the vectors, each packed in the fewest bytes an entry that hold it, and is
   written to the shared folder once.
2. Exact sums give the mean; a second pass centres each vector, multiplies, and adds up the covariance. Every task adds its blocks with
   the rounding errors kept (two-sum), and what tasks found is merged row by row of the matrix, spread over tasks.
3. Only that matrix (dimension x dimension, whatever the number of vectors) comes to the driver. Its eigenvectors are
   found in float32 and then corrected by Ogita-Aishima iterations, which are matrix products: in float64 until nothing improves, and finally, for
   the first components, in extended precision. Eigenvalues nearer to each other than the error at hand are clusters, whose vectors an iteration can't tell apart: for
   each, the matrix is shifted by the cluster's centre and reduced to the vectors of the cluster, and that small problem, in which
   the eigenvalues are far apart again, is solved by itself.
4. The fit list is whitened once more to measure how far its covariance is from the identity; then every row is whitened.

A component is a unit vector of either sign; here its largest entry in magnitude is positive, so every run has the same.

Cases: a row whose vector is null, or holds a null or an entry that isn't finite, is dropped; entries beyond 64 bits count as the
largest (smallest) integer of 64 bits; vectors of different lengths are of different spaces, and each length is fitted and whitened by itself; a vector without
entries has no component and so no row; there are as many components as entries if those are fewer; a component without variance (as with a
single distinct vector) is whitened to 0, and identity_error, which then leaves it out, is 0 if none has any. Repeated rows and equal ids are
whitened each, and ties of eigenvalues keep any orthonormal vectors of their space; a deviation that 38 digits can't hold is null. An empty table
gives an empty result; extra columns are not passed on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, table, written

SCALE = 256
COMPONENTS = 4
#: Vectors that are multiplied at a time.
BLOCK = 2048
_LOW, _HIGH = -(2**63), 2**63 - 1


def integers(column: pa.Array, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, lengths, x): the rows of a list column that are kept, how many entries each has, and all their integers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values.slice(offsets[0], offsets[-1] - offsets[0]).cast(pa.float64())
    c = values.to_numpy(zero_copy_only=False)  # a null entry becomes NaN
    lengths = np.diff(offsets)
    bad_before = np.r_[0, np.cumsum(~np.isfinite(c))]
    bad = bad_before[offsets[1:] - offsets[0]] - bad_before[offsets[:-1] - offsets[0]]
    known = np.ones(len(column), bool) if not column.null_count else column.is_valid().to_numpy(zero_copy_only=False)
    keep = known & (bad == 0)
    with np.errstate(over="ignore", invalid="ignore"):
        f = np.floor(scale * c[np.repeat(keep, lengths)])
        x = np.where(f >= 2.0**63, _HIGH, np.where(f < -(2.0**63), _LOW, np.clip(f, -(2.0**63), 2.0**63 - 1024).astype(np.int64)))
    return np.flatnonzero(keep), lengths[keep], x


def by_length(lengths: np.ndarray, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) for each length other than zero."""
    ends = np.cumsum(lengths)
    for d in np.unique(lengths[lengths > 0]).tolist():
        at = np.flatnonzero(lengths == d)
        yield at, x[(ends[at] - d)[:, None] + np.arange(d)]


def packed(x: np.ndarray) -> list[bytes]:
    """Each vector in the fewest bytes an entry (1, 2, 4 or 8) that hold all of it, so equal vectors have equal bytes."""
    out: list = [None] * len(x)
    low, high = x.min(axis=1), x.max(axis=1)
    width = np.select([(low >= -(2 ** (8 * w - 1))) & (high < 2 ** (8 * w - 1)) for w in (1, 2, 4)], [1, 2, 4], 8)
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        data, step = x[rows].astype(f"<i{w}").tobytes(), w * x.shape[1]
        for k, row in enumerate(rows.tolist()):
            out[row] = data[k * step : (k + 1) * step]
    return out


def unpacked(dims: np.ndarray, blobs: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """(dimension, matrix of integers) blocks of packed vectors."""
    sizes = np.fromiter(map(len, blobs), np.int64, len(blobs))
    for d in np.unique(dims).tolist():
        for w in (1, 2, 4, 8):
            rows = np.flatnonzero((dims == d) & (sizes == d * w))
            for at in range(0, len(rows), BLOCK):
                some = rows[at : at + BLOCK].tolist()
                yield d, np.frombuffer(b"".join([blobs[i] for i in some]), f"<i{w}").reshape(len(some), d).astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    for batch in batches:
        yield from unpacked(batch.column("dims").to_numpy(), batch.column("x").to_pylist())


def fit_list(vectors: DataFrame, vector: str, scale: int = SCALE) -> DataFrame:
    """(dims, x): each distinct integer vector once, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                _, lengths, x = integers(batch.column("v").slice(at, BLOCK), scale)
                for _, block in by_length(lengths, x):
                    yield pa.RecordBatch.from_pydict({"dims": np.full(len(block), block.shape[1], np.int32), "x": pa.array(packed(block), pa.binary())})

    return vectors.select(F.col(vector).alias("v")).mapInArrow(run, "dims int, x binary").distinct()


def _sums(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """By dimension: how many vectors, and the exact sum of each entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list[int]] = {}
        for d, x in _blocks(batches):
            most = max(abs(int(x.min())), abs(int(x.max())))
            sums = x.sum(axis=0) if most < 2**62 // BLOCK else x.astype(object).sum(axis=0)
            total[d] = [a + b for a, b in zip(total.get(d, [0] * (d + 1)), [len(x), *sums.tolist()], strict=True)]
        for d, values in total.items():
            text = pa.array(list(map(str, values)))
            yield pa.RecordBatch.from_pydict({"dims": np.full(d + 1, d, np.int32), "j": np.arange(d + 1, dtype=np.int32), "total": text})

    partial = fit.mapInArrow(run, "dims int, j int, total string")
    out: dict[int, list[int]] = {}
    for r in partial.groupBy("dims", "j").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).orderBy("dims", "j").collect():
        out.setdefault(r["dims"], []).append(int(r["total"]))
    return {d: (v[0], v[1:]) for d, v in out.items()}


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a + b and its rounding error."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def _covariances(fit: DataFrame, means: dict[int, np.ndarray], counts: dict[int, int]) -> dict[int, np.ndarray]:
    """By dimension the covariance (divisor n, centred before multiplying), in extended precision."""
    shared = fit.sparkSession.sparkContext.broadcast(means)  # a vector for each dimension

    def rows_of(total: dict) -> Iterator[pa.RecordBatch]:
        for d, (high, low) in total.items():
            columns = {"dims": np.full(d, d, np.int32), "i": np.arange(d, dtype=np.int32)}
            columns |= {k: pa.array([r.tobytes() for r in m], pa.binary()) for k, m in (("high", high), ("low", low))}
            yield pa.RecordBatch.from_pydict(columns)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for d, x in _blocks(batches):
            centred = x - shared.value[d]
            high, low = total.get(d, (np.zeros((d, d)), np.zeros((d, d))))
            high, lost = two_sum(high, centred.T @ centred)
            total[d] = high, low + lost
        yield from rows_of(total)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}  # of the matrix rows that came to this task
        for batch in batches:
            for d, i, h, w in zip(*(batch.column(c).to_pylist() for c in ("dims", "i", "high", "low")), strict=True):
                high, low = total.get((d, i), (np.zeros(d), np.zeros(d)))
                high, lost = two_sum(high, np.frombuffer(h))
                total[d, i] = high, low + lost + np.frombuffer(w)
        for (d, i), (high, low) in total.items():
            place = {k: pa.array([v], pa.int32()) for k, v in (("dims", d), ("i", i))}
            yield pa.RecordBatch.from_pydict(place | {"high": [high.tobytes()], "low": [low.tobytes()]})

    schema = "dims int, i int, high binary, low binary"
    merged = fit.mapInArrow(multiply, schema).repartition("dims", "i").mapInArrow(merge, schema)
    out = {d: np.zeros((d, d), np.longdouble) for d in means}
    for r in merged.collect():  # dimension x dimension numbers, however many vectors there are
        out[r["dims"]][r["i"]] = (np.frombuffer(r["high"]).astype(np.longdouble) + np.frombuffer(r["low"])) / counts[r["dims"]]
    return {d: (v + v.T) / 2 for d, v in out.items()}


def _clusters(values: np.ndarray, width: float) -> Iterator[np.ndarray]:
    """Places of two or more values, each within ``width`` of the next."""
    order = np.argsort(values)
    for run in np.split(order, np.flatnonzero(np.diff(values[order]) > width) + 1):
        if len(run) > 1:
            yield run


def _correct(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """One Ogita-Aishima iteration: (vectors, eigenvalues, size of the correction, the width below which values can't be told apart)."""
    norm = np.linalg.norm
    r = np.eye(len(a)) - x.T @ x
    s = x.T @ (a @ x)
    s = (s + s.T) / 2  # else the two sides of a narrow gap would turn by different rounding errors, and no longer be orthogonal
    values = np.diag(s) / (1 - np.diag(r))
    width = 2 * float(norm(s - np.diag(np.diag(s))) + norm(a) * norm(r))
    e = _turns(s, r, values, values, width)
    return x + x @ e, values, float(norm(e)), width


def _turns(s: np.ndarray, r: np.ndarray, rows: np.ndarray, columns: np.ndarray, width: float | np.ndarray) -> np.ndarray:
    """How much of vector i is missing in vector j; where their values can't be told apart, only what keeps them orthogonal."""
    gap = columns[None, :] - rows[:, None]
    apart = np.abs(gap) > width
    return np.where(apart, (s + columns[None, :] * r) / np.where(apart, gap, 1), r / 2)


def _refine(a: np.ndarray, x: np.ndarray, limit: int = 12) -> tuple[np.ndarray, np.ndarray, float]:
    """Iterations in float64 while they improve, each followed by the sub-solves of its clusters: (vectors, eigenvalues, width)."""
    best, eps = math.inf, float(np.finfo(float).eps)
    for _ in range(limit):
        x, values, size, width = _correct(a, x)
        _split(a, x, _clusters(values, width))
        if size <= 4 * eps or size >= best / 2 and size < 1e-6:
            break
        best = min(best, size)
    return x, (x * (a @ x)).sum(axis=0), width


def _split(a: np.ndarray, x: np.ndarray, clusters: Iterator[np.ndarray]) -> None:
    """The sub-solves: each cluster's problem, shifted and reduced, so that differences are no longer lost in the norm. In place."""
    for cluster in clusters:
        part = x[:, cluster]
        image = a @ part
        small = part.T @ (image - (part * image).sum(axis=0).mean() * part)
        if scale := np.abs(small).max():
            x[:, cluster] = part @ np.linalg.eigh(((small + small.T) / 2 / scale).astype(float))[1]


def _polish(a: np.ndarray, x: np.ndarray, values: np.ndarray, width: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The last iterations, in extended precision, for the first k vectors (and those of their last cluster, if it isn't large)."""
    reach = k
    while reach < len(a) and values[reach - 1] - values[reach] <= width and reach < 4 * k:
        reach += 1
    x, eye = x.astype(np.longdouble), np.eye(len(a), reach, dtype=np.longdouble)
    near, norm = np.full((len(a), 1), width), np.linalg.norm(a.astype(float))
    for _ in range(3):
        own = x[:, :reach]
        s, r = x.T @ (a @ own), eye - x.T @ own
        s[:reach] = (s[:reach] + s[:reach].T) / 2
        exact = np.diag(s) / (1 - np.diag(r))
        near[:reach] = 2 * (np.linalg.norm((s - eye * s).astype(float)) + norm * np.linalg.norm(r.astype(float)))
        x[:, :reach] = own + x @ _turns(s, r, np.r_[exact, values[reach:]], exact, near)
        own = x[:, :reach].copy()
        _split(a, own, _clusters(exact.astype(float), float(near[0, 0])))
        x[:, :reach] = own
    own = own / np.sqrt((own**2).sum(axis=0))
    exact = (own * (a @ own)).sum(axis=0)
    first = np.argsort(-exact, kind="stable")[:k]
    return own[:, first], exact[first]


def eigen(cov: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues (falling) and their unit eigenvectors (columns) of a symmetric matrix, to double precision."""
    scale, k = float(np.abs(cov).max()), min(k, len(cov))
    if not scale:
        return np.zeros(k), np.eye(len(cov), k)
    exact = cov.astype(np.longdouble) / scale
    rough = np.linalg.eigh(exact.astype(np.float32))[1]
    x, values, width = _refine(exact.astype(float), rough.astype(float))
    order = np.argsort(-values, kind="stable")
    x, values = _polish(exact, x[:, order], values[order], width, k)
    x = x * np.where(x[np.abs(x).argmax(axis=0), np.arange(k)] < 0, -1, 1)
    return (values * scale).astype(float), x.astype(float)


@dataclass
class Whitener:
    """Of the vectors of one length: the first components, scaled, and what each explains."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    @classmethod
    def of(cls, n: int, sums: list[int], cov: np.ndarray, components: int) -> Whitener:
        values, vectors = eigen(cov, components)
        trace = float(np.trace(cov))
        floor = len(cov) * np.finfo(float).eps * max(trace, 0.0)
        values = np.where(values > floor, values, 0.0)
        return cls(n, sums, values, vectors, values / trace if trace > 0 else np.zeros(len(values)))

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])  # correctly rounded, the sums being whole numbers

    def whiten(self, x: np.ndarray) -> np.ndarray:
        spread = np.sqrt(np.where(self.values > 0, self.values, np.inf))
        return (x - self.mean) @ (self.vectors / spread)

    def deviations(self, x: np.ndarray) -> list[int]:
        """sum over entries of (n x - S)^2, exactly."""
        most = max(abs(int(x.min())), abs(int(x.max())))
        reach = self.n * most + max(map(abs, self.sums))
        kind = np.int64 if x.shape[1] * reach**2 < 2**63 else object
        d = self.n * x.astype(kind) - np.array(self.sums, kind)
        return (d * d).sum(axis=1).tolist()


def fit(vectors: DataFrame, vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> dict[int, Whitener]:
    """A whitener for each length of vectors."""
    distinct = written(fit_list(vectors, vector, scale))
    sums = _sums(distinct)
    counts = {d: n for d, (n, _) in sums.items()}
    covariances = _covariances(distinct, {d: np.array([s / n for s in v]) for d, (n, v) in sums.items()}, counts)
    found = {d: Whitener.of(n, v, covariances[d], components) for d, (n, v) in sums.items()}
    shared = vectors.sparkSession.sparkContext.broadcast(found)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d, x in _blocks(batches):
            w = shared.value[d].whiten(x)
            k = w.shape[1]
            i, j = (m.ravel() for m in np.indices((k + 1, k)))
            data = np.concatenate([w.sum(axis=0)[None], w.T @ w])  # row 0 has the sums
            yield pa.RecordBatch.from_pydict({"dims": np.full(len(i), d, np.int32), "i": i.astype(np.int32), "j": j.astype(np.int32), "v": data.ravel()})

    for d, w in found.items():
        k = len(w.values)
        w.moments = np.zeros((k + 1, k))
    for r in distinct.mapInArrow(moments, "dims int, i int, j int, v double").groupBy("dims", "i", "j").agg(F.sum("v").alias("v")).collect():
        found[r["dims"]].moments[r["i"], r["j"]] = r["v"]
    discard(distinct)
    for w in found.values():
        mean, second, some = w.moments[0] / w.n, w.moments[1:] / w.n, w.values > 0
        off = np.abs(second - np.outer(mean, mean) - np.eye(len(w.values)))[np.ix_(some, some)]
        w.identity_error = float(off.max()) if some.any() else 0.0
        del w.moments
    return found


def whiten(vectors: DataFrame, found: dict[int, Whitener], vector: str = "embedding", key: str = "vec_id", scale: int = SCALE) -> DataFrame:
    """(key, component, n, deviation decimal(38,0), whitened, explained, identity_error): a row for each vector and component."""
    shared = vectors.sparkSession.sparkContext.broadcast(found)  # a few vectors for each length
    key_type = vectors.schema[key].dataType.simpleString()
    limit = 10**38

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                some = batch.slice(at, BLOCK)
                rows, lengths, x = integers(some.column("v"), scale)
                for places, block in by_length(lengths, x):
                    w = shared.value[block.shape[1]]
                    m, k = len(block), len(w.values)
                    deviation = [str(v) if v < limit else None for v in w.deviations(block)]
                    columns = {
                        key: some.column("k").take(pa.array(np.repeat(rows[places], k))),
                        "component": pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                        "n": pa.array(np.full(m * k, w.n), pa.int64()),
                        "deviation": pa.array(deviation, pa.string()).take(pa.array(np.repeat(np.arange(m), k))),
                        "whitened": pa.array(w.whiten(block).ravel()),
                        "explained": pa.array(np.tile(w.explained, m)),
                        "identity_error": pa.array(np.full(m * k, w.identity_error)),
                    }
                    yield pa.RecordBatch.from_pydict(columns)

    schema = f"`{key}` {key_type}, component int, n long, deviation string, whitened double, explained double, identity_error double"
    named = vectors.select(F.col(key).alias("k"), F.col(vector).alias("v"))
    return named.mapInArrow(run, schema).withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deviation as a long is null where 64 bits can't hold it; ``deviation_exact`` has it still."""
    vectors = table(spark, sf_dir, "embeddings")
    out = whiten(vectors, fit(vectors))
    return out.withColumn("deviation_exact", F.col("deviation")).withColumn("deviation", F.col("deviation").try_cast("long"))
