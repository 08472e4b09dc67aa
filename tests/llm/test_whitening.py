"""Whitening against NumPy on whole vectors, and the eigenvectors against planted ones, clusters included."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import whitening


def plain(rows: list) -> dict:
    """By length: (ids, x, n, exact sums, covariance) with Python's integers."""
    out: dict = {}
    for i, v in rows:
        if v and all(c is not None and np.isfinite(c) for c in v):
            x = [min(max(int(np.floor(256 * float(c))), -(2**63)), 2**63 - 1) for c in v]
            out.setdefault(len(x), []).append((i, x))
    found = {}
    for d, got in out.items():
        distinct = [list(x) for x in {tuple(x) for _, x in got}]
        sums = [sum(c) for c in zip(*distinct, strict=True)]
        y = np.array(distinct, float) - np.array([s / len(distinct) for s in sums])
        found[d] = [i for i, _ in got], [x for _, x in got], len(distinct), sums, y.T @ y / len(distinct)
    return found


@pytest.mark.parametrize("kind", ["odd", "real"])
def test_rows(spark, odd_dir, sf_dir, kind):
    folder = odd_dir if kind == "odd" else sf_dir
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = whitening.op11_whitening(spark, folder).collect()
    by_n = plain(rows)
    assert len(got) == sum(len(ids) * min(4, d) for d, (ids, *_) in by_n.items())
    for d, (ids, x, n, sums, cov) in by_n.items():
        mine = [r for r in got if r.n == n]
        k = min(4, d)
        assert sorted((repr(r.vec_id), r.component) for r in mine) == sorted((repr(i), c + 1) for i in ids for c in range(k))
        deviation = [sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for v in x]
        assert sorted((r.deviation_exact is None, r.deviation_exact or 0) for r in mine if r.component == 1) == sorted((v >= 10**38, v if v < 10**38 else 0) for v in deviation)
        assert all(r.deviation == (int(r.deviation_exact) if r.deviation_exact is not None and r.deviation_exact < 2**63 else None) for r in mine)
        values = np.linalg.eigvalsh(cov)[::-1][:k]
        trace = np.trace(cov)
        for c in range(k):
            share = {r.explained for r in mine if r.component == c + 1}
            assert len(share) == 1 and abs(share.pop() - (values[c] / trace if trace else 0)) <= 1e-9
        error = {r.identity_error for r in mine}
        assert len(error) == 1 and error.pop() <= 1e-4
        if kind == "real":
            vectors = np.linalg.eigh(cov)[1][:, ::-1][:, :k]
            want = (np.array(x, float) - np.array(sums) / n) @ vectors / np.sqrt(values)
            for c in range(k):
                found = {r.vec_id: r.whitened for r in mine if r.component == c + 1}
                w = np.array([found[i] for i in ids])
                assert np.abs(w * np.sign(w @ want[:, c]) - want[:, c]).max() < 1e-9


def test_one_distinct_vector_has_no_variance(spark):
    rows = spark.createDataFrame([(i, [0.1, 0.2, 0.3]) for i in range(5)], "vec_id long, embedding array<double>")
    out = whitening.whiten(rows, whitening.fit(rows)).collect()
    assert len(out) == 15 and all((r.whitened, r.explained, r.identity_error, r.deviation, r.n) == (0, 0, 0, 0, 1) for r in out)


def rotation(d: int, seed: int) -> np.ndarray:
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))[0].astype(np.longdouble)
    for _ in range(4):
        q = q @ (1.5 * np.eye(d) - 0.5 * q.T @ q)
    return q


@pytest.mark.parametrize(
    "values", [[1, 1 + 1e-9, 1 + 2e-9, 0.5, 0.1, 0.01], [1e6, 1, 1 - 1e-7, 1e-3, 1e-9, 0], [1, 1e-8, 1e-8 * (1 + 1e-6), 1e-12, 0, 0], [9, 5, 3, 2, 1, 0.5]]
)
def test_clusters_are_told_apart(values):
    q = rotation(6, 3)
    a = q @ np.diag(np.array(values, np.longdouble)) @ q.T
    found, x = whitening.eigen((a + a.T) / 2, 4)
    order = np.argsort(-np.array(values), kind="stable")[:4]
    assert np.allclose(found, np.array(values)[order], rtol=1e-12, atol=1e-17 * max(values))
    assert np.abs(x.T @ x - np.eye(4)).max() < 1e-14
    for k in range(4):
        if min(abs(values[order[k]] - v) for j, v in enumerate(values) if j != order[k]) > 0:
            assert np.abs(q[:, order[k]] @ x[:, k]) > 1 - 1e-11


def test_equal_values_keep_orthogonal_vectors():
    q = rotation(12, 5)
    a = q @ np.diag(np.array([7] * 5 + [3] * 7, np.longdouble)) @ q.T
    found, x = whitening.eigen((a + a.T) / 2, 4)
    assert np.allclose(found, 7) and np.abs(x.T @ x - np.eye(4)).max() < 1e-14 and np.abs(a @ x - 7 * x).max() < 1e-14


def test_float32_alone_would_not_do():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 40)) @ np.diag(np.linspace(1, 1.5, 40))
    cov = x.T @ x / 400
    rough = np.linalg.eigh(cov.astype(np.float32))[1][:, ::-1][:, :4]
    fine = whitening.eigen(cov.astype(np.longdouble), 4)[1]
    best = np.linalg.eigh(cov)[1][:, ::-1][:, :4]
    off = lambda v: np.abs(np.abs((v * best).sum(axis=0)) - 1).max() + np.abs(cov @ v - v * (v * (cov @ v)).sum(axis=0)).max()
    assert off(fine) < 1e-13 < 1e-8 < off(rough.astype(float))


def test_packed_vectors_come_back():
    rng = np.random.default_rng(2)
    blocks = [rng.integers(-(2 ** (8 * w - 1)), 2 ** (8 * w - 1) - 1, size=(9, 3)) for w in (1, 2, 4, 8)]
    x = np.concatenate(blocks)
    blobs = whitening.packed(x)
    assert len(set(blobs)) == len(np.unique(x, axis=0)) and len(blobs[0]) == 3
    back = np.concatenate([b for _, b in whitening.unpacked(np.full(len(x), 3), blobs)])
    assert sorted(map(tuple, back.tolist())) == sorted(map(tuple, x.tolist()))


def test_integers_of_slices():
    column = pa.array([[9.0], None, [1.0, -0.001], [None, 1.0], [], [float("nan")], [0.999]], pa.list_(pa.float32()))
    rows, lengths, x = whitening.integers(column.slice(1, 6))
    assert rows.tolist() == [1, 3, 5] and lengths.tolist() == [2, 0, 1] and x.tolist() == [256, -1, 255]
