"""Histogram boosting of the absolute error against plain loops over rows, and what it must learn."""

from __future__ import annotations

import numpy as np
import pytest

from tidemark.operators import boosting as B


def table(n: int, seed: int):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 3)), 2)
    x[rng.random((n, 3)) < 0.15] = np.nan
    g = np.where(np.nan_to_num(x[:, 0], nan=1.0) > 0.2, 1.0, -1.0) + 0.3 * np.nan_to_num(x[:, 1]) + rng.normal(0, 0.2, n)
    return [(i, int(100 + i % 6), int(101 + i % 6), float(g[i]), float(rng.uniform(0.5, 20)), *(None if np.isnan(v) else float(v) for v in x[i])) for i in range(n)]


SCHEMA = "entity int, t int, month int, g double, base double, a double, b double, c double"


def weighted_median(x, w) -> float:
    order = np.argsort(x, kind="stable")
    total = np.cumsum(w[order])
    return float(x[order][np.searchsorted(total, w.sum() / 2 * (1 - 1e-12))])


def by_rows(codes, g, w, p: B.Params, missing: int):
    """One model, every split tried by summing over the rows it sends either way."""
    w = w / w.mean()
    start = weighted_median(g, w)
    pred, trees = np.full(len(g), start), []
    for _ in range(p.trees):
        sign, leaf, splits = w * np.sign(g - pred), np.zeros(len(g), int), {}
        for level in range(p.depth):
            nxt = leaf * 2
            for node in range(2**level):
                here = leaf == node
                best = (1e-9, None)
                total = sign[here].sum() ** 2 / (w[here].sum() + p.penalty)
                for f in range(codes.shape[1]):
                    for cut in range(missing):
                        for side in (0, 1):
                            left = here & np.where(codes[:, f] == missing, side == 1, codes[:, f] <= cut)
                            right = here & ~left
                            if left.sum() >= p.least and right.sum() >= p.least:
                                gain = sum(sign[k].sum() ** 2 / (w[k].sum() + p.penalty) for k in (left, right)) - total
                                if gain > best[0] + 1e-9:
                                    best = gain, (f, cut, side, left)
                splits[level, node] = best[1] and best[1][:3]
                if best[1]:
                    nxt[here & ~best[1][3]] += 1
            leaf = nxt
        values = {k: weighted_median((g - pred)[leaf == k], w[leaf == k]) for k in set(leaf.tolist())}
        pred = pred + p.rate * np.array([values[k] for k in leaf.tolist()])
        trees.append((splits, values))
    return start, trees


def follow(model, codes, p, missing):
    start, trees = model
    out = np.full(len(codes), start)
    for splits, values in trees:
        leaf = np.zeros(len(codes), int)
        for level in range(p.depth):
            nxt = leaf * 2
            for i, node in enumerate(leaf.tolist()):
                if split := splits[level, node]:
                    f, cut, side = split
                    goes_left = side == 1 if codes[i, f] == missing else codes[i, f] <= cut
                    nxt[i] += not goes_left
            leaf = nxt
        out += p.rate * np.array([values.get(k, 0.0) for k in leaf.tolist()])
    return out


def test_the_same_as_trees_by_rows(spark):
    p = B.Params(trees=3, depth=2, bins=6, least=8, share=1.0, rate=0.5)
    rows = table(260, 1)
    df = spark.createDataFrame(rows, SCHEMA)
    got, shares = B.boosted(df, [104, 105], ["a", "b", "c"], params=p, key=["entity"])
    got = {r.entity: (r.t, r.prediction) for r in got.collect()}
    data, missing = B.binned(df, ["a", "b", "c"], "t <= 104", p.bins)
    codes = {r.entity: np.frombuffer(r.codes, np.uint8) for r in data.collect()}
    assert set(got) == {r[0] for r in rows if r[1] in (104, 105)} and max(c.max() for c in codes.values()) == missing
    for origin in (104, 105):
        known = [r for r in rows if r[2] <= origin]
        model = by_rows(np.array([codes[r[0]] for r in known]), np.array([r[3] for r in known]), np.array([r[4] for r in known]), p, missing)
        test = [r[0] for r in rows if r[1] == origin]
        want = follow(model, np.array([codes[i] for i in test]), p, missing)
        assert np.allclose([got[i][1] for i in test], want)
    assert sum(shares.values()) == pytest.approx(1) and shares["a"] > shares["b"] > shares["c"]


def test_targets_after_the_origin_and_the_weights_scale_do_not_matter(spark):
    p = B.Params(trees=2, depth=2, bins=8)
    rows = table(200, 2)
    run = lambda rs: {r.entity: r.prediction for r in B.boosted(spark.createDataFrame(rs, SCHEMA), [103], ["a", "b"], seeds=(1, 2), params=p, key=["entity"])[0].collect()}
    plain = run(rows)
    assert run([(*r[:3], r[3] if r[2] <= 103 else 99.0, *r[4:]) for r in rows]) == plain
    assert run([(*r[:4], r[4] * 1024, *r[5:]) for r in rows]) == plain
    assert run([(*r[:3], r[3] + 5 * (r[2] <= 103), *r[4:]) for r in rows]) != plain


def test_nothing_to_learn_from(spark):
    rows = [(i, 103, 104, None, 1.0, 0.5, None, 1.0) for i in range(5)]
    got, shares = B.boosted(spark.createDataFrame(rows, SCHEMA), [103], ["a", "b"], params=B.Params(trees=1), key=["entity"])
    assert [r.prediction for r in got.collect()] == [None] * 5 and set(shares.values()) == {0.0}


def test_missing_values_find_their_side(spark):
    rows = [(i, 100, 101, 1.0 if i % 3 else -1.0, 1.0, [None, 1.0, 2.0][i % 3], 0.0, 0.0) for i in range(90)]
    rows += [(1000 + i, 101, 102, None, 1.0, v, 0.0, 0.0) for i, v in enumerate((None, 1.0, 2.0))]
    got, _ = B.boosted(spark.createDataFrame(rows, SCHEMA), [101], ["a", "b"], params=B.Params(trees=8, depth=1, rate=0.5, share=1.0), key=["entity"])
    assert [round(r.prediction, 1) for r in got.orderBy("entity").collect()] == [-1.0, 1.0, 1.0]
