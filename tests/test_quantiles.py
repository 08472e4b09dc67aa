"""Exact quantiles by refinement against sorting, with bounds so small that every pass is used."""

from __future__ import annotations

import numpy as np
import pytest

from tidemark.operators import quantiles as Q

LEVELS = [0.0, 0.1, 0.5, 0.731, 0.9, 1.0]


def plain(values, levels=LEVELS) -> list[float]:
    v = np.sort([x for x in values if x is not None and not np.isnan(x)])
    out = []
    for p in levels:
        place = p * (len(v) - 1)
        a, b = v[int(np.floor(place))], v[int(np.ceil(place))]
        out.append(a if a == b else (1 - (place - np.floor(place))) * a + (place - np.floor(place)) * b)
    return out


def groups() -> dict:
    rng = np.random.default_rng(0)
    return {
        "even": rng.random(1500), "normal": rng.normal(size=1200), "ties": np.repeat([1.0, 1.0, 2.0, 5.0], 300), "one": np.full(900, 3.25),
        "spread": np.exp(rng.uniform(-600, 600, 900)) * rng.choice([-1, 1], 900), "outlier": np.r_[rng.normal(size=800), 1e300, -1e300],
        "near": 1 + np.arange(700) * 2.0**-52, "tiny": np.arange(50) * 5e-324, "infinite": np.r_[rng.normal(size=300), [np.inf] * 40, [-np.inf] * 40],
        "extreme": 1.7e308 * rng.uniform(-1, 1, 400), "few": np.array([2.0, 1.0]), "single": np.array([7.0]), "holes": np.r_[rng.random(500), [np.nan] * 50], None: rng.random(600),
    }


def test_groups_of_every_shape(spark):
    found = groups()
    rows = [(k, float(v), 1) for k, vs in found.items() for v in vs] + [("even", None, 1), ("nothing", None, 1)]
    df = spark.createDataFrame(rows, "k string, x double, v int")
    for small, bins, gather in ((5, 16, 2), (1 << 18, 1024, 4096)):
        got = {r["k"]: r["q"] for r in Q.quantiles(df, "x", LEVELS, ["k"], small=small, bins=bins, gather=gather).collect()}
        assert got.keys() == found.keys()
        for k, vs in found.items():
            assert np.array_equal(got[k], plain(vs)) or np.allclose(got[k], plain(vs), rtol=1e-14), (k, small, got[k], plain(vs))


def test_one_group_two_keys_and_plain_joins(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(int(a), None if b == 2 else str(b), float(x)) for a, b, x in zip(rng.integers(0, 3, 2000), rng.integers(0, 3, 2000), rng.normal(size=2000), strict=True)]
    df = spark.createDataFrame(rows, "a int, b string, x double").repartition(7)
    assert np.allclose(Q.quantiles(df, "x", [0.3], small=10, bins=16, gather=4).first().q, plain([r[2] for r in rows], [0.3]))
    monkeypatch.setattr(Q, "BROADCAST", 1)  # then both sides are shuffled
    got = {(r.a, r.b): r.q for r in Q.quantiles(df, "x", [0.25, 0.5], ["a", "b"], small=10, bins=16, gather=4).collect()}
    want: dict = {}
    for a, b, x in rows:
        want.setdefault((a, b), []).append(x)
    assert got.keys() == want.keys() and all(np.allclose(got[k], plain(v, [0.25, 0.5])) for k, v in want.items())
    assert Q.quantiles(df.where("a > 9"), "x", [0.5], ["a"]).count() == 0


@pytest.mark.parametrize(("bins", "gather"), [(16, 3), (1024, 1 << 18)])
def test_sums_without_listing_them(spark, bins, gather):
    rng = np.random.default_rng(2)
    own = {"a": rng.normal(size=400), "b": np.repeat([0.0, 1.0], 150), "c": np.array([5.0]), "d": np.exp(rng.uniform(-40, 40, 300))}
    shifts = {"a": rng.normal(size=7), "b": [0.0, 1.0, 1.0], "c": [2.0, 3.0], "d": rng.normal(size=3), "e": [1.0]}
    values = spark.createDataFrame([(k, float(v)) for k, vs in own.items() for v in vs], "k string, x double")
    moves = spark.createDataFrame([(k, float(v)) for k, vs in shifts.items() for v in vs], "k string, c double")
    got = {r["k"]: r["q"] for r in Q.sum_quantiles(values, "x", moves, "c", LEVELS, ["k"], bins=bins, gather=gather).collect()}
    assert got.keys() == own.keys()
    for k, vs in own.items():
        assert np.allclose(got[k], plain([v + c for v in vs for c in shifts[k]]), rtol=1e-13, atol=1e-13), k
