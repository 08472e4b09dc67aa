"""The round's findings: what grew with origins and repeats, against plain versions on small data."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import boosting as B
from tidemark.operators import forecast as M
from tidemark.operators import nulltest as N
from tidemark.operators import quantiles as Q
from tidemark.operators.ridge import ridge


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("types", ["entity long, t long, h int", "entity int, t int, h long"])
def test_draws_are_those_of_spark_hashes(spark, types):
    rows = [(e, 24_000 + t, h) for e in (-5, 3, 2**30, 77) for t in range(3) for h in (3, 1, 2)]
    df = spark.createDataFrame(rows, types)
    frame = df.toPandas()
    starts = N._starts(spark.createDataFrame([(24_001,), (24_002,)], "origin long"), 2)
    draws = N.Draws([frame[c].to_numpy() for c in N.ROW])
    assert set(starts) == {(k, o) for k in (1, 2) for o in (24_001, 24_002)}
    for (k, o), s in starts.items():
        before = [F.lit(k), F.lit(o).cast("long"), *N.ROW]
        unit = lambda salt, c, before=before: (F.pmod(F.xxhash64(F.lit(salt), F.lit(c), *before), F.lit(2**31)) + 0.5) / 2**31
        normal = [(F.sqrt(-2 * F.ln(unit(1, c))) * F.cos(2 * np.pi * unit(2, c))).alias(c) for c in N.NUMERIC]
        want = df.select(*normal, F.pmod(F.xxhash64(F.lit("moy"), *before), F.lit(12)).alias("month")).toPandas()
        assert np.allclose(np.column_stack(list(draws.normal(s[:-1], len(frame)))), want[list(N.NUMERIC)], atol=1e-12)
        assert draws.months(s[-1:], len(frame)).tolist() == want.month.tolist()
        assert np.allclose(list(draws.normal(s[:-1], 5)), want[list(N.NUMERIC)].to_numpy()[:5].T, atol=1e-12)


def test_cycles_follow_hash_and_key_whatever_the_keys(spark):
    rng = np.random.default_rng(3)
    for keys in (rng.integers(-(2**62), 2**62, 3000), rng.integers(0, 40, 3000), np.zeros(5, int), np.array([7])):
        values, order = rng.normal(size=len(keys)), np.lexsort((keys, N.mixed(keys, 2, 24_000, 1)))
        want = np.empty_like(values)
        want[order] = np.roll(values[order], -1)
        assert (N.cycled(values, keys, 2, 24_000, 1) == want).all()


def test_null_test_hands_each_row_over_once_a_scenario_kind(spark, monkeypatch):
    """Training rows reach Python as they are: not for each origin, nor for each repeat."""
    panel = spark.createDataFrame([(e, 24_000 + t, 100.0 + e + 7 * (t * e % 5)) for e in range(6) for t in range(40)], "entity long, month long, value double")
    origins, rows, seen = [24_033, 24_035], M.supervised(panel, (1, 2)), []
    solved = N.solved
    monkeypatch.setattr(N, "solved", lambda parts: seen.append(parts) or solved(parts))
    pred = N.null_predictions(rows, panel, origins, repeats=3)
    assert "Generate" not in _plan(seen[0]) and _plan(seen[0]).count("MapInPandas") == 1 and _plan(seen[0]).count("FlatMapGroupsInPandas") == 2
    assert {r[0]: r[1] for r in pred.groupBy("model").count().collect()} == {m: 6 * 2 * 2 for m in ("real#0", "seasonal#0", "constant#0", "drift#0", *(f"{s}#{k}" for s in N.SPOILT for k in (1, 2, 3)))}


def test_supervised_rows_need_no_join_of_the_panel(spark):
    """Bases and facts as a join by month gives them, also where months are missing."""
    values = [(e, 24_000 + t, 50.0 + 3 * t + e) for e in range(3) for t in range(40) if (t * 7 + e) % 11]
    panel = spark.createDataFrame(values, "entity long, month long, value double")
    rows = M.supervised(panel, (1, 3, 12, 13))
    assert "LeftOuter, (entity" not in _plan(rows) and {r.h for r in rows.select("h").distinct().collect()} == {1, 3, 12}
    known = {(e, m): v for e, m, v in values}
    got = rows.collect()
    assert sorted((r.entity, r.t, r.h) for r in got) == sorted((e, m, h) for e, m, _ in values for h in (1, 3, 12))
    for r in got:
        y, base = known.get((r.entity, r.month)), known.get((r.entity, r.month - 12))
        assert r.month == r.t + r.h and r.moy == r.month % 12 and (r.y, r.base) == (y, base)
        assert r.g is None if y is None or base is None else r.g == pytest.approx(np.log(y / base))


@pytest.mark.parametrize("listed", [100_000, 20, 0])
def test_column_ranks_are_those_of_sorted_values(spark, listed):
    rng = np.random.default_rng(5)
    wild = np.concatenate([rng.normal(size=200), [1e300, -1e300, np.inf, -np.inf, 5e-324, -5e-324, 0.0, -0.0, np.nan], np.full(91, 2.5)])
    columns = [rng.permutation(wild), rng.integers(1, 4, 300).astype(float), np.full(300, np.nan), np.exp(40 * rng.normal(size=300))]
    rows = [(*(None if np.isnan(v) and i % 2 else float(v) for v in x), i % 3) for i, x in enumerate(np.array(columns).T)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, p int").repartition(3)
    ranks = lambda n: sorted({0, n - 1, (n - 1) // 2, n // 3})
    got = Q.column_ranks(df, list("abcd"), ranks, "p", 3, listed=listed)
    for k in range(3):
        for (n, found), x in zip(got[k], columns, strict=True):
            own = np.sort(x[(np.arange(300) % 3 <= k) & ~np.isnan(x)])
            assert n == len(own) and found == ([own[r] for r in ranks(n)] if n else [])


def test_ridge_medians_and_cuts_do_not_depend_on_the_order_of_rows(spark):
    """Approximate medians did: they differed with the partitions."""
    rng = np.random.default_rng(6)
    rows = [(i, 100 + i % 7, 1, 101 + i % 7, 1.0 + i % 5, float(rng.normal()), None if i % 4 == 0 else float(rng.exponential())) for i in range(30_000)]
    df = spark.createDataFrame(rows, "entity int, t int, h int, month int, base double, g double, a double").withColumn("y", F.lit(1.0))
    known = np.sort([r[6] for r in rows if r[6] is not None and r[3] <= 103])
    seen = [ridge(df.repartition(n, "entity"), [103, 105], ["a"]) for n in (1, 7)]
    one, other = ({(r.entity, r.t): r.prediction for r in x.collect()} for x in seen)
    assert one == pytest.approx(other, abs=1e-12) and len(one) == sum(r[1] in (103, 105) for r in rows)
    filled = {r.prediction for r in seen[0].where("t = 103 and a is null").collect()}
    at = min((abs(r[6] - known[(len(known) - 1) // 2]), r[0]) for r in rows if r[6] is not None and r[1] == 103)
    assert at[0] < 1e-3 and one[at[1], 103] == pytest.approx(filled.pop(), abs=1e-4) and not filled
    edges = B.edges_of(df, ["a", "h"], "month <= 103", 8)
    assert edges[0] == pytest.approx(np.quantile(known, np.arange(1, 8) / 8), rel=1e-14) and edges[1].tolist() == [1.0]


def test_features_of_few_bins_are_counted_together():
    rng = np.random.default_rng(7)
    codes = np.array([rng.integers(0, 33, 500), rng.integers(0, 33, 500), rng.integers(4, 7, 500), rng.integers(0, 12, 500) * 2, np.full(500, 32)], np.uint8)
    made = B.joints([np.unique(c) for c in codes])
    assert sorted(f for j in made for f in j.features) == [0, 1, 2, 3, 4] and len(made) == 2
    for j in made:
        code = j.code(codes, 33, 6)
        assert (code % 6 == 0).all() and code.max() < 6 * np.prod(j.shape)
        for at, f in zip(np.unravel_index(code // 6, j.shape), j.features, strict=True):
            assert (j.values[j.features.index(f)][at] == codes[f]).all()


def test_values_near_an_interval():
    rng = np.random.default_rng(8)
    x, low, high = rng.normal(size=4000), np.array([-1.0, 0.3, 2.0, np.nan]), np.array([-0.99, 0.31, 2.0, np.nan])
    some = B.near(x, low, high)
    inside = np.flatnonzero(((x >= -1) & (x <= -0.99)) | ((x >= 0.3) & (x <= 0.31)))
    assert set(inside) <= set(some.tolist()) and len(some) < len(inside) + 60


def test_levels_read_signs_and_no_predictions(spark, monkeypatch):
    """A level's pass reads a byte a group in place of predictions and targets."""
    rng = np.random.default_rng(9)
    rows = [(bytes(rng.integers(0, 5, 2).astype(np.uint8)), 1 + i % 9, float(rng.normal()), 1.0 + i % 3, i) for i in range(600)]
    df = spark.createDataFrame(rows, "codes binary, month int, target double, weight double, key long")
    read, summed = [], B.Trainer._summed
    monkeypatch.setattr(B.Trainer, "_summed", lambda self, run, columns, by, read_=(), **k: read.append((run.__qualname__, set(read_), set(self.blocks.columns))) or summed(self, run, columns, by, read_, **k))
    models = B.Trainer(df, 2, 5, [(4, 1), (9, 1)], B.Params(trees=2, depth=2, bins=5)).train()
    levels = [r for name, r, held in read if "_level" in name and "signs" in held]
    assert len(levels) == 2 and all("made" not in r and "target" not in r and "signs" in r for r in levels) and all(len(m.trees) == 2 for m in models)
