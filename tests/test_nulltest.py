"""The null test: permutations, fits against NumPy, no leak of targets after an origin, and data that have or lack a signal."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import forecast as M
from tidemark.operators import nulltest as N
from tidemark.plans.catalog import QUERIES

ORIGINS = [24_034, 24_036]


@pytest.fixture(scope="module")
def panel(spark):
    """Growth that goes on: a series' growth of last month tells this month's."""
    rng, rows = np.random.default_rng(2), []
    for e in range(40):
        g, level = 0.0, np.full(40, 100.0 + e)
        for t in range(12, 40):
            g = 0.95 * g + 0.05 * rng.normal()
            level[t] = level[t - 12] * np.exp(g)
        rows += [(e, 24_000 + t, float(v)) for t, v in enumerate(level)]
    return spark.createDataFrame(rows, "entity long, month long, value double")


@pytest.fixture(scope="module")
def pred(panel):
    return N.null_predictions(M.supervised(panel, (1, 2)), panel, ORIGINS, repeats=3).toPandas()


@pytest.mark.parametrize("size", [1_000_000, 7])
def test_shuffled_is_a_cycle_in_each_group(spark, size):
    df = spark.range(200).select((F.col("id") % 3).alias("g"), "id", F.col("id").cast("double").alias("v"))
    df = df.unionByName(spark.createDataFrame([(9, 1000, 1000.0)], "g long, id long, v double"))
    got = N.shuffled(df, ["g"], ["id"], "v", size).toPandas()
    assert got.columns.tolist() == ["g", "id", "v"] and len(got) == 201
    for g, part in got.groupby("g"):
        after = dict(zip(part.id, part.v.astype(int), strict=True))
        at, seen = part.id.iloc[0], []
        while at not in seen:
            seen.append(at)
            at = after[at]
        assert len(seen) == len(part), g
    assert not (got[got.g != 9].id == got[got.g != 9].v).any()


def test_fits_are_ridge_solutions(spark):
    rng = np.random.default_rng(4)
    x, g, w = np.column_stack([np.ones(60), rng.normal(size=(60, 2))]), rng.normal(size=60), rng.uniform(0.5, 2, 60)
    rows = [("real", 0, i % 2, x[i].tolist(), float(g[i]), float(w[i])) for i in range(60)]
    df = spark.createDataFrame(rows, "scenario string, repeat int, origin long, x array<double>, g double, w double").repartition(5)
    for r in N.fits(df).collect():
        own = np.arange(60) % 2 == r.origin
        a, b, v = x[own], g[own], w[own]
        penalty = np.diag([0, 0.1, 0.1]) * v.sum()
        assert np.allclose(r.beta, np.linalg.solve((a * v[:, None]).T @ a + penalty, (a * v[:, None]).T @ b))


def test_targets_after_an_origin_change_nothing(panel, pred):
    """Facts after the first origin are replaced; what is predicted from it stays, in every scenario."""
    later = panel.withColumn("value", F.when(F.col("month") > ORIGINS[0], F.col("value") * (2 + F.col("entity") % 5)).otherwise(F.col("value")))
    spoilt = N.null_predictions(M.supervised(later, (1, 2)), later, ORIGINS[:1], repeats=3).toPandas()
    key = ["model", "entity", "origin", "h"]
    both = pred[pred.origin == ORIGINS[0]].merge(spoilt, on=key, suffixes=("", "_b"))
    assert len(both) == len(spoilt) == (pred.origin == ORIGINS[0]).sum()
    assert np.allclose(both.yhat, both.yhat_b) and not np.allclose(both.y, both.y_b)


def test_facts_are_not_shuffled(panel, pred):
    fact = panel.toPandas().set_index(["entity", "month"]).value
    assert np.allclose(pred.y, fact.loc[list(zip(pred.entity, pred.month, strict=True))].to_numpy())
    assert (pred.groupby("model").size() == 40 * 2 * 2).all() and pred.model.nunique() == 1 + 3 * 3 + 3


def test_a_signal_is_told_from_chance(spark, panel, pred):
    got = N.summary(spark.createDataFrame(pred)).toPandas().set_index("versus")
    for scenario in N.SPOILT:
        assert got.p[scenario] == 0.25 and got.repeats[scenario] == 3 and got.mae[scenario] > 1.3 * got.mae_real[scenario], scenario
    assert (got.skill[["seasonal", "constant"]] > 0.2).all() and got.share_better["seasonal"] > 0.6
    mae = (pred.y - pred.yhat).abs().groupby(pred.model).mean()
    assert got.mae_real["drift"] == pytest.approx(mae["real#0"]) and got.mae["drift"] == pytest.approx(mae["drift#0"])


def test_queries(spark, sf_dir):
    runs = QUERIES["null_test_runs"](spark, sf_dir).toPandas()
    assert runs.groupby("scenario").size().to_dict() == {"real": 1, **dict.fromkeys(N.SPOILT, 5), "seasonal": 1, "constant": 1, "drift": 1}
    assert runs.n.nunique() == 1
    summary = QUERIES["null_test_summary"](spark, sf_dir).toPandas().set_index("versus")
    assert set(summary.index) == {*N.SPOILT, "seasonal", "constant", "drift"} and summary.p.notna().sum() == 3
    for s in N.SPOILT:
        null = runs[runs.scenario == s].mae
        assert summary.p[s] == pytest.approx((1 + (null <= summary.mae_real[s]).sum()) / 6, abs=1e-6)
