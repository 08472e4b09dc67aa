"""Queries that SQL can't express, against plain NumPy and Python versions, and models on data whose answer is known."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluate as E
from tidemark.operators import forecast as M
from tidemark.operators import smoothing
from tidemark.plans.base import setting
from tidemark.plans.catalog import QUERIES
from tidemark.plans.forecast_queries import HORIZONS, full, predictions
from tidemark.session import checkpointed


@pytest.fixture(scope="module")
def at(spark, sf_dir):
    return setting(spark, sf_dir)


def test_window_comes_from_the_data(spark, sf_dir, at):
    months = at.panel.groupBy("month").count().toPandas()
    total = at.panel.select("entity").distinct().count()
    whole = months[10 * months["count"] >= 9 * total].month
    assert (at.first, at.last) == (whole.min(), whole.max()) and len(at.origins) == 7 and at.origins[-1] == at.last - 3


def test_greedy_selection(spark, sf_dir, at):
    pred = predictions(at).toPandas()
    wide = pred.pivot_table(index=["entity", "origin", "h", "month", "y"], columns="model", values="yhat").dropna().reset_index()
    known, models = wide[wide.month <= at.cut], sorted(pred.model.unique())
    chosen, best = [], np.inf
    while len(chosen) < 12:
        found = {m: (known.y - known[[*chosen, m]].mean(axis=1)).abs().mean() for m in models}
        pick = min(models, key=lambda m: (found[m], m))
        if found[pick] >= best - 0.5:
            break
        chosen.append(pick)
        best = found[pick]
    late = wide[wide.origin >= at.cut]
    want = (late.y - late[chosen].mean(axis=1)).abs().groupby(late.origin).mean()
    got = QUERIES["greedy_selection"](spark, sf_dir).toPandas().set_index("origin")
    assert set(got.members) == {"+".join(chosen)} and np.allclose(got.mae.sort_index(), want.sort_index(), atol=1e-3)


def _panel(spark, value, months=40, entities=6):
    rows = [(e, 24_000 + t, float(value(e, t))) for e in range(entities) for t in range(months)]
    return spark.createDataFrame(rows, "entity long, month long, value double")


def test_fourier_trend_recovers_what_it_models(spark, sf_dir):
    value = lambda e, t: np.exp(3 + 0.1 * e + 0.01 * t + 0.2 * np.sin(2 * np.pi * t / 12) + 0.1 * np.cos(4 * np.pi * t / 12))
    for r in M.fourier_trend(_panel(spark, value), [24_030], 6).collect():
        assert r.month == r.origin + r.h and r.yhat == pytest.approx(value(r.entity, r.month - 24_000), rel=1e-6)
    rows = QUERIES["fourier_trend_forecast"](spark, sf_dir).toPandas()
    p = full(setting(spark, sf_dir)).toPandas()
    r = rows.iloc[0]
    hist = p[(p.entity == r.entity) & (p.month <= r.origin)].sort_values("month")
    design = lambda m: np.array([1, (m - r.origin) / 12, *(np.sin(2 * np.pi * k * (m - r.origin) / 12) for k in (1, 2, 3)), *(np.cos(2 * np.pi * k * (m - r.origin) / 12) for k in (1, 2, 3))])
    beta = np.linalg.lstsq(np.array([design(m) for m in hist.month]), np.log(hist.value.to_numpy()), rcond=None)[0]
    assert r.yhat == pytest.approx(np.exp(design(r.month) @ beta), rel=1e-6)


def test_ets(spark, sf_dir, at):
    rows = QUERIES["ets_forecast"](spark, sf_dir).toPandas()
    p = full(at).toPandas()
    p["l"] = np.log(p.value)
    factor = p.groupby("month").l.median()
    entities = p.entity.nunique()
    assert len(rows) == entities * len(at.origins) * 3
    for r in rows[rows.h == 2].iloc[:3].itertuples():
        dev = (p[p.entity == r.entity].set_index("month").l - factor).loc[: r.origin].sort_index().to_numpy()
        growth = np.mean([factor[r.origin - i] - factor[r.origin - i - 12] for i in range(3)])
        assert r.yhat == pytest.approx(np.exp(factor[r.month - 12] + growth + smoothing.forecast(dev[None], 3)[0][0, 1]), rel=1e-5)


def test_ridge_is_the_weighted_least_squares_solution(spark):
    """Against the closed form: standardised inputs, penalty on their weights, weights of mean one."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(300):
        x = rng.normal(size=2)
        rows.append((i, 24_000 + i % 5, 1, 24_001 + i % 5, float(50 + 10 * rng.random()), float(0.2 * x[0] - 0.1 * x[1] + 0.02 * rng.normal()), float(x[0]), float(x[1])))
    df = spark.createDataFrame(rows, "entity long, t long, h int, month long, base double, g double, a double, b double").withColumn("moy", F.lit(1.0)).withColumn("y", F.lit(None).cast("double"))
    test = df.where("entity < 5").withColumn("t", F.lit(24_010).cast("long")).withColumn("month", F.lit(24_011).cast("long")).withColumn("g", F.lit(None).cast("double"))
    got = M.global_model(df.unionByName(test), 24_010, "ridge", features=("a", "b", "moy")).toPandas().set_index("entity")
    t = pd.DataFrame(rows, columns="entity t h month base g a b".split())
    w = t.base / t.base.mean()
    x = t[["a", "b"]].to_numpy()
    sx = x.std(axis=0, ddof=1)
    z = (x - x.mean(axis=0)) / sx
    zm, gm = np.average(z, axis=0, weights=w), np.average(t.g, weights=w)
    zs, gs = np.sqrt(np.average((z - zm) ** 2, axis=0, weights=w)), np.sqrt(np.average((t.g - gm) ** 2, weights=w))
    c, d = (z - zm) / zs, (t.g - gm) / gs
    beta = np.linalg.solve((c * w.to_numpy()[:, None]).T @ c / w.sum() + 0.1 / gs * np.eye(2), (c * w.to_numpy()[:, None]).T @ d / w.sum()) * gs / zs
    for e in range(5):
        want = t.base[e] * np.exp(gm + (z[e] - zm) @ beta)
        assert got.yhat[e] == pytest.approx(want, rel=5e-3)
    assert got.h.tolist() == [1] * 5


@pytest.mark.parametrize("backend", ["random_forest", "gbt"])
def test_trees_learn_a_step(spark, backend):
    rng = np.random.default_rng(6)
    rows = [(i, 24_000, 1, 24_001, 10.0, 0.5 if (x := float(rng.uniform(-1, 1))) > 0 else -0.5, x, float(rng.normal())) for i in range(400)]
    rows += [(1000 + i, 24_010, 1, 24_011, 10.0, None, x, 0.0) for i, x in enumerate((-0.8, -0.3, 0.3, 0.8))]
    df = spark.createDataFrame(rows, "entity long, t long, h int, month long, base double, g double, a double, b double").withColumn("moy", F.lit(1.0)).withColumn("y", F.lit(None).cast("double"))
    got = M.global_model(df, 24_010, backend, features=("a", "b", "moy")).orderBy("entity").toPandas()
    low, high = got.yhat[:2].to_numpy(), got.yhat[2:].to_numpy()
    assert (low < 8.5).all() and (high > 11.5).all()
    if backend == "gbt":  # a forest's trees don't all see the feature
        assert np.allclose(got.yhat, 10 * np.exp([-0.5, -0.5, 0.5, 0.5]), rtol=0.15)
    shares = {r.feature: r.share for r in M.importances(df, 24_010, backend, seeds=(1, 2), features=("a", "b", "moy")).collect()}
    assert sum(shares.values()) == pytest.approx(1) and shares["a"] > 0.8 and set(shares) == {"a", "b", "moy"}


@pytest.mark.parametrize("name", ["ridge_forecast", "random_forest_forecast", "gbt_forecast", "gbt_offset_forecast", "ridge_covariates_forecast"])
def test_learned_forecasts_cover_every_origin(spark, sf_dir, at, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    entities = full(at).select("entity").distinct().count()
    assert set(got.origin) == set(at.origins) and set(got.h) == set(HORIZONS) and len(got) == entities * len(HORIZONS) * len(at.origins)
    naive = predictions(at, ("naive",)).toPandas()
    assert (got.y - got.yhat).abs().mean() < 1.2 * (naive.y - naive.yhat).abs().mean()


def test_learned_metrics_cover_all_cuts(spark, sf_dir):
    m = QUERIES["learned_metrics"](spark, sf_dir).toPandas()
    assert len(m) == 4 * (1 + 3 + 7) and m[m.h.eq(-1) & m.origin.eq(-1)].n.nunique() == 1 and (m.mae > 0).all()


def test_learned_models_on_targets_that_they_have_not_seen(spark):
    """At a size where there are rows enough to learn from: on targets they haven't seen, both beat the seasonal model's error, and in what the
    trees are fitted for (the absolute error of the log growth) they beat the ridge model. Growth is noise here, so no growth at all is hard to beat in that."""
    d = "/root/testdata/sf0.01"
    at = setting(spark, d)
    rows = checkpointed(M.supervised(full(at), HORIZONS))
    pred = predictions(at, ("seasonal",))
    for name in ("ridge", "gbt"):
        pred = pred.unionByName(M.global_model(rows, at.origins, name).withColumn("model", F.lit(name)).select(pred.columns))
    error = E.shared_points(checkpointed(pred).where("y > 0 and yhat > 0")).groupBy("model").agg(F.avg(F.abs(F.ln(F.col("y") / F.col("yhat")))).alias("e"), F.avg(F.abs(F.col("y") - F.col("yhat"))).alias("mae"))
    found = {r.model: r for r in error.collect()}
    assert found["gbt"].e < found["ridge"].e
    assert max(found["gbt"].mae, found["ridge"].mae) < found["seasonal"].mae


def test_seeds_are_averaged_and_an_offset_is_given_back(spark, at):
    rows = M.supervised(full(at), (1,)).withColumn("level", F.lit(0.25))
    one, two, both = (M.global_model(rows, at.origins[-1], "gbt", seeds=s).toPandas().set_index("entity").yhat for s in ((1,), (2,), (1, 2)))
    assert not np.allclose(one, two) and np.allclose(np.log(both), (np.log(one) + np.log(two)) / 2)
    shifted = M.global_model(rows, at.origins[-1], "gbt", seeds=(1,), offset="level").toPandas().set_index("entity").yhat
    assert np.allclose(shifted, one)


def test_covariates_reach_the_model(spark, at):
    rows = M.supervised(full(at), (1,)).withColumn("hint", F.coalesce("g", F.lit(0.0)))
    plain = M.global_model(rows, at.origins[-1], "ridge").toPandas()
    told = M.global_model(rows, at.origins[-1], "ridge", features=(*M.FEATURES, "hint")).toPandas()
    error = lambda f: (f.y - f.yhat).abs().mean()
    assert error(told) < 0.7 * error(plain)


def test_feature_importance(spark, sf_dir):
    rows = QUERIES["feature_importance"](spark, sf_dir).collect()
    shares = [r.share for r in rows]
    assert len({r.feature for r in rows}) == len(rows) <= 10 and shares == sorted(shares, reverse=True)
    assert {r.feature for r in rows} <= set(M.FEATURES) and sum(shares) == pytest.approx(1)


def test_classifier_and_its_report(spark, sf_dir):
    pred = QUERIES["embedding_classifier_cv"](spark, sf_dir).toPandas()
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas()
    assert sorted(pred.vec_id) == sorted(vectors.vec_id) and pred.p.between(1 / vectors.label.nunique(), 1).all()
    assert dict(zip(pred.vec_id, pred.label.astype(int), strict=True)) == dict(zip(vectors.vec_id, vectors.label, strict=True))
    got = QUERIES["classifier_report"](spark, sf_dir).toPandas().set_index("label")
    for k in set(pred.label) | set(pred.prediction):
        hit, said, real = ((pred.label == k) & (pred.prediction == k)).sum(), (pred.prediction == k).sum(), (pred.label == k).sum()
        assert got.recall[k] == pytest.approx(hit / real) and got.f1[k] == pytest.approx(2 * hit / (said + real))
        assert (np.isnan(got.precision[k]) and not said) or got.precision[k] == pytest.approx(hit / said)
