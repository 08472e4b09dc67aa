"""Cases of the third round's findings on larger tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidemark.functions import gazetteer as G
from tidemark.functions.ratio import sorted_words, token_sort_ratio
from tidemark.operators import forecast as M
from tidemark.operators import match as J
from tidemark.operators import smoothing as S


def test_a_narrow_pool_finds_the_same_in_few_calls():
    """What a function finds doesn't depend on how many are worked on with it; a few that take long don't hold up the others."""
    rng = np.random.default_rng(9)
    goal, calls = rng.normal(size=(60, 3)), []

    def cost(rows, x):
        calls.append(len(rows))
        return (((x - goal[rows]) * [1.0, 10.0, 0.1]) ** 2).sum(axis=1) + np.abs(x[:, 0] * x[:, 1])

    again = lambda p: (p, np.full(p.shape, 0.01))
    start, steps = rng.normal(size=(60, 3)), np.full((60, 3), 0.1)
    wide, least = S.simplex(cost, start, steps, again=again, rounds=3)
    alone = [S.simplex(lambda rows, x, i=i: cost(rows + i, x), start[i : i + 1], steps[i : i + 1], again=again, rounds=3) for i in range(60)]
    assert all((wide[i] == p[0]).all() and least[i] == v[0] for i, (p, v) in enumerate(alone))
    calls.clear()
    narrow, value = S.simplex(cost, start, steps, again=again, rounds=3, width=16)
    assert (narrow == wide).all() and (value == least).all() and np.mean(calls) > 5


def test_smoothing_is_fitted_once(spark):
    rows = [(e, 24_000 + t, float(np.sin(e + t)), 0.1 * t) for e in range(5) for t in range(30)]
    factors = spark.createDataFrame(rows, "entity long, month long, l double, f double")
    whole, small = M.ets_deviation(factors, [24_020, 24_025], 3), M.ets_deviation(factors, [24_020, 24_025], 3, block=2)
    assert "MapInPandas" not in whole._jdf.queryExecution().toString()
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, small.collect())) and whole.count() == 30


def test_names_of_one_region_that_share_most_of_their_letters_are_not_compared_with_all(spark):
    """Against all pairs; and what meets before the ratio decides stays near what is similar, though 600 titles share all but four digits."""
    numbers = np.random.default_rng(4).choice(10_000, 600, replace=False).tolist()
    titles = [(n, 1, f"Trade house Supplier 00000{n:04d}") for n in numbers] + [(90_000, 2, "Trade house Supplier 000000007"), (90_001, 1, ""), (90_002, None, "x")]
    names = [(f"yTrade house Supplier 00000{n:04d}", 1) for n in numbers[:40]] + [("Trade hose Suplier 000000007", 2), ("rade house upplier 000000007", 1), (None, 1), ("", 1), ("Trade house Supplier 000000007 or more", 2)]
    left, right = spark.createDataFrame(names, "name string, region int"), spark.createDataFrame(titles, "entity long, region int, title string")
    for cutoff in (92, 80, 97):  # two edits; six, so pieces; none
        got = {(r["name"], r["entity"]): r["score"] for r in J.similar_names(left, right, ["region"], cutoff).collect()}
        every = left.join(right, "region").withColumn("score", token_sort_ratio(F.col("name"), F.col("title"))).where(F.col("score") >= cutoff)
        assert got == {(r["name"], r["entity"]): r["score"] for r in every.collect()} and (len(got) > 40 or cutoff == 97)
    a = left.withColumn("_x", sorted_words(F.col("name"))).withColumn("_n", F.length("_x"))
    b = right.withColumn("_y", sorted_words(F.col("title"))).withColumn("_len", F.length("_y"))
    assert J._met_by_remains(a, b, ["region"], 92).distinct().count() < 40 * 60


def test_a_common_stem_is_counted_once(spark):
    """Names whose stems are those of all titles of their region: as many candidates, without a row for each."""
    titles = spark.createDataFrame([(i, 1, f"Supplier house 0000001{i:03d}") for i in range(300)] + [(5, 1, "Supplier house 0000001777")], "entity long, region int, title string")
    names = spark.createDataFrame([(f"Suppliers houses 0000009{i:03d}", 1) for i in range(20)], "name string, region int")
    got = J.cascade_match(names, titles)
    assert {(r["entity"], r["match"], r["candidates"]) for r in got.collect()} == {(None, "ambiguous", 300)} and got.count() == 20


def test_ridge_of_all_origins_takes_the_passes_of_one(spark):
    """With missing values, a feature that only later origins know, and months unseen before: each origin against the closed form."""
    rng, rows = np.random.default_rng(3), []
    for i in range(400):
        a, t = float(rng.normal(5, 2)), 24_000 + i % 8
        rows.append((i, t, 1, t + 1, float(rng.uniform(1, 9)), 0.3 * a + float(rng.normal()), None if i % 5 == 0 else a, float(rng.normal()) if t > 24_004 else None, 2.0, float(t % 12)))
    df = spark.createDataFrame(rows, "entity long, t long, h int, month long, base double, g double, a double, b double, c double, moy double").withColumn("y", F.lit(1.0))
    jobs = {}
    for origins in ([24_003], [24_003, 24_005, 24_006]):
        spark.sparkContext.setJobGroup(f"ridge {len(origins)}", "")
        got = {(r["origin"], r["entity"]): r["yhat"] for r in M.global_model(df, origins, "ridge", features=("a", "b", "c", "moy")).collect()}
        jobs[len(origins)] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"ridge {len(origins)}"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] == jobs[3] and len(got) == 150
    for o in origins:
        x = np.array([[np.nan if v is None else v for v in r[6:9]] + [float(r[9] == m) for m in range(12)] for r in rows])
        known, g, w = np.array([r[3] <= o for r in rows]), np.array([r[5] for r in rows]), np.array([r[4] for r in rows])
        for k in range(3):
            own = np.sort(x[known & ~np.isnan(x[:, k]), k])
            x[np.isnan(x[:, k]), k] = own[(len(own) - 1) // 2] if len(own) else 0.0
        mean, w = np.average(x[known], axis=0, weights=w[known]), w[known]
        d, e = x[known] - mean, g[known] - np.average(g[known], weights=w)
        sd, se = np.sqrt(np.average(d**2, axis=0, weights=w)), np.sqrt(np.average(e**2, weights=w))
        use = sd > 1e-9
        z = d[:, use] / sd[use]
        beta = np.linalg.solve((z * w[:, None]).T @ z / w.sum() + 0.1 / se * np.eye(use.sum()), (z * w[:, None]).T @ e / w.sum()) / sd[use]
        for r, v in zip(rows, x, strict=True):
            if r[1] == o:
                assert np.isclose(got[o, r[0]], r[4] * np.exp(np.average(g[known], weights=w) + (v - mean)[use] @ beta))


def test_texts_are_scanned_in_small_pieces(spark):
    """More texts in a batch than are held at a time; no frame of a whole batch's texts is made."""
    texts = spark.range(700, numPartitions=1).select("id", F.when(F.col("id") % 7 != 3, F.concat(F.lit("ab "), F.col("id"), F.lit(" ab"))).alias("t"))
    got = G.occurrences(texts, "id", "t", spark.createDataFrame([("ab",), ("699",)], "form string"))
    assert "MapInArrow" in got._jdf.queryExecution().toString() and G.TEXTS < 700
    assert {tuple(r) for r in got.collect()} == {(i, "ab", 2) for i in range(700) if i % 7 != 3} | {(699, "699", 1)}
