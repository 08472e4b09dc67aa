"""Cases of the third round's findings."""

from __future__ import annotations

import os

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.operators import boosting as B
from tidemark.operators import features as X
from tidemark.operators import forest as FO
from tidemark.operators import match as J
from tidemark.operators import nulltest as N
from tidemark.plans import comparison_queries
from tidemark.plans.catalog import QUERIES, SQL
from tidemark.session import stored
from tidemark.sources import workbooks as W


def test_a_model_never_beats_itself(spark, monkeypatch):
    """An error that is computed twice differs in its last digits; here the sums' order is replaced by a jitter."""
    points = [(m, e, o, 100.0 + e, 100.0 + k * (e + 1)) for k, m in enumerate(("naive", "drift")) for o in range(40) for e in range(5)]
    schema = "model string, entity long, origin long, y double, yhat double"

    def jitter(frames):
        for f in frames:
            yield f.assign(yhat=f["yhat"] + np.random.default_rng().normal(0, 1e-9, len(f)))

    monkeypatch.setattr(comparison_queries, "setting", lambda spark, d: None)
    monkeypatch.setattr(comparison_queries, "predictions", lambda at: spark.createDataFrame(points, schema).mapInPandas(jitter, schema))
    found = {r["model"]: r["better"] for r in comparison_queries.model_table(spark, "").collect()}
    assert found == {"naive": 0, "drift": 40}


def test_titles_with_entities_and_vertical_tabs_match_the_sql(spark, tmp_path):
    titles = ["a &lt;b&gt; &amp; c", "&quot;x&quot;&nbsp;&#39;y&#39;", "&amp;lt; &amp;amp;", " a\x0b\t b\n", "", "&lt", "100 %&&", "é&gt;ü"]
    pages = pd.DataFrame({"page_id": range(len(titles) + 2), "html": [*(f"<html><title>{t}</title></html>" for t in titles), "<p>none</p>", None]})
    pages.to_parquet(tmp_path / "pages.parquet")
    got = {r["page_id"]: (r["title"], r["raw_chars"]) for r in QUERIES["page_titles"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet'")
    assert got == {p: (t, n) for p, t, n in con.sql(SQL["page_titles"]).fetchall()}
    assert got[0][0] == "a <b> & c" and got[1][0] == "\"x\" 'y'" and got[2][0] == "&lt; &amp;" and got[3][0] == "a b"


def test_boosting_packs_rows_in_blocks_and_leaves_no_table_behind(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(bytes(rng.integers(0, 5, 2, dtype=np.uint8).tolist()), int(rng.integers(0, 9)), float(rng.normal()), 1.0, i) for i in range(500)]
    df = spark.createDataFrame(rows, "codes binary, month long, target double, weight double, key long")
    blocks = [{c: np.frombuffer(r[c], k) for c, k in B.KINDS.items()} for r in B.packed(df, 2, 50).collect()]
    back = [(bytes(c), int(m), g, w, k) for b in blocks for c, m, g, w, k in zip(b["codes"].reshape(2, -1).T, b["month"], b["target"], b["weight"], b["key"], strict=True)]
    assert len(blocks) < 12 and sorted(back, key=lambda r: r[4]) == rows and all((np.diff(b["month"]) >= 0).all() for b in blocks)
    folders = []
    monkeypatch.setattr(B, "stored", lambda df, **o: folders.append(stored(df, **o)) or folders[-1])
    B.Trainer(df, 2, 5, [(4, 1), (8, 1)], B.Params(trees=3, depth=2, bins=5)).train()
    assert len(folders) == 3 and not any(os.path.exists(f) for _, f in folders)


def test_null_test_shuffles_are_cycles_within_buckets_and_move_no_features(spark):
    keys = np.random.default_rng(1).integers(-(2**62), 2**62, 50)
    assert not (N.cycled(keys, keys, 1, 2) == keys).any() and sorted(N.cycled(keys, keys, 1, 2)) == sorted(keys) and (N.cycled(keys, keys, 1, 2) != N.cycled(keys, keys, 2, 2)).any()
    rng, rows = np.random.default_rng(2), []
    for i in range(400):
        rows.append((i, 100 + i % 4, int((100 + i % 4) % 12), 2.0, float(rng.normal()), *map(float, rng.normal(size=len(N.NUMERIC)))))
    df = spark.createDataFrame(rows, "_key long, month long, moy int, base double, g double, " + ", ".join(f"{c} double" for c in N.NUMERIC))
    stats = {o: {"_base": 2.0, **{f"m_{c}": 0.0 for c in N.NUMERIC}, **{f"d_{c}": 1.0 for c in N.NUMERIC}} for o in (101, 103)}
    for by in ([], ["month"]):
        placed = N._bucketed(df, by, 30)
        assert placed.groupBy("_bucket").count().count() > 8 and placed.groupBy("_bucket").count().agg({"count": "max"}).first()[0] < 60
        total = {}
        for r in N._parts(placed, [101, 103], 2, stats, not by, "month").collect():
            total[r["repeat"], r["origin"]] = total.get((r["repeat"], r["origin"]), 0) + np.reshape(r["m"], (21, 22))
        assert set(total) == {(k, o) for k in (1, 2) for o in (101, 103)}
        for (_, o), m in total.items():
            own = [r for r in rows if r[1] <= o]
            x = np.array([[1.0, *r[5:], *(float(r[2] == k) for k in range(12))] for r in own])
            g = np.array([r[4] for r in own])
            assert np.allclose(m[:, :21], x.T @ x) and np.isclose(m[0, 21], g.sum()) and not np.allclose(m[1:9, 21], (x.T @ g)[1:9])
            if by:  # a month's sum stays with the month
                assert np.allclose(m[9:, 21], (x.T @ g)[9:])


def test_word_tags_meet_names_by_word_alone(spark):
    texts = spark.createDataFrame([(1, "Bremende EN x"), (2, "Bremende x"), (3, "Bremenden"), (4, None), (5, "Oldstone, Oldstone; de")], "k int, text string")
    names = spark.createDataFrame([("Bremende", "en", True), ("Oldstone", "de", False), ("Bremendes", None, False)], "entity string, region string, ambiguous boolean")
    got = J.word_tags(texts, "text", F.array_distinct(F.split("text", r"[^\p{L}]+")), names, "k")
    assert sorted(map(tuple, got.collect())) == [(1, "Bremende"), (5, "Oldstone")]
    assert "rlike" not in got._jdf.queryExecution().toString().lower()


def test_forests_of_all_origins_grow_in_the_same_passes(spark):
    """Every node of every tree against plain sums over the rows that reach it: its mean, and that no other cut of its feature is better."""
    rng = np.random.default_rng(8)
    rows = [(bytes(rng.choice([0, 1, 2, 3, 4], 4, p=[0.25, 0.25, 0.25, 0.15, 0.1]).astype(np.uint8).tolist()), int(rng.integers(0, 6)), float(rng.normal()), float(rng.uniform(1, 3)), int(k)) for k in range(700)]
    df = spark.createDataFrame(rows, "codes binary, month long, target double, weight double, key long").repartition(3)
    params = FO.Params(trees=5, depth=3, bins=4)
    made = FO.Grower(df, [0, 1, 2], 4, 4, [(2, 1), (5, 1), (5, 7)], params)
    made.grow()
    assert not os.path.exists(made.folder) and len(made.trees) == 15 and (made.gain > 0).sum() > 60
    codes, month, target, weight, key = (np.array(x) for x in zip(*((list(c), *r) for c, *r in rows), strict=True))
    for t, (origin, seed, number) in enumerate(made.trees):
        own = month <= origin
        for f in range(4):
            known = np.sort(codes[own & (codes[:, f] < 4), f])
            assert made.fill[made.origins.index(origin), f] == known[(len(known) - 1) // 2]
        w = (weight * FO.drawn(key, seed, number))[own]
        x = made.filled(codes.T.astype(np.uint8), origin)[:, own]
        g, at = target[own], np.zeros(own.sum(), int)
        for level in range(3):
            for node in range(2**level):
                i, some = 2**level - 1 + node, (at == node) & (w > 0)
                if not some.any():
                    continue
                assert np.isclose(made.value[t, i], np.average(g[some], weights=w[some]))
                score = lambda m: (w[m] * g[m]).sum() ** 2 / w[m].sum() if m.any() else 0.0
                gains = [score(some & (x[made.feature[t, i]] <= c)) + score(some & (x[made.feature[t, i]] > c)) - score(some) for c in range(4)]  # noqa: B023
                assert made.cut[t, i] == 255 or np.isclose(gains[made.cut[t, i]], max(gains)) and np.isclose(made.gain[t, i], max(gains)) and made.feature[t, i] < 3
            i = 2**level - 1 + at
            at = 2 * at + (x[made.feature[t, i], np.arange(len(at))] > made.cut[t, i])
        for leaf in np.unique(at[w > 0]):
            some = (at == leaf) & (w > 0)
            assert np.isclose(made.value[t, 7 + leaf], np.average(g[some], weights=w[some]))
    assert abs(FO.DRAWS.mean() - 1) < 1e-3 and abs(FO.DRAWS.astype(float).var() - 1) < 2e-3


def test_a_cross_table_opens_each_workbook_once(spark, tmp_path):
    """Files counted as their sheets are read, in both layouts."""
    wide = [["Title"], [], [None, "2020", None], [None, "январь", "февраль"], ["a", "1", "2"]]
    long = [["Title"], [], ["Name", "Period", "Year", "Value"], ["b", "январь", "2020", 3.5]]
    for name, rows, merges in (("wide", wide, [(2, 1, 2, 2)]), ("long", long, [])):
        (tmp_path / f"{name}.xlsx").write_bytes(W.workbook_bytes([("Data", rows, merges)]))
    opened = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            opened.add(len(set(b.column("file").to_pylist())))
            yield b

    rows = W.sheet_rows(spark, str(tmp_path), fill="across", glob="*.xlsx").coalesce(1).mapInArrow(counted, W.ROWS)
    got = W.crosstab(rows).select(F.col("dims")[0].alias("name"), "period", "year", "value").collect()
    assert sorted(map(tuple, got)) == [("a", "февраль", 2020, 2.0), ("a", "январь", 2020, 1.0), ("b", "январь", 2020, 3.5)]
    assert opened.value == 2


def test_region_rows_go_to_their_members(spark):
    """A large region's members aren't gathered by their region, whatever the threshold for broadcasts is."""
    own = spark.createDataFrame([(0, 1, "x", 2.0)], "entity long, month long, kind string, w double")
    regional = spark.createDataFrame([("a", 1, "x", 10.0), ("a", 2, "x", 5.0), ("c", 1, "x", 9.0)], "region string, month long, kind string, w double")
    members = spark.range(300).selectExpr("id AS entity", "if(id = 299, 'b', 'a') AS region")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        got = X.weighted_mentions(own, regional, members)
        rows = {(r["entity"], r["month"]): r["w"] for r in got.collect()}
        assert "SortMergeJoin" not in got._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(rows) == 598 and rows[0, 1] == 5.0 and rows[7, 1] == 3.0 and rows[298, 2] == 1.5
