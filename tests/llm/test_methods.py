"""The methods themselves: discovery, ordering, limits, links, learning, bit slices, encodings."""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import (
    common,
    decontaminate,
    graph,
    language_crf,
    packing,
    pii,
    pu_quality,
    quality_rules,
    secrets,
    simhash,
    token_store,
    tokens,
    url_filter,
)

from . import helpers as H


# PII
def test_pii_discovers_what_a_confident_context_precedes(spark):
    rows = [(i, f"as agreed reach me at user{i}@mail.example.com soon") for i in range(12)]
    rows += [(100, "as agreed reach me at user(at)mail-55512345 soon"), (101, "item number 55512345 here")]
    found = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string"))
    spans = {r.doc_id: [(x.kind, x.s, x.e) for x in r.spans] for r in found.collect()}
    text = dict(rows)
    kind, s, e = spans[100][0]
    assert kind == "email" and "55512345" in text[100][s:e]
    assert spans[101] == []
    assert all(len(spans[i]) == 1 for i in range(12))


def test_pii_contexts_of_mixed_use_stay_unconfident(spark):
    rows = [(i, f"we write to user{i}@mail.example.com") for i in range(6)] + [(50 + i, f"we write to code-{100000 + i}") for i in range(6)]
    found = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(len(r.spans) == (r.doc_id < 50) for r in found)


def test_pii_seeds_are_whole_spans_and_nothing_is_cut_off(spark):
    """Spaced numbers are seeds and candidates; long identifiers and contexts are found and told apart; null and repeated ids keep their spans."""
    texts = [(i, f"please call our desk +1 (01{i % 10}) 555-77{10 + i} today") for i in range(30)]
    texts += [(50, "please call our desk 1 (017) 555-7713 today"), (None, "please call our desk 1 (018) 555-7714 today"), (51, "twice"), (51, "please call our desk 1 (019) 555-7715 now")]
    long, word = "id" + "9" * 72, "w" * 40
    texts += [(60 + i, f"as {word}a agreed user{i}@mail.example.com") for i in range(12)] + [(80, f"as {word}a agreed {long}"), (81, f"as {word}b agreed {long}")]
    texts += [(90, "mail a@b.example.com, " * 3)]
    found = pii.find_pii(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    more = sorted(((r.doc_id, x.kind, x.m) for r in found for x in r.spans if x not in r.base), key=repr)
    assert more == sorted([(50, "phone", "1 (017) 555-7713"), (None, "phone", "1 (018) 555-7714"), (51, "phone", "1 (019) 555-7715"), (80, "email", long)], key=repr)
    assert len(next(r for r in found if r.doc_id == 90).base) == 3
    for r in found:
        assert all(any(t[x.s : x.e] == x.m for i, t in texts if i == r.doc_id) for x in r.spans)


def test_spans_of_many_matches_cost_what_many_texts_do(spark):
    """32,000 matches in one text: positions, overlaps and links in n log n steps."""
    import time

    n = 32_000
    part = "mail u1@a.de id 55512345 token=abcdefghijklmnop login: ann "
    one = spark.createDataFrame([(1, part * n)], "doc_id long, text string")
    many = spark.createDataFrame([(i, part * 10) for i in range(n // 10)], "doc_id long, text string").coalesce(1)
    total = lambda df: df.agg(F.sum(F.size("base")), F.sum(F.size("spans"))).first()
    for scan in (pii.find_pii, secrets.find_secrets):
        total(scan(many.limit(10)))  # warm-up
        began = time.perf_counter()
        wide = total(scan(many))
        middle = time.perf_counter()
        deep = total(scan(one))
        assert tuple(wide) == tuple(deep) and time.perf_counter() - middle < 5 * (middle - began) + 5
    clean = secrets.redact(one).first().text
    assert clean == "mail u1@a.de id 55512345 [SECRET] [SECRET] " * n


@settings(deadline=None, max_examples=25)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 9), st.booleans()), max_size=14))
def test_outside_equals_comparing_all_spans(spark, spans):
    from tidemark.llm.spans import outside

    kind = "array<struct<s:int,e:int>>"
    mine, taken = ([(s, s + n) for s, n, own in spans if own == which] for which in (True, False))
    df = spark.createDataFrame([(sorted(mine), sorted(taken))], f"m {kind}, t {kind}")
    got = [tuple(x) for x in df.select(outside(F.col("m"), F.col("t")).alias("x")).first().x]
    assert sorted(got) == sorted((a, b) for a, b in mine if not any(c < b and d > a for c, d in taken))


# quality rules
def test_cascade_orders_by_rejections_per_cost_and_stops(spark):
    import time

    def slow(d):
        time.sleep(0.002)
        return b"bad" in d.text

    rules = [quality_rules.Rule("slow", slow), quality_rules.Rule("quick", lambda d: b"bad" in d.text), quality_rules.Rule("never", lambda d: False)]
    fine = " ".join(f"w{j}" for j in range(60))
    reach = [(i, fine + " bad" if i % 2 else fine) for i in range(60)]
    docs = spark.createDataFrame([*reach, *((100 + i, "bad") for i in range(500))], "doc_id long, text string")  # those of the base verdict don't count
    plan = quality_rules.plan_cascade(docs, rules)
    assert [x[0] for x in plan] == ["quick", "slow", "never"]
    assert [x[2] for x in plan] == [0.5, 0.0, 0.0] and plan[1][1] > 0.002  # of what "quick" leaves, "slow" rejects nothing
    order = [x[0] for x in plan]
    words = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor ".split()
    rng = np.random.default_rng(1)
    good = [" ".join(rng.choice(words, 80).tolist() + [f"w{j}" for j in range(80)]) for _ in range(4)]
    docs = spark.createDataFrame(list(enumerate([*good, good[0] + " bad"])), "doc_id long, text string")
    out = {r.doc_id: (r.failed_rule, r.kept) for r in quality_rules.apply_cascade(docs, order, rules).collect()}
    assert out[4] == ("quick", False) and out[0] == (None, True)


# secrets
@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("user: bob pwd=hunter22", ["weak_access", "weak_secret"]),
        ("pwd=hunter22", []),
        ("user: bob", []),
        ("https://db.example.com/x pwd=hunter22", ["endpoint", "weak_secret"]),
        ("https://db.example.com/x user: bob", []),
        ("user: bob " + "x " * 150 + "pwd=hunter22", []),
        ("token = 04dbebab91ab85687d33eeaaf9ac699e1188f962 user: bob", ["assign", "weak_access", "hex"]),
    ],
)
def test_secret_parts_are_reported_together_only(spark, text, kinds):
    found = secrets.find_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert sorted(x.kind for x in found.spans) == sorted(kinds)


def test_sweep_equals_comparing_all_parts(spark):
    rng = np.random.default_rng(3)
    parts = []
    for doc in range(40):
        at = sorted(rng.integers(0, 3000, 12).tolist())
        parts.append((doc, [(s, int(k), s + 8, secrets.KINDS[k], "") for s, k in zip(at, rng.integers(0, 6, 12), strict=True)]))
    df = spark.createDataFrame(parts, "doc long, p array<struct<s:int,rank:int,e:int,kind:string,m:string>>")
    from pyspark.sql import functions as F

    got = df.select("doc", F.array_sort("p").alias("p")).select("doc", secrets.linked(F.col("p")).alias("x"))
    for r in got.collect():
        rows = sorted(dict(parts)[r.doc])
        want = []
        for x in rows:
            role = secrets.ROLE[x[3]]
            others = {secrets.ROLE[y[3]] for y in rows if y[0] <= x[2] + 200 and y[2] >= x[0] - 200}
            needs = {"access", "endpoint"} if role == "secret" else {"secret"}
            if x[1] >= 3 and needs & others:
                want.append(x[:3])
        assert [(x.s, x.rank, x.e) for x in r.x] == want


def test_redaction_leaves_nothing_and_keeps_the_rest(spark):
    docs = spark.createDataFrame(H.odd_rows(), H.DOCS).selectExpr("*", "1 as _spans", "2 as _row")
    clean = {(r.doc_id, r.lang): r for r in secrets.redact(docs).collect()}
    for r in docs.collect():
        got = clean[r.doc_id, r.lang]
        assert H.secret_spans(got.text) == "" and (got._spans, got._row, got.n_chars) == (1, 2, r.n_chars)
        if H.secret_spans(r.text) == "" and "pwd" not in (r.text or ""):
            assert got.text == r.text


# packing
def test_all_three_limits_bind(spark, sf_dir):
    from pyspark.sql import functions as F

    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    size = F.size(F.split("text", " "))
    talks = turns.groupBy("conv_id").agg(F.sum(size).alias("n"), F.sum(F.when(F.col("role") == "assistant", size).otherwise(0)).alias("b"))
    limits = packing.Limits(tokens=1500, segments=4, loss=500)
    rows = packing.pack_examples(talks.repartition(2), "conv_id", "n", "b", limits).collect()
    assert sorted(r.conv_id for r in rows) == sorted(r.conv_id for r in talks.collect())
    by: dict = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for found in by.values():
        if not any(r.oversized for r in found):
            assert sum(r.tokens for r in found) <= 1500 and len(found) <= 4 and sum(r.loss for r in found) <= 500
        else:
            assert len(found) == 1
    first_fit = len(_next_fit([(r.n, r.b) for r in talks.collect()], limits))
    assert len(by) <= first_fit


def _next_fit(items, limits):
    bins, left = [], None
    for n, b in items:
        if left is None or n > left[0] or b > left[1] or left[2] == 0:
            left = [limits.tokens, limits.loss, limits.segments]
            bins.append(left)
        left[0], left[1], left[2] = left[0] - n, left[1] - b, left[2] - 1
    return bins


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(1, 3000), max_size=60), st.integers(1, 6), st.integers(2, 40))
def test_cut_sequences_hold_every_token_once(sizes, segments, pool):
    packer = packing.VectorPacker(packing.Limits(tokens=256, segments=segments, loss=200), pool_size=pool)
    out = []
    for i, n in enumerate(sizes):
        packer.add(i, n, n - 1)
        out += packer.ready()
    out += packer.flush()
    seen: dict = {}
    for pieces in out:
        assert sum(x[2] for x in pieces) <= 256 and len(pieces) <= segments + 0
        assert sum(x[2] - 1 for x in pieces) <= 200
        for i, s, n in pieces:
            seen.setdefault(i, []).append((s, n))
    for i, n in enumerate(sizes):
        at = 0
        for s, length in sorted(seen[i]):
            assert s == at and length > 0
            at += length
        assert at == n


# quality classifier
def test_pu_learning_ranks_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = pu_quality.fit(docs, labels)
    assert 0.6 <= model.prior <= 0.98
    rows = pu_quality.score(docs, model).join(labels, "doc_id").collect()
    test = [(r.score, r.quality) for r in rows if H.held_out(r.doc_id)]
    pos, neg = np.array([s for s, q in test if q == 1]), np.array([s for s, q in test if q == 0])
    assert (pos[:, None] > neg).mean() > 0.95
    assert (pos >= 0.3).mean() > 0.98 and (neg < 0.3).mean() > 0.9


def test_pu_risk_and_slope_against_plain_sums():
    rng = np.random.default_rng(2)
    for prior in (0.2, 0.9):
        zp, zu = rng.normal(1, 1, 7), rng.normal(-1, 1, 11)
        loss = lambda z, y: np.log1p(np.exp(-y * z))
        negative = sum(loss(z, -1) for z in zu) / 11 - prior * sum(loss(z, -1) for z in zp) / 7
        assert pu_quality.risk(zp, zu, prior) == pytest.approx(prior * sum(loss(z, 1) for z in zp) / 7 + max(0, negative))
        part = (lambda a, b: pu_quality.risk(a, b, prior)) if negative >= 0 else (lambda a, b: prior * loss(a, 1).mean() - (loss(b, -1).mean() - prior * loss(a, -1).mean()))
        dp, du = pu_quality.risk_slope(zp, zu, prior)
        for i in range(7):
            step = np.eye(7)[i] * 1e-6
            assert dp[i] == pytest.approx((part(zp + step, zu) - part(zp - step, zu)) / 2e-6, abs=1e-5)
        for i in range(11):
            step = np.eye(11)[i] * 1e-6
            assert du[i] == pytest.approx((part(zp, zu + step) - part(zp, zu - step)) / 2e-6, abs=1e-5)


@pytest.mark.parametrize("share", [0.3, 0.7, 0.95])
def test_prior_estimate_on_a_mixture_of_known_share(share):
    rng = np.random.default_rng(4)
    def sample(n, good):
        dense = np.zeros((n, len(pu_quality.MEASURES)))
        dense[:, 0] = 1
        dense[:, 2] = np.where(good, 0.3, 0.9) + rng.normal(0, 0.1, n)
        return pu_quality.Sample(dense, [np.array([int(x)]) for x in rng.integers(0, 40, n)])
    p, u = sample(1500, np.ones(1500, bool)), sample(3000, rng.random(3000) < share)
    assert abs(pu_quality.estimate_prior(p, u) - share) < 0.08


def test_pu_scores_are_the_models_on_every_text(spark):
    docs = spark.createDataFrame(H.odd_rows(), H.DOCS)
    rng = np.random.default_rng(0)
    model = pu_quality.Model(rng.normal(size=len(pu_quality.MEASURES)), rng.normal(size=pu_quality.BUCKETS), 0.7)
    def plain(text):
        raw, low = (text or "").encode(), (text or "").encode().split()
        z = float(pu_quality.measures(quality_rules.Doc(raw)) @ model.dense)
        buckets = {zlib.crc32(w.lower()) % pu_quality.BUCKETS for w in low}
        z += sum(model.words[b] for b in buckets) / max(1, len(buckets)) ** 0.5
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    got = sorted((r.doc_id or -1, r.score) for r in pu_quality.score(docs, model).collect())
    want = sorted((i or -1, plain(t)) for i, t, *_ in H.odd_rows())
    assert np.allclose([x[1] for x in got], [x[1] for x in want])


def test_pu_fit_without_positives(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert pu_quality.fit(docs, labels) is None
    assert pu_quality.score(docs, None).first().score == 0.5


def _collected(monkeypatch, df) -> list[int]:
    """Fills with the number of rows of each collect from now on."""
    sizes, collect = [], type(df).collect

    def counted(self):
        rows = collect(self)
        sizes.append(len(rows))
        return rows

    monkeypatch.setattr(type(df), "collect", counted)
    return sizes


def _first_ids(ids) -> list[int]:
    """Ids outside the held-out fold, in the order of their hashes."""
    return sorted((i for i in ids if not H.held_out(i)), key=lambda i: np.int64(np.uint64(xxhash.xxh64_intdigest(str(i).encode(), seed=42)).view(np.int64)))


def test_pu_sample_counts_ids_however_often_they_are_repeated(spark, monkeypatch):
    ids = _first_ids(range(100))
    hot_p, hot_u = [i for i in ids if i % 2][0], [i for i in ids if i % 2 == 0][0]
    rows = [(i, f"text of {i}") for i in range(100)] + [(i, f"again {j}") for i in (hot_p, hot_u) for j in range(200)] + [(None, "no id")] * 200
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(pu_quality, "_train", lambda rows: seen.append((rows.where("positive").count(), rows.where("not positive").count())))
    pu_quality.fit(docs, labels, positives=10, unlabelled=20)
    assert seen == [(10, 20)]
    seen.clear()
    pu_quality.fit(docs, labels, positives=10, unlabelled=20, words=12)  # three words each
    pu_quality.fit(docs, labels, positives=10, unlabelled=20, words=1)
    assert seen == [(4, 4), (1, 1)]


def test_pu_fit_collects_nothing_but_weights(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet") for n in ("documents", "labels"))
    sizes = _collected(monkeypatch, docs)
    assert pu_quality.fit(docs, labels) is not None
    assert max(sizes, default=0) <= 1


def test_pu_sample_steps_are_those_of_plain_rows(monkeypatch):
    rng = np.random.default_rng(6)
    words = [rng.choice(pu_quality.BUCKETS, n, replace=False).astype("<u2") for n in (0, 3, 1, 40, 7, 0)]
    dense = rng.normal(size=(6, len(pu_quality.MEASURES)))
    model, by_row = pu_quality.Model(rng.normal(size=dense.shape[1]), rng.normal(size=pu_quality.BUCKETS), 0.5), rng.normal(size=6)
    for entries in (1, 8, 1 << 18):
        monkeypatch.setattr(pu_quality, "ENTRIES", entries)
        for rows in (np.arange(6), np.array([4, 1, 3]), np.array([], int)):
            got = pu_quality.Sample(dense, words).part(rows)
            assert np.allclose(got.logits(model), [dense[i] @ model.dense + model.words[words[i]].sum() / max(1, len(words[i])) ** 0.5 for i in rows])
            want = np.zeros(pu_quality.BUCKETS)
            for k, i in enumerate(rows):
                want[words[i]] += by_row[k] / max(1, len(words[i])) ** 0.5
            assert np.allclose(got.gradient(by_row[: len(rows)]), np.r_[dense[rows].T @ by_row[: len(rows)], want])


def test_pu_sample_of_wordy_texts_stays_small():
    """Ten thousand rows of four thousand words: two bytes each, halves two more, and a step a bounded block."""
    import tracemalloc

    rng = np.random.default_rng(7)
    words = [np.arange(i % 4000, i % 4000 + 4000, dtype="<u2") for i in range(10_000)]
    dense = rng.normal(size=(10_000, len(pu_quality.MEASURES)))
    model = pu_quality.Model(np.zeros(dense.shape[1]), np.zeros(pu_quality.BUCKETS), 0.5)
    tracemalloc.start()
    whole = pu_quality.Sample(dense, words)
    halves = [whole.part(np.arange(k, 10_000, 2)) for k in (0, 1)]
    for s in halves:
        s.gradient(s.logits(model))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 260e6


# simhash
def _brute_roots(fps):
    comp = H.components(dict(enumerate(fps)))
    return [comp[i] for i in range(len(fps))]


@settings(deadline=None, max_examples=40)
@given(st.integers(1, 400), st.integers(0, 10**6), st.integers(4, 16))
def test_bit_sliced_bucket_equals_brute_force(n, seed, free):
    rng = np.random.default_rng(seed)
    fps = np.unique(rng.integers(0, 1 << free, n, dtype=np.uint64) << np.uint64(5))
    a, b = simhash.bucket_forest(fps, np.zeros(len(fps), int))
    assert len(a) < len(fps)
    parent = {int(f): int(f) for f in fps}
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        parent[x] = y
    index = {int(f): i for i, f in enumerate(fps)}
    assert [index[parent[int(f)]] for f in fps] == _brute_roots(fps.tolist())


def test_several_buckets_and_lanes(monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 64)
    rng = np.random.default_rng(5)
    parts = [np.unique(rng.integers(0, 1 << 12, n, dtype=np.uint64)) for n in (1, 2, 64, 65, 300)]
    a, b = simhash.bucket_forest(np.concatenate(parts), np.repeat(np.arange(5), [len(p) for p in parts]))
    singles = [simhash.bucket_forest(p, np.zeros(len(p), int)) for p in parts]
    assert a.tolist() == np.concatenate([x[0] for x in singles]).tolist()
    assert b.tolist() == np.concatenate([x[1] for x in singles]).tolist()


def test_links_and_components_on_a_dense_cluster(spark):
    rng = np.random.default_rng(9)
    near = {int(x) for x in rng.integers(0, 1 << 10, 600)}
    fps = sorted(near | {int(x) << 20 for x in rng.integers(1, 1 << 30, 200)})
    df = spark.createDataFrame([(f, i) for i, f in enumerate(fps)], "fp long, weight long")
    nodes = df.selectExpr("fp as node", "weight")
    got = {r.node: r.label for r in graph.components(nodes, simhash.links(df.select("fp"))).collect()}
    assert [got[f] for f in fps] == _brute_roots(fps)


def test_components_of_long_chains(spark):
    n = 300
    order = np.random.default_rng(2).permutation(n).tolist()
    nodes = spark.createDataFrame([(i, order[i]) for i in range(n)], "node long, weight long")
    edges = spark.createDataFrame([(i, i + 1) for i in range(n - 1) if i != 149], "a long, b long")
    got = {r.node: r.label for r in graph.components(nodes, edges).collect()}
    assert {got[i] for i in range(150)} == {min(order[:150])} and {got[i] for i in range(150, n)} == {min(order[150:])}


def test_one_of_each(spark):
    docs = spark.createDataFrame(H.odd_rows(), H.DOCS)
    kept = simhash.one_of_each(docs).collect()
    fps = {r.doc_id: H.simhash(r.text) for r in docs.collect() if r.doc_id is not None}
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(set(H.components(fps).values()))
    assert sum(r.doc_id is None for r in kept) == 1


def test_one_of_each_judges_rows_not_ids(spark):
    """An id that occurs again with another text; copies under that id; wholly repeated rows; null ids."""
    a, b = H.odd_rows()[5][1], "another text altogether with quite some other words in it to stand on its own feet"
    rows = [(3, a), (5, b), (5, a), (7, b), (8, "third text"), (8, "third text"), (None, a), (None, "only here"), (None, "only here")]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept), key=repr) == sorted([(3, a), (5, b), (8, "third text"), (None, "only here")], key=repr)


def test_components_of_a_chain_beyond_any_fixed_number_of_rounds_and_of_equal_weights(spark):
    n = 2000
    nodes = spark.createDataFrame([(i, None if i % 3 else (i * 7919) % n) for i in range(n)] + [(-1, 5), (-2, 5), (-3, None), (-4, None)], "node long, weight long")
    edges = spark.createDataFrame([(i, i + 1) for i in range(n - 1)] + [(-1, -3)], "a long, b long")
    got = {r.node: r.label for r in graph.components(nodes, edges).collect()}
    assert {got[i] for i in range(n)} == {min((i * 7919) % n for i in range(0, n, 3))}
    assert (got[-1], got[-2], got[-3], got[-4]) == (5, 5, 5, None)


# urls
def test_any_number_of_rules(spark):
    """More rules than are matched in the row: a table of them gives the same verdicts, and aliases are judged by it, too."""
    few = list(url_filter.RULES)
    many = few + [(f"h{i}.org", f"/p{i % 7}/", "block" if i % 2 else "allow") for i in range(3000)] + [("h1.org", "", "allow"), ("h1.org", "/p1/x", "allow")]
    pages = [(i, f"https://www.h{i}.org/p{i % 7}/x", "") for i in range(40)] + [(100, "https://q.net/es/1", ""), (101, "https://a.q.org/1", "<link rel=canonical href='https://h3.org/p3/'>"), (102, None, None), (103, "x", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: (r.rule, r.verdict, r.source) for r in url_filter.judge_urls(df, many).collect()}
    for i in range(40):
        rule = ("h1.org/p1/x", "allow") if i == 1 else (f"h{i}.org/p{i % 7}/", "block" if i % 2 else "allow")
        assert got[i] == (*rule, "rule")
    assert got[100] == ("net/es/", "block", "rule") and got[101] == (None, "block", "alias") and got[102] == got[103] == (None, "allow", "default")
    table = spark.createDataFrame(few, "host string, path string, verdict string")
    key = lambda df: sorted(map(tuple, df.collect()))
    odd = spark.createDataFrame([p for p in pages if p[0] > 99] + [(1, "https://WWW.example.com/en/", ""), (2, "https://example.com/en", "")], "page_id long, url string, html string").where("url is not null")
    assert [x for x in key(url_filter.judge_urls(odd, few)) if x] == key(url_filter.judge_urls(odd, table))


def test_rules_and_normal_forms(spark):
    from pyspark.sql import functions as F

    rules = [("a.com", "/x", "block"), ("a.com", "/x/y", "allow"), ("b.com", "/", "block"), ("b.com", "/", "allow")]
    df = spark.createDataFrame([("a.com", "/x/z"), ("s.a.com", "/x/yy"), ("ba.com", "/x"), ("b.com", "/q")], "h string, p string")
    got = [r[0] and (r[0].rule, r[0].allow) for r in df.select(url_filter.matched_rule(F.col("h"), F.col("p"), rules)).collect()]
    assert got == [("a.com/x", False), ("a.com/x/y", True), None, ("b.com/", True)]
    found = {(r.host, r.path): (r.hit.rule, r.hit.allow) for r in url_filter.rule_hits(df.toDF("host", "path"), spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    assert [found.get((r.h, r.p)) for r in df.collect()] == got
    urls = ["HTTP://A.com/b/?utm_source=x&q=1#f", "https://a.com/b?q=1&ref=2", "https://a.com/b/", "https://a.com", "none"]
    forms = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(url_filter.normal_form(F.col("u"))).collect()]
    assert forms == ["a.com/b?q=1", "a.com/b?q=1", "a.com/b", "a.com", None]


def test_relative_and_encoded_targets(spark):
    u = "https://A.example.org/x/y/page?q=1#f"
    cases = [
        ('<link rel="canonical" href="page2.html">', "https://a.example.org/x/y/page2.html"),
        ('<link rel="canonical" href="../z?a=../b">', "https://a.example.org/x/z?a=../b"),
        ('<link rel="canonical" href="./../../../up/.">', "https://a.example.org/up/"),
        ('<link rel="canonical" href="?id=3&amp;n=2">', "https://a.example.org/x/y/page?id=3&n=2"),
        ('<link rel="canonical" href="go?to=http://b.net/">', "https://a.example.org/x/y/go?to=http://b.net/"),
        ('<link rel="canonical" href="/a/../b">', "https://a.example.org/b"),
        ("<link rel=canonical href='https://a.net/es/?x=1&amp;y=&#x4f60;&#38;amp;'>", "https://a.net/es/?x=1&y=你&amp;"),
        ("<link rel=canonical href=//b.net/&eacute;&nosuch;&#0;>", "https://b.net/é&nosuch;�"),
        ("<meta http-equiv=refresh content='0; url=next.html'>", "https://a.example.org/x/y/next.html"),
        ("""<meta content="3;URL='/r?a=1&amp;b=2'" http-equiv="refresh">""", "https://a.example.org/r?a=1&b=2"),
        ("<link rel=canonical href='#top'>", None), ("<link rel=canonical href='mailto:a@b.c'>", None), ("<meta http-equiv=refresh content=5>", None),
    ]
    df = spark.createDataFrame([(i, u, h) for i, (h, _) in enumerate(cases)], "i long, u string, h string")
    got = {r.i: r.to for r in df.select("i", url_filter.targets(F.col("u"), F.col("h")).alias("to")).collect()}
    assert got == {i: [] if want is None else [want] for i, (_, want) in enumerate(cases)}
    pages = [(1, "https://a.net/es/?x=1&y=2", ""), (2, "https://q.org/1", "<link rel=canonical href='https://a.net/es/?x=1&amp;y=2'>"),
        (3, "https://q.org/d/3", "<link rel=canonical href='../1'>"), (4, "https://q.org", "<meta http-equiv=refresh content='0; url=d/3'>"), (5, "https://q.org/5", "")]
    found = url_filter.judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r.page_id: (r.verdict, r.source) for r in found} == {1: ("block", "rule"), 2: ("block", "alias"), 3: ("block", "alias"), 4: ("block", "alias"), 5: ("allow", "default")}


# decontamination
def test_blocks_of_the_benchmark_merge(spark, sf_dir):
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    docs = docs.unionByName(docs.limit(5))
    one = decontaminate.contamination(docs, items).collect()
    many = decontaminate.contamination(docs, items, block_bytes=2000).collect()
    key = lambda r: (r.doc_id, r.n_words, r.n_hit, tuple(r.items), tuple((s["from"], s["to"]) for s in r.spans))
    assert sorted(map(key, one)) == sorted(map(key, many)) and any(r.n_hit for r in one)


def test_removing_spans_and_documents(spark):
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"
    rows = [(1, f"Before. {passage.upper()}! After."), (2, "clean text"), (3, None), (4, f"{passage} " + "w " * 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_hit")
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    cut = {r.doc_id: r.text for r in decontaminate.remove_contaminated(docs, items, unit="span").collect()}
    assert cut[1] == "Before. ! After." and cut[2] == "clean text" and cut[3] is None and cut[4].strip() == ("w " * 400).strip()
    assert [r.doc_id for r in decontaminate.remove_contaminated(docs, items).orderBy("doc_id").collect()] == [2, 3, 4]


def test_removal_judges_the_union_of_all_blocks(spark, sf_dir):
    one, two = ([f"{c}{i}" for i in range(13)] for c in "ab")
    rest = [f"r{i}" for i in range(400)]
    mixed = " ".join([*one, *rest[:200], *two, *rest[200:]])  # 3 % and 3 %: 26 of 426 words
    touching = " ".join(["x", *one, *two, "y"])
    docs = spark.createDataFrame([(1, mixed), (2, " ".join([*one, *rest])), (3, None), (4, touching), (5, "")], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(one)), (2, " ".join(two)), (3, f"{one[12]} {two[0]}")], "item_id long, text string")
    for size in (1, 1 << 20):
        kept = decontaminate.remove_contaminated(docs, items, block_bytes=size).collect()
        assert sorted(r.doc_id for r in kept) == [2, 3, 5]
        cut = {r.doc_id: r.text for r in decontaminate.remove_contaminated(docs, items, unit="span", block_bytes=size).collect()}
        assert cut == {1: f" {' '.join(rest[:200])}  {' '.join(rest[200:])}", 2: f" {' '.join(rest)}", 3: None, 4: "x  y", 5: ""}
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    want = {r.doc_id for r in decontaminate.contamination(docs, items).collect() if not (r.n_hit > 0 and 20 * r.n_hit >= r.n_words)}
    got = [r.doc_id for r in decontaminate.remove_contaminated(docs, items, block_bytes=2000).select("doc_id").collect()]
    assert len(got) == len(want) < docs.count() and set(got) == want


def test_items_without_an_id_and_repeated_texts_over_blocks(spark):
    text = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"
    docs = spark.createDataFrame([(1, text), (1, text), (None, text + " xi"), (2, "none")], "doc_id long, text string")
    items = spark.createDataFrame([(None, text), (None, text), (9, "alpha beta"), (10, "lambda mu")], "item_id long, text string")
    for size in (1, 1 << 20):
        rows = decontaminate.contamination(docs, items, block_bytes=size).collect()
        assert sorted((r.doc_id or 0, r.n_words, r.n_hit, tuple(map(str, r.items))) for r in rows) == [(0, 14, 13, ("10", "9", "None")), (1, 13, 13, ("10", "9", "None")), (1, 13, 13, ("10", "9", "None")), (2, 1, 0, ())]


# language
def test_word_labels_and_affixes(spark):
    """Runs of labels cover all words, switch where the language does, and rest on affixes alone where words are new."""
    rng = np.random.default_rng(1)
    make = lambda pre, suf: " ".join(pre + "".join(rng.choice(list("rstlmn"), 4)) + suf for _ in range(60))
    rows = [(i, make("qa", "o") if i % 2 else make("ze", "i"), "aa" if i % 2 else "bb") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    crf = language_crf.fit(docs)
    mixed = spark.createDataFrame([(1, make("qa", "o") + " " + make("ze", "i")), (2, make("ze", "i")), (3, "12 34"), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in language_crf.identify(mixed, crf).collect()}
    runs = [x.split(":") for x in got[1].runs.split(",")]
    assert [r[0] for r in runs] == ["aa", "bb"] and runs[0][1] == "0" and runs[0][2] == runs[1][1] and abs(int(runs[0][2]) - 60) <= 2 and runs[1][2] == "120"
    assert got[2].runs == "bb:0:60" and got[2].n_switches == 0 and got[1].n_switches == 1 and (got[3].lang_pred, got[3].runs) == ("und", "") == (got[4].lang_pred, got[4].runs)


def test_training_windows_bound_what_is_collected(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "word " * 10_000, "en") for i in range(10)], "doc_id long, text string, lang string")
    monkeypatch.setattr(language_crf, "train", lambda texts, langs: texts)
    assert {len(t) for t in language_crf.fit(docs, doc_chars=500)} == {500}


def test_document_scores_equal_word_by_word_marginals(spark, sf_dir):
    """op9's score and language from a plain forward-backward over each word, feature by feature."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    crf = language_crf.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), sample_docs=60)
    for r in language_crf.identify(docs, crf).join(docs.select("doc_id", "text"), "doc_id").collect():
        found, bounds = language_crf.split_words(pa.array([r.text]))
        words, token = language_crf.Words.of(found.dictionary), found.indices.to_numpy()
        gamma = _brute_marginals(crf.emissions(words)[token].astype(float), crf.weights().astype(float))
        mean = gamma[words.lettered[token]].mean(axis=0)
        assert r.lang_pred == crf.languages[int(mean.argmax())] and r.score == pytest.approx(mean.max(), abs=2e-3)


def _brute_marginals(e, t):
    """Forward-backward word by word."""
    n, k = e.shape
    alpha, beta = np.zeros((n, k)), np.ones((n, k))
    state = np.full(k, 1 / k)
    for i in range(n):
        state = state @ t * e[i]
        alpha[i] = state = state / state.sum()
    for i in range(n - 1, 0, -1):
        beta[i - 1] = t @ (e[i] * beta[i])
        beta[i - 1] /= beta[i - 1].sum()
    g = alpha * beta
    return g / g.sum(axis=1, keepdims=True)


def test_segmented_forward_backward_is_exact():
    rng = np.random.default_rng(4)
    sizes = [0, 1, 127, 128, 129, 1000, 3, 0, 300]
    bounds = np.r_[0, np.cumsum(sizes)]
    emission = rng.random((50, 3)).astype(np.float32) + 0.01
    t = np.array([[0.9, 0.05, 0.05], [0.1, 0.8, 0.1], [0.02, 0.08, 0.9]], np.float32)
    token = rng.integers(0, 50, bounds[-1])
    got = language_crf.posteriors(emission, token, bounds, t)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b > a:
            assert np.allclose(got[a:b], _brute_marginals(emission[token[a:b]].astype(float), t.astype(float)), atol=1e-3)


def test_training_gradient_counts_are_exact():
    rng = np.random.default_rng(8)
    emission, t = rng.random((6, 2)).astype(np.float32) + 0.1, np.array([[0.7, 0.3], [0.4, 0.6]], np.float32)
    seq = rng.integers(0, 6, (1, 5))
    gamma, pair = language_crf.expectations(emission, seq, t)
    weight, total, single = 0.0, np.zeros((2, 2)), np.zeros((5, 2))
    for code in range(2**5):
        y = [code >> i & 1 for i in range(5)]
        w = sum(0.5 * t[s, y[0]] for s in range(2)) * np.prod([emission[seq[0, i], y[i]] for i in range(5)]) * np.prod([t[y[i], y[i + 1]] for i in range(4)])
        weight += w
        for i in range(5):
            single[i, y[i]] += w
        for i in range(4):
            total[y[i], y[i + 1]] += w
    assert np.allclose(pair, total / weight, atol=1e-4) and np.allclose(gamma[0], single / weight, atol=1e-4)


def test_language_of_held_out_and_code_switched_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    crf = language_crf.fit(docs)
    rows = language_crf.identify(docs, crf).join(docs.select("doc_id", "lang"), "doc_id").collect()
    test = [r for r in rows if H.held_out(r.doc_id)]
    assert np.mean([r.lang_pred == r.lang for r in test]) > 0.98
    by = {r.lang: r.text for r in docs.where("length(text) between 1500 and 3000").collect()}
    mixed = spark.createDataFrame([(1, by["de"] + "\n" + by["fr"]), (2, by["en"])], "doc_id long, text string")
    switches = {r.doc_id: r.n_switches for r in language_crf.identify(mixed, crf).collect()}
    assert 1 <= switches[1] <= 6 and switches[2] <= 2


def test_language_sample_holds_every_language_and_each_id_once(spark, monkeypatch):
    ids = _first_ids(range(1000))
    hot, rare = ids[0], ids[-3:]
    rows = [(i, f"text {i}", "xx" if i in rare else "de" if i % 10 == 0 else "en") for i in range(1000)]
    rows += [(hot, f"again {j}", "de" if hot % 10 == 0 else "en") for j in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(language_crf, "train", lambda texts, langs: (texts, langs))
    sizes = _collected(monkeypatch, docs)
    texts, langs = language_crf.fit(docs, sample_docs=40)
    assert {x: langs.count(x) for x in set(langs)} == {"xx": 3, "de": 18, "en": 19} and max(sizes) == 40
    assert len(set(texts)) == 40 and sum(t.startswith("again") or t == f"text {hot}" for t in texts) <= 1
    assert language_crf._quotas({"a": 5, "b": 1, "c": 9}, 2) == {"b": 1, "a": 1, "c": 1}


# tokens
@settings(deadline=None, max_examples=150)
@given(st.text(max_size=60))
def test_word_encoder_equals_the_library(text):
    enc = tokens.encoder(tokens.default_path())
    ids, counts = enc.encode(pa.array([text, None, text + " tail"]))
    assert ids[: counts[0]].tolist() == tokens.direct_ids(enc.tokenizer, text) and counts[1] == 0


def test_encoder_forgets_safely(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    enc = tokens.WordEncoder(tokens.default_path())
    for text in ("one two three four five", "six, seven! eight's <|endoftext|>", "one two six"):
        assert enc.encode(pa.array([text]))[0].tolist() == tokens.direct_ids(enc.tokenizer, text)


@settings(deadline=None, max_examples=80)
@given(st.lists(st.integers(0, 5000), max_size=700), st.integers(-(2**60), 2**60))
def test_elias_fano_round_trip_and_select(steps, base):
    values = np.cumsum([base, *steps])
    ef, end = token_store.EliasFano.from_bytes(memoryview(token_store.EliasFano.encode(values).to_bytes()))
    assert ef.decode().tolist() == values.tolist()
    for i in {0, len(values) // 3, len(values) // 2, len(values) - 1}:
        assert ef.select(i) == values[i]
        assert ef.select_range(i, len(values)).tolist() == values[i:].tolist() and ef.select_range(0, i).tolist() == values[:i].tolist()


def test_elias_fano_is_small():
    bounds = np.cumsum(np.random.default_rng(0).integers(1, 1200, 20_000))
    bits = 8 * len(token_store.EliasFano.encode(bounds).to_bytes()) / len(bounds)
    assert bits < 2 + np.log2(600) + 1


def test_shards_split_and_read_back(spark, sf_dir, tmp_path):
    folder = f"file://{tmp_path}/shards"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = token_store.write_shards(docs.repartition(3), folder, shard_ids=5000)
    files = sorted(os.listdir(f"{tmp_path}/shards"))
    assert len(files) == manifest.count() > 10 and not any(f.startswith(".") for f in files)
    shard = token_store.Shard.load((tmp_path / "shards" / files[3]).read_bytes())
    for a, b in ((0, len(shard)), (1, 3), (len(shard) - 1, len(shard))):
        keys, bounds, some = shard.documents(a, b)
        assert keys == [shard.keys.select(i) for i in range(a, b)] and [some[x:y].tolist() for x, y in zip(bounds[:-1] - bounds[0], bounds[1:] - bounds[0], strict=True)] == [shard.document(i).tolist() for i in range(a, b)]
    key = int(shard.keys.select(0))
    text = docs.where(f"doc_id = {key}").first().text
    assert shard.document(0).tolist() == [*tokens.direct_ids(tokens.load(tokens.default_path()), text), 1]
    rows = token_store.read_documents(manifest, folder).orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted(r.doc_id for r in docs.select("doc_id").collect())


def test_checkpoint_folder_is_the_sessions(spark):
    assert common.checkpointed(spark.range(3)).count() == 3 and common.shared_dir(spark)
