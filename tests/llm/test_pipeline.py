"""The pipeline's stages against plain Python, each on its own input."""

from __future__ import annotations

import zlib

import corpus_pipeline
import numpy as np
from tidemark.llm import pu_quality
from tidemark.llm.tokens import default_path, direct_ids, load

from . import helpers as H

DIR = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, kept = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DIR)
        out.write.parquet(f"{tmp_path}/{k}")
        kept.append((docs, spark.read.parquet(f"{tmp_path}/{k}")))
        docs = kept[-1][1]
        if k < 4:
            assert docs.columns == columns
    # the classifier: what it rejects goes, nothing else
    before, after = kept[0]
    model = pu_quality.fit(before, spark.read.parquet(f"{DIR}/labels.parquet"))
    good = {r.doc_id for r in pu_quality.score(before, model).collect() if r.score >= 0.3}
    assert {r.doc_id for r in after.collect()} == good and 0.6 < len(good) / before.count() < 1
    # near-duplicates: one of each component
    before, after = kept[1]
    rows = before.collect()
    assert {r.doc_id for r in after.collect()} == set(H.components({r.doc_id: H.simhash(r.text) for r in rows}).values())
    # contamination
    before, after = kept[2]
    items = {r.item_id: r.text for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()}
    clean = set()
    for r in before.collect():
        n, hit, _ = H.contamination(r.text, items)
        if not (hit and 20 * hit >= n):
            clean.add(r.doc_id)
    assert {r.doc_id for r in after.collect()} == clean and len(clean) < before.count()
    # secrets: all documents stay, without secrets
    before, after = kept[3]
    texts = {r.doc_id: r.text for r in before.collect()}
    masked = after.collect()
    assert {r.doc_id for r in masked} == set(texts)
    for r in masked:
        assert H.secret_spans(r.text) == "" and r.n_chars == len(r.text)
        if "[SECRET]" not in r.text:
            assert r.text == texts[r.doc_id]
    # packing: every id once
    before, after = kept[4]
    t = load(default_path())
    pieces: dict = {}
    for r in after.collect():
        pieces.setdefault(r.doc_id, []).append(r)
    for r in before.collect():
        ids, at = np.array([*direct_ids(t, r.text), 1], "<u4"), 0
        for p in sorted(pieces.pop(r.doc_id), key=lambda p: p.start):
            assert p.start == at and p.ids_crc32 == zlib.crc32(ids[at : at + p.length])
            at += p.length
        assert at == len(ids)
    assert not pieces


def test_run_on_odd_and_empty_tables(spark, odd_dir, empty_dir):
    assert corpus_pipeline.run(spark, odd_dir).count() > 0
    assert corpus_pipeline.run(spark, empty_dir).count() == 0
