"""Every contract query on odd tables, empty tables and real ones, against plain Python."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest

from tidemark.llm import registry
from tidemark.llm.tokens import default_path, direct_ids, load

from . import helpers as H

QUERIES = registry.queries()


@pytest.fixture(scope="module", params=["odd", "real"])
def tables(request, odd_dir, sf_dir):
    return odd_dir if request.param == "odd" else sf_dir


@pytest.fixture(scope="module")
def texts(spark, tables):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect()]


def pairs(rows) -> list:
    return sorted(rows, key=repr)


@pytest.mark.parametrize("name", list(QUERIES))
def test_empty_tables(spark, empty_dir, name):
    assert QUERIES[name](spark, empty_dir).count() == 0


def test_pii(spark, tables, texts):
    rows = QUERIES["op1_pii"](spark, tables).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert pairs((r.doc_id, r.base_sha256) for r in rows) == pairs((i, sha(H.pii_spans(t))) for i, t in texts)
    for r in rows:
        kinds = [x.split(":")[0] for x in r.spans.split(",") if x]
        assert kinds.count("ip") >= r.n_ip and kinds.count("email") >= r.n_email


def test_secrets(spark, tables, texts):
    rows = QUERIES["op4_secrets"](spark, tables).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert pairs((r.doc_id, r.base_sha256) for r in rows) == pairs((i, sha(H.secret_spans(t))) for i, t in texts)


def test_quality_rules(spark, tables, texts):
    rows = QUERIES["op3_quality_rules"](spark, tables).collect()
    got = pairs((r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in rows)
    assert got == pairs((i, H.quality(t)) for i, t in texts)
    assert not any(r.kept for r in rows if r.base_failed)


def test_simhash(spark, tables, texts):
    rows = QUERIES["op6_simhash"](spark, tables).collect()
    assert pairs((r.doc_id, r.fingerprint) for r in rows) == pairs((i, f"{H.simhash(t):016x}") for i, t in texts)
    fps = {i: H.simhash(t) for i, t in texts if i is not None}
    want = H.components(fps)
    assert all(r.component_id == want[r.doc_id] for r in rows if r.doc_id is not None)


def test_decontamination(spark, tables, texts):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()}
    rows = QUERIES["op8_decontaminate"](spark, tables).collect()
    want = []
    for i, t in texts:
        n, hit, found = H.contamination(t, items)
        want.append((i, n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), hit > 0 and 20 * hit >= n))
    assert pairs((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows) == pairs(want)


@pytest.fixture(scope="module")
def ids(texts):
    t = load(default_path())
    return [(i, np.array([*direct_ids(t, x or ""), 1], "<u4")) for i, x in texts]


def test_token_store(spark, tables, texts, ids):
    rows = QUERIES["op10_token_store"](spark, tables).collect()
    assert pairs((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == pairs((i, len(x), zlib.crc32(x)) for i, x in ids)
    rows.sort(key=lambda r: r.start)
    assert [r.start for r in rows] == np.r_[0, np.cumsum([r.n_tokens for r in rows])][:-1].tolist()
    keys = [r.doc_id for r in rows]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))


def test_packing(spark, tables, texts, ids):
    rows = QUERIES["op2_packing"](spark, tables).collect()
    by_crc = {}
    for i, x in ids:
        by_crc.setdefault((i, len(x)), []).append(x)
    pieces: dict = {}
    for r in rows:
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    assert pieces.keys() == by_crc.keys()
    for key, found in pieces.items():
        copies = by_crc[key]
        assert sum(r.length for r in found) == sum(map(len, copies))
        assert all(any(zlib.crc32(x[r.start : r.start + r.length]) == r.ids_crc32 for x in copies) for r in found)
    sequences: dict = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
    for found in sequences.values():
        found.sort(key=lambda r: r.offset)
        assert [r.offset for r in found] == np.r_[0, np.cumsum([r.length for r in found])][:-1].tolist()
        total = sum(r.length for r in found)
        assert total <= 2048 and total & (total - 1) == 0  # cut at powers of two: no padding at all


def test_packed_conversations(spark, tables):
    t, want = load(default_path()), {}
    for r in spark.read.parquet(f"{tables}/conversations.parquet").collect():
        n, loss = want.get(r.conv_id, (0, 0))
        size = len(direct_ids(t, r.text or "")) + 1
        want[r.conv_id] = n + size, loss + size * (r.role == "assistant")
    rows = QUERIES["packed_conversations"](spark, tables).collect()
    assert pairs((r.conv_id, (r.tokens, r.loss)) for r in rows) == pairs(want.items())
    sequences: dict = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
    for found in sequences.values():
        n, loss = sum(r.tokens for r in found), sum(r.loss for r in found)
        if any(r.oversized for r in found):
            assert len(found) == 1 and (n > 2048 or loss > 1024)
        else:
            assert n <= 2048 and loss <= 1024 and len(found) <= 8
        at = sorted((r.offset, r.tokens) for r in found)
        assert [a for a, _ in at] == [sum(k for _, k in at[:i]) for i in range(len(at))]
    fitting = [x for x in want.values() if x[0] <= 2048 and x[1] <= 1024]
    least = max(sum(x[0] for x in fitting) / 2048, sum(x[1] for x in fitting) / 1024, len(fitting) / 8)
    assert len(sequences) - (len(want) - len(fitting)) <= 1.5 * least + 2 * 8  # within half of what any packing needs, but for each task's last


def test_scores(spark, tables, texts):
    quality = QUERIES["op5_pu_quality"](spark, tables).collect()
    language = QUERIES["op9_language"](spark, tables).collect()
    for rows in (quality, language):
        assert pairs(r.doc_id for r in rows) == pairs(i for i, _ in texts)
        assert all(0 <= r.score <= 1 and r.held_out == H.held_out(r.doc_id) for r in rows)
    assert all(r.predicted == int(r.score >= 0.3) for r in quality)
    blank = {i for i, t in texts if not any(c.isalpha() for c in t or "")}
    assert all((r.lang_pred == "und") == (r.doc_id in blank) for r in language)


def test_urls_against_a_parser_and_union_find(spark, tables, tmp_path):
    """The query on its own tables, and on pages whose aliases decide: relative, encoded, query-only, chained and shared targets."""
    from tidemark.llm.url_filter import RULES

    pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{tables}/pages.parquet").collect()]
    assert pairs(tuple(r) for r in QUERIES["op7_url_filter"](spark, tables).collect()) == pairs(H.url_verdicts(pages, RULES))
    link = lambda to: f'<html><head><link rel="canonical" href="{to}"></head></html>'
    made = [(1, "https://s.net/es/a?x=1&y=2", None), (2, "https://q.org/d/2", link("https://s.net/es/a?x=1&amp;y=2")), (3, "https://q.org/d/3", link("2")), (4, "https://q.org/d/e/4", link("../3")),
        (5, "https://q.org/d/5", "<meta http-equiv=refresh content='0; url=4'>"), (6, "https://q.org/d/e/6?a=1", link("?b=2")), (7, "https://q.org/d/e/6?b=2", link("//s.net/fr/z")),
        (8, "http://Q.ORG/d/2/?utm_source=x#f", ""), (9, "https://free.org/1", link("https://x.com/")), (10, "https://free.org/2", link("/1")), (11, "https://free.org/3", link("https://s.net/es/zz")),
        (12, "https://free.org/4", link("3") + link("https://x.com/")), (13, "https://free.org/3", ""), (None, "https://alone.org/", link("#top")), (14, "https://alone.org/m", link("mailto:a@b.c"))]
    made += [(100 + i, f"https://chain.org/{i}", link(f"/{i + 1}") if i < 80 else link("https://s.net/es/end")) for i in range(81)]
    made += [(300 + i, f"https://many.org/{i}", link("https://s.net/fr/hub")) for i in range(200)]
    spark.createDataFrame(made, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    rows = QUERIES["op7_url_filter"](spark, str(tmp_path)).collect()
    assert pairs(tuple(r) for r in rows) == pairs(H.url_verdicts(made, RULES))
    assert sum(r.rule is None and r.verdict == "block" for r in rows) > 250 and {r.verdict for r in rows if r.page_id in (9, 10, 12)} == {"allow"}


def test_urls(spark, odd_dir):
    rows = QUERIES["op7_url_filter"](spark, odd_dir).collect()
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}
    assert len(rows) == 15
    assert got[1] == ("a.example.net", "/es/x", "net/es/", "block")
    assert got[2] == ("alias.example.org", "/q", None, "block")  # canonical form is blocked
    assert got[3][3] == got[4][3] == "block"  # the same normal form, and where it refreshes to
    assert got[5] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert got[6] == ("sub.example.com", "/en/1", "example.com/en/", "block")
    assert got[7] == got[8] == ("", "", None, "allow")
    assert got[9] == ("", "", None, "allow")
    assert got[10][3] == "allow" and got[11][3] == "block"
    assert got[12][2] == "com/" and got[13] == ("notexample.com", "/en/", "com/", "allow") and got[14] == ("k.com", "", None, "allow")
