"""The audit against removing documents one by one, order by order."""

from __future__ import annotations

import re
from itertools import permutations

import numpy as np
import pytest

from tidemark.llm import filter_audit


def by_removal(docs: list[tuple], labels: list[tuple]) -> list[tuple]:
    smallest: dict = {}
    for i, t, _ in docs:
        if i is not None:
            smallest[t or ""] = min(i, smallest.get(t or "", i))
    marked = {k: {i for i, *v in labels if v[k] == 1 and i is not None} for k in (0, 1)}
    parts: dict = {}
    for i, t, s in docs:
        text = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and smallest[text] < i,
        }
        parts.setdefault(s or "", []).append((i, fails))
    out = []
    for part, rows in parts.items():
        steps = []
        for order in permutations("ABCDE"):
            left = rows
            for k, f in enumerate(order):
                gone, failing = [r for r in left if r[1][f]], [r for r in rows if r[1][f]]
                left = [r for r in left if not r[1][f]]
                alone = sum(sum(r[1].values()) == 1 for r in failing)
                lost = [sum(r[0] in marked[m] for r in gone) for m in (0, 1)]
                steps.append((part, "".join(order), k + 1, len(left), len(gone), len(failing) - len(gone), alone, *lost))
        total = {f: sum(s[4] for s in steps if s[1][s[2] - 1] == f) for f in "ABCDE"}
        out += [(*s, total[s[1][s[2] - 1]]) for s in steps]
    return sorted(out)


COLUMNS = ("part", "filter_order", "step", *filter_audit.MEASURES)


@pytest.mark.parametrize("kind", ["odd", "real"])
def test_rows(spark, odd_dir, sf_dir, kind):
    folder = odd_dir if kind == "odd" else sf_dir
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    labels = [(r.doc_id, r.quality, r.toxic) for r in spark.read.parquet(f"{folder}/labels.parquet").collect()]
    got = filter_audit.op13_filter_audit(spark, folder)
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got.collect()) == by_removal(docs, labels)


def test_copies_within_and_between_parts(spark):
    rows = [(5, "x", "a", 1), (3, "x", "b", 2), (3, "x", "b", 3), (9, "x", None, 4), (None, "x", "", 5), (7, None, "a", 6), (8, "", "a", 7), (2, "ÄB " * 60, "b", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, first long")
    labels = spark.createDataFrame([(5, 1, 0), (5, 0, 1), (None, 1, 1), (8, None, 1)], "doc_id long, quality int, toxic int")
    got = filter_audit.filter_audit(docs, labels).collect()
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got) == by_removal([r[:3] for r in rows], [(5, 1, 0), (5, 0, 1), (None, 1, 1), (8, None, 1)])
    assert len(got) == 3 * 600


def test_contractions_are_sums_over_cells():
    tensors = np.random.default_rng(0).integers(0, 50, size=(3, 2, 2, 2, 2, 2, 2))
    found = filter_audit.audit(tensors)
    k = [i for i, o in enumerate(filter_audit.ORDERS) if o == "CADBE"][0] * 5 + 2  # D after C and A
    assert found["removed"][1, k] == tensors[0, 1, 0, :, 0, 1, :].sum() and found["kept"][1, k] == tensors[0, 1, 0, :, 0, 0, :].sum()
    assert found["unique_fails"][1, k] == tensors[0, 1, 0, 0, 0, 1, 0] and found["redundant"][1, k] == tensors[0, 1, :, :, :, 1].sum() - found["removed"][1, k]
    assert found["good_lost"][0, k] == tensors[1, 0, 0, :, 0, 1, :].sum() and found["toxic_lost"][0, k] == tensors[2, 0, 0, :, 0, 1, :].sum()
    by_filter = {f: sum(found["removed"][0, i] for i, g in enumerate(filter_audit._LETTERS) if g == f) for f in filter_audit.FILTERS}
    assert [found["shapley"][0, i] for i in range(5)] == [by_filter[f] for f in "ABCDE"]
