"""Compiled forms and the scan for all of them, against regular expressions and by hand."""

from __future__ import annotations

import random
import re

import pytest

from tidemark.functions import gazetteer as G

NAMES = [
    (1, "Тюмень", "city", "Тюменская"), (2, "Орёл", "city", "Орловская"), (3, "Абатский", "district", "Тюменская"), (4, "Советский", "district", "Тюменская"),
    (5, "Советский", "district", "Орловская"), (6, "Нижний Тагил", "city", "Свердловская"), (7, "Уфа", "city", "Башкирия"), (8, None, "city", None), (9, " ", "city", None), (10, "Самара", "city", "Самарская"),
]
REGIONS = [(r, r, "region", r) for r in ("Тюменская", "Орловская", "Свердловская", "Башкирия", "Самарская")]
TEXTS = {
    "В Тюмени открыли мост, из Тюмени уехали": {1: 2}, "Тюменский завод": {}, "Прогулка по Орлу": {}, "Мэр Орла": {}, "в Орле и Орёл": {2: 1},
    "В Абатском районе снег": {3: 1}, "Абатский пруд": {}, "В Советском районе прошли выборы": {}, "В Советском районе Орловской области": {5: 1},
    "Советский район: Тюменская и Орловская области": {4: 1, 5: 1}, "жители Нижнего Тагила": {}, "под Нижний Тагилом, Нижний Тагил": {6: 2},
    "в Уфе": {}, "Уфа": {7: 1}, "самара и Самару": {10: 1}, "Самара-сити": {}, "Самара": {10: 1}, "": {}, "Самара " * 50_000: {10: 50_000},
}


@pytest.fixture(scope="module")
def table(spark):
    schema = "entity long, name string, kind string, region string"
    return G.compiled(spark.createDataFrame(NAMES, schema)), G.compiled(spark.createDataFrame(REGIONS, schema.replace("long", "string")))


@pytest.mark.parametrize("block", [G.BLOCK, 200])
def test_places(spark, table, block):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(999, None)]
    got: dict[int, dict] = {i: {} for i, _ in rows}
    for r in G.mentions(spark.createDataFrame(rows, "id long, t string"), "id", "t", *table, block).collect():
        got[r["id"]][r["entity"]] = r["n"]
    want = {i: dict(w) for i, w in enumerate(TEXTS.values())} | {999: {}}
    short = [i for i, t in enumerate(TEXTS) if "Орл" in t or "Орё" in t]  # three letters stay: the name alone, in either spelling
    assert {k: v for k, v in got.items() if k not in short} == {k: v for k, v in want.items() if k not in short}
    text = list(TEXTS)
    assert {text[i]: got[i] for i in short} == {
        "Прогулка по Орлу": {}, "Мэр Орла": {}, "в Орле и Орёл": {2: 1}, "В Советском районе Орловской области": {5: 1}, "Советский район: Тюменская и Орловская области": {4: 1, 5: 1}
    }


def test_ambiguous_forms(table):
    rows = {(r.form, r.entity): r.ambiguous for r in table[0].collect()}
    assert rows["Советского района", 4] and rows["Советского района", 5] and not rows["Абатского района", 3]
    assert not any(form.strip() == "" for form, _ in rows)


def test_scan_is_what_regular_expressions_find(spark):
    rng = random.Random(8)
    words = sorted({"".join(rng.choices("abё-_ 1", k=rng.randint(1, 4))).strip() for _ in range(60)} - {""})
    texts = ["".join(rng.choices("abё-_ 1.,\n", k=rng.randint(0, 80))) for _ in range(150)]
    got = G.occurrences(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), "id", "t", spark.createDataFrame([(w.replace("ё", "е"),) for w in words], "form string"), 40)
    want = set()
    for i, t in enumerate(texts):
        for w in {w.replace("ё", "е") for w in words}:
            n = len(re.findall(rf"(?=(?<![\w-]){re.escape(w)}(?![\w-]))", t.replace("ё", "е")))
            want |= {(i, w, n)} if n else set()
    assert {tuple(r) for r in got.collect()} == want


def test_empty_tables(spark, table):
    texts = spark.createDataFrame([(1, "Самара")], "id long, t string")
    assert G.mentions(texts.limit(0), "id", "t", *table).count() == G.mentions(texts, "id", "t", table[0].limit(0), table[1].limit(0)).count() == 0
