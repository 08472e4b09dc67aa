"""Work on a url or a page is linear in its length; dot segments against a plain stack."""

from __future__ import annotations

import time

import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import url_filter

KINDS = {
    "slashes inside": lambda n: ("https://a.org/" + "/" * n + "x/", ""),
    "slashes at the end": lambda n: ("https://a.org/" + "/" * n, ""),
    "many ://": lambda n: ("https://a.org/" + "b://" * (n // 4), ""),
    "parameters": lambda n: ("https://a.org/?" + "utm_&" * (n // 5), ""),
    "names and dots": lambda n: ("https://a.org/x", '<link rel="canonical" href="/' + "a/../b/./" * (n // 9) + '">'),
    "climbing": lambda n: ("https://a.org/x", '<link rel="canonical" href="/' + "a/" * (n // 5) + "../" * (n // 5) + 'c">'),
    "unclosed tags": lambda n: ("https://a.org/x", "canonical" + "<link " * (n // 6)),
    "unclosed quotes": lambda n: ("https://a.org/x", '<link rel="canonical" ' + "href=' " * (n // 7) + ">"),
    "references": lambda n: ("https://a.org/x", '<link rel="canonical" href="/' + "&amp" * (n // 4) + "&#x41;" * (n // 6) + '">'),
}


@pytest.mark.parametrize("kind", list(KINDS))
def test_ten_times_the_length_costs_about_ten_times(spark, kind):
    def seconds(n: int) -> float:
        df = spark.createDataFrame([KINDS[kind](n)], "u string, h string")
        aliases = F.transform(url_filter.targets(F.col("u"), F.col("h")), url_filter.normal_form)
        began = time.perf_counter()
        df.select(url_filter.normal_form(F.col("u")), aliases).collect()
        return time.perf_counter() - began

    seconds(100)
    small = min(seconds(30_000) for _ in range(2))
    assert seconds(300_000) < 15 * small + 3


def stack(path: str) -> str:
    kept = []
    for x in path.split("/")[1:]:
        if x == "..":
            kept = kept[:-1]
        elif x != ".":
            kept.append(x)
    if not any(x in (".", "..") for x in path.split("/")[1:]):
        return path
    return "/" + "/".join(kept) + ("/" if kept and path.endswith(("/.", "/..")) else "")


@settings(deadline=None, max_examples=40)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "", ".", "..", "..", "...", ".c"]), max_size=12), min_size=1, max_size=40))
@example([["..", "..", "a", "..", "..", "b"], ["a", "b", "..", "..", "..", "c", "."], [".."], ["."], ["", "..", ""]])
def test_dot_segments_are_a_stack(spark, cases):
    paths = ["/" + "/".join(c) for c in cases]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, p string")
    got = {r.i: r.x for r in df.select("i", url_filter._without_dots(F.col("p")).alias("x")).collect()}
    assert [got[i] for i in range(len(paths))] == [stack(p) for p in paths]


def test_a_later_separator_is_no_scheme(spark):
    urls = ["https://A.org/p//?q=a://b?c#d", "https://a.org/p#f://g?h", "https://a.org//", "x://", "https://a.org/p\n/"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(url_filter.normal_form(F.col("u"))).collect()]
    assert got == ["a.org/p?q=a://b?c", "a.org/p", "a.org", "", "a.org/p\n"]
