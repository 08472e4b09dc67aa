from __future__ import annotations

import shutil

import pytest

from .helpers import DOCS, odd_rows


@pytest.fixture(scope="session")
def odd_dir(spark, tmp_path_factory, sf_dir) -> str:
    """A folder of tables with odd rows and extra columns whose names the operators use themselves."""
    folder = tmp_path_factory.mktemp("odd")
    extra = ", ".join(f"{i} as {c}" for i, c in enumerate(("fp", "component", "label", "weight", "k", "t", "h", "base", "spans", "node", "score", "_spans", "_base", "positive", "n_words")))
    docs = spark.createDataFrame(odd_rows(), DOCS).selectExpr("*", *extra.split(", "))
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 0 if i in (16, 17, 18) else 1, 0) for i in range(19)] + [(3, 1, 0), (999, 1, 0), (None, 1, None), (4, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    items = [(1, odd_rows()[5][1]), (2, "two words"), (3, None), (4, ""), (5, "two words"), (6, "!!!")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    shutil.copy(f"{sf_dir}/pages.parquet", f"{folder}/plain_pages.parquet")
    pages = [
        (1, "https://a.example.net/es/x", None), (2, "https://alias.example.org/q?utm_source=z#f", '<link rel="canonical" href="https://a.example.net/es/x">'),
        (3, "http://ALIAS.example.org/q/", "<meta http-equiv='refresh' content='0; url=/elsewhere'>"), (4, "https://alias.example.org/elsewhere", ""),
        (5, "https://www.example.com/en/1", ""), (6, "https://sub.example.com/en/1", ""), (7, "no scheme", "<link rel=canonical href=/x>"), (8, None, None), (9, "x://", ""),
        (10, "https://free.example.org/", '<link rel=canonical href="https://www.example.com/en/1">'), (11, "https://mixed.example.org/a", '<LINK REL="canonical" HREF="//b.example.net/fr/1">'),
        (11, "https://mixed.example.org/a", '<LINK REL="canonical" HREF="//b.example.net/fr/1">'), (12, "https://com/x", ""), (13, "https://notexample.com/en/", ""), (14, "https://k.com?/en/", ""),
    ]
    spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 as node", "2 as k", "3 as hit").write.parquet(f"{folder}/pages.parquet")
    turns = [(1, 0, "user", "ask " * 30), (1, 1, "assistant", "tell " * 50), (2, 0, None, None), (2, None, "assistant", ""), (None, 0, "assistant", "no talk"),
        (3, 0, "user", "very long " * 3000), (3, 1, "assistant", "short"), (4, 0, "assistant", "answer " * 1500), (4, 0, "assistant", "answer " * 1500)]
    turns += [(10 + i, j, "user" if j % 2 == 0 else "assistant", "word " * (10 + 7 * i % 90)) for i in range(60) for j in range(4)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as tokens", "2 as loss", "3 as n").write.parquet(f"{folder}/conversations.parquet")
    nan, inf = float("nan"), float("inf")
    vectors = [(i, [float((i * k) % 7) / 3 - 1 for k in range(1, 7)]) for i in range(40)] + [(3, [float((3 * k) % 7) / 3 - 1 for k in range(1, 7)])] * 30
    vectors += [(100, None), (101, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (102, [nan, 0.0, 0.0, 0.0, 0.0, 0.0]), (103, [inf, 0.0, 0.0, 0.0, 0.0, 0.0]), (104, []),
        (105, [1.0, 2.0]), (106, [1.5, -2.0]), (107, [-0.001, 0.25]), (108, [0.0]), (108, [-0.0]), (None, [0.5] * 6), (109, [3e38] * 6), (110, [-3e38, 1.0, 0.0, 0.0, 0.0, 0.0])]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").selectExpr("*", "1 as k", "2 as v", "3 as n", "4 as component", "5 as dims").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def empty_dir(spark, odd_dir, tmp_path_factory) -> str:
    folder = tmp_path_factory.mktemp("none")
    for name in ("documents", "labels", "benchmark", "pages", "conversations", "embeddings"):
        spark.read.parquet(f"{odd_dir}/{name}.parquet").limit(0).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)
