"""The contract queries' SQL gives the same rows, on odd tables, real ones, and text from which contexts are learned."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from tidemark.llm import pii, registry, secrets


def connect(folder):
    con = duckdb.connect()
    for name in ("documents", "pages", "benchmark", "labels"):
        path = f"{folder}/{name}.parquet"
        files = [path] if os.path.isfile(path) else glob.glob(f"{path}/*.parquet")
        con.read_parquet(files).create_view(name)
    return con


def same(got, want):
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    plain = lambda rel: sorted((tuple(r) for r in rel), key=repr)
    assert plain(got.select(columns).collect()) == plain(want.select(*(f'"{c}"' for c in columns)).fetchall())


@pytest.mark.parametrize("name", list(registry.oracle_sql()))
@pytest.mark.parametrize("kind", ["odd", "real"])
def test_same_rows(spark, sf_dir, odd_dir, name, kind):
    folder = odd_dir if kind == "odd" else sf_dir
    same(registry.queries()[name](spark, folder), connect(folder).sql(registry.oracle_sql()[name]))


def test_discovery_and_links(spark, tmp_path):
    rows = [(i, f"as agreed reach me at user{i}@mail.example.com soon") for i in range(12)]
    rows += [(100, "as agreed reach me at user(at)mail-55512345 soon"), (101, "item number 55512345"), (102, "you can find user(at)mail-55512345 there")]
    rows += [(200 + i, f"you can find user(at)mail-{55512345 + i} there") for i in range(5)]
    rows += [(300, "user: bob pwd=hunter22 https://a.example/x"), (301, "pwd=hunter22"), (302, "token=abcdefghijklmnop login: ann"), (303, "é pass: secret99, host https://b/")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.read_parquet(glob.glob(f"{tmp_path}/documents.parquet/*.parquet")).create_view("documents")
    found = pii.op1_pii(spark, str(tmp_path))
    assert any(r.spans for r in found.collect() if r.doc_id == 100)
    same(found, con.sql(pii.SQL))
    same(secrets.op4_secrets(spark, str(tmp_path)), con.sql(secrets.SQL))
