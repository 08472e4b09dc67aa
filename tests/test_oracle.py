"""Every registered query with SQL gives the same rows as DuckDB."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

from tidemark.plans.catalog import QUERIES, SQL


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def rows(frame: pd.DataFrame) -> list:
    frame = frame[sorted(frame.columns)].astype(object).where(frame.notna(), None)
    plain = [[x.item() if hasattr(x, "item") else x for x in r] for r in frame.itertuples(index=False, name=None)]
    return sorted(([float(x) if isinstance(x, int) and not isinstance(x, bool) else x for x in r] for r in plain), key=repr)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_same_rows_as_sql(spark, sf_dir, duck, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_other_query_has_a_test_of_its_own():
    assert {n for n in QUERIES if n not in SQL} == {
        "greedy_selection", "ridge_forecast", "random_forest_forecast", "gbt_forecast", "gbt_offset_forecast", "learned_metrics", "ridge_covariates_forecast", "ets_forecast", "fourier_trend_forecast", "embedding_classifier_cv", "classifier_report", "feature_importance",
        "changepoint_trend_forecast", "trend_changes", "null_test_runs", "null_test_summary"
    }  # fmt: skip; in test_learned.py, test_trend.py, test_nulltest.py


def test_entry():
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
