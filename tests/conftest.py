from __future__ import annotations

import os
import tempfile

import pytest

os.environ.setdefault("OMP_NUM_THREADS", "1")


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import session

    spark = session(
        "tests",
        "local[4]",
        spark__driver__memory="6g",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__local__dir=tempfile.mkdtemp(prefix="spark-"),
        spark__sql__warehouse__dir=tempfile.mkdtemp(prefix="spark-"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


@pytest.fixture(scope="session")
def sf_dir() -> str:
    return "/root/testdata/sf0.001"
