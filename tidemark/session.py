"""Session defaults."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; ``conf`` keys use __ for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the folder in ``spark.checkpoint.dir``; a local one is set only where none is, as in tests."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-ckpt-"))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, **options: str) -> tuple[DataFrame, str]:
    """``df`` written to a folder of its own in ``spark.checkpoint.dir`` and read again, and the folder. In columns, so that a reader takes
    what it needs; for tables that are read often, or replaced, so that the folder can be deleted."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-ckpt-"))
        root = spark.sparkContext.getCheckpointDir()
    folder = f"{root.rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(folder)
    return spark.read.schema(df.schema).parquet(folder), folder


def delete(df: DataFrame, folder: str) -> None:
    """Delete a folder that ``stored`` wrote and nothing reads any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
