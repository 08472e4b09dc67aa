"""Sinks: versioned publication, idempotent writes, exports."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import decimal_comma


def content_hash(df: DataFrame) -> tuple[int, int, int]:
    """(rows, two order-free hashes) of a table's content: sums of independent 64-bit row hashes, so neither order nor
    file layout counts."""
    columns = [F.col(f"`{c}`") for c in sorted(df.columns)]
    total = lambda h: F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    row = df.agg(F.count("*").alias("n"), total(F.xxhash64(*columns)).alias("a"), total(F.xxhash64(F.lit("other"), *columns)).alias("b")).first()
    return row["n"], int(row["a"]), int(row["b"])


def write_if_changed(df: DataFrame, path: str) -> bool:
    """Write Parquet unless what is there has the same content; returns whether it wrote.

    The new content goes to a private folder first; then the old one is moved aside, the new one is moved in, and only then
    is the old one deleted. A crash leaves whole tables at every step: the next write first puts back one that was left
    aside. Between the two moves a reader finds no table; readers that can't wait use ``publish``.
    """
    spark = df.sparkSession
    fs, target = _hadoop(spark, path)
    aside = _path(spark, f"{path.rstrip('/')}.old")
    if not fs.exists(target) and fs.exists(aside):
        fs.rename(aside, target)
    if fs.exists(target):
        if content_hash(spark.read.parquet(path)) == content_hash(df):
            return False
    private = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    df.write.parquet(private)
    if fs.exists(target):
        fs.delete(aside, True)
        if not fs.rename(target, aside):
            raise OSError(f"{path} can't be moved aside")
    if not fs.rename(_path(spark, private), target):
        raise OSError(f"{private} can't be moved in")
    fs.delete(aside, True)
    return True


def publish(tables: Mapping[str, DataFrame], folder: str) -> str:
    """All tables as one new version with a table of row counts; the pointer file is replaced last, in one atomic rename,
    so a reader sees the old version or the new one, whole."""
    spark = next(iter(tables.values())).sparkSession
    version = f"v-{uuid.uuid4().hex}"
    counts = []
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{version}/{name}")
        counts.append((name, spark.read.parquet(f"{folder}/{version}/{name}").count()))
    meta = spark.createDataFrame(counts, "table string, rows long").withColumn("published_at", F.current_timestamp())
    meta.coalesce(1).write.parquet(f"{folder}/{version}/_tables")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs, fresh = _hadoop(spark, f"{folder}/{version}/_pointer")
    out = fs.create(fresh, True)
    out.write(bytearray(version.encode()))
    out.close()
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    current = fs.makeQualified(_path(spark, f"{folder}/current"))
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(current.toUri(), conf).rename(fs.makeQualified(fresh), current, overwrite)
    return version


def published(spark: SparkSession, folder: str, name: str) -> DataFrame:
    version = spark.read.text(f"{folder}/current").first()[0]
    return spark.read.parquet(f"{folder}/{version}/{name}")


def export_csv(df: DataFrame, path: str, digits: int = 2) -> None:
    """Semicolons and decimal commas."""
    shown = [decimal_comma(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    df.select(*shown).write.mode("overwrite").csv(path, sep=";", header=True)


def export_json(df: DataFrame, path: str, by: str) -> None:
    """A JSON line for each row, in a folder for each value of ``by``."""
    df.select(by, F.to_json(F.struct(*(c for c in df.columns if c != by))).alias("value")).write.mode("overwrite").partitionBy(by).text(path)


def retain(versions: DataFrame, keys: list[str], order: str, keep: int = 12) -> DataFrame:
    """The newest ``keep`` snapshots of each key."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return versions.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= keep).drop("_r")


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _hadoop(spark: SparkSession, path: str):
    target = _path(spark, path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Files of (name, content), one for each row, in a folder that all executors share: (name, bytes), to be counted or collected.

    A file is written under a private name and renamed, so a retried or speculative task only replaces it by an equal one.
    The folder needs a file system that ``pyarrow.fs`` knows.
    """
    from pyarrow import fs as stores

    hadoop, target = _hadoop(files.sparkSession, folder)
    uri = hadoop.makeQualified(target).toString()
    uri = uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri
    store, root = stores.FileSystem.from_uri(uri)
    store.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = stores.FileSystem.from_uri(uri)
        for batch in batches:
            sizes = []
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content"), strict=True):
                private, data = f"{root}/.{name}.{uuid.uuid4().hex}", content.as_buffer()
                with store.open_output_stream(private) as out:
                    out.write(data)
                store.move(private, f"{root}/{name}")
                sizes.append(data.size)
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(sizes, pa.int64())], names=["name", "bytes"])

    return files.select("name", "content").mapInArrow(run, "name string, bytes long")
