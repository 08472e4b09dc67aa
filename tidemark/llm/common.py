"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of text of an Arrow batch that are worked on at a time; a single longer text is a slice of its own.
SLICE_ROWS = 512
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder.

    ``spark.checkpoint.dir`` is read from the session; a local folder is set only where it is unset, as in tests.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", None) and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-ckpt-"))
    return df.checkpoint(eager=True)


def shared_dir(spark: SparkSession) -> str:
    """A folder that driver and executors share: ``spark.checkpoint.dir`` of the session, else one for tests."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-ckpt-"))
        found = sc.getCheckpointDir()
    return found


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: like ``checkpointed``, for loops, where a checkpoint's inferred
    constraints would grow from round to round."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made, once nothing reads them any more: what came of them must have been written, too."""
    for df in tables:
        if path := df.__dict__.get("_written_to"):
            delete(df.sparkSession, path)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def qualified(spark: SparkSession, folder: str) -> str:
    """``folder`` as a full uri: one without a scheme lies in the cluster's default file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file://") else full


def held_out(doc_id: Column) -> Column:
    """The held-out fold of the contracts: crc32 of the id as text divisible by five. A null id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def slices(batch: pa.RecordBatch, column: str, rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices bounded by rows and by bytes of ``column``, so that long texts don't add up."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(lengths), 0
    while at < batch.num_rows:
        full = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right"))
        end = min(max(full, at + 1), at + rows, batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def utf8_slices(batch: pa.RecordBatch, column: str, rows: int = SLICE_ROWS) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of a batch with ``column`` as UTF-8 bytes; null texts are empty."""
    for part in slices(batch, column, rows):
        yield part, [x or b"" for x in part.column(column).cast(pa.binary()).to_pylist()]


def crc32_ids(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def gather_runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices ``starts[i] .. starts[i]+lengths[i]-1`` for every i, one after the other."""
    ends = np.cumsum(lengths)
    out = np.arange(ends[-1] if len(ends) else 0)
    return out + np.repeat(starts - (ends - lengths), lengths)
