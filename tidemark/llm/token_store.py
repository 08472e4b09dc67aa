"""Token-id files with Elias-Fano document boundaries.

A shard file is: a header, the document boundaries and the document ids as Elias-Fano sequences with sampled select
structures, and the concatenated ids (16 bits each where the vocabulary allows it, else 32). A boundary costs about
two bits more than the logarithm of the mean document length; there is no table of 64-bit offsets.

``write_shards`` range-partitions the raw texts by document id (one shuffle), sorts within partitions, encodes, and writes
shards of bounded size to a folder all executors share. A file is written under a private name and renamed, so a retried
or speculative task only replaces a file by an equal one. ``read_documents`` opens the files again: it reads a shard's
index, selects the bounds of some documents at a time from it, and reads just their ids.

Cases: a null text is empty and is its end id alone; null ids come first; rows with equal ids are ordered by their texts'
hashes, and their range is split like any other; an id that isn't an integer is refused; an empty table writes no file and reads back as no rows; extra columns are not written.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, qualified, shared_dir, slices, table
from .tokens import default_path, document_ids

MAGIC = b"TKEF0002"
#: Ids in a shard at most, but for a single longer document.
SHARD_IDS = 4 << 20
SAMPLE = 256
_HEAD = struct.Struct("<8sBQQQQ")
_EF = struct.Struct("<QqBQQQ")


class EliasFano:
    """A non-decreasing sequence of integers: low bits packed, high bits in unary with sampled ones."""

    def __init__(self, count: int, base: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.count, self.base, self.low_bits, self.low, self.high, self.samples = count, base, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        base = int(values[0]) if n else 0
        v = values.astype(np.uint64) - np.uint64(base % 2**64)
        top = int(v[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        low = np.zeros(0, np.uint8)
        if low_bits:
            bits = (v[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
            low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        ones = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        unary[ones] = 1
        return cls(n, base, low_bits, low, np.packbits(unary, bitorder="little"), ones[::SAMPLE].astype("<u4"))

    def _lows(self, first: int, last: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(last - first, np.uint64)
        a, b = first * self.low_bits, last * self.low_bits
        bits = np.unpackbits(self.low[a // 8 : (b + 7) // 8], bitorder="little")[a % 8 : a % 8 + b - a]
        return (bits.reshape(-1, self.low_bits).astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def select(self, i: int) -> int:
        """The i-th value: from the nearest sampled one on, without decoding the rest."""
        start = int(self.samples[i // SAMPLE])
        missing, byte = i % SAMPLE, start // 8
        skip, width = start % 8, 64
        while True:
            bits = np.unpackbits(self.high[byte : byte + width], bitorder="little")
            bits[:skip] = 0
            ones = np.flatnonzero(bits)
            if missing < len(ones):
                place = byte * 8 + int(ones[missing])
                break
            missing -= len(ones)
            byte, skip, width = byte + width, 0, 2 * width
        return self.base + ((place - i) << self.low_bits | int(self._lows(i, i + 1)[0]))

    def select_range(self, first: int, last: int) -> np.ndarray:
        """Values first to last (exclusive): only the part of the unary bits between two samples is read."""
        if last <= first:
            return np.zeros(0, np.int64)
        sample, end = first // SAMPLE, (last - 1) // SAMPLE + 1
        a = int(self.samples[sample])
        b = int(self.samples[end]) if end < len(self.samples) else 8 * len(self.high)
        bits = np.unpackbits(self.high[a // 8 : (b + 7) // 8], bitorder="little")
        bits[: a % 8] = 0
        ones = np.flatnonzero(bits)[first - sample * SAMPLE : last - sample * SAMPLE] + a // 8 * 8
        high = (ones - np.arange(first, last)).astype(np.uint64)
        return ((high << np.uint64(self.low_bits)) | self._lows(first, last)).astype(np.int64) + self.base

    def decode(self) -> np.ndarray:
        return self.select_range(0, self.count)

    def to_bytes(self) -> bytes:
        head = _EF.pack(self.count, self.base, self.low_bits, len(self.low), len(self.high), len(self.samples))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: memoryview) -> tuple[EliasFano, int]:
        count, base, low_bits, n_low, n_high, n_samples = _EF.unpack_from(data)
        a = _EF.size
        b, c = a + n_low, a + n_low + n_high
        end = c + 4 * n_samples
        low, high = np.frombuffer(data[a:b], np.uint8), np.frombuffer(data[b:c], np.uint8)
        return cls(count, base, low_bits, low, high, np.frombuffer(data[c:end], "<u4")), end


class Shard:
    """A shard's parts: ids, bounds (one more than documents), keys (null ones first) and the number of null keys.

    ``ids`` is a function from a range of ids to their array, so that a file need not be read whole.
    """

    def __init__(self, ids, bounds: EliasFano, keys: EliasFano, nulls: int):
        self.ids, self.bounds, self.keys, self.nulls = ids, bounds, keys, nulls

    @staticmethod
    def dump(ids: np.ndarray, bounds: np.ndarray, keys: list) -> list[bytes]:
        known = np.array([k for k in keys if k is not None], np.int64)
        width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
        index = EliasFano.encode(bounds).to_bytes() + EliasFano.encode(known).to_bytes()
        return [_HEAD.pack(MAGIC, width, len(keys), len(keys) - len(known), len(ids), len(index)), index, ids.astype(f"<u{width}").tobytes()]

    @classmethod
    def open(cls, read_at) -> Shard:
        """A shard whose file is read by ``read_at(size, offset)``: the header and the index now, ids when asked for."""
        magic, width, n_docs, nulls, n_ids, n_index = _HEAD.unpack(read_at(_HEAD.size, 0))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        view = memoryview(read_at(n_index, _HEAD.size))
        bounds, a = EliasFano.from_bytes(view)
        keys, _ = EliasFano.from_bytes(view[a:])
        if bounds.count != n_docs + 1 or bounds.select(n_docs) != n_ids:
            raise ValueError("damaged token shard")
        ids = lambda a, b: np.frombuffer(read_at(width * (b - a), _HEAD.size + n_index + width * a), f"<u{width}")
        return cls(ids, bounds, keys, nulls)

    @classmethod
    def load(cls, data: bytes) -> Shard:
        return cls.open(lambda size, offset: data[offset : offset + size])

    def __len__(self) -> int:
        return self.bounds.count - 1

    def document(self, i: int) -> np.ndarray:
        return self.ids(self.bounds.select(i), self.bounds.select(i + 1)).astype("<u4")

    def documents(self, first: int, last: int) -> tuple[list, np.ndarray, np.ndarray]:
        """Keys, bounds (one more) and ids of documents first to last (exclusive), by select on bounds and keys."""
        bounds = self.bounds.select_range(first, last + 1)
        known = self.keys.select_range(max(0, first - self.nulls), max(0, last - self.nulls)).tolist()
        return [None] * (last - first - len(known)) + known, bounds, self.ids(int(bounds[0]), int(bounds[-1])).astype("<u4")


#: Documents that a reader takes from a shard at a time.
READ_DOCS = 2048


def write_shards(
    docs: DataFrame, folder: str, tokenizer_path: str | None = None, shard_ids: int = SHARD_IDS, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """Write all documents in ascending key order; returns the manifest (part, shard, file, n_docs, n_ids), checkpointed."""
    path = tokenizer_path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        store, root = fs.FileSystem.from_uri(folder)
        held: list[np.ndarray] = []
        sizes: list[int] = []
        keys: list = []
        shard = 0

        def flush() -> pa.RecordBatch:
            nonlocal shard
            ids = np.concatenate(held)
            name = f"part-{part:06d}-{shard:05d}.tkef"
            private = f"{root}/.{name}.{attempt}.{uuid.uuid4().hex}"
            with store.open_output_stream(private) as out:
                for piece in Shard.dump(ids, np.r_[0, np.cumsum(sizes)], keys):
                    out.write(piece)
            store.move(private, f"{root}/{name}")
            row = pa.RecordBatch.from_pydict({"part": [part], "shard": [shard], "file": [name], "n_docs": [len(keys)], "n_ids": [len(ids)]})
            held.clear(), sizes.clear(), keys.clear()
            shard += 1
            return row

        for batch in batches:
            for some in slices(batch, text, 1024):
                ids, bounds = document_ids(path, some.column(text))
                names, at = some.column(key).to_pylist(), 0
                while at < len(names):  # as many documents as the shard has room for, one at least
                    room = shard_ids - sum(map(len, held))
                    end = int(np.searchsorted(bounds, bounds[at] + room, "right")) - 1
                    if end <= at and held:
                        yield flush()
                        continue
                    end = max(end, at + 1)
                    held.append(ids[bounds[at] : bounds[end]])
                    sizes += np.diff(bounds[at : end + 1]).tolist()
                    keys += names[at:end]
                    at = end
        if keys:
            yield flush()

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    if docs.schema[key].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{key} must be an integer")
    # a key with very many rows is split by its texts' hashes, equal texts by their place in the input
    named = docs.select(F.col(key).cast("long").alias(key), text, F.xxhash64(text).alias("_h"), F.monotonically_increasing_id().alias("_n"))
    ordered = named.repartitionByRange(key, "_h", "_n").sortWithinPartitions(key, "_h", "_n").select(key, text)
    return checkpointed(ordered.mapInArrow(run, "part long, shard long, file string, n_docs long, n_ids long"))


def read_documents(manifest: DataFrame, folder: str, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document in the files; start counts the ids of all before it."""
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    totals = manifest.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row for each partition that wrote
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = manifest.withColumn("inside", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(totals, "part")
    placed = placed.select("file", (F.col("base") + F.col("inside")).alias("base")).repartition("file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                with store.open_input_file(f"{root}/{name}") as f:
                    shard = Shard.open(lambda size, offset, f=f: f.read_at(size, offset))
                    for first in range(0, len(shard), READ_DOCS):
                        keys, bounds, ids = shard.documents(first, min(first + READ_DOCS, len(shard)))
                        data, at = memoryview(ids).cast("B"), (4 * (bounds - bounds[0])).tolist()
                        crc = [zlib.crc32(data[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
                        columns = [pa.array(keys, pa.int64()), pa.array(bounds[:-1] + base), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())]
                        yield pa.RecordBatch.from_arrays(columns, names=[key, "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(run, f"`{key}` long, start long, n_tokens long, ids_crc32 long")


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = qualified(spark, f"{shared_dir(spark).rstrip('/')}/token-store-{uuid.uuid4().hex}")
    return read_documents(write_shards(table(spark, sf_dir, "documents"), folder), folder)
