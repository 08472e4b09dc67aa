"""Best-fit packing of whole documents by sum of squares.

A sequence holds at most ``capacity`` tokens; a document longer than that is cut into pieces of the capacity and a rest, and
nothing else is cut. Let N(g) be the number of open sequences with room for just g more tokens. A piece goes where the sum of N(g)^2
over all g is smallest afterwards: into an open sequence of some gap, or into a new one. A sequence that is full counts no more. This keeps the gaps
spread out, so that whatever comes next finds one that it fits. Ties go to the fullest open sequence, and to an open one before a new one.

The work has two levels, so that no task sees more than its share:

1. Each task packs the rows of its own partition where they lie: up to ``chunk`` pieces at a time, the longest first; open sequences
   stay open from one chunk to the next. What is left open at the end with a gap of ``loose`` tokens or more is taken apart.
2. The pieces of such sequences, as (id, position, length, checksum) without their text, are packed once more, those of ``FAN_IN`` tasks together.

The first level's rows are written to the shared folder in between, so the texts are encoded once, and a retried task of the second
level finds the same rows in the same order. A task keeps at most ``open_limit`` sequences open; beyond that the fullest is closed, which
bounds memory whatever the lengths are and drops nothing.

Cases: a null text is empty and is its end id alone; ties keep the order of rows; repeated rows and equal ids are packed each;
null ids are kept; an empty table gives an empty result; extra columns are not passed on.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, written
from .tokens import default_path, document_ids

CAPACITY = 4096
CHUNK = 1 << 16
#: Tasks whose loose sequences are packed together.
FAN_IN = 32
#: Sequences of the second level are numbered from here on.
SECOND = 1 << 62


class SumOfSquares:
    """Pieces in by ``place``, full sequences out; a sequence is a list of the pieces' tokens (any objects) and its gap."""

    def __init__(self, capacity: int = CAPACITY, open_limit: int = 4096):
        self.capacity, self.open_limit, self.n_open = capacity, open_limit, 0
        self.count = np.zeros(capacity + 1)
        # A gap that closes counts for nothing, where another costs 2 N + 1: as if it stood at N = -1/2
        self.count[0] = -0.5
        self.relief = np.full(capacity + 1, np.inf)  # -N(g), where a sequence of that gap is open
        self.bins: dict[int, list[list]] = {}

    def _take(self, gap: int) -> list:
        found = self.bins[gap].pop()
        self.n_open -= 1
        self.count[gap] -= 1
        self.relief[gap] = -self.count[gap] if self.count[gap] else np.inf
        return found

    def place(self, piece, size: int) -> list | None:
        """Put a piece where it belongs; a sequence that is thereby finished is returned."""
        if size >= self.capacity:
            return [piece]
        # the sum changes by 2 (N(g - size) - N(g) + 1) in a sequence of gap g, and by 2 N(capacity - size) + 1 in a new one
        change = self.count[: self.capacity - size] + self.relief[size : self.capacity]
        at = int(change.argmin())
        if change[at] <= self.count[self.capacity - size] - 0.5:
            found, gap = self._take(size + at), at
        else:
            found, gap = [], self.capacity - size
        found.append(piece)
        if not gap:
            return found
        self.bins.setdefault(gap, []).append(found)
        self.n_open += 1
        self.count[gap] += 1
        self.relief[gap] = -self.count[gap]
        return self._take(int(np.isfinite(self.relief).argmax())) if self.n_open > self.open_limit else None

    def drain(self) -> Iterator[tuple[int, list]]:
        """(gap, sequence) of all that are open."""
        for gap in sorted(self.bins):
            for found in self.bins[gap]:
                yield gap, found
        self.bins, self.n_open = {}, 0
        self.count[1:], self.relief[:] = 0, np.inf


#: Of a row: which document and piece, where its ids start, how many and their checksum, and its place (null while it has none).
_KINDS = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
_NAMES = ("piece", "start", "length", "ids_crc32", "sequence_id", "offset", "origin", "serial")
_SCHEMA = "piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, origin long, serial long"


class _Rows:
    """Collects the rows of sequences of one task and makes batches of them."""

    def __init__(self, key: str, first: int):
        self.key, self.number, self.rows = key, first, []

    def sequence(self, pieces: list[tuple]) -> None:
        at = 0
        for name, piece, start, length, crc, origin, serial in pieces:
            self.rows.append((name, piece, start, length, crc, self.number, at, origin, serial))
            at += length
        self.number += 1

    def loose(self, pieces: list[tuple]) -> None:
        self.rows += [(*p[:5], None, None, *p[5:]) for p in pieces]

    def batches(self, kind: pa.DataType, least: int = 1) -> Iterator[pa.RecordBatch]:
        if len(self.rows) >= least:
            for at in range(0, len(self.rows), CHUNK):
                columns = zip(*self.rows[at : at + CHUNK], strict=True)
                arrays = [pa.array(c, k) for c, k in zip(columns, (kind, *_KINDS), strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=[self.key, *_NAMES])
            self.rows = []


def pack_documents(
    docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, loose: int | None = None, chunk: int = CHUNK,
    open_limit: int = 4096, text: str = "text", key: str = "doc_id",
) -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset): a row for each piece of every document's ids, end id included.

    ``loose`` is the gap from which on a task's open sequences are packed again; by default a 128th of the capacity.
    """
    path, least_gap = tokenizer_path or default_path(), max(1, capacity // 128) if loose is None else loose
    key_type = docs.schema[key].dataType.simpleString()
    long_first = lambda pieces: sorted(pieces, key=lambda p: -p[3])  # noqa: E731  stable, so ties keep their order

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        packer, out, waiting, serial, kind = SumOfSquares(capacity, open_limit), _Rows(key, part << 32), [], 0, None

        def settle() -> None:
            for p in long_first(waiting):
                if done := packer.place(p, p[3]):
                    out.sequence(done)
            waiting.clear()

        for batch in batches:
            kind = batch.schema.field(0).type
            for some in slices(batch, "text", 1024):
                ids, bounds = document_ids(path, some.column("text"))
                for name, a, b in zip(some.column("key").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    for k, at in enumerate(range(a, b, capacity)):
                        end = min(b, at + capacity)
                        waiting.append((name, k, at - a, end - at, zlib.crc32(ids[at:end]), part, serial))
                        serial += 1
                        if len(waiting) >= chunk:
                            settle()
            yield from out.batches(kind, CHUNK)
        settle()
        for gap, pieces in packer.drain():
            (out.loose if gap >= least_gap else out.sequence)(pieces)
        yield from out.batches(kind)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, kind = SumOfSquares(capacity, open_limit), None
        out = _Rows(key, SECOND + (TaskContext.get().partitionId() << 32))
        for batch in batches:
            kind = batch.schema.field(key).type
            for p in zip(*(batch.column(c).to_pylist() for c in (key, "piece", "start", "length", "ids_crc32", "origin", "serial")), strict=True):
                if done := packer.place(p, p[3]):
                    out.sequence(done)
            yield from out.batches(kind, CHUNK)
        for _, pieces in packer.drain():
            out.sequence(pieces)
        yield from out.batches(kind)

    schema = f"`{key}` {key_type}, {_SCHEMA}"
    rows = written(docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(first, schema))
    open_ = rows.where("sequence_id is null").repartition(F.floor(F.col("origin") / FAN_IN))
    again = open_.sortWithinPartitions(F.desc("length"), "origin", "serial").mapInArrow(second, schema)
    return rows.where("sequence_id is not null").unionByName(again).drop("origin", "serial")


def op12_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
