"""Vector bin packing of examples into training sequences.

A sequence has three limits at once: tokens, segments, and loss-bearing tokens. ``VectorPacker`` fills one sequence at a
time and always adds the waiting example whose demand vector has the largest dot product with what the sequence has
left (both as shares of the limits), so a scarce resource steers the choice. Where cutting is allowed, the remainder of
a sequence is filled with the first part of an example, and a last sequence is cut at powers of two, which need no
padding.

The work is done where the rows lie: each task packs the rows of its own partition, holds a bounded pool of waiting
examples (of long documents only what is left of them), and numbers its sequences by partition. Nothing is shuffled, and a
retried task gives the same result. A piece bears loss on all ids but its first; where answers alone bear loss, as in
instruction data, ``pack_examples`` takes the counts and never cuts.

Cases: a null text is empty and is its end id alone; longer documents than a sequence are cut; ties go to the example
that came first; repeated rows are packed each; an empty table gives an empty result; extra columns are not passed on.
An example that alone exceeds a limit, where cutting isn't allowed, gets a sequence of its own and is marked.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table
from .tokens import default_path, document_ids


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 128
    loss: int = 2048


@dataclass
class VectorPacker:
    """Examples in by ``add``, sequences out as lists of (example, start, length)."""

    limits: Limits = field(default_factory=Limits)
    cut: bool = True
    pool_size: int = 256

    def __post_init__(self):
        self.ids: list = []
        self.start: list[int] = []
        self.fresh: list[tuple] = []
        self.demand = np.zeros((0, 3))  # tokens, segments, loss of what is left of each waiting example

    def add(self, example, tokens: int, loss: int, start: int = 0) -> None:
        self.ids.append(example)
        self.start.append(start)
        self.fresh.append((tokens, 1, loss))

    def _settle(self) -> None:
        if self.fresh:
            self.demand = np.concatenate([self.demand, np.array(self.fresh, float)])
            self.fresh = []

    def ready(self) -> Iterator[list[tuple]]:
        """Sequences while the pool is over its size; the rest waits."""
        self._settle()
        while len(self.demand) > self.pool_size:
            yield from self._sequence()

    def flush(self) -> Iterator[list[tuple]]:
        self._settle()
        while len(self.demand):
            yield from self._sequence()

    def _sequence(self) -> Iterator[list[tuple]]:
        limit = np.array([self.limits.tokens, self.limits.segments, self.limits.loss], float)
        left, out, used = limit.copy(), [], 0
        demand = self.demand[: 4 * self.pool_size]
        alive = np.ones(len(demand), bool)
        share = demand / limit
        while left[0] > 0 and left[1] > 0 and alive.any():
            fits = alive & (demand <= left).all(axis=1)
            last = self.cut and left[1] == 1  # one segment left: it had better be long enough
            if last:
                fits &= demand[:, 0] == left[0]
            if fits.any():
                pick = int(np.argmax(np.where(fits, share @ (left / limit), -1.0)))
                out.append((self.ids[pick], self.start[pick], int(demand[pick, 0])))
                left -= demand[pick]
                alive[pick] = False
                continue
            if not self.cut or (out and left[2] <= 0):
                break
            longer = alive & ~(demand <= left).all(axis=1)  # by tokens or by loss
            if longer.any() or last:
                pick = int(np.argmax(np.where(longer if longer.any() else alive, demand[:, 0], -1.0)))
                room = int(min(left[0], left[2] + 1, demand[pick, 0]))  # a piece's first id bears no loss
                out.append((self.ids[pick], self.start[pick], room))
                left -= [room, 1, room - 1]
                if room < demand[pick, 0]:
                    self.start[pick] += room
                    demand[pick, 0] -= room
                    demand[pick, 2] = demand[pick, 0] - 1
                    share[pick] = demand[pick] / limit
                    left[0] = 0  # the sequence is full, or its loss is
                else:
                    alive[pick] = False
                continue
            break
        if not out:  # an example that no sequence can hold
            out.append((self.ids[0], self.start[0], int(demand[0, 0])))
            alive[0] = False
        keep = np.ones(len(self.demand), bool)
        keep[: len(alive)] = alive
        self.demand = self.demand[keep]
        self.ids = [x for x, k in zip(self.ids, keep.tolist(), strict=True) if k]
        self.start = [x for x, k in zip(self.start, keep.tolist(), strict=True) if k]
        used = sum(x[2] for x in out)
        yield from (_powers(out, used) if self.cut and used < self.limits.tokens else [out])


def _powers(pieces: list[tuple], total: int) -> Iterator[list[tuple]]:
    """Cut a sequence that isn't full at powers of two, the largest first."""
    at, pieces = 0, list(pieces)
    while total:
        want = 1 << (total.bit_length() - 1)
        total -= want
        out = []
        while want:
            example, start, length = pieces[at]
            take = min(want, length)
            out.append((example, start, take))
            pieces[at] = (example, start + take, length - take)
            at += take == length
            want -= take
        yield out


def pack_documents(
    docs: DataFrame, tokenizer_path: str | None = None, limits: Limits | None = None, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """One row a piece of every document's ids (with the end id): where it starts, and its sequence and offset there."""
    path, limits = tokenizer_path or default_path(), limits or Limits()
    key_type = docs.schema[key].dataType.simpleString()
    arrow_key: list[pa.DataType] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, number = VectorPacker(limits), TaskContext.get().partitionId() << 32
        ids_of: dict[int, tuple] = {}  # of documents that wait: key, how many ids, from which on they wait, and those
        serial = 0

        def rows(sequences) -> list[tuple]:
            nonlocal number
            out = []
            for pieces in sequences:
                at = 0
                for doc, start, length in pieces:
                    name, total, base, ids = ids_of[doc]
                    out.append((name, start, length, zlib.crc32(ids[start - base : start - base + length]), total, number, at))
                    at += length
                    if start + length == total:
                        del ids_of[doc]
                number += 1
            return out

        for batch in batches:
            arrow_key[:] = [batch.schema.field(key).type]
            for part in slices(batch, text, 1024):
                ids, bounds = document_ids(path, part.column(text))
                out = []
                for name, a, b in zip(part.column(key).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    whole = (b - a) // limits.tokens * limits.tokens if limits.loss >= limits.tokens - 1 else 0
                    ids_of[serial] = (name, b - a, 0, ids[a:b])
                    out += rows([[(serial, s, limits.tokens)] for s in range(0, whole, limits.tokens)])
                    if b - a > whole:  # only what waits is kept
                        ids_of[serial] = (name, b - a, whole, ids[a + whole : b].copy())
                        packer.add(serial, b - a - whole, b - a - whole - 1, whole)
                    serial += 1
                out += rows(packer.ready())
                if out:
                    yield batch_of(out)
        if out := rows(packer.flush()):
            yield batch_of(out)

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        kinds = [arrow_key[0], *[pa.int64()] * 6]
        names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    schema = f"`{key}` {key_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return docs.select(key, text).mapInArrow(run, schema)


def pack_examples(
    examples: DataFrame, key: str, tokens: str, loss: str, limits: Limits | None = None, pool_size: int = 256
) -> DataFrame:
    """Instruction data: whole examples, never cut, under all three limits.

    (key, sequence_id, offset, tokens, loss, oversized). Null counts are zero; an example without tokens takes a segment.
    """
    limits = limits or Limits()
    key_type = examples.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, number = VectorPacker(limits, cut=False, pool_size=pool_size), TaskContext.get().partitionId() << 32
        kind = None

        def out_of(sequences) -> Iterator[pa.RecordBatch]:
            nonlocal number
            rows = []
            for pieces in sequences:
                at = 0
                for (name, n, bearing), _, _ in pieces:
                    rows.append((name, number, at, n, bearing, n > limits.tokens or bearing > limits.loss))
                    at += n
                number += 1
            if rows:
                kinds = (kind, *[pa.int64()] * 4, pa.bool_())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                    names=[key, "sequence_id", "offset", "tokens", "loss", "oversized"],
                )

        for batch in batches:
            kind = batch.schema.field(key).type
            for name, n, bearing in zip(*(batch.column(c).to_pylist() for c in (key, tokens, loss)), strict=True):
                packer.add((name, n or 0, bearing or 0), n or 0, bearing or 0)
            yield from out_of(packer.ready())
        yield from out_of(packer.flush())

    schema = f"`{key}` {key_type}, sequence_id long, offset long, tokens long, loss long, oversized boolean"
    return examples.selectExpr(f"`{key}`", f"cast(`{tokens}` as long) as `{tokens}`", f"cast(`{loss}` as long) as `{loss}`").mapInArrow(run, schema)


def conversation_examples(turns: DataFrame, tokenizer_path: str | None = None, role: str = "assistant") -> DataFrame:
    """(conv_id, tokens, loss) of instruction data: the ids of all turns, each with its end id, and those of the answers,
    which alone bear loss. Null texts are empty; a conversation's turns are counted one by one, so none is gathered."""
    path = tokenizer_path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1024):
                counts = np.diff(document_ids(path, part.column("text"))[1])
                yield pa.RecordBatch.from_arrays([part.column("conv_id"), part.column("answer"), pa.array(counts, pa.int64())], names=["conv_id", "answer", "n"])

    kind = turns.schema["conv_id"].dataType.simpleString()
    answer = F.coalesce(F.col("role") == role, F.lit(False)).alias("answer")
    counted = turns.select("conv_id", answer, "text").mapInArrow(run, f"conv_id {kind}, answer boolean, n long")
    return counted.groupBy("conv_id").agg(F.sum("n").alias("tokens"), F.sum(F.when(F.col("answer"), F.col("n")).otherwise(0)).alias("loss"))


def packed_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruction data of ``conversations`` under all three limits at once: whole examples, few segments, half the tokens with loss."""
    examples = conversation_examples(table(spark, sf_dir, "conversations"))
    return pack_examples(examples, "conv_id", "tokens", "loss", Limits(tokens=2048, segments=8, loss=1024))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
