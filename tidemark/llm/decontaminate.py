"""Benchmark decontamination with a broadcast set of normalised test n-grams.

Words are runs of ``[0-9a-z]`` and non-ASCII characters after lower-casing A-Z. A window is 13 consecutive words of a
benchmark item; an item of 1 to 12 words is one window. Every document is scanned with rolling window hashes; a hit in
the hash set is verified word for word.

The benchmark is broadcast in blocks: a block holds items of at most ``block_bytes`` of text (or one item). An ordinary
benchmark is one block, and one scan gives the result. A larger one is worked off block by block: each is broadcast,
scanned for, and destroyed before the next is read, and its hits are written under the hash of the text that holds
them; the union of all hits, merged into spans, is joined back to the documents. So no more than one block is ever in
memory or broadcast, and a document is judged or cut once, on all its hits. A Python worker prepares a block once.

Cases: null and empty texts have no words and are never hit; an item without words has no window; equal items are found
each; items without an id count as one item that has no name; rows are judged by their text, so repeated ids and rows
are right; an empty benchmark or table gives rows without hits or none; extra columns are only passed on by
``remove_contaminated``.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, utf8_slices, written

N = 13
BLOCK_BYTES = 8 << 20
_KEEP = frozenset(range(0x30, 0x3A)) | frozenset(range(0x61, 0x7B)) | frozenset(range(0x80, 0x100))
_TABLE = bytes(i if i in _KEEP else (i + 32 if 0x41 <= i <= 0x5A else 0x20) for i in range(256))
_MULT = np.uint64(0x9E3779B97F4A7C15)


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class NGrams:
    """The windows of some benchmark items, ready for scanning."""

    def __init__(self, items: list[tuple[object, bytes]], n: int = N):
        self.n, self.vocab = n, {}
        by_size: dict[int, dict[tuple, set]] = {}
        for item, text in items:
            ids = tuple(self.vocab.setdefault(w, len(self.vocab) + 1) for w in words(text))
            size = min(n, len(ids))
            for i in range(len(ids) - size + 1 if size else 0):
                by_size.setdefault(size, {}).setdefault(ids[i : i + size], set()).add(item)
        self.sizes = []
        for size, found in sorted(by_size.items()):
            grams = np.array(list(found), np.int64).reshape(len(found), size)
            key = self._hash(grams.T)
            order = np.argsort(key, kind="stable")
            self.sizes.append((size, key[order], grams[order], [sorted(found[tuple(g)], key=str) for g in grams[order].tolist()]))

    @staticmethod
    def _hash(columns) -> np.ndarray:
        key = np.zeros(len(columns[0]), np.uint64)
        for c in columns:
            key = (key + c.astype(np.uint64)) * _MULT
            key ^= key >> np.uint64(29)
        return key

    def scan(self, doc_words: list[list[bytes]]) -> tuple[list[int], list[list[tuple[int, int]]], list[set]]:
        """Hit word counts, merged hit spans (word from, to) and items of each document."""
        sizes = np.array([len(w) for w in doc_words])
        starts = np.cumsum(sizes + self.n) - (sizes + self.n)  # n zeros part the documents: no window crosses
        ids = np.zeros(int((sizes + self.n).sum()), np.int64)
        get = self.vocab.get
        for s, w in zip(starts.tolist(), doc_words, strict=True):
            ids[s : s + len(w)] = [get(x, 0) for x in w]
        hit = np.zeros(len(ids), bool)
        items: list[set] = [set() for _ in doc_words]
        known = np.r_[0, np.cumsum(ids != 0)]
        for size, keys, grams, owners in self.sizes:
            if len(ids) < size:
                continue
            at = np.flatnonzero(known[size:] - known[:-size] == size)  # windows of known words only
            if not len(at):
                continue
            key = self._hash([ids[at + k] for k in range(size)])
            lo, hi = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
            for where, a, b in zip(at[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
                for g in range(a, b):
                    if (ids[where : where + size] == grams[g]).all():  # verified
                        hit[where : where + size] = True
                        items[int(np.searchsorted(starts, where, "right")) - 1].update(owners[g])
        counts, spans = [], []
        for s, n in zip(starts.tolist(), sizes.tolist(), strict=True):
            edge = np.flatnonzero(np.diff(np.r_[0, hit[s : s + n].view(np.int8), 0]))
            spans.append(list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)))
            counts.append(int(hit[s : s + n].sum()))
        return counts, spans, items


def _blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int) -> Iterator[list[tuple[object, bytes]]]:
    """Items in blocks of bounded text, streamed to the driver a partition at a time."""
    held, size = [], 0
    for row in benchmark.select(item, text).where(F.col(text).isNotNull()).toLocalIterator():
        data = row[1].encode()
        if held and size + len(data) > block_bytes:
            yield held
            held, size = [], 0
        held.append((row[0], data))
        size += len(data)
    if held:
        yield held


_PREPARED: dict[tuple, NGrams] = {}


def _prepared(name: str, shared, n: int) -> NGrams:
    """The windows of a broadcast block; a Python worker keeps those of the last one."""
    if (name, n) not in _PREPARED:
        _PREPARED.clear()
        _PREPARED[name, n] = NGrams(shared.value if shared else [], n)
    return _PREPARED[name, n]


_SPAN = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
_SPAN_SQL = "array<struct<`from`:long,`to`:long>>"


def _span_array(spans: list) -> pa.Array:
    return pa.array([[{"from": a, "to": b} for a, b in x] for x in spans], _SPAN)


def _item_array(items: list[set]) -> pa.Array:
    return pa.array([sorted(str(i) for i in x if i is not None) + [None] * (None in x) for x in items], pa.list_(pa.string()))


def _block_hits(docs: DataFrame, text: str, block: list, n: int) -> DataFrame:
    """(hash, items, spans) of the distinct texts that one block hits, written; the broadcast is gone afterwards."""
    shared, name = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = _prepared(name, shared, n)
        for batch in batches:
            for _, texts in utf8_slices(batch, text, 256):
                counts, spans, items = grams.scan([words(t) for t in texts])
                at = [i for i, k in enumerate(counts) if k]
                columns = [pa.array([hashlib.sha256(texts[i]).digest() for i in at], pa.binary()), _item_array([items[i] for i in at]), _span_array([spans[i] for i in at])]
                yield pa.RecordBatch.from_arrays(columns, names=["hash", "items", "spans"])

    found = docs.select(text).mapInArrow(run, f"hash binary, items array<string>, spans {_SPAN_SQL}")
    found = written(found.groupBy("hash").agg(F.first("items").alias("items"), F.first("spans").alias("spans")))
    shared.destroy()
    return found


def _all_hits(docs: DataFrame, text: str, blocks: Iterator[list], n: int) -> DataFrame:
    """(hash, items, spans) of hit texts over all blocks; spans merged. Few rows a text, one from each block that hits it."""
    found = None
    for block in blocks:
        one = _block_hits(docs, text, block, n)
        found = one if found is None else found.unionByName(one)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = [{i for part in x for i in part} for x in batch.column("items").to_pylist()]
            spans = [_union([(y["from"], y["to"]) for part in x for y in part]) for x in batch.column("spans").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("hash"), _item_array(items), _span_array(spans)], names=["hash", "items", "spans"])

    gathered = found.groupBy("hash").agg(F.collect_list("items").alias("items"), F.collect_list("spans").alias("spans"))
    return written(gathered.mapInArrow(run, f"hash binary, items array<string>, spans {_SPAN_SQL}"))


def _split(benchmark: DataFrame, item: str, text: str, block_bytes: int) -> tuple[list | None, Iterator[list]]:
    """The only block (or nothing) and no more; or None and all blocks, one at a time."""
    blocks = _blocks(benchmark, item, text, block_bytes)
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        return first, iter(())
    return None, chain([first, second], blocks)


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    item: str = "item_id",
    item_text: str = "text",
    n: int = N,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(key, n_words, n_hit, items array<string>, spans array<struct<from,to>> in words) for every row of ``docs``."""
    key_type = docs.schema[key].dataType.simpleString()
    only, blocks = _split(benchmark, item, item_text, block_bytes)
    name = uuid.uuid4().hex
    if only is None:
        hits = _all_hits(docs, text, blocks, n)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, texts in utf8_slices(batch, text, 256):
                    sizes, hashes = [len(words(t)) for t in texts], [hashlib.sha256(t).digest() for t in texts]
                    yield pa.RecordBatch.from_arrays([part.column(key), pa.array(sizes, pa.int64()), pa.array(hashes, pa.binary())], names=[key, "n_words", "hash"])

        rows = docs.select(key, text).mapInArrow(count, f"`{key}` {key_type}, n_words long, hash binary").join(hits, "hash", "left")
        n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["to"] - x["from"])
        none = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
        return rows.select(key, "n_words", F.coalesce(n_hit, F.lit(0)).alias("n_hit"), none("items", "array<string>"), none("spans", _SPAN_SQL))
    shared = docs.sparkSession.sparkContext.broadcast(only) if only else None  # at most block_bytes of text, or a single item

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = _prepared(name, shared, n)
        for batch in batches:
            for part, texts in utf8_slices(batch, text, 256):
                found = [words(t) for t in texts]
                counts, spans, items = grams.scan(found)
                sizes = pa.array([len(w) for w in found], pa.int64())
                columns = [part.column(key), sizes, pa.array(counts, pa.int64()), _item_array(items), _span_array(spans)]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "n_words", "n_hit", "items", "spans"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {key_type}, n_words long, n_hit long, items array<string>, spans {_SPAN_SQL}")


def is_contaminated(n_hit, n_words):
    return (n_hit > 0) & (20 * n_hit >= n_words)


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of one document from several blocks, merged as ``contamination`` merges them."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and out[-1][1] >= a:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def _judged(batch: pa.RecordBatch, text: str, unit: str, hits: list) -> pa.RecordBatch:
    """A batch without its contaminated documents, or with the hit spans cut out of the texts."""
    if not any(hits):
        return batch
    texts = [x or b"" for x in batch.column(text).cast(pa.binary()).to_pylist()]
    if unit == "span":
        cut = pa.array([(_cut(t, words(t), s) if s else t).decode() for t, s in zip(texts, hits, strict=True)], pa.string())
        cut = pc.if_else(batch.column(text).is_null(), pa.scalar(None, pa.string()), cut)
        return batch.set_column(batch.schema.get_field_index(text), text, cut)
    keep = [not s or not is_contaminated(sum(b - a for a, b in s), len(words(t))) for t, s in zip(texts, hits, strict=True)]
    return batch.filter(pa.array(keep, pa.bool_()))


def remove_contaminated(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", unit: str = "document", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``docs`` (all columns) without contaminated documents, or with every hit span cut out of the text.

    ``unit`` is "document" or "span". A cut takes the bytes from the first to the last word of a merged hit. Where the
    benchmark has several blocks, a document is judged or cut once, on the union of their hits.
    """
    only, blocks = _split(benchmark, "item_id", "text", block_bytes)
    name = uuid.uuid4().hex
    if only is None:
        row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
        hashed = docs.select(row, F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("hash"))
        marked = hashed.join(_all_hits(docs, text, blocks, N), "hash", "left").select("row", "spans")

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                whole = pa.RecordBatch.from_struct_array(batch.column("row"))
                for at, part in _placed(slices(whole, text, 256)):
                    spans = batch.column("spans").slice(at, part.num_rows).to_pylist()
                    yield _judged(part, text, unit, [[(y["from"], y["to"]) for y in x or ()] for x in spans])

        return marked.mapInArrow(apply, docs.schema)
    shared = docs.sparkSession.sparkContext.broadcast(only) if only else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = _prepared(name, shared, N)
        for batch in batches:
            for part, texts in utf8_slices(batch, text, 256):
                yield _judged(part, text, unit, grams.scan([words(t) for t in texts])[1])

    return docs.mapInArrow(run, docs.schema)


def _placed(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    at = 0
    for part in parts:
        yield at, part
        at += part.num_rows


def _cut(text: bytes, found: list[bytes], spans: list[tuple[int, int]]) -> bytes:
    low, at, places = text.translate(_TABLE), 0, []
    for w in found:
        at = low.index(w, at)
        places.append((at, at + len(w)))
        at += len(w)
    out, last = [], 0
    for a, b in spans:
        out.append(text[last : places[a][0]])
        last = places[b - 1][1]
    return b"".join([*out, text[last:]])


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def item_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL
), g AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM g), p AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
), h AS (SELECT p.doc_id, p.i, p.n, g.item_id FROM p JOIN g ON p.gram = g.gram AND p.n = g.n),
c AS (
  SELECT doc_id, count(DISTINCT j)::BIGINT AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM h) GROUP BY doc_id
), e AS (
  SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN e USING (doc_id)
"""
