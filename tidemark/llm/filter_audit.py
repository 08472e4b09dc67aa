"""Filter interaction audit by contractions of contingency tensors.

Every document is judged by all filters at once, so a part (a source) is described by how many of its documents fail which
filters: a tensor of 2 x 2 x ... x 2 counts, an axis a filter, index 0 where a document passes. What a filter does at a step
of an order follows by contraction: the axes of filters applied before select "pass", its own selects "fail" (or "pass" for
what it keeps), later ones select "all". One ``einsum`` does so for all parts of a batch and all steps of all orders; documents are never read
again. Two more tensors count the documents of good quality and the toxic ones.

The filters are one letter each (``FILTERS``): A under 50 words, B few distinct words, C many capitals, D symbols, E a
text that a smaller id has already, anywhere in the table. Texts are compared by their SHA-256.

Hot parts and texts: counts and smallest ids are pre-aggregated before they are shuffled. Copies of a text meet its smallest id by text and
id together, so they are spread over tasks. What is joined to the rows has been written before, so that both sides are plain
shuffles and an id of very many rows can be split as well. Per part at most
32 rows of counts meet, however many documents it has, and parts are contracted in batches on the executors.

Cases: a null text is empty, and so identical to an empty one; a null source is the part "", as an empty one is; a null id is
neither smaller nor larger than another and has no labels; repeated rows count each, and equal ids are not
smaller than each other; of repeated or null labels one that says 1 suffices; labels of absent documents don't count; an empty
table gives an empty result; extra columns are not passed on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, utf8_slices, written

FILTERS = "ABCDE"
SYMBOLS = b"#$%&*|"
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 50, 65, 5
_CAPITALS = bytes(range(65, 91))
_CONTINUATION = bytes(range(0x80, 0xC0))  # the bytes of UTF-8 that start no code point


def failures(text: bytes) -> int:
    """Which of the filters A to D a text fails; bit k is that of ``FILTERS[k]``."""
    words = text.split()  # on bytes: exactly the ASCII white space
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    points = len(text.translate(None, _CONTINUATION))
    return (
        (len(words) < MIN_WORDS)
        | (100 * len(set(words)) < DISTINCT_PERCENT * len(words)) << 1
        | (100 * capitals > CAPITAL_PERCENT * points) << 2
        | (len(text.translate(None, SYMBOLS)) < len(text)) << 3
    )


def judged(docs: DataFrame, text: str = "text", key: str = "doc_id", part: str = "source") -> DataFrame:
    """(id, part, bits, digest) of every row: what it fails by itself, and its text's SHA-256."""
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, texts in utf8_slices(batch, "text"):
                bits = pa.array([failures(t) for t in texts], pa.int32())
                digest = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([some.column("id"), some.column("part"), bits, digest], names=["id", "part", "bits", "digest"])

    named = docs.select(F.col(key).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text).alias("text"))
    return named.mapInArrow(run, f"id {key_type}, part string, bits int, digest binary")


def counts(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", part: str = "source") -> DataFrame:
    """(part, bits, n, good, toxic): documents of each part by what they fail, those of quality 1, and the toxic ones."""
    rows = written(judged(docs, text, key, part))
    first = rows.where("id is not null").groupBy("digest").agg(F.min("id").alias("id"), F.lit(True).alias("first"))
    # met by text and id, so that the copies of a text are spread over tasks; who isn't the first has a smaller id before it
    again = rows.where("id is not null").join(written(first), ["digest", "id"], "left")
    again = again.select("id", "part", (F.col("bits") + F.when(F.col("first"), 0).otherwise(16)).alias("bits"))
    marks = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id"))
    marks = marks.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    named = again.join(written(marks), "id", "left").select("part", "bits", "good", "toxic")
    unnamed = rows.where("id is null").select("part", "bits", F.lit(0).alias("good"), F.lit(0).alias("toxic"))  # no join, so no hot null
    sums = [F.count("*").alias("n"), *(F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic"))]
    return named.unionByName(unnamed).groupBy("part", "bits").agg(*sums)


ORDERS = ["".join(p) for p in permutations(FILTERS)]
PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)


def selectors(own: tuple[int, int], before: tuple[int, int], after: tuple[int, int]) -> list[np.ndarray]:
    """For each filter's axis, what every step of every order (orders times steps rows) selects on it."""
    chosen = np.array([[own if f == at else before if order.index(f) < order.index(at) else after for f in FILTERS] for order in ORDERS for at in order])
    return [chosen[:, axis] for axis in range(len(FILTERS))]


def contracted(tensors: np.ndarray, chosen: list[np.ndarray]) -> np.ndarray:
    """(part, step of an order) from (part, 2, 2, 2, 2, 2): the sums over what the selectors choose on each axis."""
    return np.einsum("pabcde,ka,kb,kc,kd,ke->pk", tensors, *chosen, optimize="greedy")


_STEPS = len(FILTERS)
_KEPT, _REMOVED = selectors(PASS, PASS, ALL), selectors(FAIL, PASS, ALL)
_FAILING, _ALONE = selectors(FAIL, ALL, ALL), selectors(FAIL, PASS, PASS)
_LETTERS = [f for order in ORDERS for f in order]
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(tensors: np.ndarray) -> dict[str, np.ndarray]:
    """The measures of every (part, step of an order) from (3, part, 2, 2, 2, 2, 2): all documents, good and toxic ones."""
    removed = contracted(tensors[0], _REMOVED)
    letter = np.array([FILTERS.index(f) for f in _LETTERS])
    shapley = np.stack([removed[:, letter == k].sum(axis=1) for k in range(_STEPS)], axis=1)
    found = contracted(tensors[0], _KEPT), removed, contracted(tensors[0], _FAILING) - removed, contracted(tensors[0], _ALONE)
    return dict(zip(MEASURES, (*found, contracted(tensors[1], _REMOVED), contracted(tensors[2], _REMOVED), shapley[:, letter]), strict=True))


def filter_audit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", part: str = "source") -> DataFrame:
    """(part, filter_order, step, filter, and the measures): a row for each step of each of the 120 orders in every part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):  # parts at a time
                batch = whole.slice(at, 256)
                cells = batch.column("cells")
                owner = np.repeat(np.arange(batch.num_rows), np.diff(cells.offsets.to_numpy()))
                cell = [cells.flatten().field(k).to_numpy() for k in range(4)]
                tensors = np.zeros((3, batch.num_rows, 32), np.int64)
                for k in range(3):
                    tensors[k, owner, cell[0]] = cell[k + 1]
                # bit k of the cell's number is filter k: the last axis varies fastest, so the axes come in reverse
                found = audit(tensors.reshape(3, -1, 2, 2, 2, 2, 2).transpose(0, 1, 6, 5, 4, 3, 2))
                parts, steps = batch.num_rows, len(_LETTERS)
                named = [batch.column("part").take(pa.array(np.repeat(np.arange(parts), steps))), pa.array([o for o in ORDERS for _ in o] * parts)]
                named += [pa.array(np.tile(np.arange(1, _STEPS + 1), parts * len(ORDERS)), pa.int32()), pa.array(_LETTERS * parts)]
                yield pa.RecordBatch.from_arrays([*named, *(pa.array(found[m].ravel()) for m in MEASURES)], names=["part", "filter_order", "step", "filter", *MEASURES])

    cells = F.collect_list(F.struct("bits", "n", "good", "toxic")).alias("cells")  # 32 at most
    parts = counts(docs, labels, text, key, part).groupBy("part").agg(cells)
    return parts.mapInArrow(run, f"part string, filter_order string, step int, filter string, {', '.join(m + ' long' for m in MEASURES)}")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("filter")


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), f AS (
  SELECT doc_id, part, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t),
    regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS fails FROM d
), l AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), c AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS g, count(*) FILTER (WHERE toxic) AS x FROM f LEFT JOIN l USING (doc_id) GROUP BY part, fails
), letters(i) AS (VALUES (1), (2), (3), (4), (5)), perms AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS p FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), steps AS (
  SELECT p, list_aggregate(list_transform(p, lambda i: 'ABCDE'[i]), 'string_agg', '') AS filter_order, s.i AS step, p[s.i] AS f, p[1:s.i - 1] AS before FROM perms, letters s
), m AS (
  SELECT part, filter_order, step, f,
    coalesce(sum(n) FILTER (WHERE NOT fails[f] AND NOT earlier), 0) AS kept, coalesce(sum(n) FILTER (WHERE fails[f] AND NOT earlier), 0) AS removed,
    coalesce(sum(n) FILTER (WHERE fails[f] AND earlier), 0) AS redundant, coalesce(sum(n) FILTER (WHERE fails[f] AND len(list_filter(fails, lambda v: v)) = 1), 0) AS unique_fails,
    coalesce(sum(g) FILTER (WHERE fails[f] AND NOT earlier), 0) AS good_lost, coalesce(sum(x) FILTER (WHERE fails[f] AND NOT earlier), 0) AS toxic_lost
  FROM (SELECT c.*, steps.*, len(list_filter(before, lambda b: fails[b])) > 0 AS earlier FROM c, steps) GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM m
"""
