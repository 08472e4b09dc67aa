"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints have 64 bits. Two texts link when their fingerprints differ in at most two bits; a component is everything
reachable over links and is named by its smallest document id.

How links are found, exactly:

* Equal fingerprints are merged first (pre-aggregated), so copies are never compared with each other.
* A fingerprint is cut into eight bytes. Two that differ in at most two bits agree on at least six of them, so they
  share one of the 28 keys "six bytes and which". A key leaves 16 bits free: no bucket can hold more than 65,536
  distinct fingerprints, however skewed the input is, and none has more than 137 neighbours in its bucket.
* In a bucket the fingerprints are stored vertically, 64 to a lane: plane b holds bit b of each. A probe updates 64
  distances at a time with two carry-save counter words and an overflow word, and a lane is abandoned once all of its
  64 have overflowed the radius.
* A bucket emits a spanning forest of its links (at most one row for each member but one), never all pairs.

Components are then found on the fingerprints by minimum labels with pointer jumping; each round is a join and a
pre-aggregated minimum, and is cut off through the shared checkpoint folder.

Cases: a null, empty or blank text has no words and the fingerprint zero, which links like any other; a text of fewer
than three words is one shingle; ties at exactly half the shingles leave a bit at zero; repeated rows stay, with equal
results; an empty table gives an empty result; extra columns are not passed on.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, gather_runs, table, utf8_slices
from .graph import components

SEED = 42
RADIUS = 2
#: Probes times lanes that are compared at once; bounds the memory of a task.
CHUNK = 1 << 16

_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.uint8)


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of the lower-cased (A-Z) text's word shingles, repeats included."""
    words = text.lower().split()  # on bytes: only A-Z, only ASCII white space
    if not words:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) < shingle:
        hashes = [digest(join(words), SEED)]
    else:
        hashes = [digest(join(x), SEED) for x in zip(*(words[k:] for k in range(shingle)), strict=False)]
    n = len(hashes)
    as_bytes = np.fromiter(hashes, np.uint64, n).view(np.uint8).reshape(n, 8)
    ones = np.unpackbits(as_bytes, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 3) -> DataFrame:
    """(key, fp): fp is the fingerprint's 64 bits as a signed long."""
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in utf8_slices(batch, text):
                fp = np.fromiter((fingerprint(t, shingle) for t in texts), np.uint64, len(texts)).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(fp)], names=[key, "fp"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {key_type}, fp long")


#: The two bytes of a fingerprint that a key leaves out, masked to zero.
_MASKS = [~((0xFF << (8 * a)) | (0xFF << (8 * b))) & (2**64 - 1) for a, b in combinations(range(8), 2)]


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def buckets(distinct_fp: DataFrame) -> DataFrame:
    """(members array<long>) for every key that at least two distinct fingerprints share."""
    keys = F.array(*(F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for i, m in enumerate(_MASKS)))
    spread = int(distinct_fp.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # 28 rows come of each: more tasks than bytes ask for
    return (
        distinct_fp.select("fp")
        .repartition(spread, "fp")
        .select("fp", F.explode(keys).alias("x"))
        .groupBy("x")
        .agg(F.collect_list("fp").alias("members"))
        .where(F.size("members") > 1)
        .select("members")
    )


def _planes(fps: np.ndarray, lane: np.ndarray, slot: np.ndarray, lanes: int) -> np.ndarray:
    """planes[b, lane]: a word that holds bit b of the 64 fingerprints of a lane."""
    out = np.zeros((64, lanes), np.uint64)
    if not len(fps):
        return out
    starts = np.flatnonzero(np.r_[True, lane[1:] != lane[:-1]])
    one = np.uint64(1)
    for b in range(64):
        bit = ((fps >> np.uint64(b)) & one) << slot
        out[b, lane[starts]] = np.bitwise_or.reduceat(bit, starts)
    return out


def near_words(planes: np.ndarray, valid: np.ndarray, probe: np.ndarray, lane: np.ndarray) -> np.ndarray:
    """For each (probe fingerprint, lane): a word whose bit s says that slot s is within two bits of the probe.

    Distances are kept in carry-save form: ``ones`` and ``twos`` are the counter's bits, ``over`` marks slots that have
    reached three. Every eight planes, the probes whose lane has overflowed everywhere are abandoned.
    """
    result = np.zeros(len(probe), np.uint64)
    alive = np.arange(len(probe))
    over = ~valid[lane]
    ones = np.zeros_like(over)
    twos = np.zeros_like(over)
    full = np.uint64(2**64 - 1)
    zero, one = np.uint64(0), np.uint64(1)
    for b in range(64):
        bit = (probe >> np.uint64(b)) & one
        differs = planes[b, lane] ^ (zero - bit)
        carry = ones & differs
        ones ^= differs
        over |= twos & carry
        twos ^= carry
        if b % 8 == 7:
            over |= ones & twos
            keep = over != full
            if not keep.all():
                alive, probe, lane, over, ones, twos = (x[keep] for x in (alive, probe, lane, over, ones, twos))
                if not len(alive):
                    return result
    result[alive] = ~over
    return result


def bucket_forest(members: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (fingerprint, root) that span the links of each bucket. ``bucket`` is sorted; a bucket's members differ."""
    n = len(members)
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    sizes = np.diff(np.r_[starts, n])
    rank = np.arange(n) - np.repeat(starts, sizes)
    lanes_of = (sizes + 63) // 64
    first_lane = np.cumsum(lanes_of) - lanes_of
    which = np.repeat(np.arange(len(starts)), sizes)
    lane = first_lane[which] + rank // 64
    slot = (rank % 64).astype(np.uint64)
    lanes = int(lanes_of.sum())
    planes = _planes(members, lane, slot, lanes)
    head = np.searchsorted(lane, np.arange(lanes))
    count = np.diff(np.r_[head, n]).astype(np.uint64)
    valid = np.where(count == 64, np.uint64(2**64 - 1), (np.uint64(1) << (count % np.uint64(64))) - np.uint64(1))
    root = np.arange(n)

    def merge(a: np.ndarray, b: np.ndarray) -> None:
        """Join the trees of a[i] and b[i]; the smaller index becomes the root."""
        while len(a):
            ra, rb = root[a], root[b]
            low, high = np.minimum(ra, rb), np.maximum(ra, rb)
            open_ = low != high
            a, b, low, high = a[open_], b[open_], low[open_], high[open_]
            np.minimum.at(root, high, low)
            while (up := root[root]).tobytes() != root.tobytes():
                root[:] = up

    work = lanes_of[which]  # lanes that a probe meets
    done = 0
    cuts = np.cumsum(work)
    while done < n:
        last = max(done + 1, int(np.searchsorted(cuts, (cuts[done - 1] if done else 0) + CHUNK, "right")))
        probes = np.arange(done, last)
        at = np.repeat(probes, work[probes])
        against = gather_runs(first_lane[which[probes]], work[probes])
        near = near_words(planes, valid, members[at], against)
        hit = np.flatnonzero(near)
        left, right = [], []
        for s in range(64):
            got = hit[(near[hit] >> np.uint64(s)) & np.uint64(1) == 1]
            other = head[against[got]] + s
            keep = other < at[got]  # each link once; a fingerprint is near itself
            left.append(at[got][keep])
            right.append(other[keep])
        merge(np.concatenate(left), np.concatenate(right))
        done = last
    child = np.flatnonzero(root != np.arange(n))
    return members[child], members[root[child]]


def links(distinct_fp: DataFrame) -> DataFrame:
    """(a, b): pairs of fingerprints whose closure is that of all links at distance two or less."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("members")
            sizes = np.diff(column.offsets.to_numpy())
            values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            ends = np.cumsum(sizes)
            start = 0
            while start < len(sizes):  # some buckets at a time: a million members at most, or one bucket
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + (1 << 18), "right")))
                lo, hi = (ends[start - 1] if start else 0), ends[stop - 1]
                which = np.repeat(np.arange(start, stop), sizes[start:stop])
                a, b = bucket_forest(values[lo:hi], which)
                if len(a):
                    yield pa.RecordBatch.from_pydict({"a": a.view(np.int64), "b": b.view(np.int64)})
                start = stop

    return buckets(distinct_fp).mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 3) -> DataFrame:
    """(key, fp, component): every row of ``docs`` with the smallest key of its component."""
    fp = checkpointed(fingerprints(docs, text, key, shingle))
    nodes = checkpointed(fp.groupBy(F.col("fp").alias("node")).agg(F.min(key).alias("weight")))  # null ids don't count
    found = checkpointed(components(nodes, links(nodes.select(F.col("node").alias("fp")))))
    # both sides are plain shuffles, so that a fingerprint with very many copies is split between tasks
    return fp.join(found.select(F.col("node").alias("fp"), F.col("label").alias("component")), "fp", "left").select(key, "fp", "component")


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` (all columns) with one row of each component: that with the smallest key, null keys last.

    Rows are told apart by key and content, so a key that occurs again with another text is judged by that text. Of rows
    with the smallest key in one component, that of the smallest content hash stays; of wholly equal rows, one.
    """
    content = F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns))
    marked = docs.select(F.struct(F.col(key).alias("key"), content.alias("content")).alias("one"), F.col(text).alias("t"))
    found = near_duplicates(marked, "t", "one").withColumn("key", F.col("one.key")).withColumn("content", F.col("one.content"))
    rows = found.groupBy("component", "key", "content").agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col("key").isNull().alias("last"), "key", "content", "n")).alias("w")
    kept = checkpointed(rows.groupBy("component").agg(first).select(F.col("w.key").alias("_key"), F.col("w.content").alias("_content"), F.col("w.n").alias("_n")))
    named = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(key).alias("k"), content.alias("content"))

    def of(winners: DataFrame) -> DataFrame:
        return named.join(winners, F.col("k").eqNullSafe(F.col("_key")) & (F.col("content") == F.col("_content")), "left_semi")

    out = of(kept.where("_n = 1"))
    if not kept.where("_n > 1").isEmpty():  # only where whole rows are repeated
        out = out.unionByName(of(kept.where("_n > 1")).dropDuplicates(["k", "content"]))
    return out.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id")
    )
