"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled text are all that is learned from: rows labelled 0 count as unlabelled. A linear model over
text measures and hashed words minimises the non-negative unbiased risk

    prior * R+(P) + max(0, R-(U) - prior * R-(P))

(logistic loss; while the second term is negative, its gradient is stepped against as well). Steps shrink to zero, and the model is
the mean of the iterates of the last half, so no iterate is singled out. The class prior is estimated first:
a model tells P from U on one half of the sample; on the other half, the share of U above a threshold over that of P
bounds the prior, and the smallest bound, with its sampling error, is taken; several halvings are averaged.

The fit uses at most ``positives`` and ``unlabelled`` ids (bounds, by hashed id; parameters of ``fit``), one row for each
however often it is repeated, and of either kind as many as have ``words`` distinct words in all (hashed, 32 KB a row at most). Texts become feature rows
on the executors, and one task fits the model to these bounded rows; only its weights reach the driver. A (row, word) costs two bytes,
halves of the sample two more, and steps are made in blocks of rows. Every document is scored.

Cases: a null text is empty and is scored like any other (its measures are zero); labels of absent documents, null
labels and repeated label rows are harmless; without positives or unlabelled rows every score is 0.5; an empty
table gives an empty result; extra columns are not passed on.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, held_out, table, utf8_slices, written
from .quality_rules import Doc

BUCKETS = 1 << 14
THRESHOLD = 0.3
#: ASCII punctuation; each character's share has a measure of its own.
PUNCTUATION = bytes(i for i in range(33, 127) if not chr(i).isalnum())
MEASURES = (
    "bias", "log_words", "word_length", "repeats", "top_word", "duplicate_lines", "upper", "digits", "distinct", "letterless", "exclaimed",
    *(f"share_{chr(c)}" for c in PUNCTUATION),
)
_MARKS = np.frombuffer(PUNCTUATION, np.uint8)


def measures(doc: Doc) -> np.ndarray:
    n, size, counts = max(1, len(doc.words)), max(1, len(doc.text)), doc.byte_counts
    distinct = int(doc.word_ids.max()) + 1 if doc.words else 0
    head = [
        1.0,
        np.log1p(len(doc.words)) / 5,
        doc.word_chars / n / 10,
        2 * doc.n_repeat_words / n,
        4 * doc.top_word / n if n >= 20 else 0.0,
        2 * doc.n_dup_lines / max(1, len(doc.lines)),
        4 * counts[65:91].sum() / size,
        4 * counts[48:58].sum() / size,
        distinct / n,
        2 * doc.n_letterless / n,
        2 * doc.n_exclaimed / n,
    ]
    return np.r_[head, 4 * np.minimum(1.0, counts[_MARKS] / n)]


def hashed_words(doc: Doc) -> np.ndarray:
    return np.array(sorted({zlib.crc32(w.lower()) % BUCKETS for w in set(doc.words)}), "<u2")


#: (row, word) entries of a sample that a step works on at a time.
ENTRIES = 1 << 18


class Sample:
    """Feature rows: dense measures, and hashed words as buckets of all rows one after the other (two bytes each)."""

    def __init__(self, dense: np.ndarray, words: list[np.ndarray]):
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        self._hold(dense, np.concatenate([*words, np.zeros(0, "<u2")]).astype("<u2", copy=False), sizes)

    def _hold(self, dense: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.dense, self.flat, self.sizes = dense, flat, sizes
        self.bounds = np.r_[0, np.cumsum(sizes)]
        self.value = 1 / np.sqrt(np.maximum(sizes, 1))

    def __len__(self) -> int:
        return len(self.sizes)

    def part(self, rows: np.ndarray) -> Sample:
        out = Sample.__new__(Sample)
        out._hold(self.dense[rows], np.concatenate([self.flat[self.bounds[i] : self.bounds[i + 1]] for i in rows.tolist()] or [self.flat[:0]]), self.sizes[rows])
        return out

    def _blocks(self) -> Iterator[tuple[int, int]]:
        """Ranges of rows with ``ENTRIES`` entries at most, or of one row."""
        at = 0
        while at < len(self):
            end = max(at + 1, int(np.searchsorted(self.bounds, self.bounds[at] + ENTRIES, "right")) - 1)
            yield at, end
            at = end

    def logits(self, model: Model) -> np.ndarray:
        out = self.dense @ model.dense
        for a, b in self._blocks():
            row = np.repeat(np.arange(b - a), self.sizes[a:b])
            out[a:b] += self.value[a:b] * np.bincount(row, model.words[self.flat[self.bounds[a] : self.bounds[b]]], b - a)
        return out

    def gradient(self, by_row: np.ndarray) -> np.ndarray:
        lexical, scaled = np.zeros(BUCKETS), self.value * by_row
        for a, b in self._blocks():
            lexical += np.bincount(self.flat[self.bounds[a] : self.bounds[b]], np.repeat(scaled[a:b], self.sizes[a:b]), BUCKETS)
        return np.r_[self.dense.T @ by_row, lexical]


@dataclass
class Model:
    dense: np.ndarray
    words: np.ndarray
    prior: float

    def score(self, doc: Doc) -> float:
        at = hashed_words(doc)
        z = float(np.dot(measures(doc), self.dense)) + (float(self.words[at].sum()) / np.sqrt(len(at)) if len(at) else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _descend(p: Sample, u: Sample, slope, steps: int, rate: float, decay: float) -> Model:
    """Adam on all rows with steps that shrink to zero; ``slope(zp, zu)`` gives the risk's derivative by each logit. The
    model is the mean of the last half of the iterates."""
    w, total, size = np.zeros(len(MEASURES) + BUCKETS), 0.0, len(MEASURES)
    model = Model(w[:size], w[size:], 0.5)
    m = v = np.zeros(len(w))
    for k in range(1, steps + 1):
        dp, du = slope(p.logits(model), u.logits(model))
        g = p.gradient(dp) + u.gradient(du)
        g[size:] += decay * model.words
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - rate * (1 - (k - 1) / steps) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        model = Model(w[:size], w[size:], 0.5)
        if 2 * k > steps:
            total = total + w
    mean = total / max(1, steps - steps // 2)
    return Model(mean[:size], mean[size:], 0.5)


def estimate_prior(p: Sample, u: Sample, steps: int = 60, splits: int = 5) -> float:
    """The share of positives in U, averaged over random halvings: a model learns to tell P from U on one half; on the
    other, the smallest ratio of the tail masses of U and P, over tails that hold at least 30 % of P, bounds the share."""
    if min(len(p), len(u)) < 2:
        return 0.5
    found, shares = [], np.linspace(0.3, 1, 29)
    for seed in range(splits):
        rng = np.random.default_rng(seed)
        at_p, at_u = rng.permutation(len(p)), rng.permutation(len(u))
        pa_, ua, pb, ub = p.part(at_p[::2]), u.part(at_u[::2]), p.part(at_p[1::2]), u.part(at_u[1::2])
        slope = lambda zp, zu: ((_sigmoid(zp) - 1) / len(zp), _sigmoid(zu) / len(zu))
        model = _descend(pa_, ua, slope, steps, 0.1, 1e-3)
        zp, zu = np.sort(pb.logits(model)), np.sort(ub.logits(model))
        cuts = zp[np.minimum(len(zp) - 1, ((1 - shares) * len(zp)).astype(int))]
        tail = lambda z: 1 - np.searchsorted(z, cuts, "left") / len(z)  # noqa: E731, B023
        slack = sum(0.25 / np.sqrt(len(z)) + 2 / len(z) for z in (zp, zu))  # a few rows prove little
        found.append(((tail(zu) + slack) / tail(zp)).min())
    return float(np.clip(np.mean(found), 0.05, 0.98))


def risk(zp: np.ndarray, zu: np.ndarray, prior: float) -> float:
    """The non-negative unbiased risk of logits on P and U."""
    negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    return prior * np.logaddexp(0, -zp).mean() + max(0.0, negative)


def risk_slope(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """The direction by each logit: the risk's derivative, and while the negative part is below zero, against that part's own,
    so that P is never pushed down where U no longer speaks."""
    negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    if negative >= 0:
        return np.full(len(zp), -prior / len(zp)), _sigmoid(zu) / len(zu)  # the logistic losses of P differ by its logit
    return prior * (2 * _sigmoid(zp) - 1) / len(zp), -_sigmoid(zu) / len(zu)


def fit_nnpu(p: Sample, u: Sample, prior: float, steps: int = 200) -> Model:
    slope = lambda zp, zu: risk_slope(zp, zu, prior)
    model = _descend(p, u, slope, steps, 0.3, 1e-2)
    model.prior = prior
    return model


def _features(rows: DataFrame, text: str) -> DataFrame:
    """(place, positive, n, dense, words): n distinct hashed words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in utf8_slices(batch, text):
                found = [Doc(t) for t in texts]
                words = [hashed_words(d) for d in found]
                columns = [part.column("place"), part.column("positive"), pa.array(map(len, words), pa.int64()), pa.array([measures(d) for d in found], pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([w.tobytes() for w in words], pa.binary())], names=["place", "positive", "n", "dense", "words"])

    schema = f"place {rows.schema['place'].dataType.simpleString()}, positive boolean, n long, dense array<double>, words binary"
    return rows.select("place", "positive", text).mapInArrow(run, schema)


def _train(rows: DataFrame) -> Model | None:
    """The model that one task fits to bounded feature rows; None without rows of either kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense: dict[bool, list] = {True: [], False: []}
        words: dict[bool, list] = {True: [], False: []}
        for batch in batches:
            for positive, d, w in zip(batch.column("positive").to_pylist(), batch.column("dense").to_pylist(), batch.column("words").to_pylist(), strict=True):
                dense[positive].append(d)
                words[positive].append(np.frombuffer(w, "<u2"))
        if dense[True] and dense[False]:
            p, u = (Sample(np.array(dense[k]), words.pop(k)) for k in (True, False))
            model = fit_nnpu(p, u, estimate_prior(p, u))
            yield pa.RecordBatch.from_pydict({"dense": [model.dense.tolist()], "words": [model.words.tolist()], "prior": [model.prior]})

    # in one order, so that the halves of the prior's estimate don't hang on the shuffle
    ordered = rows.select("place", "positive", "dense", "words").repartition(1).sortWithinPartitions("place", "positive")
    found = ordered.mapInArrow(run, "dense array<double>, words array<double>, prior double").first()
    return Model(np.array(found["dense"]), np.array(found["words"]), found["prior"]) if found else None


def fit(
    docs: DataFrame, labels: DataFrame, positives: int = 4000, unlabelled: int = 6000, words: int = 4_000_000, text: str = "text", key: str = "doc_id"
) -> Model | None:
    """A model from at most ``positives`` trusted and ``unlabelled`` other ids, none of the held-out fold, a row for each, and of
    both as many (one at least) as have ``words`` distinct words in all."""
    order = F.xxhash64(F.col(key).cast("string"))
    trusted = labels.where((F.col("quality") == 1) & ~held_out(F.col(key))).select(key).distinct()
    some_p = trusted.orderBy(order, key).limit(positives).withColumn("positive", F.lit(True))
    others = docs.where(F.col(key).isNotNull() & ~held_out(F.col(key))).select(key).distinct().join(trusted, key, "left_anti")
    some_u = others.orderBy(order, key).limit(unlabelled).withColumn("positive", F.lit(False))
    chosen = F.broadcast(some_p.unionByName(some_u))  # at most positives + unlabelled ids
    rows = docs.select(key, text).join(chosen, key).groupBy(key, "positive")
    rows = rows.agg(F.min(F.struct(F.xxhash64(text).alias("h"), F.col(text).alias("t"))).alias("one"))  # of repeated ids, too
    rows = written(_features(rows.select(F.col(key).alias("place"), "positive", F.col("one.t").alias(text)), text))
    inside = Window.partitionBy("positive").orderBy(F.xxhash64(F.col("place").cast("string")), "place").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(inside), F.lit(0))  # over positives + unlabelled rows at most
    kept = rows.select("place", "positive", (before + F.col("n")).alias("upto"), before.alias("before")).where((F.col("upto") <= words) | (F.col("before") == 0))
    model = _train(rows.join(kept, ["place", "positive"], "left_semi"))
    discard(rows)
    return model


def score(docs: DataFrame, model: Model | None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part, texts in utf8_slices(batch, text):
                scores = [model.score(Doc(t)) if model else 0.5 for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(scores, pa.float64())], names=[key, "score"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {key_type}, score double")


def keep_good(docs: DataFrame, model: Model | None, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` (all columns) without the rows scored below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part, texts in utf8_slices(batch, text):
                yield part.filter(pa.array([not model or model.score(Doc(t)) >= threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op5_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
