"""Language identification of words by a linear-chain conditional random field.

Every word of a text has a language; neighbours are tied by learned transitions, so code-switched text is labelled word by
word. A word's features are its prefixes and suffixes of one to four bytes, its inner n-grams of two to four bytes (all
hashed, each kind for itself), and log-odds of a lexicon. Forward-backward gives each word's posterior; a document's
language is the one with the largest mean posterior over its words, and its runs of words of one language are reported.

Training takes at most ``sample_docs`` labelled documents, one row for each id, in equal shares of the languages as far as
they have so many, and at least one of each language; of a document over ``doc_chars`` code points, a window of that size
(both are documented bounds on what reaches the driver). One half makes the lexicon; of the other half, pieces from
different documents are spliced into sequences, which teaches the transitions. Everything else covers all rows and whole
texts.

Long texts are exact, too: chains are cut into segments whose transfer matrices are multiplied along the document, so
the work is vectorised over segments instead of running word by word; texts are taken in slices bounded by bytes.

Cases: null texts and texts without a letter are ``und`` with score 0 and no runs; words without letters are neutral; equal
means go to the language that sorts first; repeated rows get equal results; without labelled rows all are ``und``; an empty
table gives an empty result; extra columns are not passed on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import gather_runs, held_out, slices, table

BUCKETS = 1 << 16
SEGMENT = 128
NGRAMS = (2, 3, 4)
AFFIXES = (1, 2, 3, 4)


def split_words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Words of lower-cased (A-Z) texts as a dictionary array, and the bounds of each text in it."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    offsets = split.offsets.to_numpy()
    return split.flatten().dictionary_encode(), offsets - offsets[0]


def _hashed(letters: np.ndarray, at: np.ndarray, size: int, kind: int) -> np.ndarray:
    """Buckets of the ``size`` bytes from each place on; ``kind`` parts prefixes, suffixes and inner n-grams."""
    h = np.full(len(at), kind * 16 + size, np.uint64)
    for k in range(size):
        h = (h ^ letters[at + k]) * np.uint64(0x100000001B3)
    return ((h ^ (h >> np.uint64(29))) % np.uint64(BUCKETS)).astype(np.int64)


@dataclass
class Words:
    """Distinct words as bytes, and the buckets of their affixes and n-grams."""

    bucket: np.ndarray  # buckets of all words
    word: np.ndarray  # the word of each
    key: np.ndarray  # a 64-bit hash of each whole word
    lettered: np.ndarray

    @classmethod
    def of(cls, dictionary: pa.Array) -> Words:
        n = len(dictionary)
        _, offsets, data = dictionary.cast(pa.string()).buffers()
        bounds = np.frombuffer(offsets, np.int32)[dictionary.offset : dictionary.offset + n + 1].astype(np.int64)
        sizes = np.diff(bounds)
        letters = np.frombuffer(data or b"", np.uint8)[bounds[0] : bounds[-1]].astype(np.uint64) if n else np.zeros(0, np.uint64)
        first = np.cumsum(sizes) - sizes
        which = np.repeat(np.arange(n), sizes)
        is_letter = ((letters >= 97) & (letters <= 122)) | (letters >= 128)
        lettered = np.bincount(which, is_letter, n) > 0
        place = np.arange(len(letters)) - first[which]
        key, some = np.zeros(n, np.uint64), sizes > 0
        if some.any():
            key[some] = np.add.reduceat((letters + np.uint64(7)) * _power(place), first[some])
        buckets, words = [], []
        for g in AFFIXES:
            long = np.flatnonzero(sizes >= g)
            for kind, at in ((1, first[long]), (2, first[long] + sizes[long] - g)):
                buckets.append(_hashed(letters, at, g, kind))
                words.append(long)
        left = sizes[which] - place  # bytes from here to the word's end
        for g in NGRAMS:
            at = np.flatnonzero(left >= g)
            buckets.append(_hashed(letters, at, g, 0))
            words.append(which[at])
        return cls(np.concatenate(buckets), np.concatenate(words), key, lettered)

    def part(self, chosen: np.ndarray) -> Words:
        """Only the words at sorted places ``chosen``."""
        new = np.full(len(self.key), -1)
        new[chosen] = np.arange(len(chosen))
        of = new[self.word]
        return Words(self.bucket[of >= 0], of[of >= 0], self.key[chosen], self.lettered[chosen])


_POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)


def _power(place: np.ndarray) -> np.ndarray:
    return _POWERS[place % 64] ^ (place // 64).astype(np.uint64)


@dataclass
class Crf:
    languages: list[str]
    grams: np.ndarray  # (BUCKETS, K)
    lexicon_keys: np.ndarray  # sorted word hashes
    lexicon: np.ndarray  # (words, K) log-odds
    lexicon_weight: float
    transition: np.ndarray  # (K, K) logits

    def lexical(self, words: Words) -> np.ndarray:
        out = np.zeros((len(words.key), len(self.languages)), np.float32)
        if len(self.lexicon_keys):
            at = np.minimum(np.searchsorted(self.lexicon_keys, words.key), len(self.lexicon_keys) - 1)
            hit = self.lexicon_keys[at] == words.key
            out[hit] = self.lexicon[at[hit]]
        return out

    def emissions(self, words: Words) -> np.ndarray:
        """exp of each distinct word's scores, the largest scaled to one; ones for words without letters."""
        n, k = len(words.key), len(self.languages)
        per_word = np.bincount(words.word, minlength=n)
        z = np.stack([np.bincount(words.word, self.grams[words.bucket, j], n) for j in range(k)], 1)
        z = z / np.maximum(per_word, 1)[:, None] + self.lexicon_weight * self.lexical(words)
        z[~words.lettered] = 0
        return np.exp(np.clip(z - z.max(axis=1, keepdims=True), -20, 0)).astype(np.float32) if n else np.ones((0, k), np.float32)

    def weights(self) -> np.ndarray:
        t = np.exp(self.transition - self.transition.max())
        return (t / t.sum(axis=1).max()).astype(np.float32)


def posteriors(emission: np.ndarray, token: np.ndarray, bounds: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """(tokens, K): the marginals of every word of every text, by forward-backward along each whole text.

    ``token`` indexes rows of ``emission``; text i has tokens ``bounds[i]:bounds[i + 1]``. The chain starts from a uniform
    state before the first word.
    """
    k = emission.shape[1]
    out = np.zeros((len(token), k), np.float32)
    sizes = np.diff(bounds)
    parts = (sizes + SEGMENT - 1) // SEGMENT
    n_seg = int(parts.sum())
    if not n_seg:
        return out
    owner = np.repeat(np.arange(len(sizes)), parts)
    first = np.cumsum(parts) - parts
    rank = np.arange(n_seg) - first[owner]
    start = bounds[owner] + rank * SEGMENT
    length = np.minimum(SEGMENT, bounds[owner + 1] - start)
    order = np.argsort(-length, kind="stable")  # at step t the first live[t] segments are at work
    start_o = start[order]
    live = np.searchsorted(-length[order], -np.arange(SEGMENT), "left")
    steps = [t for t in range(SEGMENT) if live[t]]
    # transfer matrices of the segments
    m = np.tile(np.eye(k, dtype=np.float32), (n_seg, 1, 1))
    for t in steps:
        e = emission[token[start_o[: live[t]] + t]]
        now = (m[: live[t]].reshape(-1, k) @ weights).reshape(-1, k, k) * e[:, None, :]
        m[: live[t]] = now / now.max(axis=(1, 2), keepdims=True)
    matrix = np.empty_like(m)
    matrix[order] = m
    # states at the segments' borders, along each text
    ahead = np.full((n_seg, k), 1 / k, np.float32)
    behind = np.full((n_seg, k), 1 / k, np.float32)
    by_parts = np.argsort(-parts, kind="stable")
    count = np.searchsorted(-parts[by_parts], -np.arange(1, int(parts.max()) + 1), "right")
    for j in range(1, int(parts.max())):
        seg = first[by_parts[: count[j]]] + j
        now = np.einsum("si,sij->sj", ahead[seg - 1], matrix[seg - 1])
        ahead[seg] = now / now.sum(axis=1, keepdims=True)
    for j in range(int(parts.max()) - 1, 0, -1):
        seg = first[by_parts[: count[j]]] + j
        now = np.einsum("sij,sj->si", matrix[seg], behind[seg])
        behind[seg - 1] = now / now.sum(axis=1, keepdims=True)
    # the words inside the segments
    state = ahead[order]
    for t in steps:
        at = start_o[: live[t]] + t
        now = (state[: live[t]] @ weights) * emission[token[at]]
        state[: live[t]] = out[at] = now / now.sum(axis=1, keepdims=True)
    state = behind[order]
    for t in reversed(steps):
        at = start_o[: live[t]] + t
        beta = state[: live[t]]
        both = out[at] * beta
        out[at] = both / both.sum(axis=1, keepdims=True)
        now = (emission[token[at]] * beta) @ weights.T
        state[: live[t]] = now / now.sum(axis=1, keepdims=True)
    return out


def expectations(emission: np.ndarray, seq: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (b, t, K) of equally long sequences, and the expected number of each transition (first one from the
    uniform state left out)."""
    b, n = seq.shape
    k = emission.shape[1]
    e = emission[seq]
    alpha, beta = np.empty((b, n, k), np.float32), np.ones((b, n, k), np.float32)
    state = np.full((b, k), 1 / k, np.float32)
    for t in range(n):
        state = (state @ weights) * e[:, t]
        state /= state.sum(axis=1, keepdims=True)
        alpha[:, t] = state
    for t in range(n - 1, 0, -1):
        now = (e[:, t] * beta[:, t]) @ weights.T
        beta[:, t - 1] = now / now.sum(axis=1, keepdims=True)
    gamma = alpha * beta
    gamma /= gamma.sum(axis=2, keepdims=True)
    pair = alpha[:, :-1, :, None] * weights * (e[:, 1:] * beta[:, 1:])[:, :, None, :]
    pair /= pair.sum(axis=(2, 3), keepdims=True)
    return gamma, pair.sum(axis=(0, 1))


def _spliced(token: np.ndarray, label: np.ndarray, bounds: np.ndarray, rng: np.random.Generator, length: int, count: int):
    """Sequences of pieces from random texts: (count, length) tokens and labels."""
    tokens, labels = np.zeros((count, length), np.int64), np.zeros((count, length), np.int64)
    usable = np.flatnonzero(np.diff(bounds) > 0)
    for i in range(count):
        at = 0
        while at < length:
            doc = int(rng.choice(usable))
            size = min(length - at, int(rng.integers(5, 120)), int(bounds[doc + 1] - bounds[doc]))
            begin = int(rng.integers(bounds[doc], bounds[doc + 1] - size + 1))
            tokens[i, at : at + size] = token[begin : begin + size]
            labels[i, at : at + size] = label[doc]
            at += size
    return tokens, labels


def train(texts: list[str | None], langs: list[str], epochs: int = 12, sequences: int = 1200, length: int = 200, seed: int = 7) -> Crf | None:
    languages = sorted(set(langs))
    if not languages:
        return None
    k = len(languages)
    label = np.array([languages.index(x) for x in langs])
    found, bounds = split_words(pa.array(texts, pa.string()))
    words, token = Words.of(found.dictionary), found.indices.to_numpy().astype(np.int64)
    sizes = np.diff(bounds)
    of_doc = np.repeat(np.arange(len(sizes)), sizes)
    # even texts: the lexicon
    even = of_doc % 2 == 0
    counts = np.zeros((len(words.key), k))
    np.add.at(counts, (token[even], label[of_doc[even]]), 1)
    rates = (counts + 0.05) / (counts.sum(axis=0) + 1)
    odds = np.log(rates) - np.log(rates).mean(axis=1, keepdims=True)
    often = np.flatnonzero((counts.sum(axis=1) >= 3) & words.lettered)
    often = often[np.argsort(words.key[often], kind="stable")]
    crf = Crf(
        languages, np.zeros((BUCKETS, k)), words.key[often], np.clip(odds[often], -4, 4).astype(np.float32), 0.5, np.log(np.eye(k) * 0.9 + 0.1 / k)
    )
    # odd texts (all, if there are few): sequences
    odd = np.flatnonzero((np.arange(len(sizes)) % 2 == 1) | (len(sizes) < 20))
    if not (sizes[odd] > 0).any():
        return crf
    odd_bounds = np.r_[0, np.cumsum(sizes[odd])]
    odd_token = token[gather_runs(bounds[:-1][odd], sizes[odd])]
    rng = np.random.default_rng(seed)
    seq, gold = _spliced(odd_token, label[odd], odd_bounds, rng, length, sequences)
    used = np.unique(seq)
    words, seq = words.part(used), np.searchsorted(used, seq)  # the words that training meets
    lexical, per_word = crf.lexical(words), np.maximum(np.bincount(words.word, minlength=len(words.key)), 1)
    square = np.full((BUCKETS, k), 1e-8)
    batch = max(1, sequences // 8)
    for _ in range(epochs):
        for begin in range(0, sequences, batch):
            some, want = seq[begin : begin + batch], gold[begin : begin + batch]
            flat, b = some.ravel(), len(some)
            gamma, expected = expectations(crf.emissions(words), some, crf.weights())
            miss = -gamma.reshape(-1, k).astype(float)
            miss[np.arange(len(flat)), want.ravel()] += 1
            by_word = np.stack([np.bincount(flat, miss[:, j], len(words.key)) for j in range(k)], 1)
            by_word[~words.lettered] = 0
            crf.lexicon_weight = float(np.clip(crf.lexicon_weight + 2.0 * (by_word * lexical).sum() / len(flat), 0, 3))
            by_word /= per_word[:, None]
            grad = np.stack([np.bincount(words.bucket, by_word[words.word, j], BUCKETS) for j in range(k)], 1)
            square += grad * grad
            crf.grams += 2.0 * grad / np.sqrt(square) - 1e-4 * crf.grams
            actual = np.zeros((k, k))
            np.add.at(actual, (want[:, :-1].ravel(), want[:, 1:].ravel()), 1)
            crf.transition += 1.0 * (actual - expected) / (b * length)
            crf.transition = np.clip(crf.transition, -8, 8)
    return crf


def _quotas(counts: dict[str, int], total: int) -> dict[str, int]:
    """Equal shares of ``total``; what a rare language leaves goes to the others; one for each language at least."""
    out, left = {}, max(total, len(counts))
    for i, lang in enumerate(sorted(counts, key=lambda x: (counts[x], x))):
        out[lang] = min(counts[lang], left // (len(counts) - i))
        left -= out[lang]
    return out


def fit(
    docs: DataFrame, sample_docs: int = 2000, doc_chars: int = 8000, text: str = "text", lang: str = "lang", key: str = "doc_id"
) -> Crf | None:
    """A model from at most ``sample_docs`` labelled documents outside the held-out fold, chosen for each language by hashed id.

    Of a longer one, ``doc_chars`` code points from a hashed place on are learned from. Only a table of more languages
    than ``sample_docs`` gives more: one document of each.
    """
    spark, top = docs.sparkSession, 1 << 31
    known = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("lang"))
    known = known.where(F.col("lang").isNotNull() & F.col("t").isNotNull() & F.col("k").isNotNull() & ~held_out(F.col("k")))
    ids = known.select("k", "lang").distinct()
    counts = {r["lang"]: r["n"] for r in ids.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    if not counts:
        return None
    quotas = _quotas(counts, sample_docs)
    # draws are uniform: below ``bound`` are about twice as many ids as wanted, so only few are ranked
    limits = [(x, q, min(top, (2 * q + 100) * top // counts[x] + 1)) for x, q in quotas.items()]
    limits = F.broadcast(spark.createDataFrame(limits, "lang string, quota long, bound long"))
    drawn = ids.withColumn("draw", F.pmod(F.xxhash64(F.col("k").cast("string")), F.lit(top))).join(limits, "lang").where("draw < bound")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "k"))
    chosen = F.broadcast(drawn.withColumn("place", place).where("place <= quota").select("k", "lang", "place"))
    rows = known.join(chosen, ["k", "lang"]).groupBy("lang", "place")
    rows = rows.agg(F.min(F.struct(F.xxhash64("t").alias("h"), "t")).alias("one"))  # one row of a repeated id
    spare, t = F.length("one.t") - doc_chars, F.col("one.t")
    window = F.when(spare > 0, F.substring(t, (F.pmod(F.col("one.h"), spare) + 1).cast("int"), F.lit(doc_chars))).otherwise(t)
    rows = sorted(rows.select("lang", "place", window.alias("t")).collect(), key=lambda r: (r["lang"], r["place"]))
    return train([r["t"] for r in rows], [r["lang"] for r in rows])


def _runs(top: np.ndarray, bounds: np.ndarray, languages: list[str]) -> list[str]:
    """For each text, its runs of equal labels as language:from:to."""
    fresh = np.zeros(len(top), bool)
    fresh[bounds[:-1][np.diff(bounds) > 0]] = True
    fresh[1:] |= top[1:] != top[:-1]
    starts = np.flatnonzero(fresh)
    ends, first = np.r_[starts[1:], len(top)], np.searchsorted(starts, bounds)
    out = []
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        at, labels = bounds[i], top[starts[a:b]].tolist()
        out.append(",".join(f"{languages[k]}:{s}:{e}" for k, s, e in zip(labels, (starts[a:b] - at).tolist(), (ends[a:b] - at).tolist(), strict=True)))
    return out


def identify(docs: DataFrame, crf: Crf | None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, lang_pred, score, n_switches, runs) of every row.

    ``runs`` labels the words: language:from:to for each run of neighbours of one language (word places, end exclusive),
    comma-joined; n_switches is one less than their number. White space at the ends makes empty words that belong to runs.
    """
    shared = docs.sparkSession.sparkContext.broadcast(crf)  # a fixed number of weights and a bounded lexicon
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = shared.value
        for batch in batches:
            for part in slices(batch, text, 1024, 1 << 20):
                texts = pc.fill_null(part.column(text), "")
                und = ~pc.match_substring_regex(texts, r"\pL").to_numpy(zero_copy_only=False)
                pred, score, runs = ["und"] * part.num_rows, np.zeros(part.num_rows), [""] * part.num_rows
                if crf:
                    found, bounds = split_words(texts)
                    words, token = Words.of(found.dictionary), found.indices.to_numpy()
                    gamma = posteriors(crf.emissions(words), token, bounds, crf.weights())
                    lettered = words.lettered[token]
                    sums = np.concatenate([np.zeros((1, gamma.shape[1])), np.cumsum(np.where(lettered[:, None], gamma, 0), axis=0, dtype=float)])
                    n = np.r_[0, np.cumsum(lettered)]
                    mean = (sums[bounds[1:]] - sums[bounds[:-1]]) / np.maximum(n[bounds[1:]] - n[bounds[:-1]], 1)[:, None]
                    best = mean.argmax(axis=1)
                    pred = ["und" if u else crf.languages[b] for u, b in zip(und.tolist(), best.tolist(), strict=True)]
                    score = np.where(und, 0.0, np.clip(mean[np.arange(len(best)), best], 0, 1))
                    runs = ["" if u else x for u, x in zip(und.tolist(), _runs(gamma.argmax(axis=1), bounds, crf.languages), strict=True)]
                switches = [max(0, x.count(",")) for x in runs]
                columns = [part.column(key), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(switches, pa.int64()), pa.array(runs, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "lang_pred", "score", "n_switches", "runs"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {key_type}, lang_pred string, score double, n_switches long, runs string")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "runs")
