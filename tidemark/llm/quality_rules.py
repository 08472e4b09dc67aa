"""Quality rules as a short-circuit cascade.

A rule is a named predicate on a document that is true when the document fails. ``plan_cascade`` measures on a bounded
sample, on the executors, what each rule costs a document that reaches the cascade: after the base verdict let it pass,
with the base measures already made. Which rules fail together is counted, too, so the order is built rule by rule: the
next one has the most rejections per second among the documents that the rules before it leave. ``apply_cascade``
evaluates them in that order and stops at the first that fails; the verdict of a document does not depend on the order,
only the work does.

Cases: a null text counts as empty (no words; every measure zero); lines are split at ``\\n`` only; repeated rows are
judged row by row; an empty table gives an empty result; extra input columns are not passed on, so they can't clash.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, utf8_slices

SYMBOLS = b"#*$%&|<>"
BULLETS = ("-".encode(), b"*", "\u2022".encode())
_NO_LETTER = bytes(i for i in range(128) if not chr(i).isalpha())


class Doc:
    """A text with the measures that rules share, each computed when first asked for."""

    def __init__(self, text: bytes):
        self.text = text

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.split()  # on bytes: exactly the ASCII white space

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.text.split(b"\n") if x.strip()]

    @cached_property
    def word_chars(self) -> int:
        blank = len(self.text) - sum(map(len, self.words))
        return len(self.text.decode("utf-8", "replace")) - blank

    @cached_property
    def n_symbols(self) -> int:
        return len(self.text) - len(self.text.translate(None, SYMBOLS))

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def word_ids(self) -> np.ndarray:
        ids = dict.fromkeys(self.words)
        for i, w in enumerate(ids):
            ids[w] = i
        return np.fromiter(map(ids.__getitem__, self.words), np.int64, len(self.words))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside three-word windows that occur twice or more."""
        ids = self.word_ids
        if len(ids) < 4:
            return 0
        base = int(ids.max()) + 1
        pair = ids[:-1] * base + ids[1:]
        if base >= 1 << 21:
            pair = np.unique(pair, return_inverse=True)[1]
        window = pair[:-1] * base + ids[2:]
        order = np.argsort(window, kind="stable")
        same = window[order[1:]] == window[order[:-1]]
        if not same.any():
            return 0
        again = np.zeros(len(window), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        inside = np.zeros(len(ids), bool)
        for k in range(3):
            inside[k : k + len(window)] |= again
        return int(inside.sum())

    @cached_property
    def top_word(self) -> int:
        return int(np.bincount(self.word_ids).max()) if self.words else 0

    @cached_property
    def byte_counts(self) -> np.ndarray:
        return np.bincount(np.frombuffer(self.text, np.uint8), minlength=256)

    @cached_property
    def n_exclaimed(self) -> int:
        return sum(w.endswith(b"!") for w in self.words)

    @cached_property
    def n_letterless(self) -> int:
        """Words without a letter; all characters beyond ASCII count as letters."""
        return sum(not w.translate(None, _NO_LETTER) for w in self.words)

    @cached_property
    def n_bullets(self) -> int:
        return sum(x.lstrip().startswith(BULLETS) for x in self.lines)

    @cached_property
    def n_ellipses(self) -> int:
        return sum(x.rstrip().endswith((b"...", "\u2026".encode())) for x in self.lines)

    @property
    def base_failed(self) -> bool:
        n = len(self.words)
        return n < 50 or 100 * self.n_repeat_words > 50 * n

    def base(self) -> tuple:
        """The measures that every document is reported with, and the base verdict."""
        return len(self.words), self.word_chars, self.n_symbols, self.n_dup_lines, self.n_repeat_words, self.base_failed


@dataclass(frozen=True)
class Rule:
    name: str
    fails: Callable[[Doc], bool]


#: All limits are far from ordinary prose: a rule rejects only what is plainly boilerplate, a table or noise.
RULES: tuple[Rule, ...] = (
    Rule("symbols", lambda d: 4 * d.n_symbols > len(d.words)),
    Rule("exclamations", lambda d: 10 * d.n_exclaimed > 3 * len(d.words)),
    Rule("no_letters", lambda d: 10 * d.n_letterless > 4 * len(d.words)),
    Rule("bullets", lambda d: 10 * d.n_bullets > 9 * len(d.lines)),
    Rule("ellipses", lambda d: 10 * d.n_ellipses > 3 * len(d.lines)),
    Rule("duplicate_lines", lambda d: 2 * d.n_dup_lines > len(d.lines)),
    Rule("one_word", lambda d: 10 * d.top_word > 3 * len(d.words)),
    Rule("word_length", lambda d: d.word_chars < 2 * len(d.words) or d.word_chars > 15 * len(d.words)),
)


def plan_cascade(
    docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", key: str = "doc_id", sample_rows: int = 2000
) -> list[tuple[str, float, float]]:
    """(rule, seconds a document, share of what reaches it that it rejects), in the order of the cascade.

    The sample holds about ``sample_rows`` rows, whatever the table's size: rows whose hashed key and text fall below a
    share. What comes back from it is a row for each set of rules that fail together, at most one a sampled row.
    """
    total = docs.count()
    keep = min(1.0, sample_rows / max(total, 1))
    sample = docs.where(F.pmod(F.xxhash64(F.col(key).cast("string"), F.col(text)), F.lit(1 << 20)) < int(keep * (1 << 20)) + 1)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in utf8_slices(batch, text):
                masks, spent = [], []
                for t in texts:
                    doc = Doc(t)
                    if doc.base()[-1]:
                        continue  # never reaches the cascade
                    mask, seconds = 0, []
                    for i, rule in enumerate(rules):
                        began = time.perf_counter()
                        mask |= bool(rule.fails(doc)) << i
                        seconds.append(time.perf_counter() - began)
                    masks.append(mask), spent.append(seconds)
                yield pa.RecordBatch.from_arrays([pa.array(masks, pa.int64()), pa.array(spent, pa.list_(pa.float64()))], names=["mask", "s"])

    found = sample.select(text).mapInArrow(measure, "mask long, s array<double>")
    seconds = [F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(len(rules))]
    rows = found.groupBy("mask").agg(F.count("*").alias("n"), *seconds).collect()
    reached = max(1, sum(r["n"] for r in rows))
    cost = [sum(r[f"s{i}"] for r in rows) / reached for i in range(len(rules))]
    alone = [sum(r["n"] for r in rows if r["mask"] >> i & 1) / reached for i in range(len(rules))]  # decides between equals
    alive, left, plan = {r["mask"]: r["n"] for r in rows}, set(range(len(rules))), []
    while left:
        here = max(1, sum(alive.values()))
        share = {i: sum(n for m, n in alive.items() if m >> i & 1) / here for i in left}
        pick = min(left, key=lambda i: (-share[i] / max(cost[i], 1e-9), -alone[i] / max(cost[i], 1e-9), rules[i].name))
        plan.append((rules[pick].name, cost[pick], share[pick]))
        left.discard(pick)
        alive = {m: n for m, n in alive.items() if not m >> pick & 1}
    return plan


def apply_cascade(
    docs: DataFrame, order: Sequence[str], rules: Sequence[Rule] = RULES, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """One row a document: key, measures, base verdict, ``failed_rule`` (the first in ``order`` that fails) and ``kept``.

    Measures and base verdict are reported for every document. The cascade runs only where the base verdict lets the
    document pass, and stops at its first failing rule.
    """
    by_name = {r.name: r for r in rules}
    chain = [by_name[name] for name in order]
    key_type = docs.schema[key].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "failed_rule", "kept")
        kinds = (*[pa.int64()] * 5, pa.bool_(), pa.string(), pa.bool_())
        for batch in batches:
            for part, texts in utf8_slices(batch, text):
                rows = []
                for t in texts:
                    d = Doc(t)
                    measured = d.base()
                    rule = None if d.base_failed else next((r.name for r in chain if r.fails(d)), None)
                    rows.append((*measured, rule, not d.base_failed and rule is None))
                yield pa.RecordBatch.from_arrays(
                    [part.column(key), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=[key, *names]
                )

    schema = (
        f"`{key}` {key_type}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, failed_rule string, kept boolean"
    )
    return docs.select(key, text).mapInArrow(judge, schema)


def quality_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", key: str = "doc_id") -> DataFrame:
    return apply_cascade(docs, [x[0] for x in plan_cascade(docs, rules, text, key)], rules, text, key)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop("failed_rule")


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), m AS (
  SELECT doc_id, w, len(w)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS ln,
         len([x FOR x IN w IF ends_with(x, '!')])::BIGINT AS n_exclaimed,
         len([x FOR x IN w IF NOT regexp_matches(x, '[A-Za-z\x{80}-\x{10FFFF}]')])::BIGINT AS n_letterless
  FROM d
), p AS (
  SELECT doc_id, unnest(range(1, greatest(n_words - 1, 1))) AS i, w FROM m WHERE n_words >= 3
), g AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM p
), r AS (
  SELECT doc_id, count(DISTINCT j)::BIGINT AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM g WHERE c > 1) GROUP BY doc_id
), v AS (
  SELECT doc_id, max(c)::BIGINT AS top_word FROM (
    SELECT doc_id, x, count(*) AS c FROM (SELECT doc_id, unnest(w) AS x FROM m) GROUP BY doc_id, x) GROUP BY doc_id
), f AS (
  SELECT m.doc_id, n_words, word_chars, n_symbols, (len(ln) - len(list_distinct(ln)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, len(ln) AS n_lines, coalesce(top_word, 0) AS top_word, n_exclaimed, n_letterless,
         len([x FOR x IN ln IF regexp_matches(x, '^[\x20\x09-\x0D]*[-*\x{2022}]')]) AS n_bullets,
         len([x FOR x IN ln IF regexp_matches(x, '(?:\.\.\.|\x{2026})[\x20\x09-\x0D]*$')]) AS n_ellipses
  FROM m LEFT JOIN r USING (doc_id) LEFT JOIN v USING (doc_id)
), b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 4 * n_symbols > n_words OR 10 * n_exclaimed > 3 * n_words OR 10 * n_letterless > 4 * n_words
            OR 10 * n_bullets > 9 * n_lines OR 10 * n_ellipses > 3 * n_lines OR 2 * n_dup_lines > n_lines
            OR 10 * top_word > 3 * n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words) AS kept
FROM b
"""
