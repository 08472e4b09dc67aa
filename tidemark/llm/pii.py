"""Personal data by bootstrapped contextual extraction.

Base patterns find e-mail addresses, IPv4 addresses, card numbers and phone numbers. They seed a graph of contexts (the two
words on the left; a word with a digit or @ counts as ``#``, the start of the text as ``^``) and instances: contexts that
precede many different seeds of one kind, and little else, become patterns; identifier-like candidates that such patterns
precede take their score (noisy-or), confident ones count as seeds in the next round, until a round finds none; what
confident patterns precede is reported besides the base spans. A candidate is a token with a digit or @, or a run of
numeric tokens between single spaces, without outer punctuation; seeds are the base spans as they stand, spaces included.

Only built-in functions are used. Texts are read once; the rounds work on (context, instance) pairs, which are
aggregated before each shuffle, and every document's mentions are matched to the patterns by a plain equi-join. Context
words and instances over ``LONG`` code points are keyed by their hash, so no key is long and none is cut off.

Cases: a null text is empty and has no spans; texts of any length and any number of spans take n log n steps at most; rows
are told apart by a row number, so null and repeated ids keep their own spans; repeated rows get equal results; equal
contexts and scores need no order (all that pass the limits count); an empty table gives an empty result; extra columns
are not passed on. Spans of different kinds may overlap; a discovered one never overlaps a base span.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, table, written
from .secrets import positions_sql
from .spans import count_kind, matches, outside, rendered

KINDS = ("email", "ip", "card", "phone")

#: Each starts where its run starts or where the match before ended, and never gives back what it took.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?+[0-9]){13,}+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
_SPACE = r"\x09-\x0D\x20"
_NUMERIC = r"[(+]*+[0-9][0-9()+./-]*+"
MENTION = rf"(?<![^{_SPACE}])(?:{_NUMERIC}(?: {_NUMERIC})*+[^{_SPACE}]*+|[^{_SPACE}0-9@]*+[0-9@][^{_SPACE}]*+)"
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Code points beyond which a key of the graph is the hash of its text.
LONG = 64


@dataclass(frozen=True)
class Limits:
    """What makes a pattern or an instance confident."""

    support: int = 4
    pattern: float = 0.8
    instance: float = 0.8


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digit string passes Luhn's check."""
    places = F.sequence(F.lit(1), F.length(digits))

    def add(total: Column, i: Column) -> Column:
        d = F.ascii(F.substring(digits, F.length(digits) - i + 1, F.lit(1))) - 48
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(places, F.lit(0), add) % 10 == 0


def _short(x: Column) -> Column:
    return F.when(F.length(x) > LONG, F.sha2(x, 256)).otherwise(x)


def _context(left: Column, place: Column) -> Column:
    """The two words before a match, from what lies between it and the match before; empty if the text starts there."""
    whole = F.concat(F.when(place == 0, "^ ").otherwise("# "), left)
    last = F.reverse(F.regexp_extract(F.reverse(whole), rf"^[{_SPACE}]*+([^{_SPACE}]++[{_SPACE}]++[^{_SPACE}]++)", 1))
    plain = lambda w: F.when(w.rlike("[0-9@]"), "#").otherwise(_short(F.translate(w, _UPPER, _LOWER)))
    return F.array_join(F.transform(F.split(last, f"[{_SPACE}]+"), plain), " ")


def _seeds(text: Column) -> Column:
    """array<struct<s, rank, e, kind, m, ctx>>: all base spans, in order, with their contexts."""
    octets, digits = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$", lambda x: F.length(_digits(x["m"]))
    found = (
        (matches(text, EMAIL, F.contains(text, F.lit("@"))), lambda x: F.lit(True)),
        (matches(text, IP), lambda x: x["m"].rlike(octets)),
        (matches(text, CARD), lambda x: digits(x).between(14, 19) & _luhn(_digits(x["m"]))),
        (matches(text, PHONE, F.contains(text, F.lit("+"))), lambda x: digits(x).between(10, 15)),
    )

    def of(kind: str, rank: int, spans: Column, good) -> Column:
        def row(n: Column) -> Column:
            x = n["x"]
            ctx = _context(x["left"], n["i"]).alias("ctx")
            return F.struct(x["s"].alias("s"), F.lit(rank).alias("rank"), x["e"].alias("e"), F.lit(kind).alias("kind"), x["m"].alias("m"), ctx)

        numbered = F.transform(spans, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
        return F.transform(F.filter(numbered, lambda n: good(n["x"])), row)

    parts = [of(kind, rank, *way) for rank, (kind, way) in enumerate(zip(KINDS, found, strict=True))]
    return F.array_sort(F.concat(*parts))


def base_spans(found: Column) -> Column:
    """array<struct<s, rank, e, kind, m>> of ``_seeds``."""
    return F.transform(found, lambda x: F.struct(*(x[c].alias(c) for c in ("s", "rank", "e", "kind", "m"))))


def _mentions(text: Column) -> Column:
    """array<struct<s, e, inst, ctx>>: candidates in order, those that overlap base spans among them."""

    def row(x: Column, i: Column) -> Column:
        head = F.length(F.regexp_extract(x["m"], "^[^A-Za-z0-9+(@]*+", 0))
        tail = F.length(F.regexp_extract(F.reverse(x["m"]), "^[^A-Za-z0-9)]*+", 0))
        inst = F.substring(x["m"], head + 1, F.greatest(F.length(x["m"]) - head - tail, F.lit(0)))
        return F.struct((x["s"] + head).alias("s"), (x["e"] - tail).alias("e"), inst.alias("inst"), _context(x["left"], i).alias("ctx"))

    likely = lambda x: (x["ctx"] != "") & ((F.length(_digits(x["inst"])) >= 5) | x["inst"].contains("@"))
    return F.filter(F.transform(matches(text, MENTION), row), likely)


def scored_patterns(edges: DataFrame, limits: Limits) -> DataFrame:
    """(ctx, kind, confidence) of confident patterns. ``edges`` has distinct (ctx, inst) with ``seed``, a kind or null."""
    labels = written(edges.where("seed is not null").groupBy("inst").agg(F.min("seed").alias("kind")))
    while True:
        known = edges.select("ctx", "inst").join(labels, "inst", "left")
        counts = known.groupBy("ctx", "kind").agg(F.count("*").alias("n"))
        totals = counts.groupBy("ctx").agg(F.sum("n").alias("total"))
        patterns = (
            counts.where("kind is not null")
            .join(totals, "ctx")
            .withColumn("confidence", F.col("n") / (F.col("total") + 0.5))
            .where((F.col("n") >= limits.support) & (F.col("confidence") >= limits.pattern))
            .select("ctx", "kind", "confidence")
        )
        patterns = written(patterns)
        fresh = (
            known.where("kind is null")
            .select("ctx", "inst")
            .join(patterns, "ctx")
            .groupBy("inst", "kind")
            .agg((1 - F.exp(F.sum(F.log1p(-F.least("confidence", F.lit(0.999)))))).alias("score"))
            .where(F.col("score") >= limits.instance)
            .groupBy("inst")
            .agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"))
        )
        fresh = written(fresh)
        if fresh.isEmpty():  # settled: there are only so many instances, and each is labelled once
            return patterns
        labels = written(labels.unionByName(fresh))


def find_pii(docs: DataFrame, text: str = "text", key: str = "doc_id", limits: Limits | None = None) -> DataFrame:
    """(key, base, spans) for every row: base spans, and those with the discovered ones, both in order."""
    limits, t = limits or Limits(), F.col("t")
    source = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    found = source.select("k", F.monotonically_increasing_id().alias("row"), _seeds(t).alias("found"), _mentions(t).alias("mentions"))
    seeds = F.transform("found", lambda x: F.struct(x["ctx"].alias("ctx"), _short(x["m"]).alias("inst"), x["kind"].alias("seed")))
    measured = found.select(
        "k",
        "row",
        base_spans(F.col("found")).alias("base"),
        F.filter(seeds, lambda x: x["ctx"] != "").alias("seeds"),
        outside(F.col("mentions"), F.col("found")).alias("free"),
    )
    measured = checkpointed(measured)
    free = measured.where(F.size("free") > 0).select("row", F.explode("free").alias("x")).select("row", "x.*")
    pairs = measured.where(F.size("seeds") > 0).select(F.inline("seeds"))
    pairs = pairs.unionByName(free.select("ctx", _short(F.col("inst")).alias("inst"), F.lit(None).cast("string").alias("seed")))
    edges = checkpointed(pairs.groupBy("ctx", "inst").agg(F.min("seed").alias("seed")))
    patterns = scored_patterns(edges, limits).groupBy("ctx").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind"))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    fresh = free.join(patterns, "ctx").groupBy("row").agg(F.collect_list(F.struct("s", rank.alias("rank"), "e", "kind", F.col("inst").alias("m"))).alias("more"))
    joined = measured.select("k", "row", "base").join(fresh, "row", "left")
    spans = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "more")))
    return joined.select(F.col("k").alias(key), "base", spans.alias("spans"))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    counts = [count_kind(F.col("base"), k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(rendered(F.col("base")), 256).alias("base_sha256"), rendered(F.col("spans")).alias("spans"))


#: Rounds that the SQL unrolls; the query itself goes on until a round finds nothing.
SQL_ROUNDS = 5


def _rounds_sql(limits: Limits) -> str:
    """The rounds of ``scored_patterns`` as CTEs; the last one is named patterns."""
    out, labels = [], "SELECT inst, min(seed) AS kind FROM edges WHERE seed IS NOT NULL GROUP BY inst"
    for i in range(SQL_ROUNDS):
        out.append(f"l{i} AS MATERIALIZED ({labels})")
        out.append(f"k{i} AS MATERIALIZED (SELECT ctx, inst, kind FROM edges LEFT JOIN l{i} USING (inst))")
        out.append(f"c{i} AS (SELECT ctx, kind, count(*) AS n, sum(count(*)) OVER (PARTITION BY ctx) AS total FROM k{i} GROUP BY ctx, kind)")
        out.append(
            f"p{i} AS MATERIALIZED (SELECT ctx, kind, n / (total + 0.5::DOUBLE) AS confidence FROM c{i} WHERE kind IS NOT NULL AND n >= {limits.support} AND n / (total + 0.5::DOUBLE) >= {limits.pattern})"
        )
        out.append(
            f"s{i} AS (SELECT inst, kind, 1 - exp(sum(ln(1 - least(confidence, 0.999::DOUBLE)))) AS score FROM (SELECT ctx, inst FROM k{i} WHERE kind IS NULL) JOIN p{i} USING (ctx) GROUP BY ALL)"
        )
        labels = f"SELECT * FROM l{i} UNION ALL SELECT inst, arg_max(kind, (score, kind)) FROM s{i} WHERE score >= {limits.instance} GROUP BY inst"
    return ", ".join([*out, f"patterns AS (SELECT ctx, arg_max(kind, (confidence, kind)) AS kind FROM p{SQL_ROUNDS - 1} GROUP BY ctx)"])


_SHORT = f"CASE WHEN length({{0}}) > {LONG} THEN sha256({{0}}) ELSE {{0}} END"
_PLAIN_NUMERIC = _NUMERIC.replace("*+", "*")
_CONTEXT = rf"""array_to_string([CASE WHEN regexp_matches(w, '[0-9@]') THEN '#' ELSE {_SHORT.format(f"translate(w, '{_UPPER}', '{_LOWER}')")} END FOR w IN string_split_regex(
  regexp_extract(CASE WHEN i = 1 THEN '^ ' ELSE '# ' END || g, '([^{_SPACE}]+[{_SPACE}]+[^{_SPACE}]+)[{_SPACE}]*$', 1), '[{_SPACE}]+')], ' ')"""
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
{positions_sql({"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "card": "[0-9](?:[ -]?[0-9])+", "phone": PHONE})},
luhn AS (
  SELECT m, sum(CASE WHEN i % 2 = 1 THEN v WHEN v > 4 THEN 2 * v - 9 ELSE 2 * v END) AS total
  FROM (SELECT m, i, digits[len(digits) - i + 1]::INT AS v FROM (SELECT m, digits, unnest(range(1, len(digits) + 1)) AS i
    FROM (SELECT DISTINCT m, string_split(regexp_replace(m, '[^0-9]', '', 'g'), '') AS digits FROM found WHERE kind = 'card'))) GROUP BY m
), base AS (
  SELECT r, kind, rank, s, e, m, {_CONTEXT} AS ctx FROM found LEFT JOIN luhn USING (m) WHERE CASE kind WHEN 'email' THEN true
    WHEN 'ip' THEN regexp_full_match(m, '{_OCTET}(?:\.{_OCTET}){{3}}')
    WHEN 'card' THEN length(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 14 AND 19 AND total % 10 = 0
    ELSE length(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 10 AND 15 END
), {positions_sql({"mention": rf"{_PLAIN_NUMERIC}(?: {_PLAIN_NUMERIC})*[^{_SPACE}]*|[^{_SPACE}0-9@]*[0-9@][^{_SPACE}]*"}, name="token")}, mentions AS (
  SELECT r, s + h AS s, e - z AS e, substr(m, h + 1, greatest(length(m) - h - z, 0)) AS inst, ctx
  FROM (SELECT *, {_CONTEXT} AS ctx, length(regexp_extract(m, '^[^A-Za-z0-9+(@]*', 0)) AS h, length(regexp_extract(m, '[^A-Za-z0-9)]*$', 0)) AS z FROM token)
), free AS (
  SELECT * FROM mentions c WHERE ctx <> '' AND (length(regexp_replace(inst, '[^0-9]', '', 'g')) >= 5 OR contains(inst, '@'))
  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.r = c.r AND b.s < c.e AND b.e > c.s)
), edges AS MATERIALIZED (
  SELECT ctx, inst, min(seed) AS seed FROM (SELECT ctx, {_SHORT.format('m')} AS inst, kind AS seed FROM base WHERE ctx <> ''
    UNION ALL SELECT ctx, {_SHORT.format('inst')}, NULL FROM free) GROUP BY ctx, inst),
{_rounds_sql(Limits())},
more AS (SELECT r, p.kind, list_position(['email', 'ip', 'card', 'phone'], p.kind) - 1 AS rank, s, e FROM free JOIN patterns p USING (ctx)),
b AS (
  SELECT r, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in KINDS)}, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS x FROM base GROUP BY r
), a AS (
  SELECT r, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS x FROM (SELECT r, kind, rank, s, e FROM base UNION ALL SELECT r, kind, rank, s, e FROM more) GROUP BY r
)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in KINDS)}, sha256(coalesce(b.x, '')) AS base_sha256, coalesce(a.x, '') AS spans
FROM d LEFT JOIN b USING (r) LEFT JOIN a USING (r)
"""
