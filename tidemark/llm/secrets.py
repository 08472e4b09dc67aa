"""Secrets by multipart credential linking.

Strong parts are reported as they are: assignments of long values to secret names, access identifiers, long hexadecimal
runs. Weak parts are not evidence alone: user and client names, short or unusually named secret values, endpoints. A
weak part is reported only where a complementary one (access identifier, secret, endpoint: two different roles, one of
them a secret) lies in its scope, that is, within ``radius`` code points in the same document.

The interval join is a sweep in the row: parts are sorted by start; each part learns how far the parts of each role before
it reach, and where the next of each role starts. Both are running values by doubling (n log n steps), no pairs are made
and nothing is shuffled. Only built-in functions are used.

Cases: a null text is empty and has no spans; texts of any length and any number of parts take n log n steps at most; parts at equal places are ordered by kind; repeated rows get equal
results; an empty table gives an empty result; extra columns pass through ``redact`` and are dropped by ``find_secrets``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .spans import count_kind, let, matches, of_kind, outside, rendered, running

RADIUS = 200
MASK = "[SECRET]"


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(_either, ("password", "passwd", "secret", "token"))) + "|" + _either("api") + "_?" + _either("key")
_TIE = "[\"']?+ *+[:=] *+[\"']?+"
ASSIGN = rf"(?:{_NAMES}){_TIE}[A-Za-z0-9+/_.=-]++"
ACCESS = r"AKIA[A-Z0-9]++"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}+"
WEAK_ACCESS = rf"(?<![A-Za-z0-9_])(?:{'|'.join(map(_either, ('username', 'user', 'login', 'client_id', 'access_key_id', 'account')))}){_TIE}[A-Za-z0-9@._-]{{3,}}+"
WEAK_SECRET = rf"(?<![A-Za-z0-9_])(?:{_NAMES}|{'|'.join(map(_either, ('pass', 'pwd', 'credential', 'private_key', 'bearer')))}){_TIE}[^\s\"',;]{{6,}}+"
ENDPOINT = r"(?<![A-Za-z0-9_])(?:https?|ftp|jdbc:[a-z]++|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s\"'<>]++"

#: Kinds in order, with their roles.
KINDS = ("assign", "access", "hex", "weak_access", "weak_secret", "endpoint")
ROLE = {"assign": "secret", "access": "access", "hex": "secret", "weak_access": "access", "weak_secret": "secret", "endpoint": "endpoint"}
ROLES = ("access", "secret", "endpoint")


def _tied(text: Column) -> Column:
    """A cheap test: without one of these no name is tied to a value."""
    return F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))


def base_spans(text: Column) -> Column:
    assign = F.filter(
        matches(text, ASSIGN, _tied(text)), lambda x: F.length(F.regexp_extract(x["m"], rf"^(?:{_NAMES}){_TIE}([A-Za-z0-9+/_.=-]+)$", 1)) >= 12
    )
    access = F.filter(matches(text, ACCESS, F.contains(text, F.lit("AKIA"))), lambda x: F.length(x["m"]) >= 18)
    found = [of_kind(x, k, i) for i, (k, x) in enumerate(zip(KINDS, (assign, access, matches(text, HEX)), strict=False))]
    return F.array_sort(F.concat(*found))


def weak_parts(text: Column) -> Column:
    ways = ((WEAK_ACCESS, _tied(text)), (WEAK_SECRET, _tied(text)), (ENDPOINT, F.contains(text, F.lit("://"))))
    found = [of_kind(matches(text, p, guard), k, i) for i, (k, (p, guard)) in enumerate(zip(KINDS[3:], ways, strict=True), 3)]
    return F.array_sort(F.concat(*found))


def _role(kind: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, r in ROLE.items():
        out = F.when(kind == k, r).otherwise(out)
    return out


def linked(parts: Column, radius: int = RADIUS) -> Column:
    """The weak ones of the sorted ``parts`` that have a complementary part in their scope."""
    far = 1 << 30

    def reach(p: Column, end: str, none: int, best) -> Column:
        """For each part, by role, the best end of the parts up to it."""
        places = F.transform(p, lambda x: F.struct(*(F.when(_role(x["kind"]) == r, x[end]).otherwise(F.lit(none)).alias(r) for r in ROLES)))
        pick = lambda a, b: F.struct(*(best(a[r], b[r]).alias(r) for r in ROLES))
        return running(places, pick, F.struct(*(F.lit(none).alias(r) for r in ROLES)))

    def near(x: Column, role: str) -> Column:
        return (x["b"][role] >= x["p"]["s"] - radius) | (x["a"][role] <= x["p"]["e"] + radius)

    def complementary(x: Column) -> Column:
        role = _role(x["p"]["kind"])
        return F.when(role == "secret", near(x, "access") | near(x, "endpoint")).otherwise(near(x, "secret"))

    def swept(p: Column) -> Column:
        rows = F.arrays_zip(p.alias("p"), reach(p, "e", -far, F.greatest).alias("b"), F.reverse(reach(F.reverse(p), "s", far, F.least)).alias("a"))
        weak = F.filter(rows, lambda x: (x["p"]["rank"] >= 3) & complementary(x))
        return F.transform(weak, lambda x: x["p"])

    return let(parts, swept)


def _with_spans(docs: DataFrame, text: str, radius: int) -> DataFrame:
    """``docs`` with _base and _spans. The steps are projections of their own, so each pattern runs once."""
    t = F.coalesce(F.col(text), F.lit(""))
    found = docs.withColumns({"_base": base_spans(t), "_weak": weak_parts(t)})
    found = found.withColumn("_weak", outside(F.col("_weak"), F.col("_base")))
    found = found.withColumn("_parts", F.when(F.size("_weak") > 0, F.array_sort(F.concat("_base", "_weak"))).otherwise(F.col("_weak")))
    more = F.when(F.size("_parts") > 1, linked(F.col("_parts"), radius)).otherwise(F.slice("_parts", 1, 0))
    found = found.withColumn("_more", more)
    spans = F.when(F.size("_more") > 0, F.array_sort(F.concat("_base", "_more"))).otherwise(F.col("_base"))
    return found.withColumn("_spans", spans).drop("_weak", "_parts", "_more")


def find_secrets(docs: DataFrame, text: str = "text", key: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """(key, base, spans) for every row."""
    found = _with_spans(docs.select(key, text), text, radius)
    return found.select(key, F.col("_base").alias("base"), F.col("_spans").alias("spans"))


#: Code points of the blocks that a text is cut from, so that a piece is never sought from the text's start.
BLOCK = 4096


def _without(text: Column, spans: Column, mask: str) -> Column:
    """``text`` with the sorted ``spans`` masked, overlapping or touching ones by one mask each where they start anew."""

    def piece(blocks: Column, a: Column, b: Column) -> Column:
        """Code points a to b (exclusive) of the text: the blocks that hold them, cut."""
        first, last = F.floor(a / BLOCK).cast("int"), F.floor((b - 1) / BLOCK).cast("int")
        held = F.array_join(F.slice(blocks, first + 1, last - first + 1), "")
        return F.when(b > a, F.substring(held, a - first * BLOCK + 1, b - a)).otherwise("")

    def cut(blocks: Column) -> Column:
        ends = running(F.transform(spans, lambda x: x["e"]), F.greatest, F.lit(0))

        def around(done: Column) -> Column:
            """Before each span that starts where no earlier one reaches: what lies between, and the mask; then the rest."""
            before = F.concat(F.array(F.lit(0)), F.slice(done, 1, F.size(done) - 1))
            shown = F.zip_with(spans, before, lambda x, at: F.when(x["s"] >= at, F.concat(piece(blocks, at, x["s"]), F.lit(mask))).otherwise(""))
            return F.concat(F.array_join(shown, ""), piece(blocks, F.element_at(done, -1), F.length(text)))

        return let(ends, around)

    return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)), cut)


def redact(docs: DataFrame, text: str = "text", radius: int = RADIUS, mask: str = MASK) -> DataFrame:
    """``docs`` with every span, base or linked, replaced by ``mask``; overlapping spans by one. A null text stays null."""
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col(f"`{text}`").alias("_t"))
    found = _with_spans(whole, "_t", radius)
    t = F.col("_t")
    found = found.select("_row", F.when(F.size("_spans") > 0, _without(t, F.col("_spans"), mask)).otherwise(t).alias("_t"))
    return found.select(*(F.col("_t").alias(c) if c == text else F.col("_row").getField(c).alias(c) for c in docs.columns))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    counts = [count_kind(F.col("base"), k).alias(f"n_{k}") for k in KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(rendered(F.col("base")), 256).alias("base_sha256"), rendered(F.col("spans")).alias("spans"))


def _plain(pattern: str) -> str:
    """The same pattern for an engine without lookbehind and possessive quantifiers, quoted for SQL."""
    for a, b in (("(?<![A-Za-z0-9_])", r"\b"), ("(?<![0-9a-f])", ""), ("?+", "?"), ("*+", "*"), ("++", "+"), ("}+", "}")):
        pattern = pattern.replace(a, b)
    return pattern.replace("'", "''")


def positions_sql(patterns: dict[str, str], source: str = "d", name: str = "found") -> str:
    """CTEs that give (r, kind, rank, s, e, m) of all matches of the texts (r, t) of ``source``."""
    parts = " UNION ALL ".join(
        f"SELECT r, '{k}' AS kind, {i} AS rank, regexp_extract_all(t, '{p}') AS ms, string_split_regex(t, '{p}') AS gs FROM {source}"
        for i, (k, p) in enumerate(patterns.items())
    )
    return f"""{name}_l AS ({parts}), {name}_u AS (
  SELECT r, kind, rank, unnest(ms) AS m, unnest(gs[1:len(ms)]) AS g, unnest(range(1, len(ms) + 1)) AS i FROM {name}_l WHERE len(ms) > 0
), {name} AS (
  SELECT r, kind, rank, s, s + length(m) AS e, m, g, i FROM (SELECT *, (sum(length(g) + length(m)) OVER (PARTITION BY r, kind ORDER BY i) - length(m))::BIGINT AS s FROM {name}_u)
)"""


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
{positions_sql({k: _plain(p) for k, p in zip(KINDS, (ASSIGN, ACCESS, HEX, WEAK_ACCESS, WEAK_SECRET, ENDPOINT), strict=True)})},
base AS (
  SELECT * FROM found WHERE rank < 3 AND CASE kind WHEN 'assign' THEN length(regexp_extract(m, '^(?:{_plain(_NAMES)}){_plain(_TIE)}([A-Za-z0-9+/_.=-]+)$', 1)) >= 12
    WHEN 'access' THEN length(m) >= 18 ELSE true END
), weak AS (
  SELECT * FROM found f WHERE rank >= 3 AND NOT EXISTS (SELECT 1 FROM base b WHERE b.r = f.r AND b.s < f.e AND b.e > f.s)
), parts AS (
  SELECT *, CASE WHEN kind IN ('access', 'weak_access') THEN 'access' WHEN kind = 'endpoint' THEN 'endpoint' ELSE 'secret' END AS role
  FROM (SELECT * FROM base UNION ALL SELECT * FROM weak)
), more AS (
  SELECT * FROM parts w WHERE rank >= 3 AND EXISTS (SELECT 1 FROM parts p WHERE p.r = w.r AND p.e >= w.s - {RADIUS} AND p.s <= w.e + {RADIUS}
    AND CASE WHEN w.role = 'secret' THEN p.role IN ('access', 'endpoint') ELSE p.role = 'secret' END)
), b AS (
  SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS x FROM base GROUP BY r
), a AS (
  SELECT r, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS x
  FROM (SELECT r, kind, rank, s, e FROM base UNION ALL SELECT r, kind, rank, s, e FROM more) GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(b.x, '')) AS base_sha256, coalesce(a.x, '') AS spans
FROM d LEFT JOIN b USING (r) LEFT JOIN a USING (r)
"""
