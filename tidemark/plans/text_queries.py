"""Text and event queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import gazetteer as G
from ..functions import text as T
from ..operators import features as X
from .base import query, read

#: A small lexicon for the synthetic corpus. ASCII, so that any engine agrees.
LEXICON = {
    "licence": r"(?i)apache|licensed",
    "contact": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+",
    "credential": r"(?i)(token|password|secret) ?=",
    "number": r"[0-9]{16}",
    "noise": r"[#*$%&]{3}",
}


def _sql(p: str) -> str:
    return p.replace("'", "''")


_LABELS = ", ".join(f"CASE WHEN regexp_matches(text, '{_sql(p)}') THEN '{k}' END" for k, p in LEXICON.items())


@query(f"SELECT doc_id, array_to_string([x FOR x IN [{_LABELS}] IF x IS NOT NULL], ',') AS labels FROM documents")
def lexicon_labels(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.array_join(T.labels(F.col("text"), LEXICON), ",").alias("labels"))


@query(" UNION ALL ".join(f"SELECT doc_id, '{k}' AS label, regexp_extract(text, '{_sql(p)}', 0) AS first_match FROM documents WHERE regexp_matches(text, '{_sql(p)}')" for k, p in LEXICON.items()))
def lexicon_explain(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.explode(T.explain(F.col("text"), LEXICON)).alias("label", "first_match"))


@query(f"SELECT label, count(*)::BIGINT AS documents FROM (SELECT unnest([x FOR x IN [{_LABELS}] IF x IS NOT NULL]) AS label FROM documents) GROUP BY 1")
def label_counts(spark: SparkSession, d: str) -> DataFrame:
    labels = read(spark, d, "documents").select(F.explode(T.labels(F.col("text"), LEXICON)).alias("label"))
    return labels.groupBy("label").agg(F.count("*").alias("documents"))


RULES = {"credential": r"(?i)token\s*=", "licence": r"(?i)licensed", "contact": "@", "table": r" \| "}
VETO = {"credential": r"[#*$%&]{3}"}
_RULES = " ".join(f"WHEN regexp_matches(text, '{_sql(p)}')" + (f" AND NOT regexp_matches(text, '{_sql(VETO[k])}')" if k in VETO else "") + f" THEN '{k}'" for k, p in RULES.items())


@query(f"SELECT doc_id, CASE {_RULES} ELSE 'other' END AS kind FROM documents")
def ordered_rules(spark: SparkSession, d: str) -> DataFrame:
    """The first rule that matches, one of them with a veto."""
    return read(spark, d, "documents").select("doc_id", T.first_rule(F.col("text"), RULES, VETO).alias("kind"))


@query(r"""SELECT page_id, (i - 1)::BIGINT AS position, regexp_extract(a, 'href="([^"]*)"', 1) AS href, regexp_replace(a, '<[^>]+>', '', 'g') AS label
FROM (SELECT page_id, unnest(l) AS a, generate_subscripts(l, 1) AS i FROM (SELECT page_id, regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>') AS l FROM pages))""")
def page_links(spark: SparkSession, d: str) -> DataFrame:
    tags = F.regexp_extract_all("html", F.lit('<a href="[^"]*">[^<]*</a>'), F.lit(0))
    links = read(spark, d, "pages").select("page_id", F.posexplode(tags).alias("position", "a"))
    return links.select(
        "page_id", F.col("position").cast("long").alias("position"), F.regexp_extract("a", 'href="([^"]*)"', 1).alias("href"), F.regexp_replace("a", "<[^>]+>", "").alias("label")
    )


_TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"
_DECODED = _TITLE
for _entity, _char in T.ENTITIES:
    _DECODED = f"replace({_DECODED}, '{_entity}', '{_sql(_char)}')"


@query(rf"SELECT page_id, trim(regexp_replace({_DECODED}, '[\s\x0B]+', ' ', 'g')) AS title, length({_TITLE})::BIGINT AS raw_chars FROM pages")
def page_titles(spark: SparkSession, d: str) -> DataFrame:
    raw = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return read(spark, d, "pages").select("page_id", T.html_text(raw).alias("title"), F.length(raw).cast("long").alias("raw_chars"))


#: Regions by words that only their documents use, and mail hosts as cities that don't name their region.
REGIONS = {r: rf"(^|[ \n])({w})($|[ \n])" for r, w in (("north", "und|der|die|das"), ("south", "que|del|para|los"), ("west", "les|dans|pour|elle"), ("isles", "the|and|with|was"))}
CITIES = {"one": (r"@mail1\.example", "north"), "three": (r"@mail3\.example", "south"), "licence": (r"Licensed under", "isles")}
_NAMED = {r: " OR ".join(f"regexp_matches(text, '{_sql(p)}')" for p in (q, *(c for c, of in CITIES.values() if of == r))) for r, q in REGIONS.items()}


@query(f"SELECT doc_id, array_to_string([x FOR x IN [{', '.join(f'CASE WHEN {c} THEN {chr(39)}{r}{chr(39)} END' for r, c in _NAMED.items())}] IF x IS NOT NULL], ',') AS regions FROM documents")
def region_tags(spark: SparkSession, d: str) -> DataFrame:
    """Regions that a document names by an alias, or by a special city."""
    return read(spark, d, "documents").select("doc_id", F.array_join(X.region_tags(F.col("text"), REGIONS, CITIES), ",").alias("regions"))


#: Endings of the synthetic corpus' words.
LATIN = {"name": {"e": "e es en", "a": "a as", "": "s en er"}}
_FORMS = "CASE WHEN ends_with(w, 'e') THEN [w, w || 's', w || 'n'] WHEN ends_with(w, 'a') THEN [w, w || 's'] ELSE [w, w || 's', w || 'en', w || 'er'] END"


@query(rf"""WITH cw AS (SELECT lang, unnest(list_distinct([x FOR x IN string_split_regex(text, '[^\p{{L}}]+') IF regexp_full_match(x, '[A-Z][a-z]{{6,}}')])) AS w FROM documents),
nm AS (SELECT w, min(lang) AS region FROM cw GROUP BY 1 HAVING count(*) >= 5), fo AS (SELECT DISTINCT unnest({_FORMS}) AS form, w AS entity, region FROM nm),
sh AS (SELECT form, count(DISTINCT entity) > 1 AS ambiguous FROM fo GROUP BY 1), tk AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ёЁ', 'еЕ'), '[\p{{L}}\p{{N}}_-]+')) AS form FROM documents),
oc AS (SELECT doc_id, form, count(*) AS n FROM tk GROUP BY 1, 2), rg AS (SELECT DISTINCT doc_id, form AS region FROM oc WHERE form IN (SELECT region FROM nm)),
hi AS (SELECT doc_id, fo.entity, fo.region, ambiguous, n FROM oc JOIN fo USING (form) JOIN sh USING (form))
SELECT doc_id, entity, sum(n)::BIGINT AS n FROM hi WHERE NOT ambiguous OR (doc_id, region) IN (SELECT (doc_id, region) FROM rg) GROUP BY 1, 2""")
def gazetteer_mentions(spark: SparkSession, d: str) -> DataFrame:
    """How often each document names each frequent capitalised word of the corpus, in any of its forms; every text is scanned once for
    all of them. A form that two words share needs the word's language named beside it."""
    docs = read(spark, d, "documents").select("doc_id", "text", "lang")
    words = F.array_distinct(F.filter(F.split("text", r"[^\p{L}]+"), lambda x: x.rlike("^[A-Z][a-z]{6,}$")))
    names = docs.select("lang", F.explode(words).alias("name")).groupBy("name").agg(F.count("*").alias("n"), F.min("lang").alias("region")).where("n >= 5")
    names = names.select(F.col("name").alias("entity"), "name", F.lit("name").alias("kind"), "region")
    regions = names.select(F.col("region").alias("entity"), F.col("region").alias("name"), F.lit("code").alias("kind"), "region").distinct()
    return G.mentions(docs, "doc_id", "text", G.compiled(names, LATIN), G.compiled(regions, {}))


SQL_EV = """ev AS (SELECT user_id AS entity, event_type AS kind, (ts::DATE - DATE '2024-01-01')::BIGINT AS day, value, json_extract_string(props, '$.k')::DOUBLE AS k, event_id FROM events)"""


def event_days(spark: SparkSession, d: str) -> DataFrame:
    """(entity, kind, day, value, k, event_id); day counts from the start of 2024."""
    e = read(spark, d, "events")
    return e.select(
        F.col("user_id").alias("entity"), F.col("event_type").alias("kind"), F.date_diff("ts", F.lit("2024-01-01").cast("date")).cast("long").alias("day"),
        "value", F.get_json_object("props", "$.k").cast("double").alias("k"), "event_id",
    )


@query(f"""WITH {SQL_EV}, g AS (SELECT kind, day, count(*)::BIGINT AS n, round(sum(k * value) / greatest(sum(k), 1), 6) AS tone FROM ev GROUP BY 1, 2)
SELECT kind, day, n, round(ln(1 + n), 6) AS log_n, tone, round(CASE WHEN count(n) OVER w >= 3 THEN ln(1 + n) - ln(1 + avg(n) OVER w) END, 6) AS surge FROM g
WINDOW w AS (PARTITION BY kind ORDER BY day ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)""")
def event_daily_features(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.panel import rolling

    g = event_days(spark, d).groupBy("kind", "day").agg(F.count("*").alias("n"), F.round(F.sum(F.col("k") * F.col("value")) / F.greatest(F.sum("k"), F.lit(1)), 6).alias("tone"))
    surge = F.log1p("n") - F.log1p(rolling(F.avg, "n", ["kind"], -6, -1, 3, "day"))
    return g.select("kind", "day", "n", F.round(F.log1p("n"), 6).alias("log_n"), "tone", F.round(surge, 6).alias("surge"))


@query(f"""WITH {SQL_EV}, c AS (SELECT entity, day, count(*)::BIGINT AS n FROM ev WHERE kind = 'error' GROUP BY 1, 2), s AS (SELECT entity, min(day) a, max(day) b FROM c GROUP BY 1),
g AS (SELECT entity, unnest(generate_series(a, b)) AS day FROM s), f AS (SELECT entity, day, coalesce(n, 0)::BIGINT AS n FROM g LEFT JOIN c USING (entity, day))
SELECT entity, day, n AS count, n > 0 AS flag, round(CASE WHEN count(n) OVER p >= 3 THEN n - avg(n) OVER p END, 6) AS dev,
(coalesce(lag(n, 1) OVER w, 0) + coalesce(lag(n, 2) OVER w, 0))::BIGINT AS lag12_sum, (coalesce(lag(n, 3) OVER w, 0) + coalesce(lag(n, 4) OVER w, 0) + coalesce(lag(n, 5) OVER w, 0))::BIGINT AS lag35_sum
FROM f WINDOW w AS (PARTITION BY entity ORDER BY day), p AS (PARTITION BY entity ORDER BY day ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)""")
def event_forms(spark: SparkSession, d: str) -> DataFrame:
    c = event_days(spark, d).where("kind = 'error'").groupBy("entity", "day").agg(F.count("*").alias("n"))
    return X.event_forms(c, ["entity"], "day").withColumn("dev", F.round("dev", 6))


@query(f"""WITH {SQL_EV}, own AS (SELECT entity, day, kind, sum(k / 100) AS w FROM ev WHERE kind IN ('purchase', 'signup') GROUP BY ALL),
rg AS (SELECT entity % 10 AS region, day, kind, sum(k / 100) AS w FROM ev WHERE kind = 'error' GROUP BY ALL), m AS (SELECT DISTINCT entity, entity % 10 AS region FROM ev),
u AS (SELECT entity, day, kind, w FROM own UNION ALL SELECT m.entity, day, kind, 0.3::DOUBLE * w FROM rg JOIN m USING (region))
SELECT entity, day, round(coalesce(sum(w) FILTER (kind = 'error'), 0), 6) AS error, round(coalesce(sum(w) FILTER (kind = 'purchase'), 0), 6) AS purchase,
round(coalesce(sum(w) FILTER (kind = 'signup'), 0), 6) AS signup FROM u GROUP BY 1, 2""")
def weighted_mentions_pivot(spark: SparkSession, d: str) -> DataFrame:
    e = event_days(spark, d).withColumn("region", F.col("entity") % 10).withColumnRenamed("day", "month")
    own = e.where("kind in ('purchase', 'signup')").groupBy("entity", "month", "kind").agg(F.sum(F.col("k") / 100).alias("w"))
    regional = e.where("kind = 'error'").groupBy("region", "month", "kind").agg(F.sum(F.col("k") / 100).alias("w"))
    found = X.weighted_mentions(own, regional, e.select("entity", "region").distinct())
    kinds = ["error", "purchase", "signup"]
    wide = found.groupBy("entity", F.col("month").alias("day")).pivot("kind", kinds).agg(F.sum("w")).fillna(0.0, kinds)
    return wide.select("entity", "day", *(F.round(k, 6).alias(k) for k in kinds))


@query(f"""WITH {SQL_EV}, b AS (SELECT DISTINCT entity, day FROM ev WHERE kind = 'signup'), e AS (SELECT DISTINCT entity, day FROM ev WHERE kind = 'purchase')
SELECT b.entity, b.day, count(e.day) > 0 AS followed, coalesce(min(e.day), -1) AS first_day FROM b LEFT JOIN e ON e.entity = b.entity AND e.day BETWEEN b.day - 2 AND b.day + 5 GROUP BY 1, 2""")
def event_registry_check(spark: SparkSession, d: str) -> DataFrame:
    """Signals within [-2, +5] days of each registered event: a window over both kinds, not a range join."""
    e = event_days(spark, d).where("kind in ('signup', 'purchase')").select("entity", "day", "kind").distinct()
    near = F.min(F.when(F.col("kind") == "purchase", F.col("day"))).over(Window.partitionBy("entity").orderBy("day").rangeBetween(-2, 5))
    return e.withColumn("first_day", near).where("kind = 'signup'").select("entity", "day", F.col("first_day").isNotNull().alias("followed"), F.coalesce("first_day", F.lit(-1)).alias("first_day"))


@query(f"""WITH {SQL_EV}, own AS (SELECT entity, day FROM ev WHERE kind = 'purchase'), rg AS (SELECT DISTINCT entity % 50 AS region, day FROM ev WHERE kind = 'signup')
SELECT rg.region, rg.day FROM rg WHERE NOT EXISTS (SELECT 1 FROM own WHERE own.entity % 50 = rg.region AND own.day = rg.day)""")
def region_rows_not_covered(spark: SparkSession, d: str) -> DataFrame:
    """Region rows count only where no member of the region has a row of its own; fifty small regions, so that some have none."""
    e = event_days(spark, d).withColumn("region", F.col("entity") % 50)
    own = e.where("kind = 'purchase'").select("region", "day")
    return e.where("kind = 'signup'").select("region", "day").distinct().join(own, ["region", "day"], "left_anti")


@query()
def embedding_classifier_cv(spark: SparkSession, d: str) -> DataFrame:
    """Multinomial logistic regression on embeddings, class-balanced, with out-of-fold predictions by a fixed fold."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = read(spark, d, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"), F.col("label").cast("double").alias("label"))
    sizes = rows.groupBy("label").agg((1 / F.count("*")).alias("weight"))  # a row a label
    rows = rows.join(F.broadcast(sizes), "label").withColumn("fold", F.crc32(F.col("vec_id").cast("string")) % 3)
    out = None
    for fold in range(3):
        model = LogisticRegression(weightCol="weight", regParam=0.01, maxIter=30, family="multinomial").fit(rows.where(F.col("fold") != fold))
        part = model.transform(rows.where(F.col("fold") == fold)).select("vec_id", "label", "prediction", F.array_max(vector_to_array("probability")).alias("p"))
        out = part if out is None else out.unionByName(part)
    return out


@query()
def classifier_report(spark: SparkSession, d: str) -> DataFrame:
    """Precision, recall and F1 of each class."""
    found = embedding_classifier_cv(spark, d)
    pairs = found.select(F.inline(F.array(*(F.struct(F.col(c).alias("c"), F.lit(t).alias("t"), F.lit(p).alias("p")) for c, t, p in (("label", 1, 0), ("prediction", 0, 1))))), (F.col("label") == F.col("prediction")).alias("hit"))
    sums = pairs.groupBy("c").agg(F.sum("t").alias("t"), F.sum("p").alias("p"), F.sum((F.col("hit") & (F.col("t") == 1)).cast("int")).alias("k"))
    return sums.select(
        F.col("c").alias("label"), F.try_divide("k", "p").alias("precision"), F.try_divide("k", "t").alias("recall"), F.try_divide(2 * F.col("k"), F.col("p") + F.col("t")).alias("f1")
    )
