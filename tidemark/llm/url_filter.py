"""URL filters with redirect equivalence.

Rules are (host, path, verdict): a rule fits its host and all subdomains where the path starts with the rule's; the
longest rule wins, and allow wins a tie. A url that no rule fits takes the decision of its aliases: urls joined by
redirect and canonical-link edges (``<link rel=canonical>``, ``<meta http-equiv=refresh>``, and the implied canonical form
without scheme, fragment, tracking parameters and trailing slash) form components. If a member is allowed by a rule,
the component is allowed; else if a member is blocked, it is blocked; else it is allowed. A url's own rule always
stands. Targets may hold character references and be relative to the page's url (a base tag is not read); ``SQL`` below
knows neither, only absolute targets and those that start with a slash, so it is equal on pages without others.

Only built-in functions are used. A few rules (up to ``IN_ROW``) are matched in the row, as one expression. More, or rules
that are a table (host, path, verdict), of any number, are matched by an equi-join: a url meets them under each suffix of its host and each
length of path that some rule of that suffix has. Both ways give the same. Html is read once; everything after that
works on urls. All work on a url or a page is linear in its length, or nearly (dot segments: n log n). Components are those of distinct url forms that have an edge.

Cases: a null url, or one without ``://``, has an empty host and path and no rule; it is allowed, and joins no component.
Null html has no edges. Repeated rows get equal results; an empty table gives an empty result; extra columns are not passed on.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from html.entities import html5

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, table
from .graph import components
from .spans import let, running

#: Rules that are matched in the row; more of them make a table.
IN_ROW = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The rules of the contract query.
RULES: tuple[tuple[str, str, str], ...] = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)

_TRACKING = "utm_[^=&]*|ref|fbclid|gclid"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """struct<n, allow, rule> of the longest rule that fits, else null; one expression for each rule."""
    none = F.lit(None).cast("struct<n:int,allow:boolean,rule:string>")
    found = [
        F.when(
            ((host == h) | host.endswith("." + h)) & path.startswith(p),
            F.struct(F.lit(len(h + p)).alias("n"), F.lit(v == "allow").alias("allow"), F.lit(h + p).alias("rule")),
        )
        for h, p, v in rules
    ]
    return F.greatest(*found, none, none)


def rule_hits(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, hit) of the distinct (host, path) of ``urls`` that a rule of the table fits: struct<n, allow, rule>.

    A host's suffixes are joined to the lengths of their rules' paths, then each url's path heads of these lengths to the
    rules themselves; both joins are on equal keys, and a url has as many rows as suffixes times lengths, whatever the rules.
    """
    plain = rules.select(F.translate("host", _UPPER, _LOWER).alias("suffix"), F.col("path").alias("head"), (F.col("verdict") == "allow").alias("allow"))
    plain = plain.groupBy("suffix", "head").agg(F.max("allow").alias("allow"))
    sizes = plain.groupBy("suffix").agg(F.array_sort(F.collect_set(F.length("head"))).alias("sizes"))
    labels = F.split("host", r"\.")
    most = plain.agg(F.coalesce(F.max(F.size(F.split("suffix", r"\."))), F.lit(1)).alias("most"))  # one row: longer suffixes can't match
    places = F.sequence(F.greatest(F.size(labels) - F.col("most") + 1, F.lit(1)), F.size(labels))
    suffixes = F.transform(places, lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))
    seen = urls.where("host <> ''").select("host", "path").distinct()
    hosts = seen.select("host").distinct().crossJoin(F.broadcast(most)).select("host", F.explode(suffixes).alias("suffix")).join(sizes, "suffix")
    heads = seen.join(hosts, "host").select("host", "path", "suffix", F.explode("sizes").alias("n")).where(F.col("n") <= F.length("path"))
    heads = heads.select("host", "path", "suffix", F.substring("path", F.lit(1), F.col("n")).alias("head"))
    rule = F.concat("suffix", "head")
    hit = F.struct(F.length(rule).alias("n"), F.col("allow"), rule.alias("rule"))
    return heads.join(plain, ["suffix", "head"]).groupBy("host", "path").agg(F.max(hit).alias("hit"))


def normal_form(url: Column) -> Column:
    """Host in lower case, path and query, without tracking parameters, fragment and trailing slash; null if no ``://``."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))  # a later :// is part of the query or the fragment
    query = F.regexp_extract(rest, r"^[^?#]*+\?([^#]*)", 1)
    query = F.regexp_replace(F.concat(F.lit("&"), query), rf"&(?:{_TRACKING})=[^&]*", "")
    form = F.concat(host_of(url), F.rtrim(path_of(url), F.lit("/")), F.regexp_replace(query, "^&*", "?"))
    return F.when(url.contains("://"), F.regexp_replace(form, r"\?\z", ""))


def _attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute, quoted or bare; empty if it has none."""
    found = [F.regexp_extract(tag, rf"(?is)\b{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\"'\s>]+))", k) for k in (1, 2, 3)]
    return F.concat(*found)


def decoded(value: Column) -> Column:
    """``value`` with html's named and numeric character references replaced, in one pass."""
    names = F.from_json(F.lit(json.dumps({f"&{k}": v for k, v in html5.items() if k.endswith(";")})), "map<string,string>")

    def one(x: Column) -> Column:
        digits = F.regexp_extract(x, "^&#[xX]?0*([0-9a-fA-F]*)", 1)  # nine or more are beyond all characters
        code = F.when(F.length(digits) < 9, F.conv(digits, 16, 10).try_cast("long"))
        code = F.when(x.rlike("^&#[xX]"), code).otherwise(F.when(F.length(digits) < 9, digits.try_cast("long")))
        good = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(F.when(good, code).otherwise(F.lit(0xFFFD))), 8, "0")), "UTF-32")
        return F.when(x.startswith("&#"), char).otherwise(F.coalesce(F.try_element_at(names, x), x))

    pieces = F.regexp_extract_all(value, F.lit(r"&#[0-9]+;?|&#[xX][0-9a-fA-F]+;?|&[A-Za-z][A-Za-z0-9]*;|[^&]+|&"), F.lit(0))
    return F.when(value.contains("&"), F.array_join(F.transform(pieces, one), "")).otherwise(value)


def _without_dots(path: Column) -> Column:
    """An absolute path without its segments . and ..

    A name goes when a later .. climbs out of it, that is, when the depth falls below the name's own later on. Depths are running sums that
    can't fall below the root's, so what was lacking there so far is added back.
    """

    def kept(some: Column) -> Column:
        steps = F.transform(some, lambda x: F.when(x == "..", -1).when(x == ".", 0).otherwise(1))

        def of_sums(sums: Column) -> Column:
            lacking = running(F.transform(sums, lambda x: F.least(x, F.lit(0))), F.least, F.lit(0))

            def of_depths(depths: Column) -> Column:
                lowest = F.reverse(running(F.reverse(depths), F.least, F.lit(1 << 30)))  # from here on
                rows = F.arrays_zip(some.alias("x"), depths.alias("d"), lowest.alias("l"))
                return F.transform(F.filter(rows, lambda r: ~r["x"].isin(".", "..") & (r["l"] >= r["d"])), lambda r: r["x"])

            return let(F.zip_with(sums, lacking, lambda a, b: a - b), of_depths)

        return let(running(steps, lambda a, b: a + b, F.lit(0)), of_sums)

    segments = F.slice(F.split(path, "/"), 2, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))

    def joined(some: Column) -> Column:
        slash = F.when((F.size(some) > 0) & path.rlike(r"/\.\.?\z"), F.lit("/")).otherwise(F.lit(""))
        return F.concat(F.lit("/"), F.array_join(some, "/"), slash)

    return F.when(path.rlike(r"/\.\.?(?:/|\z)"), let(let(segments, kept), joined)).otherwise(path)


def resolved(ref: Column, url: Column) -> Column:
    """The absolute url that ``ref`` means on the page ``url``; null if it names the page itself or isn't hierarchical."""
    scheme, path = F.regexp_extract(url, "(?s)^(.*?)://", 1), path_of(url)
    root = F.concat(scheme, F.lit("://"), host_of(url))
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_extract(path, "(?s)^(.*/)", 1))
    whole = (
        F.when(ref.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), ref)
        .when(ref.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:|#|\z)"), F.lit(None))
        .when(ref.startswith("//"), F.concat(scheme, F.lit(":"), ref))
        .when(ref.startswith("/"), F.concat(root, ref))
        .when(ref.startswith("?"), F.concat(root, path, ref))
        .otherwise(F.concat(root, folder, ref))
    )
    part = lambda k: F.regexp_extract(whole, r"(?s)^(.*?://[^/?#]*)([^?#]*)(.*)\z", k)
    return F.when(whole.rlike(r"/\.\.?(?:[/?#]|\z)"), F.concat(part(1), _without_dots(part(2)), part(3))).otherwise(whole)


def targets(url: Column, html: Column) -> Column:
    """Absolute urls that a page names as its canonical form or refreshes to. Relative ones are resolved against its url."""
    closed = F.left(html, F.length(html) - F.length(F.substring_index(html, ">", -1)))  # so that every tag in it ends
    tags = F.regexp_extract_all(closed, F.lit(r"(?is)<(?:link|meta)\b[^>]*+>"), F.lit(0))
    tags = F.filter(tags, lambda x: x.rlike(r"(?i)\brel\s*=\s*[\"']?canonical\b|\bhttp-equiv\s*=\s*[\"']?refresh\b"))
    raw = F.transform(
        tags,
        lambda x: F.when(x.rlike("(?i)^<link"), F.trim(decoded(_attribute(x, "href")))).otherwise(
            F.regexp_extract(decoded(_attribute(x, "content")), r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1)
        ),
    )
    none = F.array().cast("array<string>")
    guard = html.rlike(r"(?i)canonical|refresh") & url.contains("://")
    return F.when(guard, F.array_compact(F.transform(raw, lambda x: resolved(x, url)))).otherwise(none)


def judge_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame = RULES, url: str = "url", html: str = "html", key: str = "page_id"
) -> DataFrame:
    """(key, host, path, rule, verdict, source): ``source`` is rule, alias or default."""
    u, spark = F.col("u"), pages.sparkSession
    read = pages.select(F.col(key).alias("k"), F.col(url).alias("u"), targets(F.col(url), F.col(html)).alias("to"))
    place = lambda x: F.struct(normal_form(x).alias("node"), host_of(x).alias("host"), path_of(x).alias("path"))
    read = read.select("k", host_of(u).alias("host"), path_of(u).alias("path"), normal_form(u).alias("node"), F.transform("to", place).alias("to"))
    if isinstance(rules, DataFrame) or len(rules) > IN_ROW:
        listed = rules if isinstance(rules, DataFrame) else spark.createDataFrame(list(rules), "host string, path string, verdict string")
        read = checkpointed(read)
        hits = checkpointed(rule_hits(read.select("host", "path").union(read.select(F.inline("to")).select("host", "path")), listed))
        with_hit = lambda df: df.join(hits, ["host", "path"], "left")
        read = checkpointed(with_hit(read))
    else:
        with_hit = lambda df: df.withColumn("hit", matched_rule(F.col("host"), F.col("path"), rules))
        read = checkpointed(with_hit(read))

    edges = read.where(F.size("to") > 0).select(F.col("node").alias("a"), F.explode("to.node").alias("b")).where("a <> b").distinct()
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels = components(nodes.withColumn("weight", F.col("node")), edges) if not edges.isEmpty() else None
    known = read.where("node is not null and hit is not null").select("node", F.col("hit.allow").alias("allow"))
    aimed = with_hit(read.where(F.size("to") > 0).select(F.inline("to")).where("node is not null")).where("hit is not null")
    known = known.unionByName(aimed.select("node", F.col("hit.allow").alias("allow")))  # of pages, and of targets that need not be pages
    known = known.groupBy("node").agg(F.max("allow").alias("allow"))
    if labels is not None:
        relabel = lambda df: df.join(labels, "node", "left").withColumn("node", F.coalesce("label", "node")).drop("label")
        read, known = relabel(read), relabel(known).groupBy("node").agg(F.max("allow").alias("allow"))
    decided = known.select("node", F.when(F.col("allow"), "allow").otherwise("block").alias("alias"))
    named, cols = F.col("hit").isNull() & F.col("node").isNotNull(), ["k", "host", "path", "hit"]
    alone = read.where(~named).select(*cols, F.lit(None).cast("string").alias("alias"))  # a rule of its own, or no url: no join, so no hot null
    out = alone.unionByName(read.where(named).join(decided, "node", "left").select(*cols, "alias"))
    own = F.when(F.col("hit.allow"), "allow").when(~F.col("hit.allow"), "block")
    source = F.when(F.col("hit").isNotNull(), "rule").when(F.col("alias").isNotNull(), "alias").otherwise("default")
    return out.select(
        F.col("k").alias(key), "host", "path", F.col("hit.rule").alias("rule"), F.coalesce(own, "alias", F.lit("allow")).alias("verdict"), source.alias("source")
    )


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages")).drop("source")


SQL = r"""
WITH RECURSIVE p AS (
  SELECT row_number() OVER () AS r, page_id, url, html,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), rules(h, p, v) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
         ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), hits AS (
  SELECT r, h || rules.p AS rule, v, row_number() OVER (PARTITION BY r ORDER BY length(h || rules.p) DESC, v) AS place
  FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, rules.p)
), urls AS (
  SELECT r, url AS u, false AS target FROM p WHERE contains(url, '://')
  UNION ALL
  SELECT r, CASE WHEN contains(x, '://') THEN x WHEN starts_with(x, '//') THEN regexp_extract(url, '(?s)^(.*?)://', 1) || ':' || x
                 WHEN starts_with(x, '/') THEN regexp_extract(url, '(?s)^(.*?)://', 1) || '://' || host || x END, true
  FROM (SELECT r, url, host, CASE WHEN regexp_matches(t, '(?i)^<link') THEN regexp_extract(t, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)
                             ELSE regexp_extract(t, '(?is)\burl\s*=\s*["'']?([^"''\s>;]+)', 1) END AS x
        FROM (SELECT r, url, host, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS t FROM p WHERE contains(url, '://'))
        WHERE regexp_matches(t, '(?i)\brel\s*=\s*["'']?canonical\b|\bhttp-equiv\s*=\s*["'']?refresh\b'))
), forms AS (
  SELECT r, target, u, regexp_replace(
    translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
    || regexp_replace(regexp_extract(u, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '/+$', '')
    || regexp_replace(regexp_replace('&' || regexp_extract(substr(u, strpos(u, '://') + 3), '^[^?#]*\?([^#]*)', 1), '&(?:utm_[^=&]*|ref|fbclid|gclid)=[^&]*', '', 'g'), '^&*', '?'),
    '\?$', '') AS node
  FROM urls WHERE u IS NOT NULL
), e AS (
  SELECT DISTINCT a.node AS a, b.node AS b FROM forms a JOIN forms b USING (r) WHERE NOT a.target AND b.target AND a.node <> b.node
), e2 AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach AS (
  SELECT DISTINCT node AS n, node AS m FROM forms UNION SELECT n, b FROM reach JOIN e2 ON m = a
), label AS (SELECT n, min(m) AS l FROM reach GROUP BY n), own AS (
  SELECT p.*, rule, v, l FROM p LEFT JOIN (SELECT * FROM hits WHERE place = 1) USING (r)
  LEFT JOIN (SELECT r, node FROM forms WHERE NOT target) USING (r) LEFT JOIN label ON node = n
), dec AS (
  SELECT l, v FROM (SELECT node, (SELECT v FROM rules x WHERE (hh = x.h OR ends_with(hh, '.' || x.h)) AND starts_with(pp, x.p)
                                  ORDER BY length(x.h || x.p) DESC, v LIMIT 1) AS v
    FROM (SELECT node, translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS hh,
                 regexp_extract(u, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS pp FROM forms)) JOIN label ON node = n
), d AS (SELECT l, CASE WHEN bool_or(v = 'allow') THEN 'allow' ELSE 'block' END AS alias FROM dec WHERE v IS NOT NULL GROUP BY l)
SELECT page_id, host, path, rule, coalesce(v, alias, 'allow') AS verdict FROM own LEFT JOIN d USING (l)
"""
