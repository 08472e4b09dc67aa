"""Serving views and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import decimal_comma
from ..operators import quality as Q
from .base import S_FIRST, S_LAST, SQL, SQL_CAT, SQL_PANEL, SQL_PLACES, category_panel, panel, places, query, read, setting
from .join_queries import SQL_NP, SQL_ORD, nation_panel, order_months
from .panel_queries import robust_z_candidates


@query("""WITH h AS (SELECT s_suppkey AS entity, s_name AS name, s_acctbal AS balance, CASE WHEN regexp_matches(lower(s_name), '\\b1') THEN 0 WHEN contains(lower(s_name), '1') THEN 1 WHEN contains(lower(n_name), '1') THEN 2 END AS rank
FROM supplier JOIN nation ON s_nationkey = n_nationkey) SELECT entity, name, rank::BIGINT AS rank, count(*) OVER ()::BIGINT AS total FROM h WHERE rank IS NOT NULL ORDER BY rank, balance DESC, entity LIMIT 20""")
def entity_search(spark: SparkSession, d: str) -> DataFrame:
    """Ranked search for "1": word prefix, substring, region; then by balance. The page has twenty rows, the total is of all."""
    s = read(spark, d, "supplier").join(F.broadcast(read(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    name = F.lower("s_name")
    rank = F.when(name.rlike(r"\b1"), 0).when(name.contains("1"), 1).when(F.lower("n_name").contains("1"), 2)
    hits = s.withColumn("rank", rank.cast("long")).where("rank is not null")
    total = hits.agg(F.count("*").alias("total"))
    page = hits.orderBy("rank", F.desc("s_acctbal"), "s_suppkey").limit(20)
    return page.crossJoin(total).select(F.col("s_suppkey").alias("entity"), F.col("s_name").alias("name"), "rank", "total")


@query(f"""WITH {SQL_PANEL}, y AS (SELECT entity, month // 12 AS year, month % 12 AS m, value FROM panel), l AS (SELECT (z + 1) // 12 - 1 AS ly FROM win),
g AS (SELECT a.entity, sum(a.value) / sum(b.value) - 1 AS growth, count(*)::BIGINT AS common FROM l, y a JOIN y b ON a.entity = b.entity AND a.m = b.m AND a.year = ly AND b.year = ly - 1 GROUP BY 1)
SELECT s.s_suppkey AS entity, round(avg(y.value), 8) AS mean, count(y.value)::BIGINT AS months, round(any_value(growth), 6) AS growth, any_value(common) AS common
FROM supplier s LEFT JOIN y ON y.entity = s.s_suppkey AND y.year = (SELECT ly FROM l) LEFT JOIN g ON g.entity = s.s_suppkey GROUP BY 1""")
def entity_table(spark: SparkSession, d: str) -> DataFrame:
    """The last whole year's mean, and growth over the months that it and the year before have."""
    at = setting(spark, d)
    year = (at.last + 1) // 12 - 1
    y = at.panel.select("entity", F.floor(F.col("month") / 12).alias("year"), (F.col("month") % 12).alias("m"), "value")
    now, ago = y.where(F.col("year") == year), y.where(F.col("year") == year - 1).select("entity", "m", F.col("value").alias("before"))
    g = now.join(ago, ["entity", "m"]).groupBy("entity").agg((F.sum("value") / F.sum("before") - 1).alias("growth"), F.count("*").alias("common"))
    mean = now.groupBy("entity").agg(F.round(F.avg("value"), 8).alias("mean"), F.count("*").alias("months"))
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("entity"))
    return s.join(mean, "entity", "left").join(g, "entity", "left").select("entity", "mean", F.coalesce("months", F.lit(0)).alias("months"), F.round("growth", 6).alias("growth"), "common")


@query(f"""WITH {SQL_CAT} SELECT entity, string_agg(category || ':' || month || '=' || printf('%.2f', value), ';' ORDER BY category, month) AS series, count(*)::BIGINT AS points FROM cat GROUP BY 1""")
def entity_detail(spark: SparkSession, d: str) -> DataFrame:
    """Nested series of an entity, all months, sorted, as text."""
    c = category_panel(spark, d)
    rows = c.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("category", "month", "value"))).alias("a"))
    text = F.transform("a", lambda r: F.concat(r["category"], F.lit(":"), r["month"].cast("string"), F.lit("="), F.format_string("%.2f", r["value"])))
    return rows.select("entity", F.array_join(text, ";").alias("series"), F.size("a").cast("long").alias("points"))


@query(f"""WITH {SQL_CAT}, p AS (SELECT entity, category, '"' || category || '":[' || string_agg('{{"month":' || month || ',"value":' || value::VARCHAR || '}}', ',' ORDER BY month) || ']' AS x FROM cat GROUP BY 1, 2)
SELECT entity, '{{' || string_agg(x, ',' ORDER BY category) || '}}' AS json FROM p GROUP BY 1""")
def entity_json(spark: SparkSession, d: str) -> DataFrame:
    """The same as nested JSON, for a static export."""
    c = category_panel(spark, d)
    per = c.groupBy("entity", "category").agg(F.array_sort(F.collect_list(F.struct("month", "value"))).alias("points"))
    return per.groupBy("entity").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "points"))))).alias("json"))


@query(f"""WITH c AS ({SQL["robust_z_candidates"]}) SELECT year, count(*) FILTER (metric = 'revenue')::BIGINT AS revenue, count(*) FILTER (metric = 'quantity')::BIGINT AS quantity
FROM c WHERE caution = '' GROUP BY 1""")
def shock_overview(spark: SparkSession, d: str) -> DataFrame:
    """Candidates by year and metric, without those that carry a caution."""
    found = robust_z_candidates(spark, d).where("caution = ''")
    return found.groupBy("year").pivot("metric", ["revenue", "quantity"]).agg(F.count("entity")).fillna(0)


@query(f"""WITH {SQL_PANEL} SELECT entity, month, replace(printf('%.2f', value), '.', ',') AS value FROM panel""")
def decimal_comma_export(spark: SparkSession, d: str) -> DataFrame:
    return panel(spark, d).select("entity", "month", decimal_comma(F.col("value")).alias("value"))


@query(f"""WITH {SQL_PANEL}, k AS (SELECT entity, month, value, CASE WHEN value / lag(value) OVER (PARTITION BY entity ORDER BY month) > 10 OR value / lag(value) OVER (PARTITION BY entity ORDER BY month) < 0.1 THEN 1 ELSE 0 END AS j FROM panel),
s AS (SELECT count(DISTINCT entity)::DOUBLE AS e, round(avg(j), 6) AS j FROM k)
SELECT 'entities' AS "check", e AS value, 10.0::DOUBLE AS "limit", e >= 10 AS ok FROM s UNION ALL SELECT 'duplicates', 0, 0, true UNION ALL SELECT 'jumps', j, 0.001, j <= 0.001 FROM s UNION ALL SELECT 'kept', 1, 0.95, true""")
def quality_gate(spark: SparkSession, d: str) -> DataFrame:
    return Q.panel_gate(panel(spark, d), min_entities=10).withColumn("value", F.round("value", 6))


@query(f"""WITH {SQL_PANEL} SELECT entity, min(month) AS first, max(month) AS last, count(DISTINCT month)::BIGINT AS months, (max(month) - min(month) + 1 - count(DISTINCT month))::BIGINT AS missing FROM panel GROUP BY 1""")
def series_holes(spark: SparkSession, d: str) -> DataFrame:
    return Q.holes(panel(spark, d))


@query(f"""WITH {SQL_PANEL}, {SQL_NP}, {SQL_ORD} SELECT nation, count(*)::BIGINT AS n, round(quantile_cont(abs(value / price - 1) * 100, 0.5), 4) AS median_pct, round(max(abs(value / price - 1) * 100), 4) AS max_pct,
round(corr(value, price), 6) AS corr FROM np JOIN om USING (nation, month) GROUP BY 1""")
def source_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    orders = order_months(spark, d).withColumnRenamed("price", "value")
    found = Q.reconcile_sources(nation_panel(spark, d), orders, ["nation", "month"], "value", ["nation"])
    return found.select("nation", "n", F.round("median_pct", 4).alias("median_pct"), F.round("max_pct", 4).alias("max_pct"), F.round("corr", 6).alias("corr"))


@query(f"""WITH {SQL_CAT}, {SQL_PANEL}, s AS (SELECT entity, month, round(sum(value), 2) AS parts FROM cat GROUP BY 1, 2)
SELECT month, count(*)::BIGINT AS n, count(*) FILTER (abs(parts - value) > 0.05)::BIGINT AS off FROM s JOIN panel USING (entity, month) GROUP BY 1""")
def parts_equal_total(spark: SparkSession, d: str) -> DataFrame:
    parts = category_panel(spark, d).groupBy("entity", "month").agg(F.round(F.sum("value"), 2).alias("parts"))
    both = parts.join(panel(spark, d), ["entity", "month"])
    return both.groupBy("month").agg(F.count("*").alias("n"), F.sum((F.abs(F.col("parts") - F.col("value")) > 0.05).cast("long")).alias("off"))


@query(f"""WITH {SQL_PANEL}, {SQL_PLACES} SELECT region, count(DISTINCT entity)::BIGINT AS entities, round(sum(value), 2) AS total, max(month) AS last_month, count(*) FILTER (month BETWEEN {S_FIRST} AND {S_LAST})::BIGINT AS rows_inside
FROM panel JOIN places USING (entity) GROUP BY 1""")
def summary_numbers(spark: SparkSession, d: str) -> DataFrame:
    at = setting(spark, d)
    return at.panel.join(places(spark, d), "entity").groupBy("region").agg(
        F.countDistinct("entity").alias("entities"), F.round(F.sum("value"), 2).alias("total"), F.max("month").alias("last_month"),
        F.sum(F.col("month").between(at.first, at.last).cast("long")).alias("rows_inside"),
    )


@query(f"""WITH {SQL_PANEL}, {SQL_PLACES}, r AS (SELECT p.entity, p.month, p.value, region FROM panel p JOIN places USING (entity))
SELECT entity, month, round(value / sum(value) OVER (PARTITION BY region, month), 6) AS share, rank() OVER (PARTITION BY region, month ORDER BY value DESC)::BIGINT AS place FROM r""")
def region_ranking(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("region", "month")
    r = panel(spark, d).join(places(spark, d), "entity")
    return r.select("entity", "month", F.round(F.col("value") / F.sum("value").over(w), 6).alias("share"), F.rank().over(w.orderBy(F.desc("value"))).cast("long").alias("place"))


_TABLES = {"lineitem": "l_shipdate", "orders": "o_orderdate", "events": "ts"}


@query(" UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*)::BIGINT AS rows, min({c})::DATE::VARCHAR AS first, max({c})::DATE::VARCHAR AS last, ((SELECT max(ts)::DATE FROM events) - max({c})::DATE)::BIGINT AS days_behind FROM {t}" for t, c in _TABLES.items()))
def data_status(spark: SparkSession, d: str) -> DataFrame:
    """Rows, first and last day of the dated tables, and how far each is behind the events."""
    out = None
    for t, c in _TABLES.items():
        one = read(spark, d, t).agg(F.count("*").alias("rows"), F.min(c).cast("date").alias("first"), F.max(c).cast("date").alias("last")).withColumn("table", F.lit(t))
        out = one if out is None else out.unionByName(one)
    newest = out.where("table = 'events'").select(F.col("last").alias("newest"))
    return out.crossJoin(F.broadcast(newest)).select(  # a row a table
        "table", "rows", F.col("first").cast("string").alias("first"), F.col("last").cast("string").alias("last"), F.date_diff("newest", "last").cast("long").alias("days_behind")
    )


@query("""WITH e AS (SELECT user_id AS entity, user_id % 10 AS region, event_type AS kind, event_id FROM events), k AS (SELECT DISTINCT kind FROM e), m AS (SELECT DISTINCT entity, region FROM e),
o AS (SELECT entity, kind, count(DISTINCT event_id)::BIGINT AS n FROM e GROUP BY 1, 2), r AS (SELECT region, kind, count(DISTINCT event_id)::BIGINT AS n FROM e GROUP BY 1, 2)
SELECT m.entity, k.kind, coalesce(o.n, 0) AS own, coalesce(r.n, 0) - coalesce(o.n, 0) AS regional, rank() OVER (PARTITION BY m.entity ORDER BY coalesce(o.n, 0) DESC, k.kind)::BIGINT AS place
FROM m CROSS JOIN k LEFT JOIN o ON o.entity = m.entity AND o.kind = k.kind LEFT JOIN r ON r.region = m.region AND r.kind = k.kind""")
def news_overview(spark: SparkSession, d: str) -> DataFrame:
    """News about an entity and about the rest of its region, by type; the entity's types are ranked. Kinds are a handful."""
    e = read(spark, d, "events").select(F.col("user_id").alias("entity"), (F.col("user_id") % 10).alias("region"), F.col("event_type").alias("kind"), "event_id")
    kinds = e.select("kind").distinct().agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
    grid = e.select("entity", "region").distinct().crossJoin(F.broadcast(kinds)).select("entity", "region", F.explode("kinds").alias("kind"))
    own = e.groupBy("entity", "kind").agg(F.countDistinct("event_id").alias("own"))
    all_ = e.groupBy("region", "kind").agg(F.countDistinct("event_id").alias("all"))
    both = grid.join(own, ["entity", "kind"], "left").join(all_, ["region", "kind"], "left").fillna(0, ["own", "all"])
    place = F.rank().over(Window.partitionBy("entity").orderBy(F.desc("own"), "kind")).cast("long")
    return both.select("entity", "kind", "own", (F.col("all") - F.col("own")).alias("regional"), place.alias("place"))


@query("""WITH e AS (SELECT user_id AS entity, user_id % 10 AS region, event_type AS kind, (ts::DATE - DATE '2024-01-01')::BIGINT // 7 AS week, event_id FROM events),
r AS (SELECT DISTINCT entity, region, week FROM e WHERE kind = 'signup'), n AS (SELECT * FROM e WHERE kind = 'error')
SELECT r.entity, r.week, (SELECT count(*) FROM n WHERE n.entity = r.entity AND n.week = r.week)::BIGINT AS own_news, (SELECT count(*) FROM n WHERE n.region = r.region AND n.week = r.week)::BIGINT AS region_news,
(SELECT coalesce(min(event_id), -1) FROM n WHERE n.entity = r.entity AND n.week = r.week) AS first_news FROM r""")
def event_period_news(spark: SparkSession, d: str) -> DataFrame:
    """For each registered event, the news about its entity, and about its region, in the same period (a week here)."""
    e = read(spark, d, "events").select(
        F.col("user_id").alias("entity"), (F.col("user_id") % 10).alias("region"), "event_type",
        F.floor(F.date_diff("ts", F.lit("2024-01-01").cast("date")) / 7).cast("long").alias("week"), "event_id",
    )
    news = e.where("event_type = 'error'")
    own = news.groupBy("entity", "week").agg(F.countDistinct("event_id").alias("own_news"), F.min("event_id").alias("first_news"))
    regional = news.groupBy("region", "week").agg(F.countDistinct("event_id").alias("region_news"))
    found = e.where("event_type = 'signup'").select("entity", "region", "week").distinct().join(own, ["entity", "week"], "left").join(regional, ["region", "week"], "left")
    return found.select("entity", "week", F.coalesce("own_news", F.lit(0)).alias("own_news"), F.coalesce("region_news", F.lit(0)).alias("region_news"), F.coalesce("first_news", F.lit(-1)).alias("first_news"))
