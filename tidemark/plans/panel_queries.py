"""Panel, aggregation, window, sort and set queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import panel as P
from ..operators.quantiles import medians, quantiles
from .base import MI, SQL_CAT, SQL_FULL, SQL_PANEL, SQL_PLACES, category_panel, panel, places, query, read, setting

E, EC = ["entity"], ["entity", "category"]


@query(f"WITH {SQL_PANEL} SELECT entity, month, value, n FROM panel")
def panel_monthly(spark: SparkSession, d: str) -> DataFrame:
    return panel(spark, d)


@query(f"""WITH {SQL_PANEL}, s AS (SELECT entity, min(month) a, max(month) b FROM panel GROUP BY 1),
g AS (SELECT entity, unnest(generate_series(a, b)) AS month FROM s)
SELECT entity, month, coalesce(value, 0) AS value, coalesce(n, 0)::BIGINT AS n FROM g LEFT JOIN panel USING (entity, month)""")
def panel_dense_zero_filled(spark: SparkSession, d: str) -> DataFrame:
    return P.densify(panel(spark, d), E, fill={"value": 0.0, "n": 0})


@query(f"""WITH {SQL_PANEL}, e AS (SELECT DISTINCT entity FROM panel), m AS (SELECT DISTINCT month FROM panel)
SELECT entity, month, value IS NOT NULL AS present FROM e CROSS JOIN m LEFT JOIN panel USING (entity, month)""")
def entity_month_grid(spark: SparkSession, d: str) -> DataFrame:
    p = panel(spark, d)
    return P.grid(p.select("entity").distinct(), p.select("month").distinct()).join(p, ["entity", "month"], "left").select(
        "entity", "month", F.col("value").isNotNull().alias("present")
    )


@query(f"WITH {SQL_PANEL}, {SQL_FULL} SELECT entity, month, value FROM full_panel")
def full_history_series(spark: SparkSession, d: str) -> DataFrame:
    s = setting(spark, d)
    return P.full_history(s.panel, E, s.first, s.last).select("entity", "month", "value")


@query(f"""WITH {SQL_PANEL}, {SQL_PLACES} SELECT region, coalesce(nation, '') AS nation, coalesce(year, -1) AS year, grouping(region, nation, year)::BIGINT AS level,
round(sum(value), 2) AS value, count(DISTINCT entity)::BIGINT AS entities FROM (SELECT *, (month // 12)::BIGINT AS year FROM panel JOIN places USING (entity))
GROUP BY GROUPING SETS ((region), (region, nation), (region, year))""")
def region_rollup_sets(spark: SparkSession, d: str) -> DataFrame:
    joined = panel(spark, d).join(places(spark, d), "entity").withColumn("year", F.floor(F.col("month") / 12).cast("long"))
    r, n, y = F.col("region"), F.col("nation"), F.col("year")
    return joined.groupingSets([[r], [r, n], [r, y]], r, n, y).agg(
        F.grouping_id().cast("long").alias("level"), F.round(F.sum("value"), 2).alias("value"), F.countDistinct("entity").alias("entities")
    ).fillna({"nation": "", "year": -1})


@query(f"""WITH {SQL_CAT} SELECT entity, month, round(sum(value), 2) AS total,
CASE WHEN count(CASE WHEN category IN ('A', 'R') THEN 1 END) = 2 THEN round(sum(value) - sum(CASE WHEN category IN ('A', 'R') THEN value END), 2) END AS other
FROM cat GROUP BY 1, 2""")
def category_other_min_count(spark: SparkSession, d: str) -> DataFrame:
    """What is left of the total after the named categories; null unless all of them are present."""
    named = F.when(F.col("category").isin("A", "R"), F.col("value"))
    return category_panel(spark, d).groupBy("entity", "month").agg(
        F.round(F.sum("value"), 2).alias("total"),
        F.when(F.count(named) == 2, F.round(F.sum("value") - F.sum(named), 2)).alias("other"),
    )


@query(f"""WITH {SQL_PANEL} SELECT a.entity, a.month, round(ln(a.value / b.value), 6) AS yoy FROM panel a JOIN panel b
ON a.entity = b.entity AND b.month = a.month - 12""")
def yoy_growth_calendar(spark: SparkSession, d: str) -> DataFrame:
    p = panel(spark, d).withColumn("before", P.lag_months("value", 12, E)).where("before is not null")
    return p.select("entity", "month", F.round(P.log_growth(F.col("value"), F.col("before")), 6).alias("yoy"))


@query(f"""WITH {SQL_PANEL} SELECT entity, month, round(ln(value / lag(value, 12) OVER w), 6) AS yoy_rows,
round(value / lag(value) OVER w - 1, 6) AS change_1 FROM panel WINDOW w AS (PARTITION BY entity ORDER BY month)""")
def yoy_growth_positional(spark: SparkSession, d: str) -> DataFrame:
    """Shifts by existing rows: a gap makes them compare months that are not adjacent."""
    return panel(spark, d).select(
        "entity",
        "month",
        F.round(P.log_growth(F.col("value"), P.lag_rows("value", 12, E)), 6).alias("yoy_rows"),
        F.round(F.col("value") / P.lag_rows("value", 1, E) - 1, 6).alias("change_1"),
    )


_RECENT = f"""WITH {SQL_PANEL}, l AS (
 SELECT p.entity, p.month, p.value, p1.value v1, p2.value v2, p11.value v11, p12.value v12, p13.value v13, p14.value v14 FROM panel p
 LEFT JOIN panel p1 ON p1.entity = p.entity AND p1.month = p.month - 1 LEFT JOIN panel p2 ON p2.entity = p.entity AND p2.month = p.month - 2
 LEFT JOIN panel p11 ON p11.entity = p.entity AND p11.month = p.month - 11
 LEFT JOIN panel p12 ON p12.entity = p.entity AND p12.month = p.month - 12 LEFT JOIN panel p13 ON p13.entity = p.entity AND p13.month = p.month - 13
 LEFT JOIN panel p14 ON p14.entity = p.entity AND p14.month = p.month - 14),
g AS (SELECT *, ln(value / v12) g1, ln(v1 / v13) g2, ln(v2 / v14) g3, ln((value + v1 + v2) / (v12 + v13 + v14)) drift3, ln(value / v1) mom, ln(v11 / v12) seas_step FROM l),
c AS (SELECT month, quantile_cont(g1, 0.5) AS common FROM g GROUP BY 1)
SELECT g.entity, g.month, round(g1, 6) g1, round(g2, 6) g2, round(g3, 6) g3, round(drift3, 6) drift3, round(mom, 6) mom, round(seas_step, 6) seas_step,
round(c.common, 6) common, round(k.common, 6) common_before FROM g LEFT JOIN c ON c.month = g.month LEFT JOIN c k ON k.month = g.month - 1"""


@query(_RECENT)
def recent_growth_features(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.features import recent_growth

    found = recent_growth(panel(spark, d))
    names = ["g1", "g2", "g3", "drift3", "mom", "seas_step", "common", "common_before"]
    return found.select("entity", "month", *(F.round(c, 6).alias(c) for c in names))


@query(f"""WITH {SQL_PANEL}, m AS (SELECT entity, month, ln(value / lag(value) OVER (PARTITION BY entity ORDER BY month)) x FROM panel)
SELECT entity, month, round(CASE WHEN count(x) OVER w = 12 THEN sum(x) OVER w END, 6) AS chain FROM m
WINDOW w AS (PARTITION BY entity ORDER BY month ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""")
def rolling12_chain(spark: SparkSession, d: str) -> DataFrame:
    m = panel(spark, d).withColumn("x", P.log_growth(F.col("value"), P.lag_rows("value", 1, E)))
    return m.select("entity", "month", F.round(P.rolling(F.sum, "x", E, -11, 0, 12), 6).alias("chain"))


@query(f"""WITH {SQL_PANEL} SELECT entity, month, round(CASE WHEN count(n) OVER a >= 3 THEN ln(1 + n) - ln(1 + avg(n) OVER a) END, 6) AS surge,
round(CASE WHEN count(n) OVER b >= 3 THEN n - avg(n) OVER b END, 6) AS dev FROM panel
WINDOW a AS (PARTITION BY entity ORDER BY month ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING),
b AS (PARTITION BY entity ORDER BY month ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)""")
def surge6_and_norm12(spark: SparkSession, d: str) -> DataFrame:
    return panel(spark, d).select(
        "entity",
        "month",
        F.round(F.log1p("n") - F.log1p(P.rolling(F.avg, "n", E, -6, -1, 3)), 6).alias("surge"),
        F.round(F.col("n") - P.rolling(F.avg, "n", E, -12, -1, 3), 6).alias("dev"),
    )


@query(f"""WITH {SQL_PANEL} SELECT a.entity, a.month, round(quantile_cont(b.value, 0.5), 4) AS median_before FROM panel a
LEFT JOIN panel b ON a.entity = b.entity AND b.month < a.month GROUP BY 1, 2""")
def expanding_median(spark: SparkSession, d: str) -> DataFrame:
    return panel(spark, d).select("entity", "month", F.round(P.expanding_median("value", E), 4).alias("median_before"))


@query(f"""WITH {SQL_PANEL}, m AS (SELECT entity, month, value, lag(value) OVER w before, value < coalesce(lag(value) OVER w, value) AS f FROM panel
WINDOW w AS (PARTITION BY entity ORDER BY month)),
s AS (SELECT *, sum((f AND NOT coalesce(pf, false))::INT) OVER (PARTITION BY entity ORDER BY month) AS run FROM
 (SELECT *, lag(f) OVER (PARTITION BY entity ORDER BY month) pf FROM m))
SELECT entity, run::BIGINT AS run, min(month) AS first, max(month) AS last, count(*)::BIGINT AS length, arg_min(before, month) AS value_before,
arg_min(month, value) AS low_month FROM s WHERE f GROUP BY 1, 2""")
def sales_runs_islands(spark: SparkSession, d: str) -> DataFrame:
    """Runs of falling months, the value before the run, and the month of the lowest value."""
    m = panel(spark, d).withColumn("before", P.lag_rows("value", 1, E)).withColumn("f", F.coalesce(F.col("value") < F.col("before"), F.lit(False)))
    m = m.withColumn("new", (F.col("f") & ~F.coalesce(F.lag("f").over(P.over(E)), F.lit(False))).cast("int"))
    m = m.withColumn("run", F.sum("new").over(P.over(E))).where("f")
    return m.groupBy("entity", "run").agg(
        F.min("month").alias("first"),
        F.max("month").alias("last"),
        F.count("*").alias("length"),
        F.min_by("before", "month").alias("value_before"),
        F.min_by("month", "value").alias("low_month"),
    )


@query("""WITH m AS (SELECT c_nationkey AS nation, year(o_orderdate)::BIGINT y, month(o_orderdate)::BIGINT m, round(sum(o_totalprice), 2) v
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3),
c AS (SELECT *, round(sum(v) OVER (PARTITION BY nation, y ORDER BY m), 2) AS ytd FROM m),
l AS (SELECT *, lag(ytd) OVER (PARTITION BY nation, y ORDER BY m) lb, lag(m) OVER (PARTITION BY nation, y ORDER BY m) lm FROM c)
SELECT nation, y AS year, m AS month, ytd, round(coalesce(ytd - lb, ytd), 2) AS flow,
round(CASE WHEN m = 1 THEN ytd WHEN lm = m - 1 THEN ytd - lb END, 2) AS flow_strict FROM l""")
def ytd_and_decumulated(spark: SparkSession, d: str) -> DataFrame:
    orders = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    m = orders.groupBy(F.col("c_nationkey").alias("nation"), F.year("o_orderdate").cast("long").alias("year"), F.month("o_orderdate").cast("long").alias("month"))
    m = m.agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    c = m.withColumn("ytd", F.round(F.sum("v").over(Window.partitionBy("nation", "year").orderBy("month")), 2))
    return c.select(
        "nation", "year", "month", "ytd",
        F.round(P.decumulate(c, ["nation"], "year", "month", "ytd"), 2).alias("flow"),
        F.round(P.decumulate(c, ["nation"], "year", "month", "ytd", strict=True), 2).alias("flow_strict"),
    )


@query(f"""WITH {SQL_PANEL}, {SQL_PLACES}, r AS (SELECT region, month, round(sum(value), 2) v FROM panel JOIN places USING (entity) GROUP BY 1, 2)
SELECT region, month, v AS value, round(v - avg(v) OVER (PARTITION BY region, month % 12), 4) AS anomaly FROM r""")
def climatology_anomaly(spark: SparkSession, d: str) -> DataFrame:
    r = panel(spark, d).join(places(spark, d), "entity").groupBy("region", "month").agg(F.round(F.sum("value"), 2).alias("value"))
    usual = F.avg("value").over(Window.partitionBy("region", F.col("month") % 12))
    return r.select("region", "month", "value", F.round(F.col("value") - usual, 4).alias("anomaly"))


@query(f"""WITH y AS (SELECT l_suppkey entity, year(l_shipdate)::BIGINT AS year, round(sum(l_extendedprice), 2) revenue, sum(l_quantity)::DOUBLE quantity, count(*)::BIGINT n
FROM lineitem GROUP BY 1, 2), m AS (SELECT entity, year, n, unnest([('revenue', ln(revenue / lag(revenue) OVER w)), ('quantity', ln(quantity / lag(quantity) OVER w))]) AS x
FROM y WINDOW w AS (PARTITION BY entity ORDER BY year)), c AS (SELECT entity, year, n, x[1] AS metric, x[2] AS change FROM m WHERE x[2] IS NOT NULL),
d AS (SELECT *, quantile_cont(change, 0.5) OVER (PARTITION BY metric, year) md FROM c),
z AS (SELECT *, 1.4826 * quantile_cont(abs(change - md), 0.5) OVER (PARTITION BY metric, year) s FROM d)
SELECT entity, year, metric, round(change, 6) AS change, round((change - md) / s, 5) AS z,
CASE WHEN abs(change) > 3 THEN 'data_error' WHEN n < 20 THEN 'small_base' ELSE '' END AS caution
FROM z WHERE s > 0 AND (change - md) / s <= -2.5 AND change <= ln(0.9)""")
def robust_z_candidates(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.detect import robust_candidates

    y = read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("entity"), F.year("l_shipdate").cast("long").alias("year"))
    y = y.agg(F.round(F.sum("l_extendedprice"), 2).alias("revenue"), F.sum("l_quantity").alias("quantity"), F.count("*").alias("n"))
    found = robust_candidates(y, ["revenue", "quantity"], z_limit=-2.5, ratio=0.9)
    caution = F.when(F.abs("change") > 3, "data_error").when(F.col("n") < 20, "small_base").otherwise("")
    return found.select("entity", "year", "metric", F.round("change", 6).alias("change"), F.round("z", 5).alias("z"), caution.alias("caution"))


@query(f"""WITH {SQL_CAT} SELECT entity, category, round(avg(value), 8) AS mean, round(avg(value) / sum(avg(value)) OVER (PARTITION BY entity), 6) AS share
FROM cat GROUP BY 1, 2""")
def category_share(spark: SparkSession, d: str) -> DataFrame:
    m = category_panel(spark, d).groupBy(*EC).agg(F.avg("value").alias("mean"))
    return m.select(*EC, F.round("mean", 8).alias("mean"), F.round(F.col("mean") / F.sum("mean").over(Window.partitionBy("entity")), 6).alias("share"))


@query(f"""WITH {SQL_PANEL}, {SQL_PLACES} SELECT region, month, round(sum(n * value) / greatest(sum(n), 1), 8) AS weighted, round(avg(value), 8) AS plain
FROM panel JOIN places USING (entity) GROUP BY 1, 2""")
def weighted_mean(spark: SparkSession, d: str) -> DataFrame:
    return panel(spark, d).join(places(spark, d), "entity").groupBy("region", "month").agg(
        F.round(F.sum(F.col("n") * F.col("value")) / F.greatest(F.sum("n"), F.lit(1)), 8).alias("weighted"), F.round(F.avg("value"), 8).alias("plain")
    )


@query(f"""WITH {SQL_CAT} SELECT entity, arg_max(value, month) FILTER (category = 'R') AS last_r, max(month) FILTER (category = 'R') AS last_month,
arg_max(month, value) AS peak_month, arg_min(month, value) AS low_month FROM cat GROUP BY 1""")
def last_and_extreme(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("category") == "R"
    return category_panel(spark, d).groupBy("entity").agg(
        F.max_by("value", F.when(r, F.col("month"))).alias("last_r"),
        F.max(F.when(r, F.col("month"))).alias("last_month"),
        F.max_by("month", "value").alias("peak_month"),
        F.min_by("month", "value").alias("low_month"),
    )


@query("""SELECT l_returnflag AS flag, bool_or(l_discount > 0.09) AS any_high, bool_and(l_quantity >= 1) AS all_positive,
round(avg((l_discount > 0.05)::INT), 6) AS share, round(stddev_samp(l_quantity), 6) AS sd, round(corr(l_quantity, l_extendedprice), 6) AS corr FROM lineitem GROUP BY 1""")
def boolean_and_spread(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(
        F.bool_or(F.col("l_discount") > 0.09).alias("any_high"),
        F.bool_and(F.col("l_quantity") >= 1).alias("all_positive"),
        F.round(F.avg((F.col("l_discount") > 0.05).cast("int")), 6).alias("share"),
        F.round(F.stddev_samp("l_quantity"), 6).alias("sd"),
        F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("corr"),
    )


@query(f"""WITH {SQL_CAT} SELECT entity, (month // 12)::BIGINT AS year, round(avg(value) FILTER (category = 'A'), 8) AS "A", round(avg(value) FILTER (category = 'N'), 8) AS "N",
round(avg(value) FILTER (category = 'R'), 8) AS "R" FROM cat GROUP BY 1, 2""")
def category_pivot(spark: SparkSession, d: str) -> DataFrame:
    c = category_panel(spark, d).withColumn("year", F.floor(F.col("month") / 12).cast("long"))
    return c.groupBy("entity", "year").pivot("category", ["A", "N", "R"]).agg(F.round(F.avg("value"), 8))


@query("""SELECT l_suppkey AS entity, l_partkey AS part, count(*)::BIGINT AS n, min(l_orderkey) AS first_order FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("entity"), F.col("l_partkey").alias("part")).agg(
        F.count("*").alias("n"), F.min("l_orderkey").alias("first_order")
    ).where("n > 1")


@query("""SELECT o_custkey AS customer, o_orderkey AS order_key, o_orderstatus AS status FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def dedup_keep_last(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    found = P.latest(o, ["o_custkey"], F.col("o_orderdate").desc(), F.col("o_orderkey").desc())
    return found.select(F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("order_key"), F.col("o_orderstatus").alias("status"))


@query(f"""WITH {SQL_PANEL}, g AS (SELECT entity, month FROM (SELECT DISTINCT entity FROM panel) CROSS JOIN (SELECT DISTINCT month FROM panel)),
w AS (SELECT entity, month, value FROM g LEFT JOIN panel USING (entity, month))
SELECT entity, month, last_value(value IGNORE NULLS) OVER (PARTITION BY entity ORDER BY month ROWS UNBOUNDED PRECEDING) AS filled FROM w""")
def forward_filled(spark: SparkSession, d: str) -> DataFrame:
    p = panel(spark, d)
    w = P.grid(p.select("entity").distinct(), p.select("month").distinct()).join(p, ["entity", "month"], "left")
    return w.select("entity", "month", P.forward_fill("value", E).alias("filled"))


@query(f"""WITH {SQL_PANEL}, r AS (SELECT month, value / avg(value) OVER (PARTITION BY entity, month // 12) x FROM panel)
SELECT (month // 12)::BIGINT AS year, (month % 12 + 1)::BIGINT AS moy, round(quantile_cont(x, 0.5), 6) AS profile, count(*)::BIGINT AS n FROM r GROUP BY 1, 2""")
def seasonal_profile(spark: SparkSession, d: str) -> DataFrame:
    year = F.floor(F.col("month") / 12).cast("long")
    r = panel(spark, d).withColumn("year", year)
    r = r.withColumn("x", F.col("value") / F.avg("value").over(Window.partitionBy("entity", "year")))
    r = r.select("year", (F.col("month") % 12 + 1).alias("moy"), "x")
    middle = medians(r, "x", ["year", "moy"], "profile")  # a row a month
    return r.groupBy("year", "moy").agg(F.count("*").alias("n")).join(F.broadcast(middle), ["year", "moy"]).withColumn("profile", F.round("profile", 6))


@query("""SELECT l_returnflag AS flag, round(quantile_cont(l_extendedprice, 0.1), 6) AS p10, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.999), 6) AS p999 FROM lineitem GROUP BY 1
UNION ALL SELECT 'all', round(quantile_cont(l_extendedprice, 0.1), 6), round(quantile_cont(l_extendedprice, 0.5), 6), round(quantile_cont(l_extendedprice, 0.999), 6) FROM lineitem""")
def price_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact quantiles of all lines, and of three flags: groups that grow with the table, so they are always refined, never gathered."""
    li, levels = read(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_extendedprice"), [0.1, 0.5, 0.999]
    both = quantiles(li, "l_extendedprice", levels, ["flag"], small=0).unionByName(quantiles(li, "l_extendedprice", levels, small=0).withColumn("flag", F.lit("all")))
    return both.select("flag", *(F.round(F.col("q")[k], 6).alias(n) for k, n in enumerate(("p10", "p50", "p999"))))


@query(f"""WITH m AS (SELECT {MI.format('o_orderdate')} AS month, avg(o_totalprice) v FROM orders GROUP BY 1)
SELECT month, round(v, 4) AS mean, round(v / lag(v) OVER (ORDER BY month) - 1, 6) AS change FROM m""")
def monthly_resample_change(spark: SparkSession, d: str) -> DataFrame:
    """A national series: one row a month, so the global window is over a calendar only."""
    m = read(spark, d, "orders").groupBy(P.month_idx("o_orderdate").alias("month")).agg(F.avg("o_totalprice").alias("v"))
    return m.select("month", F.round("v", 4).alias("mean"), F.round(F.col("v") / F.lag("v").over(Window.orderBy("month")) - 1, 6).alias("change"))


@query(f"""WITH {SQL_PANEL}, g AS (SELECT entity, month, ln(value / lag(value) OVER (PARTITION BY entity ORDER BY month)) x FROM panel)
SELECT entity, month, round(CASE WHEN x IS NOT NULL THEN greatest(least(x, 1.5::DOUBLE), -1.5::DOUBLE) END, 6) AS clipped FROM g""")
def clipped_growth(spark: SparkSession, d: str) -> DataFrame:
    g = panel(spark, d).withColumn("x", P.log_growth(F.col("value"), P.lag_rows("value", 1, E)))
    return g.select("entity", "month", F.round(P.clip(F.col("x"), -1.5, 1.5), 6).alias("clipped"))


@query(f"""WITH {SQL_PANEL}, f AS (SELECT p.entity, p.month, a.value AS lag1, b.value AS lag12 FROM panel p
LEFT JOIN panel a ON a.entity = p.entity AND a.month = p.month - 1 LEFT JOIN panel b ON b.entity = p.entity AND b.month = p.month - 12),
u AS (SELECT month, unnest([('lag1', (lag1 IS NOT NULL)::INT), ('lag12', (lag12 IS NOT NULL)::INT)]) AS x, max(month) OVER () AS top FROM f)
SELECT x[1] AS feature, round(avg(x[2]), 6) AS complete, round(avg(x[2]) FILTER (month = top), 6) AS complete_last FROM u GROUP BY 1""")
def feature_completeness(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.features import completeness

    f = panel(spark, d).select("entity", "month", P.lag_months("value", 1, E).alias("lag1"), P.lag_months("value", 12, E).alias("lag12"))
    return completeness(f, ["lag1", "lag12"])


@query(f"""WITH {SQL_PANEL}, y AS (SELECT (month // 12)::BIGINT AS year, count(DISTINCT month) m FROM panel GROUP BY 1), t AS (SELECT max(year) AS y FROM y WHERE m = 12)
SELECT entity, round(avg(value), 8) AS mean, count(*)::BIGINT AS months FROM panel, t WHERE month // 12 = y GROUP BY 1""")
def latest_complete_year(spark: SparkSession, d: str) -> DataFrame:
    p = panel(spark, d).withColumn("year", F.floor(F.col("month") / 12).cast("long"))
    years = p.groupBy("year").agg(F.countDistinct("month").alias("m")).where("m = 12").agg(F.max("year").alias("year"))
    return p.join(F.broadcast(years), "year").groupBy("entity").agg(F.round(F.avg("value"), 8).alias("mean"), F.count("*").alias("months"))


@query("""SELECT p_partkey AS part, p_type AS label, regexp_matches(lower(p_type), 'economy|promo') AND regexp_matches(lower(p_brand), '#[1-3]') AS kept FROM part""")
def label_filters(spark: SparkSession, d: str) -> DataFrame:
    """All parts, split by whether each pattern matches one of the label columns that it names."""
    p, kept = read(spark, d, "part"), F.lit(True)
    patterns = {"economy|promo": ["p_type"], "#[1-3]": ["p_brand"]}
    for pattern, cols in patterns.items():
        kept &= F.exists(F.array(*(F.lower(c) for c in cols)), lambda c: c.rlike(pattern))
    return p.select(F.col("p_partkey").alias("part"), F.col("p_type").alias("label"), kept.alias("kept"))


@query(f"""WITH {SQL_PANEL}, z AS (SELECT entity, month, ln(value / lag(value) OVER (PARTITION BY entity ORDER BY month)) x FROM panel)
SELECT entity, month, round(x, 6) AS x FROM z WHERE x IS NOT NULL ORDER BY abs(x) DESC, entity, month LIMIT 12""")
def largest_moves(spark: SparkSession, d: str) -> DataFrame:
    """A report of the twelve largest moves."""
    z = panel(spark, d).withColumn("x", P.log_growth(F.col("value"), P.lag_rows("value", 1, E))).where("x is not null")
    return z.orderBy(F.abs("x").desc(), "entity", "month").limit(12).select("entity", "month", F.round("x", 6).alias("x"))


@query(f"""WITH {SQL_CAT} SELECT entity, category, month, value FROM cat QUALIFY row_number() OVER (PARTITION BY entity, category ORDER BY value DESC, month) <= 3""")
def top3_months(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy(*EC).orderBy(F.col("value").desc(), "month")
    return category_panel(spark, d).withColumn("r", F.row_number().over(w)).where("r <= 3").select(*EC, "month", "value")


@query(f"""WITH {SQL_CAT} SELECT entity, month, category, value FROM cat QUALIFY row_number() OVER
(PARTITION BY entity, month ORDER BY CASE category WHEN 'R' THEN 0 WHEN 'N' THEN 1 ELSE 2 END, value DESC) = 1""")
def category_order_dedup(spark: SparkSession, d: str) -> DataFrame:
    rank = F.when(F.col("category") == "R", 0).when(F.col("category") == "N", 1).otherwise(2)
    return P.latest(category_panel(spark, d), ["entity", "month"], rank, F.col("value").desc()).select("entity", "month", "category", "value")


@query(f"""WITH {SQL_PANEL}, s AS (SELECT entity, min(month) a, max(month) b FROM panel GROUP BY 1), g AS (SELECT entity, unnest(generate_series(a, b)) AS month FROM s)
SELECT entity, month FROM g EXCEPT SELECT entity, month FROM panel""")
def month_gaps(spark: SparkSession, d: str) -> DataFrame:
    p = panel(spark, d).select("entity", "month")
    return P.densify(p, E).select("entity", "month").join(p, ["entity", "month"], "left_anti")


@query("""SELECT 'order' AS kind, o_orderkey AS key, NULL::DOUBLE AS quantity, o_totalprice AS price FROM orders
UNION ALL SELECT 'line', l_orderkey, l_quantity, NULL FROM lineitem""")
def concatenated_frames(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("price"))
    li = read(spark, d, "lineitem").select(F.lit("line").alias("kind"), F.col("l_orderkey").alias("key"), F.col("l_quantity").alias("quantity"))
    return o.unionByName(li, allowMissingColumns=True)


@query("""SELECT c_nationkey AS nation, round(c_acctbal / 100)::BIGINT AS hundreds FROM customer UNION SELECT s_nationkey, round(s_acctbal / 100)::BIGINT FROM supplier""")
def union_distinct(spark: SparkSession, d: str) -> DataFrame:
    shown = lambda k: (F.col(f"{k}_nationkey").alias("nation"), F.round(F.col(f"{k}_acctbal") / 100).cast("long").alias("hundreds"))
    return read(spark, d, "customer").select(*shown("c")).union(read(spark, d, "supplier").select(*shown("s"))).distinct()


@query("""WITH t AS (SELECT DISTINCT o_custkey, unnest(regexp_extract_all(o_orderpriority, '[A-Z]{3,}')) AS root FROM orders WHERE o_custkey IS NOT NULL),
r AS (SELECT DISTINCT root FROM t), m AS (SELECT a.root AS left_root, b.root AS right_root, count(*)::BIGINT AS common FROM t a JOIN t b USING (o_custkey) WHERE a.root < b.root GROUP BY 1, 2)
SELECT x.root AS left_root, y.root AS right_root, coalesce(common, 0)::BIGINT AS common FROM r x JOIN r y ON x.root < y.root LEFT JOIN m ON left_root = x.root AND right_root = y.root""")
def candidate_set_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Overlap of the candidate sets of roots: for each pair of priority words, the customers that have both."""
    o = read(spark, d, "orders")
    return root_overlap(o.select("o_custkey", F.explode(F.regexp_extract_all("o_orderpriority", F.lit("[A-Z]{3,}"), F.lit(0))).alias("root")))


def root_overlap(members: DataFrame, member: str = "o_custkey") -> DataFrame:
    """(left_root, right_root, common) of all pairs of roots; only the few roots of one member ever meet in a row."""
    own = members.where(F.col(member).isNotNull()).groupBy(member).agg(F.array_sort(F.collect_set("root")).alias("roots"))
    left = own.select("roots", F.posexplode("roots").alias("i", "left_root"))
    met = left.select("left_root", F.explode(F.expr("slice(roots, i + 2, size(roots))")).alias("right_root"))
    met = met.groupBy("left_root", "right_root").agg(F.count("*").alias("common"))
    roots = members.select("root").distinct()
    pairs = roots.toDF("left_root").join(roots.toDF("right_root"), F.col("left_root") < F.col("right_root"))
    return pairs.join(met, ["left_root", "right_root"], "left").select("left_root", "right_root", F.coalesce("common", F.lit(0)).cast("long").alias("common"))


@query(f"""WITH {SQL_CAT} SELECT entity, month, list_sort(list_filter(['A', 'N', 'R'], lambda x: NOT list_contains(list(category), x)))::VARCHAR AS missing FROM cat GROUP BY 1, 2
HAVING count(*) < 3""".replace("list_filter(['A', 'N', 'R'], lambda x: NOT list_contains(list(category), x))", "[x FOR x IN ['A', 'N', 'R'] IF NOT list_contains(list(category), x)]"))
def missing_members(spark: SparkSession, d: str) -> DataFrame:
    m = category_panel(spark, d).groupBy("entity", "month").agg(F.collect_set("category").alias("have"))
    missing = F.array_sort(F.array_except(F.array(F.lit("A"), F.lit("N"), F.lit("R")), F.col("have")))
    return m.where(F.size("have") < 3).select("entity", "month", F.concat(F.lit("["), F.array_join(missing, ", "), F.lit("]")).alias("missing"))
