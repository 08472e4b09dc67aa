"""Forecast and evaluation queries on the complete monthly panel: seven origins, horizons one to three."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators import forecast as M
from ..operators import nulltest as N
from ..operators import panel as P
from ..operators import trend as T
from ..operators.detect import lcg
from ..operators.quantiles import medians
from ..session import checkpointed, stored
from .base import S_FIRST, S_LAST, SQL_CAT, SQL_FULL, SQL_PANEL, SQL_PLACES, Setting, category_panel, places, query, setting
from .detect_queries import SQL_LCG

HORIZONS = (1, 2, 3)
MEMBERS = ("seasonal", "drift", "national")


def full(at: Setting) -> DataFrame:
    """The complete series, checkpointed: every model of a query reads them."""
    return checkpointed(P.full_history(at.panel, ["entity"], at.first, at.last))


def national_growth(p: DataFrame) -> DataFrame:
    """(month, growth) of the national total; one row a month."""
    total = p.groupBy("month").agg(F.round(F.sum("value"), 2).alias("v"))
    return total.withColumn("growth", F.col("v") / F.lag("v", 12).over(Window.orderBy("month")) - 1).where("growth is not null").select("month", "growth")


def predictions(at: Setting, models: tuple[str, ...] = ("naive", "seasonal", "drift", "national", "factor")) -> DataFrame:
    p = full(at)
    pts = M.points(p, at.origins, HORIZONS)
    make = {
        "naive": lambda: M.naive(p, pts),
        "seasonal": lambda: M.seasonal(p, pts),
        "drift": lambda: M.seasonal_drift(p, pts),
        "national": lambda: M.seasonal_national(p, pts, national_growth(p)),
        "factor": lambda: M.factor_only(M.common_factor(p), pts),
    }
    out = None
    for name in models:
        one = make[name]().select(F.lit(name).alias("model"), "entity", "origin", "h", "month", "yhat")
        out = one if out is None else out.unionByName(one)
    return M.with_fact(out, p)


def shown(pred: DataFrame) -> DataFrame:
    return pred.select("model", "entity", "origin", F.col("h").cast("long").alias("h"), "month", "y", F.round("yhat", 4).alias("yhat"))


def _origins(count: int = 7) -> str:
    """The last ``count`` of the seven origins."""
    return f"(SELECT z - 3 - i AS o FROM win, range({count}) q(i))"


_CUT, _LATEST = f"({S_LAST} - 6)", f"({S_LAST} - 3)"
SQL_PTS = f"""pts AS (SELECT entity, o::BIGINT AS origin, h::BIGINT AS h, (o + h)::BIGINT AS month FROM (SELECT DISTINCT entity FROM full_panel),
{_origins()} a(o), (VALUES (1), (2), (3)) b(h))"""
SQL_NAT = """nt AS (SELECT month, round(sum(value), 2) v FROM full_panel GROUP BY 1), ng AS (SELECT a.month, a.v / b.v - 1 AS growth FROM nt a JOIN nt b ON b.month = a.month - 12)"""
_PTS = "SELECT '{0}' AS model, p.entity, p.origin, p.h, p.month, {1} AS yhat FROM pts p LEFT JOIN full_panel s ON s.entity = p.entity AND s.month = p.month - 12"
_FACTOR = """LEFT JOIN lv ON lv.entity = p.entity AND lv.month = p.origin LEFT JOIN {0} f0 ON {1}f0.month = p.origin LEFT JOIN {0} ft ON {2}ft.month = p.month - 12
LEFT JOIN gr_{0} g ON {3}g.month = p.origin"""
SQL_LV = "lv AS (SELECT entity, month, ln(value) AS l FROM full_panel)"
SQL_FNAT = """nf AS (SELECT month, quantile_cont(l, 0.5) AS f FROM lv GROUP BY 1),
gr_nf AS (SELECT a.month, avg(x.f - y.f) AS growth FROM nf a JOIN nf x ON x.month BETWEEN a.month - 2 AND a.month JOIN nf y ON y.month = x.month - 12 GROUP BY 1 HAVING count(*) = 3)"""
SQL_MODELS = {
    "naive": "SELECT 'naive' AS model, p.entity, p.origin, p.h, p.month, s.value AS yhat FROM pts p JOIN full_panel s ON s.entity = p.entity AND s.month = p.origin",
    "seasonal": _PTS.format("seasonal", "s.value"),
    "drift": _PTS.format("drift", """s.value * (SELECT sum(n.value) FROM full_panel n WHERE n.entity = p.entity AND n.month BETWEEN p.origin - 2 AND p.origin)
/ (SELECT sum(n.value) FROM full_panel n WHERE n.entity = p.entity AND n.month BETWEEN p.origin - 14 AND p.origin - 12)"""),
    "national": _PTS.format("national", "s.value * (1 + (SELECT arg_max(growth, ng.month) FROM ng WHERE ng.month <= p.origin - 1))"),
    "factor": "SELECT 'factor' AS model, p.entity, p.origin, p.h, p.month, exp(ft.f + g.growth + lv.l - f0.f) AS yhat FROM pts p " + _FACTOR.format("nf", "", "", ""),
}
SQL_PRED = f"""{SQL_PANEL}, {SQL_FULL}, {SQL_PTS}, {SQL_NAT}, {SQL_LV}, {SQL_FNAT}, pr AS ({' UNION ALL '.join(SQL_MODELS.values())}),
pred AS (SELECT pr.*, y.value AS y FROM pr LEFT JOIN full_panel y ON y.entity = pr.entity AND y.month = pr.month)"""


def _sql_model(name: str) -> str:
    return f"WITH {SQL_PRED} SELECT model, entity, origin, h, month, y, round(yhat, 4) AS yhat FROM pred WHERE model = '{name}'"


@query(_sql_model("naive"))
def backtest_naive(spark: SparkSession, d: str) -> DataFrame:
    return shown(predictions(setting(spark, d), ("naive",)))


@query(_sql_model("seasonal"))
def backtest_seasonal(spark: SparkSession, d: str) -> DataFrame:
    return shown(predictions(setting(spark, d), ("seasonal",)))


@query(_sql_model("drift"))
def backtest_drift(spark: SparkSession, d: str) -> DataFrame:
    return shown(predictions(setting(spark, d), ("drift",)))


@query(_sql_model("national"))
def backtest_national(spark: SparkSession, d: str) -> DataFrame:
    return shown(predictions(setting(spark, d), ("national",)))


@query(_sql_model("factor"))
def factor_only_forecast(spark: SparkSession, d: str) -> DataFrame:
    return shown(predictions(setting(spark, d), ("factor",)))


@query(f"WITH {SQL_PANEL}, {SQL_FULL}, {SQL_LV}, {SQL_FNAT} SELECT entity, month, round(l - f, 6) AS deviation, round(f, 6) AS factor FROM lv JOIN nf USING (month)")
def factor_national(spark: SparkSession, d: str) -> DataFrame:
    f = M.common_factor(full(setting(spark, d)))
    return f.select("entity", "month", F.round(F.col("l") - F.col("f"), 6).alias("deviation"), F.round("f", 6).alias("factor"))


@query(f"""WITH {SQL_PANEL}, {SQL_FULL}, {SQL_PLACES}, {SQL_LV}, {SQL_FNAT}, r AS (SELECT region, month, quantile_cont(l, 0.5) AS f FROM lv JOIN places USING (entity) GROUP BY 1, 2),
s AS (SELECT region, count(DISTINCT entity) AS n FROM lv JOIN places USING (entity) GROUP BY 1)
SELECT entity, lv.month, region, round(nf.f + (r.f - nf.f) * n / (n + 10.0::DOUBLE), 6) AS factor FROM lv JOIN places USING (entity) JOIN nf ON nf.month = lv.month
JOIN r USING (region) JOIN s USING (region) WHERE r.month = lv.month""")
def factor_regional(spark: SparkSession, d: str) -> DataFrame:
    p = full(setting(spark, d)).join(places(spark, d).select("entity", "region"), "entity", "left")
    return M.common_factor(p, 10.0).join(places(spark, d), "entity").select("entity", "month", "region", F.round("f", 6).alias("factor"))


@query(f"""WITH {SQL_PRED}, c AS (SELECT *, y - avg(y) OVER (PARTITION BY model, entity, origin) AS yc FROM pred WHERE y IS NOT NULL AND yhat IS NOT NULL)
SELECT model, coalesce(h, -1) AS h, coalesce(origin, -1) AS origin, count(*)::BIGINT AS n, round(avg(abs(y - yhat)), 4) AS mae, round(sum(abs(y - yhat)) / sum(abs(y)), 6) AS wape,
round(1 - sum((y - yhat) ** 2) / (sum(y * y) - sum(y) ** 2 / count(*)), 5) AS r2, round(1 - sum((y - yhat) ** 2) / sum(yc * yc), 5) AS r2_within
FROM c GROUP BY GROUPING SETS ((model), (model, h), (model, origin)) HAVING sum(yc * yc) > 0""")
def metric_cuts(spark: SparkSession, d: str) -> DataFrame:
    m = E.metric_cuts(predictions(setting(spark, d))).where("r2_within is not null")
    digits = {"mae": 4, "wape": 6, "r2": 5, "r2_within": 5}
    return m.select("model", F.col("h").cast("long").alias("h"), "origin", "n", *(F.round(c, k).alias(c) for c, k in digits.items()))


@query(f"""WITH {SQL_PRED} SELECT entity, origin, h, month, any_value(y) AS y, round(avg(yhat), 4) AS yhat FROM pred WHERE model IN ('seasonal', 'drift', 'national') AND yhat IS NOT NULL
GROUP BY 1, 2, 3, 4 HAVING count(*) = 3""")
def ensemble_mean(spark: SparkSession, d: str) -> DataFrame:
    found = E.ensemble_mean(predictions(setting(spark, d), MEMBERS), MEMBERS, "ens_mean")
    return found.select("entity", "origin", F.col("h").cast("long").alias("h"), "month", "y", F.round("yhat", 4).alias("yhat"))


@query(f"""WITH {SQL_PRED}, b AS (SELECT a.model AS a, b.model AS b, k, a.origin, a.month, abs(a.y - (k * a.yhat + (10 - k) * b.yhat) / 10) AS e FROM pred a JOIN pred b
USING (entity, origin, h, month), range(11) r(k) WHERE a.model < b.model), s AS (SELECT a, b, k, avg(e) FILTER (month <= {_CUT}) AS f, avg(e) FILTER (origin >= {_CUT}) AS t FROM b GROUP BY 1, 2, 3)
SELECT a, b, k / 10 AS weight, round(f, 4) AS mae_fit, round(t, 4) AS mae_test FROM s QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY round(f, 6), k) = 1""")
def pair_blend_grid(spark: SparkSession, d: str) -> DataFrame:
    at = setting(spark, d)
    found = E.pair_blends(predictions(at), at.cut)
    return found.select("a", "b", "weight", F.round("mae_fit", 4).alias("mae_fit"), F.round("mae_test", 4).alias("mae_test"))


@query(f"""WITH {SQL_PRED}, c AS (SELECT o AS o_at, pred.* FROM pred, {_origins(5)} v(o)),
pa AS (SELECT o_at, model, avg(abs(y - yhat)) AS past FROM c WHERE month <= o_at GROUP BY 1, 2), pk AS (SELECT *, row_number() OVER (PARTITION BY o_at ORDER BY round(past, 6), model) AS rank FROM pa),
t AS (SELECT c.o_at, entity, h, any_value(y) AS y, avg(yhat) a_mean, quantile_cont(yhat, 0.5) a_median, avg(yhat) FILTER (rank <= 1) a_best, avg(yhat) FILTER (rank <= 3) a_top3,
avg(yhat) FILTER (rank <= 5) a_top5, sum(yhat / past) FILTER (rank <= 5) / sum(1 / past) FILTER (rank <= 5) a_inv FROM c JOIN pk USING (o_at, model) WHERE origin = c.o_at GROUP BY 1, 2, 3),
u AS (SELECT o_at, y, unnest(['mean', 'median', 'best', 'top3', 'top5', 'inverse_mae']) AS way, unnest([a_mean, a_median, a_best, a_top3, a_top5, a_inv]) AS v FROM t)
SELECT way, o_at::BIGINT AS origin, round(avg(abs(y - v)), 4) AS mae FROM u GROUP BY 1, 2""")
def rolling_selection(spark: SparkSession, d: str) -> DataFrame:
    at = setting(spark, d)
    return E.rolling_selection(predictions(at), at.origins[2:]).select("way", F.col("origin").cast("long").alias("origin"), F.round("mae", 4).alias("mae"))


@query()
def greedy_selection(spark: SparkSession, d: str) -> DataFrame:
    """Members chosen greedily on what is known at the fourth origin, and the error of each prediction's mean after it."""
    at = setting(spark, d)
    pred = checkpointed(predictions(at))
    chosen = E.greedy_selection(pred, at.cut)
    counts = {m: chosen.count(m) for m in chosen}
    weight = F.element_at(F.create_map(*(F.lit(x) for kv in counts.items() for x in kv)), F.col("model"))
    some = pred.where(F.col("model").isin(list(counts)) & (F.col("origin") >= at.cut)).withColumn("w", weight)
    mean = some.groupBy(*E.POINT).agg(F.first("y").alias("y"), (F.sum(F.col("w") * F.col("yhat")) / F.sum("w")).alias("yhat"))
    return mean.groupBy("origin").agg(F.lit("+".join(chosen)).alias("members"), F.round(F.avg(F.abs(F.col("y") - F.col("yhat"))), 4).alias("mae"))


SQL_PARTS = """pp AS (SELECT *, ln(y / yhat) AS r FROM {0} WHERE y > 0 AND yhat > 0), pc AS (SELECT *, quantile_cont(r, 0.5) OVER (PARTITION BY {1}model, origin, h) AS common FROM pp),
cm AS (SELECT DISTINCT {1}model, origin, h, common FROM pc),
bd AS (SELECT {2}pc.model, pc.h, quantile_cont(pc.r - pc.common + cm.common, 0.1) AS lo, quantile_cont(pc.r - pc.common + cm.common, 0.9) AS hi
FROM pc JOIN cm ON cm.model = pc.model AND cm.h = pc.h{3} GROUP BY ALL)"""


@query(f"WITH {SQL_PRED}, {SQL_PARTS.format('pred', '', '', '')} SELECT model, h, round(exp(lo) - 1, 6) AS lo, round(exp(hi) - 1, 6) AS hi FROM bd")
def error_band(spark: SparkSession, d: str) -> DataFrame:
    return E.error_band(predictions(setting(spark, d))).select("model", F.col("h").cast("long").alias("h"), F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@query(f"WITH {SQL_PRED} SELECT model, h, round(quantile_cont(y / yhat - 1, 0.1), 6) AS lo, round(quantile_cont(y / yhat - 1, 0.9), 6) AS hi FROM pred WHERE y IS NOT NULL GROUP BY 1, 2")
def raw_band(spark: SparkSession, d: str) -> DataFrame:
    return E.raw_band(predictions(setting(spark, d))).select("model", F.col("h").cast("long").alias("h"), F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@query(f"""WITH {SQL_PRED}, at_ AS (SELECT o AS o_at, pred.* FROM pred, {_origins(4)} v(o)), known AS (SELECT * FROM at_ WHERE month <= o_at),
{SQL_PARTS.format('known', 'o_at, ', 'pc.o_at, ', ' AND cm.o_at = pc.o_at')}, t AS (SELECT a.*, exp(lo) - 1 AS lo, exp(hi) - 1 AS hi FROM at_ a LEFT JOIN bd USING (o_at, model, h) WHERE origin = a.o_at)
SELECT model, o_at::BIGINT AS origin, round(avg(coalesce((y / yhat - 1 BETWEEN lo AND hi)::INT, 0)), 6) AS coverage, round(avg(hi - lo), 5) AS width, count(*)::BIGINT AS n FROM t GROUP BY 1, 2""")
def rolling_coverage(spark: SparkSession, d: str) -> DataFrame:
    at = setting(spark, d)
    found = E.rolling_coverage(predictions(at), at.origins[3:])
    return found.select("model", F.col("origin").cast("long").alias("origin"), F.round("coverage", 6).alias("coverage"), F.round("width", 5).alias("width"), "n")


@query(f"""WITH {SQL_PRED} SELECT a.model AS a, b.model AS b, round(corr(a.y - a.yhat, b.y - b.yhat), 6) AS corr FROM pred a JOIN pred b USING (entity, origin, h, month) WHERE a.model < b.model GROUP BY 1, 2""")
def error_correlation(spark: SparkSession, d: str) -> DataFrame:
    return E.error_correlation(predictions(setting(spark, d))).withColumn("corr", F.round("corr", 6))


@query(f"""WITH {SQL_PRED}, e AS (SELECT model, entity, avg(abs(y / yhat - 1)) AS ape FROM pred WHERE model NOT LIKE 'ens_%' GROUP BY 1, 2),
b AS (SELECT arg_min(model, m) AS model FROM (SELECT model, round(avg(abs(y - yhat)), 6) AS m FROM pred WHERE model NOT LIKE 'ens_%' GROUP BY 1))
SELECT entity, model, round(ape, 6) AS ape FROM e JOIN b USING (model) ORDER BY ape DESC, entity LIMIT 15""")
def worst_entities(spark: SparkSession, d: str) -> DataFrame:
    """A report: the fifteen series on which the best honest model errs most."""
    pred = predictions(setting(spark, d)).where(~F.col("model").startswith("ens_"))
    best = E.metrics(pred).agg(F.min_by("model", F.round("mae", 6)).alias("model"))
    ape = pred.join(F.broadcast(best), "model").groupBy("entity", "model").agg(F.avg(F.abs(F.col("y") / F.col("yhat") - 1)).alias("ape"))
    return ape.orderBy(F.desc("ape"), "entity").limit(15).withColumn("ape", F.round("ape", 6))


_H = (1, 3, 6, 12)


@query(f"""WITH {SQL_PANEL}, {SQL_FULL}, q AS (SELECT entity, h, t AS month, t - h AS origin FROM (SELECT DISTINCT entity FROM full_panel), (SELECT z - i AS t FROM win, range(6) q(i)) a(t),
(VALUES (1), (3), (6), (12), (18)) b(h)), f AS (SELECT q.*, y.value AS y, CASE WHEN h <= 12 THEN s.value END AS yhat FROM q JOIN full_panel y ON y.entity = q.entity AND y.month = q.month
JOIN full_panel s ON s.entity = q.entity AND s.month = q.month - 12)
SELECT h::BIGINT AS h, count(*)::BIGINT AS n, round(avg((yhat IS NOT NULL)::INT), 6) AS coverage, round(CASE WHEN count(yhat) = count(*) THEN avg(abs(y - yhat)) END, 4) AS mae FROM f GROUP BY 1""")
def horizon_coverage(spark: SparkSession, d: str) -> DataFrame:
    """All horizons on the same target months; a horizon that isn't fully covered has no error figure."""
    at = setting(spark, d)
    p = full(at)
    pts = p.where(F.col("month").between(at.last - 5, at.last)).select("entity", "month").withColumn("h", F.explode(F.array(*map(F.lit, (*_H, 18)))))
    pts = pts.withColumn("origin", F.col("month") - F.col("h"))
    made = pts.join(M.seasonal(p, pts).select("entity", "h", "month", "yhat"), ["entity", "h", "month"], "left")
    whole = F.count("yhat") == F.count("*")
    return M.with_fact(made, p).groupBy(F.col("h").cast("long").alias("h")).agg(
        F.count("*").alias("n"),
        F.round(F.avg(F.col("yhat").isNotNull().cast("int")), 6).alias("coverage"),
        F.round(F.when(whole, F.avg(F.abs(F.col("y") - F.col("yhat")))), 4).alias("mae"),
    )


def _hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """(entity, origin, h, month, category, yhat, total, y, err, err_total): seasonal drift of a nation's flags and of its total."""
    keys = ["entity", "category"]
    at = setting(spark, d)
    named = category_panel(spark, d).join(places(spark, d), "entity").groupBy(F.col("nation").alias("entity"), "category", "month")
    cat = checkpointed(P.full_history(named.agg(F.round(F.sum("value"), 2).alias("value")), keys, at.first, at.last))
    three = cat.groupBy("entity", "month").agg(F.count("*").alias("k"), F.round(F.sum("value"), 2).alias("value")).where("k = 3").drop("k")
    cat = cat.join(three.select("entity", "month"), ["entity", "month"], "left_semi")
    parts = M.with_fact(M.seasonal_drift(cat, M.points(cat, at.origins, HORIZONS, keys), keys=keys), cat, keys)
    total = M.with_fact(M.seasonal_drift(three, M.points(three, at.origins, HORIZONS)), three)

    def known(pred: DataFrame, by: list[str]) -> DataFrame:
        """Root mean square relative error of targets up to each origin."""
        errors = pred.select(*by, "month", ((F.col("y") - F.col("yhat")) / F.col("yhat")).alias("e"))
        o = pred.select("origin").distinct()
        return errors.join(F.broadcast(o), errors.month <= o.origin).groupBy(*by, "origin").agg(F.sqrt(F.avg(F.col("e") ** 2)).alias("s"))

    parts = parts.join(known(parts, keys).withColumnRenamed("s", "err"), [*keys, "origin"], "left")
    total = total.join(known(total, ["entity"]).withColumnRenamed("s", "err_total"), ["entity", "origin"], "left")
    return parts.join(total.select("entity", "origin", "h", "month", F.col("yhat").alias("total"), "err_total"), ["entity", "origin", "h", "month"])


_DRIFT = """SELECT {k}, p.origin, p.h, p.month, b.value * (SELECT sum(n.value) FROM {t} n WHERE {on} AND n.month BETWEEN p.origin - 2 AND p.origin)
/ (SELECT sum(n.value) FROM {t} n WHERE {on} AND n.month BETWEEN p.origin - 14 AND p.origin - 12) AS yhat, y.value AS y
FROM (SELECT DISTINCT {d}, o::BIGINT AS origin, h::BIGINT AS h, (o + h)::BIGINT AS month FROM {t}, ORIGINS a(o), (VALUES (1), (2), (3)) b(h)) p
JOIN {t} b ON {bo} AND b.month = p.month - 12 JOIN {t} y ON {yo} AND y.month = p.month""".replace("ORIGINS", _origins())
SQL_HIER = f"""{SQL_PANEL}, {SQL_CAT}, {SQL_PLACES}, nc AS (SELECT nation AS entity, category, month, round(sum(value), 2) AS value FROM cat JOIN places USING (entity) GROUP BY 1, 2, 3),
c0 AS (SELECT entity, category, month, value FROM nc WHERE month BETWEEN {S_FIRST} AND {S_LAST} AND (entity, category) IN (SELECT (entity, category) FROM nc
WHERE month BETWEEN {S_FIRST} AND {S_LAST} GROUP BY entity, category HAVING count(*) = {S_LAST} - {S_FIRST} + 1)),
th AS (SELECT entity, month, round(sum(value), 2) AS value FROM c0 GROUP BY 1, 2 HAVING count(*) = 3), c3 AS (SELECT * FROM c0 WHERE entity IN (SELECT entity FROM th)),
pa AS ({_DRIFT.format(k='p.entity, p.category', t='c3', d='entity, category', on='n.entity = p.entity AND n.category = p.category', bo='b.entity = p.entity AND b.category = p.category', yo='y.entity = p.entity AND y.category = p.category')}),
tp AS ({_DRIFT.format(k='p.entity', t='th', d='entity', on='n.entity = p.entity', bo='b.entity = p.entity', yo='y.entity = p.entity')}),
os AS (SELECT DISTINCT origin FROM pa), pe AS (SELECT entity, category, os.origin, sqrt(avg(((y - yhat) / yhat) ** 2)) AS s FROM pa JOIN os ON pa.month <= os.origin GROUP BY 1, 2, 3),
te AS (SELECT entity, os.origin, sqrt(avg(((y - yhat) / yhat) ** 2)) AS s FROM tp JOIN os ON tp.month <= os.origin GROUP BY 1, 2),
hi AS (SELECT pa.*, tp.yhat AS total, pe.s AS err, te.s AS err_total FROM pa JOIN tp USING (entity, origin, h, month) LEFT JOIN pe USING (entity, category, origin) LEFT JOIN te USING (entity, origin))"""


def _reconciled(method: str):
    part, top = {
        "bottom_up": ("0.0::DOUBLE", "1.0::DOUBLE"), "ols": ("1.0::DOUBLE", "1.0::DOUBLE"), "wls_level": ("yhat ** 2", "total ** 2"),
        "wls_error": ("(err * yhat) ** 2", "(err_total * total) ** 2"),
    }[method]
    sql = f"""WITH {SQL_HIER} SELECT entity, category, origin, h, round(yhat + coalesce((total - sum(yhat) OVER w) * {part} / nullif({top} + sum({part}) OVER w, 0), 0), 4) AS reconciled
FROM hi WINDOW w AS (PARTITION BY entity, origin, h)"""

    def run(spark: SparkSession, d: str) -> DataFrame:
        found = M.reconcile(_hierarchy(spark, d), method, ["entity", "origin", "h"])
        return found.select("entity", "category", "origin", F.col("h").cast("long").alias("h"), F.round("reconciled", 4).alias("reconciled"))

    run.__name__ = f"reconcile_{method}"
    run.__module__ = __name__
    return query(sql)(run)


for _method in ("bottom_up", "ols", "wls_level", "wls_error"):
    _reconciled(_method)

SEEDS = 19


@query(f"""WITH {SQL_PANEL}, {SQL_FULL}, g AS (SELECT a.entity, a.month, ln(a.value / b.value) AS g, ln(c.value / e.value) AS x FROM full_panel a JOIN full_panel b ON b.entity = a.entity AND b.month = a.month - 12
JOIN full_panel c ON c.entity = a.entity AND c.month = a.month - 1 JOIN full_panel e ON e.entity = a.entity AND e.month = a.month - 13),
s AS (SELECT entity, month, g, x, seed, row_number() OVER (PARTITION BY seed, month ORDER BY {SQL_LCG.format('entity', '(seed * 131 + month)')}, entity) AS r,
row_number() OVER (PARTITION BY seed, month ORDER BY entity) AS i FROM g, range(1, {SEEDS + 1}) q(seed)),
n AS (SELECT a.seed, avg(abs(b.g - a.x)) AS mae FROM s a JOIN s b ON a.seed = b.seed AND a.month = b.month AND a.i = b.r GROUP BY 1)
SELECT round((SELECT avg(abs(g - x)) FROM g), 6) AS mae_real, round(min(mae), 6) AS null_min, round(avg(mae), 6) AS null_mean,
round((1 + count(*) FILTER (mae <= (SELECT avg(abs(g - x)) FROM g))) / (1 + count(*)), 6) AS p FROM n""")
def permutation_null(spark: SparkSession, d: str) -> DataFrame:
    """Growth predicted by last month's growth, against targets shuffled among series within each month."""
    p = full(setting(spark, d)).withColumn("b", P.lag_months("value", 12, ["entity"])).withColumn("g", P.log_growth(F.col("value"), F.col("b")))
    g = p.withColumn("x", P.lag_months("g", 1, ["entity"])).where("g is not null and x is not null").select("entity", "month", "g", "x")
    s = g.withColumn("seed", F.explode(F.sequence(F.lit(1), F.lit(SEEDS))))
    w = Window.partitionBy("seed", "month")
    h = F.pmod(F.pmod(F.col("entity") * 1103515 + 12345 + 7919 * (F.col("seed") * 131 + F.col("month")), F.lit(2147483648)) * 48271 + 11, F.lit(2147483647))
    s = s.withColumn("r", F.row_number().over(w.orderBy(h, "entity"))).withColumn("i", F.row_number().over(w.orderBy("entity")))
    shuffled = s.select("seed", "month", F.col("i").alias("at"), "x").join(s.select("seed", "month", F.col("r").alias("at"), "g"), ["seed", "month", "at"])
    null = shuffled.groupBy("seed").agg(F.avg(F.abs(F.col("g") - F.col("x"))).alias("mae"))
    real = g.agg(F.avg(F.abs(F.col("g") - F.col("x"))).alias("real"))
    return null.crossJoin(F.broadcast(real)).agg(  # one row
        F.round(F.first("real"), 6).alias("mae_real"),
        F.round(F.min("mae"), 6).alias("null_min"),
        F.round(F.avg("mae"), 6).alias("null_mean"),
        F.round(E.p_value(F.col("mae"), F.col("real")), 6).alias("p"),
    )


@query(f"""WITH {SQL_PRED}, {SQL_PLACES}, e AS (SELECT nation, sum(abs(a.y - a.yhat) - abs(b.y - b.yhat)) AS s, count(*) AS n FROM pred a JOIN pred b USING (entity, origin, h, month) JOIN places USING (entity)
WHERE a.model = 'drift' AND b.model = 'seasonal' GROUP BY 1), c AS (SELECT row_number() OVER (ORDER BY nation) - 1 AS c, round(s, 4) AS s, n, count(*) OVER () AS k FROM e),
q AS (SELECT draw, slot, {SQL_LCG.format('(draw * 1009 + slot)', 3)} AS z FROM range(200) a(draw), (SELECT c AS slot FROM c)),
m AS (SELECT draw, sum(s) / sum(n) AS mean FROM q JOIN c ON c.c = (z // 97) % k GROUP BY 1)
SELECT round(quantile_cont(mean, 0.025), 4) AS lo, (SELECT round(sum(s) / sum(n), 4) FROM c) AS mean, round(quantile_cont(mean, 0.975), 4) AS hi, count(*)::BIGINT AS draws FROM m""")
def cluster_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Mean error difference of two models, resampling nations (a fixed dimension of 25)."""
    pred = predictions(setting(spark, d), ("drift", "seasonal"))
    wide = pred.groupBy(*E.POINT).pivot("model", ["drift", "seasonal"]).agg(F.first(F.abs(F.col("y") - F.col("yhat"))))
    e = wide.join(places(spark, d), "entity").groupBy("nation").agg(F.round(F.sum(F.col("drift") - F.col("seasonal")), 4).alias("s"), F.count("*").alias("n"))
    clusters = e.select((F.row_number().over(Window.orderBy("nation")) - 1).cast("long").alias("c"), "s", "n")
    found = E.cluster_bootstrap(clusters, 200, lambda draw, slot, k: F.floor(lcg(draw * 1009 + slot, 3) / 97) % k)
    return found.select(*(F.round(c, 4).alias(c) for c in ("lo", "mean", "hi")), "draws")


def _ml(name: str, backend: str, **options):
    def run(spark: SparkSession, d: str) -> DataFrame:
        at = setting(spark, d)
        found = M.global_model(M.supervised(full(at), HORIZONS), at.origins, backend, **options)
        return found.select("entity", "origin", "h", "month", "y", F.round("yhat", 2).alias("yhat"))

    run.__name__ = f"{name}_forecast"
    run.__module__ = __name__
    return query()(run)


for _name, _options in {"ridge": {}, "random_forest": {}, "gbt": {"seeds": (1, 2)}}.items():
    _ml(_name, _name, **_options)
#: What the trees learn is how a series' growth differs from the common one.
_ml("gbt_offset", "gbt", offset="common")


@query()
def learned_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The learned models beside the closed-form ones, on the points that all of them have: overall, by horizon and by origin."""
    at = setting(spark, d)
    pred, rows = predictions(at, ("seasonal", "drift")), checkpointed(M.supervised(full(at), HORIZONS))
    for name, options in {"ridge": {}, "gbt": {"seeds": (1, 2)}}.items():
        one = M.global_model(rows, at.origins, name, **options).withColumn("model", F.lit(name))
        pred = pred.unionByName(one.select(pred.columns))
    m = E.metric_cuts(E.shared_points(checkpointed(pred).where("y is not null")))
    return m.select("model", F.col("h").cast("long").alias("h"), "origin", "n", *(F.round(c, k).alias(c) for c, k in {"mae": 4, "wape": 6, "r2": 5, "r2_within": 5}.items()))


@query()
def ets_forecast(spark: SparkSession, d: str) -> DataFrame:
    at = setting(spark, d)
    return M.ets_deviation(M.common_factor(full(at)), at.origins, 3).withColumn("yhat", F.round("yhat", 4))


@query()
def fourier_trend_forecast(spark: SparkSession, d: str) -> DataFrame:
    at = setting(spark, d)
    return M.fourier_trend(full(at), at.origins, 3).withColumn("yhat", F.round("yhat", 4))


@query()
def changepoint_trend_forecast(spark: SparkSession, d: str) -> DataFrame:
    at = setting(spark, d)
    return T.changepoint_trend(full(at), at.origins, 3).withColumn("yhat", F.round("yhat", 4))


@query()
def trend_changes(spark: SparkSession, d: str) -> DataFrame:
    """Each series' slope at the end of the window, as log level a year; how often it has changed, and when last."""
    at = setting(spark, d)
    found = T.trend_fits(full(at), [at.last], 3)
    last = F.array_max(F.transform("changes", lambda c: c["month"]))
    return found.select("entity", F.round("slope", 5).alias("slope"), F.size("changes").cast("long").alias("changes"), last.alias("last_change"))


@query(f"""WITH {SQL_PANEL}, {SQL_FULL}, {SQL_PTS}, gr AS (SELECT a.month, ln(a.value / b.value) AS g FROM full_panel a JOIN full_panel b ON b.entity = a.entity AND b.month = a.month - 12 WHERE a.value > 0 AND b.value > 0),
md AS (SELECT o AS origin, quantile_cont(g, 0.5) AS m FROM gr JOIN {_origins()} a(o) ON month <= o GROUP BY 1)
SELECT pts.entity, origin, h, pts.month, round(b.value * exp(m), 4) AS yhat FROM pts JOIN md USING (origin) JOIN full_panel b ON b.entity = pts.entity AND b.month = pts.month - 12""")
def constant_growth_forecast(spark: SparkSession, d: str) -> DataFrame:
    """The reference that knows one number: the median growth of all series up to the origin."""
    at = setting(spark, d)
    p = full(at)
    found = M.constant_growth(p, M.points(p, at.origins, HORIZONS))
    return found.select("entity", "origin", F.col("h").cast("long").alias("h"), "month", F.round("yhat", 4).alias("yhat"))


def _null_predictions(spark: SparkSession, d: str) -> DataFrame:
    at = setting(spark, d)
    p = full(at)
    return stored(N.null_predictions(M.supervised(p, HORIZONS), p, at.origins))[0]


@query()
def null_test_runs(spark: SparkSession, d: str) -> DataFrame:
    """The error of a learned model on real data, on noise in place of its features, on shuffled targets, and of three references."""
    found = N.runs(_null_predictions(spark, d))
    return found.select("scenario", F.col("repeat").cast("long").alias("repeat"), "n", F.round("mae", 3).alias("mae"), F.round("r2_within", 5).alias("r2_within"))


@query()
def null_test_summary(spark: SparkSession, d: str) -> DataFrame:
    """How often spoilt data do as well as real ones, and what the model gains over the references."""
    found = N.summary(_null_predictions(spark, d))
    digits = {"mae_real": 3, "mae": 3, "best": 3, "p": 6, "skill": 5, "share_better": 5}
    return found.select("versus", "repeats", *(F.round(c, k).alias(c) for c, k in digits.items()))


@query(f"""WITH {SQL_PANEL}, {SQL_FULL}, f AS (SELECT s.entity, s.month + 12 AS month, s.month + 12 - {S_LAST} AS h, s.value * (SELECT sum(n.value) FROM full_panel n WHERE n.entity = s.entity AND n.month BETWEEN {S_LAST} - 2 AND {S_LAST})
/ (SELECT sum(n.value) FROM full_panel n WHERE n.entity = s.entity AND n.month BETWEEN {S_LAST} - 14 AND {S_LAST} - 12) AS yhat, s.value FROM full_panel s WHERE s.month BETWEEN {S_LAST} - 11 AND {S_LAST} - 9)
SELECT entity, month::BIGINT AS month, h::BIGINT AS h, round(yhat, 4) AS yhat, quantile_cont(ln(yhat / value), 0.5) OVER (PARTITION BY h) BETWEEN -0.5 AND 0.5 AS plausible FROM f""")
def forward_forecast(spark: SparkSession, d: str) -> DataFrame:
    """From the last month on, where there is no fact; with a check of the median growth."""
    at = setting(spark, d)
    p = full(at)
    pred = M.seasonal_drift(p, M.points(p, [at.last], HORIZONS)).join(p.select("entity", (F.col("month") + 12).alias("month"), "value"), ["entity", "month"])
    growth = medians(pred, F.ln(F.col("yhat") / F.col("value")), ["h"], "growth")  # a row a horizon
    pred = pred.join(F.broadcast(growth), "h", "left")
    return pred.select("entity", "month", F.col("h").cast("long").alias("h"), F.round("yhat", 4).alias("yhat"), F.col("growth").between(-0.5, 0.5).alias("plausible"))


_FORWARD = f"""fw AS (SELECT s.entity, s.month + 12 AS month, s.month + 12 - {S_LAST} AS h, s.value * (SELECT sum(n.value) FROM full_panel n WHERE n.entity = s.entity AND n.month BETWEEN {S_LAST} - 2 AND {S_LAST})
/ (SELECT sum(n.value) FROM full_panel n WHERE n.entity = s.entity AND n.month BETWEEN {S_LAST} - 14 AND {S_LAST} - 12) AS yhat FROM full_panel s WHERE s.month BETWEEN {S_LAST} - 11 AND {S_LAST} - 9)"""


@query(f"""WITH {SQL_PRED}, {SQL_PARTS.format('pred', '', '', '')}, {_FORWARD}
SELECT entity, fw.month::BIGINT AS month, fw.h::BIGINT AS h, round(yhat, 4) AS yhat, round(yhat * exp(lo), 3) AS lo, round(yhat * exp(hi), 3) AS hi FROM fw JOIN bd ON bd.model = 'drift' AND bd.h = fw.h""")
def entity_forecast(spark: SparkSession, d: str) -> DataFrame:
    """What a series' page shows ahead of its last month: the forecast and the band of its horizon."""
    at = setting(spark, d)
    p = full(at)
    band = E.error_band(predictions(at, ("drift",))).select("h", "lo", "hi")  # a row a horizon
    ahead = M.seasonal_drift(p, M.points(p, [at.last], HORIZONS)).join(F.broadcast(band), "h")
    low, high = F.round(F.col("yhat") * (1 + F.col("lo")), 3), F.round(F.col("yhat") * (1 + F.col("hi")), 3)
    return ahead.select("entity", "month", F.col("h").cast("long").alias("h"), F.round("yhat", 4).alias("yhat"), low.alias("lo"), high.alias("hi"))


@query(f"""WITH {SQL_PRED} SELECT entity, model, origin, string_agg(h || '=' || printf('%.2f', yhat) || '/' || printf('%.2f', y), ';' ORDER BY h) AS points, round(avg(abs(y / yhat - 1)), 6) AS ape FROM pred
WHERE y IS NOT NULL AND yhat IS NOT NULL GROUP BY 1, 2, 3""")
def entity_windows(spark: SparkSession, d: str) -> DataFrame:
    """Each series' past windows by model: forecast and fact of every horizon, and the window's mean relative error."""
    known = predictions(setting(spark, d)).where("y is not null and yhat is not null")
    text = F.transform(F.array_sort(F.collect_list(F.struct("h", "yhat", "y"))), lambda r: F.format_string("%d=%.2f/%.2f", r["h"], r["yhat"], r["y"]))
    return known.groupBy("entity", "model", "origin").agg(F.array_join(text, ";").alias("points"), F.round(F.avg(F.abs(F.col("y") / F.col("yhat") - 1)), 6).alias("ape"))


@query()
def ridge_covariates_forecast(spark: SparkSession, d: str) -> DataFrame:
    """The ridge model with covariates as they were known at each month beside the panel's own features."""
    from .join_queries import covariates

    at = setting(spark, d)
    known = covariates(spark, d).withColumnRenamed("month", "t")
    rows = M.supervised(full(at), HORIZONS).join(known, ["entity", "t"], "left")
    found = M.global_model(rows, at.origins, "ridge", features=(*M.FEATURES, "orders_growth", "acts", "off_days"))
    return found.select("entity", "origin", "h", "month", "y", F.round("yhat", 2).alias("yhat"))


@query()
def feature_importance(spark: SparkSession, d: str) -> DataFrame:
    """Shares of the ten most important features of the boosted trees, averaged over three seeds; a category's columns are summed."""
    at = setting(spark, d)
    return M.importances(M.supervised(full(at), HORIZONS), at.origins[-1], "gbt", seeds=(1, 2, 3)).orderBy(F.desc("share"), "feature").limit(10)


_COMMA = "replace(printf('%.2f', {0}), '.', ',')"


@query(f"""WITH {SQL_PRED}, m AS (SELECT model, avg(abs(y - yhat)) AS mae, count(*) AS n FROM pred WHERE y IS NOT NULL AND yhat IS NOT NULL GROUP BY 1), {_FORWARD}
SELECT 'series' AS kind, entity || ';' || month || ';' || {_COMMA.format('value')} AS line FROM panel
UNION ALL SELECT 'windows', entity || ';' || model || ';' || origin || ';' || h || ';' || {_COMMA.format('yhat')} FROM pred WHERE yhat IS NOT NULL
UNION ALL SELECT 'models', model || ';' || n || ';' || {_COMMA.format('mae')} FROM m
UNION ALL SELECT 'forecast', entity || ';' || month::BIGINT || ';' || h::BIGINT || ';' || {_COMMA.format('yhat')} FROM fw""")
def csv_exports(spark: SparkSession, d: str) -> DataFrame:
    """The lines of the four exports: series, past windows, models and the forecast, with semicolons and decimal commas."""
    from ..functions.text import decimal_comma

    at = setting(spark, d)
    p, pred = full(at), predictions(at).where("yhat is not null")
    models = pred.where("y is not null").groupBy("model").agg(F.avg(F.abs(F.col("y") - F.col("yhat"))).alias("mae"), F.count("*").alias("n"))
    ahead = M.seasonal_drift(p, M.points(p, [at.last], HORIZONS))
    parts = {
        "series": (at.panel, ("entity", "month"), "value"), "windows": (pred, ("entity", "model", "origin", "h"), "yhat"),
        "models": (models, ("model", "n"), "mae"), "forecast": (ahead, ("entity", "month", "h"), "yhat"),
    }
    out = None
    for kind, (df, keys, value) in parts.items():
        line = F.concat_ws(";", *(F.col(k).cast("string") for k in keys), decimal_comma(F.col(value)))
        one = df.select(F.lit(kind).alias("kind"), line.alias("line"))
        out = one if out is None else out.unionByName(one)
    return out
