"""Comparisons: detectors, models, slices, gates; and coded-event assignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import detect as D
from ..operators import evaluate as E
from ..operators import match as J
from ..operators import quality as Q
from ..session import checkpointed
from .base import SQL_PANEL, SQL_PLACES, places, query, read, setting
from .detect_queries import FARS, SQL_BOCPD, SQL_CUTS, SQL_EWMA, SQL_INJECTED, SQL_INTERVAL, SQL_LABELS, _injected, _scored, sql24, sql_z, window24
from .detect_queries import SQL_LCG
from .forecast_queries import _CUT, _LATEST, SQL_PRED, predictions


_SCORES = f"""{SQL_LABELS}, {SQL_INJECTED}, {sql_z('inj')}, {SQL_EWMA}, {SQL_BOCPD}, {SQL_INTERVAL}, e1 AS (SELECT entity, avg(z) AS ref FROM z WHERE t < 2 GROUP BY 1),
cu AS (SELECT entity, ref, 1::BIGINT AS t, 0::DOUBLE AS up, 0::DOUBLE AS down FROM e1 UNION ALL
 SELECT z.entity, ref, z.t, greatest(0, up + z.z - ref - 0.5::DOUBLE), greatest(0, down - (z.z - ref) - 0.5::DOUBLE) FROM cu JOIN z ON z.entity = cu.entity AND z.t = cu.t + 1),
dr AS (SELECT entity, m, quantile_cont(m, 0.5) OVER (PARTITION BY entity) AS mm FROM mo), sr AS (SELECT entity, 1.4826::DOUBLE * sqrt(2) * quantile_cont(abs(m - mm), 0.5) AS s FROM dr GROUP BY 1),
zr AS (SELECT entity, t, g / greatest(s, 0.5::DOUBLE * (SELECT quantile_cont(s, 0.5) FROM sr)) AS z FROM yo JOIN sr USING (entity)),
sc AS (SELECT 'ewma' AS method, entity, t, score FROM ew WHERE t >= 2 UNION ALL SELECT 'cusum', entity, t, greatest(up, down) FROM cu WHERE t >= 2
 UNION ALL SELECT 'bocpd', entity, t, run[1] + run[2] FROM bo WHERE t >= 2
 UNION ALL SELECT 'interval', entity, t, outside FROM fi UNION ALL SELECT 'forecast_median', entity, t, off_median FROM fi
 UNION ALL SELECT 'zscore', a.entity, a.t, abs(a.z - quantile_cont(b.z, 0.5)) FROM z a JOIN z b ON a.entity = b.entity AND b.t < a.t WHERE a.t >= 2 GROUP BY a.entity, a.t, a.z
 UNION ALL SELECT 'zscore_raw', a.entity, a.t, abs(a.z - quantile_cont(b.z, 0.5)) FROM zr a JOIN zr b ON a.entity = b.entity AND b.t < a.t WHERE a.t >= 2 GROUP BY a.entity, a.t, a.z),
tp AS (SELECT method, entity, max(score) AS top FROM sc WHERE entity NOT IN (SELECT entity FROM lab) GROUP BY 1, 2),
th AS (SELECT method, far, q[i] AS threshold FROM (SELECT method, quantile_cont(top, [0.95, 0.9, 0.8, 0.7]) AS q FROM tp GROUP BY 1), (VALUES (0.05::DOUBLE, 1), (0.1, 2), (0.2, 3), (0.3, 4)) v(far, i)),
al AS (SELECT sc.method, far, entity, t FROM sc JOIN th USING (method) WHERE score > threshold),
pe AS (SELECT th.method, th.far, lab.entity, lab.size, min(CASE WHEN t BETWEEN tau - 12 AND tau - 10 THEN t - tau + 12 END) AS delay
 FROM lab CROSS JOIN th LEFT JOIN al ON al.method = th.method AND al.far = th.far AND al.entity = lab.entity GROUP BY 1, 2, 3, 4),
fa AS (SELECT method, far, count(DISTINCT entity) AS n FROM al WHERE entity NOT IN (SELECT entity FROM lab) GROUP BY 1, 2)"""


@query(f"""WITH RECURSIVE {SQL_PANEL}, {sql24()}, {_SCORES}, e AS (SELECT method, far, count(*) AS shifts, count(delay) AS hits, avg(delay) AS delay FROM pe GROUP BY 1, 2),
r AS (SELECT method, far, hits / shifts AS recall, delay, coalesce(n, 0)::BIGINT AS n, hits / nullif(hits + coalesce(n, 0), 0) AS p FROM e LEFT JOIN fa USING (method, far))
SELECT method, far, round(recall, 6) AS recall, round(delay, 6) AS delay, n AS false_alarms, round(2 * p * recall / nullif(p + recall, 0), 6) AS f1,
far = 0.05 AND row_number() OVER (PARTITION BY far ORDER BY CASE WHEN method <> 'zscore_raw' THEN recall END DESC NULLS LAST, delay NULLS FIRST, method) = 1 AS best FROM r""")
def detector_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Recall, delay and false alarms of the online detectors at each rate, on the same artificial shifts; ``best`` marks
    the detector of largest recall, then smallest delay, at the lowest rate."""
    p = window24(spark, d)
    labels = D.shift_labels(p.select("entity").distinct())
    shifted = D.inject(p, labels)
    z = checkpointed(D.local_growth(shifted))  # six detectors read it; a row a series and month
    raw = D.local_growth(shifted, remove_common=False)
    scores = {"ewma": _scored(z, D.ewma), "cusum": _scored(z, D.cusum), "zscore": D.zscore(z), "zscore_raw": D.zscore(raw)}
    bayes = D.bocpd(D.signals(z)).select("entity", F.posexplode("score").alias("t", "score")).withColumn("t", F.col("t").cast("long"))
    ahead = checkpointed(D.forecast_interval(z))
    scores |= {"bocpd": bayes} | {name: ahead.select("entity", "t", F.col(c).alias("score")) for name, c in {"interval": "outside", "forecast_median": "off_median"}.items()}
    out = None
    for name, s in scores.items():
        s = checkpointed(s)
        one = D.evaluate(s, labels, D.calibrate(s, labels, FARS)).withColumn("method", F.lit(name))
        out = one if out is None else out.unionByName(one)
    rank = F.row_number().over(Window.partitionBy("far").orderBy(F.desc(F.when(F.col("method") != "zscore_raw", F.col("recall"))), "delay", "method"))
    best = ((F.col("far") == FARS[0]) & (rank == 1)).alias("best")
    return out.select("method", "far", F.round("recall", 6).alias("recall"), F.round("delay", 6).alias("delay"), "false_alarms", F.round("f1", 6).alias("f1"), best)


@query(f"""WITH RECURSIVE {SQL_PANEL}, {sql24()}, {_SCORES}
SELECT far, size, count(*)::BIGINT AS shifts, count(delay)::BIGINT AS hits, round(count(delay) / count(*), 6) AS recall FROM pe WHERE method = 'ewma' GROUP BY 1, 2""")
def recall_by_size(spark: SparkSession, d: str) -> DataFrame:
    """How often artificial shifts of each size are caught, at each rate of false alarms."""
    scores, labels = _injected(spark, d)
    found = D.evaluate(scores, labels, D.calibrate(scores, labels, FARS), by=("size",))
    return found.select("far", "size", "shifts", "hits", F.round("recall", 6).alias("recall"))


@query(f"""WITH RECURSIVE {SQL_PANEL}, {sql24()}, {SQL_LABELS}, {SQL_INJECTED}, {sql_z('inj')}, {SQL_EWMA}
SELECT rate, round((SELECT quantile_cont(score, [0.995, 0.99, 0.97]) FROM ew WHERE t >= 2 AND entity NOT IN (SELECT entity FROM lab))[i], 5) AS threshold
FROM (VALUES (0.5::DOUBLE, 1), (1.0, 2), (3.0, 3)) v(rate, i)""")
def rate_calibration(spark: SparkSession, d: str) -> DataFrame:
    """Thresholds that give so many alarms in 100 series-months of unshifted series."""
    scores, labels = _injected(spark, d)
    return D.calibrate_rate(scores, labels, (0.5, 1.0, 3.0)).withColumn("threshold", F.round("threshold", 5))


@query(f"""WITH RECURSIVE {SQL_PANEL}, {sql24()}, {SQL_LABELS}, {SQL_INJECTED}, {sql_z('inj')}, {SQL_CUTS},
g AS (SELECT a.entity, greatest(0, max((b.c - a.c) / nullif(a.breaks, 0))) AS g FROM least_ a JOIN least_ b ON b.entity = a.entity AND b.breaks = 0 WHERE a.entity NOT IN (SELECT entity FROM lab) GROUP BY 1)
SELECT far, round((SELECT quantile_cont(g, [0.95, 0.9, 0.8, 0.7]) FROM g)[i], 5) AS penalty FROM (VALUES (0.05::DOUBLE, 1), (0.1, 2), (0.2, 3), (0.3, 4)) v(far, i)""")
def segmentation_penalty(spark: SparkSession, d: str) -> DataFrame:
    """The penalty at which a share of unshifted series shows a break, found on one table of costs."""
    p = window24(spark, d)
    labels = D.shift_labels(p.select("entity").distinct())
    z = D.signals(D.local_growth(D.inject(p, labels)))
    costs = D.segment_costs(z.join(labels.select("entity"), "entity", "left_anti"))
    return D.calibrate_penalty(costs, FARS).withColumn("penalty", F.round("penalty", 5))


def beside_naive(errors: DataFrame) -> DataFrame:
    """``errors`` (model, origin, mae; a row each) with ``base``, the naive model's error at the origin. It is read off the same rows: an error
    computed a second time may differ in its last digits, as the order of a sum isn't fixed, and then a model would beat itself."""
    naive = F.max(F.when(F.col("model") == "naive", F.col("mae")))
    return errors.withColumn("base", naive.over(Window.partitionBy("origin"))).where("base is not null")


@query(f"""WITH {SQL_PRED}, o AS (SELECT model, origin, avg(abs(y - yhat)) AS mae FROM pred GROUP BY 1, 2),
b AS (SELECT o.*, n.mae AS base FROM o JOIN o n ON n.origin = o.origin AND n.model = 'naive')
SELECT model, round(avg(mae), 4) AS mean_mae, round(arg_max(mae, origin), 4) AS last_mae, arg_max(origin, round(mae, 6)) AS worst_origin, count(*) FILTER (mae < base)::BIGINT AS better FROM b GROUP BY 1""")
def model_table(spark: SparkSession, d: str) -> DataFrame:
    """Each model's mean, last and worst window, and the windows in which it beats the last value."""
    o = predictions(setting(spark, d)).groupBy("model", "origin").agg(F.avg(F.abs(F.col("y") - F.col("yhat"))).alias("mae"))
    return beside_naive(o).groupBy("model").agg(
        F.round(F.avg("mae"), 4).alias("mean_mae"),
        F.round(F.max_by("mae", "origin"), 4).alias("last_mae"),
        F.max_by("origin", F.round("mae", 6)).alias("worst_origin"),
        F.sum((F.col("mae") < F.col("base")).cast("long")).alias("better"),
    )


@query(f"""WITH {SQL_PRED}, m AS (SELECT h, model, avg(abs(y - yhat)) AS mae FROM pred GROUP BY 1, 2)
SELECT h, arg_min(model, round(mae, 6)) AS best, round(min(mae), 4) AS mae, round(1 - min(mae) / any_value(mae) FILTER (model = 'naive'), 6) AS gain FROM m GROUP BY 1""")
def horizon_overview(spark: SparkSession, d: str) -> DataFrame:
    m = predictions(setting(spark, d)).groupBy(F.col("h").cast("long").alias("h"), "model").agg(F.avg(F.abs(F.col("y") - F.col("yhat"))).alias("mae"))
    naive = F.max(F.when(F.col("model") == "naive", F.col("mae")))
    return m.groupBy("h").agg(
        F.min_by("model", F.round("mae", 6)).alias("best"), F.round(F.min("mae"), 4).alias("mae"), F.round(1 - F.min("mae") / naive, 6).alias("gain")
    )


@query(f"""WITH {SQL_PRED}, n AS (SELECT * FROM pred WHERE model <> 'factor')
SELECT model, count(*)::BIGINT AS n, round(avg(abs(y - yhat)), 4) AS mae_old, round(avg(abs(y - yhat * 1.4::DOUBLE)), 4) AS mae_new, avg(abs(y - yhat * 1.4::DOUBLE)) <= 1.25 * avg(abs(y - yhat)) AS ok FROM n GROUP BY 1""")
def model_gate(spark: SparkSession, d: str) -> DataFrame:
    """A run whose forecasts are all too high, against the run before, on points whose facts are unchanged."""
    old = predictions(setting(spark, d), ("naive", "seasonal", "drift", "national"))
    found = Q.model_gate(old.withColumn("yhat", F.col("yhat") * 1.4), old)
    return found.select("model", "n", F.round("mae_old", 4).alias("mae_old"), F.round("mae_new", 4).alias("mae_new"), "ok")


_FLAG = "(entity, month) IN (SELECT (l_suppkey, year(l_shipdate) * 12 + month(l_shipdate) - 1) FROM lineitem WHERE l_quantity = 50 AND l_discount >= 0.09)"


@query(f"""WITH {SQL_PRED}, f AS (SELECT *, {_FLAG} AS flag, y / yhat - 1 AS r FROM pred WHERE model = 'drift')
SELECT origin, round(avg(r) FILTER (flag) - avg(r) FILTER (NOT flag), 6) AS effect, count(*) FILTER (flag)::BIGINT AS flagged FROM f GROUP BY 1""")
def event_study(spark: SparkSession, d: str) -> DataFrame:
    """Mean relative error in months with a large discounted line, less that of the others, by origin."""
    from ..operators.panel import month_idx

    ev = read(spark, d, "lineitem").where("l_quantity = 50 and l_discount >= 0.09")
    ev = ev.select(F.col("l_suppkey").alias("entity"), month_idx("l_shipdate").alias("month")).distinct().withColumn("flag", F.lit(True))
    return E.event_effect(predictions(setting(spark, d), ("drift",)).join(ev, ["entity", "month"], "left"), "flag", ["origin"]).select("origin", F.round("effect", 6).alias("effect"), "flagged")


@query(f"""WITH {SQL_PRED}, {SQL_PLACES}, f AS (SELECT nation, {_FLAG} AS flag, y / yhat - 1 AS r FROM pred JOIN places USING (entity) WHERE model = 'drift'),
k AS (SELECT nation, coalesce(sum(r) FILTER (flag), 0) AS sf, count(*) FILTER (flag) AS nf, coalesce(sum(r) FILTER (NOT flag), 0) AS so, count(*) FILTER (NOT flag) AS no FROM f GROUP BY 1),
c AS (SELECT row_number() OVER (ORDER BY nation) - 1 AS c, round(sf, 9) AS sf, nf, round(so, 9) AS so, no, count(*) OVER () AS k FROM k),
q AS (SELECT draw, slot, {SQL_LCG.format('(draw * 1009 + slot)', 5)} AS z FROM range(200) a(draw), (SELECT c AS slot FROM c)),
m AS (SELECT draw, sum(sf) / nullif(sum(nf), 0) - sum(so) / nullif(sum(no), 0) AS effect FROM q JOIN c ON c.c = (z // 97) % k GROUP BY 1)
SELECT (SELECT round(sum(sf) / nullif(sum(nf), 0) - sum(so) / nullif(sum(no), 0), 6) FROM c) AS effect, round(quantile_cont(effect, 0.025), 6) AS lo, round(quantile_cont(effect, 0.975), 6) AS hi, count(*)::BIGINT AS draws FROM m""")
def event_study_interval(spark: SparkSession, d: str) -> DataFrame:
    """The event study's effect over all origins, with an interval from resampling whole nations (a fixed dimension of 25)."""
    from ..operators.panel import month_idx

    ev = read(spark, d, "lineitem").where("l_quantity = 50 and l_discount >= 0.09")
    ev = ev.select(F.col("l_suppkey").alias("entity"), month_idx("l_shipdate").alias("month")).distinct().withColumn("flag", F.lit(True))
    pred = predictions(setting(spark, d), ("drift",)).join(ev, ["entity", "month"], "left").join(places(spark, d), "entity")
    found = E.effect_interval(pred, "flag", "nation", 200, lambda draw, slot, k: F.floor(D.lcg(draw * 1009 + slot, 5) / 97) % k)
    return found.select(*(F.round(c, 6).alias(c) for c in ("effect", "lo", "hi")), "draws")


@query(f"""WITH {SQL_PRED}, {SQL_PLACES}, s AS (SELECT p.*, region, nation FROM pred p JOIN places USING (entity) WHERE model IN ('drift', 'seasonal')),
u AS (SELECT model, y, yhat, unnest(list_filter_) AS slice FROM (SELECT *, [x FOR x IN [CASE WHEN region = 'ASIA' THEN 'asia' END, CASE WHEN h = 1 THEN 'next_month' END, CASE WHEN origin >= {_CUT} THEN 'late' END, 'all'] IF x IS NOT NULL] AS list_filter_ FROM s)),
m AS (SELECT slice, avg(abs(y - yhat)) FILTER (model = 'seasonal') AS a, avg(abs(y - yhat)) FILTER (model = 'drift') AS b, count(*) FILTER (model = 'drift')::BIGINT AS points FROM u GROUP BY 1)
SELECT slice, points, round((b / a - 1) * 100, 4) AS change_pct, CASE WHEN b < 0.99 * a THEN 'better' WHEN b > 1.01 * a THEN 'worse' ELSE 'same' END AS verdict FROM m""")
def slice_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """One model against another on overlapping slices, with a verdict."""
    at = setting(spark, d)
    pred = predictions(at, ("drift", "seasonal")).join(places(spark, d), "entity")
    slices = {"asia": F.col("region") == "ASIA", "next_month": F.col("h") == 1, "late": F.col("origin") >= at.cut, "all": F.lit(True)}
    found = E.slices(pred, slices, "seasonal", "drift")
    return found.select("slice", "points", F.round("change_pct", 4).alias("change_pct"), "verdict")


@query(f"""WITH {SQL_PRED} SELECT model, origin, round(avg(abs(y - yhat)), 4) AS mae FROM pred WHERE model = (SELECT arg_min(model, m) FROM (SELECT model, round(avg(abs(y - yhat)), 6) AS m FROM pred
WHERE model NOT LIKE 'ens_%' AND month <= {_LATEST} GROUP BY 1)) AND origin = {_LATEST} GROUP BY 1, 2""")
def forward_choice(spark: SparkSession, d: str) -> DataFrame:
    """The model that was best on what the last origin knows, and its error from there."""
    at = setting(spark, d)
    pred = predictions(at)
    known = pred.where(~F.col("model").startswith("ens_") & (F.col("month") <= at.origins[-1]))
    best = E.metrics(known).agg(F.min_by("model", F.round("mae", 6)).alias("model"))
    test = pred.where(F.col("origin") == at.origins[-1]).join(F.broadcast(best), "model")
    return test.groupBy("model", "origin").agg(F.round(F.avg(F.abs(F.col("y") - F.col("yhat"))), 4).alias("mae"))


@query("""WITH e AS (SELECT event_id, (user_id % 25)::INT AS region, CASE event_id % 3 WHEN 0 THEN printf('supplier#%09d', user_id) WHEN 1 THEN 'supplier#00000000' ELSE 'elsewhere' END AS place FROM events),
s AS (SELECT s_suppkey, s_nationkey AS region, lower(s_name) AS key FROM supplier), u AS (SELECT region, key FROM s GROUP BY 1, 2 HAVING count(*) = 1),
lv AS (SELECT event_id, CASE WHEN EXISTS (SELECT 1 FROM u WHERE u.region = e.region AND u.key = e.place) THEN 'exact'
WHEN (SELECT count(DISTINCT s_suppkey) FROM s WHERE s.region = e.region AND starts_with(s.key, e.place)) = 1 THEN 'prefix' WHEN e.region IN (SELECT region FROM s) THEN 'region' END AS level FROM e)
SELECT level, count(*)::BIGINT AS n, count(DISTINCT event_id)::BIGINT AS events FROM lv WHERE level IS NOT NULL GROUP BY 1""")
def coded_event_assignment(spark: SparkSession, d: str) -> DataFrame:
    """Place names of events assigned to suppliers: the exact key in the region, then a prefix, then the region alone."""
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("entity"), F.col("s_nationkey").alias("region"), F.lower("s_name").alias("key"))
    e = read(spark, d, "events").select("event_id", (F.col("user_id") % 25).cast("int").alias("region"), F.col("user_id"))
    kind = F.col("event_id") % 3
    name = F.when(kind == 0, F.format_string("supplier#%09d", "user_id")).when(kind == 1, F.lit("supplier#00000000")).otherwise("elsewhere")
    return J.assign_events(e.select("event_id", "region", name.alias("place")), s).groupBy("level").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("events"))
