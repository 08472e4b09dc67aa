"""Shift detection queries, over the last 24 months of the complete window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detect as D
from ..operators import features as X
from ..operators import panel as P
from ..session import checkpointed
from .base import S_24, S_LAST, SQL_CAT, SQL_PANEL, Setting, category_panel, query, read, setting


def window24(spark: SparkSession, d: str, by_category: bool = False, at: Setting | None = None) -> DataFrame:
    s = at or setting(spark, d)
    keys, p = (["entity", "category"], category_panel(spark, d)) if by_category else (["entity"], s.panel)
    first = s.last - 23
    return P.full_history(p, keys, first, s.last).select(*keys, (F.col("month") - first).alias("t"), "value")


def sql24(table: str = "panel", name: str = "fp", keys: str = "entity") -> str:
    inside = f"month BETWEEN {S_24} AND {S_LAST}"
    return (
        f"{name} AS (SELECT {keys}, month - {S_24} AS t, value FROM {table} WHERE {inside} AND ({keys}) IN "
        f"(SELECT ({keys}) FROM {table} WHERE {inside} GROUP BY {keys} HAVING count(*) = 24))"
    )


def sql_z(src: str = "fp", keys: str = "entity", group: str = "") -> str:
    by = f"{group}, " if group else ""
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    sel = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    mid = f"(SELECT quantile_cont(q.s, 0.5) FROM s0 q{f' WHERE q.{group} = s0.{group}' if group else ''})"
    return f"""yo AS (SELECT {sel}, a.t - 12 AS t, ln(a.value) - ln(b.value) AS g FROM {src} a JOIN {src} b ON {on} AND b.t = a.t - 12),
xx AS (SELECT {keys}, t, g - quantile_cont(g, 0.5) OVER (PARTITION BY {by}t) AS x FROM yo),
mo AS (SELECT {sel}, a.t, ln(a.value) - ln(b.value) AS m FROM {src} a JOIN {src} b ON {on} AND b.t = a.t - 1 WHERE a.t < 12),
md AS (SELECT {keys}, m - quantile_cont(m, 0.5) OVER (PARTITION BY {by}t) AS m FROM mo),
dd AS (SELECT {keys}, m, quantile_cont(m, 0.5) OVER (PARTITION BY {keys}) AS mm FROM md),
s0 AS (SELECT {keys}, 1.4826::DOUBLE * sqrt(2) * quantile_cont(abs(m - mm), 0.5) AS s FROM dd GROUP BY {keys}),
sg AS (SELECT {keys}, greatest(s, 0.5::DOUBLE * {mid}) AS sigma FROM s0),
z AS (SELECT {keys}, t, x, sigma, x / sigma AS z FROM xx JOIN sg USING ({keys}))"""


SQL_EWMA = """e0 AS (SELECT entity, avg(z) AS level FROM z WHERE t < 2 GROUP BY 1),
ew AS (SELECT entity, 1::BIGINT AS t, level, 0::DOUBLE AS score FROM e0 UNION ALL
 SELECT z.entity, z.t, 0.3::DOUBLE * z.z + 0.7::DOUBLE * ew.level, abs(z.z - ew.level) FROM ew JOIN z ON z.entity = ew.entity AND z.t = ew.t + 1)"""
SQL_LCG = "(((({0} * 1103515 + 12345 + 7919 * {1}) % 2147483648) * 48271 + 11) % 2147483647)"
SQL_LABELS = f"""lab AS (SELECT entity, (14 + {SQL_LCG.format('entity', 1)} % 8)::BIGINT AS tau,
([-0.05, -0.10, -0.15]::DOUBLE[])[{SQL_LCG.format('entity', 2)} % 3 + 1] AS size FROM (SELECT DISTINCT entity FROM fp) WHERE {SQL_LCG.format('entity', 0)} % 5 = 0)"""
SQL_INJECTED = "inj AS (SELECT entity, t, CASE WHEN t >= tau THEN value * (1 + size) ELSE value END AS value FROM fp LEFT JOIN lab USING (entity))"


@query(f"WITH {SQL_PANEL}, {sql24()}, {sql_z()} SELECT entity, t, round(x, 6) x, round(sigma, 6) sigma, round(z, 5) z FROM z")
def local_growth_sigma(spark: SparkSession, d: str) -> DataFrame:
    z = D.local_growth(window24(spark, d))
    return z.select("entity", "t", F.round("x", 6).alias("x"), F.round("sigma", 6).alias("sigma"), F.round("z", 5).alias("z"))


@query(f"""WITH {SQL_PANEL}, {sql24()}, {sql_z()} SELECT a.entity, a.t, round(CASE WHEN a.t >= 2 THEN abs(a.z - quantile_cont(b.z, 0.5)) ELSE 0 END, 5) AS score
FROM z a LEFT JOIN z b ON a.entity = b.entity AND b.t < a.t GROUP BY a.entity, a.t, a.z""")
def score_zscore(spark: SparkSession, d: str) -> DataFrame:
    return D.zscore(D.local_growth(window24(spark, d))).withColumn("score", F.round("score", 5))


def _scored(z: DataFrame, score) -> DataFrame:
    """(entity, t, score) of a detector that folds over the signal."""
    return D.signals(z).select("entity", F.posexplode(score(F.col("z"))).alias("t", "score")).withColumn("t", F.col("t").cast("long"))


SQL_INTERVAL = """le AS (SELECT z.entity, z.t, z.z - CASE WHEN z.t < 2 THEN e0.level ELSE ew.level END AS e FROM z JOIN e0 USING (entity) LEFT JOIN ew ON ew.entity = z.entity AND ew.t = z.t - 1),
lq AS (SELECT a.entity, a.t, a.e, quantile_cont(b.e, 0.1) AS lo, quantile_cont(b.e, 0.5) AS mid, quantile_cont(b.e, 0.9) AS hi FROM le a JOIN le b ON b.entity = a.entity AND b.t < a.t WHERE a.t >= 2 GROUP BY a.entity, a.t, a.e),
fi AS (SELECT entity, t, greatest(e - hi, lo - e, 0) / greatest(hi - lo, 1) AS outside, abs(e - mid) / greatest(hi - lo, 1) AS off_median FROM lq)"""


@query(f"""WITH RECURSIVE {SQL_PANEL}, {sql24()}, {sql_z()}, {SQL_EWMA}, {SQL_INTERVAL} SELECT z.entity, z.t, round(coalesce(outside, 0), 5) AS outside, round(coalesce(off_median, 0), 5) AS off_median
FROM z LEFT JOIN fi ON fi.entity = z.entity AND fi.t = z.t""")
def score_forecast_interval(spark: SparkSession, d: str) -> DataFrame:
    found = D.forecast_interval(D.local_growth(window24(spark, d)))
    return found.select("entity", "t", F.round("outside", 5).alias("outside"), F.round("off_median", 5).alias("off_median"))


@query(f"WITH RECURSIVE {SQL_PANEL}, {sql24()}, {sql_z()}, {SQL_EWMA} SELECT entity, t, round(score, 5) AS score FROM ew UNION ALL SELECT entity, 0, 0 FROM e0")
def score_ewma(spark: SparkSession, d: str) -> DataFrame:
    return _scored(D.local_growth(window24(spark, d)), D.ewma).withColumn("score", F.round("score", 5))


@query(f"""WITH RECURSIVE {SQL_PANEL}, {sql24()}, {sql_z()}, e0 AS (SELECT entity, avg(z) AS ref FROM z WHERE t < 2 GROUP BY 1),
cu AS (SELECT entity, ref, 1::BIGINT AS t, 0::DOUBLE AS up, 0::DOUBLE AS down FROM e0 UNION ALL
 SELECT z.entity, ref, z.t, greatest(0, up + z.z - ref - 0.5::DOUBLE), greatest(0, down - (z.z - ref) - 0.5::DOUBLE) FROM cu JOIN z ON z.entity = cu.entity AND z.t = cu.t + 1)
SELECT entity, t, round(greatest(up, down), 5) AS score FROM cu UNION ALL SELECT entity, 0, 0 FROM e0""")
def score_cusum(spark: SparkSession, d: str) -> DataFrame:
    return _scored(D.local_growth(window24(spark, d)), D.cusum).withColumn("score", F.round("score", 5))


SQL_BOCPD = """m0 AS (SELECT entity, avg(z) AS m FROM z WHERE t < 2 GROUP BY 1),
bo AS (SELECT entity, m, (-1)::BIGINT AS t, [1.0::DOUBLE] AS run, [m] AS mean, [4.0::DOUBLE] AS var FROM m0 UNION ALL
 SELECT entity, m, t, [x / list_sum(r) FOR x IN r], mean, var FROM (
  SELECT entity, m, t, list_concat([list_sum(l) / 12.0::DOUBLE], [x * (1 - 1 / 12.0::DOUBLE) FOR x IN l]) AS r,
   list_concat([m], [va[i] / (1 + va[i]) * (me[i] / va[i] + z) FOR i IN range(1, len(l) + 1)]) AS mean, list_concat([4.0::DOUBLE], [v / (1 + v) FOR v IN va]) AS var
  FROM (SELECT bo.entity, bo.m, z.t, z.z, bo.mean AS me, bo.var AS va,
   [bo.run[i] * exp(-((z.z - bo.mean[i]) ** 2) / (2 * (1 + bo.var[i]))) / sqrt(2 * pi() * (1 + bo.var[i])) FOR i IN range(1, len(bo.run) + 1)] AS l
   FROM bo JOIN z ON z.entity = bo.entity AND z.t = bo.t + 1)))"""


@query(f"WITH RECURSIVE {SQL_PANEL}, {sql24()}, {sql_z()}, {SQL_BOCPD} SELECT entity, t, round(CASE WHEN t >= 2 THEN run[1] + run[2] ELSE 0 END, 6) AS score FROM bo WHERE t >= 0")
def score_bocpd(spark: SparkSession, d: str) -> DataFrame:
    found = D.bocpd(D.signals(D.local_growth(window24(spark, d))))
    return found.select("entity", F.posexplode("score").alias("t", "score")).select("entity", F.col("t").cast("long").alias("t"), F.round("score", 6).alias("score"))


#: Every way to cut twelve months into one to six pieces of two months or more, and what each piece leaves of a series.
SQL_CUTS = """pair AS (SELECT a::BIGINT AS a, b::BIGINT AS b FROM range(0, 11) x(a), range(2, 13) y(b) WHERE b - a >= 2),
cut AS (SELECT 0::BIGINT AS place, 0 AS k, [0::BIGINT] AS ends UNION ALL SELECT b, k + 1, list_append(ends, b) FROM cut JOIN pair ON a = place WHERE k < 6),
way AS (SELECT row_number() OVER () AS id, k - 1 AS breaks, ends FROM cut WHERE place = 12),
piece AS (SELECT entity, a, b, sum(z * z) - sum(z) ** 2 / (b - a) AS c FROM z JOIN pair ON t >= a AND t < b GROUP BY 1, 2, 3),
part AS (SELECT id, unnest(ends[1:len(ends) - 1]) AS a, unnest(ends[2:len(ends)]) AS b FROM way),
cost AS (SELECT entity, id, sum(c) AS c FROM part JOIN piece USING (a, b) GROUP BY 1, 2),
least_ AS (SELECT entity, breaks, arg_min(ends, c) AS ends, min(c) AS c FROM cost JOIN way USING (id) GROUP BY 1, 2)"""


@query(f"""WITH RECURSIVE {SQL_PANEL}, {sql24()}, {sql_z()}, {SQL_CUTS}
SELECT entity, array_to_string(ends[2:len(ends) - 1], ',') AS breaks, round(c, 5) AS cost FROM least_ QUALIFY row_number() OVER (PARTITION BY entity ORDER BY c + 6 * breaks, breaks) = 1""")
def segmentation(spark: SparkSession, d: str) -> DataFrame:
    found = D.segmentation(D.signals(D.local_growth(window24(spark, d))), penalty=6.0)
    return found.select("entity", F.array_join("breaks", ",").alias("breaks"), F.round("cost", 5).alias("cost"))


SQL_CATZ = f"{sql24('cat', 'fc', 'entity, category')}, {sql_z('fc', 'entity, category', 'category')}"


@query(f"""WITH {SQL_PANEL}, {SQL_CAT}, {SQL_CATZ} SELECT entity, t, round(avg(greatest(least(z, 8::DOUBLE), -8::DOUBLE)) * sqrt(count(*)), 5) AS z FROM z GROUP BY 1, 2""")
def category_signal(spark: SparkSession, d: str) -> DataFrame:
    z = D.local_growth(window24(spark, d, by_category=True), ["entity", "category"], ["category"])
    return D.category_signal(z).withColumn("z", F.round("z", 5))


@query(f"""WITH RECURSIVE {SQL_PANEL}, {sql24()}, {sql_z()}, {SQL_EWMA}, se AS (SELECT entity, t, score FROM ew UNION ALL SELECT entity, 0, 0 FROM e0),
sz AS (SELECT a.entity, a.t, CASE WHEN a.t >= 2 THEN abs(a.z - quantile_cont(b.z, 0.5)) ELSE 0 END AS score FROM z a LEFT JOIN z b ON a.entity = b.entity AND b.t < a.t
GROUP BY a.entity, a.t, a.z) SELECT entity, t, round(greatest(se.score / (SELECT quantile_cont(score, 0.5) FROM se), sz.score / (SELECT quantile_cont(score, 0.5) FROM sz)), 4) AS score
FROM se JOIN sz USING (entity, t)""")
def mixed_signal(spark: SparkSession, d: str) -> DataFrame:
    z = D.local_growth(window24(spark, d))
    return D.mixed(_scored(z, D.ewma), D.zscore(z)).withColumn("score", F.round("score", 4))


def _injected(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = window24(spark, d)
    labels = D.shift_labels(p.select("entity").distinct())
    return checkpointed(_scored(D.local_growth(D.inject(p, labels)), D.ewma)), labels  # calibration and evaluation both read it


FARS = (0.05, 0.1, 0.2, 0.3)
SQL_THRESHOLDS = f"""{SQL_LABELS}, {SQL_INJECTED}, {sql_z('inj')}, {SQL_EWMA},
top AS (SELECT entity, max(score) AS top FROM ew WHERE t >= 2 AND entity NOT IN (SELECT entity FROM lab) GROUP BY 1),
th AS (SELECT far, (SELECT quantile_cont(top, [0.95, 0.9, 0.8, 0.7]) FROM top)[i] AS threshold FROM (VALUES (0.05::DOUBLE, 1), (0.1, 2), (0.2, 3), (0.3, 4)) v(far, i))"""


@query(f"WITH RECURSIVE {SQL_PANEL}, {sql24()}, {SQL_THRESHOLDS} SELECT far, round(threshold, 5) AS threshold FROM th")
def far_calibration(spark: SparkSession, d: str) -> DataFrame:
    scores, labels = _injected(spark, d)
    return D.calibrate(scores, labels, FARS).withColumn("threshold", F.round("threshold", 5))


@query(f"""WITH RECURSIVE {SQL_PANEL}, {sql24()}, {SQL_THRESHOLDS}, al AS (SELECT far, entity, t FROM ew, th WHERE t >= 2 AND score > threshold),
pe AS (SELECT th.far, lab.entity, min(CASE WHEN t BETWEEN tau - 12 AND tau - 10 THEN t - tau + 12 END) AS delay, coalesce(bool_or(t < tau - 12), false) AS early
FROM lab CROSS JOIN th LEFT JOIN al ON al.far = th.far AND al.entity = lab.entity GROUP BY 1, 2),
fa AS (SELECT far, count(DISTINCT entity) AS n FROM al WHERE entity NOT IN (SELECT entity FROM lab) GROUP BY 1),
e AS (SELECT far, count(*)::BIGINT AS shifts, count(delay)::BIGINT AS hits, avg(delay) AS delay, avg(early::INT) AS early, count(delay) / count(*) AS recall FROM pe GROUP BY 1)
SELECT far, shifts, hits, round(recall, 6) AS recall, round(delay, 6) AS delay, round(early, 6) AS early, coalesce(n, 0)::BIGINT AS false_alarms,
round(CASE WHEN hits + coalesce(n, 0) > 0 THEN hits / (hits + coalesce(n, 0)) END, 6) AS precision FROM e LEFT JOIN fa USING (far)""")
def injected_shift_eval(spark: SparkSession, d: str) -> DataFrame:
    scores, labels = _injected(spark, d)
    found = D.evaluate(scores, labels, D.calibrate(scores, labels, FARS))
    rounded = [F.round(c, 6).alias(c) for c in ("recall", "delay", "early", "precision")]
    return found.select("far", "shifts", "hits", "false_alarms", *rounded)


@query(f"""WITH RECURSIVE {SQL_PANEL}, {sql24()}, {sql_z()}, {SQL_EWMA}, f AS (SELECT *, score > 1.5 AS a FROM ew),
g AS (SELECT *, sum((a AND NOT coalesce(b, false))::INT) OVER (PARTITION BY entity ORDER BY t) AS run FROM (SELECT *, lag(a) OVER (PARTITION BY entity ORDER BY t) b FROM f))
SELECT entity, min(t) AS first, max(t) AS last, count(*)::BIGINT AS length, round(max(score), 5) AS peak FROM g WHERE a GROUP BY entity, run""")
def alarm_episodes(spark: SparkSession, d: str) -> DataFrame:
    s = _scored(D.local_growth(window24(spark, d)), D.ewma)
    runs = P.islands(s, ["entity"], F.col("score") > 1.5, "t").drop("run")
    peak = s.join(runs, "entity").where("t between first and last").groupBy("entity", "first", "last", "length")
    return peak.agg(F.round(F.max("score"), 5).alias("peak"))


@query(f"""WITH RECURSIVE {SQL_PANEL}, {sql24()}, {sql_z()}, {SQL_EWMA}, ev AS (SELECT DISTINCT l_suppkey AS entity, (year(l_shipdate) * 12 + month(l_shipdate) - 1) - {S_24} - 12 AS t
FROM lineitem WHERE l_quantity >= 49 AND l_discount >= 0.09), e2 AS (SELECT entity, t FROM ev UNION SELECT entity, t + 1 FROM ev)
SELECT entity, t, (score > 2.5 OR (score > 1.2 AND (entity, t) IN (SELECT (entity, t) FROM e2))) AS alarm FROM ew WHERE t >= 2""")
def two_key_alarm(spark: SparkSession, d: str) -> DataFrame:
    """Months with a large discounted line stand for events; an event counts in its month and the next."""
    at = setting(spark, d)
    s = _scored(D.local_growth(window24(spark, d, at=at)), D.ewma).where("t >= 2")
    li = read(spark, d, "lineitem").where("l_quantity >= 49 and l_discount >= 0.09")
    ev = li.select(F.col("l_suppkey").alias("entity"), (P.month_idx("l_shipdate") - (at.last - 23) - 12).alias("t"))
    ev = ev.union(ev.select("entity", (F.col("t") + 1).alias("t"))).distinct().withColumn("event", F.lit(True))
    return s.join(ev, ["entity", "t"], "left").select("entity", "t", X.two_key_alarm(F.col("score"), F.col("event"), 2.5, 1.2).alias("alarm"))


@query(f"""WITH RECURSIVE {SQL_PANEL}, {sql24()}, {sql_z()}, {SQL_EWMA}, s AS (SELECT entity, t, score FROM ew UNION ALL SELECT entity, 0, 0 FROM e0),
th AS (SELECT quantile_cont(top, 0.95) AS threshold FROM (SELECT max(score) AS top FROM ew WHERE t >= 2 GROUP BY entity))
SELECT entity, t, round(x, 6) AS x, round(z, 5) AS z, round(score, 5) AS score, score > threshold AS alarm FROM z JOIN s USING (entity, t), th""")
def entity_signal(spark: SparkSession, d: str) -> DataFrame:
    """What a series' page shows: its local growth, standardised, the detector's score, and where it passes the threshold
    that one series in twenty passes."""
    z = D.local_growth(window24(spark, d))
    s = _scored(z, D.ewma)
    threshold = D.calibrate(s, s.select("entity").limit(0), (0.05,)).select("threshold")
    both = z.join(s, ["entity", "t"]).crossJoin(F.broadcast(threshold))  # one row
    return both.select("entity", "t", F.round("x", 6).alias("x"), F.round("z", 5).alias("z"), F.round("score", 5).alias("score"), (F.col("score") > F.col("threshold")).alias("alarm"))


@query(f"""WITH {SQL_PANEL}, full_ AS (SELECT * FROM panel WHERE month BETWEEN (SELECT a FROM win) AND {S_LAST} AND entity IN (SELECT entity FROM panel
WHERE month BETWEEN (SELECT a FROM win) AND {S_LAST} GROUP BY entity HAVING count(*) = {S_LAST} - (SELECT a FROM win) + 1)),
y AS (SELECT a.entity, a.month, a.value / b.value - 1 AS g FROM full_ a JOIN full_ b ON b.entity = a.entity AND b.month = a.month - 12),
i AS (SELECT entity, month, g - quantile_cont(g, 0.5) OVER (PARTITION BY month) AS x FROM y), c AS (SELECT entity, month, x - quantile_cont(x, 0.5) OVER (PARTITION BY entity) AS c FROM i),
s AS (SELECT entity, 1.4826::DOUBLE * quantile_cont(abs(c), 0.5) + 1e-9::DOUBLE AS s FROM c GROUP BY 1)
SELECT month, count(*)::BIGINT AS series, round(avg((abs(c / s) > 3)::INT), 6) AS share, round(max(abs(c / s)), 4) AS largest FROM c JOIN s USING (entity) GROUP BY 1""")
def exploratory_z(spark: SparkSession, d: str) -> DataFrame:
    """By month, the share of series whose growth less the common one lies more than three of their own robust spreads
    from their median."""
    at = setting(spark, d)
    p = P.full_history(at.panel, ["entity"], at.first, at.last)
    return D.exploratory_z(p).groupBy("month").agg(
        F.count("*").alias("series"), F.round(F.avg((F.abs("z") > 3).cast("int")), 6).alias("share"), F.round(F.max(F.abs("z")), 4).alias("largest")
    )
