"""Evaluation of prediction tables (model, entity, origin, h, month, y, yhat)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed
from .quantiles import medians, quantiles, sum_quantiles

POINT = ("entity", "origin", "h", "month")


def _metric_columns() -> list[Column]:
    e = F.col("y") - F.col("yhat")
    spread = F.sum(F.col("y") ** 2) - F.sum("y") ** 2 / F.count("y")
    return [
        F.count("y").alias("n"),
        F.avg(F.abs(e)).alias("mae"),
        (F.sum(F.abs(e)) / F.sum(F.abs("y"))).alias("wape"),
        (1 - F.try_divide(F.sum(e * e), spread)).alias("r2"),
        (1 - F.try_divide(F.sum(e * e), F.sum(F.col("yc") ** 2))).alias("r2_within"),
    ]


def _centred(pred: DataFrame) -> DataFrame:
    """y less its mean over the horizons of one series, origin and model."""
    known = pred.where("y is not null and yhat is not null")
    return known.withColumn("yc", F.col("y") - F.avg("y").over(Window.partitionBy("model", "entity", "origin")))


def metrics(pred: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    return _centred(pred).groupBy(*by).agg(*_metric_columns())


def metric_cuts(pred: DataFrame) -> DataFrame:
    """Overall, by horizon and by origin in one pass; the absent key is -1."""
    m, h, o = F.col("model"), F.col("h"), F.col("origin")
    return _centred(pred).groupingSets([[m], [m, h], [m, o]], m, h, o).agg(*_metric_columns()).fillna(-1, ["h", "origin"])


def shared_points(pred: DataFrame) -> DataFrame:
    """Points that every model has predicted."""
    models = pred.select("model").distinct().agg(F.count("*").alias("_k"))
    counted = pred.where("yhat is not null").withColumn("_n", F.count("*").over(Window.partitionBy(*POINT)))
    return counted.crossJoin(F.broadcast(models)).where("_n = _k").drop("_n", "_k")  # one row


def ensemble_mean(pred: DataFrame, members: Sequence[str], name: str, min_members: int | None = None) -> DataFrame:
    """The members' mean on points that at least ``min_members`` (all, by default) have."""
    some = pred.where(F.col("model").isin(list(members)) & F.col("yhat").isNotNull())
    out = some.groupBy(*POINT).agg(F.first("y").alias("y"), F.avg("yhat").alias("yhat"), F.count("*").alias("_k"))
    return out.where(F.col("_k") >= (min_members or len(members))).drop("_k").withColumn("model", F.lit(name))


def pair_blends(pred: DataFrame, cut: int) -> DataFrame:
    """For each pair of models, the weight (steps of 0.1) best on targets up to ``cut``, with its error there and after."""
    a = pred.select(*POINT, "y", F.col("model").alias("a"), F.col("yhat").alias("ya"))
    b = pred.select(*POINT, F.col("model").alias("b"), F.col("yhat").alias("yb"))
    both = a.join(b, list(POINT)).where("a < b and y is not null")
    both = both.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(10))))
    e = F.abs(F.col("y") - (F.col("k") * F.col("ya") + (10 - F.col("k")) * F.col("yb")) / 10)
    early = F.avg(F.when(F.col("month") <= cut, e)).alias("mae_fit")
    late = F.avg(F.when(F.col("origin") >= cut, e)).alias("mae_test")
    scored = both.groupBy("a", "b", "k").agg(early, late)
    best = F.min_by(F.struct("k", "mae_fit", "mae_test"), F.struct(F.round("mae_fit", 6), "k"))
    return scored.groupBy("a", "b").agg(best.alias("x")).select("a", "b", (F.col("x.k") / 10).alias("weight"), "x.mae_fit", "x.mae_test")


def rolling_selection(pred: DataFrame, origins: Sequence[int]) -> DataFrame:
    """Ways to combine models when each origin sees only targets up to itself: (way, origin, mae)."""
    cut = pred.select(F.explode(F.array(*map(F.lit, origins))).alias("at"), "*").where("y is not null")
    past = cut.where(F.col("month") <= F.col("at")).groupBy("at", "model").agg(F.avg(F.abs(F.col("y") - F.col("yhat"))).alias("past"))
    past = past.withColumn("rank", F.row_number().over(Window.partitionBy("at").orderBy(F.round("past", 6), "model")))
    test = cut.where(F.col("origin") == F.col("at")).join(F.broadcast(past), ["at", "model"])  # origins x models
    pick = lambda k: F.avg(F.when(F.col("rank") <= k, F.col("yhat")))
    near = F.when(F.col("rank") <= 5, 1 / F.col("past"))
    ways = {
        "mean": F.avg("yhat"), "median": F.percentile("yhat", 0.5), "best": pick(1), "top3": pick(3), "top5": pick(5),
        "inverse_mae": F.sum(near * F.col("yhat")) / F.sum(near),
    }
    made = test.groupBy("at", *POINT).agg(F.first("y").alias("y"), *(c.alias(k) for k, c in ways.items()))
    errors = F.array(*(F.struct(F.lit(k).alias("way"), F.abs(F.col("y") - F.col(k)).alias("e")) for k in ways))
    return made.select(F.col("at").alias("origin"), F.inline(errors)).groupBy("way", "origin").agg(F.avg("e").alias("mae"))


def greedy_selection(pred: DataFrame, known_until: int, max_members: int = 12, gain: float = 0.5) -> list[str]:
    """Members chosen with replacement while each lowers the mean absolute error by ``gain``; one aggregate a round."""
    known = pred.where((F.col("month") <= known_until) & F.col("y").isNotNull())
    models = sorted(r[0] for r in known.select("model").distinct().collect())
    rows = known.groupBy(*POINT).agg(F.first("y").alias("y"), F.map_from_entries(F.collect_list(F.struct("model", "yhat"))).alias("m"))
    rows = checkpointed(rows.where(F.size("m") == len(models)))
    chosen, best = [], float("inf")
    for _ in range(max_members):
        total = sum((F.col("m")[c] for c in chosen), F.lit(0.0))
        found = rows.agg(*(F.avg(F.abs(F.col("y") - (total + F.col("m")[c]) / (len(chosen) + 1))).alias(c) for c in models)).first()
        pick = min(models, key=lambda c: (found[c], c))
        if found[pick] >= best - gain:
            break
        chosen.append(pick)
        best = found[pick]
    return chosen


def _parts(pred: DataFrame, by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """r = ln(y / yhat) split into its median over an origin and horizon, and the rest: (by, h, own), and (by, origin, h, common), a row an origin."""
    known = checkpointed(pred.where("y > 0 and yhat > 0").select(*by, "origin", "h", F.ln(F.col("y") / F.col("yhat")).alias("r")))
    common = checkpointed(medians(known, "r", [*by, "origin", "h"], "common"))
    own = known.join(common, [*by, "origin", "h"]).select(*by, "h", (F.col("r") - F.col("common")).alias("own"))
    return own, common


def error_band(pred: DataFrame, by: Sequence[str] = ("model",), levels: tuple[float, float] = (0.1, 0.9)) -> DataFrame:
    """(by, h, lo, hi): quantiles of all sums of own and common errors, so a common miss of few origins widens the band.

    The sums, (points of a horizon) x (its origins), are not listed: they are selected from a histogram of the own errors.
    """
    own, common = _parts(pred, by)
    found = sum_quantiles(own, "own", common, "common", levels, [*by, "h"])
    return found.select(*by, "h", F.expm1(F.col("q")[0]).alias("lo"), F.expm1(F.col("q")[1]).alias("hi"))


def raw_band(pred: DataFrame, by: Sequence[str] = ("model",), levels: tuple[float, float] = (0.1, 0.9)) -> DataFrame:
    found = quantiles(pred.where("y is not null"), F.col("y") / F.col("yhat") - 1, levels, [*by, "h"])
    return found.select(*by, "h", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))


def rolling_coverage(pred: DataFrame, origins: Sequence[int], band=error_band) -> DataFrame:
    """Coverage and width on each origin of bands built from targets up to it."""
    at = pred.select(F.explode(F.array(*map(F.lit, origins))).alias("at"), "*").where("y is not null and yhat is not null")
    bands = band(at.where(F.col("month") <= F.col("at")), ("model", "at"))
    test = at.where(F.col("origin") == F.col("at")).join(F.broadcast(bands), ["model", "at", "h"], "left")  # models x origins x horizons
    r = F.col("y") / F.col("yhat") - 1
    inside = F.coalesce((r >= F.col("lo")) & (r <= F.col("hi")), F.lit(False)).cast("int")
    return test.groupBy("model", F.col("at").alias("origin")).agg(F.avg(inside).alias("coverage"), F.avg(F.col("hi") - F.col("lo")).alias("width"), F.count("*").alias("n"))


def error_correlation(pred: DataFrame) -> DataFrame:
    e = pred.where("y is not null").select(*POINT, "model", (F.col("y") - F.col("yhat")).alias("e"))
    a, b = e.select(*POINT, F.col("model").alias("a"), F.col("e").alias("ea")), e.select(*POINT, F.col("model").alias("b"), F.col("e").alias("eb"))
    return a.join(b, list(POINT)).where("a < b").groupBy("a", "b").agg(F.corr("ea", "eb").alias("corr"))


def cluster_bootstrap(clusters: DataFrame, draws: int, draw_index) -> DataFrame:
    """(lo, mean, hi) of a mean under resampling of whole clusters.

    ``clusters``: (c = 0..K-1, s, n) sums and counts, a row each, already aggregated. ``draw_index(draw, slot, k)`` gives the
    cluster that a slot of a draw takes, so that a run can be repeated anywhere.
    """
    table = clusters.agg(F.map_from_entries(F.collect_list(F.struct("c", F.struct("s", "n")))).alias("m"), F.count("*").alias("k"))
    spark = clusters.sparkSession
    runs = spark.range(draws).select(F.col("id").alias("draw")).crossJoin(F.broadcast(table))  # one row
    slots = runs.select("draw", "m", "k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("slot"))
    taken = slots.select("draw", F.col("m")[draw_index(F.col("draw"), F.col("slot"), F.col("k"))].alias("x"))
    means = taken.groupBy("draw").agg((F.sum("x.s") / F.sum("x.n")).alias("mean"))
    found = means.agg(F.percentile("mean", [0.025, 0.975]).alias("q"), F.count("*").alias("draws"))
    real = clusters.agg((F.sum("s") / F.sum("n")).alias("mean"))
    return found.crossJoin(real).select(F.col("q")[0].alias("lo"), "mean", F.col("q")[1].alias("hi"), "draws")


def p_value(null: Column, real: Column) -> Column:
    """(1 + number of null results at most the real one) / (1 + number of null results)."""
    return (1 + F.sum((null <= real).cast("int"))) / (1 + F.count(null))


def event_effect(pred: DataFrame, flag: str, by: Sequence[str]) -> DataFrame:
    """Mean relative error of flagged points less that of the others."""
    r, f = F.col("y") / F.col("yhat") - 1, F.coalesce(F.col(flag), F.lit(False))
    return pred.where("y is not null and yhat is not null").groupBy(*by).agg(
        (F.avg(F.when(f, r)) - F.avg(F.when(~f, r))).alias("effect"), F.sum(f.cast("long")).alias("flagged")
    )


def effect_interval(pred: DataFrame, flag: str, cluster: str, draws: int, draw_index) -> DataFrame:
    """(effect, lo, hi, draws): mean relative error of flagged points less that of the others, and its quantiles under
    resampling of whole clusters, which are aggregated first; ``draw_index`` as in ``cluster_bootstrap``."""
    r, f = F.col("y") / F.col("yhat") - 1, F.coalesce(F.col(flag), F.lit(False))
    known = pred.where("y is not null and yhat is not null")
    sums = {"sf": F.sum(F.when(f, r)), "so": F.sum(F.when(~f, r)), "nf": F.count(F.when(f, 1)), "no": F.count(F.when(~f, 1))}
    rows = known.groupBy(cluster).agg(*(F.coalesce(F.round(c, 9) if k[0] == "s" else c, F.lit(0)).alias(k) for k, c in sums.items()))
    rows = rows.select((F.row_number().over(Window.orderBy(cluster)) - 1).cast("long").alias("c"), *sums)  # a row a cluster
    effect = lambda p: F.try_divide(F.sum(f"{p}sf"), F.sum(f"{p}nf")) - F.try_divide(F.sum(f"{p}so"), F.sum(f"{p}no"))
    table = rows.agg(F.map_from_entries(F.collect_list(F.struct("c", F.struct(*sums)))).alias("m"), F.count("*").alias("k"))
    runs = pred.sparkSession.range(draws).select(F.col("id").alias("draw")).crossJoin(F.broadcast(table))  # one row
    slots = runs.select("draw", "m", "k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("slot"))
    taken = slots.select("draw", F.col("m")[draw_index(F.col("draw"), F.col("slot"), F.col("k"))].alias("x"))
    found = taken.groupBy("draw").agg(effect("x.").alias("e")).agg(F.percentile("e", [0.025, 0.975]).alias("q"), F.count("*").alias("draws"))
    return rows.agg(effect("").alias("effect")).crossJoin(found).select("effect", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"), "draws")


def slices(pred: DataFrame, flags: dict[str, Column], base: str, other: str, margin: float = 0.01) -> DataFrame:
    """(slice, points, change_pct, verdict) of one model against another on slices that may overlap."""
    member = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in flags.items())))
    long = pred.where("y is not null and yhat is not null").withColumn("slice", F.explode(member)).withColumn("_e", F.abs(F.col("y") - F.col("yhat")))
    mean = lambda m: F.avg(F.when(F.col("model") == m, F.col("_e")))
    found = long.groupBy("slice").agg(mean(base).alias("a"), mean(other).alias("b"), F.count(F.when(F.col("model") == other, 1)).alias("points"))
    verdict = F.when(F.col("b") < (1 - margin) * F.col("a"), "better").when(F.col("b") > (1 + margin) * F.col("a"), "worse").otherwise("same")
    return found.select("slice", "points", ((F.col("b") / F.col("a") - 1) * 100).alias("change_pct"), verdict.alias("verdict"))
