"""Rolling-origin forecasts. Closed-form models are joins and windows; only iterative ones run Python, on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed, stored
from . import panel as P
from . import smoothing
from .boosting import boosted
from .forest import forest
from .quantiles import medians
from .ridge import ridge


def rolling_origins(last: int, horizon: int, windows: int, step: int = 1) -> list[int]:
    """Ascending forecast origins that leave ``horizon`` months of fact after each."""
    return sorted(last - horizon - step * i for i in range(windows))


def points(panel: DataFrame, origins: Sequence[int], horizons: Sequence[int], keys: Sequence[str] = ("entity",)) -> DataFrame:
    """(keys, origin, h, month) for every series with a value at the origin. Origins and horizons are a few literals."""
    at = panel.where(F.col("month").isin(list(origins))).select(*keys, F.col("month").alias("origin"))
    return at.withColumn("h", F.explode(F.array(*map(F.lit, horizons)))).withColumn("month", F.col("origin") + F.col("h"))


def with_fact(pred: DataFrame, panel: DataFrame, keys: Sequence[str] = ("entity",)) -> DataFrame:
    """Predictions with y; null where the target month has no fact."""
    return pred.join(panel.select(*keys, "month", F.col("value").alias("y")), [*keys, "month"], "left")


def _at_origin(panel: DataFrame, keys: Sequence[str], **columns: Column) -> DataFrame:
    return panel.select(*keys, F.col("month").alias("origin"), *(c.alias(k) for k, c in columns.items()))


def _year_before(pts: DataFrame, panel: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Points with ``base``, the value of the same month a year before the target; known, as h is 12 at most."""
    known = panel.select(*keys, (F.col("month") + 12).alias("month"), F.col("value").alias("base"))
    return pts.where("h <= 12").join(known, [*keys, "month"], "left")


def naive(panel: DataFrame, pts: DataFrame, keys: Sequence[str] = ("entity",)) -> DataFrame:
    return pts.join(_at_origin(panel, keys, yhat=F.col("value")), [*keys, "origin"])


def seasonal(panel: DataFrame, pts: DataFrame, keys: Sequence[str] = ("entity",)) -> DataFrame:
    return _year_before(pts, panel, keys).withColumnRenamed("base", "yhat")


def drift_ratio(k: int, keys: Sequence[str]) -> Column:
    """The last k months' sum over that of the same months a year before; null without all of them."""
    w = P.over(keys)
    now, ago = w.rangeBetween(1 - k, 0), w.rangeBetween(-11 - k, -12)
    whole = (F.count("value").over(now) == k) & (F.count("value").over(ago) == k)
    return F.when(whole, F.try_divide(F.sum("value").over(now), F.sum("value").over(ago)))


def seasonal_drift(panel: DataFrame, pts: DataFrame, k: int = 3, keys: Sequence[str] = ("entity",)) -> DataFrame:
    """The value a year before the target, times the present annual growth."""
    growth = _at_origin(panel, keys, growth=drift_ratio(k, keys))
    out = _year_before(pts, panel, keys).join(growth, [*keys, "origin"])
    return out.withColumn("yhat", F.col("base") * F.col("growth")).drop("base", "growth")


def seasonal_national(panel: DataFrame, pts: DataFrame, national: DataFrame, lag: int = 1, keys: Sequence[str] = ("entity",)) -> DataFrame:
    """The value a year before, times 1 + the last national growth known at origin - lag.

    ``national`` (month, growth) is one row a month; its last known value is filled forward over that calendar, so the
    as-of lookup is an equi-join on the origin.
    """
    span = national.agg(F.min("month").alias("a"), F.max("month").alias("b"))
    calendar = span.select(F.explode(F.sequence("a", F.col("b") + 24)).alias("month"))
    known = calendar.join(national, "month", "left").withColumn("growth", F.last("growth", ignorenulls=True).over(Window.orderBy("month")))
    known = known.select((F.col("month") + lag).alias("origin"), "growth")
    out = _year_before(pts, panel, keys).join(F.broadcast(known), "origin", "left")
    return out.withColumn("yhat", F.col("base") * (1 + F.col("growth"))).drop("base", "growth")


def constant_growth(panel: DataFrame, pts: DataFrame, keys: Sequence[str] = ("entity",)) -> DataFrame:
    """The value a year before, times exp of one number: the median annual log growth of all series and months known at the origin."""
    grown = panel.withColumn("g", P.log_growth(F.col("value"), P.lag_months("value", 12, keys))).where("g is not null").select("month", "g")
    origins = pts.select("origin").distinct()  # a few rows
    one = medians(grown.join(F.broadcast(origins), F.col("month") <= F.col("origin")), "g", ["origin"], "growth")
    out = _year_before(pts, panel, keys).join(F.broadcast(one), "origin", "left")
    return out.withColumn("yhat", F.col("base") * F.exp("growth")).drop("base", "growth")


def common_factor(panel: DataFrame, k: float | None = None) -> DataFrame:
    """(entity, month, l, f): log level and its common factor, the national median, or the regional one shrunk by n/(n + k).

    ``panel`` needs a region column for the latter; series without a region take the national factor.
    """
    levels = panel.withColumn("l", F.ln("value"))
    nat = medians(levels, "l", ["month"], "nat")
    if k is None:
        return levels.join(F.broadcast(nat), "month").select("entity", "month", "l", F.col("nat").alias("f"))
    reg = medians(levels.where("region is not null"), "l", ["region", "month"], "reg")
    size = levels.where("region is not null").groupBy("region").agg(F.countDistinct("entity").alias("n"))
    local = reg.join(size, "region").join(F.broadcast(nat), "month")
    local = local.select("region", "month", (F.col("nat") + (F.col("reg") - F.col("nat")) * F.col("n") / (F.col("n") + k)).alias("mix"))
    out = levels.join(F.broadcast(nat), "month").join(local, ["region", "month"], "left")
    return out.select("entity", "month", "l", F.coalesce("mix", "nat").alias("f"))


def factor_only(factors: DataFrame, pts: DataFrame, window: int = 3) -> DataFrame:
    """exp of: last year's factor + its mean annual change over ``window`` months + the series' deviation at the origin."""
    w = P.over(["entity"])
    change = F.col("f") - F.first("f").over(w.rangeBetween(-12, -12))
    at = factors.withColumn("c", change).withColumn("n", F.count("c").over(w.rangeBetween(1 - window, 0)))
    at = at.withColumn("growth", F.when(F.col("n") == window, F.avg("c").over(w.rangeBetween(1 - window, 0))))
    at = at.select("entity", F.col("month").alias("origin"), "growth", (F.col("l") - F.col("f")).alias("dev"))
    ago = factors.select("entity", (F.col("month") + 12).alias("month"), F.col("f").alias("ago"))
    out = pts.where("h <= 12").join(at, ["entity", "origin"]).join(ago, ["entity", "month"], "left")
    return out.withColumn("yhat", F.exp(F.col("ago") + F.col("growth") + F.col("dev"))).drop("growth", "dev", "ago")


def reconcile(wide: DataFrame, method: str, keys: Sequence[str]) -> DataFrame:
    """Bottom forecasts that add up to a total, in closed form.

    ``wide``: keys, part, yhat (part), total (the total's own forecast), err and err_total (relative errors known at the
    origin; only for "wls_error"). The gap is spread in proportion to the parts' variances.
    """
    w = Window.partitionBy(*keys)
    gap = F.col("total") - F.sum("yhat").over(w)
    variance = {
        "bottom_up": (F.lit(0.0), F.lit(1.0)),
        "ols": (F.lit(1.0), F.lit(1.0)),
        "wls_level": (F.col("yhat") ** 2, F.col("total") ** 2),
        "wls_error": ((F.col("err") * F.col("yhat")) ** 2, (F.col("err_total") * F.col("total")) ** 2),
    }
    part, top = variance[method]
    spread = wide.withColumn("_v", part).withColumn("_gap", gap)
    share = F.coalesce(F.try_divide(F.col("_v"), top + F.sum("_v").over(w)), F.lit(0.0))
    return spread.withColumn("reconciled", F.col("yhat") + F.col("_gap") * share).drop("_v", "_gap")


def _gathered(frames: Iterator[pd.DataFrame], block: int) -> Iterator[pd.DataFrame]:
    """The same rows in frames of ``block`` rows or somewhat more."""
    held, size = [], 0
    for frame in frames:
        held.append(frame)
        size += len(frame)
        if size >= block:
            yield pd.concat(held, ignore_index=True)
            held, size = [], 0
    if size:
        yield pd.concat(held, ignore_index=True)


def ets_deviation(factors: DataFrame, origins: Sequence[int], horizon: int, window: int = 3, min_train: int = 12, block: int = 30_000) -> DataFrame:
    """Exponential smoothing of each series' deviation from the common factor, plus the factor's own forecast.

    (entity, origin, h, month, yhat). A series and origin are one row with its history as an array; about ``block`` histories are fitted together, so
    that the last ones of a fit, which take many short steps, are few beside the others.
    """
    hist = factors.withColumn("origin", F.explode(F.array(*map(F.lit, origins)))).where("month <= origin")
    hist = hist.groupBy("entity", "origin").agg(F.array_sort(F.collect_list(F.struct("month", (F.col("l") - F.col("f")).alias("d")))).alias("a"))
    hist = hist.select("entity", "origin", F.transform("a", lambda r: r["d"]).alias("d")).where(F.size("d") >= min_train)
    kind = factors.schema["entity"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _gathered(frames, block):
            yield pd.DataFrame({"entity": frame["entity"], "origin": frame["origin"], "d": list(smoothing.forecast(frame["d"].tolist(), horizon)[0])})

    dev = checkpointed(hist.mapInPandas(run, f"entity {kind}, origin long, d array<double>"))  # read twice, fitted once
    dev = dev.select("entity", "origin", F.posexplode("d").alias("h", "dev")).withColumn("h", F.col("h") + 1).withColumn("month", F.col("origin") + F.col("h"))
    base = factor_only(factors, dev.select("entity", "origin", "h", "month"), window)
    at = factors.select("entity", F.col("month").alias("origin"), (F.col("l") - F.col("f")).alias("last"))
    out = dev.join(base.select("entity", "origin", "h", "yhat"), ["entity", "origin", "h"]).join(at, ["entity", "origin"])
    return out.select("entity", "origin", "h", "month", (F.col("yhat") * F.exp(F.col("dev") - F.col("last"))).alias("yhat"))


def log_histories(panel: DataFrame, origins: Sequence[int], min_train: int) -> DataFrame:
    """(entity, origin, m, l): months and log levels of a series up to each origin, as arrays bounded by the calendar."""
    hist = panel.withColumn("origin", F.explode(F.array(*(F.lit(o).cast("long") for o in origins)))).where("month <= origin and value > 0")
    hist = hist.groupBy("entity", "origin").agg(F.array_sort(F.collect_list(F.struct("month", F.ln("value").alias("l")))).alias("a"))
    hist = hist.select("entity", "origin", F.transform("a", lambda r: r["month"]).alias("m"), F.transform("a", lambda r: r["l"]).alias("l"))
    return hist.where(F.size("l") >= min_train)


def fourier_trend(panel: DataFrame, origins: Sequence[int], horizon: int, order: int = 3, min_train: int = 24) -> DataFrame:
    """A straight trend plus yearly Fourier terms on log levels, by least squares for each series and origin."""
    hist = log_histories(panel, origins, min_train)
    kind = panel.schema["entity"].dataType.simpleString()

    def design(m: np.ndarray, origin: int) -> np.ndarray:
        k = np.arange(1, order + 1) * 2 * np.pi / 12
        return np.column_stack([np.ones(len(m)), (m - origin) / 12, np.sin(np.outer(m, k)), np.cos(np.outer(m, k))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for origin, m, y in zip(frame["origin"], frame["m"], frame["l"], strict=True):
                beta = np.linalg.lstsq(design(np.asarray(m, float), origin), np.asarray(y), rcond=None)[0]
                out.append(np.exp(design(origin + np.arange(1.0, horizon + 1), origin) @ beta))
            yield pd.DataFrame({"entity": frame["entity"], "origin": frame["origin"], "f": out})

    fit = hist.mapInPandas(run, f"entity {kind}, origin long, f array<double>")
    out = fit.select("entity", "origin", F.posexplode("f").alias("h", "yhat"))
    return out.select("entity", "origin", (F.col("h") + 1).alias("h"), (F.col("origin") + F.col("h") + 1).alias("month"), "yhat")


def supervised(panel: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """Rows (entity, t, h) with features known at t and the target g = ln y(t+h) - ln y(t+h-12), null while unknown. A horizon is 12 at most.

    Facts and bases are frames over the sort that the features' lags have, too. ``panel`` has a row a series and month.
    """
    from .features import recent_growth

    ahead = (F.struct(F.lit(h).alias("h"), P.lag_months("value", 12 - h, ["entity"]).alias("base"), P.lag_months("value", -h, ["entity"]).alias("y")) for h in horizons if h <= 12)
    rows = recent_growth(panel.withColumn("_ahead", F.array(*ahead)), keep=["_ahead"]).withColumnRenamed("month", "t")
    rows = rows.select("*", F.inline("_ahead")).drop("_ahead")
    rows = rows.withColumn("month", F.col("t") + F.col("h")).withColumn("moy", (F.col("month") % 12).cast("double"))
    return rows.withColumn("g", P.log_growth(F.col("y"), F.col("base")))


FEATURES = ("g1", "g2", "g3", "drift3", "mom", "common", "common_before", "h", "moy")


TREES = {"random_forest": forest, "gbt": boosted}


def _trained(rows: DataFrame, origin: int, backend: str, seeds: Sequence[int], offset: str | None, features: Sequence[str]) -> tuple[list, list[str], DataFrame, Column]:
    """Fitted pipelines, one a seed; the names of their input columns; the rows to predict; and the offset."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, VectorAssembler
    from pyspark.ml.regression import LinearRegression, RandomForestRegressor

    shift = F.col(offset) if offset else F.lit(0.0)
    rows = rows.withColumn("label", F.col("g") - shift).withColumns({c: F.col(c).cast("double") for c in features})
    train = rows.where((F.col("month") <= origin) & F.col("label").isNotNull() & (F.col("base") > 0))
    mean = train.agg(F.avg("base").alias("_m"))
    train = train.crossJoin(F.broadcast(mean)).withColumn("weight", F.col("base") / F.col("_m"))  # one row; weights of mean 1
    test = rows.where((F.col("t") == origin) & (F.col("base") > 0))
    filled = train.agg(*(F.count(c).alias(c) for c in features)).first()
    names = [c for c in features if filled[c]]
    numeric = [c for c in names if c != "moy"]
    stages = [Imputer(inputCols=numeric, outputCols=[f"{c}_i" for c in numeric], strategy="median")]
    inputs = [f"{c}_i" for c in numeric]
    if backend == "ridge":
        stages += [OneHotEncoder(inputCol="moy", outputCol="moy_v", handleInvalid="keep"), VectorAssembler(inputCols=[*inputs, "moy_v"], outputCol="raw")]
        stages += [StandardScaler(inputCol="raw", outputCol="features", withMean=True)]
        columns = [*numeric, *(f"moy_{k}" for k in range(13))]
    else:
        stages += [VectorAssembler(inputCols=[*inputs, "moy"], outputCol="features")]
        columns = [*numeric, "moy"]
    models = []
    for seed in seeds:
        model = {
            "ridge": lambda: LinearRegression(regParam=0.1, elasticNetParam=0.0, weightCol="weight"),
            "random_forest": lambda s=seed: RandomForestRegressor(numTrees=30, maxDepth=6, seed=s, weightCol="weight"),
        }[backend]()
        models.append(Pipeline(stages=[*stages, model]).fit(train))
    return models, columns, test, shift


def global_model(
    rows: DataFrame, origin: int | Sequence[int], backend: str = "ridge", seeds: Sequence[int] = (1,), offset: str | None = None, features: Sequence[str] = FEATURES
) -> DataFrame:
    """A model over all series for each origin, trained on targets known at it, weighted by the base level; averaged over seeds.

    Backends: ridge, random_forest, gbt (absolute loss on histograms); the trees of all origins and seeds grow in the same passes. ``offset`` names a column
    that is taken from the target and added back. Features that are null in all training rows are left out; others are filled by their median (trees of
    gbt send missing values where they do better).
    """
    origins = [origin] if isinstance(origin, int) else sorted(origin)
    wanted = list(dict.fromkeys(["entity", "t", "h", "month", "base", "y", "g", *features, *([offset] if offset else [])]))
    rows, _ = stored(rows.select(wanted).where((F.col("month") <= max(origins)) & F.col("g").isNotNull() | F.col("t").isin(origins)))  # every fit reads them
    shift = F.coalesce(F.col(offset).cast("double"), F.lit(0.0)) if offset and backend != "ridge" else F.col(offset).cast("double") if offset else F.lit(0.0)
    some = rows.withColumn("_shift", shift).withColumn("_target", F.col("g") - F.col("_shift"))
    if backend == "ridge":  # no draws: one model, whatever the seeds
        found = ridge(some, origins, features, target="_target")
    else:
        found, _ = TREES[backend](some, origins, features, seeds, target="_target")
    out = found.where("base > 0").select("entity", "t", "h", "month", "base", "y", (F.col("prediction") + F.col("_shift")).alias("g"))
    keys = ["entity", F.col("t").alias("origin"), F.col("h").cast("int").alias("h"), "month"]
    return out.groupBy(*keys).agg(F.first("y").alias("y"), (F.first("base") * F.exp(F.avg("g"))).alias("yhat"))


def importances(rows: DataFrame, origin: int, backend: str = "gbt", seeds: Sequence[int] = (1,), features: Sequence[str] = FEATURES) -> DataFrame:
    """(feature, share): shares of the gain of trees, mean over seeds; of a linear model its standardised weights, one-hot columns
    counted for their feature. A row for each feature."""
    total: dict[str, float] = {}
    if backend != "ridge":
        wanted = list(dict.fromkeys(["entity", "t", "h", "month", "base", "g", *features]))
        _, total = TREES[backend](stored(rows.select(wanted).where((F.col("month") <= origin) & F.col("g").isNotNull() | (F.col("t") == origin)))[0], [origin], features, seeds)
    else:
        models, columns, _, _ = _trained(checkpointed(rows), origin, backend, seeds, None, features)
        for fitted in models:
            last = fitted.stages[-1]
            weights = np.abs(np.asarray(last.coefficients.toArray() if backend == "ridge" else last.featureImportances.toArray()))
            for name, w in zip(columns, weights / max(weights.sum(), 1e-12), strict=False):
                name = "moy" if name.startswith("moy") else name
                total[name] = total.get(name, 0.0) + float(w) / len(models)
    return rows.sparkSession.createDataFrame(sorted(total.items()), "feature string, share double")
