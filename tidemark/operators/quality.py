"""Gates and audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import medians


def panel_gate(panel: DataFrame, previous: DataFrame | None = None, min_entities: int = 1800, drop: float = 0.05, jump: float = 0.001) -> DataFrame:
    """(check, value, limit, ok) of a panel (entity, month, value): entities, duplicates, jumps, drop against before."""
    w = Window.partitionBy("entity").orderBy("month")
    ratio = F.col("value") / F.lag("value").over(w)
    per = panel.withColumn("_j", F.coalesce((ratio > 10) | (ratio < 0.1), F.lit(False)).cast("int"))
    keys = per.groupBy("entity", "month").agg(F.count("*").alias("_n"), F.sum("_j").alias("_j"))
    seen = keys.agg(
        F.countDistinct("entity").cast("double").alias("entities"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("double").alias("duplicates"),
        F.coalesce(F.sum("_j") / F.sum("_n"), F.lit(0.0)).alias("jumps"),
    )
    before = (previous or panel).agg(F.countDistinct("entity").cast("double").alias("before"))
    e = F.col("entities")
    rules = (
        ("entities", e, float(min_entities), e >= min_entities),
        ("duplicates", F.col("duplicates"), 0.0, F.col("duplicates") == 0),
        ("jumps", F.col("jumps"), jump, F.col("jumps") <= jump),
        ("kept", F.coalesce(F.try_divide(e, F.col("before")), F.lit(0.0)), 1 - drop, e >= (1 - drop) * F.col("before")),
    )
    checks = F.array(*(F.struct(F.lit(n).alias("check"), v.alias("value"), F.lit(x).alias("limit"), ok.alias("ok")) for n, v, x, ok in rules))
    return seen.crossJoin(before).select(F.inline(checks))  # one row each


def model_gate(new: DataFrame, old: DataFrame, rise: float = 0.25, tolerance: float = 1e-6) -> DataFrame:
    """Errors of two prediction sets on common points whose facts weren't revised: (model, n, mae_old, mae_new, ok)."""
    keys = ["model", "entity", "origin", "h"]
    both = new.select(*keys, F.col("y").alias("y1"), F.col("yhat").alias("f1")).join(old.select(*keys, F.col("y").alias("y0"), F.col("yhat").alias("f0")), keys)
    same = both.where(F.abs(F.col("y1") - F.col("y0")) <= tolerance * F.greatest(F.abs("y0"), F.lit(1.0)))
    out = same.groupBy("model").agg(
        F.count("*").alias("n"), F.avg(F.abs(F.col("y0") - F.col("f0"))).alias("mae_old"), F.avg(F.abs(F.col("y1") - F.col("f1"))).alias("mae_new")
    )
    return out.withColumn("ok", F.col("mae_new") <= (1 + rise) * F.col("mae_old"))


def holes(panel: DataFrame, keys: Sequence[str] = ("entity",)) -> DataFrame:
    """Inner gaps of each series: first and last month, months there, months missing."""
    return panel.groupBy(*keys).agg(
        F.min("month").alias("first"), F.max("month").alias("last"), F.countDistinct("month").alias("months"),
        (F.max("month") - F.min("month") + 1 - F.countDistinct("month")).alias("missing"),
    )


def reconcile_sources(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str, by: Sequence[str]) -> DataFrame:
    """How far two sources of one figure differ: median and largest percent difference, and correlation, by group."""
    both = a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), list(keys))
    both = both.withColumn("_d", F.abs(F.try_divide(F.col("_a"), F.col("_b")) - 1) * 100)
    found = both.groupBy(*by).agg(F.count("*").alias("n"), F.max("_d").alias("max_pct"), F.corr("_a", "_b").alias("corr"))
    middle = medians(both, "_d", by, "median_pct")  # a row a group
    return found.join(F.broadcast(middle), list(by), "left") if by else found.crossJoin(F.broadcast(middle))


def manifest(spark, folder: str, pattern: str = "*") -> DataFrame:
    """(path, length, sha256, copies) of every file, read by Spark."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    shown = files.select("path", "length", F.sha2("content", 256).alias("sha256"))
    return shown.withColumn("copies", F.count("*").over(Window.partitionBy("sha256")))
