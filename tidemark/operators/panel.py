"""Panel algebra on long tables (entity, month, value): no pivots, one window sort for all lags of a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def month_idx(ts: Column | str) -> Column:
    """Months since year 0, as a long: the join and frame key of every panel."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return (F.year(ts) * 12 + F.month(ts) - 1).cast("long")


def month_start(idx: Column | str) -> Column:
    idx = F.col(idx) if isinstance(idx, str) else idx
    return F.make_timestamp((idx / 12).cast("int"), (idx % 12 + 1).cast("int"), F.lit(1), F.lit(0), F.lit(0), F.lit(0))


def over(keys: Sequence[str], order: str = "month") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def lag_rows(col: str, k: int, keys: Sequence[str], order: str = "month") -> Column:
    """The value k rows earlier: gaps are skipped over."""
    return F.lag(col, k).over(over(keys, order))


def lag_months(col: str, k: int, keys: Sequence[str], order: str = "month") -> Column:
    """The value exactly k months earlier, null if that month is absent. A range frame, so no self-join."""
    return F.first(col).over(over(keys, order).rangeBetween(-k, -k))


def rolling(agg, col: str, keys: Sequence[str], first: int, last: int, at_least: int, order: str = "month") -> Column:
    """``agg`` over rows first..last (relative), null unless ``at_least`` values are present."""
    w = over(keys, order).rowsBetween(first, last)
    return F.when(F.count(col).over(w) >= at_least, agg(col).over(w))


def expanding_median(col: str, keys: Sequence[str], order: str = "month") -> Column:
    """Median of all earlier rows."""
    return F.percentile(col, 0.5).over(over(keys, order).rowsBetween(Window.unboundedPreceding, -1))


def guarded_ln(col: Column | str) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return F.ln(F.when(col > 0, col))


def clip(col: Column, low: float, high: float) -> Column:
    """Winsorise; null stays null."""
    return F.when(col.isNotNull(), F.greatest(F.least(col, F.lit(high)), F.lit(low)))


def log_growth(now: Column, before: Column) -> Column:
    return F.when((now > 0) & (before > 0), F.ln(now / before))


def densify(panel: DataFrame, keys: Sequence[str], order: str = "month", fill: dict[str, float] | None = None) -> DataFrame:
    """Every month between a key's first and last, missing ones filled (null unless ``fill`` names the column)."""
    span = panel.groupBy(*keys).agg(F.min(order).alias("_a"), F.max(order).alias("_b"))
    grid = span.select(*keys, F.explode(F.sequence("_a", "_b")).alias(order))
    return grid.join(panel, [*keys, order], "left").fillna(fill or {})


def grid(entities: DataFrame, months: DataFrame) -> DataFrame:
    """Entity x month. Months are a calendar: tens to hundreds of rows, checked by the caller's schema."""
    calendar = months.agg(F.array_sort(F.collect_set("month")).alias("_m"))
    return entities.crossJoin(F.broadcast(calendar)).select(*entities.columns, F.explode("_m").alias("month"))


def full_history(panel: DataFrame, keys: Sequence[str], first: int, last: int) -> DataFrame:
    """Rows of the window, of the series that have every month of it."""
    inside = panel.where(F.col("month").between(first, last))
    whole = inside.groupBy(*keys).agg(F.countDistinct("month").alias("_n")).where(F.col("_n") == last - first + 1)
    return inside.join(whole.select(*keys), list(keys), "left_semi")


def islands(panel: DataFrame, keys: Sequence[str], flag: Column, order: str = "month") -> DataFrame:
    """Runs of consecutive rows whose flag holds: keys, run, first, last, length."""
    w = over(keys, order)
    marked = panel.withColumn("_f", F.coalesce(flag, F.lit(False)))
    marked = marked.withColumn("_new", (F.col("_f") & ~F.coalesce(F.lag("_f").over(w), F.lit(False))).cast("int"))
    marked = marked.withColumn("run", F.sum("_new").over(w)).where("_f")
    return marked.groupBy(*keys, "run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("length"))


def decumulate(df: DataFrame, keys: Sequence[str], year: str, month: str, cum: str, strict: bool = False) -> Column:
    """Monthly values of a year-to-date series. ``strict``: only where the month before is present."""
    w = Window.partitionBy(*keys, year).orderBy(month)
    before = F.lag(cum).over(w)
    if strict:
        ok = F.lag(month).over(w) == F.col(month) - 1
        return F.when(F.col(month) == 1, F.col(cum)).when(ok, F.col(cum) - before)
    return F.coalesce(F.col(cum) - before, F.col(cum))


def forward_fill(col: str, keys: Sequence[str], order: str = "month") -> Column:
    return F.last(col, ignorenulls=True).over(over(keys, order).rowsBetween(Window.unboundedPreceding, 0))


def group_median(col: str, keys: Sequence[str]) -> Column:
    return F.percentile(col, 0.5).over(Window.partitionBy(*keys))


def drop_empty_columns(df: DataFrame, condition: Column) -> DataFrame:
    """Without the columns that are null in every row of ``condition``; one aggregate for all columns."""
    counts = df.where(condition).agg(*(F.count(c).alias(c) for c in df.columns)).first()
    return df.drop(*(c for c in df.columns if not counts[c]))


def latest(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order (a versioned dictionary's valid version)."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")
