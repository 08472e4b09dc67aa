"""Features as they were known at a point in time."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import panel as P
from .quantiles import medians

#: Months between a series' own month and the first month it may be used, by series.
AS_OF_LAG = {
    "regional_monthly": 1, "unemployment": 3, "loans_and_prices": 2, "income_and_housing": 5, "tax_ytd": 1,
    "fx": 0, "calendar": 0, "news": 0, "coded_events": 0, "acts": 0, "national_growth": 1,
}


def recent_growth(panel: DataFrame, keys: Sequence[str] = ("entity",), keep: Sequence[str] = ()) -> DataFrame:
    """Year-over-year growth at t, t-1, t-2, three-month drift, month change, seasonal step, and the common growth; columns to ``keep`` beside them.

    All lags share one sort by (keys, month). The common growth is a median by month: a table as long as the calendar.
    """
    lag = {k: P.lag_months("value", k, keys) for k in (1, 2, 11, 12, 13, 14)}
    v = panel.select(*keys, "month", "value", *keep, *(c.alias(f"v{k}") for k, c in lag.items()))
    c = F.col
    v = v.select(
        *keys,
        "month",
        *keep,
        P.log_growth(c("value"), c("v12")).alias("g1"),
        P.log_growth(c("v1"), c("v13")).alias("g2"),
        P.log_growth(c("v2"), c("v14")).alias("g3"),
        P.log_growth(c("value") + c("v1") + c("v2"), c("v12") + c("v13") + c("v14")).alias("drift3"),
        P.log_growth(c("value"), c("v1")).alias("mom"),
        P.log_growth(c("v11"), c("v12")).alias("seas_step"),
    )
    common = medians(v, "g1", ["month"], "common")
    before = common.select((c("month") + 1).alias("month"), c("common").alias("common_before"))
    return v.join(F.broadcast(common), "month", "left").join(F.broadcast(before), "month", "left")


def as_of_join(panel: DataFrame, right: DataFrame, on: Sequence[str], lag: int, month: str = "month") -> DataFrame:
    """What was published by month t: the right key is moved by the lag, so this is an equi-join."""
    return panel.join(right.withColumn(month, F.col(month) + lag), [*on, month], "left")


def annual_release(panel: DataFrame, annual: DataFrame, on: Sequence[str], release_month: int, back: int = 1) -> DataFrame:
    """The value of year Y is known from ``release_month`` of Y + back; before that, the one of Y - 1. ``annual``: on, year, columns."""
    year = F.floor(F.col("month") / 12) - back - F.when(F.col("month") % 12 + 1 < release_month, 1).otherwise(0)
    return panel.withColumn("year", year.cast("long")).join(annual, [*on, "year"], "left").drop("year")


def completeness(df: DataFrame, columns: Sequence[str], month: str = "month") -> DataFrame:
    """Share of filled values of each column: all rows, and those of the last month."""
    top = df.agg(F.max(month).alias("_top"))
    counted = df.crossJoin(F.broadcast(top))  # one row
    parts = [
        F.struct(
            F.lit(c).alias("feature"),
            F.round(F.avg(F.col(c).isNotNull().cast("int")), 6).alias("complete"),
            F.round(F.avg(F.when(F.col(month) == F.col("_top"), F.col(c).isNotNull().cast("int"))), 6).alias("complete_last"),
        )
        for c in columns
    ]
    return counted.agg(F.array(*parts).alias("x")).select(F.inline("x"))


def event_forms(counts: DataFrame, keys: Sequence[str], order: str = "month", col: str = "n") -> DataFrame:
    """count, flag, deviation from the norm of the previous 12, and sums of the previous 2 and 3 to 5, on a zero-filled grid."""
    dense = P.densify(counts, keys, order, {col: 0})
    w = P.over(keys, order)
    back = {k: F.coalesce(F.lag(col, k).over(w), F.lit(0)) for k in range(1, 6)}
    return dense.select(
        *keys,
        order,
        F.col(col).alias("count"),
        (F.col(col) > 0).alias("flag"),
        (F.col(col) - P.rolling(F.avg, col, keys, -12, -1, 3, order)).alias("dev"),
        (back[1] + back[2]).alias("lag12_sum"),
        (back[3] + back[4] + back[5]).alias("lag35_sum"),
    )


def active_months(intervals: DataFrame, keys: Sequence[str], start: str, ends: DataFrame, end: str, default: int) -> DataFrame:
    """Months in which an interval is active: from its start to the first later end of the same keys, or a default length.

    A start's end is found with one sorted window over starts and ends together, not with a range join.
    """
    both = intervals.select(*keys, F.col(start).alias("at"), F.lit(1).alias("is_start")).unionByName(
        ends.select(*keys, F.col(end).alias("at"), F.lit(0).alias("is_start"))
    )
    after = Window.partitionBy(*keys).orderBy("at").rangeBetween(0, Window.unboundedFollowing)
    both = both.withColumn("stop", F.min(F.when(F.col("is_start") == 0, F.col("at"))).over(after)).where("is_start = 1")
    last = F.coalesce("stop", F.col("at") + default - 1)
    return both.select(*keys, F.explode(F.sequence("at", last)).alias("month")).distinct()


def known_active_months(starts: DataFrame, keys: Sequence[str], start: str, ends: DataFrame, end: str, default: int) -> DataFrame:
    """Months in which an act counts as active by what was published then: from its publication for ``default`` months, or
    until the month in which a later end is published. Unlike ``active_months``, no month knows of an end to come."""
    both = starts.select(*keys, F.col(start).alias("at"), F.lit(1).alias("is_start")).unionByName(
        ends.select(*keys, F.col(end).alias("at"), F.lit(0).alias("is_start"))
    )
    after = Window.partitionBy(*keys).orderBy("at").rangeBetween(1, Window.unboundedFollowing)
    both = both.withColumn("stop", F.min(F.when(F.col("is_start") == 0, F.col("at"))).over(after)).where("is_start = 1")
    last = F.least(F.col("at") + default, F.coalesce("stop", F.col("at") + default)) - 1
    return both.select(*keys, F.explode(F.sequence("at", last)).alias("month")).distinct()


def region_tags(text: Column, aliases: Mapping[str, str], special: Mapping[str, tuple[str, str]]) -> Column:
    """Regions that a text names, in the order of ``aliases``: by one of the region's own names, or by a special city of
    it (pattern, region) whose name says nothing of the region."""
    found = F.array(*(F.when(text.rlike(p), F.lit(r)) for r, p in aliases.items()))
    cities = F.array(*(F.when(text.rlike(p), F.lit(r)) for p, r in special.values()))
    named = F.array_union(F.array_compact(found), F.array_compact(cities))
    return F.filter(F.array(*map(F.lit, aliases)), lambda r: F.array_contains(named, r))


def weighted_mentions(own: DataFrame, regional: DataFrame, members: DataFrame, share: float = 0.3) -> DataFrame:
    """Entity rows at full weight plus region rows that reach each member of the region at ``share``. Region rows are aggregated: regions x months x kinds;
    they go to where the members are, so that no region's members meet in a task."""
    reach = members.join(F.broadcast(regional), "region").withColumn("w", F.col("w") * share)
    cols = ["entity", "month", "kind", "w"]
    return own.select(cols).unionByName(reach.select(cols)).groupBy("entity", "month", "kind").agg(F.sum("w").alias("w"))


def two_key_alarm(score: Column, event: Column, strict: float, soft: float) -> Column:
    """A strong score, or a weaker one together with an event of this or the previous month."""
    return (score > strict) | ((score > soft) & F.coalesce(event, F.lit(False)))
