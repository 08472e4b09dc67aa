"""The query registry, and the tables that queries share."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.forecast import rolling_origins
from ..operators.panel import month_idx
from ..session import checkpointed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that must give the same rows."""

    def wrap(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return wrap


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def category_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, category, month, value, n): revenue and lines of a supplier, return flag and month."""
    lines = read(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("entity"), F.col("l_returnflag").alias("category"), month_idx("l_shipdate").alias("month"), "l_extendedprice"
    )
    return lines.groupBy("entity", "category", "month").agg(F.round(F.sum("l_extendedprice"), 2).alias("value"), F.count("*").alias("n"))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, month, value, n)."""
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("entity"), month_idx("l_shipdate").alias("month"), "l_extendedprice")
    return lines.groupBy("entity", "month").agg(F.round(F.sum("l_extendedprice"), 2).alias("value"), F.count("*").alias("n"))


@dataclass(frozen=True)
class Setting:
    """The panel, aggregated once and checkpointed, and the window of its complete months."""

    panel: DataFrame
    first: int
    last: int

    @property
    def origins(self) -> list[int]:
        return rolling_origins(self.last, 3, 7)

    @property
    def cut(self) -> int:
        return self.origins[3]


def setting(spark: SparkSession, sf_dir: str) -> Setting:
    """The window runs from the first to the last month in which nine tenths of all series have a value. One scan of the
    facts; the window is found on a row a month."""
    p = checkpointed(panel(spark, sf_dir))
    months = p.groupBy("month").agg(F.count("*").alias("c")).crossJoin(p.agg(F.countDistinct("entity").alias("k")))  # one row
    row = months.where("10 * c >= 9 * k").agg(F.min("month").alias("a"), F.max("month").alias("z")).first()
    return Setting(p, *((row["a"], row["z"]) if row["a"] is not None else (0, -1)))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, nation, region) of suppliers. Nations and regions are fixed dimensions of 25 and 5 rows."""
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    named = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey)
    supplier = read(spark, sf_dir, "supplier")
    return supplier.join(F.broadcast(named), supplier.s_nationkey == named.n_nationkey).select(
        F.col("s_suppkey").alias("entity"), F.col("n_name").alias("nation"), F.col("r_name").alias("region")
    )


#: The same tables in SQL, to start a WITH list.
MI = "(year({0}) * 12 + month({0}) - 1)::BIGINT"
SQL_PANEL = (
    "panel AS (SELECT l_suppkey AS entity, (year(l_shipdate) * 12 + month(l_shipdate) - 1)::BIGINT AS month, "
    "round(sum(l_extendedprice), 2) AS value, count(*)::BIGINT AS n FROM lineitem GROUP BY 1, 2), "
    "win AS MATERIALIZED (SELECT min(month) AS a, max(month) AS z FROM (SELECT month, count(*) AS c FROM panel GROUP BY 1) "
    "WHERE 10 * c >= 9 * (SELECT count(DISTINCT entity) FROM panel))"
)
#: First and last month of the complete window, and the first of its last two years.
S_FIRST, S_LAST, S_24 = "(SELECT a FROM win)", "(SELECT z FROM win)", "((SELECT z FROM win) - 23)"
SQL_CAT = (
    "cat AS (SELECT l_suppkey AS entity, l_returnflag AS category, (year(l_shipdate) * 12 + month(l_shipdate) - 1)::BIGINT AS month, "
    "round(sum(l_extendedprice), 2) AS value, count(*)::BIGINT AS n FROM lineitem GROUP BY 1, 2, 3)"
)
SQL_PLACES = (
    "places AS (SELECT s_suppkey AS entity, n_name AS nation, r_name AS region FROM supplier "
    "JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
)
SQL_FULL = (
    f"full_panel AS (SELECT * FROM panel WHERE month BETWEEN {S_FIRST} AND {S_LAST} AND entity IN (SELECT entity FROM panel "
    f"WHERE month BETWEEN {S_FIRST} AND {S_LAST} GROUP BY entity HAVING count(*) = {S_LAST} - {S_FIRST} + 1))"
)
