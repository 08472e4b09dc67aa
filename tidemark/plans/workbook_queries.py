"""Spreadsheets on whole tables: each query writes a given table as workbooks, of a bounded number of rows each, and reads them back."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.panel import month_idx
from ..sources import readers as R
from ..sources import sinks as S
from ..sources import workbooks as W
from .base import SQL_CAT, category_panel, query, read
from .source_queries import folder

#: Customers and suppliers whose rows share a workbook.
CUSTOMERS, SUPPLIERS = 500, 50


def put(rows: DataFrame, by: str, make, path: str) -> None:
    """One file for each value of ``by``, made from its rows; a value's rows are as many as a workbook holds at most."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        name, content = make(group)
        return pd.DataFrame({"name": [name], "content": [content]})

    S.write_files(rows.groupBy(by).applyInPandas(run, "name string, content binary"), path).count()


@query("""SELECT o_orderkey AS order_key, o_custkey AS customer, o_orderpriority AS priority, round(o_totalprice, 2) AS price, o_orderdate::DATE::TIMESTAMP AS ordered FROM orders""")
def source_workbooks(spark: SparkSession, d: str) -> DataFrame:
    """Orders as workbooks with a sheet for each priority (its name is the sheet's) and typed cells; all sheets stacked again."""

    def make(group: pd.DataFrame) -> tuple[str, bytes]:
        sheets = []
        for priority, rows in group.sort_values("o_orderkey").groupby("o_orderpriority"):
            cells = zip(rows["o_orderkey"].tolist(), rows["o_custkey"].tolist(), rows["price"].tolist(), rows["ordered"], strict=True)
            sheets.append((priority, [["Order", "Customer", "Price", "Date"], *map(list, cells)], ()))
        return f"orders-{group['book'].iloc[0]:08d}.xlsx", W.workbook_bytes([("Contents", [["Orders by priority"]], ()), *sheets])

    o = read(spark, d, "orders").where("o_custkey is not null")
    o = o.select("o_orderkey", "o_custkey", "o_orderpriority", F.round("o_totalprice", 2).alias("price"), F.to_date("o_orderdate").alias("ordered"), F.floor(F.col("o_custkey") / CUSTOMERS).alias("book"))
    path = folder(spark)
    put(o, "book", make, path)
    rows = W.titled(W.sheet_rows(spark, path, sheet="^[0-9]-", glob="*.xlsx"), {"order_key": 0, "customer": 1, "price": 2, "ordered": 3})
    return rows.select(F.col("order_key").cast("long"), F.col("customer").cast("long"), F.col("sheet").alias("priority"), F.col("price").cast("double"), F.col("ordered").cast("timestamp"))


_NAMES = ", ".join(f"'{m}'" for m in W.MONTH_NAMES)


@query(f"""WITH {SQL_CAT} SELECT 'Supplier ' || entity AS entity, 'flag ' || category AS flag, [{_NAMES}][(month % 12 + 1)::INT] AS period, (month // 12)::INT AS year, value FROM cat""")
def source_crosstab(spark: SparkSession, d: str) -> DataFrame:
    """The supplier panel as cross tables in both layouts: every other workbook is wide (merged years over months over flags), the others are long."""

    def make(group: pd.DataFrame) -> tuple[str, bytes]:
        book = int(group["book"].iloc[0])
        group = group.sort_values(["entity", "month", "category"])
        group["period"] = [W.MONTH_NAMES[m % 12] for m in group["month"]]
        if book % 2:
            rows = [[f"Supplier {e}", f" flag {c} ", p, str(m // 12), v] for e, c, p, m, v in zip(group["entity"], group["category"], group["period"], group["month"], group["value"].tolist(), strict=True)]
            return f"long-{book:08d}.xlsx", W.workbook_bytes([("Data", [["Turnover by supplier"], [], ["Supplier", "Flag", "Period", "Year", "Value"], *rows], ())])
        columns = sorted(set(zip(group["month"], group["category"], strict=True)))
        place = {c: 1 + k for k, c in enumerate(columns)}
        years, months, flags, merges = [None], [None], [None], []
        for (month, flag), at in place.items():
            for row, (line, value, before) in enumerate(((years, str(month // 12), (month - 1) // 12 if at > 1 else None), (months, W.MONTH_NAMES[month % 12], None))):
                key = month // 12 if row == 0 else month
                last = merges and next((m for m in reversed(merges) if m[0] == 2 + row), None)
                if last and last[4] == key:
                    merges[merges.index(last)] = (*last[:3], at, key)
                    line.append(None)
                else:
                    merges.append((2 + row, at, 2 + row, at, key))
                    line.append(value)
            flags.append(f"flag {flag}")
        body = []
        for entity, rows in group.groupby("entity"):
            line: list = [f"  Supplier {entity}", *[None] * len(columns)]
            for m, c, v in zip(rows["month"], rows["category"], rows["value"].tolist(), strict=True):
                line[place[m, c]] = f"{v:.2f}".replace(".", ",")
            body.append(line)
        ranges = [m[:4] for m in merges if m[1] < m[3]]
        return f"wide-{book:08d}.xlsx", W.workbook_bytes([("Data", [["Turnover by supplier, by month"], [], years, months, flags, *body], ranges)])

    path = folder(spark)
    put(category_panel(spark, d).withColumn("book", F.floor(F.col("entity") / SUPPLIERS)), "book", make, path)
    found = W.crosstab(W.sheet_rows(spark, path, fill="across", glob="*.xlsx"))
    return found.select(F.col("dims")[0].alias("entity"), F.col("dims")[1].alias("flag"), "period", "year", "value")


@query("""SELECT n_name AS nation, (year(o_orderdate) * 12 + month(o_orderdate) - 1)::BIGINT AS month, count(*)::DOUBLE AS orders, round(sum(o_totalprice), 2) AS total,
count(*) FILTER (o_orderstatus = 'F')::DOUBLE AS closed FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""")
def source_coded_columns(spark: SparkSession, d: str) -> DataFrame:
    """Monthly reports as archives of workbooks, "as of" the first day of the next month: one book of two, sheets by their prefix, columns by a row of codes."""

    def make(group: pd.DataFrame) -> tuple[str, bytes]:
        group, month = group.sort_values("nation"), int(group["month"].iloc[0]) + 1
        rows = [[n, float(a), None, float(b)] for n, a, b in zip(group["nation"], group["orders"], group["closed"], strict=True)]
        count = ("1000-all", [["Orders received"], ["", "Total", "of which", ""], ["А", "1000", "1000.1", "1000.4"], *rows, [None, 0.0, None, 0.0]], ((1, 2, 1, 3),))
        money = ("1130-sums", [["Value"], ["А", "1129", "1130"], *([n, "x", f"{v:.2f}"] for n, v in zip(group["nation"], group["total"].tolist(), strict=True))], ())
        book = W.workbook_bytes([("11300-other", [["А", "1130"], ["nobody", 1.0]], ()), count, money])
        decoy = W.workbook_bytes([("1000-all", [["А", "1000"], ["nobody", 1.0]], ())])
        as_of = dt.date(month // 12, month % 12 + 1, 1)
        return f"report_{as_of}.zip", W.archive_bytes({"Orders by nation.xlsx": book, "Orders by branch.xlsx": decoy, "notes.txt": b"none"})

    o, c = read(spark, d, "orders"), read(spark, d, "customer").select("c_custkey", "c_nationkey")
    n = read(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("nation"))
    facts = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey", month_idx("o_orderdate").alias("month"))
    facts = facts.agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("closed"))
    path = folder(spark)
    put(facts.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")), "month", make, path)  # nations: a dimension of 25 rows
    dated = F.to_date(F.regexp_extract("file", r"_([0-9-]{10})\.zip$", 1))
    found = None
    for prefix, codes in {"1000": {"1000": "orders", "1000.4": "closed"}, "1130": {"1130": "total"}}.items():
        sheet = W.by_code_row(W.sheet_rows(spark, path, sheet=f"^{prefix}(?:-|$)", book="by nation", glob="report_*.zip"), "А", codes)
        sheet = R.as_of_first_day(sheet.withColumn("date", dated), "date").select(F.col("name").alias("nation"), month_idx("date").alias("month"), *codes.values())
        found = sheet if found is None else found.join(sheet, ["nation", "month"])
    return found.select("nation", "month", "orders", "total", "closed")
