"""Readers for the landing-zone formats: everything through Spark, so any file system works."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import number, padded_code


def parquet_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table of the contract: an absent file is an empty table with its declared columns."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def csv(spark: SparkSession, path: str, schema: str, sep: str = ",", header: bool = True, encoding: str = "UTF-8") -> DataFrame:
    return spark.read.csv(path, schema=schema, sep=sep, header=header, encoding=encoding, mode="FAILFAST")


def recoded(df: DataFrame, column: str, codes: Mapping[str, str]) -> DataFrame:
    """Stripped values replaced by their code; an unknown value is an error."""
    table = F.create_map(*(F.lit(x) for kv in codes.items() for x in kv))
    code = F.try_element_at(table, F.trim(column))
    message = F.concat(F.lit(f"unknown {column}: "), F.coalesce(F.col(column), F.lit("null")))
    return df.withColumn(column, F.when(code.isNotNull(), code).otherwise(F.raise_error(message).cast("string")))


def valid_version(df: DataFrame, key: str, year: int, since: str = "year_from", until: str = "year_to", tie: str | None = None) -> DataFrame:
    """Of each key, the version valid in ``year``, else the latest; ``tie`` orders equal ones."""
    valid = (F.col(since) <= year) & (F.coalesce(until, F.lit(9999)) >= year)
    w = Window.partitionBy(key).orderBy(valid.desc(), F.coalesce(until, F.lit(9999)).desc(), F.col(since).desc(), *([F.col(tie)] if tie else []))
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def headerless_codes(spark: SparkSession, path: str, section: str = "1") -> DataFrame:
    """A headerless dictionary (c1..c4 code parts, section, name): one section, header rows rejected, code assembled."""
    raw = csv(spark, path, "c1 string, c2 string, c3 string, c4 string, section string, name string", sep=";", header=False)
    rows = raw.where((F.trim("section") == section) & F.trim("c1").rlike("^[0-9]+$"))
    code = F.concat(padded_code(F.col("c1"), 2), padded_code(F.col("c2"), 3), padded_code(F.col("c3"), 3))
    return rows.select(code.alias("code"), F.trim("name").alias("name")).where(F.col("name") != "")


def stateful_header(rows: DataFrame, order: str, header: Column, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows below a header row carry it; header rows themselves go. ``order`` is the row's place in its file, ``by`` names
    the file. Without ``by`` all rows are one file, which one task reads: only for a single small file."""
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_h", header).withColumn(name, F.last("_h", ignorenulls=True).over(w)).where("_h is null").drop("_h")


def calendar_days(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Calendar JSON {year, months: [{month, days: "1,2*,3+"}]} to (date, kind): off, short (*) or moved (+) days."""
    raw = spark.read.json(path, multiLine=multi_line, schema="year int, months array<struct<month:int,days:string>>")
    days = raw.select("year", F.explode("months").alias("m")).select("year", "m.month", F.explode(F.split("m.days", ",")).alias("d"))
    day = F.regexp_extract("d", "[0-9]+", 0).cast("int")
    kind = F.when(F.col("d").endswith("*"), "short").when(F.col("d").endswith("+"), "moved").otherwise("off")
    return days.select(F.make_date("year", "month", day).alias("date"), kind.alias("kind"))


def currency_rates(spark: SparkSession, path: str) -> DataFrame:
    """XML records (Date attribute, Nominal, Value with a decimal comma) to (month, rate, change)."""
    schema = "_Date string, Nominal string, Value string"
    raw = spark.read.format("xml").option("rowTag", "Record").schema(schema).load(path)
    rate = number(F.col("Value")) / number(F.col("Nominal"))
    monthly = raw.select(F.trunc(F.to_date("_Date", "dd.MM.yyyy"), "month").alias("month"), rate.alias("r")).groupBy("month").agg(F.avg("r").alias("rate"))
    return monthly.withColumn("change", F.col("rate") / F.lag("rate").over(Window.orderBy("month")) - 1)  # one row a month


def sdmx_series(spark: SparkSession, path: str, labels: DataFrame | None = None) -> DataFrame:
    """Generic SDMX to (dimension values map, time, value), with code-list labels joined if given (dimension, code, label)."""
    key = "SeriesKey struct<Value:array<struct<_concept:string,_value:string>>>"
    obs = "Obs array<struct<Time:string,ObsValue:struct<_value:string>>>"
    raw = spark.read.format("xml").option("rowTag", "Series").schema(f"{key}, {obs}").load(path)
    rows = raw.select(
        F.map_from_entries(F.transform("SeriesKey.Value", lambda v: F.struct(v["_concept"], v["_value"]))).alias("keys"), F.explode("Obs").alias("o")
    ).select("keys", F.col("o.Time").alias("time"), number(F.col("o.ObsValue._value")).alias("value"))
    if labels is None:
        return rows
    long = rows.select("*", F.explode("keys").alias("dimension", "code"))
    return long.join(F.broadcast(labels), ["dimension", "code"], "left").select("time", "value", "dimension", "code", "label")


def block_csv(spark: SparkSession, path: str, encoding: str = "cp1251") -> DataFrame:
    """Blocks parted by blank lines, each a title, a line of years and rows of values: (file, title, name, year, value).

    A file is one row here; such files are kilobytes. Spark's own decode knows no single-byte Cyrillic charset.
    """

    @F.pandas_udf("string")
    def decoded(content: pd.Series) -> pd.Series:
        return content.map(lambda b: b.decode(encoding))

    raw = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), decoded("content").alias("t"))
    block = raw.select("file", F.explode(F.split(F.replace("t", F.lit("\r"), F.lit("")), r"\n\s*\n")).alias("b"))
    lines = block.select("file", F.filter(F.split("b", "\n"), lambda x: F.trim(x) != "").alias("l")).where(F.size("l") >= 3)
    rows = lines.select("file", F.col("l")[0].alias("title"), F.split(F.col("l")[1], ";").alias("years"), F.explode(F.slice("l", F.lit(3), F.size("l"))).alias("r"))
    cells = rows.select("file", "title", "years", F.split("r", ";").alias("c")).select("file", "title", F.col("c")[0].alias("name"), F.posexplode(F.arrays_zip("years", "c")).alias("pos", "x"))
    return cells.where("pos > 0").select("file", "title", "name", F.regexp_extract("x.years", "[0-9]{4}", 0).try_cast("int").alias("year"), number(F.col("x.c")).alias("value"))


def with_path_code(df: DataFrame, pattern: str, name: str) -> DataFrame:
    """A code taken from each row's file path."""
    return df.withColumn(name, F.regexp_extract(F.input_file_name(), pattern, 1))


def weather(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """JSON {region, daily: {time: [...], temp: [...], rain: [...]}} to daily rows."""
    raw = spark.read.json(path, multiLine=multi_line, schema="region string, daily struct<time:array<string>,temp:array<double>,rain:array<double>>")
    rows = raw.select("region", F.inline(F.arrays_zip("daily.time", "daily.temp", "daily.rain")))
    names = rows.columns
    return rows.select("region", F.to_date(names[1]).alias("date"), F.col(names[2]).alias("temp"), F.col(names[3]).alias("rain"))


def html_listing(pages: DataFrame, html: str, item: str, fields: Mapping[str, str]) -> DataFrame:
    """Items of a listing page by a pattern, and their fields by patterns with one group."""
    items = pages.select(F.explode(F.regexp_extract_all(html, F.lit(item), F.lit(0))).alias("_i"))
    return items.select(*(F.regexp_extract("_i", p, 1).alias(k) for k, p in fields.items()))


def coded_events(spark: SparkSession, path: str, columns: Mapping[str, int], width: int, country: tuple[str, str]) -> DataFrame:
    """Headerless tab-separated exports of ``width`` columns: some columns by place, one country, bad numbers null.

    Lines of another width are not events; ``other_widths`` counts them, so none goes unnoticed.
    """
    cells = _cells(spark, path).where(F.size("c") == width)
    rows = cells.select(*(F.nullif(F.col("c")[i], F.lit("")).alias(k) for k, i in columns.items()))
    return rows.where(F.col(country[0]) == country[1])


def other_widths(spark: SparkSession, path: str, width: int) -> DataFrame:
    """(file, width, lines): what ``coded_events`` leaves out."""
    cells = _cells(spark, path).where(F.size("c") != width)
    return cells.groupBy("file", F.size("c").alias("width")).agg(F.count("*").alias("lines"))


def _cells(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).where(F.length("value") > 0)
    return lines.select(F.input_file_name().alias("file"), F.split("value", "\t", -1).alias("c"))


def deduplicated_dump(spark: SparkSession, path: str, schema: str, key: str, newest: str, sep: str = "|") -> DataFrame:
    """A large separated dump with a header, one row for each key: the newest, of equal ones the first by content.

    A key's rows are reduced before the shuffle, so a key that is repeated very often is no hot spot.
    """
    raw = csv(spark, path, schema, sep=sep).where(F.col(key).isNotNull())
    row = F.struct(*(c for c in raw.columns if c != key))
    best = raw.groupBy(key).agg(F.max_by(row.alias("row"), F.struct(F.col(newest), F.xxhash64(*raw.columns))).alias("row"))
    return best.select(key, "row.*").select(raw.columns)


def listed_between(manifest: DataFrame, url: str, start: str, end: str) -> DataFrame:
    """Manifest rows whose url carries a time stamp of 14 digits inside [start, end]."""
    stamp = F.regexp_extract(url, "([0-9]{14})", 1)
    return manifest.withColumn("stamp", stamp).where(stamp.between(start, end))


def melted(df: DataFrame, keys: Sequence[str], values: Sequence[str], name: str = "date", value: str = "value") -> DataFrame:
    """Wide columns to rows; values as numbers."""
    return df.unpivot(list(keys), list(values), name, "_v").select(*keys, name, number(F.col("_v")).alias(value)).where(F.col(value).isNotNull())


def as_of_first_day(df: DataFrame, date: str) -> DataFrame:
    """A figure "as of 01.MM" belongs to the month before."""
    return df.withColumn(date, F.add_months(F.trunc(date, "month"), -1))


def latest_file(spark: SparkSession, folder: str, pattern: str) -> str:
    """Path of the file that sorts last among those that match."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path")
    found = files.agg(F.max("path")).first()[0]
    if found is None:
        raise FileNotFoundError(f"{folder}/{pattern}")
    return found
