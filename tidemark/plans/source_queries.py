"""Sources and sinks on whole tables: each query lets Spark write a given table in a landing-zone format, reads it with the
reader for that format, and must give what SQL gives on the table itself."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.quality import manifest
from ..sources import readers as R
from ..sources import sinks as S
from .base import SQL_PANEL, panel, query, read


def folder(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='files-')}"
    return f"{base.rstrip('/')}/files-{uuid.uuid4().hex}"


def lines(df: DataFrame, path: str, *parts, sep: str = ";", header: str | None = None) -> str:
    """Rows as separated values; a header, if any, goes on top of each file."""
    names = header.split(sep) if header else [f"c{i}" for i in range(len(parts))]
    shown = (F.coalesce(p.cast("string"), F.lit("")).alias(n) for p, n in zip(parts, names, strict=True))
    df.select(*shown).write.csv(path, sep=sep, header=header is not None)
    return path


@query("""SELECT c_custkey AS customer, c_nationkey AS nation, round(c_acctbal, 2) AS balance, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'A' WHEN 'BUILDING' THEN 'B' WHEN 'FURNITURE' THEN 'F' WHEN 'MACHINERY' THEN 'M' WHEN 'HOUSEHOLD' THEN 'H' END AS segment FROM customer""")
def source_csv_recode(spark: SparkSession, d: str) -> DataFrame:
    """A semicolon CSV with decimal commas and padded labels: typed, stripped, recoded; an unknown label would be an error."""
    c = read(spark, d, "customer")
    path = lines(c, folder(spark), F.col("c_custkey"), F.col("c_nationkey"), T.decimal_comma(F.col("c_acctbal")), F.concat(F.lit(" "), "c_mktsegment", F.lit(" ")), sep=";", header="customer;nation;balance;segment")
    raw = R.csv(spark, path, "customer long, nation int, balance string, segment string", sep=";")
    codes = {"AUTOMOBILE": "A", "BUILDING": "B", "FURNITURE": "F", "MACHINERY": "M", "HOUSEHOLD": "H"}
    return R.recoded(raw, "segment", codes).withColumn("balance", T.number(F.col("balance")))


@query("""WITH v AS (SELECT s_nationkey AS key, s_suppkey AS version, (1990 + s_suppkey % 20)::INT AS a, CASE WHEN s_suppkey % 3 > 0 THEN (1990 + s_suppkey % 20 + s_suppkey % 5)::INT END AS b FROM supplier)
SELECT key, version FROM v QUALIFY row_number() OVER (PARTITION BY key ORDER BY (a <= 2000 AND coalesce(b, 9999) >= 2000) DESC, coalesce(b, 9999) DESC, a DESC, version) = 1""")
def source_versions(spark: SparkSession, d: str) -> DataFrame:
    """Of each key, the dictionary version valid in a year, else the latest; equal ones by their number."""
    s = read(spark, d, "supplier").select(
        F.col("s_nationkey").alias("key"), F.col("s_suppkey").alias("version"), (1990 + F.col("s_suppkey") % 20).cast("int").alias("year_from"),
        F.when(F.col("s_suppkey") % 3 > 0, (1990 + F.col("s_suppkey") % 20 + F.col("s_suppkey") % 5).cast("int")).alias("year_to"),
    )
    return R.valid_version(s, "key", 2000, tie="version").select("key", "version")


@query("""SELECT lpad((s_nationkey + 1)::VARCHAR, 2, '0') || lpad((s_suppkey % 1000)::VARCHAR, 3, '0') || lpad((s_suppkey // 1000)::VARCHAR, 3, '0') AS code, s_name AS name FROM supplier WHERE s_suppkey % 2 = 0""")
def source_headerless_codes(spark: SparkSession, d: str) -> DataFrame:
    """A headerless dictionary of code parts with two sections and header rows inside: one section, codes with leading zeros."""
    s = read(spark, d, "supplier")
    head = spark.range(1).select(F.lit("Code").alias("a"), F.lit("x").alias("b"), F.lit("y").alias("c"), F.lit("1").alias("e"), F.lit("Name").alias("n"))
    rows = s.select(
        (F.col("s_nationkey") + 1).cast("string").alias("a"), (F.col("s_suppkey") % 1000).cast("string").alias("b"), F.floor(F.col("s_suppkey") / 1000).cast("string").alias("c"),
        (1 + F.col("s_suppkey") % 2).cast("string").alias("e"), F.concat(F.lit(" "), "s_name").alias("n"),
    )
    both = head.unionByName(rows)
    path = lines(both, folder(spark), F.col("a"), F.col("b"), F.col("c"), F.lit("0"), F.col("e"), F.col("n"))
    return R.headerless_codes(spark, path)


@query("""SELECT o_orderkey AS order_key, l_linenumber::BIGINT AS line, 'Order ' || o_orderkey AS header FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def source_stateful_header(spark: SparkSession, d: str) -> DataFrame:
    """Lines below a header row, as in a report; the header names the order that the lines belong to. A file for each order."""
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("file"), F.lit(0).cast("long").alias("place"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("cell"))
    li = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").cast("long").alias("place"), F.lit("line").alias("cell"))
    report = o.unionByName(li.join(o.select("file"), "file", "left_semi"))
    named = R.stateful_header(report, "place", F.when(F.col("cell").startswith("Order"), F.col("cell")), "header", ["file"])
    return named.select(F.col("file").alias("order_key"), F.col("place").alias("line"), "header")


@query("""WITH d AS (SELECT DISTINCT o_orderdate::DATE AS date FROM orders) SELECT date::VARCHAR AS date, CASE day(date) % 3 WHEN 0 THEN 'off' WHEN 1 THEN 'short' ELSE 'moved' END AS kind FROM d""")
def source_calendar(spark: SparkSession, d: str) -> DataFrame:
    """A calendar as JSON by year, months and marked days, from the days on which orders came, and back to rows."""
    days = read(spark, d, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    mark = F.concat(F.day("date").cast("string"), F.element_at(F.array(F.lit(""), F.lit("*"), F.lit("+")), (F.day("date") % 3 + 1).cast("int")))
    months = days.groupBy(F.year("date").alias("year"), F.month("date").alias("month")).agg(F.concat_ws(",", F.collect_list(mark)).alias("days"))
    years = months.groupBy("year").agg(F.collect_list(F.struct("month", "days")).alias("months"))
    path = folder(spark)
    years.write.json(path)
    return R.calendar_days(spark, path, multi_line=False).withColumn("date", F.col("date").cast("string"))


@query("""WITH m AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, avg(round(o_totalprice, 2) / 10) AS rate FROM orders GROUP BY 1)
SELECT month::VARCHAR AS month, round(rate, 6) AS rate, round(rate / lag(rate) OVER (ORDER BY month) - 1, 6) AS change FROM m""")
def source_rates_xml(spark: SparkSession, d: str) -> DataFrame:
    """Order prices as rate records in XML, with a nominal and decimal commas: monthly means and their change."""
    o = read(spark, d, "orders").select(
        F.date_format("o_orderdate", "dd.MM.yyyy").alias("_Date"), F.lit("10").alias("Nominal"), T.decimal_comma(F.col("o_totalprice")).alias("Value")
    )
    path = folder(spark)
    o.write.format("xml").option("rowTag", "Record").option("rootTag", "Rates").save(path)
    return R.currency_rates(spark, path).select(F.col("month").cast("string").alias("month"), F.round("rate", 6).alias("rate"), F.round("change", 6).alias("change"))


@query("""SELECT n_name AS label, (year(o_orderdate))::VARCHAR AS time, round(sum(o_totalprice), 2) AS value FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""")
def source_sdmx(spark: SparkSession, d: str) -> DataFrame:
    """Yearly totals as generic SDMX series by nation code, read back with labels from the code list."""
    o = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    year = o.groupBy(F.col("c_nationkey").cast("string").alias("code"), F.year("o_orderdate").cast("string").alias("Time")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    obs = F.struct("Time", F.struct(F.format_string("%.2f", "v").alias("_value")).alias("ObsValue"))
    series = year.groupBy("code").agg(F.collect_list(obs).alias("Obs"))
    key = F.struct(F.array(F.struct(F.lit("NATION").alias("_concept"), F.col("code").alias("_value"))).alias("Value"))
    path = folder(spark)
    series.select(key.alias("SeriesKey"), "Obs").write.format("xml").option("rowTag", "Series").option("rootTag", "Root").save(path)
    labels = read(spark, d, "nation").select(F.lit("NATION").alias("dimension"), F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("label"))
    return R.sdmx_series(spark, path, labels).select("label", "time", "value")


@query(f"""WITH {SQL_PANEL}, s AS (SELECT entity, month // 12 AS year, round(sum(value), 2) AS value FROM panel GROUP BY 1, 2), y AS (SELECT DISTINCT year FROM s), e AS (SELECT DISTINCT entity FROM s)
SELECT 'Block ' || entity % 7 AS title, 'S' || entity AS name, year::INT AS year, value FROM e CROSS JOIN y LEFT JOIN s USING (entity, year)""")
def source_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Yearly sums in blocks of a title, a line of years and rows of values with dashes for missing ones, in a single-byte charset."""
    s = panel(spark, d).groupBy("entity", F.floor(F.col("month") / 12).cast("int").alias("year")).agg(F.round(F.sum("value"), 2).alias("value"))
    years = F.broadcast(s.agg(F.array_sort(F.collect_set("year")).alias("years")))  # a calendar
    wide = s.groupBy("entity").agg(F.map_from_entries(F.collect_list(F.struct("year", "value"))).alias("m")).crossJoin(years)
    cells = F.transform("years", lambda y: F.coalesce(T.decimal_comma(F.try_element_at(F.col("m"), y)), F.lit("-")))
    rows = wide.select("entity", F.concat_ws(";", F.concat(F.lit("S"), F.col("entity").cast("string")), cells).alias("row"), F.concat(F.lit(";"), F.array_join(F.transform("years", lambda y: y.cast("string")), ";")).alias("head"))
    blocks = rows.groupBy((F.col("entity") % 7).alias("k")).agg(F.first("head").alias("head"), F.array_join(F.array_sort(F.collect_list("row")), "\n").alias("rows"))
    text = F.concat(F.lit("Block "), F.col("k").cast("string"), F.lit("\n"), "head", F.lit("\n"), "rows", F.lit("\n\n"))
    path = folder(spark)
    blocks.select(text.alias("value")).write.option("lineSep", "\n").text(path)
    return R.block_csv(spark, f"{path}/*.txt").select("title", "name", "year", "value")


@query("""SELECT n_nationkey::VARCHAR AS code, count(*)::BIGINT AS suppliers, round(sum(s_acctbal), 2) AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1""")
def source_path_codes(spark: SparkSession, d: str) -> DataFrame:
    """Files in a folder for each nation: the code comes from the path, the reference file says which codes exist."""
    path = folder(spark)
    read(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), "s_suppkey", "s_acctbal").write.partitionBy("nation").parquet(path)
    found = R.with_path_code(spark.read.parquet(f"{path}/nation=*"), "nation=([0-9]+)", "code")
    known = read(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("code"))
    return found.join(known, "code").groupBy("code").agg(F.count("*").alias("suppliers"), F.round(F.sum("s_acctbal"), 2).alias("balance"))


@query("""SELECT user_id::VARCHAR AS region, ts::DATE::VARCHAR AS date, round(avg(value), 6) AS temp, count(*)::DOUBLE AS rain FROM events GROUP BY 1, 2""")
def source_weather(spark: SparkSession, d: str) -> DataFrame:
    """Daily values of a region as JSON of parallel arrays, and back to rows."""
    day = read(spark, d, "events").groupBy(F.col("user_id").cast("string").alias("region"), F.to_date("ts").cast("string").alias("day"))
    day = day.agg(F.round(F.avg("value"), 6).alias("temp"), F.count("*").cast("double").alias("rain"))
    rows = day.groupBy("region").agg(F.array_sort(F.collect_list(F.struct("day", "temp", "rain"))).alias("a"))
    daily = F.struct(F.col("a.day").alias("time"), F.col("a.temp").alias("temp"), F.col("a.rain").alias("rain"))
    path = folder(spark)
    rows.select("region", daily.alias("daily")).write.json(path)
    return R.weather(spark, path, multi_line=False).withColumn("date", F.col("date").cast("string"))


@query("""SELECT event_id::VARCHAR AS id, event_type AS type, strftime(ts, '%Y%m%d%H%M%S') AS stamp FROM events WHERE user_id % 5 = 2""")
def source_coded_events(spark: SparkSession, d: str) -> DataFrame:
    """Events as a headerless tab-separated export of nine columns: three by place, one country; broken lines are left out."""
    e = read(spark, d, "events")
    country = F.concat(F.lit("C"), (F.col("user_id") % 5).cast("string"))
    path, blank = folder(spark), F.lit("")
    good = e.select(F.concat_ws("\t", F.col("event_id").cast("string"), F.date_format("ts", "yyyyMMddHHmmss"), blank, "event_type", blank, blank, country, blank, F.lit("x")).alias("value"))
    broken = e.select(F.concat_ws("\t", F.lit("broken"), F.col("event_id").cast("string")).alias("value"))
    good.unionByName(broken).write.text(path)
    return R.coded_events(spark, path, {"id": 0, "stamp": 1, "type": 3, "country": 6}, 9, ("country", "C2")).select("id", "type", "stamp")


@query("""SELECT event_id, strftime(ts, '%Y%m%d%H%M%S') AS stamp FROM events WHERE ts::DATE BETWEEN (SELECT min(ts)::DATE + 5 FROM events) AND (SELECT min(ts)::DATE + 14 FROM events)""")
def source_manifest_window(spark: SparkSession, d: str) -> DataFrame:
    """Entries of a file list whose url carries a time stamp inside ten days."""
    e = read(spark, d, "events")
    first = e.agg(F.date_format(F.date_add(F.min("ts").cast("date"), 5), "yyyyMMdd").alias("a"), F.date_format(F.date_add(F.min("ts").cast("date"), 14), "yyyyMMdd").alias("b")).first()
    urls = e.select("event_id", F.concat(F.lit("https://example.org/"), F.date_format("ts", "yyyyMMddHHmmss"), F.lit(".zip")).alias("url"))
    return R.listed_between(urls, "url", f"{first['a'] or ''}000000", f"{first['b'] or ''}235959").select("event_id", "stamp")


@query("""SELECT o_orderkey AS id, o_custkey AS customer, round(o_totalprice * 2, 2) AS price, printf('%.1f', o_custkey / 10) AS lat FROM orders""")
def source_dump_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Orders in two states as one pipe-separated dump, the newer one kept; a coordinate is taken out of its JSON cell."""
    o = read(spark, d, "orders")
    place = F.format_string('{"lat": %.1f, "lon": 1}', F.col("o_custkey") / 10)
    path = folder(spark)
    for i, factor in enumerate((1, 2)):
        rows = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer"), F.round(F.col("o_totalprice") * factor, 2).alias("price"), F.lit(i).alias("version"), place.alias("place"))
        rows.write.csv(f"{path}/{i}", sep="|", header=True)
    found = R.deduplicated_dump(spark, f"{path}/*", "id long, customer long, price double, version int, place string", "id", "version")
    return found.select("id", "customer", "price", F.regexp_extract("place", '"lat": *([0-9.]+)', 1).alias("lat"))


_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


@query(f"""WITH {SQL_PANEL}, s AS (SELECT entity, month % 12 AS m, round(avg(value), 4) AS value FROM panel GROUP BY 1, 2)
SELECT entity, {list(_MONTHS)}[m::INT + 1] AS date, value FROM s""")
def source_melt(spark: SparkSession, d: str) -> DataFrame:
    """A wide sheet of twelve months with decimal commas and dashes, melted to rows."""
    p = panel(spark, d).withColumn("m", F.col("month") % 12)
    wide = p.groupBy("entity").pivot("m", list(range(12))).agg(F.round(F.avg("value"), 4))
    shown = wide.select("entity", *(F.coalesce(T.decimal_comma(F.col(str(k)), 4), F.lit("-")).alias(v) for k, v in enumerate(_MONTHS)))
    return R.melted(shown, ["entity"], list(_MONTHS))


@query(f"""WITH {SQL_PANEL} SELECT entity, month, value FROM panel WHERE n > 1""")
def sink_write_if_changed(spark: SparkSession, d: str) -> DataFrame:
    """Written, written again in another order (skipped), then with fewer rows (written): what a reader finds."""
    p, path = panel(spark, d).select("entity", "month", "value", "n"), folder(spark)
    steps = (S.write_if_changed(p, path), S.write_if_changed(p.orderBy("value"), path), S.write_if_changed(p.where("n > 1"), path))
    if steps[:2] != (True, False):
        raise AssertionError(f"writes: {steps}")
    return spark.read.parquet(path).select("entity", "month", "value")


@query(f"""WITH {SQL_PANEL} SELECT entity, sum(n)::BIGINT AS n, (SELECT count(*) FROM panel)::BIGINT AS rows FROM panel GROUP BY 1""")
def sink_publish(spark: SparkSession, d: str) -> DataFrame:
    """Two versions published one after the other: the pointer leads to the second, with its row counts."""
    p, path = panel(spark, d), folder(spark)
    S.publish({"panel": p.limit(0)}, path)
    S.publish({"panel": p}, path)
    rows = S.published(spark, path, "_tables").where("table = 'panel'").select("rows")
    return S.published(spark, path, "panel").groupBy("entity").agg(F.sum("n").alias("n")).crossJoin(F.broadcast(rows))  # one row


@query(f"""WITH {SQL_PANEL} SELECT entity, month, value, n FROM panel""")
def sink_json_export(spark: SparkSession, d: str) -> DataFrame:
    """The panel as JSON lines in a folder for each year, read back."""
    p, path = panel(spark, d), folder(spark)
    S.export_json(p.withColumn("year", F.floor(F.col("month") / 12)), path, "year")
    return spark.read.schema("entity long, month long, value double, n long").json(f"{path}/year=*")


@query("""SELECT n_regionkey AS region, count(*)::BIGINT AS copies FROM nation GROUP BY 1""")
def sink_manifest(spark: SparkSession, d: str) -> DataFrame:
    """A file for each nation that holds its region's key: files of equal content are found by their hashes."""
    n, path = read(spark, d, "nation"), folder(spark)
    n.select("n_nationkey", F.col("n_regionkey").cast("string").alias("value")).write.partitionBy("n_nationkey").text(path)
    found = manifest(spark, f"{path}/n_nationkey=*", "*.txt")
    keys = n.select(F.sha2(F.concat(F.col("n_regionkey").cast("string"), F.lit("\n")), 256).alias("sha256"), F.col("n_regionkey").alias("region")).distinct()
    return found.join(keys, "sha256").groupBy("region").agg(F.max("copies").cast("long").alias("copies"))


@query(f"""WITH {SQL_PANEL} SELECT entity, month FROM panel QUALIFY row_number() OVER (PARTITION BY entity ORDER BY month DESC) <= 12""")
def sink_retain(spark: SparkSession, d: str) -> DataFrame:
    """The newest twelve snapshots of each series."""
    return S.retain(panel(spark, d).select("entity", "month"), ["entity"], "month", 12)


@query("""SELECT event_id, ts::DATE::VARCHAR AS day, CASE WHEN ts::DATE >= (SELECT max(ts)::DATE - 2 FROM events) THEN value * 2 ELSE value END AS value FROM events""")
def sink_refetched_days(spark: SparkSession, d: str) -> DataFrame:
    """The last three days are fetched again with other values; only these days are replaced."""
    from ..streaming.events import upsert_days

    e = read(spark, d, "events").select("event_id", F.to_date("ts").alias("day"), "value")
    path = folder(spark)
    write = upsert_days(path)
    write(e, 0)
    last = e.agg(F.date_add(F.max("day"), -2).alias("last"))
    write(e.join(F.broadcast(last), F.col("day") >= F.col("last")).select("event_id", (F.col("value") * 2).alias("value"), "day"), 1)  # one row
    return spark.read.schema("event_id long, value double, day date").parquet(path).select("event_id", F.col("day").cast("string").alias("day"), "value")
