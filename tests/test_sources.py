"""Parsers on small fixtures, the empty-table contract, and publication."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources import readers as R
from tidemark.sources import sinks as S


def put(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_absent_table_is_empty(spark, tmp_path):
    schema = T.StructType([T.StructField("a", T.LongType())])
    assert R.parquet_or_empty(spark, str(tmp_path / "none"), schema).columns == ["a"]


def test_csv_recode_and_versions(spark, tmp_path):
    path = put(tmp_path / "a.csv", "k;c\n1; food \n2;odd\n")
    df = R.csv(spark, path, "k int, c string", sep=";")
    assert R.recoded(df.where("k = 1"), "c", {"food": "F"}).first().c == "F"
    with pytest.raises(Exception, match="unknown c"):
        R.recoded(df, "c", {"food": "F"}).collect()
    v = spark.createDataFrame([("a", 2000, 2010, 1), ("a", 2011, None, 2), ("b", 1990, 1995, 3)], "k string, year_from int, year_to int, v int")
    pick = lambda y: {r.k: r.v for r in R.valid_version(v, "k", y).collect()}
    assert pick(2005) == {"a": 1, "b": 3} and pick(2020) == {"a": 2, "b": 3}


def test_headerless_codes_and_stateful_header(spark, tmp_path):
    path = put(tmp_path / "o.csv", "Code;x;y;z;1;Name\n1;2;3;0;1; Town \n1;2;4;0;2;Village\n")
    assert [tuple(r) for r in R.headerless_codes(spark, path).collect()] == [("01002003", "Town")]
    rows = spark.createDataFrame([(1, "Region A"), (2, "x"), (3, "y"), (4, "Region B"), (5, "z")], "n int, t string")
    got = R.stateful_header(rows, "n", F.when(F.col("t").startswith("Region"), F.col("t")), "region").orderBy("n").collect()
    assert [(r.t, r.region) for r in got] == [("x", "Region A"), ("y", "Region A"), ("z", "Region B")]


def test_calendar_weather_and_rates(spark, tmp_path):
    path = put(tmp_path / "c.json", '{"year": 2024, "months": [{"month": 1, "days": "1,2,9*,10+"}]}')
    assert [(r.date.day, r.kind) for r in R.calendar_days(spark, path).orderBy("date").collect()] == [(1, "off"), (2, "off"), (9, "short"), (10, "moved")]
    path = put(tmp_path / "w.json", '{"region": "a", "daily": {"time": ["2024-01-01", "2024-01-02"], "temp": [1.5, null], "rain": [0.0, 2.0]}}')
    assert [(r.date, r.temp, r.rain) for r in R.weather(spark, path).orderBy("date").collect()] == [(dt.date(2024, 1, 1), 1.5, 0.0), (dt.date(2024, 1, 2), None, 2.0)]
    xml = "".join(f'<Record Date="{d}"><Nominal>{n}</Nominal><Value>{v}</Value></Record>' for d, n, v in (("10.01.2024", 1, "90,0"), ("20.01.2024", 10, "920,0"), ("05.02.2024", 1, "100,1")))
    path = put(tmp_path / "r.xml", f"<ValCurs>{xml}</ValCurs>")
    got = R.currency_rates(spark, path).orderBy("month").collect()
    assert [round(r.rate, 3) for r in got] == [91.0, 100.1] and got[0].change is None and round(got[1].change, 3) == 0.1


def test_sdmx(spark, tmp_path):
    series = '<Series><SeriesKey><Value concept="OKATO" value="45"/></SeriesKey><Obs><Time>2023</Time><ObsValue value="1,5"/></Obs><Obs><Time>2024</Time><ObsValue value="2"/></Obs></Series>'
    path = put(tmp_path / "s.xml", f"<Root>{series}{series}</Root>")
    rows = R.sdmx_series(spark, path).collect()
    assert len(rows) == 4 and {(r.time, r.value) for r in rows} == {("2023", 1.5), ("2024", 2.0)} and rows[0]["keys"] == {"OKATO": "45"}
    labels = spark.createDataFrame([("OKATO", "45", "City")], "dimension string, code string, label string")
    assert {r.label for r in R.sdmx_series(spark, path, labels).collect()} == {"City"}


def test_block_csv_html_and_coded_events(spark, tmp_path):
    path = put(tmp_path / "b.csv", "Доходы\n;2022;2023\nГород;1,5;2\nСело;-;3\n\nРасходы\n;2022;2023\nГород;7;…\n", "cp1251")
    got = {(r.title, r.name, r.year): r.value for r in R.block_csv(spark, path).collect()}
    assert got[("Доходы", "Город", 2022)] == 1.5 and got[("Доходы", "Село", 2022)] is None and got[("Расходы", "Город", 2022)] == 7.0
    page = spark.createDataFrame([('<ul><li><a href="/1">One</a><time>10:05</time></li><li><a href="/2">Two</a><time>11:00</time></li></ul>',), ("",)], "h string")
    items = R.html_listing(page, "h", r"<li>.*?</li>", {"url": 'href="([^"]*)"', "title": r'">([^<]*)</a>', "time": r"<time>([^<]*)<"})
    assert [tuple(r) for r in items.collect()] == [("/1", "One", "10:05"), ("/2", "Two", "11:00")]
    path = put(tmp_path / "e.tsv", "1\ta\tRS\n2\tb\tUS\n")
    assert [r.id for r in R.coded_events(spark, path, {"id": 0, "c": 2}, 3, ("c", "RS")).collect()] == ["1"]
    m = spark.createDataFrame([("http://x/20240101000000.zip",), ("http://x/20250101000000.zip",), ("none",)], "url string")
    assert R.listed_between(m, "url", "20240101000000", "20241231235959").count() == 1


def test_melt_dates_and_latest(spark, tmp_path):
    w = spark.createDataFrame([("a", "1,5", "-")], "k string, x string, y string")
    assert [tuple(r) for r in R.melted(w, ["k"], ["x", "y"]).collect()] == [("a", "x", 1.5)]
    d = spark.createDataFrame([(dt.date(2024, 3, 1),)], "date date")
    assert R.as_of_first_day(d, "date").first().date == dt.date(2024, 2, 1)
    put(tmp_path / "f-1.txt", "x"), put(tmp_path / "f-2.txt", "y")
    assert R.latest_file(spark, str(tmp_path), "f-*.txt").endswith("f-2.txt")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 1.5, "a"), (2, None, "b")], "id long, v double, k string")
    path = f"file://{tmp_path}/t"
    assert S.write_if_changed(df, path) and not S.write_if_changed(df.orderBy(F.desc("id")), path)
    assert S.write_if_changed(df.where("id = 1"), path) and spark.read.parquet(path).count() == 1
    first = S.publish({"t": df}, f"file://{tmp_path}/p")
    assert S.published(spark, f"file://{tmp_path}/p", "t").count() == 2 and S.published(spark, f"file://{tmp_path}/p", "_tables").first().rows == 2
    assert S.publish({"t": df.limit(1)}, f"file://{tmp_path}/p") != first and S.published(spark, f"file://{tmp_path}/p", "t").count() == 1
    S.export_csv(df, f"file://{tmp_path}/c")
    assert "1;1,50;a" in {r.value for r in spark.read.text(f"file://{tmp_path}/c").collect()}
    S.export_json(df, f"file://{tmp_path}/j", "k")
    assert spark.read.text(f"file://{tmp_path}/j").count() == 2
    snaps = spark.createDataFrame([("a", i) for i in range(5)], "k string, at int")
    assert {r.at for r in S.retain(snaps, ["k"], "at", 2).collect()} == {3, 4}


def test_manifest(spark, tmp_path):
    from tidemark.operators.quality import manifest

    put(tmp_path / "a.txt", "same"), put(tmp_path / "b.txt", "same"), put(tmp_path / "c.txt", "other")
    assert sorted(r.copies for r in manifest(spark, str(tmp_path), "*.txt").collect()) == [1, 2, 2]
