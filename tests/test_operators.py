"""Hand-computed values, invariants, optimality, and no look-ahead."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions.ratio import token_sort_ratio
from tidemark.operators import detect, evaluate, features, forecast, match, panel, quality

M0 = 2023 * 12


def series(spark, values, entity=1, start=M0):
    return spark.createDataFrame([(entity, start + i, float(v)) for i, v in enumerate(values) if v is not None], "entity long, month long, value double")


def col(df, name, order="month"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_positional_and_calendar_lags_differ_at_gaps(spark):
    p = series(spark, [1, 2, None, 4])
    got = p.select("month", panel.lag_rows("value", 1, ["entity"]).alias("a"), panel.lag_months("value", 1, ["entity"]).alias("b"))
    assert col(got, "a") == [None, 1, 2] and col(got, "b") == [None, 1, None]


def test_guarded_windows_and_expanding_median(spark):
    p = series(spark, [1, 2, 3, 10])
    got = p.select("month", panel.rolling(F.avg, "value", ["entity"], -6, -1, 3).alias("r"), panel.expanding_median("value", ["entity"]).alias("m"))
    assert col(got, "r") == [None, None, None, 2.0] and col(got, "m") == [None, 1.0, 1.5, 2.0]


def test_densify_islands_and_decumulate(spark):
    p = panel.densify(series(spark, [1, None, 3]), ["entity"], fill={"value": 0.0})
    assert col(p, "value") == [1.0, 0.0, 3.0]
    runs = panel.islands(series(spark, [1, 5, 6, 1, 7]), ["entity"], F.col("value") > 4).orderBy("first").collect()
    assert [(r.first - M0, r.last - M0, r.length) for r in runs] == [(1, 2, 2), (4, 4, 1)]
    ytd = spark.createDataFrame([("a", 2023, 1, 5.0), ("a", 2023, 2, 9.0), ("a", 2023, 4, 20.0)], "k string, y int, m int, c double")
    loose = ytd.select("m", panel.decumulate(ytd, ["k"], "y", "m", "c").alias("v"))
    strict = ytd.select("m", panel.decumulate(ytd, ["k"], "y", "m", "c", strict=True).alias("v"))
    assert col(loose, "v", "m") == [5.0, 4.0, 11.0] and col(strict, "v", "m") == [5.0, 4.0, None]


def test_full_history_forward_fill_latest_and_empty_columns(spark):
    both = series(spark, [1, 2, 3]).unionByName(series(spark, [1, None, 3], 2))
    assert {r.entity for r in panel.full_history(both, ["entity"], M0, M0 + 2).collect()} == {1}
    w = spark.createDataFrame([(1, 1, 5.0), (1, 2, None), (1, 3, 7.0)], "entity long, month long, value double")
    assert col(w.select("month", panel.forward_fill("value", ["entity"]).alias("v")), "v") == [5.0, 5.0, 7.0]
    assert panel.latest(w, ["entity"], F.desc("month")).first().value == 7.0
    assert panel.drop_empty_columns(w.withColumn("none", F.lit(None).cast("int")), F.lit(True)).columns == ["entity", "month", "value"]
    c = spark.createDataFrame([(None,), (5.0,), (-9.0,), (0.0,)], "x double").select(panel.clip(F.col("x"), -1, 1), panel.guarded_ln("x")).collect()
    assert [r[0] for r in c] == [None, 1.0, -1.0, 0.0] and c[2][1] is None and c[3][1] is None


def test_seasonal_lookup_is_by_date_and_drift_needs_history(spark):
    p = series(spark, range(1, 25))
    pts = forecast.points(p, [M0 + 23], [1, 2, 12])
    assert [r.yhat for r in forecast.seasonal(p, pts).orderBy("h").collect()] == [13.0, 14.0, 24.0]
    got = forecast.seasonal_drift(p, pts).orderBy("h").collect()
    ratio = (22 + 23 + 24) / (10 + 11 + 12)
    assert [round(r.yhat, 9) for r in got] == [round(x * ratio, 9) for x in (13, 14, 24)]
    short = series(spark, range(1, 14))
    assert forecast.seasonal_drift(short, forecast.points(short, [M0 + 12], [1])).first().yhat is None


def test_national_growth_is_the_last_known_one(spark):
    p = series(spark, [100] * 24)
    nat = spark.createDataFrame([(M0 + 16, 0.1), (M0 + 17, 0.2), (M0 + 18, 0.3)], "month long, growth double")
    value = lambda origin, lag: round(forecast.seasonal_national(p, forecast.points(p, [M0 + origin], [1]), nat, lag).first().yhat, 6)
    assert value(18, 1) == 120 and value(18, 0) == 130 and value(22, 1) == 130 and value(17, 1) == 110


def test_regional_factor_limits(spark):
    rows = [(e, M0 + t, float(np.exp(1 + 0.1 * e + 0.01 * t * (e % 3))), "r" + str(e % 2)) for e in range(12) for t in range(24)]
    p = spark.createDataFrame(rows, "entity long, month long, value double, region string")
    f = lambda k: {(r.entity, r.month): r.f for r in forecast.common_factor(p, k).collect()}
    nat, far, zero = f(None), f(1e12), f(0.0)
    assert all(abs(nat[k] - far[k]) < 1e-9 for k in nat)
    local = {}
    for e, m, v, r in rows:
        local.setdefault((r, m), []).append(np.log(v))
    assert all(abs(zero[e, m] - np.median(local[r, m])) < 1e-9 for e, m, _, r in rows)


@pytest.mark.parametrize("method", ["bottom_up", "ols", "wls_level", "wls_error"])
def test_reconciliation_solves_the_normal_equations(spark, method):
    rng = np.random.default_rng(3)
    y, total, err, err_total = rng.uniform(5, 20, 4), 60.0, rng.uniform(0.05, 0.3, 4), 0.1
    rows = [(1, i, float(y[i]), total, float(err[i]), err_total) for i in range(4)]
    wide = spark.createDataFrame(rows, "k int, part int, yhat double, total double, err double, err_total double")
    got = np.array([r.reconciled for r in forecast.reconcile(wide, method, ["k"]).orderBy("part").collect()])
    if method == "bottom_up":
        return np.testing.assert_allclose(got, y)
    w = {"ols": np.ones(5), "wls_level": 1 / np.r_[total, y] ** 2, "wls_error": 1 / np.r_[err_total * total, err * y] ** 2}[method]
    s = np.vstack([np.ones(4), np.eye(4)])
    want = np.linalg.solve(s.T @ np.diag(w) @ s, s.T @ np.diag(w) @ np.r_[total, y])
    np.testing.assert_allclose(got, want, rtol=1e-9)


def test_features_do_not_look_ahead(spark):
    rng = np.random.default_rng(1)
    p = None
    for e in range(5):
        s = series(spark, rng.uniform(50, 100, 30), e)
        p = s if p is None else p.unionByName(s)
    cut = M0 + 24
    full = {(r.entity, r.month): tuple(r) for r in features.recent_growth(p).where(F.col("month") <= cut).collect()}
    past = {(r.entity, r.month): tuple(r) for r in features.recent_growth(p.where(F.col("month") <= cut)).collect()}
    assert full == past
    a = forecast.ets_deviation(forecast.common_factor(p), [cut], 2).orderBy("entity", "h").collect()
    b = forecast.ets_deviation(forecast.common_factor(p.where(F.col("month") <= cut)), [cut], 2).orderBy("entity", "h").collect()
    assert np.allclose([r.yhat for r in a], [r.yhat for r in b])


def test_acts_are_active_until_cancelled_or_by_default(spark):
    starts = spark.createDataFrame([("r", M0), ("r", M0 + 10), ("q", M0)], "region string, m long")
    ends = spark.createDataFrame([("r", M0 + 1)], "region string, c long")
    got = features.active_months(starts, ["region"], "m", ends, "c", 3)
    assert sorted((r.region, r.month - M0) for r in got.collect()) == [("q", 0), ("q", 1), ("q", 2), ("r", 0), ("r", 1), ("r", 10), ("r", 11), ("r", 12)]


def test_event_forms(spark):
    counts = spark.createDataFrame([(1, M0 + 1, 2), (1, M0 + 4, 4), (1, M0, 0), (1, M0 + 5, 0)], "entity long, month long, n long")
    got = features.event_forms(counts, ["entity"]).orderBy("month").collect()
    assert [r["count"] for r in got] == [0, 2, 0, 0, 4, 0] and [r.flag for r in got] == [False, True, False, False, True, False]
    assert [r.lag12_sum for r in got] == [0, 0, 2, 2, 0, 4] and got[2].dev is None and got[3].dev == pytest.approx(-2 / 3)


def test_annual_release(spark):
    p = spark.createDataFrame([(1, 2024 * 12 + 2), (1, 2024 * 12 + 3)], "entity long, month long")
    a = spark.createDataFrame([(1, 2022, 10.0), (1, 2023, 20.0)], "entity long, year long, v double")
    assert col(features.annual_release(p, a, ["entity"], 4), "v") == [10.0, 20.0]


def test_segmentation_is_optimal():
    z = np.random.default_rng(0).normal(size=(20, 8))
    costs, breaks = detect.segment_batch(z, max_breaks=2)

    def sse(row, cut):
        parts = np.split(row, cut)
        return sum(((p - p.mean()) ** 2).sum() for p in parts)

    for i, row in enumerate(z):
        for k in range(3):
            options = [c for c in itertools.combinations(range(1, 8), k) if all(b - a >= 2 for a, b in itertools.pairwise((0, *c, 8)))]
            assert costs[i, k] == pytest.approx(min(sse(row, list(c)) for c in options))
            assert sse(row, breaks[i][k]) == pytest.approx(costs[i, k])


def test_detectors_score_shifted_series_higher(spark):
    z = np.random.default_rng(0).normal(size=(200, 12))
    z[100:, 6:] -= 4
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(z)], "entity long, z array<double>")
    long = df.select("entity", F.posexplode("z").alias("t", "z"))
    tables = {
        "ewma": df.select("entity", detect.ewma(F.col("z")).alias("s")),
        "cusum": df.select("entity", detect.cusum(F.col("z")).alias("s")),
        "bocpd": detect.bocpd(df).withColumnRenamed("score", "s"),
        "zscore": detect.zscore(long).groupBy("entity").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "score"))), lambda x: x["score"]).alias("s")),
    }
    for name, t in tables.items():
        s = np.array([r.s for r in t.orderBy("entity").collect()])
        assert (s[:, :2] == 0).all(), name
        assert np.median(s[100:, 6:9].max(axis=1)) > np.median(s[:100, 6:9].max(axis=1)), name


def test_shifts_multiply_from_tau_on(spark):
    p = spark.createDataFrame([(e, t, 10.0) for e in (1, 2) for t in range(4)], "entity long, t long, value double")
    labels = spark.createDataFrame([(2, 1, -0.1)], "entity long, tau long, size double")
    value = lambda **k: [round(r.value, 6) for r in detect.inject(p, labels, **k).where("entity = 2").orderBy("t").collect()]
    assert value() == [10, 9, 9, 9] and value(duration=2) == [10, 9, 9, 10]


def predictions(spark, miss=0.0):
    rng = np.random.default_rng(5)
    rows = []
    for o in range(3):
        for e in range(200):
            y = float(rng.uniform(80, 120))
            rows.append(("m", e, o, 1, o + 1, y * (1 - (miss if o == 2 else 0)) * float(np.exp(rng.normal(0, 0.02))), y))
    return spark.createDataFrame(rows, "model string, entity long, origin long, h long, month long, y double, yhat double")


def test_a_common_miss_widens_the_band(spark):
    width = lambda miss, band: (lambda r: r.hi - r.lo)(band(predictions(spark, miss)).first())
    assert width(0.1, evaluate.error_band) > 1.5 * width(0.0, evaluate.error_band)


def test_metrics_against_numpy(spark):
    p = predictions(spark)
    rows = p.collect()
    y, f = np.array([r.y for r in rows]), np.array([r.yhat for r in rows])
    m = evaluate.metrics(p).first()
    assert m.mae == pytest.approx(np.abs(y - f).mean()) and m.wape == pytest.approx(np.abs(y - f).sum() / y.sum())
    assert m.r2 == pytest.approx(1 - ((y - f) ** 2).sum() / ((y - y.mean()) ** 2).sum())


def test_gates(spark):
    p = series(spark, [1, 2, 3]).unionByName(series(spark, [1, 50, 3], 2)).unionByName(series(spark, [1], 2))
    got = {r["check"]: r for r in quality.panel_gate(p, min_entities=2).collect()}
    assert got["entities"].ok and not got["duplicates"].ok and got["duplicates"].value == 1 and not got["jumps"].ok and got["kept"].ok
    old = predictions(spark)
    bad = old.withColumn("yhat", F.col("yhat") * 1.2)
    assert not quality.model_gate(bad, old).first().ok and quality.model_gate(old, old).first().ok
    revised = bad.withColumn("y", F.col("y") * 1.5)
    assert quality.model_gate(revised, old).count() == 0


def test_cascade_match(spark):
    d = spark.createDataFrame([(1, "r", "Green Hill"), (2, "r", "Old Mill"), (3, "r", "Old Mill."), (4, "q", "Green Hill"), (5, "r", "Riverside district")], "entity long, region string, title string")
    names = spark.createDataFrame([("Green Hill", "r"), ("green-hill", "q"), ("old mill", "r"), ("district riverside", "r"), ("Riversidde district", "r"), ("Nowhere", "r")], "name string, region string")
    got = {(r.name, r.region): (r.entity, r.match) for r in match.cascade_match(names, d).collect()}
    assert got[("Green Hill", "r")] == (1, "exact") and got[("green-hill", "q")] == (4, "normalised")
    assert got[("old mill", "r")] == (None, "ambiguous") and got[("district riverside", "r")] == (5, "stem")
    assert got[("Riversidde district", "r")][0] == 5 and ("Nowhere", "r") not in got


def test_pattern_tags_need_the_region_for_homonyms(spark):
    t = spark.createDataFrame([(1, "fire in Springfield today"), (2, "Springfield, Lakeland region"), (3, "springs and fields")], "id long, text string")
    p = spark.createDataFrame([("a", "sprin", r"(?iu)\bspringfield\b", "Lakeland", True), ("b", "lakel", r"(?iu)\blakeland\b", "x", False)], "entity string, stem string, pattern string, region string, ambiguous boolean")
    assert sorted((r.id, r.entity) for r in match.pattern_tags(t, "text", p, "id").collect()) == [(2, "a"), (2, "b")]


def test_prefix_join_of_short_and_long_queries(spark):
    names = spark.createDataFrame([("alpha",), ("alps",), ("be",)], "n string")
    q = spark.createDataFrame([("al",), ("alph",), ("b",), ("zz",)], "q string")
    assert sorted(tuple(r) for r in match.prefix_join(names, "n", q, "q").select("n", "q").collect()) == [("alpha", "al"), ("alpha", "alph"), ("alps", "al"), ("be", "b")]


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(T.latin_key(F.lit("Щёлково-Южный"))) == "shchelkovo yuzhny"
    assert one(T.norm_key(F.lit("  Посёлок  «Заря» №3"))) == "поселок заря 3" and one(T.padded_code(F.lit("123"), 8)) == "00000123"
    assert one(T.number(F.lit("1 234,5"))) == 1234.5 and one(T.number(F.lit("…"))) is None and one(T.decimal_comma(F.lit(1234.5))) == "1234,50"
    h = 2166136261
    for c in b"abc":
        h = (h ^ c) * 16777619 % 2**32
    assert int(one(T.fnv1a_base36(F.lit("abc"))), 36) == h
    assert one(T.html_text(F.lit("<p>a &amp; b<script>x</script>\n<b>c</b></p>"))) == "a & b c"
    rules, veto = {"intro": "(?iu)введ", "end": "(?iu)отмен"}, {"intro": "(?iu)изменен"}
    kinds = [one(T.first_rule(F.lit(t), rules, veto)) for t in ("Введение режима", "О введении изменений", "Отмена введенного", "Прочее")]
    assert kinds == ["intro", "other", "intro", "other"]
    assert one(token_sort_ratio(F.lit("b a"), F.lit("A b"))) == 100.0


def test_root_overlap_counts_every_member(spark):
    from tidemark.plans.panel_queries import root_overlap

    rows = [(i, r) for i in range(1000) for r in ("A", "B") + (("C",) if i % 4 == 0 else ())] + [(5, "A"), (2000, "D"), (None, "A"), (None, "D")]
    got = sorted(map(tuple, root_overlap(spark.createDataFrame(rows, "o_custkey long, root string")).collect()))
    assert got == [("A", "B", 1000), ("A", "C", 250), ("A", "D", 0), ("B", "C", 250), ("B", "D", 0), ("C", "D", 0)]


def test_roots_resolve_to_one_target(spark):
    """Exact before prefix, all roots needed, one common target only."""
    own = [("saha", 1), ("sahalin", 2), ("mosk", 3), ("moskovsk", 4), ("krasnodarsk", 5), ("krasnoyarsk", 6), ("altai", 7), ("gorn", 7), ("altai", 8), ("uud", 9), (None, 10)]
    dictionary = spark.createDataFrame(own, "root string, target long")
    asked = {
        "exact": ["sahalin"], "exact beats prefix": ["saha"], "prefix": ["krasnodarskiy"], "two by prefix": ["krasno"], "two targets": ["altai"],
        "second root decides": ["altai", "gorn"], "foreign root": ["altai", "gorn", "xyzw"], "no common": ["sahalin", "gorn"], "short": ["uuda"], "short exact": ["uud"],
        "twice": ["uud", "uud"], "null inside": ["uud", None], "none": [], "null": None,
    }
    df = spark.createDataFrame(list(asked.items()), "name string, roots array<string>")
    got = {r["name"]: r["target"] for r in match.resolve_by_roots(df, dictionary, "name", "target").collect()}
    assert got == {"exact": 2, "exact beats prefix": 1, "prefix": 5, "second root decides": 7, "short exact": 9, "twice": 9, "null inside": 9}
    assert match.resolve_by_roots(df.limit(0), dictionary, "name", "target").count() == match.resolve_by_roots(df, dictionary.limit(0), "name", "target").count() == 0


def test_forecast_interval_sees_the_past_only(spark):
    rng = np.random.default_rng(6)
    z = rng.normal(size=12)
    z[8] += 9

    def scored(v):
        df = spark.createDataFrame([(1, t, float(x)) for t, x in enumerate(v)], "entity long, t long, z double")
        return detect.forecast_interval(df).orderBy("t").toPandas()

    got = scored(z)
    level, e = z[:2].mean(), list(z[:2] - z[:2].mean())
    for t in range(2, 12):
        lo, mid, hi = np.quantile(e, [0.1, 0.5, 0.9])
        e.append(z[t] - level)
        width = max(hi - lo, 1)
        assert got.outside[t] == pytest.approx(max(e[-1] - hi, lo - e[-1], 0) / width) and got.off_median[t] == pytest.approx(abs(e[-1] - mid) / width)
        level = 0.3 * z[t] + 0.7 * level
    assert (got.outside[:2] == 0).all() and got.outside[4:].idxmax() == 8  # two or three errors make no good interval yet
    other = z.copy()
    other[9:] = 50
    assert scored(other)[:9].equals(got[:9])
