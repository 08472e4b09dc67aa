"""Late and repeated events, day upserts, and the online detector against the batch one."""

from __future__ import annotations

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import detect
from tidemark.plans import stream_queries as Q
from tidemark.streaming import events as S

SCHEMA = "event_id long, ts timestamp, user_id long"


def at(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


def files(spark, tmp_path, batches):
    folder = f"{tmp_path}/in"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/{i:02d}.parquet")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def test_late_and_repeated_events(spark, tmp_path):
    stream = files(spark, tmp_path, [[(1, at(1), 1), (2, at(2), 1)], [(2, at(2), 1), (3, at(1, 5), 1)], [(4, at(20), 1)]])
    unique = S.run_available(S.deduplicated(stream))
    assert sorted(r.event_id for r in unique.collect()) == [1, 2, 3, 4]
    counts = S.run_available(S.tumbling_counts(stream, ["user_id"]))  # append: only closed windows
    assert {r.start.day: r.n for r in counts.collect()} == {1: 2, 2: 2}


def test_day_upsert(spark, tmp_path):
    out = f"{tmp_path}/days"
    write = S.upsert_days(out)
    write(spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02")], "id long, day string"), 0)
    write(spark.createDataFrame([(9, "2024-01-02")], "id long, day string"), 1)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 9]


def test_online_ewma_equals_batch(spark, tmp_path):
    z = np.random.default_rng(2).normal(size=(4, 12))
    schema = "entity long, t long, z double"
    for t in range(12):
        rows = [(e, t, float(z[e, t])) for e in range(4)]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/z/{t:02d}.parquet")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/z")
    got = {(r.entity, r.t): r.score for r in S.run_available(S.online_ewma(stream)).collect()}
    df = spark.createDataFrame([(e, z[e].tolist()) for e in range(4)], "entity long, z array<double>")
    want = df.select("entity", F.posexplode(detect.ewma(F.col("z"))).alias("t", "s")).collect()
    assert len(got) == 48 and all(abs(got[r.entity, r.t] - r.s) < 1e-9 for r in want)


def test_stored_table_of_many_files_in_any_order(spark, tmp_path):
    """Part files that run backwards in time, more than a batch takes, with repeated and constant values."""
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    rows = [(i, at(1 + i // 2, 3 * (i % 2)), i % 2, "error", 5.0 if i % 2 else float(i)) for i in range(50)]
    for k, row in enumerate(reversed(rows)):
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/many/events.parquet")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/one")
    (tmp_path / "single").mkdir()
    next((tmp_path / "one").glob("part-*")).rename(tmp_path / "single/events.parquet")
    for name in ("stream_tumbling", "stream_dedup", "stream_session", "stream_ewma"):
        got, want = (sorted(map(tuple, getattr(Q, name)(spark, f"{tmp_path}/{x}").collect())) for x in ("many", "single"))
        assert got == want and len(got) == {"stream_tumbling": 25, "stream_dedup": 50, "stream_session": 50, "stream_ewma": 2}[name]
    assert got[1] == (1, 23, 0.0, 0.0)  # a constant series keeps its values


def test_online_bocpd_equals_batch_and_its_state_stays_short(spark):
    rng = np.random.default_rng(8)
    z = np.concatenate([rng.normal(size=(3, 40)), rng.normal(6, 1, size=(3, 40))], axis=1)
    rows = [(e, t, float(z[e, t])) for e in range(3) for t in range(80)] + [(9, 0, 1.0), (8, 0, 1.0), (8, 79, 2.0)]
    df = spark.createDataFrame(rows, "entity long, t long, z double")
    parts = [df.where((F.col("t") >= a) & (F.col("t") < b)) for a, b in ((0, 1), (1, 30), (30, 55), (55, 80))]
    got = {(r.entity, r.t): (r.score, r.position) for r in S.run_waves(parts, S.online_bocpd).collect()}
    want = detect.bocpd_batch(z)
    assert len(got) == len(rows) and got[9, 0] == got[8, 0] == (0.0, 0) and got[8, 79] == (0.0, 1)
    assert max(abs(got[e, t][0] - want[e, t]) for e in range(3) for t in range(80)) < 1e-9
    assert want[:, 40].min() > 0.5  # the shift is seen at once
    run, mean, var, longest = np.ones((1, 1)), z[:1, :2].mean(keepdims=True), np.full((1, 1), detect.PRIOR_VAR), 0
    for t in range(80):
        run, mean, var = detect.bocpd_step(run, mean, var, z[:1, t : t + 1], z[:1, :2].mean(keepdims=True))
        likely = run[0] >= 1e-15
        run, mean, var = run[:, likely], mean[:, likely], var[:, likely]
        longest = max(longest, len(run[0])) if t > 60 else longest
    assert longest < 60  # lengths from before the shift are gone; there would be 81


def test_series_share_calls_and_states(spark, tmp_path):
    """Many series in few blocks, over three runs that not all series are in: as each by itself, and a state for a block, not for a series.
    Keys are large, null, or texts."""
    rng = np.random.default_rng(5)
    z = {None if e == 7 else 2**60 + e: rng.normal(size=5 + e % 9).tolist() for e in range(40)}
    rows = [(k, t, v) for k, values in z.items() for t, v in enumerate(values)]
    df = spark.createDataFrame(rows, "entity long, t long, z double")
    parts = [df.where((F.col("t") >= a) & (F.col("t") < b)) for a, b in ((0, 1), (1, 6), (6, 99))]
    series = spark.createDataFrame(list(z.items()), "entity long, z array<double>")
    for online, batch in ((S.online_cusum, detect.cusum), (S.online_ewma, detect.ewma)):
        got = {(r.entity, r.t): r for r in S.run_waves(parts, lambda s, f=online: f(s, blocks=7)).collect()}
        want = series.select("entity", F.posexplode(batch(F.col("z"))).alias("t", "s")).collect()
        assert len(got) == len(want) == len(rows) and all(abs(got[r.entity, r.t].score - r.s) < 1e-9 and got[r.entity, r.t].position == r.t for r in want)
    alone = detect.bocpd_batch(np.array([z[None]]))[0]
    got = {(r.entity, r.t): r.score for r in S.run_waves(parts, lambda s: S.online_bocpd(s, blocks=7)).collect()}
    assert len(got) == len(rows) and max(abs(got[None, t] - x) for t, x in enumerate(alone)) < 1e-9

    named = df.withColumn("entity", F.concat(F.lit("n "), F.col("entity")))
    named.write.parquet(f"{tmp_path}/z")
    stream = S.online_cusum(spark.readStream.schema(named.schema).parquet(f"{tmp_path}/z"), blocks=7)
    run = stream.writeStream.option("checkpointLocation", f"{tmp_path}/ledger").trigger(availableNow=True).format("parquet").option("path", f"{tmp_path}/out").start()
    run.awaitTermination()
    assert run.lastProgress["stateOperators"][0]["numRowsTotal"] <= 7
    assert {r.entity for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {k and f"n {k}" for k in z}
