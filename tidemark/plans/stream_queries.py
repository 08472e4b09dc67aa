"""Streaming queries over the events table, each equal to a batch query over the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detect as D
from ..operators.detect import START
from ..operators.quantiles import quantiles
from ..streaming import events as S
from ..session import checkpointed
from .base import SQL, query, read
from .detect_queries import window24


def stream(spark: SparkSession, d: str, per_trigger: int | None = 8) -> DataFrame:
    found = S.stored(spark, d, "events.parquet", read(spark, d, "events").schema, per_trigger)
    return found.withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need an instant


def waves(signal: DataFrame, count: int = 3) -> list[DataFrame]:
    """A signal (.., t), a stored table, cut in time into parts of about equally many rows."""
    q = quantiles(signal, "t", [k / count for k in range(1, count)], reread=True).first()
    cuts = [-float("inf"), *(q["q"] if q else []), float("inf")]
    return [signal.where((F.col("t") > a) & (F.col("t") <= b)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def signal_waves(spark: SparkSession, d: str) -> list[DataFrame]:
    return waves(read(spark, d, "events").select(F.col("user_id").alias("entity"), F.col("event_id").alias("t"), F.col("value").alias("z")))


@query("""SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS start, count(*)::BIGINT AS n FROM events GROUP BY 1, 2""")
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """Daily counts; in complete mode, so the days that the watermark hasn't closed are there too."""
    return S.run_available(S.tumbling_counts(stream(spark, d), ["event_type"]), "complete")


@query("""SELECT event_id, user_id, event_type FROM events""")
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Every file's rows arrive twice; each event id stays once. A stored table's files have no order in time, so nothing is late."""
    s = stream(spark, d)
    return S.run_available(S.deduplicated(s.unionByName(s), late=None).select("event_id", "user_id", "event_type"))


@query("""WITH e AS (SELECT user_id, ts, (ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR)::INT AS fresh FROM events),
s AS (SELECT user_id, ts, sum(coalesce(fresh, 0)) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*)::BIGINT AS n FROM s GROUP BY user_id, k""")
def stream_session(spark: SparkSession, d: str) -> DataFrame:
    return S.run_available(S.sessions(stream(spark, d), ["user_id"], late=None), "complete")


@query("""WITH RECURSIVE z AS (SELECT user_id AS entity, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS t, value AS z FROM events),
e0 AS (SELECT entity, avg(z) AS level FROM z WHERE t < 2 GROUP BY 1), ew AS (SELECT entity, 1::BIGINT AS t, level, 0::DOUBLE AS score FROM e0 UNION ALL
SELECT z.entity, z.t, 0.3::DOUBLE * z.z + 0.7::DOUBLE * ew.level, abs(z.z - ew.level) FROM ew JOIN z ON z.entity = ew.entity AND z.t = ew.t + 1)
SELECT entity, count(*)::BIGINT AS n, round(max(score), 4) AS top, round(sum(score), 3) AS total FROM ew WHERE t >= 2 GROUP BY 1""")
def stream_ewma(spark: SparkSession, d: str) -> DataFrame:
    """The detector's state carried over three runs, a third of the events each, in their order."""
    scores = S.run_waves(signal_waves(spark, d), S.online_ewma).where(F.col("position") >= START)
    return scores.groupBy("entity").agg(F.count("*").alias("n"), F.round(F.max("score"), 4).alias("top"), F.round(F.sum("score"), 3).alias("total"))


@query("""WITH RECURSIVE z AS (SELECT user_id AS entity, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS t, value AS z FROM events),
e0 AS (SELECT entity, avg(z) AS ref FROM z WHERE t < 2 GROUP BY 1 HAVING count(*) = 2), cu AS (SELECT entity, ref, 1::BIGINT AS t, 0::DOUBLE AS up, 0::DOUBLE AS down FROM e0 UNION ALL
SELECT z.entity, ref, z.t, greatest(0, up + z.z - ref - 0.5::DOUBLE), greatest(0, down - (z.z - ref) - 0.5::DOUBLE) FROM cu JOIN z ON z.entity = cu.entity AND z.t = cu.t + 1)
SELECT entity, count(*)::BIGINT AS n, round(max(greatest(up, down)), 3) AS top FROM cu WHERE t >= 2 GROUP BY 1""")
def stream_cusum(spark: SparkSession, d: str) -> DataFrame:
    """The cumulative-sum detector's state carried over three runs like ``stream_ewma``."""
    scores = S.run_waves(signal_waves(spark, d), S.online_cusum).where(F.col("position") >= START)
    return scores.groupBy("entity").agg(F.count("*").alias("n"), F.round(F.max("score"), 3).alias("top"))


@query(SQL["score_bocpd"])
def stream_bocpd(spark: SparkSession, d: str) -> DataFrame:
    """Bayesian detection carried over three runs of four months each: the same scores as all months at once give."""
    z = checkpointed(D.local_growth(window24(spark, d)).select("entity", F.col("t").cast("long").alias("t"), "z"))
    return S.run_waves(waves(z), S.online_bocpd).select("entity", "t", F.round("score", 6).alias("score"))
