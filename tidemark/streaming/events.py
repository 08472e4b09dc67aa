"""Structured Streaming: ingestion, windowed counts, episodes, and an online detector equal to the batch one."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.detect import ALPHA, PRIOR_VAR, SLACK, START, bocpd_step


def source(spark: SparkSession, folder: str, pattern: str, schema, per_trigger: int | None = 8) -> DataFrame:
    """Files as a stream; the checkpoint of the query is the ledger of what was read. Without ``per_trigger``, all of them at once."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).parquet(folder)


def stored(spark: SparkSession, folder: str, name: str, schema, per_trigger: int | None = 8) -> DataFrame:
    """A stored table as a stream: one file of that name in the folder, or a folder of part files."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    parts = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    return source(spark, f"{folder}/{name}", "*", schema, per_trigger) if parts else source(spark, folder, name, schema, per_trigger)


def deduplicated(events: DataFrame, key: str = "event_id", ts: str = "ts", late: str | None = "3 days") -> DataFrame:
    """The first event of each key. Without ``late``, none is dropped for its time and all keys are held as state."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key]) if late else events.dropDuplicates([key])


def tumbling_counts(events: DataFrame, keys: list[str], ts: str = "ts", width: str = "1 day", late: str = "3 days") -> DataFrame:
    """Counts of each window; a late event counts until the watermark has passed its window."""
    win = events.withWatermark(ts, late).groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n"))
    return win.select(*keys, F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, keys: list[str], ts: str = "ts", gap: str = "6 hours", late: str | None = "3 days") -> DataFrame:
    """Episodes of events. Without ``late``, none is dropped for its time (complete mode only)."""
    win = (events.withWatermark(ts, late) if late else events).groupBy(F.session_window(ts, gap), *keys).agg(F.count("*").alias("n"))
    return win.select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


#: Blocks that series are dealt out to by their key's hash.
BLOCKS = 4096


def _online(signal: DataFrame, key: str, held: Sequence[tuple[str, str]], step: Callable, blocks: int) -> DataFrame:
    """Scores (key, t, score, position) as values arrive, of a detector that goes on with a series by ``step(state, values)``: the state
    is None at first and then what ``held`` names, count first; values (t, z) are sorted; it returns the state and the scores.

    A group is a block of series and its state holds theirs, as a call and a stored state for each series cost far more than its few values.
    A block's values of a batch are held by a task; ``blocks`` stays as it is as long as the ledger lives. In Python a key is its text,
    which tells null from other keys whatever the type.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def work(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names, *fields = state.get if state.exists else ([], *([] for _ in held))
        states = dict(zip(names, zip(*fields, strict=True), strict=True))
        values = {}
        for f in frames:
            for k, t, z in zip(f["series"].tolist(), f["t"].tolist(), f["z"].tolist(), strict=True):
                values.setdefault(k, []).append((t, z))
        series, ts, scores, positions = [], [], [], []
        for k, found in values.items():
            found.sort()
            before = states.get(k)
            states[k], made = step(before, found)
            seen = before[0] if before else 0
            series += [k] * len(found)
            ts += [t for t, _ in found]
            scores += made
            positions += range(seen, seen + len(found))
        state.update((list(states), *(list(x) for x in zip(*states.values(), strict=True))))
        yield pd.DataFrame({"series": series, "t": ts, "score": scores, "position": positions})

    rows = signal.select(F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block"), F.col(key).cast("string").alias("series"), "t", "z")
    kept = ", ".join(["series array<string>", *(f"{name} array<{kind}>" for name, kind in held)])
    made = rows.groupBy("block").applyInPandasWithState(
        work, "series string, t long, score double, position long", kept, "append", GroupStateTimeout.NoTimeout
    )
    return made.select(F.col("series").cast(signal.schema[key].dataType).alias(key), "t", "score", "position")


def online_ewma(signal: DataFrame, key: str = "entity", blocks: int = BLOCKS) -> DataFrame:
    """Scores (key, t, score, position) as values arrive: the state of a series is its count, sum of first values and level.

    Values of a series must arrive in the order of t across batches; within a batch they are sorted.
    """

    def step(state: tuple | None, values: list[tuple[int, float]]) -> tuple[tuple, list[float]]:
        seen, level = state or (0, 0.0)
        scores = []
        for _, z in values:
            if seen < START:
                level += z / START
                scores.append(0.0)
            else:
                scores.append(abs(z - level))
                level = ALPHA * z + (1 - ALPHA) * level
            seen += 1
        return (seen, level), scores

    return _online(signal, key, [("seen", "long"), ("level", "double")], step, blocks)


def online_cusum(signal: DataFrame, key: str = "entity", slack: float = SLACK, blocks: int = BLOCKS) -> DataFrame:
    """Two-sided cumulative sums (key, t, score, position) as values arrive, as in the batch detector; the state of a series is
    its count, its reference (the mean of the first values) and both sums. Order as for ``online_ewma``."""

    def step(state: tuple | None, values: list[tuple[int, float]]) -> tuple[tuple, list[float]]:
        seen, ref, up, down = state or (0, 0.0, 0.0, 0.0)
        scores = []
        for _, z in values:
            if seen < START:
                ref += z / START
            else:
                up, down = max(0.0, up + (z - ref) - slack), max(0.0, down - (z - ref) - slack)
            scores.append(max(up, down))
            seen += 1
        return (seen, ref, up, down), scores

    return _online(signal, key, [("seen", "long"), ("ref", "double"), ("up", "double"), ("down", "double")], step, blocks)


def online_bocpd(signal: DataFrame, key: str = "entity", least: float = 1e-15, blocks: int = BLOCKS) -> DataFrame:
    """Probabilities (key, t, score, position) that a series' run is one value old at most, as values arrive, as in the batch detector.

    The state of a series is its count, its first values and the posterior of its run lengths with their means and variances. Run lengths
    less likely than ``least`` are dropped, so the state stays short however long the series gets. Order as for ``online_ewma``.
    """

    def step(state: tuple | None, values: list[tuple[int, float]]) -> tuple[tuple, list[float]]:
        seen, first, *posterior = state or (0, [], [], [], [])
        first, (run, mean, var) = list(first), (np.array(x, float)[None] for x in posterior)
        scores = []
        for _, z in values:
            score, new = 0.0, [z]
            if seen < START:
                first.append(z)
                new = first if len(first) == START else []  # the prior's mean is that of the first values
                run, mean, var = (np.array([[x]]) for x in (1.0, sum(first) / len(first), PRIOR_VAR))
            for x in new:
                run, mean, var = bocpd_step(run, mean, var, np.array([[x]]), np.array([[sum(first) / START]]))
            if seen >= START:
                score = float(run[0, :2].sum())
                likely = run[0] >= least
                likely[:2] = True
                run, mean, var = run[:, likely], mean[:, likely], var[:, likely]
            scores.append(score)
            seen += 1
        return (seen, first, *(x[0].tolist() for x in (run, mean, var))), scores

    held = [("seen", "long"), *((name, "array<double>") for name in ("first", "run", "mean", "var"))]
    return _online(signal, key, held, step, blocks)


def run_waves(waves: Sequence[DataFrame], build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Waves of rows that land one after the other in a folder, each worked off by a run of its own that goes on from the
    state and the ledger of the one before, as a daily job does; then all that the runs wrote, as a table."""
    spark = waves[0].sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='stream-')}"
    root = f"{base.rstrip('/')}/waves-{uuid.uuid4().hex}"
    for wave in waves:
        wave.write.mode("append").parquet(f"{root}/landing")
        made = build(spark.readStream.schema(wave.schema).parquet(f"{root}/landing"))
        writer = made.writeStream.option("checkpointLocation", f"{root}/ledger").trigger(availableNow=True)
        writer.outputMode("append").format("parquet").option("path", f"{root}/out").start().awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{root}/out")


def upsert_days(folder: str, day: str = "day"):
    """A foreachBatch sink that replaces whole days: late files rewrite only the days they touch."""

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(folder)

    return write


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Everything available now, then the result as a table. For reports and tests; a service would use a lasting sink."""
    spark = stream.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='stream-')}"
    root = f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"
    out = f"{root}/out"
    writer = stream.writeStream.option("checkpointLocation", f"{root}/ledger").trigger(availableNow=True)
    if mode == "append":
        query = writer.outputMode("append").format("parquet").option("path", out).start()
    else:
        query = writer.outputMode(mode).foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(out)).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
