"""Is a learned forecast better than chance? A ridge model is fitted again and again on spoilt data, all fits in one job.

A fit needs only sums over its rows (features by features and by target), so the rows of every scenario and repeat are added up where
they lie, partial sums meet in one aggregate, and each fit is solved from one small matrix. No fit's rows ever meet in a task.

Rows are moved twice, whatever the number of origins and repeats: once as they are, and once into random buckets of one target month each, in which targets are
shuffled. Noise and shuffles are made by column in the task that adds up, so no row is written, nor handed to Python, for an origin or a repeat. Noise in training and
in prediction are the same function of the row (``Draws``).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..session import checkpointed, stored
from . import evaluate as E
from .forecast import constant_growth

SPOILT = ("noise_features", "shuffled_target", "shuffled_within_month")
NUMERIC = ("g1", "g2", "g3", "drift3", "mom", "common", "common_before", "h")
RIDGE = 0.1
ROW = ("entity", "t", "h")
FIT = ("scenario", "repeat", "origin")
BLOCK = 4096  #: rows whose columns stay in a core's cache


def shuffled(rows: DataFrame, group: Sequence[str], key: Sequence[str], value: str, size: int = 100_000) -> DataFrame:
    """``rows`` with ``value`` (not null) moved around a random cycle through each group: every row takes its successor's.

    A cycle is a permutation that leaves no row its own value, unless a group has one row. A group of any size is cut into
    buckets of about ``size`` rows by a hash; the order within a bucket is a sort of that bucket, and its last row takes the first
    value of the next bucket. ``key`` identifies a row of a group.
    """
    buckets = max(1, -(-rows.count() // size))
    placed = rows.withColumn("_h", F.xxhash64(*group, *key)).withColumn("_b", F.pmod(F.xxhash64("_h"), F.lit(buckets)))
    place = F.struct("_h", *key)
    heads = placed.groupBy(*group, "_b").agg(F.min_by(value, place).alias("_head"))
    ring = Window.partitionBy(*group).orderBy("_b")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select(*group, "_b", F.coalesce(F.lead("_head").over(ring), F.first("_head").over(whole)).alias("_after"))
    moved = placed.withColumn("_next", F.lead(value).over(Window.partitionBy(*group, "_b").orderBy(place)))
    moved = moved.join(heads, [*group, "_b"]).withColumn(value, F.coalesce("_next", "_after"))
    return moved.select(rows.columns)


def _keys(rows: DataFrame) -> list[Column]:
    """The columns of ROW as integers."""
    return [F.col(c) if isinstance(rows.schema[c].dataType, IntegralType) else F.xxhash64(c) for c in ROW]


_PRIMES = tuple(np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


class Draws:
    """Standard normal draws (Box-Muller on two hashes) and months for a frame's rows, which depend on feature, repeat, origin and the row's key only.

    The hashes are Spark's ``xxhash64``. It goes on from column to column, and its state after the columns before a row's key (salt, feature, repeat, origin) is given. Rows
    that share the first columns of the key share that part of the hash: it is taken once for each of them.
    """

    def __init__(self, keys: Sequence[np.ndarray]):
        p1, p2, *_ = _PRIMES
        self.levels, above = [], np.zeros(len(keys[0]), np.intp)
        for i, key in enumerate(keys):
            wide, x = key.dtype.itemsize > 4, key.astype(np.int64).view(np.uint64)
            with np.errstate(over="ignore"):
                x = _turned(x * p2, 31) * p1 if wide else (x & np.uint64(0xFFFFFFFF)) * p1
            if i < len(keys) - 1:
                found, own = np.unique(key, return_inverse=True)
                _, first, own = np.unique(above * len(found) + own, return_index=True, return_inverse=True)
                self.levels.append((above[first], x[first], wide))
                above = own
            else:
                self.levels.append((above, x, wide))

    def hashes(self, starts: np.ndarray, n: int) -> Iterator[np.ndarray]:
        """The hashes of the first ``n`` rows, for each of the starts."""
        state = starts[:, None]
        for above, x, wide in self.levels[:-1]:
            state = self._step(np.take(state, above, axis=1), x, wide)
        above, x, wide = self.levels[-1]
        for own in state:
            yield self._step(np.take(own, above[:n]), x[:n], wide)

    @staticmethod
    def _step(h: np.ndarray, x: np.ndarray, wide: bool) -> np.ndarray:
        """The states ``h`` after one more column, in place."""
        p1, p2, p3, p4, p5 = _PRIMES
        bytes_, turn, factor, more = (8, 27, p1, p4) if wide else (4, 23, p2, p3)
        h += p5 + np.uint64(bytes_)
        h ^= x
        some = h >> np.uint64(64 - turn)
        h <<= np.uint64(turn)
        h |= some
        h *= factor
        h += more
        for shift, factor in ((33, p2), (29, p3), (32, None)):
            h ^= np.right_shift(h, np.uint64(shift), out=some)
            if factor:
                h *= factor
        return h

    def normal(self, starts: np.ndarray, n: int) -> Iterator[np.ndarray]:
        """Standard normal draws from pairs of starts (salts one and two of a feature)."""
        hashes = self.hashes(starts, n)
        for first in hashes:
            length, turn = (((h & np.uint64(2**31 - 1)).view(np.int64) + 0.5) * 2.0**-31 for h in (first, next(hashes)))
            length = np.log(length, out=length)
            length *= -2
            turn *= 2 * np.pi
            yield np.sqrt(length, out=length) * np.cos(turn, out=turn)

    def months(self, start: np.ndarray, n: int) -> np.ndarray:
        return next(self.hashes(start, n)).view(np.int64) % 12


def _starts(origins: DataFrame, repeats: int) -> dict[tuple[int, int], np.ndarray]:
    """(repeat, origin) -> states of the hash before a row's key: two a feature, then the month's."""
    salts = [(F.lit(salt), F.lit(c)) for c in NUMERIC for salt in (1, 2)] + [(F.lit("moy"),)]
    many = origins.select("origin", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("repeat"))
    found = many.select("repeat", "origin", F.array(*(F.xxhash64(*s, "repeat", "origin") for s in salts)).alias("s")).collect()  # repeats x origins
    return {(r["repeat"], r["origin"]): np.array(r["s"], np.int64).view(np.uint64) for r in found}


def _sums(x: np.ndarray, g: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted sums of features by features and by target."""
    return (x * w[:, None]).T @ np.column_stack([x, g])


def _table(total: dict[tuple, np.ndarray]) -> Iterator[pd.DataFrame]:
    if total:
        yield pd.DataFrame([(*fit, m.ravel()) for fit, m in total.items()], columns=[*FIT, "m"])


def _add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums of a task's rows, a matrix for each fit. Fits and features are few, whatever the rows."""
    total: dict[tuple, np.ndarray] = {}
    for frame in frames:
        for fit, part in frame.groupby(list(FIT)):
            one = _sums(np.stack(part["x"].to_numpy()), part["g"].to_numpy(), part["w"].to_numpy())
            total[fit] = total[fit] + one if fit in total else one
    yield from _table(total)


def mixed(keys: np.ndarray, *salt: int) -> np.ndarray:
    """Random 64 bits for each key, by a hash of it and the salt."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64)
        for s in salt:
            x = x + np.uint64(0x9E3779B97F4A7C15) * np.uint64(s + 1)
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
            x ^= x >> np.uint64(31)
    return x


def _order(hashes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The order by hash, then key. The first bits of the hashes are sorted with the places below them, which takes half as long as an argsort."""
    bits = np.uint64(max(len(hashes) - 1, 1).bit_length())
    packed = np.sort(hashes >> bits << bits | np.arange(len(hashes), dtype=np.uint64))
    if ((packed[1:] ^ packed[:-1]) >> bits == 0).any():  # the first bits don't tell
        return np.lexsort((keys, hashes))
    return (packed & ((np.uint64(1) << bits) - np.uint64(1))).view(np.int64)


def _cycle(values: np.ndarray, keys: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    order = _order(hashes, keys)
    out, ranked = np.empty_like(values), values[order]
    out[order[:-1]], out[order[-1:]] = ranked[1:], ranked[:1]
    return out


def cycled(values: np.ndarray, keys: np.ndarray, *salt: int) -> np.ndarray:
    """``values`` moved around one random cycle: every row takes its successor's in an order by hashes of the keys."""
    return _cycle(values, keys, mixed(keys, *salt))


def _scaled(frame: pd.DataFrame, at: dict, n: int) -> list[np.ndarray]:
    """The features of the first ``n`` rows, standardised as an origin knows them; missing ones are zero, their mean."""
    known = lambda c: at[f"m_{c}"] is not None and at[f"d_{c}"]
    return [np.nan_to_num((frame[c].to_numpy(float)[:n] - at[f"m_{c}"]) / at[f"d_{c}"]) if known(c) else np.zeros(n) for c in NUMERIC]


def _design(numeric: Iterable[np.ndarray], moy: np.ndarray) -> np.ndarray:
    """(1, features, months of the year) by row."""
    x = np.empty((1 + len(NUMERIC) + 12, len(moy)))
    x[0], x[1 + len(NUMERIC) :] = 1, moy == np.arange(12)[:, None]
    for i, column in enumerate(numeric, 1):
        x[i] = column
    return x


def _variants(frame: pd.DataFrame, draws: Draws, at: dict, starts: dict[tuple[int, int], np.ndarray], n: int) -> Iterator[tuple[str, int, np.ndarray]]:
    """(scenario, repeat, design) of the first ``n`` rows as an origin knows them: real features, then noise in their place."""
    yield "real", 0, _design(_scaled(frame, at, n), frame["moy"].to_numpy()[:n])
    for (k, o), s in starts.items():
        if o == at["origin"]:
            yield "noise_features", k, _design(draws.normal(s[:-1], n), draws.months(s[-1:], n))


def _draws(frame: pd.DataFrame) -> Draws:
    return Draws([frame[f"k{i}"].to_numpy() for i in range(len(ROW))])


def _own_parts(known: DataFrame, origins: Sequence[int], stats: dict[int, dict], starts: dict[tuple[int, int], np.ndarray]) -> DataFrame:
    """(FIT, m): a task's partial sums of the fits whose targets stay, on the features and on noise in their place. ``known``: the columns of ROW as k0,
    k1, .., month, moy, base, g and features. Rows are in order of their months, so that what an origin knows is the first part of a frame."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple, np.ndarray] = {}
        for frame in (f.iloc[i : i + BLOCK] for f in frames for i in range(0, len(f), BLOCK)):
            frame = frame.sort_values("month", kind="stable")
            draws, month = _draws(frame), frame["month"].to_numpy()
            for o in origins:
                if n := int(np.searchsorted(month, o, "right")):
                    w, g = frame["base"].to_numpy()[:n] / stats[o]["_base"], frame["g"].to_numpy()[:n]
                    for scenario, repeat, x in _variants(frame, draws, stats[o], starts, n):
                        xw = x * w
                        total[scenario, repeat, o] = total.get((scenario, repeat, o), 0.0) + np.column_stack([xw @ x.T, xw @ g])
        yield from _table(total)

    return known.mapInPandas(run, "scenario string, repeat int, origin long, m array<double>")


def _predicted(asked: DataFrame, beta: dict[tuple, np.ndarray], stats: dict[int, dict], starts: dict[tuple[int, int], np.ndarray], fits: Sequence[tuple[str, int]]) -> DataFrame:
    """(POINT, y, yhats): points with the predictions of each fit. ``asked``: the columns of POINT as at_*, y, k0, k1, .., moy, base and features."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in frames:
            for o, frame in whole.groupby("at_origin"):
                out = np.empty((len(fits), len(frame)))
                for scenario, repeat, x in _variants(frame, _draws(frame), stats[o], starts, len(frame)):
                    for i, fit in enumerate(fits):  # targets are shuffled in training only
                        if fit == (scenario, repeat) or scenario == "real" and fit[0] != "noise_features":
                            out[i] = frame["base"].to_numpy() * np.exp(beta[*fit, o] @ x)
                yield frame[point].assign(yhats=list(out.T))

    point = [*(f"at_{c}" for c in E.POINT), "y"]
    schema = ", ".join(f"{c} {asked.schema[c].dataType.simpleString()}" for c in point)
    made = asked.mapInPandas(run, f"{schema}, yhats array<double>")
    return made.select(*(F.col(f"at_{c}").alias(c) for c in E.POINT), "y", "yhats")


def _parts(known: DataFrame, origins: Sequence[int], repeats: int, stats: dict[int, dict], whole: bool, month: str) -> DataFrame:
    """(FIT, m): partial sums of the fits whose targets are shuffled in buckets: among all of a bucket's rows that an origin knows (``whole``), or
    among those of one target month. ``known``: bucket, key, month, moy, base, g and features; a bucket's rows are one frame."""
    scenario = "shuffled_target" if whole else "shuffled_within_month"

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([month, "_key"])
        key, g, m, moy, base = (frame[c].to_numpy() for c in ("_key", "g", month, "moy", "base"))
        total: dict[tuple, np.ndarray] = {}
        mixed_keys = [mixed(key, k) for k in range(1, repeats + 1)]
        for o in origins:
            n = int(np.searchsorted(m, o, "right"))  # months ascend
            if not n:
                continue
            x = _design(_scaled(frame, stats[o], n), moy[:n])
            xw = x * (base[:n] / stats[o]["_base"])
            own = xw @ x.T
            starts = [0] if whole else np.flatnonzero(np.r_[True, m[1:n] != m[: n - 1]]).tolist()
            groups = [slice(a, b) for a, b in zip(starts, [*starts[1:], n], strict=True)]
            moved = np.empty((repeats, n))
            for k, own_keys in enumerate(mixed_keys):
                hashes = mixed(own_keys[:n], o, int(whole))
                for i in groups:
                    moved[k, i] = _cycle(g[i], key[i], hashes[i])
            sums = xw @ moved.T
            for k in range(repeats):
                total[scenario, k + 1, o] = np.column_stack([own, sums[:, k]])
        return pd.DataFrame([(*fit, v.ravel()) for fit, v in total.items()], columns=[*FIT, "m"])

    return known.groupBy("_bucket").applyInPandas(run, "scenario string, repeat int, origin long, m array<double>")


def _bucketed(known: DataFrame, by: Sequence[str], size: int) -> DataFrame:
    """Rows with ``_bucket``: each group of ``by`` is cut into buckets of about ``size`` rows by a hash of the row's key."""
    sizes = known.groupBy(*by).agg(F.greatest(F.ceil(F.count("*") / size), F.lit(1)).alias("_k"))  # a row a month, or one row
    met = known.join(F.broadcast(sizes), list(by)) if by else known.crossJoin(F.broadcast(sizes))
    return met.withColumn("_bucket", F.xxhash64(F.lit("bucket"), *by, F.pmod(F.xxhash64("_key"), "_k"))).drop("_k")


def _solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = []
        for m in frame.pop("m"):
            p = int((len(m) + 0.25) ** 0.5 - 0.5 + 1e-9)  # p x (p + 1)
            m = np.asarray(m).reshape(p, p + 1)
            penalty = np.full(p, RIDGE * m[0, 0])  # m[0, 0] is the weight of all rows
            penalty[0] = 0.0
            out.append(np.linalg.solve(m[:, :p] + np.diag(penalty), m[:, p]))
        yield frame.assign(beta=out)


def fits(train: DataFrame) -> DataFrame:
    """(scenario, repeat, origin, beta) from rows (scenario, repeat, origin, x, g, w)."""
    return solved(train.select(*FIT, "x", "g", "w").mapInPandas(_add, "scenario string, repeat int, origin long, m array<double>"))


def solved(parts: DataFrame) -> DataFrame:
    """(scenario, repeat, origin, beta) from partial sums of the fits."""
    schema = "scenario string, repeat int, origin long"
    cells = parts.select(*FIT, F.posexplode("m").alias("at", "v")).groupBy(*FIT, "at").agg(F.sum("v").alias("v"))
    whole = cells.groupBy(*FIT).agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("m"))
    return whole.select(*FIT, F.transform("m", lambda c: c["v"]).alias("m")).mapInPandas(_solve, f"{schema}, beta array<double>")


def null_predictions(rows: DataFrame, panel: DataFrame, origins: Sequence[int], repeats: int = 5, size: int = 100_000) -> DataFrame:
    """(model, scenario, repeat, entity, origin, h, month, y, yhat) of the points that have a fact.

    ``rows`` are ``forecast.supervised``'s. Scenarios: real; noise_features (every feature a draw, in training and prediction);
    shuffled_target (among an origin's training rows); shuffled_within_month (among those of one target month, so that only the
    differences between series are lost); targets change places within random buckets of about ``size`` rows. Targets after an origin are never touched. Beside them the references seasonal, constant
    and drift on the same points. Missing features take the training mean of their origin.
    """
    used = list(dict.fromkeys([*ROW, "month", "moy", "base", "y", "g", *NUMERIC]))
    rows, _ = stored(rows.where((F.col("base") > 0) & (F.col("t") <= max(origins))).select(used))
    at = rows.withColumn("origin", F.explode(F.array(*(F.lit(o).cast("long") for o in origins))))
    known = at.where((F.col("month") <= F.col("origin")) & F.col("g").isNotNull())
    means = [F.avg(c).alias(f"m_{c}") for c in NUMERIC] + [F.stddev_pop(c).alias(f"d_{c}") for c in NUMERIC]
    stats = checkpointed(known.groupBy("origin").agg(F.avg("base").alias("_base"), *means))  # a row an origin
    found = {r["origin"]: r.asDict() for r in stats.collect()}
    starts = _starts(stats, repeats)

    learn = ["base", F.col("moy").cast("int").alias("moy"), *(F.col(c).cast("double").alias(c) for c in NUMERIC)]
    keys = [c.alias(f"k{i}") for i, c in enumerate(_keys(rows))]
    some = rows.where(F.col("g").isNotNull() & (F.col("month") <= max(found, default=0)))
    parts = _own_parts(some.select(*keys, "month", "g", *learn), sorted(found), found, starts)
    some = some.select(F.xxhash64(*ROW).alias("_key"), "month", "g", *learn)
    for by in ([], ["month"]):
        parts = parts.unionByName(_parts(_bucketed(some, by, size), sorted(found), repeats, found, not by, "month"))
    beta = {tuple(r[c] for c in FIT): np.array(r["beta"]) for r in solved(parts).collect()}  # origins x (1 + 3 x repeats) rows of 21 numbers

    asked = rows.where(F.col("t").isin(list(origins)) & F.col("y").isNotNull()).withColumn("origin", F.col("t").cast("long"))
    fitted = [("real", 0), *((scenario, k) for scenario in SPOILT for k in range(1, repeats + 1))]
    given = asked.where(F.col("origin").isin(list(found))).select(*(F.col(c).alias(f"at_{c}") for c in E.POINT), "y", *keys, *learn)
    out = _predicted(given, beta, found, starts, fitted).select(*E.POINT, "y", F.posexplode("yhats").alias("at", "yhat"))
    which = F.array(*(F.struct(F.lit(scenario).alias("scenario"), F.lit(k).alias("repeat")) for scenario, k in fitted))[F.col("at")]
    shown = ["scenario", "repeat", *E.POINT, "y"]
    out = out.select(which["scenario"].alias("scenario"), which["repeat"].alias("repeat"), *shown[2:], "yhat")
    point = [*E.POINT, "base", "y"]
    simple = asked.select(*point, F.coalesce("drift3", "g1", F.lit(0.0)).alias("drift"))
    constant = constant_growth(panel, asked.select(*E.POINT)).select(*E.POINT, F.col("yhat").alias("constant"))
    simple = simple.join(constant, list(E.POINT), "left").select(
        *point, F.explode(F.create_map(F.lit("seasonal"), F.col("base"), F.lit("constant"), F.col("constant"), F.lit("drift"), F.col("base") * F.exp("drift"))).alias("scenario", "yhat")
    )
    out = out.unionByName(simple.withColumn("repeat", F.lit(0)).select(*shown, "yhat"))
    return out.withColumn("model", F.concat_ws("#", "scenario", F.col("repeat").cast("string")))


def runs(pred: DataFrame) -> DataFrame:
    """(scenario, repeat, n, mae, r2_within) of every fit and reference."""
    return E.metrics(pred, ["scenario", "repeat"]).select("scenario", "repeat", "n", "mae", "r2_within")


def summary(pred: DataFrame) -> DataFrame:
    """One row for each thing that the real model is compared with: (versus, repeats, mae_real, mae, best, p, skill, share_better).

    p is the share of repeats no worse than the real model, itself counted; the least possible is 1 / (repeats + 1). For references
    p is null, and share_better is the share of series on which the real model's error is smaller.
    """
    found = checkpointed(runs(pred))  # a row a fit
    real = found.where("scenario = 'real'").select(F.col("mae").alias("mae_real"))
    every = found.where("scenario <> 'real'").crossJoin(F.broadcast(real))  # one row
    by = every.groupBy(F.col("scenario").alias("versus")).agg(
        F.count("*").alias("repeats"),
        F.first("mae_real").alias("mae_real"),
        F.avg("mae").alias("mae"),
        F.min("mae").alias("best"),
        F.when(F.first("scenario").isin(*SPOILT), E.p_value(F.col("mae"), F.col("mae_real"))).alias("p"),
        (1 - F.first("mae_real") / F.avg("mae")).alias("skill"),
    )
    simple = pred.where("repeat = 0 and yhat is not null").groupBy("entity", "scenario").agg(F.sum(F.abs(F.col("y") - F.col("yhat"))).alias("e"))
    ours = simple.where("scenario = 'real'").select("entity", F.col("e").alias("ours"))
    share = simple.where("scenario <> 'real'").join(ours, "entity").groupBy(F.col("scenario").alias("versus")).agg(F.avg((F.col("ours") < F.col("e")).cast("int")).alias("share_better"))
    return by.join(F.broadcast(share), "versus", "left")  # three rows
