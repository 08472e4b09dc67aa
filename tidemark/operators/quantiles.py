"""Exact quantiles of groups of any size, by distributed selection.

A quantile with linear interpolation lies between two values of a known rank. ``quantiles`` finds them by refining histograms: all values between a
group's bounds are counted in a row of bins (each bin with its own smallest and largest value), the bin that holds the rank gives
the next bounds, and so on until the bounds meet, or so few values are left between them that they fit in an array. All groups and ranks go through the same passes.
What a group costs in memory is a row of bins, however many values it has, and its values are never gathered in one task. A group whose
values are few enough for that (``SMALL``) is left to the built-in function, which gives the same.

``sum_quantiles`` does so for all sums of a value and a shift (values x shifts of a group) without listing the sums: a histogram of the values,
moved by each shift, bounds the rank from both sides; bins whose moved bounds lie between are refined.

Bins are linear. Where a pass leaves most values in one bin, the next one's are logarithmic, signs apart, so values of any
spread take few passes: a linear pass divides the range by the number of bins, a logarithmic one divides its logarithm.

``column_ranks`` selects in many columns of one table at once, and in growing parts of its rows. There the values' bits, in their order, take the place of bins:
a pass tells eight of the 64 bits apart, so values of any spread take eight passes at most.

Cases: nulls and NaN are left out; a group without any other value gives no row; infinities are values like others; null
keys are a group; a level may be 0 or 1; ties of any number are one value with its count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed

#: Values of a group that the built-in function may merge in one task; bins; values that are gathered at the end; rows of bounds that are broadcast.
SMALL, BINS, GATHER, BROADCAST = 1 << 18, 1024, 4096, 50_000
_LARGEST = 1.7976931348623157e308


def _finite(x: Column) -> Column:
    return F.greatest(F.least(x, F.lit(_LARGEST)), F.lit(-_LARGEST))


def _bin(v: Column, lo: Column, hi: Column, log: Column, bins: int) -> Column:
    """The number of a value's bin between its bounds; never falls where values rise."""
    v, lo, hi = _finite(v), _finite(lo), _finite(hi)
    spread = hi / 2 - lo / 2  # halves, as the difference itself may be beyond the largest number
    linear = F.when(spread == 0, (v > lo).cast("long")).otherwise(F.floor(F.least(F.try_divide(v / 2 - lo / 2, spread) * bins, F.lit(bins - 1.0))))
    low, high = F.ln(F.least(F.abs(lo), F.abs(hi))), F.ln(F.greatest(F.abs(lo), F.abs(hi)))
    within = F.coalesce(F.least(F.try_divide(F.ln(F.abs(v)) - low, high - low) * bins, F.lit(bins - 1.0)), F.lit(0.0))
    of_one_sign = F.when(lo > 0, F.floor(within)).otherwise(-F.floor(within))
    by_sign = F.signum(v).cast("long")  # bounds on both sides of zero, or at it: first apart
    return F.when(~log, linear).when((lo <= 0) & (hi >= 0), by_sign).otherwise(of_one_sign).cast("long")


def _known(df: DataFrame, value: Column, by: Sequence[str]) -> DataFrame:
    """(g, v): the group as a struct, which is never null, and the value."""
    group = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))
    return df.select(group.alias("g"), value.cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))


def _ranks(stats: DataFrame, levels: Sequence[float], count: Column) -> DataFrame:
    """(.., level, part, rank): for each level the ranks below and above its place, ``part`` of the way from one to the other."""
    places = F.array(*(F.struct(F.lit(i).alias("level"), (F.lit(float(p)) * (count - 1)).alias("place")) for i, p in enumerate(levels)))
    rows = stats.select("*", F.inline(places))
    return rows.withColumn("part", F.col("place") - F.floor("place")).withColumn("rank", F.explode(F.array_distinct(F.array(F.floor("place"), F.ceil("place"))))).drop("place")


def _interpolated(found: DataFrame, levels: Sequence[float], by: Sequence[str], name: str) -> DataFrame:
    """(by, name) from the values (g, level, part, rank, x) of the ranks."""
    ends = found.groupBy("g", "level", "part").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    value = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((1 - F.col("part")) * F.col("a") + F.col("part") * F.col("b"))
    rows = ends.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("level", value.alias("x")))).alias("q"))
    return rows.select(*(F.col("g").getField(c).alias(c) for c in by), F.transform("q", lambda r: r["x"]).alias(name))


def _meet(values: DataFrame, bounds: DataFrame) -> DataFrame:
    """Values with the bounds of their group that they lie between. Bounds are broadcast if they are few; if not, both sides are shuffled."""
    few = bounds.limit(BROADCAST + 1).count() <= BROADCAST
    met = values.join(F.broadcast(bounds) if few else bounds, "g")
    return met.where((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))


def quantiles(
    df: DataFrame, value: Column | str, levels: Sequence[float], by: Sequence[str] = (), name: str = "q", small: int = SMALL, bins: int = BINS, gather: int = GATHER,
    reread: bool = False,
) -> DataFrame:
    """(by, name array<double>): the exact quantiles of each group, as ``percentile`` has them. With ``reread`` each pass reads ``df`` itself, which
    should be a stored table then; else its values are written once."""
    values = _known(df, F.col(value) if isinstance(value, str) else value, by)
    stats = checkpointed(values.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")))
    if stats.where(F.col("n") > small).isEmpty():
        rows = values.groupBy("g").agg(F.percentile("v", list(levels)).alias(name))
        return rows.select(*(F.col("g").getField(c).alias(c) for c in by), name)

    values = values if reread else checkpointed(values)
    state = _ranks(stats, levels, F.col("n")).select("g", "level", "part", "rank", "lo", "hi", "n", F.lit(0).cast("long").alias("before"), F.lit(False).alias("log"))
    settled = (F.col("lo") == F.col("hi")) | (F.col("n") <= gather)
    done = None
    while True:
        state = checkpointed(state)
        ready, state = state.where(settled), state.where(~settled)
        done = ready if done is None else done.unionByName(ready)
        if state.isEmpty():
            break
        met = _meet(values, state.select("g", "lo", "hi", "log").distinct())
        bound = ["g", "lo", "hi"]
        counts = met.groupBy(*bound, _bin(F.col("v"), F.col("lo"), F.col("hi"), F.col("log"), bins).alias("bin")).agg(
            F.count("*").alias("c"), F.min("v").alias("a"), F.max("v").alias("b")
        )
        passed = F.coalesce(F.sum("c").over(Window.partitionBy(*bound).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # over a row of bins
        held = state.join(counts.withColumn("passed", passed), bound)
        place = F.col("rank") - F.col("before")
        held = held.where((place >= F.col("passed")) & (place < F.col("passed") + F.col("c")))
        state = held.select(
            "g", "level", "part", "rank", F.col("a").alias("lo"), F.col("b").alias("hi"), F.col("c").alias("n"), (F.col("before") + F.col("passed")).alias("before"), (~F.col("log") & (8 * F.col("c") > F.col("n"))).alias("log")
        )
    single = done.where("lo = hi").withColumn("x", F.col("lo"))
    open_ = done.where("lo < hi")
    left = _meet(values, open_.select("g", "lo", "hi").distinct()).groupBy("g", "lo", "hi").agg(F.array_sort(F.collect_list("v")).alias("vs"))  # ``gather`` at most
    several = open_.join(left, ["g", "lo", "hi"]).withColumn("x", F.get("vs", (F.col("rank") - F.col("before")).cast("int"))).drop("vs")
    return _interpolated(single.unionByName(several), levels, by, name)


def sum_quantiles(
    values: DataFrame, value: str, shifts: DataFrame, shift: str, levels: Sequence[float], by: Sequence[str] = (), name: str = "q", bins: int = BINS, gather: int = 2 * GATHER
) -> DataFrame:
    """(by, name array<double>): exact quantiles of all sums of a value and a shift of the same group. Shifts are few (an origin each).

    Near a rank at most ``gather`` sums are listed; while there are more, the bins that make them are refined.
    """
    own = checkpointed(_known(values, F.col(value), by))
    moves = checkpointed(_known(shifts, F.col(shift), by).groupBy("g", F.col("v").alias("s")).agg(F.count("*").alias("m")))
    hist = own.groupBy("g").agg(F.min("v").alias("a"), F.max("v").alias("b"), F.count("*").alias("c")).withColumn("log", F.lit(False))
    total = hist.select("g", F.col("c").alias("n")).join(moves.groupBy("g").agg(F.sum("m").alias("k")), "g")
    rank = ["g", "level", "part", "rank"]
    ranks = _ranks(total, levels, F.col("n") * F.col("k")).select(rank)
    upto = lambda c: F.sum("w").over(Window.partitionBy("g").orderBy(c).rangeBetween(Window.unboundedPreceding, 0))  # noqa: E731  over bins x shifts
    near, bounds = (F.col("lo") <= F.col("x_hi")) & (F.col("hi") >= F.col("x_lo")), [*rank, "x_lo", "x_hi"]
    found = None
    while True:
        # the sums of a bin and a shift lie between the bin's bounds, moved; there are as many as the bin has values, times the shift's count
        moved = hist.join(moves, "g").select("g", "a", "b", (F.col("a") + F.col("s")).alias("lo"), (F.col("b") + F.col("s")).alias("hi"), (F.col("c") * F.col("m")).alias("w"))
        moved = checkpointed(moved.withColumn("most", upto("lo")).withColumn("least", upto("hi")))
        ends = ranks.join(moved, "g").groupBy(rank).agg(
            F.min(F.when(F.col("most") > F.col("rank"), F.col("lo"))).alias("x_lo"), F.min(F.when(F.col("least") > F.col("rank"), F.col("hi"))).alias("x_hi")
        )
        weight = lambda c: F.sum(F.when(c, F.col("w")).otherwise(0))
        about = ends.join(moved, "g").groupBy(bounds).agg(weight(near).alias("n"), weight(F.col("hi") < F.col("x_lo")).alias("before"))
        about = checkpointed(about)
        met = F.col("x_lo") == F.col("x_hi")
        one = about.where(met).select(*rank, F.col("x_lo").alias("x"))
        one = one.unionByName(_listed(own, moves, about.where(~met & (F.col("n") <= gather)), moved, near, bounds).select(*rank, "x"))
        found = one if found is None else found.unionByName(one)
        about = about.where(~met & (F.col("n") > gather))
        if about.isEmpty():
            return _interpolated(found, levels, by, name)
        ranks = about.select(rank)
        active = about.join(moved, "g").where(near & (F.col("a") < F.col("b"))).select("g", "a", "b").distinct()
        active = active.join(hist, ["g", "a", "b"]).select("g", F.col("a").alias("lo"), F.col("b").alias("hi"), "log", F.col("c").alias("of"))
        active = checkpointed(active)
        fine = _meet(own, active).groupBy("g", "lo", "hi", "of", "log", _bin(F.col("v"), F.col("lo"), F.col("hi"), F.col("log"), bins).alias("bin"))
        fine = fine.agg(F.min("v").alias("a"), F.max("v").alias("b"), F.count("*").alias("c"))
        fine = fine.select("g", "a", "b", "c", (~F.col("log") & (8 * F.col("c") > F.col("of"))).alias("log"))
        rest = hist.join(active.select("g", F.col("lo").alias("a"), F.col("hi").alias("b")), ["g", "a", "b"], "left_anti")
        hist = checkpointed(rest.unionByName(fine))


def _listed(own: DataFrame, moves: DataFrame, ranks: DataFrame, moved: DataFrame, near: Column, bounds: list[str]) -> DataFrame:
    """(bounds, x) of ranks near which so few sums are left that they can be listed."""
    bars = ranks.join(moved, "g").where(near).select("g", F.col("a").alias("lo"), F.col("b").alias("hi")).distinct()
    values = _meet(own, bars).select("g", "v", F.col("lo").alias("a"), F.col("hi").alias("b"))
    ends = [(F.col(c) + F.col("s")).alias(n) for c, n in (("v", "x"), ("a", "lo"), ("b", "hi"))]
    sums = ranks.join(values.join(moves, "g").select("g", *ends, "m"), "g").where(near)
    w = Window.partitionBy(bounds).orderBy("x").rangeBetween(Window.unboundedPreceding, 0)
    placed = sums.withColumn("upto", F.col("before") + F.sum("m").over(w))
    return placed.where(F.col("upto") > F.col("rank")).groupBy(bounds).agg(F.min("x").alias("x"))


def medians(df: DataFrame, value: Column | str, by: Sequence[str] = (), name: str = "median") -> DataFrame:
    """(by, name): each group's exact median."""
    return quantiles(df, value, [0.5], by).select(*by, F.col("q")[0].alias(name))


def _ordered(x: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the values; both zeros are one."""
    i = (x + 0.0).view(np.int64)
    return (i ^ ((i >> 63) & np.int64(2**63 - 1))).view(np.uint64) ^ np.uint64(1 << 63)


def _value(key: int) -> float:
    i = np.array([key], np.uint64) ^ np.uint64(1 << 63)
    i = i.view(np.int64)
    return float((i ^ ((i >> 63) & np.int64(2**63 - 1))).view(np.float64)[0])


def column_ranks(
    df: DataFrame, columns: Sequence[str], ranks: Callable[[int], Sequence[int]], part: str | None = None, parts: int = 1, top: int = 12, bits: int = 8, listed: int = 100_000
) -> list[list[tuple[int, list[float]]]]:
    """For each k below ``parts`` and each column: how many values there are in rows whose ``part`` (an int) is k at most, and those of the ``ranks`` (of
    the count, from 0). ``df`` is a stored table, which each pass reads; a pass costs arrays, whatever the number of ranks and parts."""
    df = df.select(*(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)), (F.col(part) if part else F.lit(0)).cast("int").alias("part"))
    sign = np.uint64(1 << 63)

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for b in batches:
            own = b.column("part").to_numpy()
            for c in range(len(columns)):
                x = b.column(f"x{c}").to_numpy(zero_copy_only=False)
                some = np.flatnonzero(x == x)
                if len(some):
                    yield c, own[some].astype(np.intp), _ordered(x[some])

    def passed(starts: list[np.ndarray], left: int, wide: int, few: bool) -> pa.Table:
        """(cell, n, a, b): values and their bounds by part, column, interval (``starts``, each of 2^left keys) and the next ``wide`` bits; if ``few`` by value."""
        cells = [parts * len(s) << wide for s in starts]

        def within(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
            for c, own, key in values(batches):
                if left == 64:
                    yield c, own << wide | (key >> np.uint64(64 - wide)).astype(np.intp), key
                elif len(starts[c]):
                    at = np.maximum(np.searchsorted(starts[c], key, "right") - 1, 0)
                    off = key - starts[c][at]  # far off below the first start
                    some = np.flatnonzero(off >> np.uint64(left) == 0)
                    inner = (off[some] >> np.uint64(left - wide)).astype(np.intp)
                    yield c, (own[some] * len(starts[c]) + at[some]) << wide | inner, key[some]

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = [np.zeros(size, np.int64) for size in cells]
            low, high = [np.full(size, 2**64 - 1, np.uint64) for size in cells], [np.zeros(size, np.uint64) for size in cells]
            for c, cell, key in within(batches):
                n[c] += np.bincount(cell, minlength=cells[c])
                np.minimum.at(low[c], cell, key)
                np.maximum.at(high[c], cell, key)
            for c in range(len(columns)):
                at = np.flatnonzero(n[c])
                yield pa.RecordBatch.from_pydict({"c": np.full(len(at), c), "cell": at, "n": n[c][at], "a": (low[c][at] ^ sign).view(np.int64), "b": (high[c][at] ^ sign).view(np.int64)})

        def listing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for c, cell, key in within(batches):
                a = (key ^ sign).view(np.int64)
                yield pa.RecordBatch.from_pydict({"c": np.full(len(a), c), "cell": cell, "n": np.ones(len(a), np.int64), "a": a, "b": a})

        by = ["c", "cell", "a"] if few else ["c", "cell"]
        found = df.mapInArrow(listing if few else count, "c long, cell long, n long, a long, b long").groupBy(*by)
        return found.agg(F.sum("n").alias("n"), F.max("b").alias("b"), *([] if few else [F.min("a").alias("a")])).toArrow()

    counts = np.zeros((parts, len(columns)), np.int64)
    done: dict[tuple[int, int, int], int] = {}
    starts, left, wide, few = [np.zeros(1, np.uint64) for _ in columns], 64, top, False
    open_: dict[int, list[tuple[int, int, int, int]]] = {}  # column -> (part, rank, interval, values of the part below it)
    first = True
    while first or any(open_.values()):
        table = passed(starts, left, wide, few)
        c, cell, n = (table[x].to_numpy() for x in ("c", "cell", "n"))
        a, b = ((table[x].to_numpy().view(np.uint64) ^ sign) for x in ("a", "b"))
        rest, inside, new_starts = {}, 0, []
        for col in range(len(columns)):
            own = np.flatnonzero(c == col)
            place = cell[own] % (len(starts[col]) << wide)  # interval and bits
            own_part, interval = cell[own] // (len(starts[col]) << wide), place >> wide
            if first:
                for k in range(parts):
                    counts[k, col] = n[own][own_part <= k].sum()
                open_[col] = [(k, int(r), 0, 0) for k in range(parts) if counts[k, col] for r in ranks(int(counts[k, col]))]
            order = np.lexsort((a[own], place))
            own, place, own_part, interval = own[order], place[order], own_part[order], interval[order]
            rest[col] = []
            for k, r, at, below in open_[col]:
                some = np.flatnonzero((interval == at) & (own_part <= k))
                spot = place[some] if not few else np.arange(len(some))
                upto = below + np.cumsum(n[own[some]])
                hit = int(np.searchsorted(upto, r, "right"))
                same = some[spot == spot[hit]]
                least, most = int(a[own[same]].min()), int(b[own[same]].max())
                if least == most:
                    done[k, col, r] = least
                else:
                    ahead = np.flatnonzero(spot == spot[hit])[0]
                    start = least >> (left - wide) << (left - wide)
                    rest[col].append((k, r, start, int(upto[ahead - 1]) if ahead else below))
            ends = sorted({x[2] for x in rest[col]})
            inside += sum(int(n[own[(a[own] >= np.uint64(e)) & (a[own] <= np.uint64(e + (1 << (left - wide)) - 1))]].sum()) for e in ends)
            new_starts.append(np.array(ends, np.uint64))
            rest[col] = [(k, r, ends.index(start), below) for k, r, start, below in rest[col]]
        open_, starts, left, first = rest, new_starts, left - wide, False
        wide, few = min(bits, left), inside <= listed
    return [[(int(counts[k, c]), [_value(done[k, c, int(r)]) for r in ranks(int(counts[k, c]))] if counts[k, c] else []) for c in range(len(columns))] for k in range(parts)]
