"""Positions of regular-expression matches, and sweeps over spans, with built-in functions only.

Spark returns what a pattern matched, not where. ``split`` returns what lies between the matches, so the running sum of
both lengths gives the positions, in code points. Patterns here use possessive quantifiers and start only where a run
starts, so a failed match is not retried inside the run and long texts stay linear.

Running values over an array are made by doubling: k passes reach back 2**k elements, each pass one copy, so an array
of n elements takes n log n steps. A fold that appends to an array would copy it at each step.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MATCH = "array<struct<s:int,e:int,m:string,left:string>>"
_REACH = [1 << k for k in range(31)]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, combine: Callable[[Column, Column], Column], neutral: Column) -> Column:
    """values[0], combine(values[0], values[1]), ... for an associative ``combine`` with a neutral element."""

    def double(acc: Column, reach: Column) -> Column:
        earlier = F.concat(F.array_repeat(neutral, reach), F.slice(acc, F.lit(1), F.size(acc) - reach))
        return F.zip_with(earlier, acc, lambda a, b: combine(a, b))

    def scan(v: Column) -> Column:
        return F.aggregate(F.filter(F.array(*map(F.lit, _REACH)), lambda r: r < F.size(v)), v, double)

    return let(values, scan)


def matches(text: Column, pattern: str, guard: Column | None = None) -> Column:
    """array<struct<s, e, m, left>>: start, end (exclusive), match, and the text since the match before.

    ``guard`` is a cheap test that holds wherever the pattern can match.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(F.split(text, pattern, -1), found, lambda g, m: F.struct(g.alias("g"), m.alias("m")))

    def placed(p: Column) -> Column:
        ends = running(F.transform(p, lambda x: F.length(x["g"]) + F.coalesce(F.length(x["m"]), F.lit(0))), lambda a, b: a + b, F.lit(0))
        rows = F.zip_with(p, ends, lambda x, e: F.struct((e - F.length(x["m"])).alias("s"), e.alias("e"), x["m"].alias("m"), x["g"].alias("left")))
        return F.filter(rows, lambda x: x["m"].isNotNull())  # what follows the last match has none

    hit = text.rlike(pattern) if guard is None else guard & text.rlike(pattern)
    return F.when(hit, let(pairs, placed)).otherwise(F.array().cast(MATCH))


def outside(spans: Column, taken: Column) -> Column:
    """Those of ``spans`` that overlap none of ``taken``; both are arrays of structs with s and e. One merged sweep."""
    far = 1 << 30

    def tagged(a: Column, own: bool) -> Column:
        row = lambda x, i: F.struct(x["s"].alias("s"), F.lit(own).alias("own"), x["e"].alias("e"), i.alias("i"))
        return F.transform(a, row)

    def swept(mine: Column) -> Column:
        def free(both: Column) -> Column:
            behind = running(F.transform(both, lambda x: F.when(x["own"], F.lit(-far)).otherwise(x["e"])), F.greatest, F.lit(-far))
            ahead = F.reverse(running(F.reverse(F.transform(both, lambda x: F.when(x["own"], F.lit(far)).otherwise(x["s"]))), F.least, F.lit(far)))
            rows = F.arrays_zip(both.alias("b"), behind.alias("l"), ahead.alias("r"))
            kept = F.filter(rows, lambda x: x["b"]["own"] & (x["l"] <= x["b"]["s"]) & (x["r"] >= x["b"]["e"]))
            return F.transform(kept, lambda x: F.get(mine, x["b"]["i"]))

        return let(F.array_sort(F.concat(tagged(mine, True), tagged(taken, False))), free)

    return F.when((F.size(spans) > 0) & (F.size(taken) > 0), let(spans, swept)).otherwise(spans)


def of_kind(found: Column, kind: str, rank: int) -> Column:
    """array<struct<s, rank, e, kind, m>>, which sorts by start, then by the kind's place in the list."""
    return F.transform(
        found, lambda x: F.struct(x["s"].alias("s"), F.lit(rank).alias("rank"), x["e"].alias("e"), F.lit(kind).alias("kind"), x["m"].alias("m"))
    )


def rendered(found: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def count_kind(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda x: x["kind"] == kind)).cast("long")
