"""Joins on names, prefixes, patterns and priorities."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ratio import sorted_words, token_sort_ratio
from ..functions.text import norm_key, stem_key
from ..session import checkpointed


def unique_only(right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key occurs once; keys that occur more often are dropped entirely."""
    once = right.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n = 1").select(*keys)
    return right.join(once, list(keys), "left_semi")


def priority_fill(base: DataFrame, sources: Mapping[str, tuple[DataFrame, Sequence[str]]], value: str) -> DataFrame:
    """``value`` from the first source that has it, and that source's name. A source is a frame and its join keys."""
    out = base
    for name, (source, keys) in sources.items():
        out = out.join(source.select(*keys, F.col(value).alias(f"_{name}")), list(keys), "left")
    picks = [F.col(f"_{name}") for name in sources]
    tag = F.coalesce(*(F.when(F.col(f"_{name}").isNotNull(), F.lit(name)) for name in sources))
    return out.withColumn(value, F.coalesce(*picks)).withColumn("source", tag).drop(*(f"_{name}" for name in sources))


def priority_union(sources: Sequence[DataFrame], keys: Sequence[str], order: str) -> DataFrame:
    """The row of each key from the first source that has the key."""
    tagged = None
    for i, s in enumerate(sources):
        s = s.withColumn("_p", F.lit(i))
        tagged = s if tagged is None else tagged.unionByName(s)
    w = Window.partitionBy(*keys).orderBy("_p", order)
    return tagged.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_p", "_r")


def prefix_join(left: DataFrame, name: str, queries: DataFrame, prefix: str, size: int = 3, on: Sequence[str] = ()) -> DataFrame:
    """Rows whose name starts with a query. An equi-join on the first ``size`` letters comes first, so nothing is compared
    with everything; queries shorter than that are joined on each of their lengths."""
    lengths = [r[0] for r in queries.select(F.least(F.length(prefix), F.lit(size)).alias("n")).distinct().collect()]  # 1..size
    pieces = F.array_distinct(F.array(*(F.substring(name, 1, n) for n in sorted(lengths) if n)))
    heads = left.withColumn("_h", F.explode(pieces) if lengths else F.lit(None).cast("string"))
    q = queries.withColumn("_h", F.substring(prefix, 1, size))
    return heads.join(q, [*on, "_h"]).where(F.col(name).startswith(F.col(prefix))).drop("_h")


def pattern_tags(texts: DataFrame, text: str, patterns: DataFrame, key: str) -> DataFrame:
    """(key, entity) where an entity's pattern occurs in the text.

    ``patterns``: entity, stem, pattern, region, ambiguous. Texts meet patterns by an equi-join on word stems, without
    their text; a text is then fetched once, for all the patterns that its stems lead to, and the regular expressions
    only verify. Names that several entities share count only with their region's name in the text. ``key`` is unique.
    """
    stems = F.array_distinct(F.transform(F.split(norm_key(F.col(text)), " "), lambda w: F.substring(w, 1, 5)))
    words = texts.select(key, F.explode(stems).alias("stem"))
    led = words.join(patterns, "stem").groupBy(key).agg(F.collect_set(F.struct("entity", "pattern", "region", "ambiguous")).alias("_p"))
    low = F.lower(F.col(text))
    good = lambda p: F.rlike(F.col(text), p["pattern"]) & (~p["ambiguous"] | low.contains(F.lower(p["region"])))
    hit = texts.select(key, text).join(led, key).select(key, F.explode(F.filter("_p", good)).alias("p"))
    return hit.select(key, F.col("p.entity").alias("entity")).distinct()


def word_tags(texts: DataFrame, text: str, words: Column, names: DataFrame, key: str) -> DataFrame:
    """(key, entity) where an entity's name is among a text's ``words``, an array without repeats.

    ``names``: entity, region, ambiguous; an entity is its own name, one word. An ambiguous name counts only with its region's name in the
    text, too. Words meet names in an equi-join; a text is read where it lies and never compared with names one by one. Regions with an ambiguous
    name are few.
    """
    regions = names.where("ambiguous").select("region").distinct().agg(F.collect_set("region").alias("_regions"))  # one row
    low = F.lower(F.col(text))
    told = F.filter("_regions", lambda r: low.contains(F.lower(r)))
    found = texts.crossJoin(F.broadcast(regions)).select(key, told.alias("_told"), words.alias("_words"))
    found = found.select(key, "_told", F.explode("_words").alias("entity")).join(names, "entity")
    return found.where(~F.col("ambiguous") | F.array_contains("_told", F.col("region"))).select(key, "entity").distinct()


def _pieces(length: Column, cutoff: float) -> Column:
    """array<struct<i, start, size>>: the pieces into which a title of ``length`` is cut, one more than the most edits that
    a name as similar as ``cutoff`` can differ by, so that one piece at least is in the name unchanged."""
    count = F.floor(length * (100 - cutoff) / cutoff + 1e-9).cast("int") + 1
    base, longer = F.floor(length / count).cast("int"), length % count
    row = lambda i: F.struct(i.alias("i"), (i * base + F.greatest(i - (count - longer), F.lit(0))).alias("start"), (base + (i >= count - longer).cast("int")).alias("size"))
    return F.transform(F.sequence(F.lit(0), count - 1), row)


#: Edits up to which names meet by what remains when letters are deleted; a name of n letters has about n ** 2 / 2 such remains at two.
DELETED = 2


def _edits(longer: Column, cutoff: float) -> Column:
    """The most edits that names can differ by at a ratio of ``cutoff``, the longer one having that many letters."""
    return F.floor(longer * (100 - cutoff) / 100 + 1e-9).cast("int")


def _remains(x: Column, deleted: Column) -> Column:
    """All that can remain of a text when ``deleted`` letters (none, one or two) are deleted."""
    n = F.length(x)
    head, tail = lambda i: F.substring(x, F.lit(1), i - 1), lambda i: F.substring(x, i + 1, n)
    one = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(head(i), tail(i)))
    both = lambda i, j: F.concat(head(i), F.substring(x, i + 1, j - i - 1), tail(j))
    two = F.flatten(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.transform(F.sequence(i + 1, n), lambda j: both(i, j))))
    return F.when(deleted == 0, F.array(x)).when(deleted == 1, one).otherwise(two)


def _met_by_remains(a: DataFrame, b: DataFrame, on: Sequence[str], cutoff: float) -> DataFrame:
    """Pairs of ``a`` (.., _x, _n) and ``b`` (.., _y, _len) that may differ by ``DELETED`` edits at most.

    Where k edits are allowed at the longer one's length m, the same m - k letters remain of both when each is cut down to that, if there are no more edits than k.
    What is common to all names of a group is no key by itself, so those that meet are alike as a whole.
    """
    pairs = a.select("_n").distinct().crossJoin(F.broadcast(b.select("_len").distinct()))  # lengths, few
    pairs = pairs.withColumn("_m", F.greatest("_n", "_len")).withColumn("_k", _edits(F.col("_m"), cutoff)).where((F.abs(F.col("_n") - F.col("_len")) <= F.col("_k")) & (F.col("_k") <= DELETED))

    def keyed(rows: DataFrame, text: str, size: str) -> DataFrame:
        cuts = pairs.select(size, "_m", (F.col("_k") - F.col("_m") + F.col(size)).alias("_d")).distinct()
        keys = F.transform(_remains(F.col(text), F.col("_d")), lambda r: F.xxhash64("_m", r))  # a chance hit is found out by the ratio
        return rows.join(F.broadcast(cuts), size).withColumn("_key", F.explode(F.array_distinct(keys))).drop("_m", "_d", text, size)

    return keyed(a, "_x", "_n").join(keyed(b, "_y", "_len"), [*on, "_key"]).drop("_key")


def similar_names(left: DataFrame, right: DataFrame, on: Sequence[str], cutoff: float) -> DataFrame:
    """Pairs of ``left`` (name) and ``right`` (title) that share ``on`` and whose token-sort ratio is at least ``cutoff``.

    No pair is lost. Up to two allowed edits, sorted words meet by what remains of them when letters are deleted. Above that, a title's sorted
    words are cut into more pieces than the edits allowed, and a name offers, for each length that its partner may have, all its substrings where such a
    piece may lie; pieces that most titles share meet often there. These meet in an equi-join, and the ratio decides.
    """
    a = left.withColumn("_x", sorted_words(F.col("name"))).withColumn("_n", F.length("_x"))
    b = right.withColumn("_y", sorted_words(F.col("title"))).withColumn("_len", F.length("_y"))
    low, high = lambda n: F.ceil(n * cutoff / 100 - 1e-9).cast("int"), lambda n: F.floor(n * 100 / cutoff + 1e-9).cast("int")
    kept = b.where(_edits(high(F.col("_len")), cutoff) > DELETED).select("*", F.explode(_pieces(F.col("_len"), cutoff)).alias("_p"))
    kept = kept.select(*right.columns, "_len", F.col("_p.i").alias("_i"), F.substring("_y", F.col("_p.start") + 1, F.col("_p.size")).alias("_s"))
    offered = a.select("*", F.explode(F.sequence(low(F.col("_n")), high(F.col("_n")))).alias("_len")).where(_edits(F.greatest("_n", "_len"), cutoff) > DELETED)
    offered = offered.select("*", F.explode(_pieces(F.col("_len"), cutoff)).alias("_p"))
    reach = F.floor(F.col("_len") * (100 - cutoff) / cutoff + 1e-9).cast("int")
    first, end = F.greatest(F.col("_p.start") - reach, F.lit(0)), F.least(F.col("_p.start") + reach, F.col("_n") - F.col("_p.size"))
    places = F.when(end >= first, F.sequence(first, end)).otherwise(F.array().cast("array<int>"))
    offered = offered.withColumn("_at", F.explode(places)).select(*left.columns, "_len", F.col("_p.i").alias("_i"), F.substring("_x", F.col("_at") + 1, F.col("_p.size")).alias("_s"))
    by_pieces = offered.join(kept, [*on, "_len", "_i", "_s"]).drop("_len", "_i", "_s")
    met = _met_by_remains(a, b, on, cutoff).unionByName(by_pieces).distinct()
    return met.withColumn("score", token_sort_ratio(F.col("name"), F.col("title"))).where(F.col("score") >= cutoff)


def cascade_match(names: DataFrame, dictionary: DataFrame, cutoff: float = 92) -> DataFrame:
    """(name, region, entity, match, score, candidates): exact, then normalised, then stems, then fuzzy; each step only
    sees what the one before left. More than one candidate at a step is ambiguous and matches nothing.

    All candidates are of the name's region; within it, no fuzzy candidate at or above the cutoff is missed.
    """
    left = names.select("name", "region").distinct()
    found = None

    steps = (("exact", lambda c: c), ("normalised", norm_key), ("stem", stem_key))
    for how, key in steps:
        a = left.withColumn("_k", key(F.col("name")))
        # a key's entities are one row before names meet it: a stem may be common to a whole region
        b = dictionary.select("entity", "region", key(F.col("title")).alias("_k")).groupBy("region", "_k").agg(F.min("entity").alias("entity"), F.countDistinct("entity").alias("candidates"))
        done = a.join(b, ["region", "_k"]).select("name", "region", "entity", "candidates", F.lit(100.0).alias("score"), F.lit(how).alias("match"))
        found = done if found is None else found.unionByName(done)
        left = left.join(done.select("name", "region"), ["name", "region"], "left_anti")
    pairs = checkpointed(similar_names(left, dictionary.select("region", "title").distinct(), ["region"], cutoff))
    top = pairs.groupBy("name", "region").agg(F.max("score").alias("_top"))
    best = pairs.join(top, ["name", "region"]).where("score = _top").join(dictionary.select("entity", "region", "title"), ["region", "title"])
    fuzzy = best.groupBy("name", "region").agg(F.min("entity").alias("entity"), F.countDistinct("entity").alias("candidates"), F.max("score").alias("score"), F.lit("fuzzy").alias("match"))
    found = found.unionByName(fuzzy)
    unsure = F.col("candidates") > 1
    return found.select(
        "name", "region", F.when(~unsure, F.col("entity")).alias("entity"), F.when(unsure, "ambiguous").otherwise(F.col("match")).alias("match"), "score", "candidates"
    )


def neighbour_region(rows: DataFrame, order: str, region: str, by: Sequence[str], k: int = 3) -> DataFrame:
    """Fill an unknown region where the k nearest known ones before and after in the list, however far, all agree.
    ``by`` names the list a row belongs to."""
    over = f"OVER (PARTITION BY {', '.join(f'`{c}`' for c in by)} ORDER BY `{order}`)"
    near = [F.expr(f"{side}(`{region}`, {i}) IGNORE NULLS {over}") for side in ("lag", "lead") for i in range(1, k + 1)]
    found = rows.withColumn("_near", F.array_distinct(F.array_compact(F.array(*near))))
    agreed = F.when(F.size("_near") == 1, F.element_at("_near", 1))
    return found.withColumn("resolved", F.coalesce(F.col(region), agreed)).drop("_near")


def assign_events(events: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(event_id, region, entity, level): an entity by its exact key in the region; else by the one key of the region that the
    place is a prefix of, where exactly one is; else the region alone, if the dictionary has it; else dropped."""
    cols = ["event_id", "region", "entity", "level"]
    keys = unique_only(dictionary, ["region", "key"])
    exact = events.join(keys.withColumnRenamed("key", "place"), ["region", "place"]).withColumn("level", F.lit("exact"))
    rest = events.join(exact.select("event_id"), "event_id", "left_anti")
    places = rest.select("region", "place").distinct()  # few, however many events there are
    pairs = prefix_join(dictionary.select("region", "key", "entity"), "key", places, "place", 4, ["region"])
    one = pairs.groupBy("region", "place").agg(F.min("entity").alias("entity"), F.countDistinct("entity").alias("n")).where("n = 1").drop("n")
    prefix = rest.join(one, ["region", "place"]).withColumn("level", F.lit("prefix"))
    left = rest.join(prefix.select("event_id"), "event_id", "left_anti")
    none = F.lit(None).cast(dictionary.schema["entity"].dataType)
    region = left.join(dictionary.select("region").distinct(), "region").withColumn("entity", none).withColumn("level", F.lit("region"))
    return exact.select(cols).unionByName(prefix.select(cols)).unionByName(region.select(cols))


def resolve_by_roots(names: DataFrame, dictionary: DataFrame, key: str, target: str, least: int = 4) -> DataFrame:
    """(key, target) of names that their roots resolve to one target.

    ``names``: key, roots (array); ``dictionary``: root, target. A root stands for the targets that have exactly this root; if none has, for those
    one of whose roots begins with it or with which it begins, both of ``least`` letters or more. A name resolves if every
    root of it stands for some target and exactly one target is common to all. Nulls and names without roots resolve to nothing.
    """
    own = dictionary.where("root is not null").select("root", target).distinct()
    known = F.array_sort(F.array_distinct(F.filter("roots", lambda r: r.isNotNull())))
    sets = names.select(known.alias("_set")).where(F.size("_set") > 0).distinct()  # as many as there are different names
    asked = sets.select("_set", F.explode("_set").alias("root"))
    roots = asked.select("root").distinct()
    exact = roots.join(own, "root")
    head = lambda c: F.substring(c, 1, least)
    rest = roots.join(exact, "root", "left_anti").where(F.length("root") >= least).withColumn("_head", head("root"))
    near = rest.join(own.select(F.col("root").alias("_own"), target, head("root").alias("_head")).where(F.length("_own") >= least), "_head")
    near = near.where(F.col("_own").startswith(F.col("root")) | F.col("root").startswith(F.col("_own"))).select("root", target).distinct()
    hits = asked.join(exact.unionByName(near), "root").groupBy("_set", target).agg(F.count("*").alias("_hits"))
    common = hits.where("_hits = size(_set)").groupBy("_set").agg(F.min(target).alias(target), F.count("*").alias("_k")).where("_k = 1")
    return names.select(key, known.alias("_set")).join(common.drop("_k"), "_set").select(key, target)
