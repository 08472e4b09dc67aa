"""A gazetteer: rules for word endings compiled to forms, and texts scanned once for all forms.

Names are compiled on Spark to the forms in which a text may have them. The forms go into a multi-pattern automaton that a
task builds once; a text is read once, however many names there are. What is shared with the tasks is a block of forms of bounded
size; a larger table is worked off in blocks, a scan each.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed

#: How the last word of a name may end, by kind of name. The longest fitting ending is replaced by each of the others.
ENDINGS = {
    "city": {"а": "а ы е у ой", "я": "я и е ю ей", "ь": "ь и я ю ем ью е", "о": "о", "": "а у е ом"},
    "district": {"ий": "ий ого ому им ом", "ый": "ый ого ому ым ом", "ой": "ой ого ому ым ом"},
    "region": {"ая": "ая ой ую", "ий": "ий ого ому им ом", "ия": "ия ии ию ией", "а": "а ы е у ой", "ь": "ь и ью", "": "а у е ом"},
}
#: A district counts only with its unit behind it.
UNITS = {"district": "район района району районом районе округ округа округу округом округе"}
#: Forms that one block may hold, in characters; a block's automaton takes some tens of bytes for each.
BLOCK = 4_000_000
#: Texts whose forms are held at a time.
TEXTS = 256


def spelled(text: Column) -> Column:
    """One spelling of ё, in texts and names alike."""
    return F.translate(text, "ёЁ", "еЕ")


def forms(name: Column, endings: Mapping[str, str], least: int = 4) -> Column:
    """All forms of a name, itself first: ``endings`` maps an ending to the endings, separated by blanks, that may stand in its
    place; longer ones are tried first, and the empty one fits every name. A name that keeps less than ``least`` letters has only itself."""
    out = F.array(name)
    for ending in sorted(endings, key=len):
        stem = F.substring(name, F.lit(1), F.length(name) - len(ending))
        made = F.array(name, *(F.concat(stem, F.lit(t)) for t in endings[ending].split()))
        out = F.when(name.endswith(ending), F.when(F.length(stem) >= least, made).otherwise(F.array(name))).otherwise(out)
    return F.array_distinct(out)


def compiled(names: DataFrame, endings: Mapping[str, Mapping[str, str]] = ENDINGS, units: Mapping[str, str] = UNITS, least: int = 4) -> DataFrame:
    """(form, entity, region, ambiguous) from (entity, name, kind, region).

    A form that several entities share is ambiguous. A kind without endings has the name alone; a kind with units has each form with
    each unit behind it. Null and empty names have no forms.
    """
    name = spelled(F.trim("name"))
    found = F.array(name)
    for kind, own in endings.items():
        made = forms(name, own, least)
        if kind in units:
            behind = F.array(*map(F.lit, units[kind].split()))
            made = F.flatten(F.transform(made, lambda f: F.transform(behind, lambda u: F.concat(f, F.lit(" "), u))))  # noqa: B023
        found = F.when(F.col("kind") == kind, made).otherwise(found)
    table = names.where(F.length(F.trim("name")) > 0).select(F.explode(found).alias("form"), "entity", "region").distinct()
    sharing = table.groupBy("form").agg((F.countDistinct("entity") > 1).alias("ambiguous"))
    return table.join(sharing, "form").select("form", "entity", "region", "ambiguous")


def occurrences(texts: DataFrame, key: str, text: str, form_table: DataFrame, block: int = BLOCK) -> DataFrame:
    """(key, form, n): how often each form stands in a text as a whole word or words.

    A letter, digit, underscore or hyphen beside it makes a form part of a longer word. Forms may overlap; each counts. Case matters. Null
    and empty texts have none.
    """
    own = checkpointed(form_table.select("form").where(F.length("form") > 0).distinct())
    size = own.agg(F.coalesce(F.sum(F.length("form") + 1), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-size // block))
    kind, spark, out = texts.schema[key].dataType.simpleString(), texts.sparkSession, None
    read = texts.where(F.length(text) > 0).select(F.col(key).alias("k"), spelled(F.col(text)).alias("text"))
    for i in range(blocks):
        part = own.where(F.pmod(F.xxhash64("form"), F.lit(blocks)) == i).toPandas()["form"].tolist()  # about ``block`` characters
        shared = spark.sparkContext.broadcast(part)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            machine = ahocorasick.Automaton()
            for form in shared.value:
                machine.add_word(form, form)
            if len(machine):
                machine.make_automaton()
            inside = lambda c: c.isalnum() or c in "_-"
            for piece in (b.slice(at, TEXTS) for b in batches for at in range(0, b.num_rows, TEXTS)):
                keys, found, counts = [], [], []
                for k, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                    seen: dict[str, int] = {}
                    for end, form in machine.iter(text) if len(machine) else ():
                        start = end + 1 - len(form)
                        if not (start and inside(text[start - 1])) and not (end + 1 < len(text) and inside(text[end + 1])):
                            seen[form] = seen.get(form, 0) + 1
                    keys += [k] * len(seen)
                    found += seen.keys()
                    counts += seen.values()
                yield pa.RecordBatch.from_arrays([pa.array(keys, piece.schema.field(0).type), pa.array(found, pa.string()), pa.array(counts, pa.int64())], ["k", "form", "n"])

        one = read.mapInArrow(scan, f"k {kind}, form string, n long")
        out = one if out is None else out.unionByName(one)
    return out.withColumnRenamed("k", key)


def mentions(texts: DataFrame, key: str, text: str, table: DataFrame, regions: DataFrame, block: int = BLOCK) -> DataFrame:
    """(key, entity, n): entities that a text names, and how often. An ambiguous form counts for those of its entities whose region the
    text names, too. ``table`` and ``regions`` are what ``compiled`` gives, the latter with regions as entities. Rows of one key count together."""
    table, regions = checkpointed(table), checkpointed(regions.select("form", F.col("entity").alias("region")).distinct())
    hits = checkpointed(occurrences(texts, key, text, table.select("form").unionByName(regions.select("form")), block))  # no text in it
    named = hits.join(regions, "form").select(key, "region").distinct()
    found = hits.join(table, "form")
    sure = found.where("not ambiguous").select(key, "entity", "n")
    told = found.where("ambiguous").join(named, [key, "region"]).select(key, "entity", "n")
    return sure.unionByName(told).groupBy(key, "entity").agg(F.sum("n").alias("n"))
