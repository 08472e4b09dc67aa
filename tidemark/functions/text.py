"""Text functions as column expressions. Patterns that must also work on other alphabets carry (?iu)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cyrillic letters in Latin script.
TRANSLITERATION = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh", "з": "z", "и": "i", "й": "y", "к": "k",
    "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts",
    "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya",
}


def labels(text: Column, patterns: Mapping[str, str]) -> Column:
    """All labels whose pattern occurs, in the mapping's order."""
    return F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(k)) for k, p in patterns.items())))


def explain(text: Column, patterns: Mapping[str, str]) -> Column:
    """Map from label to the first words that matched it."""
    pairs = F.array(*(F.struct(F.lit(k).alias("k"), F.regexp_extract(text, p, 0).alias("v")) for k, p in patterns.items()))
    return F.map_from_entries(F.filter(pairs, lambda x: x["v"] != ""))


def first_rule(text: Column, rules: Mapping[str, str], veto: Mapping[str, str] | None = None, default: str = "other") -> Column:
    """The first rule that matches and whose veto, if it has one, doesn't."""
    out = F.lit(default)
    for kind, pattern in reversed(rules.items()):
        hit = text.rlike(pattern)
        if veto and kind in veto:
            hit &= ~text.rlike(veto[kind])
        out = F.when(hit, kind).otherwise(out)
    return out


def norm_key(name: Column) -> Column:
    """Lower case, one spelling of ё, only letters and digits, single spaces."""
    plain = F.translate(F.lower(name), "ё", "е")
    return F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " "))


def stem_key(name: Column, size: int = 5) -> Column:
    """Sorted word stems: case endings and word order don't matter."""
    words = F.array_sort(F.filter(F.split(norm_key(name), " "), lambda w: w != ""))
    return F.array_join(F.transform(words, lambda w: F.substring(w, 1, size)), " ")


def latin_key(name: Column) -> Column:
    """Cyrillic in Latin letters, with spellings that differ between sources made one."""
    out = F.lower(name)
    for a, b in TRANSLITERATION.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    for pattern, b in (("kh", "h"), ("iy\\b|yy\\b", "y"), ("['`’]", ""), ("[^a-z0-9]+", " ")):
        out = F.regexp_replace(out, pattern, b)
    return F.trim(out)


def fnv1a_base36(text: Column) -> Column:
    """32-bit FNV-1a over the code points of ASCII text, in base 36."""
    points = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    step = lambda h, c: F.pmod(h.bitwiseXOR(c) * 16777619, F.lit(4294967296))
    return F.lower(F.conv(F.aggregate(points, F.lit(2166136261).cast("long"), step).cast("string"), 10, 36))


def padded_code(code: Column, size: int) -> Column:
    """Codes keep their leading zeros."""
    return F.lpad(F.trim(code), size, "0")


def number(text: Column) -> Column:
    """Decimal comma, blanks inside, dashes and dots for missing."""
    plain = F.replace(F.regexp_replace(text, r"[\s ]", ""), F.lit(","), F.lit("."))
    return plain.try_cast("double")


def decimal_comma(value: Column, digits: int = 2) -> Column:
    return F.replace(F.format_string(f"%.{digits}f", value), F.lit("."), F.lit(","))


#: The common entities, in the order in which they are decoded.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def html_text(html: Column) -> Column:
    """Tags out, the common entities decoded, white space collapsed."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->|<[^>]+>", " ")
    for a, b in ENTITIES:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(out, r"\s+", " "))
