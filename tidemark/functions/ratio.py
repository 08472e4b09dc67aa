"""Similarity of names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import norm_key


def sorted_words(name: Column) -> Column:
    return F.array_join(F.array_sort(F.split(norm_key(name), " ")), " ")


def token_sort_ratio(a: Column, b: Column) -> Column:
    """100 x (1 - edit distance / length) of the names with their words sorted."""
    x, y = sorted_words(a), sorted_words(b)
    return 100 * (1 - F.try_divide(F.levenshtein(x, y), F.greatest(F.length(x), F.length(y))))
