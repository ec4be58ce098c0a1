"""Subsequence ("fuzzy") matching.

The score is this library's own: 100 for each matched character, less one for
each character skipped between the first and the last, less the place of the first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is mentioned."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fuzzy_positions(text: Column, query: str) -> Column:
    """Places, from 0, of the query's characters in order, each the leftmost possible; null without a match."""
    if not query:
        return F.lit(None).cast("array<int>")
    low = F.lower(text)

    def step(acc, c):
        return F.concat(acc, F.array(F.call_function("locate", c, low, F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + 1)))

    found = F.aggregate(F.array(*map(F.lit, query.lower())), F.array().cast("array<int>"), step)
    return F.when(text.isNotNull(), once(found, lambda f: F.when(~F.array_contains(f, 0), F.transform(f, lambda p: p - 1))))


def fuzzy_score(places: Column) -> Column:
    """The score of such places; null stays null."""

    def value(p):
        k, first, last = F.size(p), F.get(p, F.lit(0)), F.try_element_at(p, F.lit(-1))
        return F.when(p.isNotNull(), (k * 100 - (last - first + 1 - k) - first).cast("long"))

    return once(places, value)


def best(a: Column, b: Column) -> Column:
    """The greater of two optional scores."""
    return F.greatest(a, b)
