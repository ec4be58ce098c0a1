"""Highlighting: matched characters by mode, spans, and display rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fuzzy import fuzzy_positions, once
from ..functions.match import matched, positions
from ..functions.text import args_suffix, count_prefix, secondary_text

_NONE = "array<int>"


def _none() -> Column:
    return F.array().cast(_NONE)


def title_positions(query: str, mode: str = "combined", indexed: bool = True) -> Column:
    """Characters of the title that a query matches; in combined mode those of either matcher, sorted."""
    fuzzy = F.coalesce(fuzzy_positions(F.col("title"), query), _none())
    if not indexed:
        return fuzzy if mode != "reading" else _none()
    reading = once(matched(F.col("title"), F.col("morae"), query), lambda m: positions(F.col("title"), F.col("segments"), m, query))
    if mode == "combined":
        return F.array_sort(F.array_distinct(F.concat(fuzzy, reading)))
    return reading if mode == "reading" else fuzzy


def secondary_positions(query: str, mode: str = "combined") -> Column:
    """Characters of the secondary text that a query matches; none in reading mode."""
    if mode == "reading":
        return _none()
    return F.coalesce(fuzzy_positions(secondary_text(F.col("type"), F.col("url"), F.col("command")), query), _none())


def spans(text: Column, places: Column) -> Column:
    """array<struct<start, end, lit>>: the text cut wherever lit and unlit characters adjoin."""
    n, none = F.length(text), F.array().cast("array<struct<start: int, end: int, lit: boolean>>")

    def cut(inside):
        edges = F.filter(F.flatten(F.transform(inside, lambda p: F.array(p, p + 1))), lambda e: F.array_contains(inside, e) != F.array_contains(inside, e - 1))
        return once(F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0), n), edges))), lambda cuts: paired(inside, cuts))

    def paired(inside, cuts):
        pairs = F.arrays_zip(F.slice(cuts, F.lit(1), F.size(cuts) - 1).alias("a"), F.slice(cuts, F.lit(2), F.greatest(F.size(cuts) - 1, F.lit(0))).alias("b"))
        return F.transform(pairs, lambda p: F.struct(p["a"].alias("start"), p["b"].alias("end"), F.array_contains(inside, p["a"]).alias("lit")))

    lit = F.array_sort(F.array_distinct(F.filter(places, lambda p: (p >= 0) & (p < n))))
    return F.when(n > 0, once(lit, cut)).otherwise(none)


def display_rows(hits: DataFrame, query: str, mode: str = "combined", indexed: bool = True) -> DataFrame:
    """(rank, entry_id, prefix, title_spans, suffix, secondary, secondary_spans) of ranked entries."""
    second = secondary_text(F.col("type"), F.col("url"), F.col("command"))
    return hits.select(
        "rank", "entry_id", count_prefix(F.col("access_count")).alias("prefix"),
        spans(F.col("title"), title_positions(query, mode, indexed)).alias("title_spans"),
        F.when(F.col("type") == "app", args_suffix(F.col("args"))).otherwise("").alias("suffix"),
        second.alias("secondary"), spans(F.coalesce(second, F.lit("")), secondary_positions(query, mode)).alias("secondary_spans"),
    )
