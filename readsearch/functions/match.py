"""Matching of a decoded or plain query against indexed texts, as expressions.

A query is a literal: it is decoded once on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fuzzy import once
from .query import decode

MATCH_TYPE = "struct<path: string, start: int, score: bigint>"


def score(length: Column, start: Column, total: Column) -> Column:
    """Longer and earlier matches rank higher: 100 for each unit, and what is left behind the start."""
    return (length * 100 + F.greatest(total - start, F.lit(0))).cast("long")


def window_start(morae: Column, units: list[str]) -> Column:
    """The first place at which the units lie side by side, from 0; null if there is none or no unit."""
    n = len(units)
    if not n:
        return F.lit(None).cast("int")
    wanted = F.array(*map(F.lit, units))
    places = F.filter(F.sequence(F.lit(1), F.size(morae) - n + 1), lambda i: F.slice(morae, i, F.lit(n)) == wanted)
    return F.when(F.size(morae) >= n, F.get(places, F.lit(0)) - 1)


def plain_start(text: Column, query: str) -> Column:
    """Where the lower-cased query lies in the lower-cased text, from 0; null if nowhere or empty."""
    if not query:
        return F.lit(None).cast("int")
    return once(F.instr(F.lower(text), F.lit(query.lower())), lambda at: F.when(at > 0, at - 1))


def matched(text: Column, morae: Column, query: str) -> Column:
    """struct(path, start, score): by units if they match, else by substring; null without a match."""
    units = decode(query)
    found = lambda path, at, n, total: F.when(at.isNotNull(), F.struct(F.lit(path).alias("path"), at.alias("start"), score(F.lit(n), at, total).alias("score")))
    by_unit = once(window_start(morae, units), lambda w: found("mora", w, len(units), F.size(morae)))
    by_text = once(plain_start(text, query), lambda p: found("plain", p, len(query), F.length(text)))
    return F.coalesce(by_unit, by_text).cast(MATCH_TYPE)


def plain_positions(text: Column, start: Column, length: int) -> Column:
    """The characters of a plain match, none beyond the text's end."""
    end = F.least(start + length, F.length(text))
    return F.when((start.isNotNull()) & (end > start), F.sequence(start, end - 1)).otherwise(F.array().cast("array<int>"))


def window_positions(segments: Column, start: Column, n: int) -> Column:
    """All characters of the segments that the units [start, start + n) touch."""
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def step(acc, seg):
        end = acc["at"] + seg["morae_len"]
        lit = (acc["at"] < start + n) & (end > start) & (seg["char_end"] > seg["char_start"])
        more = F.when(lit, F.concat(acc["out"], F.sequence(seg["char_start"], seg["char_end"] - 1))).otherwise(acc["out"])
        return F.struct(end.alias("at"), more.alias("out"))

    return F.aggregate(segments, begin, step)["out"]


def positions(text: Column, segments: Column, match: Column, query: str) -> Column:
    """The characters to highlight for a match; none without one."""
    none = F.array().cast("array<int>")
    by_unit = window_positions(segments, match["start"], len(decode(query)))
    return F.when(match["path"] == "mora", by_unit).when(match["path"] == "plain", plain_positions(text, match["start"], len(query))).otherwise(none)
