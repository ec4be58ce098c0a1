"""Kana to sound units ("morae"), as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .tables import DIGRAPH, GEMINATE, HIRAGANA, KATAKANA, LONG, SINGLE

UNIT_TYPE = "array<struct<s: int, e: int, m: string>>"
_UNITS = "|".join([*DIGRAPH, *SINGLE])
#: A unit with or without the sign that doubles it, or any other character.
_TOKEN = f"(?s)({GEMINATE}(?:{_UNITS})|{_UNITS}|.)"


def literal_map(table: dict[str, str]) -> Column:
    """A constant map, small as an expression: Spark folds it into one literal."""
    return F.map_from_arrays(F.split(F.lit(" ".join(table)), " "), F.split(F.lit(" ".join(table.values())), " "))


def katakana_to_hiragana(text: Column) -> Column:
    return F.translate(text, KATAKANA, HIRAGANA)


def _reading(token: Column) -> Column:
    known = literal_map(DIGRAPH | SINGLE)
    doubled = F.try_element_at(known, F.substring(token, 2, 2))
    return F.when(token.startswith(GEMINATE) & (F.length(token) > 1), F.concat(F.left(doubled, F.lit(1)), doubled)).otherwise(F.try_element_at(known, token))


def morae_with_spans(hiragana: Column) -> Column:
    """array<struct<s, e, m>>: units of a hiragana string with the characters
    [s, e) they cover.  A long-vowel sign repeats the last character of the unit
    before it; what has no reading yields nothing.  Null gives null."""
    tokens = F.regexp_extract_all(hiragana, F.lit(_TOKEN), F.lit(1))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(UNIT_TYPE).alias("out"))

    def step(acc, token):
        end = acc["at"] + F.length(token)
        held = F.right(F.try_element_at(acc["out"], F.lit(-1))["m"], F.lit(1))
        m = F.when(token == LONG, held).otherwise(_reading(token))
        unit = F.struct(acc["at"].alias("s"), end.alias("e"), m.alias("m"))
        return F.struct(end.alias("at"), F.when(m.isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(unit))).cast(UNIT_TYPE).alias("out"))

    return F.aggregate(tokens, start, step)["out"]


def morae(hiragana: Column) -> Column:
    """array<string>: the units of a hiragana string."""
    return F.transform(morae_with_spans(hiragana), lambda x: x["m"])
