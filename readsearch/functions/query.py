"""Decoding of queries into sound units: on the driver for literals, as an expression for columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .kana import literal_map
from .tables import TOKENS

_WIDEST = max(map(len, TOKENS))
_ORDERED = sorted(TOKENS, key=lambda t: (-len(t), t))
_T = "|".join(_ORDERED)
#: A token, or one whose first letter (not n) is written twice.
_Q = rf"(?:{_T})|(?<d>[^n])(?=\k<d>)(?:{_T})"


def _token_at(text: str, at: int) -> tuple[int, str] | None:
    for n in range(_WIDEST, 0, -1):
        if len(text) >= at + n and (unit := TOKENS.get(text[at : at + n])):
            return n, unit
    if text[at] != "n" and text[at + 1 : at + 2] == text[at]:
        for n in range(_WIDEST, 0, -1):
            if len(text) >= at + 1 + n and (unit := TOKENS.get(text[at + 1 : at + 1 + n])):
                return n + 1, unit[0] + unit
    return None


def decode(query: str) -> list[str]:
    """The units a query spells, up to the first place that spells none."""
    text, at, out = query.lower(), 0, []
    while at < len(text) and (found := _token_at(text, at)):
        at += found[0]
        out.append(found[1])
    return out


def decode_column(query: Column) -> Column:
    """``decode`` of a column; null gives null."""
    lead = F.regexp_extract(F.lower(query), f"^((?:{_Q})*)", 1)
    tokens = F.regexp_extract_all(lead, F.lit(f"({_Q})"), F.lit(1))
    known = literal_map(TOKENS)

    def unit(t):
        rest = F.try_element_at(known, F.substring(t, 2, _WIDEST))
        return F.coalesce(F.try_element_at(known, t), F.concat(F.left(rest, F.lit(1)), rest))

    return F.when(query.isNotNull(), F.transform(tokens, unit))
