"""Path completion: kind filter, ranking, top-N, formatting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.match import matched
from ..functions.text import format_candidate
from .index import with_index
from .rank import ranked

KINDS, LIMIT = ("dir", "file", "any"), 50


def by_kind(listing: DataFrame, kind: str) -> DataFrame:
    if kind not in KINDS:
        raise ValueError(f"kind is one of {KINDS}")
    return listing if kind == "any" else listing.where(F.col("is_dir") if kind == "dir" else ~F.col("is_dir"))


def candidates(listing: DataFrame, leaf: str, kind: str = "any", dictionary: DataFrame | None = None, prefix: str = "", limit: int | None = LIMIT) -> DataFrame:
    """(rank, name, is_dir, candidate) of ``listing`` (name, is_dir).

    The kind is filtered before anything is read.  An empty leaf gives every
    name in byte order; else matches come by score, then name.
    """
    rows = by_kind(listing, kind)
    if leaf:
        rows = with_index(rows, "name", "name", dictionary)
        rows = rows.withColumn("score", matched(F.col("name"), F.col("morae"), leaf)["score"]).where("score IS NOT NULL")
        order = [F.desc("score"), F.asc("name")]
    else:
        order = [F.asc("name")]
    out = ranked(rows, order, limit)
    return out.select("rank", "name", "is_dir", format_candidate(F.lit(prefix), F.col("name"), F.col("is_dir")).alias("candidate"))
