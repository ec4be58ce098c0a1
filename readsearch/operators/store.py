"""A small keyed store of entries: insert if absent, count uses, delete.

Rows keep a stable id; the ordinal that an append-only list would give them is
derived when asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import page_title, title_or_domain
from .stage import numbered

SCHEMA = "entry_id long, type string, title string, url string, command string, args array<string>, access_count long"


def add_if_absent(entries: DataFrame, pages: DataFrame, bare: bool = True) -> DataFrame:
    """``entries`` and a bookmark for every address in ``pages`` (url, html) that
    no bookmark has; of pages with one address the first by content is taken.
    Null addresses are ignored.  New ids follow the greatest one, in order of address.
    ``bare`` as in ``unescape_html``."""
    fresh = pages.where("url IS NOT NULL").groupBy("url").agg(F.min(F.coalesce("html", F.lit(""))).alias("html"))
    fresh = fresh.join(entries.where("type = 'bookmark'").select("url"), "url", "left_anti")
    top = entries.agg(F.coalesce(F.max("entry_id"), F.lit(-1))).scalar()
    new = numbered(fresh, [F.asc("url")], "_place").select(
        (top + F.col("_place")).cast("long").alias("entry_id"), F.lit("bookmark").alias("type"),
        title_or_domain(page_title(F.col("html"), bare), F.col("url")).alias("title"), "url",
        F.lit(None).cast("string").alias("command"), F.lit(None).cast("array<string>").alias("args"), F.lit(0).cast("long").alias("access_count"),
    )
    return entries.select(*new.columns).unionByName(new)


def increment(entries: DataFrame, opened: DataFrame, id_col: str = "entry_id") -> DataFrame:
    """``entries`` with one use more for every row of ``opened``; unknown ids are ignored."""
    uses = opened.groupBy(F.col(id_col).alias("entry_id")).agg(F.count("*").alias("_more"))
    return entries.join(uses, "entry_id", "left").withColumn("access_count", F.col("access_count") + F.coalesce("_more", F.lit(0))).drop("_more").select(*entries.columns)


def delete(entries: DataFrame, gone: DataFrame) -> DataFrame:
    """``entries`` without those whose id is in ``gone``; unknown ids are ignored."""
    return entries.join(gone.select("entry_id"), "entry_id", "left_anti").select(*entries.columns)


def ordinals(entries: DataFrame) -> DataFrame:
    """(ordinal, entry_id): places from 0 in order of id."""
    return numbered(entries.select("entry_id"), [F.asc("entry_id")], "_place").select((F.col("_place") - 1).alias("ordinal"), "entry_id")
