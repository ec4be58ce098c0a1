"""Searches: both matchers, their fusion with use counts, orders and limits.

``entries`` are rows (entry_id, type, title, url, command, args, access_count)
with the index columns ``morae`` and ``segments`` where units are matched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fuzzy import best, fuzzy_positions, fuzzy_score
from ..functions.match import matched, score
from ..functions.query import decode_column
from ..functions.text import secondary_text
from .stage import fixed, numbered, stored

MODES, SORTS = ("fuzzy", "reading", "combined"), ("by_score", "by_count")


def fuzzy_best(query: str) -> Column:
    """The better fuzzy score of title and secondary text; null if neither matches."""
    second = secondary_text(F.col("type"), F.col("url"), F.col("command"))
    return best(fuzzy_score(fuzzy_positions(F.col("title"), query)), fuzzy_score(fuzzy_positions(second, query)))


def ranked(rows: DataFrame, order: list[Column], limit: int | None) -> DataFrame:
    """``rows`` with their rank from 1.  With a limit only the first rows are
    ever sorted together; without one, the sorted rows are written once and
    ranks are places in that table."""
    if limit is not None:
        return rows.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))
    return numbered(rows, order)


def _result(rows: DataFrame, score: Column, order: list[Column], limit: int | None) -> DataFrame:
    return ranked(rows.withColumn("score", score.cast("long")), order, limit).select("rank", "entry_id", "score", "access_count")


def _by(*names: str) -> list[Column]:
    """Order by these, greatest first, and by id."""
    return [*map(F.desc, names), F.asc("entry_id")]


def all_by_count(entries: DataFrame, limit: int | None = None) -> DataFrame:
    """What an empty query gives: every entry with score 0, most used first."""
    return _result(entries, F.lit(0), _by("access_count"), limit)


def fuzzy_search(entries: DataFrame, query: str, sort: str = "by_score", limit: int | None = None) -> DataFrame:
    if not query:
        return all_by_count(entries, limit)
    hits = fixed(entries.select("entry_id", "access_count", fuzzy_best(query).alias("_f")), "_f").where("_f IS NOT NULL")
    return _result(hits, F.col("_f"), _by("score", "access_count") if sort == "by_score" else _by("access_count", "score"), limit)


def reading_search(entries: DataFrame, query: str, limit: int | None = None, indexed: bool = True) -> DataFrame:
    """Entries whose title matches by units or substring, most used first, score 0.  Without an index nothing matches."""
    if not query:
        return all_by_count(entries, limit)
    hit = matched(F.col("title"), F.col("morae"), query).isNotNull() if indexed else F.lit(False)
    return _result(entries.where(hit), F.lit(0), _by("access_count"), limit)


def combined_search(entries: DataFrame, query: str, limit: int | None = None, indexed: bool = True) -> DataFrame:
    """Entries that either matcher finds.  Each signal, use count included, is
    divided by its greatest value among them, and the sum is given in millionths.
    The hits with their scores are written once, for the maxima and for the ranks."""
    if not query:
        return all_by_count(entries, limit)
    reading = matched(F.col("title"), F.col("morae"), query)["score"] if indexed else F.lit(None).cast("long")
    scored = fixed(entries.select("entry_id", "access_count", fuzzy_best(query).alias("_f"), reading.alias("_r")), "_f", "_r")
    both = stored(scored.where("_f IS NOT NULL OR _r IS NOT NULL"))
    least = lambda c: F.greatest(F.coalesce(F.max(F.greatest(F.col(c), F.lit(0))), F.lit(1)), F.lit(1))
    tops = both.agg(F.struct(least("_f").alias("f"), least("_r").alias("r"), least("access_count").alias("a")).alias("m")).scalar()
    share = lambda c, k: F.coalesce(F.greatest(F.col(c), F.lit(0)).cast("double") / F.col("_m")[k], F.lit(0.0))
    fused = F.round((share("_f", "f") + share("_r", "r") + share("access_count", "a")) * 1e6)
    return _result(both.withColumn("_m", tops), fused, _by("score", "access_count"), limit)


def search(entries: DataFrame, query: str, mode: str = "combined", sort: str = "by_score", limit: int | None = None, indexed: bool = True) -> DataFrame:
    """(rank, entry_id, score, access_count) of a query in a mode."""
    if mode not in MODES or sort not in SORTS:
        raise ValueError(f"mode is one of {MODES}, sort one of {SORTS}")
    if mode == "fuzzy":
        return fuzzy_search(entries, query, sort, limit)
    if mode == "reading":
        return reading_search(entries, query, limit, indexed)
    return combined_search(entries, query, limit, indexed)


def hits(entries: DataFrame, ranks: DataFrame) -> DataFrame:
    """Ranks with their entries; ranks of entries that are gone are dropped."""
    return ranks.drop("access_count").join(entries, "entry_id")


def index_search(items: DataFrame, query: str, id_col: str, text_col: str) -> DataFrame:
    """(id, path, start, score) of the items that match; nothing for an empty query."""
    found = fixed(items.select(F.col(id_col), matched(F.col(text_col), F.col("morae"), query).alias("m")), "m")
    return found.where("m IS NOT NULL").select(id_col, "m.path", "m.start", "m.score")


def batch_search(items: DataFrame, queries: list[str], id_col: str, text_col: str) -> DataFrame:
    """(query, id, path, start, score) for a short list of queries in one pass over the items."""
    if not queries:
        queries, items = [""], items.limit(0)
    found = F.array(*[F.struct(F.lit(q).alias("query"), matched(F.col(text_col), F.col("morae"), q).alias("m")) for q in queries])
    out = fixed(items.select(F.col(id_col), found.alias("_found")), "_found").select(id_col, F.explode(F.filter("_found", lambda x: x["m"].isNotNull())).alias("x"))
    return out.select("x.query", id_col, "x.m.path", "x.m.start", "x.m.score")


def table_search(items: DataFrame, queries: DataFrame, id_col: str, text_col: str, query_col: str = "query") -> DataFrame:
    """(query, id, path, start, score) for a table of queries of any size.

    Items and queries meet by equality: an item gives its windows of sound units,
    and its substrings, in the lengths that queries have, each once with its first
    place.  Nothing is compared pair by pair.  Null and empty queries match
    nothing, repeated ones count once, ids must be unique; null texts are empty.
    """
    asked = queries.select(F.col(query_col).alias("query")).where("query <> ''").distinct()
    asked = fixed(asked.select("query", decode_column(F.col("query")).alias("_u"), F.lower("query").alias("_q")), "_u", "_q")
    asked = stored(asked.select("query", F.size("_u").alias("_n"), F.array_join("_u", " ").alias("_units"), "_q", F.length("query").alias("_len")))
    sizes = lambda e: asked.where(f"{e} > 0").agg(F.collect_set(F.expr(e))).scalar()  # noqa: E731  (as many as there are lengths)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = items.select(F.col(id_col).alias("_id"), F.col("morae").alias("_m"), F.lower(text).alias("_t"), F.length(text).alias("_length"))
    rows = rows.withColumn("_sizes", sizes("_n")).withColumn("_lengths", sizes("length(_q)"))

    def parts(wanted: str, total: Column, cut) -> Column:
        """Every part of a wanted length, as struct(n, s, at)."""
        of = lambda n: F.transform(F.when(total >= n, F.sequence(F.lit(1), total - n + 1)).otherwise(F.array().cast("array<int>")), lambda at: F.struct(n.alias("n"), cut(at, n).alias("s"), at.alias("at")))
        return F.explode(F.flatten(F.transform(wanted, of)))

    windows = rows.select("_id", F.size("_m").alias("_total"), parts("_sizes", F.size("_m"), lambda at, n: F.array_join(F.slice("_m", at, n), " ")).alias("p"))
    strings = rows.select("_id", F.col("_length").alias("_total"), parts("_lengths", F.length("_t"), lambda at, n: F.substring(F.col("_t"), at, n)).alias("p"))
    first = lambda x: x.groupBy("_id", "_total", F.col("p.n").alias("_n"), F.col("p.s").alias("_s")).agg((F.min("p.at") - 1).alias("start"))
    by_unit = first(windows).join(asked.where("_n > 0").select("query", "_n", F.col("_units").alias("_s")), ["_n", "_s"])
    by_text = first(strings).drop("_n").join(asked.select("query", "_len", F.col("_q").alias("_s")), "_s")
    found = by_unit.select("query", "_id", F.lit("mora").alias("path"), "start", score(F.col("_n"), F.col("start"), F.col("_total")).alias("score"))
    found = found.unionByName(by_text.select("query", "_id", F.lit("plain").alias("path"), "start", score(F.col("_len"), F.col("start"), F.col("_total")).alias("score")))
    best = found.groupBy("query", "_id").agg(F.min(F.struct("path", "start", "score")).alias("m"))  # "mora" before "plain"
    return best.select("query", F.col("_id").alias(id_col), "m.path", "m.start", "m.score")
