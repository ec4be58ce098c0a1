"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws an exponential key, scaled by its quality weight.  A
source's target is met by complete passes over it, then by its documents in key
order until the rest of the budget is used.  Where that order is cut is found
without sorting a source in one place: sizes are summed by key range, the range
with the cut is split again, and only the rows of that small range are sorted.
A source's plan (passes, and the key, id and words of its cut) is one row; with
it every document's share follows from the document alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, stored, table, words

WEIGHTS, EPOCHS, SEED = (5, 2, 1), 3, "mix"
SPLIT = 512  # key ranges of a level
#: Plans of up to this many sources are broadcast, larger ones are joined by shuffle.
BROADCAST_SOURCES = 20_000


def quality_weight(text: Column, size: Column) -> Column:
    """1 for plain text, towards 0 the more of it is symbols."""
    symbols = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^#*$%&|<>]+", ""))
    return F.when(size > 0, size.cast("double") / (size + 10 * symbols).cast("double")).otherwise(F.lit(1.0))


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> dict[str, Column]:
    """Columns that follow from a document alone, in the order they build on each other."""
    size = F.size(words(F.col(text_col))).cast("long")
    named = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), named)), 1, 13), 16, 10).cast("double")
    return {
        "_sk": F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("n")),
        "_size": size,
        "_k": -F.log((draw + F.lit(0.5)) / F.lit(float(1 << 52))) / quality_weight(F.col(text_col), F.col("_size")),
        "_id": F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)),
        "_tie": F.xxhash64(F.col(text_col)),
        "_bin": F.least(F.floor((1 - 1 / (1 + F.col("_k"))) * (SPLIT * SPLIT)), F.lit(SPLIT * SPLIT - 1)).cast("int"),
    }


def targets(sources: DataFrame, weights=WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(_sk, source_size, target) from (_sk, source_size): the total is shared
    by weight; no source gets over ``epochs`` times its size, what it leaves is
    shared again by weight.  Sources in code point order, null last.

    The level to which all sources are filled rises until no further source is
    full; each step is a sum over the stored sources, however many they are."""
    w = F.element_at(F.array(*[F.lit(x).cast("long") for x in weights]), ((F.col("_r") - 1) % len(weights) + 1).cast("int"))
    ranked = numbered(sources, [(F.col("_sk") == "n").asc(), F.asc("_sk")], "_r")
    cap, wide = F.lit(epochs) * F.col("source_size"), lambda c: c.cast("decimal(19,0)")
    shared = stored(ranked.select("_sk", "source_size", w.alias("_w"), cap.alias("_cap")))
    sums = lambda rows: [int(x or 0) for x in rows.agg(F.sum("source_size"), F.sum("_w"), F.sum("_cap"), F.count("*")).first()]
    total, all_w, _, _ = sums(shared)
    left, open_w, n_full = total, all_w, -1
    while True:
        full = wide(F.col("_cap")) * wide(F.lit(open_w)) <= wide(F.col("_w")) * wide(F.lit(left))
        _, full_w, full_cap, n = sums(shared.where(full))
        if n == n_full:  # the sources from which left and open_w come
            break
        n_full, left, open_w = n, total - full_cap, all_w - full_w
    share = (F.col("_w") * F.lit(left)).cast("double") / F.lit(float(open_w or 1))
    return shared.select("_sk", "source_size", F.when(full, F.col("_cap").cast("double")).otherwise(share).alias("target"))


def _cut(rows: DataFrame, plan: DataFrame, order: list[str]) -> DataFrame:
    """The group of ``rows`` (_sk, *order, n words) in which each source's rest ends, and the words before it."""
    upto = Window.partitionBy("_sk").orderBy(*order)
    sums = rows.join(plan.select("_sk", "_rest"), "_sk").withColumn("_upto", F.sum("_n").over(upto.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return sums.where("_upto >= _rest AND _upto - _n < _rest").withColumn("_rest", F.col("_rest") - (F.col("_upto") - F.col("_n"))).drop("_upto")


def _small(plan: DataFrame, n: int) -> DataFrame:
    return F.broadcast(plan) if n <= BROADCAST_SOURCES else plan


def plan(rows: DataFrame, weights=WEIGHTS, epochs: int = EPOCHS) -> tuple[DataFrame, int]:
    """A row per source: target, complete passes, and the cut of the last, partial pass."""
    aimed = stored(targets(rows.groupBy("_sk").agg(F.sum("_size").alias("source_size")), weights, epochs))
    n = aimed.count()
    passes = F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(0).cast("long")
    budget = aimed.withColumn("_passes", passes).withColumn("_rest", (F.floor("target") - F.col("_passes") * F.col("source_size")).cast("long"))
    todo = budget.where("_rest > 0").select("_sk", "_rest")
    some = rows.where("_size > 0")
    one = some.groupBy("_sk", F.floor(F.col("_bin") / SPLIT).alias("_b")).agg(F.sum("_size").alias("_n"))
    one = stored(_cut(one, todo, ["_b"]))
    inside = some.join(_small(one.select("_sk", "_b"), n), "_sk").where(F.floor(F.col("_bin") / SPLIT) == F.col("_b"))
    two = stored(_cut(inside.groupBy("_sk", "_bin").agg(F.sum("_size").alias("_n")), one, ["_bin"]))
    inside = some.join(_small(two.select("_sk", F.col("_bin").alias("_b")), n), "_sk").where("_bin = _b")
    last = _cut(inside.groupBy("_sk", "_k", "_id", "_tie").agg(F.sum("_size").alias("_n"), F.count("*").alias("_m")), two, ["_k", "_id", "_tie"])
    # Rows alike in id and text share the last words evenly.
    cut = last.select("_sk", F.struct(F.col("_k").alias("k"), F.col("_id").alias("id"), F.col("_tie").alias("tie")).alias("_cut"), F.floor(F.col("_rest") / F.col("_m")).cast("long").alias("_partial"))
    return stored(budget.drop("_rest").join(cut, "_sk", "left")), n


def _taken() -> Column:
    mine = F.struct(F.col("_k").alias("k"), F.col("_id").alias("id"), F.col("_tie").alias("tie"))
    extra = F.when(F.col("_cut").isNull(), 0).when(mine < F.col("_cut"), F.col("_size")).when(mine == F.col("_cut"), F.least("_partial", "_size")).otherwise(0)
    return (F.col("_size") * F.col("_passes") + F.coalesce(extra, F.lit(0))).cast("long")


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken): one row per row.

    Null and empty texts have size 0 and nothing taken; a null source is a
    source of its own, in last place; rows without an id draw by their text, ties
    are broken by id and text, and rows alike in both share what is left at the
    cut.  Texts may be of any length that a cell holds.  No rows: no sources.  Other columns of ``docs`` are never read.
    """
    cols = _keyed(docs, id_col, text_col, source_col, seed)
    rows = docs.select(F.col(id_col), F.col(text_col), F.col(source_col))
    for name, col in cols.items():
        rows = rows.withColumn(name, col)
    rows = stored(rows.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), *cols))
    by_source, n = plan(rows, weights, epochs)
    return rows.join(_small(by_source, n), "_sk").select("doc_id", "source", F.col("_size").alias("size"), "source_size", "target", _taken().alias("taken"))


def materialize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """The mixture itself, with the columns of ``docs``: a row for each pass over
    a document, the last one cut after the words that are still wanted.

    What is taken is as in ``mixture``, null sources, null ids, ties and repeated
    rows included; rows of which nothing is taken, null and empty texts among
    them, give no row.  No rows: none.  Other columns, whatever their names, are
    passed on."""
    names = docs.columns
    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_doc"), F.col(id_col).alias("_i"), F.col(text_col).alias("_text"), F.col(source_col).alias("_source"))
    cols = _keyed(boxed, "_i", "_text", "_source", seed)
    for name, col in cols.items():
        boxed = boxed.withColumn(name, col)
    by_source, n = plan(stored(boxed.select(*cols)), weights, epochs)
    taken = boxed.join(_small(by_source, n), "_sk").withColumn("_taken", _taken()).where("_taken > 0")
    copies = taken.withColumn("_p", F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("_taken") / F.col("_size")))))
    left = F.col("_taken") - (F.col("_p") - 1) * F.col("_size")
    text = F.when(left >= F.col("_size"), F.col("_text")).otherwise(F.array_join(F.slice(words(F.col("_text")), F.lit(1), left.cast("int")), " "))
    return copies.withColumn("_cut_text", text).select(*[(F.col("_cut_text") if c == text_col else F.col("_doc")[c]).alias(c) for c in names])


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]+', '', 'g')) AS sym
  FROM documents),
k AS (
  SELECT doc_id, source, CAST(size AS BIGINT) AS size,
         -ln((CAST(CAST('0x' || md5('mix:' || doc_id)[1:13] AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0)
         / (CASE WHEN size > 0 THEN CAST(size AS DOUBLE) / CAST(size + 10 * sym AS DOUBLE) ELSE 1.0 END) AS k
  FROM d),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, ([5, 2, 1])[CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)] AS w
  FROM k GROUP BY source),
f AS (
  SELECT *, sum(source_size) OVER () AS t,
         3 * source_size * sum(w) OVER (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
         <= w * (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS filled
  FROM s),
g AS (
  SELECT source, source_size,
         CASE WHEN filled THEN CAST(3 * source_size AS DOUBLE)
              ELSE CAST(w * (t - sum(CASE WHEN filled THEN 3 * source_size ELSE 0 END) OVER ()) AS DOUBLE)
                   / CAST(sum(CASE WHEN filled THEN 0 ELSE w END) OVER () AS DOUBLE) END AS target
  FROM f),
h AS (
  SELECT k.doc_id, size, source_size, target,
         CASE WHEN source_size > 0 THEN CAST(floor(floor(target) / source_size) AS BIGINT) ELSE 0 END AS passes,
         sum(size) OVER (PARTITION BY k.source ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before
  FROM k JOIN g ON k.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       CAST(size * passes + greatest(0, least(size, CAST(floor(target) AS BIGINT) - passes * source_size - before)) AS BIGINT) AS taken
FROM h
"""
