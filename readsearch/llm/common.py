"""What the operators share: reading, words, batch slicing, bit tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stage import new_path, numbered, removed, shared_dir, stored  # noqa: F401  (shared with the modules here)

#: A word, and a run between words, as regular expressions that Java, RE2 and Python read alike.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text; none if it is null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def pieces(batches: Iterator, limit: int = 8 << 20) -> Iterator:
    """Record batches cut by rows so that each holds about ``limit`` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        each = max(1, int(batch.num_rows * limit / max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, each):
            yield batch.slice(at, each)


def text_hash(text: Column) -> Column:
    """Tells rows of one id apart; null has a value of its own."""
    return F.xxhash64(text)


def keep_rows(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str, repeated: bool) -> DataFrame:
    """The rows of ``docs``, whole, whose id and text hash are in ``keys``
    (keep_id, keep_th); null ids match null.  With ``repeated`` rows alike in
    both are kept once."""
    names = docs.columns
    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_doc"), F.col(id_col).cast("long").alias("_id"), text_hash(F.col(text_col)).alias("_th"))
    kept = boxed.join(keys, F.col("_id").eqNullSafe(F.col("keep_id")) & (F.col("_th") == F.col("keep_th")), "left_semi")
    if repeated:
        kept = kept.dropDuplicates(["_id", "_th"])
    return kept.select(*[F.col("_doc")[c].alias(c) for c in names])


#: Bits of the tables below: 2^18 rows at most, whatever the corpus.
SLOT_BITS = 24


def slots(hashes: DataFrame) -> DataFrame:
    """A bit table (word, bits) of the longs in ``hashes`` (h): a filter of fixed
    size that is safe to broadcast.  It lets every member through and, the fuller
    it is, more of the others."""
    slot = hashes.select(F.pmod("h", F.lit(1 << SLOT_BITS)).alias("s"))
    return slot.groupBy(F.shiftright("s", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(s & 63 AS int)))").alias("bits"))


def marked(rows: DataFrame, hashed: Column, table_: DataFrame, name: str) -> DataFrame:
    """``rows`` with a boolean: whether the table may hold the row's hash."""
    slot = rows.withColumn("_slot", F.pmod(hashed, F.lit(1 << SLOT_BITS)))
    both = slot.join(F.broadcast(table_.withColumnsRenamed({"word": "_word", "bits": "_bits"})), F.shiftright("_slot", 6) == F.col("_word"), "left")
    hit = F.expr("coalesce(_bits & shiftleft(1L, cast(_slot & 63 AS int)), 0) <> 0")
    return both.withColumn(name, hit).drop("_slot", "_word", "_bits")


def bit_table(hashes: DataFrame, bits: int) -> np.ndarray:
    """A bit table of the longs in ``hashes`` (h) for numpy: 2^bits bits, whatever
    the corpus, of which at most 2^bits / 64 words come to the driver."""
    bits = max(bits, 6)
    slot = F.shiftrightunsigned("h", 64 - bits)
    bit = F.expr("bit_or(shiftleft(1L, cast(slot & 63 AS int)))")
    got = hashes.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(bit.alias("bits")).toArrow()
    out = np.zeros(1 << bits >> 6, dtype=np.uint64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return out


def has(table_: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the unsigned hashes the bit table may hold."""
    slot = hashes >> np.uint64(64 - (len(table_) * 64).bit_length() + 1)
    return (table_[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def worker_state() -> dict:
    """What a Python worker keeps from task to task; functions are shipped by
    value, so their own modules' variables do not last."""
    import sys
    import types

    return sys.modules.setdefault("_worker_state", types.ModuleType("_worker_state")).__dict__
