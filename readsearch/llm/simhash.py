"""SimHash near-duplicates through pivot distance tables.

A fingerprint's Hamming distances to fixed reference fingerprints (pivots) are
its coordinates.  Distance is a metric, so two fingerprints at distance d differ
by d at most in every coordinate; and as it adds up over blocks of bits, of b
blocks at least b - 3 must have no difference when d is 3 at most, which makes all
coordinates restricted to those blocks equal.  So:

1. for each choice of b - 3 blocks the vector of restricted coordinates is a join
   key; only distinct fingerprints take part, so exact copies cost one row.  The
   more fingerprints, the more blocks, and so bits in a key: buckets stay small;
2. within a bucket, pairs whose coordinates differ by more than 3 anywhere are
   discarded, the others are verified bit by bit;
3. a bucket yields the edges of a spanning forest, never all of its pairs.
   Buckets over ``CHUNK`` are dealt as pairs of chunks, so no task holds one.

Nothing is capped and no pair within reach is lost.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_rows, pieces, stored, text_hash
from .components import roots

BITS, REACH, PIVOTS, CHUNK, SHINGLE = 64, 3, 32, 256, 3
#: Blocks, and the fingerprints up to which they do; keys have 25, 32, 36 and 40 bits.  Links are the same with any.
BLOCKS = {5: 1 << 26, 6: 1 << 33, 7: 1 << 37, 8: 1 << 64}
_GOLD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pivots(n: int = PIVOTS) -> np.ndarray:
    """The reference fingerprints: a fixed pseudo-random sequence."""
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * _GOLD)


def masks(blocks: int) -> np.ndarray:
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    return np.array([sum(1 << b for b in range(x, y)) for x, y in zip(edges, edges[1:])], dtype=np.uint64)


def distances(fps: np.ndarray, mask: np.uint64 = np.uint64(2**64 - 1), n: int = PIVOTS) -> np.ndarray:
    """(fingerprints, pivots) table of Hamming distances within ``mask``."""
    return np.bitwise_count((fps[:, None] ^ pivots(n)[None, :]) & mask)


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of a text in UTF-8.  A-Z count as a-z; no words: zero."""
    parts = (text or b"").lower().split()
    if not parts:
        return 0
    grams = map(b" ".join, zip(*(parts[i:] for i in range(shingle)))) if len(parts) >= shingle else iter([b" ".join(parts)])
    total, counts = max(1, len(parts) - shingle + 1), np.zeros(BITS, dtype=np.int64)
    for at in range(0, total, 1 << 15):
        n = min(1 << 15, total - at)
        h = np.fromiter((xxhash.xxh64_intdigest(next(grams), 42) for _ in range(n)), dtype="<u8", count=n)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, th, fp long): one row per row, th the text's hash; a null text counts as empty (zero)."""

    def run(batches):
        for b in pieces(batches):
            fps = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], dtype=np.uint64)
            yield pa.record_batch([b.column(0), b.column(2), pa.array(fps.view(np.int64))], ["doc_id", "th", "fp"])

    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(F.col(text_col), "utf-8").alias("t"), text_hash(F.col(text_col)).alias("th"))
    return ids.mapInArrow(run, "doc_id long, th long, fp long")


def bucket_keys(fps: DataFrame, blocks: int) -> DataFrame:
    """(key, fp): a row per choice of blocks; the key stands for the coordinates."""
    chosen = list(combinations(range(blocks), blocks - REACH))

    def run(batches):
        for b in batches:
            x = b.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(x), 1 << 14):
                part = x[at : at + (1 << 14)]
                codes = []
                for m in masks(blocks):
                    code = np.zeros(len(part), dtype=np.uint64)
                    for lane in np.ascontiguousarray(distances(part, m)).view(np.uint64).T:
                        code = _mix(code * _GOLD + lane)
                    codes.append(code)
                keys = []
                for k, some in enumerate(chosen):
                    key = np.full(len(part), k + 1, dtype=np.uint64)
                    for i in some:
                        key = _mix(key * _GOLD + codes[i])
                    keys.append(key)
                yield pa.record_batch([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.tile(part, len(chosen)).view(np.int64))], ["key", "fp"])

    return fps.select("fp").mapInArrow(run, "key long, fp long")


def _forest(x: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links within a bucket: each found
    fingerprint is compared with those not yet found only."""
    table, left, edges = distances(x).astype(np.int8), np.arange(len(x)), []
    while len(left):
        stack, left = [left[0]], left[1:]
        while stack and len(left):
            u = stack.pop()
            near = np.abs(table[left] - table[u]).max(axis=1) <= REACH
            near[near] = np.bitwise_count(x[left[near]] ^ x[u]) <= REACH
            found, left = left[near], left[~near]
            edges += [(u, v) for v in found]
            stack += found.tolist()
    return edges


def _links(batches):
    """Streams buckets, sorted by key, and emits their forests."""
    held: list[pa.RecordBatch] = []

    def emit(t: pa.Table):
        k = np.stack([t.column(i).to_numpy() for i in range(3)])
        x = t.column(3).to_numpy().view(np.uint64)
        starts = np.flatnonzero(np.r_[True, (k[:, 1:] != k[:, :-1]).any(axis=0)])
        ends = np.r_[starts[1:], len(x)]
        two = starts[ends - starts == 2]
        near = two[np.abs(distances(x[two]).astype(np.int8) - distances(x[two + 1]).astype(np.int8)).max(axis=1, initial=0) <= REACH] if len(two) else two
        near = near[np.bitwise_count(x[near] ^ x[near + 1]) <= REACH]
        a, b = [x[near]], [x[near + 1]]
        for s, e in zip(starts, ends):
            if e - s > 2 and (pairs := _forest(x[s:e])):
                i, j = np.array(pairs).T
                a.append(x[s:e][i])
                b.append(x[s:e][j])
        return pa.record_batch([pa.array(np.concatenate(v).view(np.int64)) for v in (a, b)], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([*held, batch])
        k = np.stack([t.column(i).to_numpy() for i in range(3)])
        cut = np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0))
        last = int(cut[-1]) + 1 if len(cut) else 0
        held = t.slice(last).to_batches()
        if last:
            yield emit(t.slice(0, last))
    if held:
        yield emit(pa.Table.from_batches(held))


def links(fps: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints that span each group of
    fingerprints reachable from one another within ``REACH`` bits."""
    n = fps.count()
    keys = bucket_keys(fps, next(b for b, most in BLOCKS.items() if n <= most))
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("s") - 1), lambda j: F.struct(F.least("c", j).alias("i"), F.greatest("c", j).alias("j"))))
    dealt = (
        keys.join(shared, "key")
        .withColumn("s", F.ceil(F.col("n") / CHUNK).cast("int"))
        .withColumn("c", F.pmod(F.xxhash64("fp"), F.col("s")).cast("int"))
        .select("key", "fp", pair.alias("p"))
        .select("key", F.col("p.i").alias("i"), F.col("p.j").alias("j"), "fp")
    )
    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "fp").mapInArrow(_links, "a long, b long")


def _classes(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> tuple[DataFrame, DataFrame]:
    """Rows with their fingerprint, and fingerprints with the row that stands for their group."""
    rows = stored(fingerprints(docs, id_col, text_col, shingle))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("th")))
    groups = stored(rows.groupBy("fp").agg(first.alias("first")))
    linked = roots(links(groups))
    rooted = stored(groups.join(linked.withColumnRenamed("node", "fp"), "fp").select("fp", "root", "first"))
    least = stored(rooted.groupBy("root").agg(F.min("first").alias("whole")))
    classes = rooted.join(least, "root").select("fp", "whole")
    return rows, stored(groups.join(classes, "fp", "left").select("fp", F.coalesce("whole", "first").alias("first")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id, fp): one row per row of ``docs``.

    component_id is the smallest doc_id reachable over links of at most
    ``REACH`` bits, the document itself included.  Null and empty texts have
    fingerprint zero and link like any other; repeated rows repeat; rows
    without an id take part and are null in doc_id (a group of such rows only
    has a null component).  Other columns of ``docs`` are never read.
    """
    rows, classes = _classes(docs, id_col, text_col, shingle)
    return rows.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.id").alias("component_id"), "fp")


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row of each group, whole: that with the smallest id, ids before null."""
    rows, classes = _classes(docs, id_col, text_col, shingle)
    keys = stored(classes.select(F.col("first.id").alias("keep_id"), F.col("first.th").alias("keep_th")).distinct())
    repeated = not rows.groupBy("doc_id", "th").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    return keep_rows(docs, keys, id_col, text_col, repeated)


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")
