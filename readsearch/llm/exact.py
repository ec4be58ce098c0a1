"""Exact duplicates by composable polynomial fingerprints.

A text's bytes are the digits of a polynomial at a fixed point modulo two
primes.  Chunks are hashed apart and combined by shifting: H(ab) = H(a) *
B^len(b) + H(b), so any cutting of a document gives the same fingerprint.
Documents over ``PART`` bytes are cut into parts that are hashed wherever they
lie; only remainders meet.  Rows whose fingerprints meet are then compared part
by part, chunkwise as they stream by, so no task holds two whole texts and a
collision never merges them.  Copies of a hot text are folded in two steps, by
salted key first, so none of its parts gathers in one task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, keep_rows, marked, pieces, slots, stored, table, text_hash

CHUNK = 1 << 16
#: Bytes of the parts in which longer documents are hashed, and all texts compared.
PART = 1 << 20
#: Groups of more rows are folded by salted key before their copies meet.
HOT, SALTS = 64, 64
#: Two primes below 2^31 and a base for each (fixed values of the fingerprint).
MODULI, BASES = (2147483647, 2147483629), (1000003, 998244353)

Print = tuple[int, int, int]  # the two remainders and the length in bytes


_POWERS: dict[int, np.ndarray] = {}


def _powers(k: int) -> np.ndarray:
    if k not in _POWERS:
        out, p, b, x = np.empty(CHUNK, dtype=np.int64), MODULI[k], BASES[k], 1
        for i in range(CHUNK - 1, -1, -1):
            out[i] = x
            x = x * b % p
        _POWERS[k] = out
    return _POWERS[k]


def chunk_print(data: bytes) -> Print:
    """The fingerprint of up to ``CHUNK`` bytes; a digit is a byte plus one, so leading zero bytes count."""
    x = np.frombuffer(data, dtype=np.uint8).astype(np.int64) + 1
    return tuple(int(x @ _powers(k)[CHUNK - len(x) :]) % MODULI[k] for k in (0, 1)) + (len(x),)


def combine(a: Print, b: Print) -> Print:
    """The fingerprint of a text from those of its two parts."""
    return tuple((a[k] * pow(BASES[k], b[2], MODULI[k]) + b[k]) % MODULI[k] for k in (0, 1)) + (a[2] + b[2],)


def text_print(data: bytes, chunk: int = CHUNK) -> Print:
    out: Print = (0, 0, 0)
    for at in range(0, len(data), chunk):
        out = combine(out, chunk_print(data[at : at + chunk]))
    return out


def same(a: bytes, b: bytes) -> bool:
    """Chunkwise comparison that ends at the first difference."""
    if len(a) != len(b):
        return False
    x, y = memoryview(a), memoryview(b)
    return all(x[i : i + CHUNK] == y[i : i + CHUNK] for i in range(0, len(a), CHUNK))


def _normal(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACE, " ")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_hash(F.col(text_col)).alias("th"), F.encode(text, "utf-8").alias("t"))


def _parted(rows: DataFrame, t: str, size: int) -> DataFrame:
    """``rows`` with (part_no, data) in place of the binary ``t``."""
    cut = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.octet_length(t) - 1, F.lit(0)) / size).cast("int")), lambda i: F.struct(i.cast("long").alias("part_no"), F.substring(F.col(t), i * size + 1, size).alias("data")))
    return rows.withColumn("_p", F.explode(cut)).drop(t).select("*", "_p.part_no", "_p.data").drop("_p")


def _prints(batches):
    for b in pieces(batches):
        texts = b.column(2).to_pylist()
        p = np.array([text_print(t) for t in texts], dtype=np.int64).reshape(-1, 3)
        sha = pa.array([hashlib.sha256(t).hexdigest() for t in texts])
        yield pa.record_batch([b.column(0), b.column(1), sha, pa.array(p[:, 0] << 31 | p[:, 1]), pa.array(p[:, 2])], ["doc_id", "th", "sha", "fp", "n_bytes"])


def part_prints(parts: DataFrame) -> DataFrame:
    """(the other columns, fp, n_bytes) of documents that lie in parts (part_no,
    data binary, and columns that together name a document): each part is hashed
    where it lies, and only remainders meet.  Null data counts as empty."""
    named = [c for c in parts.columns if c not in ("part_no", "data")]

    def run(batches):
        for b in pieces(batches):
            p = [text_print(t or b"") for t in b.column(len(named) + 1).to_pylist()]
            cols = [[x[0] for x in p], [x[1] for x in p], [pow(BASES[0], x[2], MODULI[0]) for x in p], [pow(BASES[1], x[2], MODULI[1]) for x in p], [x[2] for x in p]]
            yield pa.record_batch([*b.columns[: len(named) + 1], *(pa.array(c, pa.int64()) for c in cols)], [*named, "part_no", "h0", "h1", "s0", "s1", "n"])

    given = parts.select(*named, F.col("part_no").cast("long"), "data")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in given.schema if f.name != "data")
    prints = given.mapInArrow(run, f"{kinds}, h0 long, h1 long, s0 long, s1 long, n long")
    whole = prints.groupBy(*named).agg(F.sort_array(F.collect_list(F.struct("part_no", "h0", "h1", "s0", "s1", "n"))).alias("p"))
    zero = F.struct(*[F.lit(0).cast("long").alias(c) for c in ("a", "b", "n")])
    fold = F.aggregate("p", zero, lambda x, y: F.struct(((x["a"] * y["s0"] + y["h0"]) % MODULI[0]).alias("a"), ((x["b"] * y["s1"] + y["h1"]) % MODULI[1]).alias("b"), (x["n"] + y["n"]).alias("n")))
    return whole.select(*named, fold.alias("f")).select(*named, F.shiftleft("f.a", 31).bitwiseOR(F.col("f.b")).alias("fp"), F.col("f.n").alias("n_bytes"))


def _fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, th, sha, fp, n_bytes, row): a row per row; texts over ``PART`` bytes are hashed in parts."""
    size = F.coalesce(F.octet_length(text_col), F.lit(0))
    short = _normal(docs.where(size <= PART), id_col, text_col).mapInArrow(_prints, "doc_id long, th long, sha string, fp long, n_bytes long")
    long = _normal(docs.where(size > PART), id_col, text_col).select("doc_id", "th", F.sha2("t", 256).alias("sha"), F.monotonically_increasing_id().alias("at"), "t")
    parts = _parted(long, "t", PART).repartition("at", "part_no")
    return stored(short.unionByName(part_prints(parts).drop("at")).withColumn("row", F.monotonically_increasing_id()))


def _folded(part: int):
    """Parts of each text once per piece of a batch, so that a hot text does not travel once per copy."""

    def run(batches):
        for b in pieces(batches):
            rows = []
            for t in dict.fromkeys(b.column(0).to_pylist()):
                a, c, n = text_print(t)
                rows += [(a << 31 | c, n, i // part, t[i : i + part]) for i in range(0, max(n, 1), part)]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["fp", "n_bytes", "part_no", "data"])

    return run


def _compared(batches):
    """Streams parts sorted by place; yields each part whose copies are salted once,
    for a second round, and the places at which others hold two different parts."""
    at, held, out, size = None, [], [], 0

    def done():
        if at is None:
            return []
        if at[3] >= 0:
            return [(*at[:3], False, x) for x in held]
        return [(*at[:3], True, b"")] if len(held) > 1 else []

    def batch(rows):
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()))], ["fp", "n_bytes", "part_no", "clash", "data"])

    for b in batches:
        for *key, data in zip(*(c.to_pylist() for c in b.columns)):
            if key != at:
                out += (more := done())
                size += sum(len(x[4]) for x in more) + 40 * len(more)
                at, held = key, [data]
                if size > 8 << 20:
                    yield batch(out)
                    out, size = [], 0
            elif not any(same(data, x) for x in held):
                held.append(data)
    out += done()
    if out:
        yield batch(out)


def _clashes(normal: DataFrame, met: DataFrame) -> DataFrame:
    """(fp, n_bytes) of the fingerprints in ``met`` that stand for two texts or more."""
    key, kinds = F.xxhash64("fp", "n_bytes"), "fp long, n_bytes long, part_no long, clash boolean, data binary"
    place = ["fp", "n_bytes", "part_no", "salt"]
    parts = normal.select("t").mapInArrow(_folded(PART), "fp long, n_bytes long, part_no long, data binary")
    found = marked(parts, key, slots(met.select(key.alias("h"))), "met").where("met")
    found = marked(found, key, slots(met.where(F.col("n") > HOT).select(key.alias("h"))), "hot")
    salted = found.select("fp", "n_bytes", "part_no", F.when(F.col("hot"), F.pmod(F.spark_partition_id(), F.lit(SALTS))).otherwise(-1).alias("salt"), "data")
    dealt = lambda x: x.repartition(*place).sortWithinPartitions(*place).mapInArrow(_compared, kinds)
    first = stored(dealt(salted))
    second = dealt(first.where("NOT clash").select("fp", "n_bytes", "part_no", F.lit(-1).alias("salt"), "data"))
    return stored(first.where("clash").unionByName(second).select("fp", "n_bytes").distinct())


def _classes(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows with their class, and classes with the row that stays."""
    rows = _fingerprints(docs, id_col, text_col)
    met = stored(rows.groupBy("fp", "n_bytes").agg(F.count("*").alias("n")).where("n > 1"))
    clashes = _clashes(_normal(docs, id_col, text_col), met)
    if clashes.isEmpty():
        rows = rows.withColumn("part", F.lit(""))
    else:  # fingerprints that stand for several texts: their rows are told apart by digest
        several = clashes.select("fp", "n_bytes", F.lit(True).alias("clash"))
        rows = stored(rows.join(several, ["fp", "n_bytes"], "left").select(*[rows[c] for c in rows.columns], F.when(F.col("clash"), F.col("sha")).otherwise("").alias("part")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("th").alias("th"), F.col("row").alias("at")))
    return rows, stored(rows.groupBy("fp", "n_bytes", "part").agg(first.alias("first"), F.count("*").alias("group_size")))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): one row per row.

    Texts are equal when identical after each run of blanks is one space; null
    counts as empty.  The row with the smallest id stays, ids before null, and
    of rows with the same id and text exactly one.  A text may be of any length
    that a cell holds; no rows give none.  Other columns of ``docs`` are never read.
    """
    rows, groups = _classes(docs, id_col, text_col)
    return rows.join(groups, ["fp", "n_bytes", "part"]).select(
        "doc_id", F.col("first.id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.at")).alias("kept"), F.col("sha").alias("text_sha256")
    )


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, whole, with all their columns, whatever their names.
    Null and empty texts are one group; ties, repeated rows, null ids and very
    long texts are as in ``exact_duplicates``; no rows give none."""
    rows, groups = _classes(docs, id_col, text_col)
    keys = stored(groups.select(F.col("first.id").alias("keep_id"), F.col("first.th").alias("keep_th")))
    repeated = not rows.groupBy("doc_id", "th").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    return keep_rows(docs, keys, id_col, text_col, repeated)


def op3_exact(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""
