"""Substring deduplication by seed and extend.

Words become 64-bit hashes.  A window of ``LENGTH`` words is seeded by its
winnowed anchor, the leftmost least hash among its runs of ``GRAM`` words: equal
windows have equal anchors at the same place, and neighbouring windows mostly
share one.  A first pass counts in how many documents each anchor lies.  Then
documents are joined on the anchors that lie in two or more: an anchor's
occurrences meet, each with the words around it, sorted by document.  Matches
are extended word by word, to the left and to the right, as far as occurrences
still agree; an extension that with its anchor reaches ``LENGTH`` words is a
repeat, and the one of the earliest document stays.  Overlapping and adjoining
repeats make up the maximal ones.

An occurrence is one row, whatever the number of its partners: no pairs are
made.  Anchors in over ``HOT`` documents would pile up in one task; for the
windows that they seed the earliest document is found by a partial aggregate,
and sent to all tasks or, if there are too many, joined, which Spark can split.  Which anchors are shared is known to all
tasks through a bit table as long as it is sparse; beyond that the places of
shared anchors are joined to their documents instead.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bit_table, has, marked, pieces, shared_dir, slots, stored, table, text_hash, words

LENGTH, GRAM, HOT = 13, 8, 4096
#: log2 of the bits of the anchor table: 16 MiB, for at most an eighth as many anchors.
TABLE_BITS = 27
#: First documents of crowded windows that are sent to all tasks, 24 bytes each.
KNOWN = 1 << 20


def _consts(seed: int, n: int) -> np.ndarray:
    x = (np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 1000)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB) | np.uint64(1)


def _run_hash(x: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The hash of each run of n hashes of ``x``."""
    if len(x) < n:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(len(x) - n + 1, dtype=np.uint64)
    for j, c in enumerate(_consts(seed, n)):
        out += x[j : j + len(out)] * c
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


def _windows(batch, length: int):
    """The flat words of a batch and the offsets of its rows; hashes of all runs of
    ``GRAM`` words; and of each window its start, row, and the place of its anchor."""
    flat = batch.column(2)
    off = flat.offsets.to_numpy()
    x = flat.values.to_numpy().view(np.uint64)[off[0] : off[-1]]
    off = (off - off[0]).astype(np.int64)
    gram = min(GRAM, length)
    runs = _run_hash(x, gram, 1)
    width = length - gram + 1
    at = np.arange(max(0, len(runs) - width + 1))
    least, place = runs[: len(at)].copy(), at.copy()
    for j in range(1, width):
        less = runs[j : j + len(at)] < least
        least[less], place[less] = runs[j : j + len(at)][less], at[less] + j
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    inside = row[at] == row[at + length - 1] if len(at) else np.zeros(0, bool)
    return x, off, runs, at[inside], row[at[inside]], place[inside]


def _anchors(length: int):
    """(anchor, n): anchors with the number of documents of the batch that hold them."""

    def run(batches):
        for b in pieces(batches):
            _, _, runs, _, row, place = _windows(b, length)
            if not len(row):
                continue
            new = np.r_[True, place[1:] != place[:-1]]
            anchor, doc = runs[place[new]], b.column(0).to_numpy()[row[new]]
            order = np.lexsort((doc, anchor))
            anchor, doc = anchor[order], doc[order]
            first = np.r_[True, anchor[1:] != anchor[:-1]]
            once = first | np.r_[True, doc[1:] != doc[:-1]]
            start = np.flatnonzero(first)
            n = np.add.reduceat(once.astype(np.int32), start)
            yield pa.record_batch([pa.array(anchor[start].view(np.int64)), pa.array(n, pa.int32())], ["anchor", "n"])

    return run


def _places(length: int):
    """(anchor, doc_id, th, place): every anchor where it lies."""

    def run(batches):
        for b in pieces(batches):
            _, off, runs, _, row, place = _windows(b, length)
            if not len(row):
                continue
            new = np.r_[True, place[1:] != place[:-1]]
            p, r = place[new], row[new]
            yield pa.record_batch([pa.array(runs[p].view(np.int64)), b.column(0).take(pa.array(r)), b.column(1).take(pa.array(r)), pa.array((p - off[r]).astype(np.int32))], ["anchor", "doc_id", "th", "place"])

    return run


def _by_table(bits, hot):
    """Which anchors are shared by few, and by many documents, by bit tables."""

    def select(batch, off, seeds, row, anchor):
        hit = has(bits.value, anchor)
        many = hit & has(hot.value, anchor) if hot is not None else np.zeros(len(hit), bool)
        return hit & ~many, many

    return select


def _by_place(batch, off, seeds, row, anchor):
    """The same by the places that the rows bring along."""
    out = []
    for c in (3, 4):
        lists, marks = batch.column(c).to_pylist(), np.zeros(off[-1] + 1, bool)
        for i, found in enumerate(lists):
            marks[off[i] + np.array(found or [], dtype=np.int64)] = True
        out.append(marks[seeds])
    return out


def _once(key: np.ndarray, start: np.ndarray):
    """The first of equal keys, and the starts of the others as bytes."""
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
    again, ends = np.full(len(first), None, dtype=object), np.r_[first[1:], len(order)]
    for g in np.flatnonzero(ends - first > 1):
        again[g] = start[order[first[g] + 1 : ends[g]]].astype("<i4").tobytes()
    return order[first], pa.array(again, pa.binary())


def _seeds(select, length: int):
    """Occurrences of anchors that few documents share, with the words on either
    side (nearest first, as many as a window can reach and the text has), the
    document, place and text packed, and the places at which a text has the same
    again (so that it sends one row)."""
    gram = min(GRAM, length)
    reach = length - gram

    def run(batches):
        for b in pieces(batches):
            x, off, runs, _, row, place = _windows(b, length)
            if not len(row):
                continue
            new = np.r_[True, place[1:] != place[:-1]]
            p, r = place[new], row[new]
            cold, _ = select(b, off, p, r, runs[p])
            p, r = p[cold], r[cold]
            if not len(p):
                continue
            left = np.minimum(p - off[r], reach).astype(np.int8)
            right = np.minimum(off[r + 1] - p - gram, reach).astype(np.int8)
            padded = np.r_[np.zeros(reach, np.uint64), x, np.zeros(reach, np.uint64)]
            around = np.empty((len(p), 2 * reach), dtype=np.uint64)
            for j in range(reach):
                around[:, j] = np.where(left > j, padded[p + reach - 1 - j], 0)
                around[:, reach + j] = np.where(right > j, padded[p + reach + gram + j], 0)
            key = runs[p] + r.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + left.astype(np.uint64) * np.uint64(31) + right.astype(np.uint64)
            for j, c in enumerate(_consts(4, 2 * reach)):
                key = (key ^ around[:, j]) * c
            one, again = _once(key, p - off[r])
            cells = pa.Array.from_buffers(pa.binary(16 * reach), len(one), [None, pa.py_buffer(np.ascontiguousarray(around[one]).tobytes())]) if reach else pa.array([b""] * len(one))
            packed = (p - off[r])[one] << 32 | b.column(1).to_numpy()[r[one]]
            cols = [pa.array(runs[p[one]].view(np.int64)), b.column(0).take(pa.array(r[one])), pa.array(packed), pa.array(left[one]), pa.array(right[one]), cells.cast(pa.binary()), again]
            yield pa.record_batch(cols, ["anchor", "doc_id", "place", "l", "r", "around", "again"])

    return run


def _refined(group: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Groups split by one more word each, numbered anew."""
    rank = np.unique(word, return_inverse=True)[1]
    return np.unique(group * (int(rank.max()) + 1) + rank, return_inverse=True)[1]


def _extended(length: int):
    """Streams occurrences sorted by anchor and document; extends each as far as an
    earlier document agrees, and yields (doc_id, place, reaches, again): bit l says
    that the window which begins l words before the anchor is repeated."""
    reach = length - min(GRAM, length)

    def matches(t: pa.Table):
        anchor, doc = t.column(0).to_numpy(), t.column(1).to_numpy()
        new = np.r_[True, anchor[1:] != anchor[:-1]]
        group, start = np.cumsum(new) - 1, np.flatnonzero(new)
        ends = np.r_[start[1:], len(doc)]
        shared = (doc[ends - 1] > doc[start])[group]  # sorted: the last document of an anchor is its greatest
        t, doc, group = t.filter(pa.array(shared)), doc[shared], group[shared]
        if not len(doc):
            return None
        n_left, n_right = t.column(3).to_numpy(), t.column(4).to_numpy()
        around = np.frombuffer(b"".join(t.column(5).to_pylist()), dtype=np.uint64).reshape(len(doc), 2 * reach)
        group = np.unique(group, return_inverse=True)[1].astype(np.int64)
        by_left, by_right = [group], [group]
        for j in range(reach):  # one more word to the left, one more to the right
            by_left.append(_refined(by_left[-1], around[:, j]))
            by_right.append(_refined(by_right[-1], around[:, reach + j]))
        found = np.zeros(len(doc), dtype=np.int32)
        for l in range(reach + 1):  # noqa: E741
            whole = np.flatnonzero((n_left >= l) & (n_right >= reach - l))
            if not len(whole):
                continue
            _, first, of = np.unique(by_left[l][whole] * (len(doc) + 1) + by_right[reach - l][whole], return_index=True, return_inverse=True)
            mine = doc[whole]
            found[whole[mine > mine[first[of]]]] |= 1 << l  # sorted: the first of equals has the least document
        hit = pa.array(found > 0)
        t = t.filter(hit).combine_chunks()
        cols = [t.column(1), t.column(2), pa.array(found[found > 0]), t.column(6)]
        return pa.Table.from_arrays(cols, ["doc_id", "place", "reaches", "again"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([*held, b])
            anchor = t.column(0).to_numpy()
            cut = np.flatnonzero(anchor[1:] != anchor[:-1])
            last = int(cut[-1]) + 1 if len(cut) else 0
            held = t.slice(last).to_batches()
            if last and (out := matches(t.slice(0, last))) is not None:
                yield from out.to_batches()
        if held and (out := matches(pa.Table.from_batches(held))) is not None:
            yield from out.to_batches()

    return run


def _hot_windows(b, select, length: int):
    """Windows of a batch that are seeded by anchors which many documents share:
    two hashes of their words, their places within the text, and their rows."""
    x, off, runs, at, row, place = _windows(b, length)
    if len(row):
        hot = select(b, off, place, row, runs[place])[1]
        at, row = at[hot], row[hot]
    if not len(row):
        return None
    return _run_hash(x, length, 2)[at], _run_hash(x, length, 3)[at], at - off[row], row


def _least(select, length: int):
    """(h1, h2, first, last): such windows, each once a batch, with the least and greatest document."""

    def run(batches):
        for b in pieces(batches):
            if (got := _hot_windows(b, select, length)) is None:
                continue
            h1, h2, _, row = got
            doc = b.column(0).to_numpy()[row]
            order = np.lexsort((doc, h2, h1))
            h1, h2, doc = h1[order], h2[order], doc[order]
            start = np.flatnonzero(np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
            last = np.r_[start[1:], len(doc)] - 1
            yield pa.record_batch([pa.array(h1[start].view(np.int64)), pa.array(h2[start].view(np.int64)), pa.array(doc[start]), pa.array(doc[last])], ["h1", "h2", "first", "last"])

    return run


def _by_text(doc: np.ndarray, th: np.ndarray, row: np.ndarray, start: np.ndarray):
    """(doc_id, place, reaches, again): a row per text for its repeated windows."""
    new = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    ends = np.r_[new[1:], len(row)]
    again = [start[i + 1 : j].astype("<i4").tobytes() if j - i > 1 else None for i, j in zip(new, ends)]
    r = row[new]
    return pa.record_batch([pa.array(doc[r]), pa.array(start[new] << 32 | th[r]), pa.array(np.ones(len(new), np.int32)), pa.array(again, pa.binary())], ["doc_id", "place", "reaches", "again"])


def _crowded_known(select, known, length: int):
    """Such windows of documents behind their first, which ``known`` tells: (h1 sorted, h2, first)."""

    def run(batches):
        for b in pieces(batches):
            if (got := _hot_windows(b, select, length)) is None:
                continue
            h1, h2, start, row = got
            keys, others, first = known.value
            at = np.minimum(np.searchsorted(keys, h1), len(keys) - 1)
            doc = b.column(0).to_numpy()
            later = (keys[at] == h1) & (others[at] == h2) & (doc[row] > first[at])
            if later.any():
                yield _by_text(doc, b.column(1).to_numpy(), row[later], start[later])

    return run


def _crowded(select, length: int):
    """Such windows, once a text, to be joined with their first documents."""

    def run(batches):
        for b in pieces(batches):
            if (got := _hot_windows(b, select, length)) is None:
                continue
            h1, h2, start, row = got
            one, again = _once(h1 + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), start)
            packed = start[one] << 32 | b.column(1).to_numpy()[row[one]]
            yield pa.record_batch([pa.array(h1[one].view(np.int64)), pa.array(h2[one].view(np.int64)), b.column(0).take(pa.array(row[one])), pa.array(packed), again], ["h1", "h2", "doc_id", "place", "again"])

    return run


def _crowded_repeats(hashed: DataFrame, select, length: int) -> DataFrame:
    """(doc_id, place, reaches, again) of the windows that anchors of many documents
    seed.  Their first documents come from a partial aggregate; up to ``KNOWN`` of
    them are sent to all tasks, more are joined, which Spark can split."""
    least = hashed.mapInArrow(_least(select, length), "h1 long, h2 long, first long, last long")
    first = stored(least.groupBy("h1", "h2").agg(F.min("first").alias("first"), F.max("last").alias("last")).where("first < last").select("h1", "h2", "first"))
    schema = "doc_id long, place long, reaches int, again binary"
    if 0 < first.count() <= KNOWN:
        got = first.toArrow()
        h1, h2, doc = (got.column(i).to_numpy() for i in range(3))
        order = np.argsort(h1.view(np.uint64), kind="stable")
        keys = h1.view(np.uint64)[order]
        if (keys[1:] != keys[:-1]).all():
            known = hashed.sparkSession.sparkContext.broadcast((keys, h2.view(np.uint64)[order], doc[order]))
            return hashed.mapInArrow(_crowded_known(select, known, length), schema)
    many = hashed.mapInArrow(_crowded(select, length), "h1 long, h2 long, doc_id long, place long, again binary")
    return many.join(first, ["h1", "h2"]).where("doc_id > first").select("doc_id", "place", F.lit(1).alias("reaches"), "again")


def _spans(length: int):
    """Merges the repeated windows of a document into runs of words [start, end)."""

    def run(batches):
        for b in pieces(batches):
            lists = b.column(2)
            flat, off = lists.flatten(), lists.offsets.to_numpy()
            doc = np.repeat(np.arange(b.num_rows), np.diff(off))
            at, reaches, again = flat.field(0).to_numpy(), flat.field(1).to_numpy(), flat.field(2)
            docs, places, marks = [doc], [at.astype(np.int64)], [reaches]
            for i in np.flatnonzero(again.is_valid().to_numpy(zero_copy_only=False)):
                more = np.frombuffer(again[i].as_py(), dtype="<i4").astype(np.int64)
                docs.append(np.full(len(more), doc[i]))
                places.append(more)
                marks.append(np.full(len(more), reaches[i], dtype=reaches.dtype))
            doc, at, reaches = np.concatenate(docs), np.concatenate(places), np.concatenate(marks)
            starts = [(doc[hit] << 32) + at[hit] - l for l in range(length) if (hit := (reaches >> l & 1) == 1).any()]  # noqa: E741
            s = np.unique(np.concatenate(starts))
            of, s = s >> 32, s & 0xFFFFFFFF
            new = np.r_[True, (np.diff(s) > length) | (of[1:] != of[:-1])]
            first = np.flatnonzero(new)
            last = np.r_[first[1:], len(s)] - 1
            spans = pa.StructArray.from_arrays([pa.array(s[first].astype(np.int32)), pa.array((s[last] + length).astype(np.int32))], ["start", "end"])
            ends = np.r_[0, np.cumsum(np.bincount(of[first], minlength=b.num_rows))].astype(np.int32)
            yield pa.record_batch([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(ends), spans)], ["doc_id", "th", "spans"])

    return run


def _removed(batches):
    for b in pieces(batches, 4 << 20):
        kept, n, gone = [], [], []
        for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            parts = (text or b"").split()
            n.append(len(parts))
            gone.append(sum(s["end"] - s["start"] for s in spans))
            at, left = 0, []
            for s in spans:
                left += parts[at : s["start"]]
                at = s["end"]
            kept.append(b" ".join(left + parts[at:]).decode())
        yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), b.column(2), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "repeats", "kept_text"])


def substring_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc_id, n_words, n_removed, repeats, kept_text): one row per row.

    ``repeats`` are the maximal runs of words [start, end) all of whose windows
    of ``length`` words also start in a document with a smaller id; they are
    what is removed.  Windows are judged on the input; words are told apart by
    64-bit hashes.  A null or empty text has no words; texts shorter than a window lose none.  Rows with one id
    never remove words from one another; rows without an id neither lose words
    nor count as earlier.  Other columns of ``docs`` are never read.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    # A text hash beside the id is needed only where an id has several rows.
    single = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    rows = rows.withColumn("th", F.lit(0).cast("long") if single else text_hash(F.col("t")).bitwiseAND(F.lit(0xFFFFFFFF)))
    hashed = rows.where("doc_id IS NOT NULL").select("doc_id", "th", F.transform(words(F.col("t")), lambda w: F.xxhash64(w)).alias("w"))

    counts = stored(hashed.mapInArrow(_anchors(length), "anchor long, n int").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1"))
    if counts.count() <= 1 << TABLE_BITS >> 3:
        crowded = counts.where(F.col("n") > HOT)
        hot = None if crowded.isEmpty() else spark.sparkContext.broadcast(bit_table(crowded.select(F.col("anchor").alias("h")), TABLE_BITS))
        select = _by_table(spark.sparkContext.broadcast(bit_table(counts.select(F.col("anchor").alias("h")), TABLE_BITS)), hot)
    else:
        places = hashed.mapInArrow(_places(length), "anchor long, doc_id long, th long, place int").join(counts, "anchor")
        some = lambda c: F.collect_list(F.when(c, F.col("place")))
        lists = places.groupBy("doc_id", "th").agg(some(F.col("n") <= HOT).alias("few"), some(F.col("n") > HOT).alias("many"))
        hashed, hot, select = stored(hashed.join(lists, ["doc_id", "th"])), True, _by_place
    kinds = "anchor long, doc_id long, place long, l tinyint, r tinyint, around binary, again binary"
    seeds = hashed.mapInArrow(_seeds(select, length), kinds).repartition("anchor").sortWithinPartitions("anchor", "doc_id")
    later = seeds.mapInArrow(_extended(length), "doc_id long, place long, reaches int, again binary")
    if hot is not None:
        later = later.unionByName(_crowded_repeats(hashed, select, length))
    found = F.collect_list(F.struct(F.shiftrightunsigned("place", 32).cast("int").alias("at"), "reaches", "again"))
    starts = later.groupBy("doc_id", F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).alias("th")).agg(found.alias("found"))
    spans = stored(starts.mapInArrow(_spans(length), "doc_id long, th long, spans array<struct<start: int, end: int>>"))

    key = F.xxhash64("doc_id", "th")
    texts = marked(rows.select("doc_id", "th", F.encode("t", "utf-8").alias("t")), key, slots(spans.select(key.alias("h"))), "touched")
    none = F.array().cast("array<struct<start: int, end: int>>")
    whole = texts.where("NOT touched").select("doc_id", "t", none.alias("spans"))
    cut = texts.where("touched").join(spans, ["doc_id", "th"], "left").select("doc_id", "t", F.coalesce("spans", none).alias("spans"))
    out = "doc_id long, n_words long, n_removed long, repeats array<struct<start: int, end: int>>, kept_text string"
    return whole.unionByName(cut).mapInArrow(_removed, out)


def op4_substring(spark, sf_dir: str) -> DataFrame:
    rows = substring_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS s
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT s, min(doc_id) AS first FROM g GROUP BY s HAVING min(doc_id) < max(doc_id)),
c AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, i + unnest(range(0, 13)) AS p FROM g JOIN f USING (s) WHERE doc_id > first)),
r AS (SELECT doc_id, list(p) AS p, count(*) AS n FROM c GROUP BY doc_id),
k AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t
      FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d) ANTI JOIN (SELECT doc_id, p AS i FROM c) USING (doc_id, i)
      GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(r.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM d LEFT JOIN r ON d.doc_id = r.doc_id LEFT JOIN k ON d.doc_id = k.doc_id
"""
