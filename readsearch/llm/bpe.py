"""Byte-level BPE by content-defined chunk reuse.

A rolling hash over a text's bytes cuts it where the content says so, so a
passage that documents share is cut alike in all of them.  Chunks that occur
more than once are found by their digests, encoded once for the whole table,
and joined to the documents that hold them.

Token boundaries near a cut may be false.  A chunk is therefore encoded between
points that hold in any context: a blank after a character that is none, which
no token of the splitting pattern spans.  Its outermost such segments are kept
apart.  Where chunks join, the stretch from the last segment of one to the first
segment of the next is encoded again; the result has to agree exactly with both
segments.  Without agreement the stretch grows over the whole chunk, and on to
the whole text.  Text in chunks of its own is encoded as it stands.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import tiktoken
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bit_table, has, marked, pieces, slots, stored, table, text_hash, worker_state

#: How byte-level BPE splits text before merges (a fixed value of the format).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPAN, MASK, LEAST = 32, (1 << 10) - 1, 256  # bytes under the rolling hash; a cut per KiB; least chunk
#: log2 of the bits of the table of repeated chunks; a fuller table only sends more chunks to be compared.
TABLE_BITS = 24

#: A blank behind a character that is certainly none: not behind the lead bytes of blanks beyond ASCII.
_SAFE = re.compile(rb"(?:[!-~]|[\xC3-\xDF][\x80-\xBF]|[\xE0\xE4-\xEF][\x80-\xBF]{2}|\xE3[\x81-\xBF][\x80-\xBF]|[\xF0-\xF4][\x80-\xBF]{3})(?=[ \n])")

#: What a tokenizer file has to say for its ids to be those of merges by rank behind ``PATTERN``.
_WANTED = {
    "normalizer": [None],
    "pre_tokenizer": [{"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}],
    "decoder": [{"type": "ByteLevel"}],
    "model": [{"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False, "ignore_merges": False}],
}


def public_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _alphabet() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return out | {chr(256 + i): b for i, b in enumerate(rest)}


def read_file(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Ranks and special tokens of a tokenizer file.  A file whose ids can't be
    had by merging in order of id behind ``PATTERN`` is an error."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    for part, (want,) in _WANTED.items():
        got = spec.get(part)
        if (want is None) != (got is None) or any((got.get(k) or None) != (v or None) for k, v in (want or {}).items()):
            raise ValueError(f"{path}: {part} is not one that is understood here")
    for t in spec["added_tokens"]:
        if any(t.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized")) or not t["special"] or re.search(r"\s", t["content"]):
            raise ValueError(f"{path}: added token {t['content']!r} is not one that is understood here")
    special, byte = {t["content"]: t["id"] for t in spec["added_tokens"]}, _alphabet()
    vocab = {k: i for k, i in spec["model"]["vocab"].items() if k not in special}
    made = [vocab.get("".join(m) if isinstance(m, list) else m.replace(" ", "", 1), -1) for m in spec["model"]["merges"]]
    if any(c not in byte for token in vocab for c in token) or any(c not in vocab for c in byte):
        raise ValueError(f"{path}: the vocabulary is not one of bytes")
    if made != sorted(set(made)) or made[:1] == [-1] or len(made) + 256 != len(vocab):
        raise ValueError(f"{path}: ids are not in the order of merges")
    return {bytes(byte[c] for c in token): i for token, i in vocab.items()}, special


def encoding(path: str) -> tiktoken.Encoding:
    """The merges and special tokens of a file, kept by each Python worker."""
    kept = worker_state()
    if ("bpe", path) not in kept:
        ranks, special = read_file(path)
        kept["bpe", path] = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return kept["bpe", path]


def cuts(data: bytes) -> list[int]:
    """Content-defined cut positions, at starts of characters, ends included."""
    n = len(data)
    out = [0]
    if n > LEAST:
        x = np.frombuffer(data, dtype=np.uint8)
        h = (x.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
        width, base = 1, 0x01000193
        while width < SPAN:  # the hash of twice the width from two hashes
            low = h[width:] + h[:-width] * np.uint32(base)
            h, base, width = low, base * base & 0xFFFFFFFF, 2 * width
        ends = np.flatnonzero((h >> np.uint32(15)) & np.uint32(MASK) == 0) + SPAN
        for at in ends.tolist():
            if at - out[-1] >= LEAST and at < n and data[at] & 0xC0 != 0x80:
                out.append(at)
    out.append(n)
    return out


def chunks(data: bytes) -> list[tuple[tuple[int, int], bytes]]:
    """The chunks of a text, each with its digest as two longs."""
    at = cuts(data)
    return [(digest(data[i:j]), data[i:j]) for i, j in zip(at, at[1:]) if j > i]


def digest(data: bytes) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(data)
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


class Encoder:
    """Encodes texts, with or without what is known of their chunks."""

    def __init__(self, path: str):
        self.core = encoding(path)
        self.reused = 0  # bytes whose ids came from a known chunk

    def encoded(self, data: bytes) -> bytes:
        return self.core.encode_to_numpy(data.decode("utf-8"), allowed_special="all", disallowed_special=()).astype("<u4").tobytes()

    def chunk(self, data: bytes) -> tuple[int, int, bytes, bytes, bytes] | None:
        """(a, b, head, body, tail): ids of the first segment, which ends at a, of
        the middle up to b, and of the last segment behind it; None if there are
        not four points that hold in any context."""
        points = [m.end() for m in _SAFE.finditer(data)]
        if len(points) < 4:
            return None
        first, a, b, last = points[0], points[1], points[-2], points[-1]
        return a, b, self.encoded(data[first:a]), self.encoded(data[a:b]), self.encoded(data[b:last])

    def ids(self, data: bytes, known: dict | None = None) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers."""
        known = dict(known or {})
        while known:
            out, stretch, tail, last, reused = [], [], b"", None, 0
            for key, part in chunks(data):
                got = known.get(key)
                if got is None:
                    stretch.append(part)
                    continue
                a, b, head, body, end = got
                again = self.encoded(b"".join([*stretch, part[:a]]))
                if not (again.startswith(tail) and again.endswith(head)):
                    break
                out += [again, body]
                stretch, tail, last, reused = [part[b:]], end, key, reused + b - a
            else:
                key, again = last, self.encoded(b"".join(stretch))
                if again.startswith(tail):
                    self.reused += reused
                    return b"".join([*out, again])
            for k in {key, last} & set(known):  # no agreement: the stretch grows over these chunks
                del known[k]
        return self.encoded(data)

    def text(self, ids: bytes) -> str:
        return self.core.decode_bytes(np.frombuffer(ids, dtype="<u4").tolist()).decode("utf-8", errors="replace")


def _counted(batches):
    for b in pieces(batches):
        n: dict[tuple[int, int], int] = {}
        for t in b.column(2).to_pylist():
            for key, _ in chunks(t or b""):
                n[key] = n.get(key, 0) + 1
        if n:
            yield pa.record_batch([pa.array([k[0] for k in n]), pa.array([k[1] for k in n]), pa.array(list(n.values()), pa.int32())], ["h", "g", "n"])


def _maybe(table_, data: bytes) -> list[tuple[tuple[int, int], bytes]]:
    found = chunks(data)
    if not found:
        return found
    hit = has(table_, np.array([k[0] for k, _ in found], dtype=np.int64).view(np.uint64))
    return [x for x, y in zip(found, hit) if y]


def _repeated(bits):
    """(h, g, data) of the chunks in the table, once per piece of a batch."""

    def run(batches):
        for b in pieces(batches):
            out: dict[tuple[int, int], bytes] = {}
            for t in b.column(2).to_pylist():
                out.update(_maybe(bits.value, t or b""))
            if out:
                yield pa.record_batch([pa.array([k[0] for k in out]), pa.array([k[1] for k in out]), pa.array(list(out.values()), pa.binary())], ["h", "g", "data"])

    return run


def _held(bits):
    """(doc_id, th, h, g): the chunks in the table that a document holds, each once."""

    def run(batches):
        for b in pieces(batches):
            row, keys = [], []
            for i, t in enumerate(b.column(2).to_pylist()):
                mine = dict.fromkeys(k for k, _ in _maybe(bits.value, t or b""))
                row += [i] * len(mine)
                keys += mine
            if row:
                at = pa.array(row)
                yield pa.record_batch([b.column(0).take(at), b.column(1).take(at), pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys])], ["doc_id", "th", "h", "g"])

    return run


def _known(where: str):
    def run(batches):
        encoder = Encoder(where)
        for b in pieces(batches):
            h, g, data = (c.to_pylist() for c in b.columns)
            rows = [(*k, *got) for *k, d in zip(h, g, data) if (got := encoder.chunk(d))]
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["h", "g", "a", "b", "head", "body", "tail"])

    return run


def _run(where: str, decoded: bool):
    names = ["doc_id", "n_tokens", "ids", "n_reused", *(["decoded"] if decoded else [])]

    def run(batches):
        encoder = Encoder(where)
        for b in pieces(batches, 4 << 20):
            ids, reused = [], []
            for t, known in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                before = encoder.reused
                ids.append(encoder.ids(t or b"", {(k["h"], k["g"]): (k["a"], k["b"], k["head"], k["body"], k["tail"]) for k in known or ()}))
                reused.append(encoder.reused - before)
            out = [b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(reused, pa.int64())]
            yield pa.record_batch(out + ([pa.array([encoder.text(x) for x in ids], pa.string())] if decoded else []), names)

    return run


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids binary, n_reused[, decoded]): one row per row.

    The ids are those of the tokenizer file at ``path`` without added special
    tokens; strings of special tokens in a text are encoded as those.  Null
    counts as empty and has no ids; repeated rows and null ids are encoded like
    any other; a text may be of any length that a cell holds; no rows give none.
    ``n_reused`` are the bytes whose ids came from a chunk that occurs again
    somewhere in ``docs``.  ``decoded`` adds the text read back from the ids.
    Other columns of ``docs`` are never read.
    """
    where = path or public_path()
    read_file(where)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_hash(F.col(text_col)).alias("th"), F.encode(F.col(text_col), "utf-8").alias("t"))
    shared = stored(rows.mapInArrow(_counted, "h long, g long, n int").groupBy("h", "g").agg(F.sum("n").alias("n")).where("n > 1").select("h", "g"))
    bits = docs.sparkSession.sparkContext.broadcast(bit_table(shared.select("h"), TABLE_BITS))
    known = "h long, g long, a int, b int, head binary, body binary, tail binary"
    once = rows.mapInArrow(_repeated(bits), "h long, g long, data binary").groupBy("h", "g").agg(F.first("data").alias("data")).join(shared, ["h", "g"], "left_semi")
    table_ = stored(once.mapInArrow(_known(where), known))
    held = stored(rows.mapInArrow(_held(bits), "doc_id long, th long, h long, g long"))
    given = held.join(table_, ["h", "g"]).groupBy("doc_id", "th").agg(F.collect_list(F.struct("h", "g", "a", "b", "head", "body", "tail")).alias("known"))
    key = F.xxhash64("doc_id", "th")
    seen = marked(rows, key, slots(held.select(key.alias("h"))), "touched")
    none = F.lit(None).cast(given.schema["known"].dataType)
    whole = seen.where("NOT touched").select("doc_id", "t", none.alias("known"))  # stays where it is
    theirs = given.select(F.col("doc_id").alias("_i"), F.col("th").alias("_h"), "known")
    touched = seen.where("touched").join(theirs, F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("th") == F.col("_h")), "left").select("doc_id", "t", "known")
    return whole.unionByName(touched).mapInArrow(_run(where, decoded), "doc_id long, n_tokens long, ids binary, n_reused long" + ", decoded string" * decoded)


def decode(rows: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) from ids: one row per row, repeated ones and null ids included;
    null ids cells count as none, bytes that are no UTF-8 become U+FFFD."""
    where = path or public_path()
    read_file(where)

    def run(batches):
        encoder = Encoder(where)
        for b in pieces(batches, 4 << 20):
            yield pa.record_batch([b.column(0), pa.array([encoder.text(x or b"") for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    rows = encode(table(spark, sf_dir, "documents"), decoded=True)
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "n_reused")
