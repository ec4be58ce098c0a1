"""Near, exact and substring duplicates against brute force, with edge cases."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from readsearch.llm import components, exact, simhash, substring

SCHEMA = "doc_id long, text string, fp string, th string, _id long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", None, 5) for i, t in rows], SCHEMA)


def corpus(seed=0, n=120):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 6))) for _ in range(40)]
    base = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(0, 60))) for _ in range(n // 3)]
    passage = " ".join(rng.choice(vocab) for _ in range(30))
    rows = list(enumerate(base))
    for i in range(n // 3, n):
        words = rng.choice(base).split()
        kind = rng.randrange(4)
        if words and kind == 0:
            words[rng.randrange(len(words))] = rng.choice(vocab)
        if kind == 1:
            words[len(words) // 2 : len(words) // 2] = passage.split()
        sep = rng.choice([" ", "  ", "\n"])
        rows.append((i, sep.join(words)))
    rows += [(n, None), (n + 1, ""), (n + 2, " \n"), (7, base[7]), (None, base[3]), (None, None), (n + 3, "w " * 30000), (n + 4, "one")]
    rng.shuffle(rows)
    return rows


def brute_fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not w:
        return 0
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows, reach):
    fps = [brute_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= reach:
                group[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(d)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return [(d, f"{fps[i]:016x}", least[find(i)]) for i, (d, _) in enumerate(rows)]


@pytest.mark.parametrize(("chunk", "blocks"), [(256, 5), (2, 5), (256, 7)])
def test_simhash_equals_brute_force(spark, monkeypatch, chunk, blocks):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    monkeypatch.setattr(simhash, "BLOCKS", {blocks: 1 << 64})
    rows = corpus(1)
    got = simhash.near_duplicates(docs(spark, rows)).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute_components(rows, 3)))
    kept = simhash.keep(docs(spark, rows))
    assert kept.columns == ["doc_id", "text", "fp", "th", "_id"]
    want = {x[2] for x in brute_components(rows, 3)}
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(x for x in want if x is not None)


def test_pivot_links_lose_nothing():
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 2**63, 40, dtype=np.uint64)
    x = np.unique(np.concatenate([centre] + [centre ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for _ in range(6)]))
    near = np.bitwise_count(x[:, None] ^ x[None]) <= 3
    a, b = np.nonzero(near)
    table = simhash.distances(x).astype(int)
    assert np.abs(table[a] - table[b]).max() <= 3
    for n in simhash.BLOCKS:
        blocks = simhash.masks(n)
        same = sum((simhash.distances(x, m)[a] == simhash.distances(x, m)[b]).all(axis=1).astype(int) for m in blocks)
        assert same.min() >= n - 3 and int(blocks.sum()) == 2**64 - 1


def test_simhash_empty(spark):
    assert simhash.near_duplicates(docs(spark, [])).isEmpty()
    assert simhash.keep(docs(spark, [])).isEmpty()


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000), (1, 0), (1, 0)]
    got = {r["node"]: r["root"] for r in components.roots(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(301)}) == 1 and len({got[1000 + i] for i in range(200)}) == 1
    assert got[0] != got[1000] and 5000 not in got


def normal(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_exact_equals_brute_force(spark):
    rows = corpus(2)
    groups = {}
    for d, t in rows:
        groups.setdefault(normal(t), []).append(d)
    got = exact.exact_duplicates(docs(spark, rows)).collect()
    least = lambda v: min((x for x in v if x is not None), default=None)
    want = [(d, least(groups[normal(t)]), len(groups[normal(t)]), hashlib.sha256(normal(t).encode()).hexdigest()) for d, t in rows]
    assert sorted(repr((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"])) for r in got) == sorted(map(repr, want))
    assert sum(r["kept"] for r in got) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    kept = exact.keep(docs(spark, rows)).collect()
    assert sorted(normal(r["text"]) for r in kept) == sorted(groups)
    assert exact.exact_duplicates(docs(spark, [])).isEmpty() and exact.keep(docs(spark, [])).isEmpty()


@pytest.mark.parametrize("hot", [64, 1])
def test_exact_tells_colliding_fingerprints_apart(spark, monkeypatch, hot):
    monkeypatch.setattr(exact, "text_print", lambda data, chunk=0: (1, 2, 3))
    monkeypatch.setattr(exact, "HOT", hot)
    got = exact.exact_duplicates(docs(spark, [(1, "a"), (2, "b"), (3, "a"), (4, "b")])).collect()
    assert {r["doc_id"]: r["keep_id"] for r in got} == {1: 1, 2: 2, 3: 1, 4: 2}


@pytest.mark.parametrize("hot", [64, 1])
def test_exact_in_small_parts_equals_whole(spark, monkeypatch, hot):
    monkeypatch.setattr(exact, "PART", 40)
    monkeypatch.setattr(exact, "HOT", hot)
    test_exact_equals_brute_force(spark)


def test_exact_hot_text_is_folded_before_it_meets(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)
    plain = exact._compared

    def counted(batches):
        def passed():
            for b in batches:
                seen.add(b.num_rows)
                yield b

        yield from plain(passed())

    monkeypatch.setattr(exact, "_compared", counted)
    rows = spark.range(5000, numPartitions=500).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 3, F.concat(F.lit("own "), "id")).otherwise("a hot text").alias("text"))
    got = exact.exact_duplicates(rows).where("kept").agg(F.count("*"), F.max("group_size")).first()
    assert tuple(got) == (501, 4500)
    assert seen.value <= 500 + 2 * exact.SALTS  # a row per partition, then one per salt, none of them in a task with all


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=400), st.integers(1, 50), st.integers(0, 400))
def test_prints_compose(data, chunk, cut):
    whole = exact.text_print(data)
    assert exact.text_print(data, chunk) == whole
    assert exact.combine(exact.text_print(data[:cut]), exact.text_print(data[cut:])) == whole
    value = [0, 0]
    for b in data:
        value = [(value[k] * exact.BASES[k] + b + 1) % exact.MODULI[k] for k in (0, 1)]
    assert whole == (*value, len(data))


def test_parts_of_a_document_give_its_print(spark):
    data = b"abc" * 50000 + b"\x00"
    parts = spark.createDataFrame([(1, 0, bytearray(data[:7])), (1, 1, bytearray(data[7:100000])), (1, 2, bytearray(data[100000:])), (2, 0, None)], "doc_id long, part_no long, data binary")
    got = {r["doc_id"]: (r["fp"], r["n_bytes"]) for r in exact.part_prints(parts.select("doc_id", "part_no", "data")).collect()}
    p = exact.text_print(data)
    assert got == {1: (p[0] << 31 | p[1], len(data)), 2: (0, 0)}


def brute_removed(rows, length):
    split = [(d, (t or "").encode().split()) for d, t in rows]
    first = {}
    for d, w in split:
        if d is not None:
            for i in range(len(w) - length + 1):
                k = tuple(w[i : i + length])
                first[k] = min(first.get(k, d), d)
    out = []
    for d, w in split:
        gone = set()
        if d is not None:
            for i in range(len(w) - length + 1):
                if first[tuple(w[i : i + length])] < d:
                    gone.update(range(i, i + length))
        out.append((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


@pytest.mark.parametrize(("hot", "bits", "known"), [(4096, 27, 1 << 20), (1, 27, 1 << 20), (1, 27, 0), (3, 0, 1 << 20)])
def test_substring_equals_brute_force(spark, monkeypatch, hot, bits, known):
    """Anchors shared by few and by many; known by a bit table, or (no bits) by their
    places; first documents of crowded windows sent to all tasks or joined."""
    monkeypatch.setattr(substring, "KNOWN", known)
    monkeypatch.setattr(substring, "HOT", hot)
    monkeypatch.setattr(substring, "TABLE_BITS", bits)
    rows = corpus(3) + [(7, "another text of an id that is used twice " * 3)]
    for length in (13, 4):
        got = substring.substring_duplicates(docs(spark, rows), length=length).collect()
        assert sorted(repr((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"])) for r in got) == sorted(map(repr, brute_removed(rows, length)))
        assert all(sum(x["end"] - x["start"] for x in r["repeats"]) == r["n_removed"] for r in got)
    assert substring.substring_duplicates(docs(spark, [])).isEmpty()


def test_anchors_cover_every_window():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 50, 500).astype(np.uint64)
    g = substring._run_hash(x, substring.GRAM, 1)
    width = 13 - substring.GRAM + 1
    import pyarrow as pa

    batch = pa.record_batch([pa.array([1]), pa.array([0]), pa.array([x.view(np.int64)])], ["doc_id", "th", "w"])
    _, _, runs, at, _, place = substring._windows(batch, 13)
    assert at.tolist() == list(range(len(x) - 12)) and (runs == g).all()
    assert place.tolist() == [i + int(np.argmin(g[i : i + width])) for i in range(len(x) - 12)]


def test_extension_needs_agreement_on_both_sides(spark):
    """The anchor may agree while the words around it are those of two other documents."""
    w = [f"w{i}" for i in range(60)]
    a, b = w[:30], w[:12] + ["x"] + w[13:30]
    rows = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(["y", *w[5:17], "z"])), (4, " ".join(["y", *w[5:18], "z"]))]
    got = {r["doc_id"]: [tuple(x) for x in r["repeats"]] for r in substring.substring_duplicates(docs(spark, rows)).collect()}
    assert got == {1: [], 2: [(13, 30)], 3: [], 4: [(0, 14)]}
