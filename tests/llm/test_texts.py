"""Rules, tokens, languages, licences, mixing: brute force, round trips, held-out accuracy."""

import os
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from readsearch.llm import bpe, langid, license, mixing, quality

public = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"


def brute_quality(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = {}
    for i in range(len(w) - 4):
        grams.setdefault(tuple(w[i : i + 5]), []).append(i)
    covered = {i + j for v in grams.values() if len(v) > 1 for i in v for j in range(5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))


TEXTS = [None, "", " \n\t", "one", "a b c d e f g h i j k", "x y z p q x y z p q x y z", "é" * 50000, "a b " * 4000, "l1 w\nl1 w\n\nl2\nl1 w", "### $$$ a|b <c>", "WORD " * 3 + "other words go here to fill ten of them", "\x00 \x1f   a b"]


def test_quality_equals_brute_force(spark):
    rows = [(i, t, 9) for i, t in enumerate(TEXTS)] + [(None, "a", 1), (0, None, 1)]
    given = spark.createDataFrame(rows, "doc_id long, text string, n_words long")
    got = quality.apply_policy(quality.ledger(given)).collect()
    want = [(d, *brute_quality(t)) for d, t, _ in rows]
    assert sorted(repr((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])) for r in got) == sorted(map(repr, want))
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert r["kept"] == (r["failures"] == 0)
    assert quality.keep(given).columns == given.columns
    assert quality.keep(given).count() == sum(r["kept"] for r in got)
    assert quality.ledger(given.limit(0)).isEmpty()


def test_ablations(spark):
    rows = spark.createDataFrame([(m,) for m in (0, 1, 1, 2, 3, 4, 36, 0)], "failures long")
    got = {r["rule"]: (r["n_failed"], r["n_only"], r["kept_without"]) for r in quality.ablations(rows).collect()}
    assert got["few_words"] == (3, 2, 4) and got["repeat_words"] == (2, 1, 3) and got["symbols"] == (2, 1, 3) and got["capitals"] == (1, 0, 2)


def test_ledger_outlives_its_rules(spark, tmp_path, monkeypatch):
    """A stored ledger serves policies that came later, and rules in another order."""
    given = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    quality.write_ledger(given, str(tmp_path / "ledger"))
    want = {r["doc_id"]: r["failures"] for r in quality.ledger(given).collect()}
    assert {r["doc_id"]: r["failures"] for r in quality.read_ledger(spark, str(tmp_path / "ledger")).collect()} == want
    monkeypatch.setattr(quality, "POLICIES", quality.POLICIES | {"later": ("symbols",)})
    monkeypatch.setattr(quality, "RULES", dict(reversed(quality.RULES.items())))
    rows = quality.apply_policy(quality.read_ledger(spark, str(tmp_path / "ledger")), "later")
    assert {r["doc_id"] for r in rows.where("NOT kept AND NOT base_failed").collect()} == {i for i, m in want.items() if m & 4 and not m & 3}
    assert quality.ablations(rows, "later").first()["n_failed"] == sum(bool(m & 4) for m in want.values())
    monkeypatch.setattr(quality, "RULES", quality.RULES | {"new": "n_words > 5"})
    with pytest.raises(ValueError, match="not a ledger"):
        quality.read_ledger(spark, str(tmp_path / "ledger"))
    quality.write_ledger(given.limit(0), str(tmp_path / "none"))


def test_quality_is_native(spark):
    plan = quality.ledger(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


HARD = [
    "", "a<|endoftext|>b", "  x  <|endoftext|>  y ", "don't  we'll\n\n\tgo   ", "日本語" * 2000, "a" * 5000, " " * 3000, "\n\n \n x", "é " * 900,
    "x <|endoftext|> " * 400, "1 2 3 " * 500, "ab cd   ef" * 300, "it's " * 700 + "'", " a  b" * 300, "a\r\n b\x0b c\x1c d" * 200, "🙂 🙃" * 400,
]


def hard_texts():
    rng = np.random.default_rng(0)
    alphabet = list("abc de'f12 .,\n\té日🙂<|>") + ["<|endoftext|>", " the", "'ll", "\u00a0", "\u3000", "слово "]
    return HARD + ["".join(rng.choice(alphabet, rng.integers(1, 3000))) for _ in range(150)]


def test_bpe_equals_the_library(monkeypatch):
    """With nothing known, and with every chunk known, in small and in usual chunks."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.public_path())
    encoder = bpe.Encoder(bpe.public_path())
    texts = hard_texts()
    wants = [library.encode(t, add_special_tokens=False).ids for t in texts]
    for least, mask in ((bpe.LEAST, bpe.MASK), (24, 15)):
        monkeypatch.setattr(bpe, "LEAST", least)
        monkeypatch.setattr(bpe, "MASK", mask)
        encoder.reused = 0
        for t, want in zip(texts, wants):
            known = {k: got for k, d in bpe.chunks(t.encode()) if (got := encoder.chunk(d))}
            assert b"".join(d for _, d in bpe.chunks(t.encode())) == t.encode()
            for ids in (encoder.ids(t.encode()), encoder.ids(t.encode(), known)):
                assert np.frombuffer(ids, "<u4").tolist() == want
            assert encoder.text(ids) == library.decode(want, skip_special_tokens=False) == t
        assert encoder.reused > 10_000


def test_bpe_joins_grow_until_they_agree():
    """Chunks whose outer segments are not what an encoding of the whole text has are encoded again."""
    encoder = bpe.Encoder(bpe.public_path())
    rng = np.random.default_rng(1)
    text = " ".join("".join(rng.choice(list("abcdef"), 6)) for _ in range(3000)).encode()
    good = {k: got for k, d in bpe.chunks(text) if (got := encoder.chunk(d))}
    want = encoder.ids(text)
    assert encoder.ids(text, good) == want and encoder.reused > 0.8 * len(text)
    encoder.reused = 0
    for at in (2, 4):  # a wrong first, or last, segment of every other chunk
        bad = {k: (*v[:at], b"\x01\0\0\0", *v[at + 1 :]) if i % 2 else v for i, (k, v) in enumerate(good.items())}
        assert encoder.ids(text, bad) == want
    assert encoder.reused > 0
    assert encoder.ids(text, {k: (*v[:2], b"\x01\0\0\0", *v[3:]) for k, v in good.items()}) == want


def test_bpe_refuses_other_files(spark, tmp_path):
    import json

    with pytest.raises(ValueError, match="not one that is understood|not one of bytes"):
        bpe.encode(spark.createDataFrame([], "doc_id long, text string"), public.path("word_bpe_49k.json"))
    spec = json.load(open(bpe.public_path(), encoding="utf-8"))
    swapped = spec["model"]["merges"][1::-1] + spec["model"]["merges"][2:]
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "use_regex": True}}, {"added_tokens": [spec["added_tokens"][0] | {"lstrip": True}]}, {"model": spec["model"] | {"merges": swapped}}):
        (tmp_path / "t.json").write_text(json.dumps(spec | change), encoding="utf-8")
        with pytest.raises(ValueError, match="t.json"):
            bpe.read_file(str(tmp_path / "t.json"))


def test_bpe_tables(spark):
    """A whole table against the library: what repeats is encoded once and counted as reused."""
    import hashlib

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.public_path())
    passage = " ".join(f"{a} слово {b} word" for a, b in zip(range(0, 9000, 7), range(5, 9000, 3)))
    texts = [*hard_texts()[:60], passage, "x " + passage, "another beginning. " + passage, None, "", "hello  world", "hello  world"]
    rows = [(i if i % 9 else None, t, i) for i, t in enumerate(texts)] + [(1, texts[1], 0)] * 2
    given = spark.createDataFrame(rows, "doc_id long, text string, ids int").repartition(5)
    got = bpe.encode(given, decoded=True).collect()
    want = [(i, np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes(), t or "") for i, t, _ in rows]
    digest = lambda rows: sorted((str(i), hashlib.sha256(ids).hexdigest(), len(ids) // 4, t) for i, ids, t in rows)
    assert digest((r["doc_id"], bytes(r["ids"]), r["decoded"]) for r in got) == digest(want)
    assert all(r["n_tokens"] == len(r["ids"]) // 4 for r in got) and sum(r["n_reused"] for r in got) > 2 * len(passage)
    back = bpe.decode(spark.createDataFrame([(1, r["ids"]) for r in got] + [(None, None)], "doc_id long, ids binary"))
    assert sorted(r["text"] for r in back.collect()) == sorted([t or "" for _, t, _ in rows] + [""])
    assert bpe.encode(given.limit(0)).isEmpty() and bpe.decode(back.select("doc_id", F.lit(None).cast("binary").alias("ids")).limit(0)).isEmpty()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_op5_equals_the_library(spark):
    import hashlib

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.public_path())
    want = []
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.append((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    got = bpe.op5_bpe(spark, SF)
    assert sorted(map(tuple, got.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())) == sorted(want)


def test_langid(spark):
    rng = np.random.default_rng(3)
    words = {"xa": ["kolo", "miska", "tuva"], "xb": ["wherr", "schtun", "ungbl"], "xc": ["éau", "çion", "quèr"]}
    rows = [(i, " ".join(rng.choice(words[y], rng.integers(5, 200))), y, y) for i in range(240) for y in [("xa", "xb", "xc")[i % 3]]]
    rows += [(1000, None, "xa", ""), (1001, "12 34 !!", "xb", ""), (1002, "", None, ""), (None, "kolo tuva", None, ""), (1003, "KOLO MISKA " * 20000, None, "")]
    given = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    model = langid.fit(given)
    got = langid.predict(given, model).collect()
    want = {d: y for d, t, y, _ in rows if d is not None and d < 1000 and zlib.crc32(str(d).encode()) % 4 == 2}
    held = [r for r in got if r["doc_id"] in want]
    assert len(held) > 40 and np.mean([r["lang_pred"] == want[r["doc_id"]] for r in held]) > 0.97
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and by[1003]["lang_pred"] == "xa" and all(0 <= r["score"] <= 1 for r in got)
    assert langid.fit(given.limit(0)) is None
    assert {r["lang_pred"] for r in langid.predict(given, None).collect()} == {"und"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_op6_on_rows_held_out(spark):
    """Accuracy on the documents that the model never saw."""
    sf = SF.replace("0.001", "0.01")
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = langid.op6_langid(spark, sf).collect()
    assert len(got) == len(lang) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"] and lang[r["doc_id"]] is not None and r["lang_pred"] != "und"]
    assert len(held) > 150 and np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) >= 0.95
    twice = spark.createDataFrame([(1, "the same row", "en"), (1, "the same row", "en")], "doc_id long, text string, lang string")
    assert langid.predict(twice, langid.fit(twice)).count() == 2 and langid.predict(twice.limit(0), None).isEmpty()


def test_langid_learns_from_whole_texts(spark):
    """What tells two languages apart stands at the end of long texts only."""
    rows = [(i, "same words here " * 3000 + ("kolo miska " if i % 2 else "wherr schtun ") * 3000, "ab"[i % 2]) for i in range(12)]
    given = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.predict(spark.createDataFrame([(1, "miska kolo miska kolo"), (2, "schtun wherr schtun")], "doc_id long, text string"), langid.fit(given))
    assert {r["doc_id"]: r["lang_pred"] for r in got.collect()} == {1: "b", 2: "a"}


def test_langid_tables_equal_convolution():
    rng = np.random.default_rng(4)
    model = langid.train([b"abc abd" * 40, b"xyz xxz" * 40], ["a", "b"], steps=20)
    x = rng.integers(0, 256, (5, langid.WINDOW)).astype(np.uint8)
    feats = []
    for w, f in zip(langid.WIDTHS, model.filters):
        cols = np.stack([model.embed[x[:, i : i + w]].reshape(5, -1) for i in range(langid.WINDOW - w + 1)], axis=1)
        feats.append(np.maximum((cols @ f).max(axis=1), 0))
    want = langid._softmax(np.concatenate([*feats, np.ones((5, 1))], axis=1) @ model.out)
    assert np.allclose(langid.Reader(model).probabilities(x), want, atol=1e-4)


def test_licences(spark):
    mit = license.TEXTS["MIT"]
    rows = [
        (1, "Copyright (c) 2020 Somebody\n" + mit.upper().replace('"', "'")), (2, mit.replace("sublicense", "sub-license")), (3, mit + " and more"), (4, None), (5, ""),
        (6, "text\nReleased  under the MIT Licence!\nmore\nLicensed under CC BY-NC 4.0."), (None, license.TEXTS["ISC"]), (7, "x" * 100000),
    ]
    got = {r["doc_id"]: (r["license"], r["notices"]) for r in license.scan(spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, license string")).collect()}
    assert got == {1: ("MIT", []), 2: ("MIT", []), 3: (None, []), 4: (None, []), 5: (None, []), 6: (None, ["CC-BY-NC-4.0", "MIT"]), None: ("ISC", []), 7: (None, [])}
    assert len({d for d, _, _ in license.known(spark, license.TEXTS.items())}) == len(license.TEXTS)


def brute_targets(sizes, weights, epochs):
    """Shares again and again until no source is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full, out = sum(sizes.values()), set(), {}
    while True:
        left = total - sum(epochs * sizes[s] for s in full)
        free = sum(w[s] for s in order if s not in full)
        out = {s: epochs * sizes[s] if s in full else w[s] * left / free for s in order}
        over = {s for s in order if s not in full and out[s] > epochs * sizes[s]}
        if not over:
            return out
        full |= over


@pytest.mark.parametrize(("split", "sources"), [(512, 20_000), (2, 20_000), (7, 0)])
def test_mixing(spark, monkeypatch, split, sources):
    """Many key ranges or few; plans broadcast or joined by shuffle."""
    monkeypatch.setattr(mixing, "SPLIT", split)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", sources)
    rng = np.random.default_rng(6)
    names = ["b", "a", None, "é", "zz", ""]
    rows = [(i, "w " * int(rng.integers(0, 60)) + "#" * int(rng.integers(0, 5)), names[int(rng.choice(6, p=[0.7, 0.1, 0.05, 0.05, 0.05, 0.05]))], 1.0) for i in range(400)]
    rows += [(None, "a b c", "a", 1.0), (None, None, "a", 1.0), (9, "same row here", "b", 1.0), (9, "same row here", "b", 1.0), (401, "", "void", 1.0), (402, "long " * 200_000, "long", 1.0)]
    given = spark.createDataFrame(rows, "doc_id long, text string, source string, target double")
    got = mixing.mixture(given).collect()
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = brute_targets(sizes, (5, 2, 1), 3)
    taken = {}
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]] and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert len(got) == len(rows) and all(abs(taken[s] - want[s]) <= 3 for s in want)
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mixture(given.repartition(3)).collect()))
    made = mixing.materialize(given)
    assert made.columns == given.columns
    words = {}
    for r in made.collect():
        words[r["source"]] = words.get(r["source"], 0) + len(r["text"].split())
    assert words == {s: n for s, n in taken.items() if n}
    assert mixing.mixture(given.limit(0)).isEmpty() and mixing.materialize(given.limit(0)).isEmpty()
    passes = {s: int(want[s] // sizes[s]) if sizes[s] else 0 for s in sizes}
    for r in got:  # complete passes come first
        assert r["taken"] >= passes[r["source"]] * r["size"]


def test_mixing_without_words_or_ids(spark):
    kind = "doc_id long, text string, source string"
    none = mixing.mixture(spark.createDataFrame([(1, None, "a"), (2, "", None)], kind)).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in none] == [(0, 0.0, 0)] * 2
    rows = [(None, f"text of row {i} " * (1 + i % 5), "a" if i % 3 else "b") for i in range(200)]
    cols = mixing._keyed(spark.createDataFrame(rows, kind), "doc_id", "text", "source", "mix")
    keyed = spark.createDataFrame(rows, kind)
    for name in ("_sk", "_size", "_k"):
        keyed = keyed.withColumn(name, cols[name])
    assert keyed.select("_k").distinct().count() == 200  # no two rows without an id draw one key
    many = spark.createDataFrame([(f"s{i}", int(10 ** (i % 7))) for i in range(300)], "_sk string, source_size long")
    want = brute_targets({f"s{i}": 10 ** (i % 7) for i in range(300)}, (5, 2, 1), 3)
    got = {r["_sk"]: r["target"] for r in mixing.targets(many).collect()}
    assert got == pytest.approx(want)


def test_mixing_takes_heavier_documents_first(spark):
    rows = [(i, "plain words in a row " * 4 if i % 2 else "noise ### $$$ %%% words " * 4, "s" if i < 2000 else "t") for i in range(4000)]
    got = mixing.mixture(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1, 15)).where("source = 's'").collect()
    full = [r["doc_id"] % 2 for r in got if r["taken"]]
    assert 0 < len(full) < 2000 and np.mean(full) > 0.7
