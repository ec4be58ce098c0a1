"""The pipeline and the registered queries against SQL and brute force on the small tables."""

import glob
import hashlib
import os
import subprocess
import sys

import numpy as np
import pytest

import corpus_pipeline
from readsearch.llm import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def text(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(r[i] for i in order)) for r in data)


def test_queries_agree_with_sql(spark):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    queries = registry.queries()
    for name, sql in registry.oracle_sql().items():
        got, want = queries[name](spark, SF), con.execute(sql)
        assert text(got.columns, got.collect()) == text([c[0] for c in want.description], want.fetchall()), name


def five_words(text):
    w = text.lower().encode().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_pipeline_equals_brute_force(spark):
    from tokenizers import Tokenizer

    from readsearch.llm import bpe, mixing, quality

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r["doc_id"] for r in quality.apply_policy(quality.ledger(docs)).where("kept").collect()}
    rows = [r.asDict() for r in docs.collect() if r["doc_id"] in kept]
    seen, unique = set(), []
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        key = " ".join(r["text"].split())
        if key not in seen:
            seen.add(key)
            unique.append(r)
    sets = [five_words(r["text"]) for r in unique]  # the stage's contract: five words, a similarity of 0.8 or more
    group = list(range(len(unique)))
    for i in range(len(unique)):
        for j in range(i):
            if group[i] != group[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = min(group[i], group[j]), max(group[i], group[j])
                group = [a if g == b else g for g in group]
    near = [r for i, r in enumerate(unique) if group[i] == i]
    taken = {r["doc_id"]: (r["size"], r["taken"]) for r in mixing.mixture(spark.createDataFrame(near, docs.schema)).collect()}
    library = Tokenizer.from_file(bpe.public_path())
    want = []
    for r in near:
        size, n = taken[r["doc_id"]]
        while n > 0:
            t = r["text"] if n >= size else " ".join(r["text"].split()[:n])
            ids = library.encode(t, add_special_tokens=False).ids
            want.append((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
            n -= size
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == sorted(want)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "mix_sources", "tokenize"]


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = docs.limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, out, SF)
        assert out.count() == 0
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
            out = spark.createDataFrame([], out.schema)


def test_stages_on_odd_rows(spark):
    """Null ids, texts and sources, repeated rows, ties, a very long text, and clashing columns."""
    plain = " ".join(f"word{i} and others" for i in range(40))
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(None, plain, "en", "a"), (None, plain, "en", "a"), (5, plain, "en", None), (4, plain + " ", "en", "b"), (6, None, None, None), (7, "", "en", "a"), (8, long, "en", "b"), (8, long, "en", "b"), (9, plain + " more", "en", "a"), (None, None, None, None)]
    names = "doc_id long, text string, lang string, source string, n_words long, _doc string, th string, node long, _k double, rank long"
    docs = spark.createDataFrame([(*r, i, "x", "y", 3, 0.5, 1) for i, r in enumerate(rows)], names)
    kept, out = [], docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, "")
        if name != "tokenize":
            assert out.columns == docs.columns, name
        kept.append(sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in out.collect()))
    assert kept[:3] == [[-1, -1, 4, 5, 8, 8, 9], [4, 5, 8, 9], [4, 8]]
    assert set(kept[3]) <= {4, 8} and len(kept[4]) == len(kept[3])


def test_workers_need_not_have_the_package(tmp_path):
    """All ten queries and the pipeline from a folder, and with workers, that can't import the package."""
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    script = f"""
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
def absent(_):
    try:
        import readsearch
        return [1]
    except ModuleNotFoundError:
        return [0]
assert spark.sparkContext.parallelize([0], 1).mapPartitions(absent).collect() == [0]
import __spark_entry__ as e
for name, run in e.queries().items():
    if name.startswith("op") or name == "pipeline":
        assert run(spark, {SF!r}).count() > 0, name
        print("ran", name, flush=True)
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert out.stdout.count("ran ") == 11, out.stdout + out.stderr[-3000:]
