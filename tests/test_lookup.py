"""The lookup engine: vectors, an independent model on random strings, edge cases, plans."""

import random

import pytest
from pyspark.sql import functions as F

from readsearch.functions import fuzzy, kana, match, query, text
from readsearch.functions.tables import DIGRAPH, SINGLE, TOKENS
from readsearch.operators import complete, highlight, index, rank, stage, store
from readsearch.plans import catalog
from readsearch.plans import fixtures as X
from readsearch.sources import dictionary, entries, listing
from readsearch.streaming.opens import open_counts

STORE = "entry_id long, type string, title string, url string, command string, args array<string>, access_count long"


def model_morae(s):
    """Reads a hiragana string one sign at a time."""
    out, i = [], 0
    known = SINGLE | DIGRAPH
    while i < len(s):
        for skip in (1, 0):
            if skip and s[i] != "っ":
                continue
            unit = next((s[i + skip : i + skip + n] for n in (2, 1) if s[i + skip : i + skip + n] in known and len(s[i + skip : i + skip + n]) == n), None)
            if unit:
                out.append((known[unit][0] if skip else "") + known[unit])
                i += skip + len(unit)
                break
        else:
            if s[i] == "ー" and out:
                out.append(out[-1][-1])
            i += 1
    return out


def test_tables():
    assert (len(SINGLE), len(DIGRAPH), len(TOKENS)) == (81, 62, 131)


def test_random_kana(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("かきしちゃゅょっーんあいゐばぴてぃ") for _ in range(rng.randrange(12))) for _ in range(300)]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", kana.morae(F.col("w")).alias("m")).collect()
    assert all(r["m"] == model_morae(r["w"]) for r in got)


def test_query_column_equals_driver(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("aiueokkstnhgyj") for _ in range(rng.randrange(10))) for _ in range(300)] + list(X.QUERIES)
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", query.decode_column(F.col("w")).alias("m")).collect()
    assert all(r["m"] == query.decode(r["w"]) for r in got)
    assert all(",".join(query.decode(q)) == m for q, m in X.QUERIES.items())


def test_catalog_matches_fixtures(spark):
    q = catalog.queries()
    assert {r["kana"]: r["morae"] for r in q["kana_to_morae"](spark, "").collect()} == X.KANA
    assert {r["word"]: r["morae"] for r in q["dictionary_first_wins"](spark, "").collect()} == X.DICTIONARY
    assert {r["run"]: r["words"] for r in q["longest_match"](spark, "").collect()} == {k: v for k, v in X.RUNS.items() if v}
    got = {(r["text"], r["query"]): (r["m"] and tuple(r["m"]) or (None, None, None), ",".join(map(str, r["lit"]))) for r in catalog._matches(spark).collect()}
    assert got == {(t, w): ((p, s, c), lit) for t, w, p, s, c, lit in X.MATCHES}


def test_index_of_mixed_text(spark):
    d = catalog._dictionary(spark)
    rows = spark.createDataFrame([(1, "A研究会ー"), (2, None), (3, ""), (4, "人々"), (5, "İx")], "id long, t string")
    got = {r["id"]: (r["morae"], [tuple(s) for s in r["segments"]]) for r in index.with_index(rows, "id", "t", d).collect()}
    assert got[1] == (["a", "ke", "n", "kyu", "u"], [(0, 1, 1), (1, 3, 4)])
    assert got[2] == got[3] == ([], [])
    assert got[4] == (["々"], [(1, 2, 1)])
    assert got[5][1][0][2] == len(got[5][0]) - 1
    bare = index.with_index(rows, "id", "t")
    assert bare.where("id = 1").first()["morae"] == ["a"]
    more = index.add_items(bare, spark.createDataFrame([(9, "か")], "id long, t string"), "id", "t")
    assert {r["id"] for r in index.remove_items(more, spark.createDataFrame([(1,)], "id long"), "id").collect()} == {2, 3, 4, 5, 9}


def test_dictionary_files(spark, tmp_path):
    path = tmp_path / "dict.txt"
    assert dictionary.read_cached(spark, str(path)).isEmpty()
    path.write_bytes("\n".join(X.DICTIONARY_LINES).encode("euc_jp"))
    for _ in range(2):
        assert {r["word"]: ",".join(r["morae"]) for r in dictionary.read_cached(spark, str(path)).collect()} == X.DICTIONARY
    part = next((tmp_path / "dict.txt.compiled").glob("part-*.parquet"))
    part.write_bytes(part.read_bytes()[:40])
    (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    with pytest.raises(Exception, match="(?i)parquet"):
        dictionary.read_compiled(spark, str(tmp_path / "dict.txt.compiled")).collect()
    assert dictionary.parse(spark.createDataFrame([(0, "けん /件/")], "line_no long, line string")).isEmpty()


def _entries(spark, rows):
    return index.with_index(spark.createDataFrame(rows, STORE), "entry_id", "title", catalog._dictionary(spark))


def test_modes(spark):
    e = _entries(spark, [(0, "bookmark", "言", "https://x.com", None, None, 3), (1, "app", "Foobar", None, "run", ["a", "b"], 5), (2, "bookmark", "GitHub", "https://example.com", None, None, 5)])
    ids = lambda *a, **k: [r["entry_id"] for r in rank.search(e, *a, **k).orderBy("rank").collect()]
    assert ids("") == [1, 2, 0] and ids("", "fuzzy", limit=2) == [1, 2]
    assert ids("gen") == [0] and ids("gen", "fuzzy") == [] and ids("gen", "reading") == [0]
    assert ids("Fbr") == [1] and ids("Fbr", "reading") == []
    assert ids("gen", indexed=False) == [] and ids("gen", "reading", indexed=False) == []
    assert ids("gh", "fuzzy") == [2] and ids("zzz") == []
    with pytest.raises(ValueError):
        rank.search(e, "x", "other")
    same = _entries(spark, [(0, "bookmark", "Test", "https://example.com", None, None, 1), (1, "bookmark", "Test", "https://example.com", None, None, 100)])
    assert [r["entry_id"] for r in rank.search(same, "Test").orderBy("rank").collect()] == [1, 0]
    shown = highlight.display_rows(rank.hits(e, rank.search(e, "Fbr")), "Fbr").first()
    assert shown["prefix"] == "   5 " and shown["suffix"] == " a b"
    assert [tuple(s) for s in shown["title_spans"]] == [(0, 1, True), (1, 3, False), (3, 4, True), (4, 5, False), (5, 6, True)]
    lit = e.where("entry_id = 2").select(highlight.title_positions("gh").alias("a"), highlight.title_positions("xyz").alias("b"), highlight.title_positions("").alias("c")).first()
    assert lit["a"] == [0, 3] and lit["b"] == [] and lit["c"] == []
    assert rank.search(e.limit(0), "a").count() == 0


def test_unlimited_rank_is_complete(spark):
    rows = spark.range(5000).select(F.col("id"), (F.col("id") * 7919 % 1000).alias("k"))
    got = rank.ranked(rows, [F.desc("k"), F.asc("id")], None).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 5001))
    assert [(r["k"], r["id"]) for r in got] == sorted(((r["k"], r["id"]) for r in got), key=lambda x: (-x[0], x[1]))


def test_unlimited_rank_of_wide_rows(spark):
    """Default shuffle settings and a payload that the sort key alone does not have."""
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        rows = spark.range(200_000).select(F.concat(F.lit("n"), F.md5(F.col("id").cast("string"))).alias("name"), F.lit(False).alias("is_dir"), F.repeat(F.md5(F.col("id").cast("string")), 12).alias("payload"))
        got = rank.ranked(rows, [F.asc("name")], None)
        assert tuple(got.agg(F.count("*"), F.min("rank"), F.max("rank"), F.countDistinct("rank")).first()) == (200_000, 1, 200_000, 200_000)
        assert got.columns == [*rows.columns, "rank"] and got.where(F.length("payload") != 384).isEmpty()
        got = complete.candidates(rows, "", limit=None).orderBy("rank")
        assert [r["name"] for r in got.limit(500).collect()] == [r["name"] for r in rows.orderBy("name").limit(500).collect()]
        assert tuple(got.agg(F.max("rank"), F.countDistinct("rank")).first()) == (200_000, 200_000)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert rank.ranked(rows.limit(0), [F.asc("name")], None).isEmpty()


def test_query_table_equals_single_queries(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("かきちゃんabi oAIN人事研究") for _ in range(rng.randrange(10))) for _ in range(60)] + [None, ""]
    asked = ["ka", "kan", "chi", "io", "AI", "o", "b", "i o", "jin", "kenkyuu", "zz", "ab", "nb"]
    items = index.with_index(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), "id", "t", catalog._dictionary(spark))
    table = spark.createDataFrame([(q,) for q in [*asked, "ka", "", None]], "q string")
    one = lambda q: [(q, *r) for r in rank.index_search(items, q, "id", "t").collect()]
    want = sorted(x for q in asked for x in one(q))
    assert want == sorted(map(tuple, rank.table_search(items, table, "id", "t", "q").collect()))
    assert want == sorted(map(tuple, rank.batch_search(items, asked, "id", "t").collect())) and len({x[2] for x in want}) == 2
    assert rank.table_search(items, table.limit(0), "id", "t", "q").isEmpty() and rank.table_search(items.limit(0), table, "id", "t", "q").isEmpty()


def test_titles(spark):
    import html

    rng = random.Random(4)
    bits = ["&", "&amp;", "&#8217;", "&#x2014;", "&mdash;", "&eacute", "&notit;", "&#0;", "&#x80;", "&#55296;", "&#99999999999;", "a", ";", "&lt;b", "&#x1F600;", "&copy", "&unknown;", "&#;", "x&y"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 8))) for _ in range(400)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.unescape_html(F.col("t")).alias("u")).collect()
    assert all(r["u"] == html.unescape(r["t"]) for r in got)
    given = spark.createDataFrame([*X.TITLES, (None, ""), ("<style>" + "<" * 200_000, "")], "html string, title string")
    assert all(r["title"] == r["t"] for r in given.select("title", text.page_title(F.col("html")).alias("t")).collect())


def test_index_keeps_columns_and_rows_without_id(spark):
    rows = spark.createDataFrame([(None, "研究", 7, "m"), (None, "人事", 8, "n"), (1, "言", 9, "o")], "id long, t string, _id long, morae string")
    got = index.with_index(rows, "id", "t", catalog._dictionary(spark))
    assert sorted(got.columns) == ["_id", "id", "morae", "segments", "t"]
    assert {r["_id"]: r["morae"] for r in got.collect()} == {7: ["ke", "n", "kyu", "u"], 8: ["ji", "n", "ji"], 9: ["ge", "n"]}


def test_stage_wants_a_shared_folder_on_a_cluster():
    class Session:
        conf = {}
        sparkContext = type("C", (), {"master": "spark://host:7077", "_jsc": type("J", (), {"sc": staticmethod(lambda: type("S", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isDefined": staticmethod(lambda: False)}))}))})})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        stage.shared_dir(Session)


def test_completion(spark):
    rows = spark.createDataFrame(X.LISTING, "name string, is_dir boolean")
    d = dictionary.empty(spark)
    names = lambda *a: [r["name"] for r in complete.candidates(rows, *a, d).orderBy("rank").collect()]
    assert names("", "dir") == ["Documents", "alpha", "app", "zeta", "アプリ"]
    for leaf in ("te", "tes", "test"):
        assert set(names(leaf, "file")) == {"test.txt", "テスト.txt"}
    assert complete.candidates(rows, "", "any", None, "p/", 2).count() == 2
    with pytest.raises(ValueError):
        complete.by_kind(rows, "link")


def test_store(spark, tmp_path):
    base = spark.createDataFrame([(0, "bookmark", "A", "u://a", None, None, 1), (4, "app", "B", None, "b", ["x"], 2)], STORE)
    pages = spark.createDataFrame([("u://a", "<title>no</title>"), ("u://n/x", "<p>"), ("u://n/x", None), (None, "x"), ("u://t", "<html><TITLE lang=x> T&amp;amp;\n</TITLE>")], "url string, html string")
    added = store.add_if_absent(base, pages)
    assert sorted((r["entry_id"], r["title"]) for r in added.collect()) == [(0, "A"), (4, "B"), (5, "n"), (6, "T&amp;")]
    up = store.increment(added, spark.createDataFrame([(4,), (4,), (77,), (None,)], "entry_id long"))
    assert {r["entry_id"]: r["access_count"] for r in up.collect()} == {0: 1, 4: 4, 5: 0, 6: 0}
    left = store.delete(up, spark.createDataFrame([(0,), (99,)], "entry_id long"))
    assert sorted((r["ordinal"], r["entry_id"]) for r in store.ordinals(left).collect()) == [(0, 4), (1, 5), (2, 6)]
    toml = tmp_path / "s.toml"
    toml.write_text('[[bookmarks]]\ntype = "bookmark"\ntitle = "t"\nurl = "u"\naccess_count = 2\n[[bookmarks]]\ntype = "app"\ntitle = "p"\ncommand = "c"\nargs = ["1"]\naccess_count = 0\n')
    got = entries.read_store(spark, str(toml)).collect()
    assert [(r["entry_id"], r["type"], r["args"]) for r in got] == [(0, "bookmark", None), (1, "app", ["1"])]
    entries.write_entries(left, str(tmp_path / "out"))
    assert entries.read_entries(spark, str(tmp_path / "out")).count() == 3
    toml.write_text("not toml = = ")
    with pytest.raises(Exception, match="(?i)invalid|expected"):
        entries.read_store(spark, str(toml))


def test_small_functions(spark, tmp_path):
    one = spark.range(1)
    show = lambda c: one.select(c.alias("x")).first()["x"]
    for url, title, expected in X.ADDRESSES:
        assert show(text.title_or_domain(F.lit(title), F.lit(url))) == expected
    for q, n, expected in (("a.b", 0, True), ("a.b", 1, False), (" ", 0, False), ("http://x", 0, True), ("word", 0, False)):
        assert show(text.url_like(F.lit(q), F.lit(n))) is expected
    assert show(text.count_prefix(F.lit(123456))) == "123456 " and text.mode_label("combined", False).endswith("(dict missing)") and text.sort_label("by_count") == "Count"
    assert show(text.page_title(F.lit(None).cast("string"))) == ""
    assert show(fuzzy.fuzzy_score(fuzzy.fuzzy_positions(F.lit("Foobar"), "Fbr"))) == 297
    assert show(fuzzy.fuzzy_positions(F.lit(None).cast("string"), "a")) is None
    assert show(match.plain_start(F.lit("ab"), "")) is None
    (tmp_path / "d").mkdir()
    (tmp_path / ".h").write_text("")
    assert {tuple(r) for r in listing.list_directory(spark, str(tmp_path)).collect()} == {("d", True), (".h", False)}
    assert listing.list_directory(spark, str(tmp_path / "no")).isEmpty() and listing.folder_of("/a", "b/") == "/a/b/"


def test_plans(spark):
    e = spark.range(100).select(F.col("id").alias("entry_id"), F.lit("bookmark").alias("type"), F.lit("the title").alias("title"), F.lit("u").alias("url"), F.lit("").alias("command"), F.col("id").alias("access_count"))
    top = rank.search(index.with_index(e, "entry_id", "title"), "the", limit=10)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "CartesianProduct" not in plan and "Python" not in plan


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    spark.sql("select timestamp'2024-01-01 00:10:00' ts, 1L user_id union all select timestamp'2024-01-01 00:20:00', 1L union all select timestamp'2024-01-01 03:00:00', 2L").write.parquet(str(src))
    stream = spark.readStream.schema("ts timestamp, user_id long").parquet(str(src))
    q = open_counts(stream).writeStream.outputMode("append").format("memory").queryName("opens").start()
    q.processAllAvailable()
    q.stop()
    assert [(r["entry_id"], r["opens"]) for r in spark.sql("select * from opens").collect()] == [(1, 2)]
