"""Entire licence texts as they lie in files: wrapped, with notices."""

import textwrap

from readsearch.llm import license


def wrapped(text, width):
    """Paragraphs wrapped anew; one with a copyright notice keeps its lines."""
    parts = text.split("\n\n")
    return "\n\n".join(p if "copyright (c)" in p.lower() or "copyright [" in p.lower() else textwrap.fill(" ".join(p.split()), width, break_long_words=False, break_on_hyphens=False) for p in parts)


def scanned(spark, texts, **more):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["license"] for r in sorted(license.scan(rows, **more).collect(), key=lambda r: r["doc_id"])]


def test_wrapped_texts(spark):
    given = [(name, wrapped(text, width)) for name, text in license.TEXTS.items() for width in [*range(40, 100, 3), 120]]
    assert any("\ncopyright" in t for _, t in given)
    assert scanned(spark, [t for _, t in given]) == [name for name, _ in given]


def test_notices_are_dropped_and_prose_is_not(spark):
    isc = license.TEXTS["ISC"]
    broken = isc.replace("above copyright notice", "above\ncopyright notice")
    heads = ["Copyright (c) 2020, A B", "Copyright © 2020 A", "Copyright 2019-2024 A B <a@b.c>", "(c) 2020 A", "© A B", "Copyright: 2020 A", "Copyright A B and contributors", "Copyright (c) 2001 A\nCopyright (c) 2002 B", "\n Copyright A\n\n", "\n" * 50000, "Copyright A\n" * 20000]
    assert scanned(spark, [h + "\n\n" + broken for h in heads]) == ["ISC"] * len(heads)
    assert scanned(spark, [h + "\r\n" + broken.replace("\n", "\r\n") for h in heads]) == ["ISC"] * len(heads)
    without = broken.replace("\ncopyright notice and this permission notice appear in all copies.", "\n")
    assert without != broken and scanned(spark, [without]) == [None]


def test_table_of_texts(spark):
    given = license.texts()
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0"} <= {n for n, _ in given}
    assert scanned(spark, [t for _, t in given]) == [n for n, _ in given]
    known = license.known(spark)
    assert len(known) == len(given) and all(hinted for _, _, hinted in known)


def test_scan_equals_sql(spark, tmp_path):
    """Texts of all known licences, wrapped, titled, changed, beside notices and others."""
    import duckdb

    rows = [t for _, t in license.texts()] + [wrapped(t, w) for t in license.TEXTS.values() for w in range(60, 101, 9)]
    rows += ["Copyright A B\nAll rights reserved.\n\n" + t for t in license.TEXTS.values()] + ["A Title Without The Word\n\n" + t for t in license.TEXTS.values()]
    rows += [t + "\nmore" for t in license.TEXTS.values()] + ["text\nReleased  under the MIT Licence!\nAll rights reserved.", " All rights reserved ", "license", "", None, "\n\n", "MIT License\n\n", "é licence"]
    spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(license.OP8_SQL).fetchall()
    got = [tuple(r) for r in license.op8_license(spark, str(tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert sum(r[1] is not None for r in got) >= len(license.texts()) + 6 * len(license.TEXTS) and not any(r[1] and "proprietary" in r[2] for r in got)


def test_empty_and_repeated(spark):
    rows = spark.createDataFrame([(1, license.TEXTS["MIT"])] * 2 + [(None, None)], "doc_id long, text string")
    assert [r["license"] for r in license.scan(rows).orderBy("doc_id").collect()] == [None, "MIT", "MIT"]
    assert license.scan(rows.limit(0)).isEmpty() and license.scan(rows, table_=[]).where("license IS NOT NULL").isEmpty()


def test_titles_and_rights(spark):
    t = license.TEXTS
    rows = [
        ("ISC", "ISC License\n\nCopyright (c) 2020 A\n\n" + t["ISC"]), ("ISC", "The ISC License (ISC)\n=================\n\n" + t["ISC"]),
        ("BSD-3-Clause", "BSD 3-Clause License\n\nCopyright (c) 2020, A\nAll rights reserved.\n\n" + wrapped(t["BSD-3-Clause"], 78)), ("BSD-2-Clause", "Copyright (c) 2020, A\nAll rights reserved.\n\n" + t["BSD-2-Clause"]),
        ("Zlib", "zlib License\n\n(C) 2020 A\n\n" + t["Zlib"]), ("MIT", t["MIT"].split("\n\n", 1)[1]), ("MIT", "The MIT License (MIT)\n\n" + t["MIT"].split("\n\n", 1)[1]), ("0BSD", "Zero-Clause BSD\n\n" + t["0BSD"]),
        (None, "MIT License\n\n"), (None, "All rights reserved."), (None, "BSD License\n\nsomething else"),
    ]
    assert scanned(spark, [x for _, x in rows]) == [n for n, _ in rows]


def test_own_table(spark):
    own = [("Own", "Do as you like.\n\nReally."), ("Own-2", "A license to do nothing.")]
    assert scanned(spark, ["do as you\nlike - really", "a LICENCE to do nothing", license.TEXTS["MIT"], None], table_=own) == ["Own", "Own-2", None, None]
    assert scanned(spark, ["a LICENCE to do nothing", "x"], table_=own[1:]) == ["Own-2", None]
