"""The driver's contract: every query with SQL agrees with it on the small tables."""

import glob
import os

import pytest

SF = "/root/testdata/sf0.001"


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(r[i] for i in order)) for r in data)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_queries_agree_with_sql(spark):
    import duckdb

    from readsearch.plans import catalog

    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    sql = catalog.oracle_sql()
    for name, run in catalog.queries().items():
        got = run(spark, SF)
        if name in sql:
            want = con.execute(sql[name])
            assert rows(got.columns, got.collect()) == rows([c[0] for c in want.description], want.fetchall()), name
        else:
            assert got.count() >= 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_either_part_can_be_missing(monkeypatch):
    """The lookup queries stay, and what can be imported of the rest."""
    import importlib

    import __spark_entry__ as entry

    real, whole = importlib.import_module, set(entry.queries())
    for gone in ("corpus_pipeline", "readsearch.llm.registry"):

        def load(name, *rest, gone=gone):
            if name == gone:
                raise ModuleNotFoundError(f"No module named {name!r}", name="a_missing_wheel")
            return real(name, *rest)

        monkeypatch.setattr(importlib, "import_module", load)
        with pytest.warns(UserWarning, match="left out"):
            importlib.reload(entry)
        names = set(entry.queries())
        assert "combined_rank" in names and set(entry.oracle_sql()) <= names <= whole
        assert ("pipeline" not in names) if gone == "corpus_pipeline" else not any(n.startswith("op") for n in names)
        assert gone != "corpus_pipeline" or {n for n in whole if n.startswith("op")} <= names
    monkeypatch.undo()
    importlib.reload(entry)
    assert set(entry.queries()) == whole
