"""The labels that the language model learns."""

import zlib

from readsearch.llm import langid


def test_every_label_of_rows_not_held_out_is_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_LANGS", 1)
    ids = {held: [i for i in range(400) if (zlib.crc32(str(i).encode()) % 4 == 2) == held] for held in (True, False)}
    rows = [(i, "held out words", "held") for i in ids[True]] + [(i, "some words " * 5, ("aa", "bb", "cc")[k % 3]) for k, i in enumerate(ids[False])]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert list(model.langs) == ["aa", "bb", "cc"]
