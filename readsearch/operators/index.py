"""Reading index: a text's sound units, and the characters each stands for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fuzzy import once
from ..functions.kana import katakana_to_hiragana, morae_with_spans
from .stage import fixed

_HIRA, _KATA, _KANJI = "ぁ-ゟ", "ァ-ヿ", "一-鿿"
#: Runs of one kind of character.  A long-vowel sign belongs to the run before it.
RUN = (
    rf"([\x00-\x7F][\x00-\x7Fー]*|[{_HIRA}][{_HIRA}ー]*|[{_KATA}]+|[{_KANJI}][{_KANJI}ー]*"
    rf"|[^\x00-\x7F{_HIRA}{_KATA}{_KANJI}][^\x00-\x7F{_HIRA}ァ-・ヽ-ヿ{_KANJI}]*)"
)
_UNITS = "array<struct<s: int, e: int, m: array<string>>>"
#: Dictionaries of up to this many words are broadcast, larger ones are joined by shuffle.
BROADCAST_WORDS = 400_000


def runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(RUN), F.lit(1))


def kind(run: Column) -> Column:
    """ascii, hiragana, katakana, kanji or other, by a run's first character."""
    out = F.lit("other")
    for name, chars in (("kanji", _KANJI), ("katakana", _KATA), ("hiragana", _HIRA), ("ascii", r"\x00-\x7F")):
        out = F.when(run.rlike(rf"^[{chars}]"), name).otherwise(out)
    return out


def _chars(run: Column) -> Column:
    return F.transform(F.split(run, ""), lambda c, i: F.struct(i.alias("s"), (i + 1).alias("e"), F.split(F.lower(c), "").alias("m"))).cast(_UNITS)


def _kana(run: Column) -> Column:
    return F.transform(morae_with_spans(katakana_to_hiragana(run)), lambda u: F.struct(u["s"].alias("s"), u["e"].alias("e"), F.array(u["m"]).alias("m"))).cast(_UNITS)


def longest_match(distinct_runs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(run, units): each run cut from the left into the longest words of
    ``dictionary`` (word, morae); characters that begin no word are skipped.
    Runs without any word are absent."""
    size = dictionary.agg(F.max(F.length("word")).alias("longest"), F.count("*").alias("n")).first()
    longest = size["longest"] or 0
    starts = distinct_runs.select("run", F.explode(F.sequence(F.lit(1), F.length("run"))).alias("at"))
    parts = starts.select("run", "at", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("run") - F.col("at") + 1))).alias("n")) if longest else starts.select("run", "at", F.lit(1).alias("n")).limit(0)
    words = F.broadcast(dictionary) if size["n"] <= BROADCAST_WORDS else dictionary
    found = parts.withColumn("word", F.substring(F.col("run"), F.col("at"), F.col("n"))).join(words, "word")
    best = found.groupBy("run", "at").agg(F.max_by(F.struct("n", "morae"), "n").alias("w"))
    hits = best.groupBy("run").agg(F.sort_array(F.collect_list(F.struct("at", F.col("w.n").alias("n"), F.col("w.morae").alias("morae")))).alias("hits"))
    begin = F.struct(F.lit(1).alias("next"), F.array().cast(_UNITS).alias("out"))

    def step(acc, h):
        unit = F.struct((h["at"] - 1).alias("s"), (h["at"] - 1 + h["n"]).alias("e"), h["morae"].alias("m"))
        taken = h["at"] >= acc["next"]
        return F.struct(F.when(taken, h["at"] + h["n"]).otherwise(acc["next"]).alias("next"), F.when(taken, F.concat(acc["out"], F.array(unit))).otherwise(acc["out"]).cast(_UNITS).alias("out"))

    return hits.select("run", F.aggregate("hits", begin, step)["out"].alias("units"))


def _assembled(text: Column, kanji: Column | None) -> Column:
    """The units of a text; ``kanji`` maps its kanji runs to theirs."""
    none = F.array().cast(_UNITS)

    def units(r):
        words = F.coalesce(F.try_element_at(kanji, r), none) if kanji is not None else none
        return once(kind(r), lambda k: F.when(k == "kanji", words).when(k.isin("hiragana", "katakana"), _kana(r)).otherwise(_chars(r)))

    def placed(parts):
        ends = F.aggregate(parts, F.array(F.lit(0)), lambda acc, r: F.concat(acc, F.array(F.element_at(acc, F.lit(-1)) + F.length(r))))
        runs_at = F.arrays_zip(parts.alias("r"), F.slice(ends, F.lit(1), F.size(parts)).alias("o"))
        return F.flatten(F.transform(runs_at, lambda x: F.transform(units(x["r"]), lambda u: F.struct((u["s"] + x["o"]).alias("s"), (u["e"] + x["o"]).alias("e"), u["m"].alias("m")))))

    return once(runs(text), placed)


def _indexed(items: DataFrame, names: list[str], units: Column) -> DataFrame:
    free = _free(names, "_units")
    rows = fixed(items.withColumn(free, units), free)
    morae = F.flatten(F.transform(free, lambda u: u["m"]))
    segments = F.transform(free, lambda u: F.struct(u["s"].alias("char_start"), u["e"].alias("char_end"), F.size(u["m"]).alias("morae_len")))
    mine = [c for c in names if c not in ("morae", "segments")]
    return fixed(rows.select(*[F.col(f"`{c}`") for c in mine], morae.alias("morae"), segments.alias("segments")), "morae", "segments")


def _free(names: list[str], name: str) -> str:
    while name in names:
        name = f"_{name}"
    return name


def with_index(items: DataFrame, id_col: str, text_col: str, dictionary: DataFrame | None = None) -> DataFrame:
    """``items`` with ``morae`` and ``segments`` of their text, in place of columns of those names.

    Null texts count as empty; ids may be null or repeat.  Only items with kanji
    take part in the join with the dictionary.  Without a dictionary there is
    no join and kanji have no reading.
    """
    names = items.columns
    text = F.coalesce(F.col(text_col), F.lit(""))
    if dictionary is None:
        return _indexed(items, names, _assembled(text, None))
    key, kanji = _free(names, "_id"), _free(names, "_kanji")
    mine = items.where(text.rlike(f"[{_KANJI}]")).select(F.col(id_col).alias(key), F.explode(F.filter(runs(text), lambda r: kind(r) == "kanji")).alias("run")).distinct()
    resolved = longest_match(mine.select("run").distinct(), dictionary)
    maps = mine.join(resolved, "run").groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("run", "units"))).alias(kanji))
    return _indexed(items.join(maps, F.col(id_col).eqNullSafe(F.col(key)), "left"), names, _assembled(text, F.col(kanji)))


def add_items(index: DataFrame, new: DataFrame, id_col: str, text_col: str, dictionary: DataFrame | None = None) -> DataFrame:
    """An index with new items; only those are read."""
    return index.unionByName(with_index(new, id_col, text_col, dictionary).select(*index.columns))


def remove_items(index: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    """An index without the items whose ids are in ``gone``."""
    return index.join(gone.select(id_col), id_col, "left_anti")
