"""Reading dictionaries: legacy-encoded text to a table, and its cache."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kana import morae

SCHEMA = "word string, morae array<string>"
_HEADER = ";; okuri-nasi entries"


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def read_lines(spark: SparkSession, path: str, encoding: str = "euc_jp") -> DataFrame:
    """(line_no, line) of a text file that is a few MB: it is decoded whole, as Spark's readers lack its encoding."""
    found = spark.read.format("binaryFile").load(path).select("content").first()
    text = bytes(found["content"]).decode(encoding, errors="replace") if found else ""
    lines = [x.removesuffix("\r") for x in text.split("\n")]
    return spark.createDataFrame(pa.table({"line_no": pa.array(range(len(lines)), pa.int64()), "line": pa.array(lines, pa.string())}))


def parse(lines: DataFrame) -> DataFrame:
    """(word, morae) from (line_no, line): entries of the section without
    inflection; the first reading of a word, by line and place, wins."""
    header = lines.where(F.col("line").startswith(_HEADER)).agg(F.min("line_no").alias("n")).scalar()
    text = lines.where((F.col("line_no") > header) & (F.col("line") != "") & ~F.col("line").startswith(";") & F.col("line").contains(" "))
    split = text.select("line_no", morae(F.substring_index("line", " ", 1)).alias("morae"), F.regexp_replace(F.regexp_extract("line", r"^[^ ]* (.*)$", 1), "^/", "").alias("rest")).where(F.size("morae") > 0)
    each = split.select("line_no", "morae", F.posexplode(F.split("rest", "/")).alias("place", "c")).where((F.col("c") != "") & ~F.col("c").startswith("#"))
    words = each.withColumn("word", F.substring_index("c", ";", 1)).where("word <> ''")
    return words.groupBy("word").agg(F.min_by("morae", F.struct("line_no", "place")).alias("morae"))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    return parse(read_lines(spark, path))


def write_compiled(dictionary: DataFrame, path: str) -> None:
    """Writes the table sorted by word; writing what was read back changes nothing."""
    dictionary.select("word", "morae").orderBy("word").write.mode("overwrite").parquet(path)


def read_compiled(spark: SparkSession, path: str) -> DataFrame:
    """The table as written; a damaged file is an error of the reader."""
    return spark.read.schema(SCHEMA).parquet(path)


def _newest(spark: SparkSession, path: str):
    try:
        return spark.read.format("binaryFile").load(path).agg(F.max("modificationTime")).first()[0]
    except Exception as error:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise


def read_cached(spark: SparkSession, path: str, cache: str | None = None) -> DataFrame:
    """The dictionary of a text file through a compiled copy (by default beside
    it), which is used while it is no older than the text and is rebuilt
    otherwise.  No file gives an empty dictionary."""
    cache = cache or f"{path}.compiled"
    source = _newest(spark, path)
    if source is None:
        return empty(spark)
    kept = _newest(spark, cache)
    if kept is None or kept < source:
        write_compiled(read_text(spark, path), cache)
    return read_compiled(spark, cache)
