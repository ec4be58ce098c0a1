"""Entry tables: from store files, and from pages and their use events."""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import page_title
from ..operators.stage import fixed
from ..operators.store import SCHEMA


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a store file (TOML, key ``bookmarks``), numbered as listed.  A
    missing key gives none; a file that can't be parsed is an error."""
    found = spark.read.format("binaryFile").load(path).select("content").first()
    rows = tomllib.loads(bytes(found["content"]).decode()).get("bookmarks", []) if found else []
    return spark.createDataFrame([(i, r["type"], r["title"], r.get("url"), r.get("command"), r.get("args"), int(r.get("access_count", 0))) for i, r in enumerate(rows)], SCHEMA)


def write_entries(entries: DataFrame, path: str) -> None:
    """Writes a full copy; a store under 100 TB is rewritten into a new folder, never in place."""
    entries.write.mode("errorifexists").parquet(path)


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def page_entries(pages: DataFrame, events: DataFrame, bare: bool = True) -> DataFrame:
    """Pages as bookmarks whose use count is the number of events of the user with
    the page's id.  ``bare`` as in ``unescape_html``."""
    uses = events.groupBy(F.col("user_id").alias("entry_id")).agg(F.count("*").alias("access_count"))
    rows = fixed(pages.select(
        F.col("page_id").alias("entry_id"), F.lit("bookmark").alias("type"), page_title(F.col("html"), bare).alias("title"), "url",
        F.lit(None).cast("string").alias("command"), F.lit(None).cast("array<string>").alias("args"),
    ), "title")
    return rows.join(uses, "entry_id", "left").withColumn("access_count", F.coalesce("access_count", F.lit(0)).cast("long"))
