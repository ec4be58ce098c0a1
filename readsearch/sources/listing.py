"""Directory listings for completion."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def list_directory(spark: SparkSession, path: str) -> DataFrame:
    """(name, is_dir) of a folder of the driver, hidden names included, links
    not followed; one that can't be read is empty."""
    try:
        with os.scandir(path) as found:
            rows = [(x.name.encode(errors="surrogateescape").decode(errors="replace"), x.is_dir(follow_symlinks=False)) for x in found]
    except OSError:
        rows = []
    return spark.createDataFrame(rows, "name string, is_dir boolean")


def folder_of(cwd: str, prefix: str) -> str:
    return os.path.join(cwd, prefix) if prefix else cwd
