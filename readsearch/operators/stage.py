"""Tables written on the way, and columns that are computed once."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the cluster's
    ``spark.checkpoint.dir``.  Only a driver that is its own executor may go
    without one; its temporary folder goes when it ends."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if path is None and held.isDefined():
        path = held.get()
    if path is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="readsearch-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        path = f"file://{own}"
    if not held.isDefined():
        spark.sparkContext.setCheckpointDir(path)
    return path


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from there: later steps
    neither recompute it nor lose it with an executor.  Spark deletes the files
    with ``spark.cleaner.referenceTracking.cleanCheckpoints``."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fixed(rows: DataFrame, *names: str) -> DataFrame:
    """``rows`` with these columns computed once: Spark neither copies their
    expressions into each place that reads them nor moves a filter below them."""
    never = F.monotonically_increasing_id() < 0
    return rows.withColumns({n: F.when(never, F.lit(None)).otherwise(F.col(n)) for n in names})


def numbered(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``rows`` with their place from 1 in ``order``, whatever their number: the
    sorted rows are written once, and places are counted in that one table, by
    sorted range and within it.  Only a row per range meets in one task."""
    laid = stored(rows.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()))
    part, place = F.shiftright("_m", 33), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = laid.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    before = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_o"))
    counted = laid.withColumn("_p", part).join(F.broadcast(before), "_p", "left")
    offset = F.coalesce("_o", F.raise_error(F.lit("a sorted range was not counted")).cast("long"))
    return counted.withColumn(name, offset + place + 1).drop("_p", "_o", "_m")
