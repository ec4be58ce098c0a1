"""Connected components of a graph that is only ever held as a table.

Each round maps every node to the neighbour (or itself) that comes first in a
hashed order and replaces the graph by the one between those images.  Images
stay in their node's component and edges map to edges, so connectivity is
kept; the hashed order makes a round shrink any graph, long chains included,
by a constant factor in expectation, so the number of rounds is logarithmic.
Every join is between two stored tables, which lets Spark split a hub's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _first(node: str):
    return F.struct(F.xxhash64(node).alias("o"), F.col(node).alias("n"))


def roots(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a long, b long).

    Rows with a null or with a = b count for nothing; repeated edges count
    once; an empty table gives an empty one.
    """
    left = stored(edges.select("a", "b").where("a <> b").distinct())
    images: list[DataFrame] = []
    while not left.isEmpty():
        both = left.select("a", "b").unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        image = stored(both.groupBy("a").agg(F.min(_first("b")).alias("m")).select(F.col("a").alias("node"), F.least(_first("a"), F.col("m"))["n"].alias("root")))
        images.append(image)
        left = stored(
            left.join(image.withColumnsRenamed({"node": "a", "root": "ra"}), "a")
            .join(image.withColumnsRenamed({"node": "b", "root": "rb"}), "b")
            .where("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
            .distinct()
        )
    if not images:
        return edges.select(F.col("a").cast("long").alias("node"), F.col("b").cast("long").alias("root")).limit(0)
    out = images[0]
    for image in images[1:]:
        step = image.select(F.col("node").alias("root"), F.col("root").alias("to"))
        out = stored(out.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root")))
    return out
