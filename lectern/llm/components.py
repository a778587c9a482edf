"""Connected components of an edge table by alternating large and small stars.

Both steps are grouped minima and equality joins, so no node's neighbours are ever
gathered in one place, and the edges stay in the cluster's shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import durable


def _oriented(e: DataFrame) -> DataFrame:
    return e.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return _oriented(both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small(e: DataFrame) -> DataFrame:
    low = e.groupBy("a").agg(F.min("b").alias("m"))
    moved = e.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _oriented(moved.union(low.select("a", F.col("m").alias("b"))))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node with an edge to another; root: the smallest node of
    its component.  Null ends and loops are no edges.  An empty table gives an empty one."""
    e = durable(_oriented(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).dropna()))
    before = None
    while True:
        now = e.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if now == before or not now[0]:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        before = now
        e = durable(_small(_large(e)))
