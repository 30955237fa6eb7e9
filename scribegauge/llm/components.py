"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def _with_least(edges: DataFrame) -> DataFrame:
    """edges (u, v) plus m, the least of u and its neighbours. Both sides of the join are dealt by it alone, so that
    adaptive execution can split a node with very many neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.bitwise_not("u").alias("other"), F.least("u", "m").alias("m"))
    return edges.join(least, F.bitwise_not("u") == F.col("other")).drop("other")


def components(edges: DataFrame) -> DataFrame:
    """(u, root): every node of edges (u long, v long) that isn't its component's least node, and that least node.

    Each round is written to the shared folder. Nulls are ignored, loops and repeated edges are harmless, no edges give
    no rows.
    """
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "components")
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = written(_with_least(both).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "components")
        small = _with_least(large)
        linked = small.select("u", F.col("m").alias("v")).unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        before, now = now, written(linked.where("u <> v").distinct(), "components")
        discard(before, large)
        # a star: no node points at two others, and no node that points is pointed at
        ends = now.select("u", F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(now.select(F.col("v").alias("u"), F.lit(0).alias("out"), F.lit(1).alias("into")))
        if ends.groupBy("u").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out + into > 1").isEmpty():
            return now.select("u", F.col("v").alias("root"))
