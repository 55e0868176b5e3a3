"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.plans.tables import materialize


def _is_star(edges: DataFrame) -> bool:
    """Whether every ``hi`` has one edge and no ``lo`` is a ``hi`` elsewhere."""
    if not edges.groupBy("hi").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return False
    return edges.join(edges.select(F.col("hi").alias("lo")), "lo", "left_semi").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b) that is not the smallest of its component.

    Nodes may be of any orderable type. A step moves edges to the smallest neighbour, so a hot node is
    only ever aggregated map-side or joined to one row; every step is a written table.
    """
    lo, hi = F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")
    current = materialize(edges.where("a != b").select(hi, lo).distinct(), "edges")
    while not _is_star(current):
        smallest = (
            current.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
            .unionByName(current.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
            .groupBy("u")
            .agg(F.min("v").alias("v"))
            .select(F.col("u").alias("lo"), F.least("u", "v").alias("m"))
        )
        large = current.join(smallest, "lo").select("hi", F.col("m").alias("lo")).distinct()
        large = materialize(large, "large-star")
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(least, "hi")
            .where("lo != m")
            .select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .unionByName(least.select("hi", F.col("m").alias("lo")))
            .distinct()
        )
        current = materialize(small, "small-star")
    return current.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
