"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step sends every node's neighbours to the smallest node it knows; the
edges end as stars around the smallest node of each component, after a number
of rounds logarithmic in the component's size.  Every step is an aggregation
(combined before its shuffle) and a join whose skewed keys AQE splits; each
round is written to the shared folder, so lineage stays short and lost
executors cost one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _large(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "cc-least")
    return both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(e: DataFrame) -> DataFrame:
    least = materialise(e.groupBy("a").agg(F.min("b").alias("m")), "cc-least")
    rest = e.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.unionByName(least.withColumnRenamed("m", "b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) in any order -> (node, component): the smallest node reachable, for every node but the smallest itself."""
    e = materialise(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "cc-edges"
    )

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = None
    while (now := state(e)) != before and now[0]:
        before = now
        e = materialise(_small(_large(e)), "cc-edges")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
