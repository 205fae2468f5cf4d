"""Connected components of a table of links, by alternating large and small stars.

A large star links every larger neighbour of a node to the node's least neighbour, a small
star every smaller one; both keep the components and shrink them towards stars around their
least members. The links are written to the shared folder after every round, so lineage stays
short and a lost executor costs one round. Groups combine before they are shuffled, and a hub
that a third of all links touch is a skewed join, which Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.base import materialize


def _star(links: DataFrame, small: bool) -> DataFrame:
    """One star operation; links have a > b."""
    if small:
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    else:
        both = links.select(F.explode(F.array(
            F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v"))
        )).alias("x")).select("x.*")
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    joined = both.join(least, "u")
    if small:
        own = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("u").alias("a"), F.col("m").alias("b"))
        )
    else:
        own = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return own.where("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the least node of its component, of every node of ``links`` (a, b) that is no root.

    Nodes are long integers; links of a node with itself and repeated links don't matter.
    """
    own = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    own = materialize(own, "links")
    mark = None
    while True:
        total = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        found = tuple(own.agg(F.count(F.lit(1)), total).first())
        if found == mark:
            return own.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = found
        own = materialize(_star(_star(own, small=False), small=True), "links")
