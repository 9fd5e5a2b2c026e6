"""Connected components by alternating large-star and small-star steps.

Each step is an aggregate and an equi-join on the edge list, so hub nodes are split by adaptive execution and nothing
is gathered on the driver but a count of nodes. Every round is cut, by a checkpoint or as the caller says. Edges that are stars
already would come out of a round as they are, so that rounds end when all are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.sources.shared import cut


def components(edges: DataFrame, put: Callable[[DataFrame], DataFrame] = cut, drop: Callable[[DataFrame], None] = lambda _: None) -> DataFrame:
    """id, component (the least id reachable) for every node of ``edges`` (a, b: long) that some other node is joined with."""
    now = put(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while _unsettled(now):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(least.select("u", F.col("m").alias("v"))).distinct()
        after = put(small)
        drop(now)
        now = after
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )


def _unsettled(edges: DataFrame) -> int:
    """How many nodes keep ``edges`` from being stars: those above more than one node, or both above and below others."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select(F.col("v").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    nodes = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.agg(F.count_if((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()[0]
