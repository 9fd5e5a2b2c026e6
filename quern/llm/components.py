"""Connected components whose rounds are cut by staged tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quern.operators.components import components as joined

from .staging import Stages


def components(edges: DataFrame, stages: Stages) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long); component is the least node reachable."""
    return joined(edges, lambda df: stages.put(df, "star"), stages.drop).withColumnRenamed("id", "node")
