"""Aggregates, quantile bins and scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .names import unused
from .quantiles import quantiles, with_quantiles


def describe(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """A row a group: count, mean, std (sample), min, quartiles, max."""
    q = quantiles(df, value, [0.25, 0.5, 0.75], "_q", by=by)
    per = df.groupBy(*by).agg(
        F.count(value).alias("count"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).cast("double").alias("min"),
        F.max(value).cast("double").alias("max"),
    )
    both = per.join(q.toDF(*[f"_{c}" for c in by], "_q"), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by], "left")
    return both.select(*by, "count", "mean", "std", "min", *[F.col("_q")[i].alias(f"q{25 * (i + 1)}") for i in range(3)], "max")


def with_scalars(df: DataFrame, *scalars: Column) -> DataFrame:
    """Each row with aggregates over all rows: a one-row broadcast."""
    return df.crossJoin(F.broadcast(df.agg(*scalars)))


def qcut(df: DataFrame, value: str, q: int, out: str, labels: list[str] | None = None) -> DataFrame:
    """Right-closed quantile bins of exact edges, the least value in the first; duplicate edges are dropped.

    With labels, duplicate edges give every row the middle label; without distinct edges the bin is null. A missing value has no bin.
    """
    there = F.col(value).isNotNull()
    (edges,) = unused(df, "edges")
    cut = quantiles(df, value, [k / q for k in range(q + 1)]).select(F.array_distinct("q").alias(edges))
    with_edges = df.crossJoin(F.broadcast(cut))
    place = F.greatest(F.size(F.filter(edges, lambda e: e < F.col(value))), F.lit(1)) - 1
    number = F.when(there & (F.size(edges) > 1), place)
    if labels:
        named = F.get(F.array(*map(F.lit, labels)), place)
        number = F.when(there & (F.size(edges) == q + 1), named).when(there, F.lit(labels[len(labels) // 2]))
    return with_edges.withColumn(out, number).drop(edges)


def median_fill(df: DataFrame, column: str) -> DataFrame:
    return with_quantiles(df, column, _m=0.5).withColumn(column, F.coalesce(F.col(column).cast("double"), F.col("_m"))).drop("_m")


def standardize(df: DataFrame, columns: list[str]) -> DataFrame:
    """Population z-scores; a constant column is only centred."""
    stats = [x for c in columns for x in (F.avg(c).alias(f"_a_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))]
    out = with_scalars(df, *stats)
    for c in columns:
        out = out.withColumn(c, (F.col(c) - F.col(f"_a_{c}")) / F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}")))
    return out.drop(*[f"_{k}_{c}" for c in columns for k in "as"])


def shares(df: DataFrame, key: str) -> DataFrame:
    """Value counts with their share of all rows."""
    per = df.groupBy(key).agg(F.count("*").alias("n"))
    return per.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))
