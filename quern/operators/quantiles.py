"""Exact quantiles without one task that holds every value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.sources.shared import cut

#: Distinct values, as estimated, of which one task may hold all.
FEW = 200_000


def quantiles(
    df: DataFrame,
    value: Column | str,
    qs: Sequence[float],
    name: str = "q",
    few: int = FEW,
    by: Sequence[str] = (),
) -> DataFrame:
    """One row, or one a group of ``by``: quantiles by linear interpolation between order statistics; without values null, or no row.

    Few distinct values are counted in one aggregate. Many are counted by value, dealt by range, and placed by the counts of the ranges before, so
    that no group is one task's.
    """
    x = (F.col(value) if isinstance(value, str) else value).cast("double")
    values = df.select(*by, x.alias("v")).where("v is not null")
    if (values.agg(F.approx_count_distinct("v", 0.05)).first()[0] or 0) <= few:
        return values.groupBy(*by).agg(F.percentile("v", F.array(*map(F.lit, qs))).alias(name))
    counted = values.groupBy(*by, "v").agg(F.count("*").alias("n"))
    dealt = cut(counted.repartitionByRange(_parts(df), *by, "v").withColumn("part", F.spark_partition_id()))
    before = dealt.groupBy(*by, "part").agg(F.sum("n").alias("m"))
    before = before.withColumn("before", F.sum("m").over(Window.partitionBy(*by).orderBy("part")) - F.col("m")).withColumn("total", F.sum("m").over(Window.partitionBy(*by)))
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in (*by, "part")]
    on = same[0]
    for s in same[1:]:
        on &= s
    placed = dealt.alias("x").join(before.alias("y"), on).select(
        *[f"x.{c}" for c in (*by, "v")],
        "total",
        (F.sum("n").over(Window.partitionBy(*[f"x.{c}" for c in (*by, "part")]).orderBy("v")) + F.col("before")).alias("upto"),
    )
    at = [(F.col("total") - 1) * q for q in qs]
    ends = [F.min(F.when(F.col("upto") > F.floor(a) + k, F.col("v"))).alias(f"{i}_{k}") for i, a in enumerate(at) for k in (0, 1)]
    low = lambda i: F.col(f"{i}_0")
    between = [low(i) + (F.coalesce(F.col(f"{i}_1"), low(i)) - low(i)) * (a - F.floor(a)) for i, a in enumerate(at)]
    return placed.groupBy(*by).agg(F.first("total").alias("total"), *ends).select(*by, F.array(*between).alias(name))


def _parts(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def with_quantiles(df: DataFrame, value: Column | str, **named: float) -> DataFrame:
    """Each row with quantiles of all rows under the names given: a one-row broadcast."""
    row = quantiles(df, value, list(named.values()), "all_q").select(*[F.col("all_q")[i].alias(n) for i, n in enumerate(named)])
    return df.crossJoin(F.broadcast(row))
