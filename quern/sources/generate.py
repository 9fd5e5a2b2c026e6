"""A seeded synthetic river panel."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.physics import seasonal


def uniform(id_: Column, seed: int, stream: int) -> Column:
    """A number in (0, 1) out of a row's id: the same however rows are partitioned."""
    digest = F.md5(F.concat_ws("|", id_.cast("string"), F.lit(str(seed)), F.lit(str(stream))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def normal(id_: Column, seed: int, stream: int) -> Column:
    return F.sqrt(-2 * F.ln(uniform(id_, seed, stream))) * F.cos(2 * math.pi * uniform(id_, seed, stream + 1))


def river_panel(stations: DataFrame, days: DataFrame, seed: int = 42) -> DataFrame:
    """station_id, date, and seasonal flow, rain, temperature and level: of each of ``stations`` (station_id) on each day from the first to the last of
    ``days`` (date). A station's days are made where the station is."""
    id_ = F.col("id")
    ends = F.broadcast(days.agg(F.min("date").cast("date").alias("first"), F.max("date").cast("date").alias("last")))  # one row
    each = stations.crossJoin(ends).where("first is not null").select("station_id", F.posexplode(F.sequence("first", "last")).alias("t", "date"))
    rows = each.withColumn("id", F.col("station_id").cast("long") * 100_000 + F.col("t"))
    rows = rows.withColumn("rain", -F.ln(uniform(id_, seed, 1)) * 3).withColumn("n1", normal(id_, seed, 2)).withColumn("n2", normal(id_, seed, 4))
    flow = F.greatest(F.lit(0.1), 5 + F.col("station_id") * 0.5 + 3 * seasonal(F.col("t")) + 0.4 * F.col("rain") + 0.3 * F.col("n1"))
    out = rows.withColumn("flow", flow)
    return out.select(
        "station_id",
        "date",
        F.col("flow").alias("Q"),
        (0.3 + 0.08 * F.pow("flow", F.lit(0.6))).alias("H"),
        F.col("rain").alias("PRELIQ_Q"),
        (12 - 8 * seasonal(F.col("t")) + F.col("n2")).alias("T_Q"),
    )
