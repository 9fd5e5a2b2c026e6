"""Roll-ups of timed observations by day or month, in batch and as a stream that goes on where it stopped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.sources.shared import fresh


def rollup(events: DataFrame, period: str = "day") -> DataFrame:
    """event_type, period (its start), mean, min, max, n; period is ``day`` or ``month``."""
    by = F.window("ts", "1 day")["start"].alias(period) if period == "day" else F.col(period) if period in events.columns else F.date_trunc(period, "ts").alias(period)
    per = events.groupBy("event_type", by).agg(
        F.avg("value").alias("mean"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.count("*").alias("n"),
    )
    return per.select("event_type", period, "mean", "min", "max", "n")


def stream(spark: SparkSession, folder: str, table: str, files_a_batch: int | None = None) -> DataFrame:
    """The files of a table, or of a folder of that name, as a stream; time stamps are time stamps with a zone, as watermarks want."""
    static = spark.read.parquet(f"{folder}/{table}.parquet")
    files = static.inputFiles()
    source, glob = (
        files[0].rsplit("/", 1)[0],
        "*.parquet",
    ) if len(files) > 1 or not files[0].endswith(f"/{table}.parquet") else (folder, f"{table}.parquet")
    reader = spark.readStream.schema(static.schema).option("pathGlobFilter", glob)
    rows = (reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader).parquet(source)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def follow(spark: SparkSession, folder: str, table: str, period: str, late: str, to: str, files: int | None = None) -> StreamingQuery:
    """One run to its end; batches of at most ``files`` files, where that is given."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{to}/rows/batch={number}")

    rows = stream(spark, folder, table, files)
    if period == "day":
        rows = rows.withWatermark("ts", late)
    else:  # the month itself is the event time, so that its state goes once the month after the next has begun and ``late`` has passed
        rows = rows.withColumn(period, F.date_trunc(period, "ts")).withWatermark(period, f"32 days {late}")
    writer = rollup(rows, period).writeStream.outputMode("update").option("checkpointLocation", f"{to}/state")
    run = writer.foreachBatch(put).trigger(availableNow=True).start()
    run.awaitTermination()
    return run


def streamed(spark: SparkSession, folder: str, table: str, period: str = "day", late: str = "1 hour", to: str | None = None) -> DataFrame:
    """The roll-up of all files there now, as one run of a stream that a scheduler repeats.

    State and offsets are kept under ``to`` in the shared folder: another run with the same ``to`` reads only files that came since, and adds to
    the state. Each batch writes the rows that it changed; the latest of each is the result. State of a day or month is given up once nothing within
    ``late`` can change it any more.
    """
    to = to or fresh(spark, "rollup")
    keys = ["event_type", period]
    follow(spark, folder, table, period, late, to)
    kind = spark.read.parquet(f"{folder}/{table}.parquet").schema["ts"].dataType
    rows = spark.read.parquet(f"{to}/rows")
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct("mean", "min", "max", "n"), "batch").alias("last"))
    return latest.select("event_type", F.col(period).cast(kind).alias(period), "last.*")
