"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names; a folder of our own only in a plain local session without it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='quern-')}")
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def session_dir(spark: SparkSession) -> str:
    """A folder of this session in the shared one, which goes when the driver ends."""
    context, shared = spark.sparkContext, shared_dir(spark)
    known = context.__dict__.setdefault("_quern_folders", {})
    if shared not in known:
        known[shared] = f"{shared}/quern/session-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(known[shared])
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        system.mkdirs(path)
        system.deleteOnExit(path)
    return known[shared]


def fresh(spark: SparkSession, what: str) -> str:
    """A path in the session's folder that nothing has written to."""
    return f"{session_dir(spark)}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage with a checkpoint in the shared folder."""
    if not df.sparkSession.sparkContext.getCheckpointDir():
        df.sparkSession.sparkContext.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


#: Bytes a core up to which a table of few files is dealt out anew.
SPREAD_BYTES = 32 << 20


def spread(table: DataFrame) -> DataFrame:
    """A scan of fewer files than cores, and of at most ``SPREAD_BYTES`` a core, dealt out to all of them; any other scan is left as it is."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return table.repartition(cores) if len(table.inputFiles()) < cores and size <= cores * SPREAD_BYTES else table
