"""Shared-folder staging and size-checked broadcasts.

Lineage is cut by writing Parquet into the folder that ``spark.checkpoint.dir`` names, which every
executor can read again after a loss.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

from quern.plans.ship import ship
from quern.sources.shared import shared_dir, spread  # noqa: F401

#: Most bytes that a side may have to be broadcast, and of an Arrow batch, each where the user has set none.
BROADCAST_BYTES = 64 << 20
ARROW_BYTES, ARROW_SETTING = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


_open: list[list[Stages]] = []


@contextmanager
def scope() -> Iterator[None]:
    """Deletes at its end what operators staged inside it; what they return must have been written by then."""
    _open.append([])
    try:
        yield
    finally:
        for stages in _open.pop():
            stages.clear()


class Stages:
    """Named intermediate tables of one operator call, each in a folder of its own."""

    def __init__(self, spark: SparkSession, what: str):
        ship(spark)
        bounded(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/quern/{what}-{uuid.uuid4().hex}"
        self.made = 0
        if _open:
            _open[-1].append(self)

    def folder(self, name: str) -> str:
        self.made += 1
        return f"{self.root}/{self.made:03d}-{name}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Writes ``df`` and returns a scan of what was written."""
        path = self.folder(name)
        df.write.option("compression", "zstd").parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._quern_path = path
        return back

    def drop(self, df: DataFrame) -> None:
        """Deletes a stage that no later plan reads."""
        path = getattr(df, "_quern_path", None)
        if path:
            self._delete(path)

    def clear(self) -> None:
        """Deletes all stages; no plan may read them any more."""
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def small_side(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` (a staged table) with a broadcast hint if its rows, measured, take at most ``most`` bytes.

    Above that the join shuffles, and adaptive execution splits skewed keys.
    """
    rows, held = df.agg(F.count(F.lit(1)), F.sum(sum((_width(F.col(f.name), f.dataType) for f in df.schema), F.lit(32)))).first()
    return F.broadcast(df) if not rows or held <= most else df


def _width(column: Column, kind: DataType) -> Column:
    """About how many bytes a value takes."""
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 16
    if isinstance(kind, ArrayType):
        if isinstance(kind.elementType, (StringType, BinaryType, ArrayType, StructType)):
            return F.aggregate(
                F.coalesce(column, F.array().cast(kind)),
                F.lit(16).cast("long"),
                lambda a, x: a + _width(x, kind.elementType).cast("long"),
            )
        return F.greatest(F.size(column), F.lit(0)) * 8 + 16
    if isinstance(kind, StructType):
        return sum((_width(column.getField(f.name), f.dataType) for f in kind), F.lit(16))
    return F.lit(8)


def bounded(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes as well as by rows, unless the session already does."""
    if ARROW_SETTING not in spark.conf.getAll:
        spark.conf.set(ARROW_SETTING, str(ARROW_BYTES))


def unused(name: str, df: DataFrame) -> str:
    """``name``, or a longer one that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def filtered(docs: DataFrame, keep: Callable) -> DataFrame:
    """``docs`` through a function of Arrow batches that drops rows; columns pass by place, so that any name will do."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.mapInArrow(keep, plain.schema).toDF(*docs.columns)
