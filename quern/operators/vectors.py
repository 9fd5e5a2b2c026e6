"""Vectors as arrays: normalising, pooling, diagnostics, clusters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from quern.sources.shared import cut


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def unit(v: Column, eps: float = 1e-8) -> Column:
    # bound by a lambda, the norm is taken once a vector and not once a component
    return F.transform(F.array(norm(v)), lambda n: F.transform(v, lambda x: x.cast("double") / (n + eps)))[0]


def n_clusters(n: int) -> int:
    return max(30, min(80, n // 60))


#: Vectors, chosen by a hash of their ids, that starting centres are drawn from.
START_ROWS = 20_000
#: Centroids that a task may hold.
CENTROID_BYTES = 64 << 20


def mean_pool(df: DataFrame, group: str, vector: str) -> DataFrame:
    """group, pooled: the mean of every component."""
    each = df.select(group, F.posexplode(vector).alias("k", "x")).groupBy(group, "k").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return each.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda s: s["m"]).alias("pooled"))


def kmeans(df: DataFrame, id_: str, vector: str, k: int, seed: int = 42, starts: int = 10, rounds: int = 100, least: float = 1e-4) -> DataFrame:
    """id, cluster_id of the best of several starts, on unit vectors of the commonest length.

    Starting centres are drawn from a bounded sample, each far from those before it, and first move on that sample until they rest. Then all starts move in
    the same passes over the vectors, which are written once: a task sums its vectors by start and centre, and only those sums leave it. A start that rests
    takes part no more. Rows whose vector is null, or of another length, are left out.
    """
    size = common_size(df, vector)
    ready = cut(df.where(F.size(vector) == size).select(id_, unit(F.col(vector)).alias("v")))
    n = ready.count()
    part = F.pmod(F.xxhash64(F.lit(seed), id_), F.lit(1 << 20))
    some = ready.where(part < int(min(1.0, START_ROWS / max(n, 1)) * (1 << 20))).orderBy(id_).select("v").toArrow()["v"].combine_chunks()
    x = _matrix(some)
    k = min(k, len(x)) or 1
    if not len(x):
        return ready.select(id_, F.lit(0).alias("cluster_id")).limit(0)
    centres = np.stack([_rested(x, _spread_out(x, k, np.random.default_rng(seed + i)), rounds, least) for i in range(starts)])
    cost, live = np.full(starts, np.inf), np.arange(starts)
    for _ in range(rounds):
        now, off = centres[live].copy(), np.zeros(len(live))
        for start, cluster, count, far, total in _moved(ready, centres[live]):
            now[start, cluster] = np.array(total) / count
            off[start] += far
        moved = ((now - centres[live]) ** 2).sum(axis=2).max(axis=1) > least**2
        centres[live], cost[live] = now, off
        live = live[moved]
        if not len(live):
            break
    best = centres[int(cost.argmin())]
    shared = df.sparkSession.sparkContext.broadcast(best)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(_distances(_matrix(batch.column(1)), shared.value).argmin(axis=1).astype(np.int32))],
                [id_, "cluster_id"],
            )

    return ready.mapInArrow(near, StructType([df.schema[id_], StructField("cluster_id", IntegerType())]))


def _rested(x: np.ndarray, centres: np.ndarray, rounds: int, least: float) -> np.ndarray:
    """Centres moved to the means of what is nearest to them until they rest."""
    for _ in range(rounds):
        near = _distances(x, centres).argmin(axis=1)
        total, n = np.zeros_like(centres), np.bincount(near, minlength=len(centres))
        np.add.at(total, near, x)
        now = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
        moved = ((now - centres) ** 2).sum(axis=1).max() > least**2
        centres = now
        if not moved:
            break
    return centres


def common_size(df: DataFrame, vector: str) -> int:
    """The commonest length of the vectors, the least of several; -1 where there are none."""
    found = df.where(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("n")).count().orderBy(F.desc("count"), "n").first()
    return found.n if found else -1


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.empty((0, 1))


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum(
        (x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1),
        0,
    ) if len(x) else np.empty((0, len(centres)))


def _spread_out(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Each centre drawn with a chance by its squared distance to the nearest one before it."""
    chosen = [int(rng.integers(len(x)))]
    gap = _distances(x, x[chosen])[:, 0]
    while len(chosen) < k:
        chosen.append(int(rng.choice(len(x), p=gap / gap.sum())) if gap.sum() > 0 else int(rng.integers(len(x))))
        gap = np.minimum(gap, _distances(x, x[chosen[-1:]])[:, 0])
    return x[chosen]


def _moved(ready: DataFrame, centres: np.ndarray) -> list[tuple]:
    """start, cluster, count, summed squared distance and summed vector of every centre with members: one row each."""
    shared = ready.sparkSession.sparkContext.broadcast(centres)
    starts, k, size = centres.shape

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, off, total = np.zeros((starts, k), np.int64), np.zeros((starts, k)), np.zeros((starts, k, size))
        for batch in batches:
            x = _matrix(batch.column(0))
            for s in range(starts if len(x) else 0):
                d = _distances(x, shared.value[s])
                near = d.argmin(axis=1)
                counts[s] += np.bincount(near, minlength=k)
                off[s] += np.bincount(near, d[np.arange(len(x)), near], k)
                np.add.at(total[s], near, x)
        s, c = np.nonzero(counts)
        ends = np.arange(len(s) + 1, dtype=np.int32) * size
        yield pa.RecordBatch.from_arrays(
            [pa.array(s), pa.array(c), pa.array(counts[s, c]), pa.array(off[s, c]), pa.ListArray.from_arrays(ends, pa.array(total[s, c].ravel()))],
            ["s", "c", "n", "off", "v"],
        )

    rows = ready.select("v").mapInArrow(summed, "s long, c long, n long, off double, v array<double>")
    per = rows.groupBy("s", "c").agg(F.sum("n"), F.sum("off"), *[F.sum(F.col("v")[i]) for i in range(size)]).orderBy("s", "c").collect()
    shared.unpersist()
    return [(r[0], r[1], r[2], r[3], list(r[4:])) for r in per]


def nearest(df: DataFrame, id_: str, vector: str, centroids: DataFrame) -> DataFrame:
    """id, label, distance of the nearest centroid (label_c, centroid), the least label on ties; null vectors, and those of another length than the
    centroids commonly have, have none.

    Centroids go to every task, at most ``CENTROID_BYTES`` of them, and a vector meets them inside its Arrow batch: no row is multiplied.
    """
    size = common_size(centroids, "centroid")
    few = centroids.where(F.size("centroid") == size).orderBy("label_c").limit(CENTROID_BYTES // (8 * max(size, 1)) + 1).toArrow()
    if few.nbytes > CENTROID_BYTES:
        raise ValueError("too many centroids to send to every task")
    labels, shared = few["label_c"].combine_chunks(), df.sparkSession.sparkContext.broadcast(_matrix(few["centroid"]).astype(np.float64))
    labels = labels.chunk(0) if isinstance(labels, pa.ChunkedArray) else labels

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            there = pc.fill_null(pc.equal(pc.list_value_length(batch.column(1)), size), False).to_numpy(zero_copy_only=False) & (len(labels) > 0)
            x = _matrix(batch.column(1).filter(pa.array(there))).astype(np.float64)
            best, far = np.zeros(len(x), np.int64), np.full(len(x), np.inf)
            for k, c in enumerate(shared.value if len(x) else []):
                d = np.sqrt(((x - c) ** 2).sum(axis=1))
                best, far = np.where(d < far, k, best), np.minimum(d, far)
            place, gap = np.zeros(len(there), np.int64), np.zeros(len(there))
            place[there], gap[there] = best, far
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), labels.take(pa.array(place, mask=~there)), pa.array(gap, mask=~there)],
                [id_, "label", "distance"],
            )

    kind = centroids.schema["label_c"].dataType
    return df.select(id_, vector).mapInArrow(near, StructType([df.schema[id_], StructField("label", kind), StructField("distance", DoubleType())]))
