"""A k-d partition of points in the plane: leaves hold about as many points each, however unevenly the points lie."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Points that the tree is built from, and its most levels of splits.
SAMPLE, DEEPEST = 200_000, 16


class Tree(NamedTuple):
    """Splits in breadth-first order: node i has children 2i + 1 (below the split) and 2i + 2. Leaves are numbered from left to right, so that
    leaf >> 1 is the number of the pair that a split made."""

    depth: int
    axis: np.ndarray
    split: np.ndarray

    def leaves(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            at = 2 * at + 1 + (np.where(self.axis[at] == 0, x, y) >= self.split[at])
        return (at - ((1 << self.depth) - 1)).astype(np.int32)

    def reached(self, x: np.ndarray, y: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """(point, leaf) for every leaf that the square of ``reach`` around a point meets."""
        row, at = np.arange(len(x)), np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            c, s = np.where(self.axis[at] == 0, x[row], y[row]), self.split[at]
            left, right = c - reach < s, c + reach >= s
            row, at = np.concatenate([row[left], row[right]]), np.concatenate([2 * at[left] + 1, 2 * at[right] + 2])
        return row, (at - ((1 << self.depth) - 1)).astype(np.int32)


def tree(points: DataFrame, per_leaf: int, least: int = 1) -> Tree:
    """Of points (id, x, y), from a bounded sample chosen by hash; ``least`` leaves where there are points enough for 64 a leaf."""
    n = points.count()
    leaves = max(-(-n // per_leaf), min(least, n // 64), 1)
    depth = min(int(leaves - 1).bit_length(), DEEPEST)
    inner = (1 << depth) - 1
    axis, split = np.zeros(max(inner, 1), np.int8), np.zeros(max(inner, 1))
    if depth:
        share = int(min(1.0, SAMPLE / n) * (1 << 20))
        some = points.where(F.pmod(F.xxhash64(F.lit("tree"), "id"), F.lit(1 << 20)) < share).select(F.col("x").cast("double"), F.col("y").cast("double")).toArrow()
        xy = np.stack([some[c].to_numpy() for c in "xy"])
        held = [np.arange(xy.shape[1])]
        for at in range(inner):
            own = held[at]
            spread = np.ptp(xy[:, own], axis=1) if len(own) else np.zeros(2)
            axis[at] = int(spread[1] > spread[0])
            c = xy[axis[at], own]
            split[at] = np.median(c) if len(own) else 0.0
            held[at] = None
            held += [own[c < split[at]], own[c >= split[at]]]
    return Tree(depth, axis, split)


def leaf(points: DataFrame, known: Tree, x: str = "x", y: str = "y") -> Column:
    """The leaf of each point; the tree is broadcast, at most 600 KB."""
    shared = points.sparkSession.sparkContext.broadcast(known)

    @F.pandas_udf("int")
    def of(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(shared.value.leaves(x.to_numpy(np.float64), y.to_numpy(np.float64)))

    return of(F.col(x), F.col(y))


def around(points: DataFrame, known: Tree, reach: float, x: str = "x", y: str = "y") -> Column:
    """All leaves that hold places nearer than ``reach`` to each point."""
    shared = points.sparkSession.sparkContext.broadcast(known)

    @F.pandas_udf("array<int>")
    def of(x: pd.Series, y: pd.Series) -> pd.Series:
        row, at = shared.value.reached(x.to_numpy(np.float64), y.to_numpy(np.float64), reach)
        order = np.argsort(row, kind="stable")
        return pd.Series(np.split(at[order], np.cumsum(np.bincount(row, minlength=len(x)))[:-1])) if len(x) else pd.Series([], dtype=object)

    return of(F.col(x), F.col(y))
