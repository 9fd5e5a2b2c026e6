"""Bounded labelled samples and score calibration, shared by the trained operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column | str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids are in fold 0."""
    return F.coalesce(
        F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id.cast("string").cast("binary")) % folds,
        F.lit(0),
    ).cast("int")


def sample(labels: DataFrame, label: str, train: Column, rows: int) -> DataFrame:
    """(id, label): about ``rows`` labelled training ids at most, chosen by a hash of the id; one label an id."""
    given = labels.where(train & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    n = given.count()
    share = min(1.0, rows / n) if n else 1.0
    part = F.pmod(F.xxhash64(F.lit("labelled"), "doc_id"), F.lit(1 << 20))
    return given.where(part < int(share * (1 << 20))).withColumnRenamed("doc_id", "_id")


def balanced_cut(margin: np.ndarray, label: np.ndarray) -> float:
    """The margin between two neighbours that best separates the classes, both counting alike."""
    if len(margin) == 0 or label.min() == label.max():
        return 0.0 if len(margin) == 0 or label[0] else float(margin.max()) + 1.0
    order = np.argsort(margin, kind="stable")
    m, y = margin[order], label[order]
    kept = 1 - np.concatenate([[0], np.cumsum(y)]) / y.sum()  # label 1 at or above each cut
    cut = np.concatenate([[0], np.cumsum(1 - y)]) / (1 - y).sum()
    good = kept + cut
    good[1:-1][m[1:] == m[:-1]] = -1
    best = np.flatnonzero(good >= good.max() - 1e-12)
    k = int(best[len(best) // 2])
    lo = m[k - 1] if k else m[0] - 1.0
    hi = m[k] if k < len(m) else m[-1] + 1.0
    return float((lo + hi) / 2)


def slope(margin: np.ndarray, label: np.ndarray, cut: float) -> float:
    """Steepness of the logistic curve through ``cut``, by a few Newton steps with smoothed targets (Platt)."""
    y = np.where(label == 1, (label.sum() + 1) / (label.sum() + 2), 1 / ((1 - label).sum() + 2))
    x, a = margin - cut, 1.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * x, -30, 30)))
        a -= float(((p - y) * x).sum() + 1e-3 * a) / float((p * (1 - p) * x * x).sum() + 1e-3)
        a = min(max(a, 1e-2), 50.0)
    return a


def probability(margin: np.ndarray, cut: float, a: float, at: float) -> np.ndarray:
    """Logistic score of a margin that is exactly ``at`` at the cut."""
    return 1 / (1 + np.exp(-np.clip(a * (margin - cut) + np.log(at / (1 - at)), -30, 30)))
