"""Quality classifier: naive Bayes support vectors on n-gram indicators.

Indicators are hashed word unigrams and bigrams, unigrams and bigrams of word shapes, and whether a
word repeats the one before it. Each is scaled by its log-count ratio between the classes; a linear hinge-loss model is
then fitted to the scaled, length-normalised indicators by dual coordinate descent, and its weights are drawn towards their
mean magnitude. The labelled sample that is fitted is bounded by ``train_rows`` documents and by ``train_features`` indicators in all; which ones
is decided by a hash of their ids, so a bound met means fewer documents and never parts of them. A fifth of the sample is kept back to place
the cut and the slope of the score.

Defined cases: null and empty texts have no indicators and score by the bias alone; repeated rows score alike; with no
labelled rows, or one class only, every score follows from the bias; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labels as L
from .staging import Stages
from .text import BLOCK, Words, chunks, lean, mix, powers, utf8, word_bytes, words

BITS = 20
TRAIN_ROWS, TRAIN_FEATURES = 20_000, 60_000_000
EPOCHS = 12
COST = 1.0
SMOOTH = 1.0
#: Share of the fitted weights against their mean magnitude.
BETA = 0.75
CUT = 0.3
#: Words of a long text whose indicators are made at once.
SEGMENT = 1 << 18
BLANK = word_bytes("blank")


def _shapes() -> np.ndarray:
    """A class for each byte: upper, lower, digit, non-ASCII, and each ASCII mark its own."""
    c = np.arange(256, dtype=np.uint64) + np.uint64(1)
    for lo, hi in (("A", "Z"), ("a", "z"), ("0", "9")):
        c[ord(lo) : ord(hi) + 1] = ord(lo)
    c[128:] = ord("a")
    return c


SHAPE = _shapes()


def shapes(data: np.ndarray, lo: int, w: Words) -> np.ndarray:
    """A hash of each word's shape, the classes of its bytes with repeats dropped."""
    power, inverse = powers()
    out, i = np.zeros(len(w.start), np.uint64), 0
    while i < len(w.start):
        j = max(i + 1, int(np.searchsorted(w.end, w.start[i] + BLOCK, "right")))
        base, place, last = int(w.start[i]), 0, -1
        for b in range(base, int(w.end[j - 1]), BLOCK):  # more than one block only inside a single word
            kind = SHAPE[data[lo + b : lo + min(b + BLOCK, int(w.end[j - 1]))]]
            new = np.ones(len(kind), bool)
            new[1:] = kind[1:] != kind[:-1]
            new[w.start[i:j][w.start[i:j] >= b] - b] = True
            new[0] = new[0] and (b == base or int(kind[0]) != last)
            at = np.cumsum(new)
            total = np.zeros(len(kind) + 1, np.uint64)
            np.cumsum(np.where(new, kind * power[at], np.uint64(0)), out=total[1:])
            if j > i + 1 or w.end[i] - w.start[i] <= BLOCK:
                out[i:j] = (total[w.end[i:j] - base] - total[w.start[i:j] - base]) * inverse[at[w.start[i:j] - base]]
            else:
                out[i] = (int(out[i]) + int(total[-1]) * pow(int(power[1]), place - 1, 1 << 64)) & ((1 << 64) - 1)
                place, last = place + int(at[-1]), int(kind[-1])
        i = j
    return mix(out)


def indicators(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (document, bucket) pairs of a chunk, as two arrays."""
    w = words(data, at, BLANK)
    shape = shapes(data, int(at[0]), w)
    all_keys = [np.empty(0, np.uint64)]
    for lo in range(0, len(w.start), SEGMENT):
        hi = min(lo + SEGMENT, len(w.start))
        k = np.arange(max(lo, 1), hi)
        k = k[w.doc[k] == w.doc[k - 1]]
        same = (w.hash[k] == w.hash[k - 1]).astype(np.uint64)
        found = [
            (w.doc[lo:hi], w.hash[lo:hi]),
            (w.doc[lo:hi], shape[lo:hi] + np.uint64(1)),
            (w.doc[k], mix(w.hash[k - 1] * np.uint64(3) + w.hash[k])),
            (w.doc[k], mix(shape[k - 1] * np.uint64(5) + shape[k] + same)),
            (w.doc[k], mix(same + np.uint64(77))),
        ]
        keys = np.concatenate([(d.astype(np.uint64) << np.uint64(BITS)) | (mix(h) >> np.uint64(64 - BITS)) for d, h in found])
        keys.sort()
        all_keys.append(keys[np.concatenate([[True], keys[1:] != keys[:-1]])])
    keys = all_keys[-1] if len(all_keys) <= 2 else np.unique(np.concatenate(all_keys))
    return (keys >> np.uint64(BITS)).astype(np.int64), (keys & np.uint64((1 << BITS) - 1)).astype(np.int64)


class Model(NamedTuple):
    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    cut: float
    slope: float


def margins(model: Model, doc: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
    top = np.bincount(doc, model.weight[bucket], n)
    size = np.sqrt(np.bincount(doc, model.ratio[bucket] ** 2, n))
    return top / np.maximum(size, 1e-9) + model.bias


def fit(features: list[np.ndarray], label: np.ndarray, seed: int = 7) -> Model:
    """Log-count ratios, then dual coordinate descent on all but the calibration fifth."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(label))
    kept_back, train = order[: len(order) // 5], order[len(order) // 5 :]
    ratio, weight, bias = np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, np.float32), 0.0
    if len(label) == 0 or label.min() == label.max():
        return Model(ratio, weight, 0.0, 1.0 if len(label) and label[0] == 0 else -1.0, 1.0)
    counts = [np.full(1 << BITS, SMOOTH), np.full(1 << BITS, SMOOTH)]
    for i in train:
        counts[label[i]][features[i]] += 1
    ratio = np.log((counts[1] / counts[1].sum()) / (counts[0] / counts[0].sum())).astype(np.float32)
    w = np.zeros(1 << BITS, np.float64)
    size = [max(float(np.sqrt(np.square(ratio[features[i]]).sum())), 1e-9) for i in train]
    y = np.where(label[train] == 1, 1.0, -1.0)
    share = np.array([(y < 0).mean(), (y > 0).mean()]).clip(1e-3)
    upper = np.where(y > 0, COST * 0.5 / share[1], COST * 0.5 / share[0])
    alpha = np.zeros(len(y))
    for _ in range(EPOCHS):
        moved = 0.0
        for i in rng.permutation(len(y)):
            f = features[train[i]]
            x = ratio[f] / size[i]
            slack = y[i] * (w[f] @ x + bias) - 1.0
            new = min(max(alpha[i] - slack / 2.0, 0.0), upper[i])  # a unit row and a unit bias: curvature 2
            if step := (new - alpha[i]) * y[i]:
                w[f] += step * x
                bias += step
                alpha[i] = new
                moved += abs(step)
        if moved < 1e-3 * len(y):
            break
    mean = np.abs(w[w != 0]).mean() if w.any() else 0.0
    w = np.where(counts[0] + counts[1] > 2 * SMOOTH, (1 - BETA) * mean * np.sign(w) + BETA * w, 0.0)
    model = Model(ratio, (w * ratio).astype(np.float32), bias, 0.0, 1.0)
    held = kept_back if len(kept_back) and label[kept_back].min() != label[kept_back].max() else order
    m = np.concatenate([margins(model, np.zeros(len(features[i]), np.int64), features[i], 1) for i in held])
    cut = L.balanced_cut(m, label[held])
    return model._replace(cut=cut, slope=L.slope(m, label[held], cut))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = utf8(batch.column("text"))
        for lo, hi in chunks(at):
            doc, bucket = indicators(data, at[lo : hi + 1])
            ends = np.searchsorted(doc, np.arange(hi - lo + 1))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64())[lo:hi],
                    batch.column("label")[lo:hi],
                    pa.ListArray.from_arrays(ends.astype(np.int32), bucket.astype(np.int32)),
                ],
                ["doc_id", "label", "buckets"],
            )


def train(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    held_out: F.Column,
    train_rows: int = TRAIN_ROWS,
    train_features: int = TRAIN_FEATURES,
) -> Model:
    """Fits on at most about ``train_rows`` labelled documents that are not held out, of at most about ``train_features`` indicators."""
    stages = Stages(docs.sparkSession, "quality")
    some = L.sample(labels, label, ~held_out, train_rows)
    made = docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "label").mapInArrow(
        _featured,
        "doc_id long, label int, buckets array<int>",
    )
    made = stages.put(made, "features")
    held = made.agg(F.sum(F.size("buckets"))).first()[0] or 0
    part = F.pmod(F.xxhash64(F.lit("features"), "doc_id"), F.lit(1 << 20))
    rows = made.where(part < int(min(1.0, train_features / max(held, 1)) * (1 << 20))).select("label", "buckets").toArrow()
    stages.drop(made)
    label_of = rows["label"].to_numpy().astype(np.int64)
    flat = rows["buckets"].combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) and flat.num_chunks else flat
    if not len(label_of):
        return fit([], label_of)
    ends, values = flat.offsets.to_numpy(), flat.values.to_numpy()
    order = np.lexsort(  # the same whatever order rows arrive in
        [[values[ends[i] : ends[i + 1]].sum() for i in range(len(label_of))], np.diff(ends), label_of]
    )
    return fit([values[ends[i] : ends[i + 1]] for i in order], label_of[order])


def score(docs: DataFrame, model: Model, held_out: F.Column, at: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @lean
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            data, ends = utf8(batch.column("text"))
            out = np.zeros(len(ends) - 1)
            for lo, hi in chunks(ends):
                doc, bucket = indicators(data, ends[lo : hi + 1])
                out[lo:hi] = L.probability(margins(model, doc, bucket, hi - lo), model.cut, model.slope, at)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(out), pa.array((out >= at).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    return docs.select("doc_id", held_out.alias("held_out"), "text").mapInArrow(scored, "doc_id long, held_out boolean, score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    held_out = L.fold("doc_id", 5) == 0
    return score(docs, train(docs, labels, "quality", held_out, train_rows), held_out)
