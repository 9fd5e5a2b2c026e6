"""The measures of ``paper`` for pages that are no larger than a tile: each is worked out in one task from the page's row, so that nothing of it is
shuffled or written. Larger pages go through their tiles."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import pixels as P
from quern.sources.shared import cut

from . import images as I
from . import pages as G

#: Votes that are counted at a time.
VOTES_HELD = 1 << 21


def measured(pages: DataFrame, one: Callable[[dict[str, Any]], tuple], schema: str, tiled: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Columns of ``schema``: what ``one`` makes of the row of a page with no more places than a tile, and what ``tiled`` makes of all larger pages, which
    are written to the shared folder once."""
    small: Column = F.col("height").cast("long") * F.col("width") <= G.SIZE * G.SIZE
    large = cut(pages.where(~small))
    out = G.by_rows(pages.where(small), lambda row: [one(row)], schema)
    return out if large.isEmpty() else out.unionByName(tiled(large).select(*out.columns))


def page(row: dict[str, Any], name: str = "v") -> np.ndarray:
    return np.frombuffer(row[name], np.uint8).reshape(row["height"], row["width"])


def framed(v: np.ndarray, rim: int, border: str) -> np.ndarray:
    """A page with a rim, filled as ``border`` says."""
    if border == P.ZERO:
        return np.pad(v, rim)
    at = [P.place(np.arange(-rim, n + rim), n, border) for n in v.shape]
    return v[at[0][:, None], at[1][None, :]]


def capped(x: float) -> float:
    return min(100.0, max(0.0, x))


def quantile(values: np.ndarray, n: np.ndarray, q: float) -> float:
    """Of values in order, counted n times, between the two nearest ranks."""
    upto = np.cumsum(n)
    place = float(upto[-1] - 1) * q
    lo, hi = (float(values[np.searchsorted(upto, f(place), "right")]) for f in (np.floor, np.ceil))
    return lo + (hi - lo) * (place - np.floor(place))


def histogram(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a page and how often each is there."""
    n = np.bincount(v.ravel(), minlength=256)
    values = np.flatnonzero(n)
    return values, n[values]


def _moments(values: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    mean = float((values * n).sum() / n.sum())
    return mean, float(np.sqrt(max(0.0, float((values * values * n).sum() / n.sum()) - mean * mean)))


def otsu(values: np.ndarray, n: np.ndarray) -> int | None:
    """As ``images.otsu_of``."""
    if len(values) < 2:
        return None
    w0, s0, m = np.cumsum(n).astype(np.float64)[:-1], np.cumsum(n * values).astype(np.float64)[:-1], float(n.sum())
    gap = s0 / w0 - (float((n * values).sum()) - s0) / (m - w0)
    return int(values[np.argmax(np.round(w0 * (m - w0) * gap * gap, 4))])


def contrast(values: np.ndarray, n: np.ndarray) -> float:
    lo, hi, p = int(values[0]), int(values[-1]), n / n.sum()
    return min(100.0, ((hi - lo) / (hi + lo) * 50 + float(-(p * np.log2(p)).sum()) / 8 * 50) * 100) if lo + hi else 0.0


def fade(values: np.ndarray, n: np.ndarray) -> float:
    threshold = otsu(values, n)
    dark = values < (threshold if threshold is not None else 0)
    if threshold is None or not dark.any():
        return 100.0
    mean = lambda some: float((n * values)[some].sum() / n[some].sum())
    return capped(100 - (mean(~dark) - mean(dark)) * 0.8)


def laplacian_variance(v: np.ndarray) -> float:
    x = P.laplacian(framed(v, 1, P.MIRROR)).astype(np.int64)
    s, ss = int(x.sum()), int((x * x).sum())
    return (ss - s * s / float(x.size)) / x.size


def noise_level(v: np.ndarray) -> float:
    return int(np.abs(v.astype(np.int64) - P.middle(framed(v, 2, P.REPEAT))).sum()) / v.size


def dark(v: np.ndarray, row: dict[str, Any]) -> float:
    """As ``paper.dark_patches``."""
    from . import paper as M

    means = np.array([s / places for *_, s, places in M.patches(G.Tile(row | {"y": 0, "x": 0, "h": v.shape[0], "w": v.shape[1]}, 0))])
    if not len(means):
        return 0.0
    mean = square = 0.0
    for k, m in enumerate(means.tolist(), 1):
        gap = m - mean
        mean += gap / k
        square += gap * (gap - gap / k)
    spread = float(np.sqrt(square / len(means)))
    middle = quantile(np.sort(means), np.ones(len(means), np.int64), 0.5)
    return capped(spread * 0.5 + int((means < middle - spread).sum()) / len(means) * 100)


def edges(v: np.ndarray, low: int = 50, high: int = 150) -> np.ndarray:
    """As ``pages.edges``."""
    classes = P.edge_classes(framed(v, 2, P.REPEAT), low, high, np.pad(np.ones(v.shape, bool), 1))
    label = P.regions(classes > 0)
    keep = np.zeros(int(label.max()) + 1, bool)
    keep[label[classes == P.STRONG]] = True
    return keep[label]


def lines(v: np.ndarray) -> tuple[int, float | None, float]:
    """Lines, angle and skew, as ``paper.skew``."""
    from . import paper as M

    height, width = v.shape
    y, x = np.nonzero(edges(v))
    n = 2 * (width + height) + 1
    votes = np.zeros((M.ANGLES, n), np.int64)
    if len(y) <= M.VOTES:  # no line has so many
        return M._lines(votes, width, height)
    cos, sin = M.turns()
    for lo in range(0, len(y), VOTES_HELD // M.ANGLES):
        some = slice(lo, lo + VOTES_HELD // M.ANGLES)
        r = np.outer(cos, x[some])
        r += np.outer(sin, y[some])
        r += 0.5
        at = np.floor(r, out=r).astype(np.int64)
        at += (np.arange(M.ANGLES) * n + width + height)[:, None]
        votes += np.bincount(at.ravel(), minlength=votes.size).reshape(votes.shape)
    return M._lines(votes, width, height)


def skew(row: dict[str, Any]) -> tuple:
    return row["img"], *lines(page(row))


def difficulty(row: dict[str, Any]) -> tuple:
    v = page(row)
    h, sharp = histogram(v), laplacian_variance(v)
    own = dark(v, row), contrast(*h), capped(sharp / 50.0 + noise_level(v) * 5), fade(*h), capped(100 - sharp / 10.0), lines(v)[2]
    return row["img"], *own, float(I.image_difficulty(*own))


def text_gradient(v: np.ndarray) -> tuple[float, float]:
    """The gradient and its score, as ``paper.text_contrast``."""
    across, down = P.gradient(framed(v, 1, P.MIRROR), 3, 10)
    across, down = (x[v <= quantile(*histogram(v), 0.9)].astype(np.int64) for x in (across, down))
    squares, n = np.unique(across * across + down * down, return_counts=True)
    g = quantile(np.sqrt(squares), n, 0.9)
    score = 15 - (g - 800) * 0.01 if g >= 800 else 15 + (800 - g) / 400 * 20 if g >= 400 else 35 + (400 - g) / 200 * 30 if g >= 200 else 65 + (200 - g) / 200 * 35
    return g, capped(score)


def text_contrast(row: dict[str, Any]) -> tuple:
    return row["img"], *text_gradient(page(row))


def texture(v: np.ndarray, lo: float, hi: float) -> float:
    paper = (v >= lo) & (v <= hi)
    return capped(int(np.abs(v.astype(np.int64) - P.smooth(framed(v, 2, P.MIRROR)))[paper].sum()) / int(paper.sum()) * 5)


def spreads(row: dict[str, Any], lo: float, hi: float) -> list[float]:
    """Standard deviations of what is perceived on paper."""
    from . import paper as M

    _, n, *sums = next(iter(M.colour_sums(row | {"lo": lo, "hi": hi})))
    return [float(np.sqrt(max(0.0, ss / n - (s / n) * (s / n)))) for s, ss in zip(sums[::2], sums[1::2], strict=True)]


def opened(v: np.ndarray, side: int) -> np.ndarray:
    return _extremes(v, side, P.eroded, P.dilated, 255, 0)


def closed(v: np.ndarray, side: int) -> np.ndarray:
    return _extremes(v, side, P.dilated, P.eroded, 0, 255)


def _extremes(v: np.ndarray, side: int, one: Callable, two: Callable, no_one: int, no_two: int) -> np.ndarray:
    reach = side // 2
    first = one(np.pad(v, reach, constant_values=no_one), side)
    return two(np.pad(first, reach, constant_values=no_two), side)


def bright_limit(values: np.ndarray, n: np.ndarray) -> float:
    """As ``paper.bright_limits``."""
    light = values >= (otsu(values, n) or 0)
    values, n = values[light], n[light]
    mean, spread = _moments(values, n)
    return min(min(255.0, mean + 2.5 * spread), max(quantile(values, n, 0.9), mean + 1.5 * spread), 240.0)


def tear_areas(v: np.ndarray, side: int = 3) -> tuple[int, int, float]:
    """Areas of tears and holes, and the score, as ``paper.tears``."""
    places = v.size
    zones = P.dilated(framed(edges(v).astype(np.uint8), 1, P.REPEAT), 3) > 0
    plain = opened(((v > 230) & ~zones).astype(np.uint8), 2 * side + 1)
    label = P.regions(plain > 0)
    keep = np.bincount(label.ravel()) >= max(200, places // 2000)
    keep[0] = False
    openings = opened((((v > bright_limit(*histogram(v))) & zones) | keep[label]).astype(np.uint8), side)
    tear = hole = 0
    if openings.any():
        h, w = v.shape
        tile = G.Tile({"img": 0, "height": h, "width": w, "y": 0, "x": 0, "h": h, "w": w, "v": np.pad(openings, 1).tobytes()}, 1)
        for *_, area, _, top, bottom, left, right, straight, diagonal, _ in G.parts(tile):
            length = straight + diagonal * np.sqrt(2.0)
            if area >= max(50, places // 10000) and length > 0:
                long, short = sorted((bottom - top + 1, right - left + 1), reverse=True)
                irregular, compact = length / max(2 * np.pi * np.sqrt(area / np.pi), 1.0), 4 * np.pi * area / (length * length)
                if long / short <= 2.5 and irregular <= 1.3 and compact > 0.5:
                    hole += area
                else:
                    tear += area
    return tear, hole, min(60.0, tear / places * 3000) + min(40.0, hole / places * 2000)


def tears(row: dict[str, Any], side: int = 3) -> tuple:
    return row["img"], *tear_areas(page(row), side)


def stain_scores(row: dict[str, Any], tint: float | None = None) -> tuple[float, float, float, float]:
    """uneven, dark, tint, stains, as ``paper.stains``."""
    from . import paper as M

    v = page(row)
    if min(v.shape) < 50:
        return 0.0, 0.0, 0.0, 0.0
    values, n = histogram(v)
    lo, hi = quantile(values, n, 0.3), quantile(values, n, 0.8)
    own = (values >= lo) & (values <= hi)
    mean, spread = _moments(values[own], n[own])
    windows, off = M.window_sums(v, 0, 0, *v.shape, *v.shape, lo, hi)
    if not windows:
        return 0.0, 0.0, 0.0, 0.0
    side = max(11, max(20, min(100, min(v.shape) // 10)) // 5)
    shaded = int(((closed(v, side + 1 - side % 2) < mean - 1.5 * spread) & (v >= lo) & (v <= hi)).sum())
    uneven, dark = off / windows / max(spread, 1.0), shaded / int(n[own].sum())
    tint = sum(spreads(row, lo, hi)[1:]) if tint is None else tint
    return uneven, dark, tint, capped(min(30.0, uneven * 20) + min(30.0, dark * 800) + min(40.0, tint / 0.5) * 0.25)


def stains(row: dict[str, Any]) -> tuple:
    return row["img"], *stain_scores(row)


def condition(row: dict[str, Any]) -> tuple:
    v = page(row)
    values, n = histogram(v)
    lo, hi = quantile(values, n, 0.3), quantile(values, n, 0.8)
    light, a, b = spreads(row, lo, hi)
    own = text_gradient(v)[1], capped((light + a + b) / 0.5), tear_areas(v)[2], texture(v, lo, hi), stain_scores(row, a + b)[3]
    return row["img"], *own, float(I.condition_score(*own))
