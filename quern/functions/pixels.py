"""Measures of one tile of grey pixels: arrays with a rim, so that a place has its neighbours wherever a tile was cut.

Every function takes an array that is wider than what it returns by its own rim on each side. How a rim beyond the page's end is filled is
the caller's choice (``place``); operators take what each measure needs.
"""

from __future__ import annotations

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view

#: A rim beyond the page: the last place again, mirrored about the last place, or zero.
REPEAT, MIRROR, ZERO = "repeat", "mirror", "zero"
#: Classes of places on the way to edges.
NONE, WEAK, STRONG = 0, 1, 2
#: tan(22.5 degrees) in 15 binary places, by which directions are told apart in whole numbers.
TAN_22 = 13573


def place(at: np.ndarray, n: int, border: str) -> np.ndarray:
    """Where on a page of ``n`` places a place at or beyond its ends is taken from."""
    if border != MIRROR or n == 1:
        return np.clip(at, 0, n - 1)
    at = np.abs(at) % (2 * n - 2)
    return np.where(at < n, at, 2 * n - 2 - at)


def shifted(v: np.ndarray, dy: int, dx: int, rim: int) -> np.ndarray:
    """The neighbour at (dy, dx) of every place inside the rim."""
    h, w = v.shape
    return v[rim + dy : h - rim + dy, rim + dx : w - rim + dx]


def gradient(v: np.ndarray, side: int, middle: int) -> tuple[np.ndarray, np.ndarray]:
    """Differences across and down of the 3 by 3 places, its sides weighing ``side`` and its middle ``middle``. Rim 1."""
    v = v.astype(np.int32)
    at = lambda dy, dx: shifted(v, dy, dx, 1)
    across = side * (at(-1, 1) - at(-1, -1) + at(1, 1) - at(1, -1)) + middle * (at(0, 1) - at(0, -1))
    down = side * (at(1, -1) - at(-1, -1) + at(1, 1) - at(-1, 1)) + middle * (at(1, 0) - at(-1, 0))
    return across, down


def laplacian(v: np.ndarray) -> np.ndarray:
    """Sum of the four neighbours less four times the place. Rim 1."""
    v = v.astype(np.int32)
    return sum(shifted(v, dy, dx, 1) for dy, dx in ((0, -1), (0, 1), (-1, 0), (1, 0))) - 4 * shifted(v, 0, 0, 1)


def edge_classes(v: np.ndarray, low: int, high: int, inside: np.ndarray) -> np.ndarray:
    """Whether each place is no ridge of the gradient, a weak or a strong one. Rim 2; ``inside``: places of the page, with rim 1.

    The gradient's size is the sum of both differences' sizes, and 0 beyond the page. A place above ``low`` is a ridge if it is above the neighbour before
    it and not below the one behind it, across, down or diagonally as its direction is nearest to.
    """
    across, down = gradient(v, 1, 2)
    size = np.where(inside, np.abs(across) + np.abs(down), 0)
    m, dx, dy = shifted(size, 0, 0, 1), shifted(across, 0, 0, 1), shifted(down, 0, 0, 1)
    x, y = np.abs(dx).astype(np.int64), np.abs(dy).astype(np.int64) << 15
    flat, steep = y < x * TAN_22, y > x * TAN_22 + (x << 16)
    rising = (dx ^ dy) < 0
    at = lambda a, b: shifted(size, a, b, 1)
    ridge = np.where(
        flat,
        (m > at(0, -1)) & (m >= at(0, 1)),
        np.where(
            steep,
            (m > at(-1, 0)) & (m >= at(1, 0)),
            np.where(rising, (m > at(-1, 1)) & (m > at(1, -1)), (m > at(-1, -1)) & (m > at(1, 1))),
        ),
    )
    return np.where((m > low) & ridge, np.where(m > high, STRONG, WEAK), NONE).astype(np.uint8)


def smooth(v: np.ndarray) -> np.ndarray:
    """Weights 1, 4, 6, 4, 1 down and across, rounded to whole numbers, halves up. Rim 2."""
    v = v.astype(np.int32)
    h, w = v.shape
    down = sum(k * v[i : h - 4 + i] for i, k in enumerate((1, 4, 6, 4, 1)))
    return (sum(k * down[:, i : w - 4 + i] for i, k in enumerate((1, 4, 6, 4, 1))) + 128) >> 8


def middle(v: np.ndarray, reach: int = 2) -> np.ndarray:
    """The median of the square around each place, a stripe of rows at a time. Rim ``reach``."""
    side = 2 * reach + 1
    near = sliding_window_view(v, (side, side))
    out = np.empty(near.shape[:2], v.dtype)
    for lo in range(0, len(near), 64):
        some = near[lo : lo + 64].reshape(-1, side * side)
        out[lo : lo + 64] = np.partition(some, side * side // 2, axis=1)[:, side * side // 2].reshape(-1, near.shape[1])
    return out


def running(v: np.ndarray, side: int, least: bool, axis: int) -> np.ndarray:
    """The least or greatest of every ``side`` places in a line, in time that does not grow with ``side``.

    A line is cut into stretches of ``side`` places; the extremes from each stretch's head on and to its tail are enough, as a window
    is the tail of one stretch and the head of the next.
    """
    v = np.moveaxis(v, axis, -1)
    n, extreme = v.shape[-1], np.minimum if least else np.maximum
    pad = -n % side
    if pad:
        v = np.concatenate([v, np.repeat(v[..., -1:], pad, axis=-1)], axis=-1)
    cut = v.reshape(*v.shape[:-1], -1, side)
    heads = extreme.accumulate(cut, axis=-1).reshape(*v.shape)
    tails = extreme.accumulate(cut[..., ::-1], axis=-1)[..., ::-1].reshape(*v.shape)
    return np.moveaxis(extreme(tails[..., : n - side + 1], heads[..., side - 1 : n]), -1, axis)


def eroded(v: np.ndarray, side: int) -> np.ndarray:
    """The least of the square of ``side`` around each place. Rim: half the side."""
    return running(running(v, side, True, 0), side, True, 1)


def dilated(v: np.ndarray, side: int) -> np.ndarray:
    """The greatest of the square of ``side`` around each place. Rim: half the side."""
    return running(running(v, side, False, 0), side, False, 1)


def regions(mask: np.ndarray) -> np.ndarray:
    """A number from 1 for the places of each connected region (also diagonally), 0 elsewhere: runs of rows, joined where they touch the row before."""
    h, w = mask.shape
    wide = np.zeros((h, w + 2), np.int8)
    wide[:, 1:-1] = mask
    step = np.diff(wide, axis=1)
    row, start = np.nonzero(step == 1)
    stop = np.nonzero(step == -1)[1]
    if not len(row):
        return np.zeros((h, w), np.int32)
    # runs (row, start, stop) in order; those of the row before that touch [start - 1, stop + 1) are a range
    key = lambda r, x: r * (w + 3) + x
    lo = np.searchsorted(key(row, stop), key(row - 1, start), "left")
    hi = np.searchsorted(key(row, start), key(row - 1, stop), "right")
    n = np.maximum(hi - lo, 0)
    above = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    label = joined(len(row), np.repeat(np.arange(len(row)), n), above)
    number = np.unique(label, return_inverse=True)[1] + 1
    out = np.zeros(h * w + 1, np.int32)
    np.add.at(out, row * w + start, number)
    np.add.at(out, row * w + stop, -number)
    return np.cumsum(out[:-1], dtype=np.int32).reshape(h, w)


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` things the least that it is joined with by pairs (a, b)."""
    label = np.arange(n)
    while len(a) and (label[a] != label[b]).any():
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label = label[label]
    return label


def contour(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Straight and diagonal steps along the rims of regions, by the windows of 2 by 2 places that account for them: one row and column of windows more
    than the mask has places inside its rim of 1, from the window up and left of the first place on.

    Steps lead from the middle of a place to the next one's. A pair of neighbours is passed once on each side where their window holds no third
    place; a window of three places has its diagonal on the rim, and one of two opposite places is passed there and back.
    """
    m = mask.astype(np.int8)
    a, b, c, d = m[:-1, :-1], m[:-1, 1:], m[1:, :-1], m[1:, 1:]
    n, opposite = a + b + c + d, (a & d) + (b & c)
    straight = (n == 2) & (opposite == 0)
    diagonal = np.where(n == 3, 1, np.where((n == 2) & (opposite == 1), 2, 0))
    return straight.astype(np.int64), diagonal.astype(np.int64)
