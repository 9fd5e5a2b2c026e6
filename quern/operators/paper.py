"""Measures of page images (img, height, width, v): what the eye would call blurred, skewed, torn, stained or faded, each 0 to 100."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import pixels as P

from . import images as I
from . import pages as G
from . import whole as W

#: Angles of lines, votes that a line takes, and the most lines that a page's angle is read from (a limit that is the feature).
ANGLES, VOTES, LINES = 180, 100, 50
#: Weights of red, green and blue in the three measures of light, and those of white.
LIGHT = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
WHITE = (0.950456, 1.0, 1.088754)


def _capped(x: Column) -> Column:
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), x))


def edge_density(pages: DataFrame) -> DataFrame:
    """img, edges (places on edges), edge_density (their mean as white on black)."""
    n = lambda row: [(row["img"], int(np.count_nonzero(np.frombuffer(row["v"], np.uint8))), len(row["v"]))]
    per = G.by_rows(G.edges(pages).select("img", "v"), n, "img long, edges long, places long")
    return per.select("img", "edges", (F.col("edges") * 255.0 / F.col("places")).alias("edge_density"))


def _lines(votes: np.ndarray, width: int, height: int) -> tuple[int, float | None, float]:
    """Number of lines (at most LINES), their median angle and the score, of votes by angle and distance."""
    wide = np.zeros((ANGLES + 2, votes.shape[1] + 2), np.int64)
    wide[1:-1, 1:-1] = votes
    top = (votes > VOTES) & (votes > wide[1:-1, :-2]) & (votes >= wide[1:-1, 2:]) & (votes > wide[:-2, 1:-1]) & (votes >= wide[2:, 1:-1])
    angle, _ = np.nonzero(top)
    best = angle[np.argsort(-votes[top], kind="stable")][:LINES] - 90
    middle = float(np.median(best)) if len(best) else None
    return len(best), middle, min(100.0, abs(middle) * 10) if len(best) else 0.0


def turns() -> tuple[np.ndarray, np.ndarray]:
    """Cosines and sines of the angles, the same everywhere."""
    turn = np.arange(ANGLES) * np.pi / ANGLES
    return np.round(np.cos(turn), 12), np.round(np.sin(turn), 12)


def skew(pages: DataFrame) -> DataFrame:
    """img, lines, angle, skew: the median angle of the lines that most edges lie on, by votes for angle and distance."""
    return W.measured(pages, W.skew, "img long, lines long, angle double, skew double", _skew)


def _skew(pages: DataFrame) -> DataFrame:
    """The same by tiles.

    A tile votes for all its edges; the votes of tiles are added page by page, and a line is a cell with more votes than the cells around it. Lines come by
    votes, then by angle and distance.
    """
    cos, sin = turns()
    schema = "img long, lines long, angle double, skew double"

    def distances(t: G.Tile) -> np.ndarray:
        y, x = np.nonzero(t.v)
        return np.floor(np.outer(cos, x + t.x) + np.outer(sin, y + t.y) + 0.5).astype(np.int64) + t.width + t.height

    def alone(t: G.Tile) -> Iterable[tuple]:
        r, n = distances(t), 2 * (t.width + t.height) + 1
        votes = np.bincount((r + np.arange(ANGLES)[:, None] * n).ravel(), minlength=ANGLES * n).reshape(ANGLES, n)
        yield t.img, *_lines(votes, t.width, t.height)

    def some(t: G.Tile) -> Iterable[tuple]:
        for k, r in enumerate(distances(t)):
            lo = int(r.min()) if len(r) else 0
            yield t.img, t.width, t.height, k, lo, np.bincount(r - lo).astype("<i4").tobytes()

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        width, height = int(rows["width"].iloc[0]), int(rows["height"].iloc[0])
        votes = np.zeros((ANGLES, 2 * (width + height) + 1), np.int64)
        for k, lo, part in zip(rows["k"], rows["lo"], rows["votes"], strict=True):
            part = np.frombuffer(part, "<i4")
            votes[k, lo : lo + len(part)] += part
        return pd.DataFrame([(rows["img"].iloc[0], *_lines(votes, width, height))], columns=["img", "lines", "angle", "skew"])

    tiles = G.tiled(G.edges(pages), 0, P.ZERO)
    whole = F.expr("h = height and w = width")
    parts = G.per_tile(tiles.where(~whole), 0, some, "img long, width int, height int, k int, lo int, votes binary")
    return G.per_tile(tiles.where(whole), 0, alone, schema).union(parts.groupBy("img").applyInPandas(added, schema))  # a page's tiles, 180 rows each


def blur(pages: DataFrame) -> DataFrame:
    """img, edges (variance of the Laplacian), blur."""

    def sums(t: G.Tile) -> Iterable[tuple]:
        x = P.laplacian(t.v).astype(np.int64)
        yield t.img, x.size, int(x.sum()), int((x * x).sum())

    per = G.per_tile(G.tiled(pages, 1, P.MIRROR), 1, sums, "img long, n long, s long, ss long").groupBy("img").agg(*[F.sum(c).alias(c) for c in ("n", "s", "ss")])
    edges = (F.col("ss") - F.col("s") * F.col("s") / F.col("n").cast("double")) / F.col("n")
    return per.select("img", edges.alias("edges")).withColumn("blur", _capped(100 - F.col("edges") / 10.0))


def noise(pages: DataFrame) -> DataFrame:
    """img, level (mean distance to the median of the 5 by 5 places around), noise."""

    def sums(t: G.Tile) -> Iterable[tuple]:
        yield t.img, t.h * t.w, int(np.abs(t.core().astype(np.int64) - P.middle(t.v)).sum())

    per = G.per_tile(G.tiled(pages, 2, P.REPEAT), 2, sums, "img long, n long, s long").groupBy("img").agg((F.sum("s") / F.sum("n")).alias("level"))
    return per.join(blur(pages), "img").select("img", "level", _capped(F.col("edges") / 50.0 + F.col("level") * 5).alias("noise"))


def patches(t: G.Tile) -> Iterable[tuple]:
    """img, row, column, sum and places of the patches in a tile, or of their parts there."""
    down, across = t.height // 16, t.width // 16
    if down < 10 or across < 10:
        down, across = t.height // 4, t.width // 4
    if not down or not across:
        return
    y, x = (np.arange(t.y, t.y + t.h), np.arange(t.x, t.x + t.w))
    rows, columns = np.flatnonzero(y // down * down < t.height - down), np.flatnonzero(x // across * across < t.width - across)
    if len(rows) and len(columns):
        row, at_row = np.unique(y[rows] // down, return_index=True)
        col, at_col = np.unique(x[columns] // across, return_index=True)
        part = np.add.reduceat(np.add.reduceat(t.v[np.ix_(rows, columns)].astype(np.int64), at_row, axis=0), at_col, axis=1)
        for i, j in np.ndindex(part.shape):
            yield t.img, int(row[i]), int(col[j]), int(part[i, j]), down * across


def dark_patches(pages: DataFrame) -> DataFrame:
    """img, patches, spread (standard deviation of their means), share (of those darker than the median less one deviation), dark.

    A page is cut 16 times each way, or 4 times where that makes patches of less than 10 places; the last patches of a line, and those that reach the
    page's end, are left out. Pages too small for any have 0.
    """

    per = G.per_tile(G.tiled(pages, 0, P.ZERO), 0, patches, "img long, i int, j int, s long, places long")
    means = per.groupBy("img", "i", "j").agg((F.sum("s") / F.first("places")).alias("v"), F.lit(1).alias("n"))
    line = G.quantile_columns(means.select("img", "v", "n"), "v", {"middle": 0.5}, F.count("*").alias("patches"), F.stddev_pop("v").alias("spread"))
    dark = means.join(line, "img").groupBy("img").agg(
        F.first("patches").alias("patches"),
        F.first("spread").alias("spread"),
        (F.count_if(F.col("v") < F.col("middle") - F.col("spread")) / F.first("patches")).alias("share"),
    )
    out = pages.select("img").join(dark, "img", "left").fillna(0, ["patches", "spread", "share"])
    return out.withColumn("dark", _capped(F.col("spread") * 0.5 + F.col("share") * 100))


def difficulty(pages: DataFrame) -> DataFrame:
    """img, the six measures and their sum by weight."""
    return W.measured(pages, W.difficulty, "img long, dark double, contrast double, noise double, fade double, blur double, skew double, difficulty double", _difficulty)


def _difficulty(pages: DataFrame) -> DataFrame:
    """The same by tiles."""
    h = G.counts(pages).select("img", "v", F.col("n").cast("double").alias("n"))
    every = dark_patches(pages).select("img", "dark")
    for part in (I.contrast_of(h).drop("entropy"), noise(pages).drop("level"), I.fade_of(h), blur(pages).drop("edges"), _skew(pages).select("img", "skew")):
        every = every.join(part, "img")
    weighed = I.image_difficulty(*[F.col(c) for c in ("dark", "contrast", "noise", "fade", "blur", "skew")])
    return every.withColumn("difficulty", weighed)


def paper_bounds(pages: DataFrame) -> DataFrame:
    """img, lo, hi: the values between which a page's paper lies, its 30th and 80th percentile; at least half of a page does."""
    return G.quantile_columns(G.counts(pages), "v", {"lo": 0.3, "hi": 0.8})


def text_contrast(pages: DataFrame) -> DataFrame:
    """img, gradient (the 90th percentile of its size where a page is no brighter than at nine places of ten), contrast: high where edges are soft."""
    return W.measured(pages, W.text_contrast, "img long, gradient double, text_contrast double", _text_contrast)


def _text_contrast(pages: DataFrame) -> DataFrame:
    """The same by tiles."""
    bright = G.quantile_columns(G.counts(pages), "v", {"top": 0.9})

    def sizes(t: G.Tile) -> Iterable[tuple]:
        across, down = P.gradient(t.v, 3, 10)
        squares = (across.astype(np.int64) ** 2 + down.astype(np.int64) ** 2)[t.core() <= t.more["top"]]
        for square, n in zip(*np.unique(squares, return_counts=True), strict=True):
            yield t.img, int(square), int(n)

    per = G.per_tile(G.tiled(pages, 1, P.MIRROR).join(bright, "img"), 1, sizes, "img long, square long, n long")
    per = per.groupBy("img", "square").agg(F.sum("n").alias("n")).select("img", F.sqrt("square").alias("g"), "n")
    g = F.col("gradient")
    score = F.when(g >= 800, 15 - (g - 800) * 0.01).when(g >= 400, 15 + (800 - g) / 400 * 20).when(g >= 200, 35 + (400 - g) / 200 * 30).otherwise(65 + (200 - g) / 200 * 35)
    return G.quantile_columns(per, "g", {"gradient": 0.9}).withColumn("text_contrast", _capped(score))


def texture(pages: DataFrame) -> DataFrame:
    """img, level (mean distance to the smoothed page on paper), texture."""

    def sums(t: G.Tile) -> Iterable[tuple]:
        v = t.core().astype(np.int64)
        paper = (v >= t.more["lo"]) & (v <= t.more["hi"])
        yield t.img, int(paper.sum()), int(np.abs(v - P.smooth(t.v))[paper].sum())

    per = G.per_tile(G.tiled(pages, 2, P.MIRROR).join(paper_bounds(pages), "img"), 2, sums, "img long, n long, s long")
    per = per.groupBy("img").agg((F.sum("s") / F.sum("n")).alias("level"))
    return per.withColumn("texture", _capped(F.col("level") * 5))


def perceived(rgb: np.ndarray) -> np.ndarray:
    """Lightness, green to red, blue to yellow of colours (a row each), as whole numbers from 0 to 255."""
    x = rgb / 255.0
    x = np.where(x <= 0.04045, x / 12.92, ((x + 0.055) / 1.055) ** 2.4) @ np.array(LIGHT).T / np.array(WHITE)
    f = np.where(x > 0.008856, np.cbrt(x), 7.787 * x + 16 / 116)
    light = np.where(x[:, 1] > 0.008856, 116 * np.cbrt(x[:, 1]) - 16, 903.3 * x[:, 1])
    out = np.stack([light * 255 / 100, 500 * (f[:, 0] - f[:, 1]) + 128, 200 * (f[:, 1] - f[:, 2]) + 128], 1)
    return np.clip(np.floor(out + 0.5), 0, 255).astype(np.int64)


def colour_sums(row: dict) -> Iterable[tuple]:
    """img, places of paper (between lo and hi), and sums and sums of squares of what is perceived there."""
    v, r, g, b = (np.frombuffer(row[c], np.uint8) for c in ("v", "r", "g", "b"))
    total = np.zeros((3, 2), np.int64)
    n = 0
    for lo in range(0, len(v), 1 << 20):
        some = slice(lo, lo + (1 << 20))
        paper = (v[some] >= row["lo"]) & (v[some] <= row["hi"])
        code = (r[some][paper].astype(np.int64) << 16) | (g[some][paper].astype(np.int64) << 8) | b[some][paper]
        code, many = np.unique(code, return_counts=True)
        seen = perceived(np.stack([code >> 16, code >> 8 & 255, code & 255], 1).astype(np.float64))
        total += np.stack([many @ seen, many @ (seen * seen)], 1)
        n += int(many.sum())
    yield row["img"], n, *[int(k) for k in total.ravel()]


def paper_colour(pages: DataFrame) -> DataFrame:
    """img, spread_l, spread_a, spread_b (standard deviations of what is perceived on paper), paper_colour.

    Pages have their colours too: r, g, b, bytes as v is. Colours are counted, and each is looked at once.
    """

    per = G.by_rows(pages.join(paper_bounds(pages), "img"), colour_sums, "img long, n long, l long, ll long, a long, aa long, b long, bb long")
    spread = [F.sqrt(F.greatest(F.lit(0.0), F.col(c + c) / F.col("n") - (F.col(c) / F.col("n")) * (F.col(c) / F.col("n")))).alias(f"spread_{c}") for c in "lab"]
    return per.select("img", *spread).withColumn("paper_colour", _capped((F.col("spread_l") + F.col("spread_a") + F.col("spread_b")) / 0.5))


def masked(pages: DataFrame, per_page: DataFrame, keep) -> DataFrame:
    """Pages with 1 where ``keep`` (the values, the row of ``per_page``) holds, 0 elsewhere."""

    def work(row: dict) -> Iterable[tuple]:
        yield row["img"], row["height"], row["width"], keep(np.frombuffer(row["v"], np.uint8), row).astype(np.uint8).tobytes()

    return G.by_rows(pages.join(per_page, "img"), work, "img long, height int, width int, v binary")


def together(a: DataFrame, b: DataFrame, how) -> DataFrame:
    """Two tables of pages, place by place."""

    def work(row: dict) -> Iterable[tuple]:
        yield row["img"], row["height"], row["width"], how(np.frombuffer(row["v"], np.uint8), np.frombuffer(row["u"], np.uint8)).astype(np.uint8).tobytes()

    return G.by_rows(a.join(b.select("img", F.col("v").alias("u")), "img"), work, "img long, height int, width int, v binary")


def bright_limits(pages: DataFrame) -> DataFrame:
    """img, limit: above it a place is brighter than paper, by the mean, spread and 90th percentile of what is not below Otsu's threshold; 240 at most."""
    h = G.counts(pages).select("img", "v", F.col("n").cast("double").alias("n"))
    light = h.join(I.otsu_of(h), "img", "left").where(F.col("threshold").isNull() | (F.col("v") >= F.col("threshold")))
    mean = F.sum(F.col("v") * F.col("n")) / F.sum("n")
    stats = light.groupBy("img").agg(mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.sum(F.col("v") * F.col("v") * F.col("n")) / F.sum("n") - mean * mean)).alias("spread"))
    top = G.quantile_columns(light.select("img", "v", "n"), "v", {"top": 0.9})
    both = stats.join(top, "img")
    relative = F.least(F.lit(255.0), F.col("mean") + 2.5 * F.col("spread"))
    return both.select("img", F.least(relative, F.greatest(F.col("top"), F.col("mean") + 1.5 * F.col("spread")), F.lit(240.0)).alias("limit"))


def tears(pages: DataFrame, side: int = 3) -> DataFrame:
    """img, tear_area, hole_area, tears: openings that are brighter than paper, long or ragged ones as tears and round ones as holes.

    Openings are bright places beside edges, and large regions above 230 away from edges; spots narrower than ``side`` are taken away.
    """
    schema = "img long, tear_area long, hole_area long, tears double"
    return W.measured(pages, lambda row: W.tears(row, side), schema, lambda large: _tears(large, side))


def _tears(pages: DataFrame, side: int = 3) -> DataFrame:
    """The same by tiles."""
    zones = G.dilated(G.edges(pages), 3)
    bright = masked(pages, bright_limits(pages), lambda v, row: v > row["limit"])
    ragged = together(bright, zones, lambda v, u: v & u)
    plain = together(masked(pages, pages.select("img"), lambda v, row: v > 230), zones, lambda v, u: v & (u == 0))
    size = pages.select(F.col("img").alias("page"), (F.col("height").cast("long") * F.col("width")).alias("places"))
    found, members = G.regions(G.opened(plain, 2 * side + 1))
    large = found.join(size, F.col("img") == F.col("page")).where(F.col("area") >= F.greatest(F.lit(200), F.floor(F.col("places") / 2000)))
    plain = G.painted(G.opened(plain, 2 * side + 1), members, large.select("img", "region"))
    openings = G.opened(together(ragged, plain, lambda v, u: v | u), side)
    found = G.shapes(G.regions(openings)[0]).join(size, F.col("img") == F.col("page"))
    found = found.where((F.col("area") >= F.greatest(F.lit(50), F.floor(F.col("places") / 10000))) & (F.col("length") > 0))
    hole = (F.col("aspect") <= 2.5) & (F.col("irregularity") <= 1.3) & (F.col("compactness") > 0.5)
    per = found.groupBy("img").agg(F.sum(F.when(hole, 0).otherwise(F.col("area"))).alias("tear_area"), F.sum(F.when(hole, F.col("area")).otherwise(0)).alias("hole_area"))
    out = size.join(per, F.col("img") == F.col("page"), "left").fillna(0, ["tear_area", "hole_area"])
    score = F.least(F.lit(60.0), F.col("tear_area") / F.col("places") * 3000) + F.least(F.lit(40.0), F.col("hole_area") / F.col("places") * 2000)
    return out.select(F.col("page").alias("img"), "tear_area", "hole_area", score.alias("tears"))


def window_side(height: Column, width: Column) -> Column:
    return F.greatest(F.lit(20), F.least(F.lit(100), F.floor(F.least(height, width) / 10))).cast("int")


def window_sums(v: np.ndarray, top: int, left: int, h: int, w: int, height: int, width: int, lo: float, hi: float) -> tuple[int, float]:
    """Windows that begin in the ``h`` by ``w`` places from (top, left) on: how many hold paper enough, and the sum of its deviations there. ``v``: these
    places, and those behind and below that the windows reach."""
    side = max(20, min(100, min(height, width) // 10))
    step = side // 2
    v = v.astype(np.int64)
    paper = (v >= lo) & (v <= hi)
    total = [np.pad(x, ((1, 0), (1, 0))).cumsum(0).cumsum(1) for x in (paper.astype(np.int64), v * paper, v * v * paper)]
    y = np.arange(-(-top // step) * step, min(top + h, height - side), step) - top
    x = np.arange(-(-left // step) * step, min(left + w, width - side), step) - left
    n, s, ss = (c[np.ix_(y + side, x + side)] - c[np.ix_(y, x + side)] - c[np.ix_(y + side, x)] + c[np.ix_(y, x)] for c in total)
    some = n >= side * side * 0.3
    off = np.sqrt(np.maximum(0.0, ss[some] / n[some] - (s[some] / n[some]) ** 2))
    return int(some.sum()), float(off.sum())


def stains(pages: DataFrame) -> DataFrame:
    """img, uneven (mean deviation of the paper in windows over that of the page's), dark (share of paper that stays dark without its text), tint (as
    ``paper_colour`` without lightness), stains. Pages of less than 50 places a side have 0."""
    return W.measured(pages, W.stains, "img long, uneven double, dark double, tint double, stains double", _stains)


def _stains(pages: DataFrame) -> DataFrame:
    """The same by tiles."""
    every, pages = pages, pages.where("height >= 50 and width >= 50")
    bounds = paper_bounds(pages)
    h = G.counts(pages).join(bounds, "img").where("v between lo and hi")
    mean = F.sum(F.col("v") * F.col("n")) / F.sum("n")
    spread = F.sqrt(F.greatest(F.lit(0.0), F.sum(F.col("v") * F.col("v") * F.col("n")) / F.sum("n") - mean * mean))
    known = h.groupBy("img").agg(F.first("lo").alias("lo"), F.first("hi").alias("hi"), mean.alias("mean"), spread.alias("spread"), F.sum("n").alias("paper"))

    def windows(t: G.Tile) -> Iterable[tuple]:
        yield t.img, *window_sums(t.v[t.rim :, t.rim :], t.y, t.x, t.h, t.w, t.height, t.width, t.more["lo"], t.more["hi"])

    tiles = G.tiled(pages, 100, P.ZERO).join(known, "img")
    per = G.per_tile(tiles, 100, windows, "img long, windows long, off double").groupBy("img").agg(F.sum("windows").alias("windows"), F.sum("off").alias("off"))

    # text is closed by squares that grow with the page, some sides at a time
    sides = pages.select("img", F.greatest(F.lit(11), F.floor(window_side(F.col("height"), F.col("width")) / 5)).cast("int").alias("side"))
    sides = sides.select("img", (F.col("side") + 1 - F.col("side") % 2).alias("side"))
    plain = None
    for side in range(11, 22, 2):
        part = G.closed(pages.join(sides.where(F.col("side") == side), "img", "left_semi"), side)
        plain = part if plain is None else plain.union(part)

    def shaded(row: dict) -> Iterable[tuple]:
        v, u = np.frombuffer(row["v"], np.uint8), np.frombuffer(row["u"], np.uint8)
        paper = (v >= row["lo"]) & (v <= row["hi"])
        yield row["img"], int(((u < row["mean"] - 1.5 * row["spread"]) & paper).sum())

    both = pages.join(plain.select("img", F.col("v").alias("u")), "img").join(known, "img")
    dark = G.by_rows(both, shaded, "img long, shaded long")
    tint = paper_colour(pages).select("img", (F.col("spread_a") + F.col("spread_b")).alias("tint"))
    out = known.join(per, "img").join(dark, "img").join(tint, "img")
    out = out.select(
        "img",
        (F.col("off") / F.col("windows") / F.greatest(F.col("spread"), F.lit(1.0))).alias("uneven"),
        (F.col("shaded") / F.col("paper")).alias("dark"),
        "tint",
        F.col("windows"),
    )
    score = F.least(F.lit(30.0), F.col("uneven") * 20) + F.least(F.lit(30.0), F.col("dark") * 800) + F.least(F.lit(40.0), F.col("tint") / 0.5) * 0.25
    out = out.where("windows > 0").select("img", "uneven", "dark", "tint", _capped(score).alias("stains"))
    return every.select("img").join(out, "img", "left").fillna(0.0, ["uneven", "dark", "tint", "stains"])


def condition(pages: DataFrame) -> DataFrame:
    """img, the five measures of a page in colour and their sum by weight."""
    return W.measured(pages, W.condition, "img long, text_contrast double, paper_colour double, tears double, texture double, stains double, condition double", _condition)


def _condition(pages: DataFrame) -> DataFrame:
    """The same by tiles."""
    every = _text_contrast(pages).select("img", "text_contrast")
    for part in (paper_colour(pages).select("img", "paper_colour"), _tears(pages).select("img", "tears"), texture(pages).select("img", "texture"), _stains(pages).select("img", "stains")):
        every = every.join(part, "img")
    return every.withColumn("condition", I.condition_score(*[F.col(c) for c in ("text_contrast", "paper_colour", "tears", "texture", "stains")]))
