"""Page images as rows of bytes, cut into tiles with a rim: filters, edges, regions and morphology without a row a pixel.

A page is (img, height, width, v): a byte a place, row by row. ``tiled`` cuts pages of any size into tiles of at most ``SIZE`` places a side, each with
as much of its neighbours around it as a measure reaches, so that tiles are worked on one by one, by any executor. What a tile yields is small: counts
by value, sums, or a new tile. Regions that tiles cut through are joined where their rims overlap.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import pixels as P
from quern.sources.shared import cut

from .components import components

SIZE = 1024
TILE = "img long, height int, width int, y int, x int, h int, w int, v binary"


class Tile:
    """A tile in a task: its page and place there, its pixels with the rim, and the page's other columns."""

    def __init__(self, row: dict[str, Any], rim: int):
        self.img, self.height, self.width, self.y, self.x, self.h, self.w = (row[c] for c in ("img", "height", "width", "y", "x", "h", "w"))
        self.rim, self.more = rim, row
        self.v = np.frombuffer(row["v"], np.uint8).reshape(self.h + 2 * rim, self.w + 2 * rim)

    def core(self, v: np.ndarray | None = None) -> np.ndarray:
        return P.shifted(self.v if v is None else v, 0, 0, self.rim)

    def inside(self, rim: int) -> np.ndarray:
        """Which places of the tile, with a rim of so much, are on the page."""
        y, x = np.arange(self.y - rim, self.y + self.h + rim), np.arange(self.x - rim, self.x + self.w + rim)
        return ((y >= 0) & (y < self.height))[:, None] & ((x >= 0) & (x < self.width))[None, :]

    def row(self, v: np.ndarray) -> tuple:
        """As a row of ``TILE``."""
        return self.img, self.height, self.width, self.y, self.x, self.h, self.w, np.ascontiguousarray(v, np.uint8).tobytes()


def by_rows(df: DataFrame, work: Callable[[dict[str, Any]], Iterable[tuple]], schema: str, held: int = 8 << 20) -> DataFrame:
    """What ``work`` makes of each row, handed on whenever about ``held`` bytes are together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                for out in work(batch.slice(k, 1).to_pylist()[0]):
                    rows.append(out)
                    size += 64 + sum(len(c) for c in out if isinstance(c, bytes))
                    if size > held:
                        yield packed(rows)
                        rows, size = [], 0
        if rows:
            yield packed(rows)

    names = [f.split()[0] for f in schema.split(", ")]
    kinds = [{"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary(), "boolean": pa.bool_()}[f.split()[1]] for f in schema.split(", ")]
    packed = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
    return df.mapInArrow(run, schema)


def text_pages(docs: DataFrame, key: str, value: Callable[[np.ndarray], Any], width: int = 80, more: tuple[str, ...] = ()) -> DataFrame:
    """Texts laid out in lines of ``width`` places as pages, a place's grey by its code point; the last line is filled with spaces. Null and empty texts
    have no page. With the names of ``more`` columns ``value`` gives one array for v and each of them."""

    def laid(row: dict[str, Any]) -> Iterable[tuple]:
        points = np.frombuffer(row["text"].encode("utf-32-le", "surrogatepass"), "<u4")
        height = -(-len(points) // width)
        full = np.full(height * width, 32, np.uint32)
        full[: len(points)] = points
        of = value(full) if more else (value(full),)
        yield row["img"], height, width, *[x.astype(np.uint8).tobytes() for x in of]

    schema = "img long, height int, width int, v binary" + "".join(f", {name} binary" for name in more)
    return by_rows(docs.where("length(text) > 0").select(F.col(key).alias("img"), "text"), laid, schema)


def kept(pages: DataFrame) -> DataFrame:
    """Pages written to the shared folder once, for measures that each read them."""
    return cut(pages)


def tiled(pages: DataFrame, rim: int, border: str, size: int | None = None) -> DataFrame:
    """Tiles of pages with a rim; beyond the page's ends it is filled as ``border`` says."""
    size = size or SIZE

    def cut_up(row: dict[str, Any]) -> Iterable[tuple]:
        height, width = row["height"], row["width"]
        page = np.frombuffer(row["v"], np.uint8).reshape(height, width)
        for y in range(0, height, size):
            for x in range(0, width, size):
                h, w = min(size, height - y), min(size, width - x)
                down, across = np.arange(y - rim, y + h + rim), np.arange(x - rim, x + w + rim)
                v = page[P.place(down, height, border)[:, None], P.place(across, width, border)[None, :]]
                if border == P.ZERO:
                    v = v * (((down >= 0) & (down < height))[:, None] & ((across >= 0) & (across < width))[None, :])
                yield row["img"], height, width, y, x, h, w, np.ascontiguousarray(v, np.uint8).tobytes()

    return by_rows(pages.select("img", "height", "width", "v"), cut_up, TILE)


def per_tile(tiles: DataFrame, rim: int, work: Callable[[Tile], Iterable[tuple]], schema: str) -> DataFrame:
    """What ``work`` makes of each tile."""
    return by_rows(tiles, lambda row: work(Tile(row, rim)), schema)


def assembled(tiles: DataFrame) -> DataFrame:
    """Pages of tiles without a rim, which are worked out once and written to the shared folder; an image that one tile holds is that tile."""
    tiles = cut(tiles)
    alone = tiles.where("h = height and w = width").select("img", "height", "width", "v")
    listed = tiles.where("h < height or w < width").groupBy("img").agg(
        F.first("height").alias("height"),
        F.first("width").alias("width"),
        F.collect_list(F.struct("y", "x", "h", "w", "v")).alias("tiles"),  # the tiles of one page
    )

    def together(row: dict[str, Any]) -> Iterable[tuple]:
        page = np.zeros((row["height"], row["width"]), np.uint8)
        for t in row["tiles"]:
            page[t["y"] : t["y"] + t["h"], t["x"] : t["x"] + t["w"]] = np.frombuffer(t["v"], np.uint8).reshape(t["h"], t["w"])
        yield row["img"], row["height"], row["width"], page.tobytes()

    return alone.union(by_rows(listed, together, "img long, height int, width int, v binary"))


def counts(pages: DataFrame) -> DataFrame:
    """img, v, n: the histogram of every page."""

    def counted(row: dict[str, Any]) -> Iterable[tuple]:
        n = np.bincount(np.frombuffer(row["v"], np.uint8), minlength=256)
        for v in np.flatnonzero(n):
            yield row["img"], int(v), int(n[v])

    return by_rows(pages.select("img", "v"), counted, "img long, v int, n long")


def quantile_columns(counted: DataFrame, value: str, qs: dict[str, float], *more: Column) -> DataFrame:
    """img, a quantile a name of ``qs`` of values (img, ``value``, n) counted n times, between the two nearest ranks, and aggregates over the groups."""
    order = Window.partitionBy("img").orderBy(value)
    runs = counted.withColumn("upto", F.sum("n").over(order)).withColumn("all", F.sum("n").over(Window.partitionBy("img")))

    def at(rank: Column) -> Column:
        return F.min(F.when(F.col("upto") > rank, F.col(value)))

    out = {}
    for name, q in qs.items():
        place = (F.col("all") - 1) * F.lit(q)
        out[name] = at(F.floor(place)) + (at(F.ceil(place)) - at(F.floor(place))) * (F.max(place) - F.floor(F.max(place)))
    return runs.groupBy("img").agg(*[c.alias(n) for n, c in out.items()], *more)


def edges(pages: DataFrame, low: int = 50, high: int = 150) -> DataFrame:
    """Pages of the same size, 1 on edges: ridges of the gradient above ``high``, and those above ``low`` that are connected with them."""

    def classed(t: Tile) -> Iterable[tuple]:
        yield t.row(P.edge_classes(t.v, low, high, t.inside(1)))

    ridges = assembled(per_tile(tiled(pages, 2, P.REPEAT), 2, classed, TILE))
    return kept_regions(ridges, lambda r: F.col("most") == P.STRONG)


def parts(t: Tile) -> Iterable[tuple]:
    """What ``region_parts`` says of one tile."""
    label = P.regions(t.v > 0)
    n = int(label.max()) + 1
    if n == 1:
        return
    own = t.core(label)
    rows, columns = np.nonzero(own)
    of = own[rows, columns]
    area = np.bincount(of, minlength=n)
    box = [np.full(n, k) for k in (1 << 30, -1, 1 << 30, -1)]
    for out, at, far in zip(box, (rows, rows, columns, columns), (np.minimum, np.maximum) * 2, strict=True):
        far.at(out, of, at)
    least, most = np.full(n, 1 << 62), np.zeros(n, np.int64)
    np.minimum.at(least, of, (rows + t.y) * t.width + columns + t.x)
    np.maximum.at(most, of, t.core()[rows, columns])
    straight, diagonal = P.contour(t.v > 0)
    lead = np.maximum(np.maximum(label[:-1, :-1], label[:-1, 1:]), np.maximum(label[1:, :-1], label[1:, 1:]))
    first = slice(0 if t.y == 0 else 1, None), slice(0 if t.x == 0 else 1, None)  # windows up and left belong to the tile there
    steps = [np.bincount(lead[first].ravel(), s[first].ravel(), n).astype(np.int64) for s in (straight, diagonal)]
    rim = np.concatenate([label[:2].ravel(), label[-2:].ravel(), label[:, :2].ravel(), label[:, -2:].ravel()])
    cut_ = np.zeros(n, bool)
    cut_[rim] = t.h < t.height or t.w < t.width
    for k in range(1, n):
        if area[k] or cut_[k]:
            there = area[k] > 0
            sides = [int(b[k] + o) if there else None for b, o in zip(box, (t.y, t.y, t.x, t.x), strict=True)]
            yield (t.img, t.y, t.x, k, int(least[k]) if there else None, int(area[k]), int(most[k]), *sides, int(steps[0][k]), int(steps[1][k]), bool(cut_[k]))


def region_parts(tiles: DataFrame) -> DataFrame:
    """What each tile (rim 1, beyond the page 0) holds of each region of places that are not 0: img, y, x (the tile), part (a number inside the tile),
    least (the least place of the page in it, row by row), area, most (the greatest value), its box, steps along its rim, and whether it goes on."""

    return per_tile(
        tiles,
        1,
        parts,
        "img long, y int, x int, part int, least long, area long, most int, top int, bottom int, left int, right int, straight long, diagonal long, goes_on boolean",
    )


def _rims(tiles: DataFrame) -> DataFrame:
    """img, at (a place of the page), y, x, part: the places in the two rows and columns along each inner side of a tile, which its neighbour labels too."""

    def strips(t: Tile) -> Iterable[tuple]:
        if t.h == t.height and t.w == t.width:
            return
        label = P.regions(t.v > 0)
        near = np.zeros(label.shape, bool)
        near[:2] = near[-2:] = True
        near[:, :2] = near[:, -2:] = True
        rows, columns = np.nonzero(near & (label > 0))
        for r, c in zip(rows.tolist(), columns.tolist(), strict=True):
            yield t.img, (r - 1 + t.y) * t.width + c - 1 + t.x, t.y, t.x, int(label[r, c])

    return per_tile(tiles, 1, strips, "img long, at long, y int, x int, part int")


def regions(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(regions, members) of connected places, also diagonally, that are not 0.

    regions: img, region (its least place, row by row), area, most, top, bottom, left, right, and the steps along its rim, straight and diagonal, those
    around holes included. members: img, y, x, part and region of every part of a tile.
    """
    tiles = cut(tiled(pages, 1, P.ZERO))
    found = cut(region_parts(tiles))
    sums = [F.sum(c).cast("long").alias(c) for c in ("area", "straight", "diagonal")]
    box = [f(c).alias(c) for f, c in ((F.max, "most"), (F.min, "top"), (F.max, "bottom"), (F.min, "left"), (F.max, "right"))]
    keep = ["img", "region", "area", "straight", "diagonal", "most", "top", "bottom", "left", "right"]
    if tiles.where("h < height or w < width").isEmpty():
        found = found.withColumn("region", F.col("least"))
        return found.select(*keep), found.select("img", "y", "x", "part", "region")
    own = cut(found.where("goes_on").select("img", "y", "x", "part").withColumn("id", F.monotonically_increasing_id()))
    seen = _rims(tiles).join(own, ["img", "y", "x", "part"]).select("img", "at", "id").distinct()
    pairs = seen.groupBy("img", "at").agg(F.sort_array(F.collect_set("id")).alias("ids"))  # of at most four tiles
    joins = pairs.select(F.col("ids")[0].alias("a"), F.explode(F.slice("ids", 2, 4)).alias("b")).distinct()
    whole = own.join(components(joins), "id", "left").withColumn("group", F.coalesce("component", "id")).drop("component", "id")
    parts = found.join(whole, ["img", "y", "x", "part"], "left")
    named = parts.where("group is not null").groupBy("img", "group").agg(F.min("least").alias("region"))
    parts = cut(parts.join(named, ["img", "group"], "left").withColumn("region", F.coalesce("region", "least")))
    return parts.groupBy("img", "region").agg(*sums, *box).select(*keep), parts.select("img", "y", "x", "part", "region")


def kept_regions(pages: DataFrame, keep: Callable[[DataFrame], Column]) -> DataFrame:
    """Pages with 1 on the places of the regions for which ``keep`` holds, 0 elsewhere."""
    found, members = regions(pages)
    return painted(pages, members, found.where(keep(found)).select("img", "region"))


def painted(pages: DataFrame, members: DataFrame, kept: DataFrame) -> DataFrame:
    """The same pages with 1 on the places of the regions kept (img, region), 0 elsewhere; ``members`` as ``regions`` gives them."""
    some = members.join(kept, ["img", "region"]).groupBy("img", "y", "x").agg(F.collect_list("part").alias("parts"))  # of one tile

    def paint(t: Tile) -> Iterable[tuple]:
        label = P.regions(t.v > 0)
        keep = np.zeros(int(label.max()) + 1, bool)
        keep[t.more["parts"] or []] = True
        yield t.row(t.core(keep[label].astype(np.uint8)))

    return assembled(per_tile(tiled(pages, 1, P.ZERO).join(some, ["img", "y", "x"], "left"), 1, paint, TILE))


def shapes(found: DataFrame) -> DataFrame:
    """Adds to regions: length (of the rim), compactness (4 pi area over length squared), aspect (long side over short) and irregularity (length over that
    of a circle of the same area). A region of one place has no rim: its compactness is 0, as it has no area to compare."""
    wide = found.withColumn("h", F.col("bottom") - F.col("top") + 1).withColumn("w", F.col("right") - F.col("left") + 1)
    wide = wide.withColumn("length", F.col("straight") + F.col("diagonal") * F.sqrt(F.lit(2.0)))
    pi = F.lit(np.pi)
    return wide.select(
        "img",
        "region",
        "area",
        "top",
        "left",
        "h",
        "w",
        "length",
        F.when(F.col("length") > 0, 4 * pi * F.col("area") / (F.col("length") * F.col("length"))).otherwise(0.0).alias("compactness"),
        (F.greatest("h", "w") / F.least("h", "w")).alias("aspect"),
        (F.col("length") / F.greatest(2 * pi * F.sqrt(F.col("area") / pi), F.lit(1.0))).alias("irregularity"),
    )


def mapped(pages: DataFrame, rim: int, border: str, change: Callable[[Tile], np.ndarray]) -> DataFrame:
    """Pages of the same size, each tile changed by itself."""
    return assembled(per_tile(tiled(pages, rim, border), rim, lambda t: [t.row(change(t))], TILE))


def opened(pages: DataFrame, side: int) -> DataFrame:
    """Bright spots narrower than ``side`` (odd) taken away: the least, then the greatest of squares, which are cut off at the page's ends."""
    return _extremes(pages, side, P.eroded, P.dilated, 255, 0)


def closed(pages: DataFrame, side: int) -> DataFrame:
    """Dark spots narrower than ``side`` (odd) taken away."""
    return _extremes(pages, side, P.dilated, P.eroded, 0, 255)


def _extremes(pages: DataFrame, side: int, one: Callable, two: Callable, no_one: int, no_two: int) -> DataFrame:
    if side % 2 == 0:
        raise ValueError("a square around a place has an odd side")
    reach = side // 2

    def change(t: Tile) -> np.ndarray:
        first = one(np.where(t.inside(2 * reach), t.v, no_one), side)
        return two(np.where(t.inside(reach), first, no_two), side)

    return mapped(pages, 2 * reach, P.REPEAT, change)


def dilated(pages: DataFrame, side: int) -> DataFrame:
    """The greatest of the square of ``side`` (odd) around each place."""
    return mapped(pages, side // 2, P.REPEAT, lambda t: P.dilated(t.v, side))
