"""Page measures against brute force, place by place, on pages cut into many tiles and into one."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import pixels as P
from quern.operators import pages as G
from quern.operators import paper as M
from quern.plans.ship import ship


@pytest.fixture(params=[1024, 16])
def size(request, spark, monkeypatch):
    ship(spark)
    monkeypatch.setattr(G, "SIZE", request.param)
    return request.param


def pages_of(spark, pages):
    return spark.createDataFrame([(i, *p.shape, bytearray(p.astype(np.uint8).tobytes())) for i, p in enumerate(pages)], "img long, height int, width int, v binary")


def back(df):
    return {r.img: np.frombuffer(r.v, np.uint8).reshape(r.height, r.width) for r in df.collect()}


def some_pages():
    """Noise, a slanted page, dots, a chequered corner, and pages of one place, row and column."""
    rng = np.random.default_rng(4)
    noisy = rng.integers(0, 256, (37, 53))
    slanted = np.full((60, 70), 200)
    for k in range(5, 60, 12):
        for x in range(70):
            slanted[min(59, k + x // 9), x] = 20
    soft = np.add.outer(np.arange(40), np.arange(45)) * 3 % 256
    dots = np.where(rng.random((33, 48)) < 0.4, 255, 0)
    return [noisy, slanted, soft, dots, np.full((1, 1), 7), rng.integers(0, 256, (1, 40)), rng.integers(0, 256, (40, 1))]


def held(page, y, x):
    return int(page[min(max(y, 0), len(page) - 1), min(max(x, 0), page.shape[1] - 1)])


def edges_of(page, low=50, high=150):
    h, w = page.shape
    size, dxs, dys = (np.zeros((h + 2, w + 2), int) for _ in range(3))
    for y in range(h):
        for x in range(w):
            at = lambda a, b, y=y, x=x: held(page, y + a, x + b)
            dx = at(-1, 1) + 2 * at(0, 1) + at(1, 1) - at(-1, -1) - 2 * at(0, -1) - at(1, -1)
            dy = at(1, -1) + 2 * at(1, 0) + at(1, 1) - at(-1, -1) - 2 * at(-1, 0) - at(-1, 1)
            size[y + 1, x + 1], dxs[y + 1, x + 1], dys[y + 1, x + 1] = abs(dx) + abs(dy), dx, dy
    ridge = {}
    for y in range(1, h + 1):
        for x in range(1, w + 1):
            m, dx, dy = size[y, x], dxs[y, x], dys[y, x]
            if m <= low:
                continue
            if abs(dy) << 15 < abs(dx) * 13573:
                top = m > size[y, x - 1] and m >= size[y, x + 1]
            elif abs(dy) << 15 > abs(dx) * (13573 + 65536):
                top = m > size[y - 1, x] and m >= size[y + 1, x]
            else:
                s = -1 if (dx < 0) != (dy < 0) else 1
                top = m > size[y - 1, x - s] and m > size[y + 1, x + s]
            if top:
                ridge[y - 1, x - 1] = m
    todo = [p for p, m in ridge.items() if m > high]
    seen = set(todo)
    while todo:
        y, x = todo.pop()
        for p in ((y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)):
            if p in ridge and p not in seen:
                seen.add(p)
                todo.append(p)
    out = np.zeros((h, w), np.uint8)
    for p in seen:
        out[p] = 1
    return out


def regions_of(mask):
    """Sets of connected places, by flooding."""
    left, out = set(zip(*np.nonzero(mask), strict=True)), []
    while left:
        todo, own = [left.pop()], set()
        while todo:
            y, x = todo.pop()
            own.add((int(y), int(x)))
            for p in ((y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)):
                if p in left:
                    left.remove(p)
                    todo.append(p)
        out.append(own)
    return out


def rim_of(own):
    """Length of the rim by neighbours: once for each side of a pair that has no third place, diagonals likewise."""
    total = 0.0
    for y, x in own:
        for a, b in ((0, 1), (1, 0)):
            if (y + a, x + b) in own:
                total += sum((y + s * b, x + s * a) not in own and (y + a + s * b, x + b + s * a) not in own for s in (-1, 1))
        for b in (-1, 1):
            if (y + 1, x + b) in own:
                third = ((y + 1, x) in own) + ((y, x + b) in own)
                total += math.sqrt(2) * (2 - third if third < 2 else 0)
    for y, x in {(y + a, x + b) for y, x in own for a in (-1, 0) for b in (-1, 0)}:
        square = [(y, x) in own, (y, x + 1) in own, (y + 1, x) in own, (y + 1, x + 1) in own]
        if sum(square) == 3 and not ((square[0] and square[3]) or (square[1] and square[2])):
            raise AssertionError
    return total


def square_of(page, side, change):
    k = side // 2
    return np.array([[change(page[max(0, y - k) : y + k + 1, max(0, x - k) : x + k + 1]) for x in range(page.shape[1])] for y in range(len(page))])


def test_edges(spark, size):
    pages = some_pages()
    got = back(G.edges(pages_of(spark, pages)))
    for i, p in enumerate(pages):
        assert (got[i] == edges_of(p)).all(), i
    density = {r.img: r.edge_density for r in M.edge_density(pages_of(spark, pages)).collect()}
    assert density == pytest.approx({i: got[i].mean() * 255 for i in got})


def test_regions(spark, size):
    rng = np.random.default_rng(7)
    masks = [(rng.random((40, 50)) < share).astype(np.uint8) * 2 for share in (0.2, 0.35, 0.5, 0.9)]
    spiral = np.zeros((35, 35), np.uint8)
    for k in range(0, 16, 2):
        spiral[k, k : 35 - k] = spiral[34 - k, k : 35 - k] = spiral[k : 35 - k, 34 - k] = 1
        spiral[k + 2 : 35 - k, k] = 1
        spiral[k + 2, k : k + 2] = 1
    masks += [spiral, np.ones((33, 47), np.uint8), np.zeros((5, 5), np.uint8), np.eye(20, dtype=np.uint8)]
    found = G.shapes(G.regions(pages_of(spark, masks))[0]).collect()
    got = sorted((r.img, r.region, r.area, r.top, r.left, r.h, r.w, round(r.length, 6)) for r in found)
    want = []
    for i, m in enumerate(masks):
        for own in regions_of(m):
            ys, xs = [p[0] for p in own], [p[1] for p in own]
            least = min(y * m.shape[1] + x for y, x in own)
            want.append((i, least, len(own), min(ys), min(xs), max(ys) - min(ys) + 1, max(xs) - min(xs) + 1, round(rim_of(own), 6)))
    assert got == sorted(want)
    assert [(r.length, r.aspect) for r in found if r.img == 5] == [(2 * 32 + 2 * 46, 47 / 33)]
    assert [r.length for r in found if r.img == 7] == [pytest.approx(2 * 19 * math.sqrt(2))]


@pytest.mark.parametrize("side", [3, 7])
def test_opened_and_closed(spark, size, side):
    pages = some_pages()
    for operator, one, two in ((G.opened, np.min, np.max), (G.closed, np.max, np.min)):
        got = back(operator(pages_of(spark, pages), side))
        for i, p in enumerate(pages):
            assert (got[i] == square_of(square_of(p, side, one), side, two)).all()
    with pytest.raises(ValueError):
        G.opened(pages_of(spark, pages), 4)


def test_running_extremes():
    rng = np.random.default_rng(1)
    for n, side in ((20, 1), (20, 3), (21, 7), (9, 9), (30, 11)):
        v = rng.integers(0, 99, (4, n))
        assert (P.running(v, side, True, 1) == [[min(r[i : i + side]) for i in range(n - side + 1)] for r in v]).all()
        assert (P.running(v.T, side, False, 0).T == [[max(r[i : i + side]) for i in range(n - side + 1)] for r in v]).all()


def test_skew(spark, size):
    """Votes of every edge, and the middle angle of the lines."""
    pages = [np.full((200, 220), 210) for _ in range(3)] + [np.zeros((3, 3))]
    for y in range(20, 180, 30):
        pages[0][y : y + 3, 10:210] = 10
        for x in range(10, 210):
            pages[1][y + x // 15 : y + x // 15 + 3, x] = 10
    got = {r.img: r for r in M.skew(pages_of(spark, pages)).collect()}
    for i, p in enumerate(pages):
        votes = {}
        for y, x in zip(*np.nonzero(edges_of(p) if i < 2 else np.zeros(p.shape)), strict=True):
            for a in range(180):
                r = math.floor(x * round(math.cos(a * math.pi / 180), 12) + y * round(math.sin(a * math.pi / 180), 12) + 0.5)
                votes[a, r] = votes.get((a, r), 0) + 1
        n = lambda a, r, votes=votes: votes.get((a, r), 0)
        top = [(-v, a, r) for (a, r), v in votes.items() if v > 100 and v > n(a, r - 1) and v >= n(a, r + 1) and v > n(a - 1, r) and v >= n(a + 1, r)]
        angles = [a - 90 for _, a, _ in sorted(top)[:50]]
        assert got[i].lines == len(angles) and got[i].angle == (float(np.median(angles)) if angles else None)
    assert got[0].lines > 5 and got[0].angle == 0 and got[1].angle == pytest.approx(4, abs=1) and got[2].skew == got[3].skew == 0


def test_measures_do_not_depend_on_tiles(spark, size):
    pages = some_pages() + [np.random.default_rng(3).integers(90, 200, (170, 180))]
    df = pages_of(spark, pages)
    near = lambda p, y, x, k: [held(p, y + a, x + b) for a in range(-k, k + 1) for b in range(-k, k + 1)]
    got = {r.img: r.level for r in M.noise(df).collect()}
    assert got == pytest.approx({i: np.mean([[abs(int(p[y, x]) - sorted(near(p, y, x, 2))[12]) for x in range(p.shape[1])] for y in range(len(p))]) for i, p in enumerate(pages)})
    wide = [np.pad(p.astype(int), [(2, 2) if n > 2 else (0, 0) for n in p.shape], mode="reflect") if min(p.shape) > 2 else None for p in pages]
    laplace, texture, strong = {}, {}, {}
    for i, (p, v) in enumerate(zip(pages, wide, strict=True)):
        if v is None:
            continue
        s = lambda a, b, v=v, p=p: v[2 + a : 2 + a + len(p), 2 + b : 2 + b + p.shape[1]]
        laplace[i] = np.var(s(0, 1) + s(0, -1) + s(1, 0) + s(-1, 0) - 4 * s(0, 0))
        k = (1, 4, 6, 4, 1)
        smooth = (sum(k[a + 2] * k[b + 2] * s(a, b) for a in range(-2, 3) for b in range(-2, 3)) + 128) // 256
        paper = (p >= np.percentile(p, 30)) & (p <= np.percentile(p, 80))
        texture[i] = np.abs(p - smooth)[paper].mean()
        gx = 3 * (s(-1, 1) - s(-1, -1) + s(1, 1) - s(1, -1)) + 10 * (s(0, 1) - s(0, -1))
        gy = 3 * (s(1, -1) - s(-1, -1) + s(1, 1) - s(-1, 1)) + 10 * (s(1, 0) - s(-1, 0))
        strong[i] = np.percentile(np.hypot(gx, gy)[p <= np.percentile(p, 90)], 90)
    for df_, column, want in ((M.blur(df), "edges", laplace), (M.texture(df), "level", texture), (M.text_contrast(df), "gradient", strong)):
        assert {r.img: r[column] for r in df_.collect() if r.img in want} == pytest.approx(want)
    dark = {r.img: (r.patches, r.spread, r.share) for r in M.dark_patches(df).collect()}
    for i, p in enumerate(pages):
        h, w = (n // 16 for n in p.shape)
        h, w = (n // 4 for n in p.shape) if h < 10 or w < 10 else (h, w)
        m = [p[y : y + h, x : x + w].mean() for y in range(0, len(p) - h, h) for x in range(0, p.shape[1] - w, w)] if h and w else []
        want = (len(m), np.std(m), np.mean(np.array(m) < np.median(m) - np.std(m))) if m else (0, 0, 0)
        assert dark[i] == pytest.approx(want), i


def worn(rng):
    """Paper with lines of text, a round hole, a long tear, a white patch away from edges, and a dark stain."""
    page = rng.normal(170, 4, (240, 260))
    for y in range(20, 220, 12):
        page[y : y + 3, 15:245:2] = 60
    yy, xx = np.mgrid[:240, :260]
    page[(yy - 120) ** 2 + (xx - 60) ** 2 < 400] = 250
    page[194:212, 100:250] = 252
    soft = np.clip(1 - np.hypot(yy - 60, xx - 180) / 40, 0, 1)
    page += soft * 80
    page -= np.clip(1 - np.hypot(yy - 150, xx - 180) / 30, 0, 1) * 50
    return np.clip(page, 0, 255).astype(np.uint8)


def tears_of(p, side=3):
    n = np.bincount(p.ravel(), minlength=256).astype(float)
    v = np.arange(256)
    w0, s0 = np.cumsum(n), np.cumsum(n * v)
    with np.errstate(all="ignore"):
        between = np.where((n > 0) & (w0 < p.size), w0 * (p.size - w0) * (s0 / w0 - (s0[-1] - s0) / (p.size - w0)) ** 2, -1)
    light = p[p >= int(np.argmax(np.round(between, 4)))].astype(float)
    limit = min(255, light.mean() + 2.5 * light.std(), max(np.percentile(light, 90), light.mean() + 1.5 * light.std()), 240)
    zones = square_of(edges_of(p), 3, np.max) > 0
    opening = lambda m, k: square_of(square_of(m.astype(int), k, np.min), k, np.max)
    plain = np.zeros(p.shape, int)
    for own in regions_of(opening((p > 230) & ~zones, 2 * side + 1)):
        if len(own) >= max(200, p.size // 2000):
            for at in own:
                plain[at] = 1
    tear = hole = 0
    for own in regions_of(opening(((p > limit) & zones) | (plain > 0), side)):
        area, length = len(own), rim_of(own)
        if area >= max(50, p.size // 10000) and length:
            h, w = (max(q[k] for q in own) - min(q[k] for q in own) + 1 for k in (0, 1))
            ragged = max(h, w) / min(h, w) > 2.5 or length / max(2 * math.pi * math.sqrt(area / math.pi), 1) > 1.3
            if not ragged and 4 * math.pi * area / length**2 > 0.5:
                hole += area
            else:
                tear += area
    return tear, hole, min(60, tear / p.size * 3000) + min(40, hole / p.size * 2000)


def test_tears(spark, monkeypatch):
    ship(spark)
    rng = np.random.default_rng(6)
    pages = [worn(rng), rng.normal(150, 3, (60, 70)).astype(np.uint8), np.full((5, 5), 9, np.uint8)]
    want = {i: tears_of(p) for i, p in enumerate(pages)}
    assert want[0][0] > 200 and want[0][1] > 500
    for size in (1024, 64):
        monkeypatch.setattr(G, "SIZE", size)
        got = {r.img: (r.tear_area, r.hole_area, r.tears) for r in M.tears(pages_of(spark, pages)).collect()}
        assert got == {i: pytest.approx(w) for i, w in want.items()}, size


def stains_of(p, rgb):
    h, w = p.shape
    if min(h, w) < 50:
        return 0, 0, 0, 0
    lo, hi = np.percentile(p, 30), np.percentile(p, 80)
    paper, v = (p >= lo) & (p <= hi), p.astype(float)
    side = max(20, min(100, min(h, w) // 10))
    off = []
    for y in range(0, h - side, side // 2):
        for x in range(0, w - side, side // 2):
            m = paper[y : y + side, x : x + side]
            if m.sum() >= side * side * 0.3:
                off.append(v[y : y + side, x : x + side][m].std())
    if not off:
        return 0, 0, 0, 0
    k = max(11, side // 5)
    k += 1 - k % 2
    shut = square_of(square_of(p, k, np.max), k, np.min)
    uneven = np.mean(off) / max(v[paper].std(), 1)
    dark = ((shut < v[paper].mean() - 1.5 * v[paper].std()) & paper).sum() / paper.sum()
    seen = M.perceived(rgb[paper].astype(float))
    tint = seen[:, 1].std() + seen[:, 2].std()
    return uneven, dark, tint, min(100, min(30, uneven * 20) + min(30, dark * 800) + min(40, tint / 0.5) * 0.25)


def test_stains_and_condition(spark, monkeypatch):
    ship(spark)
    rng = np.random.default_rng(9)
    pages = [worn(rng), rng.normal(150, 3, (60, 70)).astype(np.uint8), np.full((20, 90), 9, np.uint8)]
    colours = [np.stack([p, np.clip(p.astype(int) - 20, 0, 255), np.clip(p.astype(int) - rng.integers(0, 60, p.shape), 0, 255)], -1).astype(np.uint8) for p in pages]
    rows = [(i, *p.shape, *[bytearray(c.tobytes()) for c in (p, *(c[..., k].copy() for k in range(3)))]) for i, (p, c) in enumerate(zip(pages, colours, strict=True))]
    df = spark.createDataFrame(rows, "img long, height int, width int, v binary, r binary, g binary, b binary")
    want = {i: stains_of(p, c) for i, (p, c) in enumerate(zip(pages, colours, strict=True))}
    for size in (1024, 70):
        monkeypatch.setattr(G, "SIZE", size)
        got = {r.img: (r.uneven, r.dark, r.tint, r.stains) for r in M.stains(df).collect()}
        assert got == {i: pytest.approx(w) for i, w in want.items()}, size
    assert want[0][0] > 0
    whole = {r.img: r for r in M.condition(df).collect()}
    one = whole[0]
    assert len(whole) == 3 and one.tears == pytest.approx(tears_of(pages[0])[2])
    assert one.condition == pytest.approx(0.35 * one.text_contrast + 0.25 * one.tears + 0.2 * one.paper_colour + 0.1 * one.texture + 0.1 * one.stains)


def test_perceived_colours():
    """White, black, grey and the pure colours."""
    got = M.perceived(np.array([[255, 255, 255], [0, 0, 0], [119, 119, 119], [255, 0, 0], [0, 255, 0], [0, 0, 255]], float))
    assert got.tolist() == [[255, 128, 128], [0, 128, 128], [128, 128, 128], [136, 208, 195], [224, 42, 211], [82, 207, 20]]


def test_odd_pages(spark, size):
    """No page, and texts that make none."""
    none = pages_of(spark, some_pages()).limit(0)
    for measure in (M.edge_density, M.skew, M.noise, M.text_contrast, M.texture, M.tears, M.dark_patches):
        assert measure(none).isEmpty()
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "é" * 81), (4, "😀")], "doc long, text string")
    got = back(G.text_pages(docs, "doc", lambda p: p % 251))
    assert sorted(got) == [3, 4] and got[3].shape == (2, 80) and got[3][1].tolist() == [ord("é") % 251] + [32] * 79
