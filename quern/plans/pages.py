"""Queries over page images.

Texts of documents are laid out as pages of 80 places a line, a place's grey and colour by its code point; vectors are images of eight places a line.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quern.operators import pages as G
from quern.operators import paper as M
from quern.plans.registry import Tables, query
from quern.plans.ship import ship

WIDTH = 80

# As SQL: one row a place.
PX = """px as materialized (
  select img, h, i, i // 80 as y, i % 80 as x, (((255 - 7 * (coalesce(cps[i + 1], 32) - 32)) % 256 + 256) % 256)::int as v from (
    select doc_id as img, cps, (len(cps) + 79) // 80 as h, unnest(range(0, (len(cps) + 79) // 80 * 80)) as i
    from (select doc_id, list_transform(string_split(text, ''), lambda c: unicode(c)) as cps from documents where length(text) > 0)))"""
LINE = "over (partition by img order by i)"


def around(table: str, mirror: bool) -> str:
    """The places with the values around: l, r, and u and d above and below with theirs; beyond the page the last one again, or the one before it."""
    left, right = ("lead(v) " + LINE, "lag(v) " + LINE) if mirror else ("v", "v")
    up = lambda c: f"coalesce(lag({c}, 80) {LINE}, {f'lead({c}, 80) {LINE}, ' if mirror else ''}{c})"
    down = lambda c: f"coalesce(lead({c}, 80) {LINE}, {f'lag({c}, 80) {LINE}, ' if mirror else ''}{c})"
    sides = f"select img, h, i, y, x, v, case when x = 0 then {left} else lag(v) {LINE} end as l, case when x = 79 then {right} else lead(v) {LINE} end as r from {table}"
    return "(select *, " + ", ".join(f"{up(c)} as u{c}, {down(c)} as d{c}" for c in "lvr") + f" from ({sides}))"


def differences(side: int, middle: int) -> str:
    return f"{side} * (ur - ul + dr - dl) + {middle} * (r - l) as dx, {side} * (dl - ul + dr - ur) + {middle} * (dv - uv) as dy"


def grey(points: np.ndarray) -> np.ndarray:
    return (255 - 7 * (points.astype(np.int64) - 32)) % 256


def pages(t: Tables):
    ship(t.spark)
    return G.text_pages(t.dealt("documents"), "doc_id", grey, WIDTH)


def colour_pages(t: Tables):
    """With r, g and b beside the grey made of them."""

    def mixed(points: np.ndarray) -> tuple[np.ndarray, ...]:
        r, g, b = colours(points)
        return np.floor(0.299 * r + 0.587 * g + 0.114 * b + 0.5), r, g, b

    ship(t.spark)
    return G.text_pages(t.dealt("documents"), "doc_id", mixed, WIDTH, ("r", "g", "b"))


def colours(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r, p = grey(points), points.astype(np.int64)
    return r, (r + 13 * (p % 5)) % 256, (r + 29 * (p % 7)) % 256


def small_images(t: Tables):
    """Vectors as images of eight places a line."""
    ship(t.spark)
    value = lambda e: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(128 + 400 * e.cast("double")))).cast("long")
    hexed = F.array_join(F.transform("embedding", lambda e: F.lpad(F.hex(value(e)), 2, "0")), "")
    height = (F.size("embedding") / 8).cast("int")
    return t.dealt("embeddings").where(F.size("embedding") >= 8).select(F.col("vec_id").alias("img"), height.alias("height"), F.lit(8).alias("width"), F.unhex(hexed).alias("v"))


SMALL = """im as materialized (
  select img, k // 8 as y, k % 8 as x, h, greatest(0, least(255, floor(128 + 400 * e)))::int as v
  from (select vec_id as img, len(embedding) // 8 as h, unnest(embedding)::double as e, unnest(generate_series(0, len(embedding) - 1)) as k from embeddings where len(embedding) >= 8))"""

def beside(value: str, dy: int, dx: int) -> str:
    """The value of a neighbour, 0 beyond the page."""
    far = 80 * dy + dx
    there = f"coalesce({'lag' if far < 0 else 'lead'}({value}, {abs(far)}) {LINE}, 0)"
    return there if not dx else f"case when x = {0 if dx < 0 else 79} then 0 else {there} end"


EIGHT = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]
EDGES = f"""{PX},
grad as (select img, i, x, y, {differences(1, 2)} from {around("px", False)}),
sized as (
  select *, abs(dx) + abs(dy) as m, abs(dy)::bigint * 32768 < abs(dx)::bigint * 13573 as flat, abs(dy)::bigint * 32768 > abs(dx)::bigint * (13573 + 65536) as steep,
    (dx < 0) <> (dy < 0) as rising from grad),
beside as (select *, {", ".join(f"{beside('m', dy, dx)} as n{k}" for k, (dy, dx) in enumerate(EIGHT))} from sized),
ridge as materialized (
  select img, i, x, m from beside where m > 50 and case when flat then m > n3 and m >= n4 when steep then m > n1 and m >= n6 when rising then m > n2 and m > n5 else m > n0 and m > n7 end),
step as materialized (
  select r.img, r.i, unnest([{", ".join(str(80 * dy + dx) for dy, dx in EIGHT)}]) + r.i as j, unnest([{", ".join(str(dx) for _, dx in EIGHT)}]) + r.x as to_x from ridge r),
near as materialized (select s.img, s.i, s.j from step s join ridge r on r.img = s.img and r.i = s.j where to_x between 0 and 79),
reached as (select img, i from ridge where m > 150 union select n.img, n.j from reached e join near n on n.img = e.img and n.i = e.i),
edge as materialized (select img, i, i // 80 as y, i % 80 as x from reached)"""


@query("edge_density", f"""
with recursive {EDGES}
select img, count(e.img) as edges, round(count(e.img) * 255.0 / count(*), 6) as edge_density from px left join edge e using (img, i) group by img""")
def edge_density(t: Tables):
    return M.edge_density(pages(t)).select("img", "edges", F.round("edge_density", 6).alias("edge_density"))


SKEW = """
votes as materialized (
  select img, a, r, count(*) as n from (
    select img, a, floor(x * round(cos(a * pi() / 180), 12) + y * round(sin(a * pi() / 180), 12) + 0.5)::int as r from edge, (select unnest(range(0, 180)) as a)) group by img, a, r),
line as (
  select v.img, v.a, row_number() over (partition by v.img order by v.n desc, v.a, v.r) as k from votes v
  left join votes l on l.img = v.img and l.a = v.a and l.r = v.r - 1 left join votes m on m.img = v.img and m.a = v.a and m.r = v.r + 1
  left join votes b on b.img = v.img and b.a = v.a - 1 and b.r = v.r left join votes c on c.img = v.img and c.a = v.a + 1 and c.r = v.r
  where v.n > 100 and v.n > coalesce(l.n, 0) and v.n >= coalesce(m.n, 0) and v.n > coalesce(b.n, 0) and v.n >= coalesce(c.n, 0)),
skewed as (
  select img, count(a) as lines, median(a - 90) as angle from (select distinct img from px) left join (select * from line where k <= 50) using (img) group by img)"""


@query("image_skew", f"""
with recursive {EDGES}, {SKEW}
select img, lines, angle, round(least(100, coalesce(abs(angle), 0) * 10), 6) as skew from skewed""")
def image_skew(t: Tables):
    return M.skew(pages(t)).select("img", "lines", "angle", F.round("skew", 6).alias("skew"))


LAPLACE = f"laplace as (select img, var_pop(l + r + uv + dv - 4 * v) as edges from {around('px', True)} group by img)"
FIVE = "[coalesce(lag({c}, {two}) over o, lag({c}, {one}) over o, {c}), coalesce(lag({c}, {one}) over o, {c}), {c}, coalesce(lead({c}, {one}) over o, {c}), coalesce(lead({c}, {two}) over o, lead({c}, {one}) over o, {c})]"
NOISE = f"""{LAPLACE},
across as (select img, i, v, {FIVE.format(c="v", one=1, two=2)} as five from px window o as (partition by img, y order by x)),
square as (select img, v, {FIVE.format(c="five", one=80, two=160)} as near from across window o as (partition by img order by i)),
noised as (
  select img, avg(abs(v - list_sort(flatten(near))[13])) as level from square group by img)"""


@query("image_noise", f"""
with {PX}, {NOISE}
select img, round(level, 6) as level, round(least(100, edges / 50.0 + level * 5), 7) as noise from noised join laplace using (img)""")
def image_noise(t: Tables):
    return M.noise(pages(t)).select("img", F.round("level", 6).alias("level"), F.round("noise", 7).alias("noise"))


DARK = """cells as (
  select img, h, y, x, v, h // 4 as down, 20 as across from px),
patch as (
  select img, y // down as i, x // across as j, avg(v) as m from cells where h >= 4 and y // down * down < h - down and x // across * across < 80 - across group by all),
patched as (
  select img, count(*) as patches, stddev_pop(m) as spread, median(m) as middle from patch group by img),
darkened as (
  select img, patches, spread, count(*) filter (m < middle - spread) / patches as share from patch join patched using (img) group by img, patches, spread, middle)"""

@query("dark_patches", f"""
with {PX}, {DARK}
select img, coalesce(patches, 0) as patches, round(coalesce(spread, 0), 6) as spread, round(coalesce(share, 0), 6) as share, round(least(100, coalesce(spread * 0.5 + share * 100, 0)), 5) as dark
from (select distinct img from px) left join darkened using (img)""")
def dark_patches(t: Tables):
    """Lines of 80 places are cut four times across."""
    d = M.dark_patches(pages(t))
    return d.select("img", "patches", F.round("spread", 6).alias("spread"), F.round("share", 6).alias("share"), F.round("dark", 5).alias("dark"))


HISTOGRAM = """hist as materialized (select img, v, count(*)::double as n from px group by img, v),
contrasted as (
  select img, least(100, case when lo + hi = 0 then 0 else ((hi - lo) / (hi + lo)::double * 50 + entropy / 8 * 50) * 100 end) as contrast from (
    select img, min(v) as lo, max(v) as hi, -sum(n / total * log2(n / total)) as entropy from (select *, sum(n) over (partition by img) as total from hist) group by img)),
split as (
  select img, arg_min(v, (-round(w0 * (n - w0) * (s0 / w0 - (s - s0) / (n - w0)) ** 2, 4), v)) as cut from (
    select img, v, sum(n) over w as w0, sum(n * v) over w as s0, sum(n) over (partition by img) as n, sum(n * v) over (partition by img) as s from hist window w as (partition by img order by v))
  where w0 < n group by img),
faded as (
  select img, case when dark is null or light is null then 100 else least(100, greatest(0, 100 - (light - dark) * 0.8)) end as fade from (
    select img, sum(n * v) filter (v < cut) / sum(n) filter (v < cut) as dark, sum(n * v) filter (v >= cut) / sum(n) filter (v >= cut) as light from hist left join split using (img) group by img))"""


@query("page_difficulty", f"""
with recursive {EDGES}, {SKEW}, {NOISE}, {DARK}, {HISTOGRAM},
every as (
  select img, least(100, coalesce(spread * 0.5 + share * 100, 0)) as dark, contrast, least(100, edges / 50.0 + level * 5) as noise, fade, least(100, greatest(0, 100 - edges / 10.0)) as blur,
    least(100, coalesce(abs(angle), 0) * 10) as skew
  from contrasted join faded using (img) join noised using (img) join laplace using (img) join skewed using (img) left join darkened using (img))
select img, round(contrast, 7) as contrast, round(fade, 7) as fade, round(blur, 7) as blur,
  round(0.25 * dark + 0.30 * (100 - contrast) + 0.15 * noise + 0.20 * fade + 0.05 * blur + 0.05 * skew, 7) as difficulty from every""")
def page_difficulty(t: Tables):
    """Six measures of every page, weighed."""
    d = M.difficulty(pages(t))
    return d.select("img", *[F.round(c, 7).alias(c) for c in ("contrast", "fade", "blur", "difficulty")])


@query("text_contrast", f"""
with {PX},
grad as (select img, v, {differences(3, 10)} from {around("px", True)}),
top as (select img, quantile_cont(v, 0.9) as top from px group by img),
strong as (select img, quantile_cont(sqrt((dx * dx + dy * dy)::double), 0.9) as g from grad join top using (img) where v <= top group by img)
select img, round(g, 5) as gradient, round(least(100, greatest(0, case when g >= 800 then 15 - (g - 800) * 0.01 when g >= 400 then 15 + (800 - g) / 400 * 20
  when g >= 200 then 35 + (400 - g) / 200 * 30 else 65 + (200 - g) / 200 * 35 end)), 5) as text_contrast from strong""")
def text_contrast(t: Tables):
    return M.text_contrast(pages(t)).select("img", F.round("gradient", 5).alias("gradient"), F.round("text_contrast", 5).alias("text_contrast"))


PAPER = "paper as (select img, quantile_cont(v, 0.3) as lo, quantile_cont(v, 0.8) as hi from px group by img)"


@query("image_texture", f"""
with {PX}, {PAPER},
across as (
  select img, h, i, y, v, case when x = 0 then lead(v, 2) over o when x = 1 then v else lag(v, 2) over o end + 4 * case when x = 0 then lead(v) over o else lag(v) over o end + 6 * v
    + 4 * case when x = 79 then lag(v) over o else lead(v) over o end + case when x = 79 then lag(v, 2) over o when x = 78 then v else lead(v, 2) over o end as c from px window o as (partition by img order by i)),
mixed as (
  select img, v, floor((case when y >= 2 then lag(c, 160) over o when y = 1 then c else coalesce(lead(c, 160) over o, c) end + 4 * coalesce(lag(c, 80) over o, lead(c, 80) over o, c) + 6 * c
    + 4 * coalesce(lead(c, 80) over o, lag(c, 80) over o, c) + case when y <= h - 3 then lead(c, 160) over o when y = h - 2 then c else coalesce(lag(c, 160) over o, c) end + 128) / 256) as s
  from across window o as (partition by img order by i))
select img, round(avg(abs(v - s)), 6) as level, round(least(100, avg(abs(v - s)) * 5), 5) as texture from mixed join paper using (img) where v between lo and hi group by img""")
def image_texture(t: Tables):
    return M.texture(pages(t)).select("img", F.round("level", 6).alias("level"), F.round("texture", 5).alias("texture"))


@query("paper_colour", f"""
with {PX.replace("px as", "raw as")},
points as (
  select doc_id as img, unnest(range(0, len(cps))) as i, unnest(cps) as cp from (select doc_id, list_transform(string_split(text, ''), lambda c: unicode(c)) as cps from documents where length(text) > 0)),
mixed as (
  select r.img, r.v as r, (r.v + 13 * (coalesce(p.cp, 32) % 5)) % 256 as g, (r.v + 29 * (coalesce(p.cp, 32) % 7)) % 256 as b from raw r left join points p on p.img = r.img and p.i = r.y * 80 + r.x),
px as materialized (select *, floor(0.299::double * r + 0.587::double * g + 0.114::double * b + 0.5) as v from mixed),
{PAPER},
light as (
  select r, g, b, list_transform([r / 255.0::double, g / 255.0::double, b / 255.0::double], lambda c: case when c <= 0.04045 then c / 12.92 else ((c + 0.055) / 1.055) ** 2.4 end) as l from (select distinct r, g, b from px)),
xyz as (
  select r, g, b, (0.412453 * l[1] + 0.357580 * l[2] + 0.180423 * l[3]) / 0.950456 as x, 0.212671 * l[1] + 0.715160 * l[2] + 0.072169 * l[3] as y, (0.019334 * l[1] + 0.119193 * l[2] + 0.950227 * l[3]) / 1.088754 as z from light),
bent as (
  select r, g, b, y, case when x > 0.008856 then cbrt(x) else 7.787 * x + 16 / 116.0::double end as fx, case when y > 0.008856 then cbrt(y) else 7.787 * y + 16 / 116.0::double end as fy,
    case when z > 0.008856 then cbrt(z) else 7.787 * z + 16 / 116.0::double end as fz from xyz),
seen as (
  select r, g, b, greatest(0, least(255, floor(case when y > 0.008856 then 116 * fy - 16 else 903.3 * y end * 255 / 100 + 0.5))) as l,
    greatest(0, least(255, floor(500 * (fx - fy) + 128 + 0.5))) as a, greatest(0, least(255, floor(200 * (fy - fz) + 128 + 0.5))) as bb from bent)
select img, round(stddev_pop(l), 6) as spread_l, round(stddev_pop(a), 6) as spread_a, round(stddev_pop(bb), 6) as spread_b,
  round(least(100, (stddev_pop(l) + stddev_pop(a) + stddev_pop(bb)) / 0.5), 5) as paper_colour
from px join paper using (img) join seen using (r, g, b) where v between lo and hi group by img""")
def paper_colour(t: Tables):
    c = M.paper_colour(colour_pages(t))
    return c.select("img", *[F.round(f"spread_{k}", 6).alias(f"spread_{k}") for k in "lab"], F.round("paper_colour", 5).alias("paper_colour"))


BRIGHT = 150


@query("image_regions", f"""
with recursive {SMALL},
lit as materialized (select img, y, x, y * 8 + x as pos from im where v > {BRIGHT}),
near as materialized (
  select a.img, a.pos, b.pos as other from lit a cross join (select * from (values (-1), (0), (1)) p(dy), (values (-1), (0), (1)) q(dx)) k join lit b on b.img = a.img and b.y = a.y + k.dy and b.x = a.x + k.dx),
walk as (select img, pos, pos as region from lit union select n.img, n.other, w.region from walk w join near n on n.img = w.img and n.pos = w.pos where w.region < n.other or n.other <> n.pos),
named as materialized (select img, pos, min(region) as region from walk group by img, pos),
square as (
  select l.img, k.dy, l.y - k.dy as y, l.x - k.dx as x, k.dy * 2 + k.dx as corner, n.region from lit l cross join (select * from (values (0), (1)) p(dy), (values (0), (1)) q(dx)) k join named n on n.img = l.img and n.pos = l.pos),
steps as (
  select img, region, sum(case when n = 2 and c not in (3) then 1 else 0 end) as straight, sum(case when n = 3 then 1 when n = 2 and c = 3 then 2 else 0 end) as diagonal
  from (select img, region, y, x, count(*) as n, sum(corner) as c from square group by img, region, y, x) group by img, region),
boxed as (
  select img, region, count(*) as area, min(pos // 8) as y, min(pos % 8) as x, max(pos // 8) - min(pos // 8) + 1 as h, max(pos % 8) - min(pos % 8) + 1 as w from named group by img, region)
select img, region, area, y, x, h, w, round(straight + diagonal * sqrt(2), 6) as length,
  round(case when straight + diagonal > 0 then 4 * pi() * area / ((straight + diagonal * sqrt(2)) ** 2) else 0 end, 6) as compactness from boxed join steps using (img, region)""")
def image_regions(t: Tables):
    """Bright regions of small images, with their boxes and rims."""
    lit = M.masked(small_images(t), small_images(t).select("img"), lambda v, row: v > BRIGHT)
    out = G.shapes(G.regions(lit)[0])
    return out.select("img", "region", "area", F.col("top").alias("y"), F.col("left").alias("x"), "h", "w", F.round("length", 6).alias("length"), F.round("compactness", 6).alias("compactness"))


@query("image_opened", f"""
with {SMALL}, k as (select * from (values (-1), (0), (1)) p(dy), (values (-1), (0), (1)) q(dx)),
least_ as materialized (select a.img, a.y, a.x, min(b.v) as v from im a cross join k join im b on b.img = a.img and b.y = a.y + k.dy and b.x = a.x + k.dx group by a.img, a.y, a.x)
select a.img, a.y, a.x, max(b.v) as v from least_ a cross join k join least_ b on b.img = a.img and b.y = a.y + k.dy and b.x = a.x + k.dx group by a.img, a.y, a.x""")
def image_opened(t: Tables):
    """Small images without bright spots of less than three places a side."""

    def places(row: dict):
        for k, v in enumerate(row["v"]):
            yield row["img"], k // row["width"], k % row["width"], v

    return G.by_rows(G.opened(small_images(t), 3), places, "img long, y int, x int, v int")


@query("image_tears")
def image_tears(t: Tables):
    """Openings brighter than paper; tested against brute force."""
    d = M.tears(pages(t))
    return d.select("img", "tear_area", "hole_area", F.round("tears", 5).alias("tears"))


@query("image_stains")
def image_stains(t: Tables):
    """Uneven, dark and tinted paper; tested against brute force."""
    return M.stains(colour_pages(t)).select("img", *[F.round(c, 6).alias(c) for c in ("uneven", "dark", "tint", "stains")])


@query("page_condition")
def page_condition(t: Tables):
    """Five measures of every page in colour, weighed; its measures have queries of their own."""
    return M.condition(colour_pages(t)).select("img", *[F.round(c, 4).alias(c) for c in ("text_contrast", "paper_colour", "tears", "texture", "stains", "condition")])
