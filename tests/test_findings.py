"""What the findings of a round asked for."""

import datetime
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quern import catalog
from quern.operators import graph
from quern.operators import pages as G
from quern.operators import paper as M
from quern.operators import similarity as C
from quern.plans.ship import ship
from quern.sources import tables


def test_running_best_does_not_hang_on_partitions(spark, tmp_path):
    """Two days of the same values have the same mean, though the second day's lie in two files: (0.1 + 0.2) + 0.3 is above 0.1 + (0.2 + 0.3)."""
    days = [datetime.datetime(2024, 1, d, 12) for d in (1, 2, 3)]
    one = [(1, days[0], 7, 0.1), (2, days[0], 7, 0.2), (3, days[0], 7, 0.3), (4, days[1], 7, 0.1), (8, days[2], 7, None)]
    two = [(6, days[1], 7, 0.3), (5, days[1], 7, 0.2), (7, days[2], 9, 1.0)]
    for rows in (one, two):
        spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, value double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    got = {(r.station, r.day): r.new_best for r in catalog.QUERIES["running_best"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"create view events as select * from (values {', '.join(str((i, str(t), u, v)).replace('None', 'null') for i, t, u, v in sorted(one + two))}) v(event_id, ts, user_id, value)")
    con.execute("create view typed as select event_id, ts::timestamp as ts, user_id, value::double as value from events; set threads = 1")
    want = con.execute(catalog.ORACLES["running_best"].replace("from events", "from typed")).fetchall()
    assert got == {(s, d): b for s, d, b in want} == {(7, "2024-01-01"): True, (7, "2024-01-02"): False, (7, "2024-01-03"): None, (9, "2024-01-03"): True}


def test_a_name_looks_into_its_range_once(spark):
    """No frame of a window runs on to the end of its range, where each row would be worked out from all that follow."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("ab") for _ in range(rng.randrange(1, 9)))
    names, files = [word() for _ in range(300)], sorted({word() for _ in range(150)})
    df = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    out = tables.resolve_files(df, spark.createDataFrame([(f,) for f in files], "file string"), "id")
    assert "unboundedfollowing" not in out._jdf.queryExecution().toString().lower()
    assert {r.id: r.file for r in out.collect()} == {i: next((f for f in files if f.startswith(n)), None) for i, n in enumerate(names)}


@pytest.mark.parametrize("measure", [M.text_contrast, M.skew, M.difficulty, M.tears, M.stains, M.condition], ids=lambda f: f.__name__)
def test_pages_of_one_tile_are_not_shuffled(spark, monkeypatch, measure):
    """A page is measured from its row, to what its tiles give."""
    ship(spark)
    rng = np.random.default_rng(4)
    rows = []
    for i, (h, w) in enumerate([(90, 80), (1, 80), (60, 130), (51, 52)]):
        v = [np.clip(rng.normal(170, 9, (h, w)), 0, 255).astype(np.uint8) for _ in range(4)]
        v[0][h // 3 : h // 3 + 4, 5:] = 20
        v[0][h // 2 : h // 2 + 14, 8:40] = 250
        rows.append((i, h, w, *[bytearray(x.tobytes()) for x in v]))
    df = spark.createDataFrame(rows, "img long, height int, width int, v binary, r binary, g binary, b binary")
    out = measure(df)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    whole = {r.img: r for r in out.collect()}
    monkeypatch.setattr(G, "SIZE", 40)
    by_tiles = measure(df).collect()
    assert len(whole) == len(by_tiles) == len(rows) and by_tiles[0].__fields__ == whole[0].__fields__
    for r in by_tiles:
        assert tuple(whole[r.img]) == tuple(pytest.approx(x) if x is not None else None for x in r)


@pytest.mark.parametrize("small", [1_000_000, 0])
def test_no_task_holds_a_dense_graph(spark, monkeypatch, small):
    """200 nodes with a link to every lower one: no task walks more than ``BLOCK`` links, whatever place or height they share."""
    monkeypatch.setattr(graph, "BLOCK", 900)
    monkeypatch.setattr(graph, "SMALL", small, raising=False)
    held = spark.sparkContext.accumulator(0)
    part = graph._Part

    class Watched(part):
        def __init__(self, nodes, links):
            held.add(len(links) > 900)
            super().__init__(nodes, links)

    monkeypatch.setattr(graph, "_Part", Watched)
    rng = random.Random(8)
    rows = [(3 * k, rng.random(), rng.random(), float(rng.randrange(120)), rng.random() / 1e30) for k in range(200)]
    rows += [(601, 0.5, 0.5, None, 1.0), (602, 0.5, 0.5, float("inf"), 1.0)]
    nodes = spark.createDataFrame(rows, "id long, x double, y double, h double, v double")
    side = lambda s: nodes.select(*[F.col(c).alias(f"{s}_{c}") for c in nodes.columns])
    edges = side("a").join(side("b"), F.col("a_h") > F.col("b_h"))
    want = {r[0]: r[4] for r in rows}
    known = [r for r in rows if r[3] is not None]
    for i, *_, h, _ in sorted(known, key=lambda r: -r[3]):
        for j, *_, low, _ in known:
            want[j] += want[i] if low < h else 0
    assert {r.id: r.total for r in graph.accumulate_down(nodes, edges, "v", "h").collect()} == pytest.approx(want, rel=1e-9)
    assert held.value == 0


@pytest.mark.parametrize("pruned, words", [(100_000, 1 << 20), (0, 40)])
def test_ngrams_are_counted_where_their_text_is(spark, monkeypatch, pruned, words):
    """The vocabulary and vectors of all n-grams, whether rare words are left out first or not, in pieces of any size; vectors are eight bytes a term."""
    monkeypatch.setattr(C, "PRUNED", pruned, raising=False)
    monkeypatch.setattr(C, "WORDS", words, raising=False)
    rng = random.Random(12)
    texts = [" ".join(f"w{'abcdefghijkl'[int(rng.paretovariate(0.8)) % 12]}" for _ in range(rng.randrange(90))) for _ in range(40)] + ["", "?", "wa wa wa wa", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc long, text string")
    want = {}
    for r in C.tfidf(df, terms=30).collect():
        want.setdefault(r.doc, {})[r.term] = r.w
    names = sorted({t for row in want.values() for t in row})
    found = C.classes(df, terms=30)
    got = {}
    for r in found.members.join(found.classes, "name").collect():
        at, n = np.frombuffer(r.v, "<i4").reshape(2, -1)
        w = n * found.idf[at]
        assert len(r.v) == 8 * len(at)
        got[r.doc] = {names[k]: x for k, x in zip(at, w / np.sqrt((w * w).sum()), strict=True)}
    assert len(names) == 30 == len(found.idf) and any(" " in t for t in names)
    assert got == {k: pytest.approx(row) for k, row in want.items()}


def test_a_dense_graph_of_few_links(spark):
    """40 nodes with a link to every lower one are dense, and fit in one band."""
    rows = [(k, k / 100, 0.0, float(k), 1.0) for k in range(40)]
    nodes = spark.createDataFrame(rows, "id long, x double, y double, h double, v double")
    side = lambda s: nodes.select(*[F.col(c).alias(f"{s}_{c}") for c in nodes.columns])
    edges = side("a").join(side("b"), F.col("a_h") > F.col("b_h"))
    got = {r.id: r.total for r in graph.accumulate_down(nodes, edges, "v", "h").collect()}
    assert got == {k: 2.0 ** (39 - k) for k in range(40)}


def _copied():
    """Texts of two vocabularies, with copies; each text's vector by the plain way, and the docs' pairs above a cosine."""
    rng = random.Random(31)
    texts = [" ".join(f"{'xy'[k % 2]}{'abcdefgh'[int(rng.paretovariate(0.9)) % 8]}" for _ in range(rng.randrange(1, 12))) for k in range(60)]
    return list(enumerate(texts + texts[:10] + texts[:3] * 9))


def _near(spark, df, above):
    rows = {}
    for r in C.tfidf(df, terms=30).collect():
        rows.setdefault(r.doc, {})[r.term] = r.w
    dots = {(i, j): sum(w * rows[j].get(t, 0.0) for t, w in rows[i].items()) for i in rows for j in rows if i < j}
    assert not any(abs(s - above) < 1e-9 for s in dots.values())
    return {k: s for k, s in dots.items() if s > above}


@pytest.mark.parametrize("sparse, tile, copies", [(32768, (256, 1024), 32), (20, (3, 7), 2)])
def test_pairs_are_not_shuffled(spark, monkeypatch, sparse, tile, copies):
    """Near pairs with the docs of their vectors come whole out of the tasks that found them, in blocks of any size."""
    for name, value in (("SPARSE", sparse), ("TILE", tile), ("COPIES", copies)):
        monkeypatch.setattr(C, name, value, raising=False)
    ship(spark)
    df = spark.createDataFrame(_copied(), "doc long, text string")
    out = C.similar(C.classes(df, terms=30), 0.8)
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    got = [(r.i, r.j, r.sim) for r in out.collect()]
    want = _near(spark, df, 0.8)
    assert len(got) == len(want) > 300 and {(i, j): s for i, j, s in got} == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("sparse, tile", [(32768, (256, 1024)), (20, (3, 7))])
def test_templates_in_tiles_of_shared_terms(spark, monkeypatch, sparse, tile):
    """Neighbours are counted in blocks of any size; vectors without a term in common are not multiplied."""
    monkeypatch.setattr(C, "SPARSE", sparse, raising=False)
    monkeypatch.setattr(C, "TILE", tile, raising=False)
    ship(spark)
    df = spark.createDataFrame(_copied(), "doc long, text string")
    n = {}
    for pair in _near(spark, df, 0.6):
        for d in pair:
            n[d] = n.get(d, 0) + 1
    assert {r.doc: r.neighbours for r in C.templates(C.classes(df, terms=30), 0.6, 5).collect()} == {k: v for k, v in n.items() if v >= 5}
    unit = lambda *at: np.array([*at, *[1] * len(at)], "<i4").tobytes()
    side = C._Side([unit(0, 1), unit(5, 6), unit(0, 1, 2), unit(5)], np.ones(8), 2)
    assert [t.tolist() for _, t, _, _ in side.stripes] == [[0, 1, 2], [5, 6]]
    found = [(side.order[r], side.order[k], s) for a in C._above(side, side, True, 0.6, True) for r, k, s in zip(*a, strict=True)]
    assert {(min(r, k), max(r, k)): s for r, k, s in found} == {(0, 2): pytest.approx((2 / 3) ** 0.5), (1, 3): pytest.approx(0.5**0.5)} and len(found) == 2
