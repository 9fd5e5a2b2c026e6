"""Queries that do the whole job, against brute force on tables where a cut would show."""

import random

import duckdb
import pytest

from quern import catalog
from quern.operators import graph as G


def distance(a, b):
    """Edit distance of two sequences by the whole table."""
    d = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
    return d[-1][-1]


def spoken():
    """Turns of a few to 400 distinct words; conversation 2 has long ones only."""
    rng = random.Random(21)
    say = lambda n: " ".join(f"{rng.choice(['the', 'a', 'x', 'oar'])}{rng.randrange(900)}" for _ in range(n))
    return [
        (1, 0, "user", "the oath of a fee"),
        (1, 1, "user", say(250)),
        (2, 0, "user", say(400)),
        (2, 1, "user", say(130)),
        (3, 0, "user", None),
        (3, 1, "user", say(20)),
    ]


def test_every_turn_is_scored(spark, tmp_path):
    rows = spoken()
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    want, rates = {}, {}
    for conv, turn, _, text in rows:
        ref = text or ""
        pred = ref.translate(str.maketrans("ae", "xe", "o")).replace("th", "t")
        words = distance(ref.split(), pred.split()), len(ref.split())
        want[conv, turn] = words
        rates[conv] = [x + y for x, y in zip(rates.get(conv, [0] * 4), (*words, distance(ref, pred), len(ref)), strict=True)]
    got = catalog.QUERIES["word_errors"](spark, str(tmp_path)).collect()
    assert {(r.conv_id, r.turn): (r.edits, r.length) for r in got} == want and len(got) == len(rows)
    score = {r.conv_id: (r.wer, r.cer) for r in catalog.QUERIES["competition_score"](spark, str(tmp_path)).collect()}
    assert score == {k: (pytest.approx(e / max(n, 1), abs=1e-6), pytest.approx(c / max(m, 1), abs=1e-6)) for k, (e, n, c, m) in rates.items()}
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    assert {(c, t): (e, n) for c, t, e, n in con.execute(catalog.ORACLES["word_errors"]).fetchall()} == want


@pytest.mark.parametrize("part, block, shrinks, leaf", [(16384, 2_000_000, 0.7, 4096), (20, 2_000_000, 0.7, 16), (20, 30, 100, 4096), (20, 30, 0.0, 4096)])
def test_the_whole_river(spark, tmp_path, monkeypatch, part, block, shrinks, leaf):
    """Flow and components along every river edge, whatever the ids, in one part, in parts contracted once or again, and by levels."""
    for name, value in (("PART", part), ("BLOCK", block), ("SHRINKS", shrinks), ("PER_LEAF", leaf)):
        monkeypatch.setattr(G, name, value)
    rng = random.Random(23)
    at = {
        7 * i: [rng.uniform(-0.1, 0.1), rng.uniform(-0.1, 0.1), rng.uniform(-0.3, 0.3), *(rng.uniform(0, 0.2) for _ in range(3))] for i in range(300)
    }
    spark.createDataFrame(list(at.items()), "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    far = lambda a, b: ((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2) ** 0.5 * 200
    edges = {i: [j for j, b in at.items() if b[2] < a[2] and far(a, b) < 5 and 1e-4 < (a[2] - b[2]) / far(a, b) < 0.1] for i, a in at.items()}
    total, least = {i: 10 + a[4] * 1000 for i, a in at.items()}, {i: i for i in at}
    for i in sorted(at, key=lambda i: -at[i][2]):
        for j in edges[i]:
            total[j] += total[i]
    for _ in at:
        for i, to in edges.items():
            for j in to:
                least[i] = least[j] = min(least[i], least[j])
    got = {r.id: r.total for r in catalog.QUERIES["accumulate"](spark, str(tmp_path)).collect()}
    assert got == pytest.approx(total, abs=1e-3) and sum(map(len, edges.values())) > 300
    joined = {i for i, to in edges.items() if to} | {j for to in edges.values() for j in to}
    assert {r.id: r.component for r in catalog.QUERIES["components"](spark, str(tmp_path)).collect()} == {i: least[i] for i in joined}


def test_no_level_is_left_out(spark):
    nodes = spark.createDataFrame([(k, 1.0) for k in range(5)], "id long, v double")
    edges = spark.createDataFrame([(k, k + 1) for k in range(4)], "a_id long, b_id long")
    assert {r.id: r.total for r in G.accumulate(nodes, edges, "v", most=4).collect()} == {k: k + 1.0 for k in range(5)}
    with pytest.raises(RuntimeError):
        G.accumulate(nodes, edges, "v", most=2)


@pytest.mark.parametrize("block", [2_000_000, 20])
def test_a_long_chain(spark, monkeypatch, block):
    """5,000 levels through all parts of the plane, to and fro along its lines."""
    monkeypatch.setattr(G, "PART", 200)
    monkeypatch.setattr(G, "BLOCK", block)
    n = 5000
    rows = [(10 * k, float(k % 50 if k // 50 % 2 else 49 - k % 50), float(k // 50), float(-k), 1.0) for k in range(n)]
    nodes = spark.createDataFrame(rows, "id long, x double, y double, h double, v double")
    pairs = [(k, k + 1) for k in range(n - 1)] + [(k, k + 7) for k in range(0, 700, 100)] + [(3, 4)]
    at = lambda side, r: {f"{side}_id": r[0], f"{side}_x": r[1], f"{side}_y": r[2], f"{side}_h": r[3]}
    edges = spark.createDataFrame([at("a", rows[a]) | at("b", rows[b]) for a, b in pairs])
    want = [1.0] * n
    for a, b in sorted(pairs):
        want[b] += want[a]
    out = G.accumulate_down(nodes, edges, "v", "h")
    got = {r.id: r.total for r in out.collect()}
    assert got == pytest.approx({10 * k: v for k, v in enumerate(want)}, rel=1e-9)


def test_a_crowded_place(spark, monkeypatch):
    """Nine nodes of ten in one cell of the grid, some in one spot: pairs are all there, and come from many leaves."""
    monkeypatch.setattr(G, "PER_LEAF", 16)
    rng = random.Random(6)
    rows = [(k, rng.random(), rng.random()) for k in range(180)] + [(k, 9 * rng.random(), 9 * rng.random()) for k in range(180, 250)]
    rows += [(k, 0.5, 0.5) for k in range(250, 400)]
    nodes = spark.createDataFrame(rows, "id long, x double, y double")
    far = lambda a, b: ((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2) ** 0.5
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] != b[0] and far(a, b) < 1.5}
    got = [(r.a_id, r.b_id) for r in G.within(nodes, 1.5).select("a_id", "b_id").collect()]
    assert len(got) == len(want) and set(got) == want
    known = G.S.tree(nodes, 16)
    held = nodes.groupBy(G.S.leaf(nodes, known).alias("leaf")).count().collect()
    assert len(held) > 8 and sum(r["count"] for r in held) == 400
