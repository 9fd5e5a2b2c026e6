"""Files, configurations and streams: round trips, resumed runs and restatements."""

import datetime
import json
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import similarity as M
from quern.operators import vectors as V
from quern.plans.ship import ship
from quern.sources import tables as Q
from quern.streaming import patience, rollup


def test_empty_results_raise(spark):
    df = spark.range(3)
    assert Q.nonempty(df, "ids").count() == 3
    with pytest.raises(RuntimeError, match="ids is empty"):
        Q.nonempty(df.where("id > 5"), "ids")


def test_yaml_without_its_library():
    text = "a: 1\n# note\nb:\n  c: true\n  d: 'x: y'\n  e: [1, two, 0.5]\nf:\n- p\n- 2\ng:\nh: 1.5  # tail\n"
    want = {"a": 1, "b": {"c": True, "d": "x: y", "e": [1, "two", 0.5]}, "f": ["p", 2], "g": None, "h": 1.5}
    lines = [(len(x) - len(x.lstrip()), x.strip()) for x in text.splitlines() if x.strip() and not x.lstrip().startswith("#")]
    assert Q._parsed(lines) == want == Q.parse_yaml(text)


def test_json_maps(spark, tmp_path):
    """One object or many, indented or not."""
    (tmp_path / "one.json").write_text(json.dumps({"a": "x\n}\n{y", "b": " "}, indent=2))
    assert {r.id: r.pred for r in Q.read_json_map(spark, str(tmp_path / "one.json")).collect()} == {"a": "x\n}\n{y", "b": " "}
    rows = [(i, f" t{i}\n}}\n{{ ") for i in range(50)]
    for entries in (1000, 7):
        Q.write_json_map(spark.createDataFrame(rows, "id long, t string"), str(tmp_path / f"m{entries}"), "id", "t", entries=entries)
        assert {r.id: r.pred for r in Q.read_json_map(spark, str(tmp_path / f"m{entries}")).collect()} == {str(i): t.strip() for i, t in rows}


def test_files_by_name(spark):
    """The file of that name, else the first that begins with it, whatever heads names share and however many ranges hold no file."""
    df = spark.createDataFrame([(1, "ab"), (2, "abcdef"), (3, "zz"), (4, "abc"), (5, None), (6, "abc")], "k int, name string")
    files = spark.createDataFrame([("abcdef",), ("abc_2",), ("abc",), ("y",), (None,), ("y",)], "file string")
    assert {r.k: r.file for r in Q.resolve_files(df, files, "k").collect()} == {1: "abc", 2: "abcdef", 3: None, 4: "abc", 5: None, 6: "abc"}
    rng = random.Random(3)
    names = [f"shared_head_of_18__{rng.randrange(400):03d}" for _ in range(300)]
    held = sorted({f"{rng.choice(names)[: rng.randrange(19, 22)]}{rng.choice(['', '_a', 'x'])}" for _ in range(60)} | {"shared_head_of_18__9999"})
    df = spark.createDataFrame(list(enumerate(names)) + [(900, "shared_head"), (901, "t")], "k int, name string")
    for some in (held, held[-1:], []):
        files = spark.createDataFrame([(f,) for f in some], "file string")
        want = {k: next((f for f in some if f.startswith(n)), None) for k, n in [*enumerate(names), (900, "shared_head"), (901, "t")]}
        assert {r.k: r.file for r in Q.resolve_files(df, files, "k").collect()} == want


def test_configurations_of_runs(spark, tmp_path):
    """A run's own file, else its newest summary."""
    import os

    for name, text, at in (
        ("a.yaml", "x: 1\ny:\n  z: [1, b]\n", 1),
        ("a/summary_9.json", '{"x": 5}', 9),
        ("b/summary_1.json", '{"config": {"x": "old"}}', 1),
        ("b/summary_2.json", '{"config": {"x": "new", "w": {"v": null}}, "results": []}', 2),
        ("c.json", '{"q": true}', 1),
    ):
        file = tmp_path / name
        file.parent.mkdir(exist_ok=True)
        file.write_text(text)
        os.utime(file, (at * 1000, at * 1000))
    got = {(r.run, r.name): r.value for r in Q.configurations(spark, str(tmp_path)).collect()}
    assert got == {("a", "x"): "1", ("a", "y.z"): '[1, "b"]', ("b", "x"): '"new"', ("b", "w.v"): "null", ("c", "q"): "true"}


def test_vectors_of_several_lengths(spark):
    """Ragged vectors are left out, or have no centroid."""
    ship(spark)
    rows = [(i, [float(i % 2), 1.0, 0.0]) for i in range(20)] + [(90, [1.0]), (91, None), (92, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]), (93, [])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    assert sorted(r.id for r in V.kmeans(df, "id", "v", 2, starts=2).collect()) == list(range(20))
    centres = spark.createDataFrame([(7, [0.0, 1.0, 0.0]), (8, [1.0, 1.0, 0.0]), (9, [1.0])], "label_c int, centroid array<double>")
    got = {r.id: r.label for r in V.nearest(df, "id", "v", centres).collect()}
    assert len(got) == 24 and all(got[i] == 7 + i % 2 for i in range(20)) and got[90] is got[91] is got[92] is got[93] is None


def test_streams_go_on(spark, tmp_path):
    """A second run reads only what came since the first, and adds to its state."""
    ship(spark)
    at = lambda d, h: datetime.datetime(2024, 1, d, h)
    folder = tmp_path / "events.parquet"
    one = spark.createDataFrame(
        [("a", at(1, 1), 1.0), ("a", at(1, 5), 3.0), ("b", at(1, 2), 5.0)],
        "event_type string, ts timestamp, value double",
    ).coalesce(1)
    two = spark.createDataFrame([("a", at(1, 23), 8.0), ("b", at(2, 2), 6.0)], "event_type string, ts timestamp, value double").coalesce(1)
    one.write.parquet(str(folder))
    to = f"file://{tmp_path}/state"
    get = lambda: {
        (r.event_type, r.day.day): (r.mean, r.min, r.max, r.n) for r in rollup.streamed(
            spark,
            str(tmp_path),
            "events",
            late="2 days",
            to=to,
        ).collect()
    }
    assert get() == {("a", 1): (2.0, 1.0, 3.0, 2), ("b", 1): (5.0, 5.0, 5.0, 1)}
    two.write.mode("append").parquet(str(folder))
    assert get() == {("a", 1): (4.0, 1.0, 8.0, 3), ("b", 1): (5.0, 5.0, 5.0, 1), ("b", 2): (6.0, 6.0, 6.0, 1)}



def test_months_are_given_up(spark, tmp_path):
    """A stream by month holds no more months than can still change, and its rows are right after late ones."""
    at = lambda m, d: datetime.datetime(2024, m, d, 12)
    for m in range(1, 11):
        rows = [("a", at(m, 3), 1.0), ("a", at(m, 20), 3.0), *([("a", at(m - 1, 28), 10.0)] if m > 1 else [])]
        spark.createDataFrame(rows, "event_type string, ts timestamp, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
        time.sleep(0.02)
    to = f"file://{tmp_path}/state"
    run = rollup.follow(spark, str(tmp_path), "events", "month", "1 hour", to, files=1)
    held = [p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress if p["stateOperators"]]
    assert len(held) >= 10 and max(held) <= 3
    got = {r.month.month: (r.mean, r.n) for r in rollup.streamed(spark, str(tmp_path), "events", "month", to=to).collect()}
    assert got == {m: (14 / 3, 3) if m < 10 else (2.0, 2) for m in range(1, 11)}


STEPS = "station int, ts timestamp, step long, val double"


def steps_of(rows):
    return [(s, datetime.datetime(2024, 1, 1) + datetime.timedelta(days=d), d, float(v)) for s, d, v in rows]


def stop_of(values, patience, delta):
    """best, stop by walking the steps in order."""
    best, bad = float("inf"), 0
    for d, v in sorted(values):
        if v < best - delta:
            best, bad = v, 0
        else:
            bad += 1
            if bad >= patience:
                return best, d
    return best, None


def test_steps_in_any_order(spark, tmp_path):
    """Files of steps in any order, one a batch and over two runs: as if they had come in order."""
    ship(spark)
    rng = random.Random(5)
    rows = [(s, d, rng.choice([5, 4, 3, 2, 1]) + s / 10 - d / 20) for s in range(4) for d in range(40)]
    rng.shuffle(rows)
    read = lambda: spark.readStream.schema(STEPS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "steps"))
    to = f"file://{tmp_path}/patience"
    for lo, hi in ((0, 90), (90, 160)):
        for k in range(lo, hi, 35):
            spark.createDataFrame(steps_of(rows[k : min(k + 35, hi)]), STEPS).coalesce(1).write.mode("append").parquet(str(tmp_path / "steps"))
        got = {r.station: (r.best, r.stop) for r in patience.stopped(read(), 3, 0.5, "60 days", to=to).collect()}
        assert got == {s: stop_of([(d, v) for t, d, v in rows[:hi] if t == s], 3, 0.5) for s in range(4)}


def test_state_of_steps_is_bounded(spark, tmp_path):
    """Steps behind the watermark are released; one that comes later still is left out."""
    ship(spark)
    files = [[(1, d, 100 - d) for d in range(k, k + 5)] for k in range(0, 60, 5)] + [[(1, 2, -500)], [(1, 60, 41), (1, 59, 0)]]
    for rows in files:
        spark.createDataFrame(steps_of(rows), STEPS).coalesce(1).write.mode("append").parquet(str(tmp_path / "steps"))
        time.sleep(0.02)
    rows = spark.readStream.schema(STEPS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "steps"))
    run = patience.follow(rows, 50, 0.5, "6 days", f"file://{tmp_path}/patience")
    custom = [p["stateOperators"][0] for p in run.recentProgress if p["stateOperators"]]
    assert max(p["numRowsTotal"] for p in custom) < 40 and sum(p["numRowsDroppedByWatermark"] for p in custom) == 1
    got = spark.read.parquet(f"{tmp_path}/patience/rows").orderBy(F.desc("batch")).first()
    assert (got.best, got.stop) == (0.0, None)


def sparse_pairs(unit):
    """All cosines above 0 of tfidf's rows, by brute force."""
    rows = {}
    for r in unit.collect():
        rows.setdefault(r.doc, {})[r.term] = r.w
    docs = sorted(rows)
    sims = {(i, j): sum(w * rows[j].get(t, 0) for t, w in rows[i].items()) for k, i in enumerate(docs) for j in docs[k + 1 :]}
    return {k: v for k, v in sims.items() if v > 0}


@pytest.mark.parametrize("block, steps, few", [(4096, 1 << 16, 10**6), (16, 8, 5)])
def test_blocks_of_cosines(spark, monkeypatch, block, steps, few):
    """Pairs, neighbours, quantiles and ranges over all pairs of texts, copies and texts without terms among them, in one block and in many."""
    for name, value in (("BLOCK", block), ("STRIPE", 5), ("STEPS", steps), ("FEW", few)):
        monkeypatch.setattr(M, name, value)
    rng = random.Random(8)
    texts = ["", "? !", None]
    for i in range(60):
        words = [f"w{int(rng.paretovariate(0.7)) % 90}" for _ in range(30)] if i % 3 or len(texts) < 4 else texts[-1].split()
        words[rng.randrange(len(words))] = f"e{i}"
        texts.append(" ".join(words))
    texts += [texts[10]] * 7
    df = spark.createDataFrame(list(enumerate(texts)), "doc int, text string").where("text is not null or doc >= 0").fillna("")
    every, n = sparse_pairs(M.tfidf(df)), len(texts)
    found = M.classes(df)
    for above in (0.2, 0.6, 0.9):
        got = {(r.i, r.j): r.sim for r in M.similar(found, above).collect()}
        assert got == pytest.approx({k: v for k, v in every.items() if v > above}) and (above > 0.8 or got)
        near = {}
        for (i, j), v in every.items():
            if v > above:
                near[i], near[j] = near.get(i, 0) + 1, near.get(j, 0) + 1
        assert {r.doc: r.neighbours for r in M.templates(found, above, 2).collect()} == {k: v for k, v in near.items() if v >= 2}
    all_ = list(every.values()) + [0.0] * (n * (n - 1) // 2 - len(every))
    qs = [0.0, 0.01, 0.1, 0.5, 0.75, 0.9, 0.99, 1.0]
    assert {r.q: r.sim for r in M.percentiles(found, n, qs).collect()} == pytest.approx(dict(zip(qs, np.quantile(all_, qs).tolist(), strict=True)))
    want = {}
    for v in all_:
        if v < 1 - 1e-12:
            k = f"{min(int(v * 5), 4) / 5:.1f}-{min(int(v * 5), 4) / 5 + 0.2:.1f}"
            want[k] = want.get(k, 0) + 1
    assert {r.bucket: r.n for r in M.ranges(found, n).collect()} == want
    none = M.classes(df.limit(0))
    assert M.similar(none, 0.5).isEmpty() and M.percentiles(none, 0, qs).isEmpty() and M.ranges(none, 0).isEmpty()


def test_kmeans(spark):
    """Every vector is with its nearest centre, and the cost is near that of the planted clusters."""
    ship(spark)
    rng = np.random.default_rng(3)
    planted = rng.normal(size=(6, 8))
    x = planted[np.arange(300) % 6] + rng.normal(scale=0.08, size=(300, 8))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(999, None)], "id long, v array<double>")
    got = {r.id: r.cluster_id for r in V.kmeans(df, "id", "v", 6, starts=4).collect()}
    assert sorted(got) == list(range(300)) and len({(i % 6, got[i]) for i in got}) == 6
    assert V.kmeans(df.limit(0), "id", "v", 3, starts=2).collect() == []


def test_chained_cleaner(spark, tmp_path):
    from quern import catalog

    from .test_functions import restated

    texts = ["fine text as it is", "go on " * 9, "Assistant: kept  part " + "- " * 9, "é " * 4, None]
    spark.createDataFrame(
        [(1, k, "user", t) for k, t in enumerate(texts)],
        "conv_id long, turn long, role string, text string",
    ).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.turn: r.cleaned for r in catalog.QUERIES["clean_chained"](spark, str(tmp_path)).collect()}
    for k, t in enumerate(texts):
        said = f"<|assistant|> user said: {t or ''}"
        for a in T.ARTIFACTS:
            said = said.split(a)[-1]
        assert got[k] == " ".join(restated(said).split())


def test_measures_of_a_small_image(spark):
    from quern.operators import images as I

    values = np.array([[0, 0, 200], [10, 250, 200], [10, 10, 200], [0, 30, 90]])
    df = spark.createDataFrame([(1, y, x, int(v)) for (y, x), v in np.ndenumerate(values)], "img int, y int, x int, v int")
    wide = np.pad(values, 1, mode="reflect")
    edge = wide[:-2, 1:-1] + wide[2:, 1:-1] + wide[1:-1, :-2] + wide[1:-1, 2:] - 4 * values
    assert I.blur(df).first().edges == pytest.approx(edge.var())
    _, n = np.unique(values, return_counts=True)
    assert I.contrast(df).first().entropy == pytest.approx(-(n / 12 * np.log2(n / 12)).sum())
    assert I.ink_fade(df.where("x = 0 and y = 0")).first().fade == 100.0
    assert df.where(F.col("v") > 255).isEmpty()


def test_images(spark, tmp_path):
    """Every filter and colour type, and files that are none."""
    import struct
    import zlib

    from quern.sources import images as J

    rng = np.random.default_rng(5)

    def png(rows, colour, channels, extra=b""):
        height, width = rows.shape[0], rows.shape[1] // channels
        out, above = [], np.zeros(rows.shape[1] + channels, np.int64)
        for y, row in enumerate(rows.astype(np.int64)):
            kind, now = y % 5, np.concatenate([np.zeros(channels, np.int64), row])
            a, b, c = now[:-channels], above[channels:], above[:-channels]
            p = a + b - c
            near = np.where((abs(p - a) <= abs(p - b)) & (abs(p - a) <= abs(p - c)), a, np.where(abs(p - b) <= abs(p - c), b, c))
            out.append(bytes([kind]) + ((row - [0 * a, a, b, (a + b) // 2, near][kind]) & 255).astype(np.uint8).tobytes())
            above = now
        chunk = lambda k, x: struct.pack(">I", len(x)) + k + x + struct.pack(">I", zlib.crc32(k + x))
        return J.SIGNATURE + chunk(
            b"IHDR",
            struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0),
        ) + extra + chunk(b"IDAT", zlib.compress(b"".join(out))) + chunk(b"IEND", b"")

    for colour, channels in J.CHANNELS.items():
        if colour == 3:
            continue
        raw = rng.integers(0, 256, (11, 7, channels))
        want = raw[..., 0] if channels < 3 else np.rint(raw[..., :3] @ [0.299, 0.587, 0.114])
        file = png(raw.reshape(11, -1), colour, channels)
        assert (J.decode(file) == want).all() and (J.colours(J.channels(file)) == (raw[..., :3] if channels > 2 else raw[..., :1])).all(), colour
    grey = rng.integers(0, 256, (5, 6)).astype(np.uint8)
    assert (J.decode(J.encode(grey)) == grey).all()
    mixed = rng.integers(0, 256, (5, 6, 3)).astype(np.uint8)
    assert (J.channels(J.encode(mixed)) == mixed).all()
    assert (J.decode(b"P5\n# made\n6 5\n255\n" + grey.tobytes()) == grey).all()
    ship(spark)
    (tmp_path / "a.png").write_bytes(J.encode(grey))
    (tmp_path / "b.png").write_bytes(b"no image")
    (tmp_path / "c.pgm").write_bytes(b"P5 6 5 255\n" + grey.tobytes())
    got = {r.path[-5:]: r for r in J.read_images(spark, str(tmp_path)).collect()}
    assert got["a.png"].grey == got["c.pgm"].grey == grey.tobytes() and got["b.png"].error and got["b.png"].grey is None
    back = J.pixels(J.read_images(spark, str(tmp_path), "a.png"), "path").collect()
    assert {(r.y, r.x): r.v for r in back} == {(y, x): int(v) for (y, x), v in np.ndenumerate(grey)}
