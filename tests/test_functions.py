"""Literals with known results, and sequential algorithms against plain restatements."""

import random

import pytest
from pyspark.sql import functions as F

from quern.functions import arrays as R
from quern.functions import edit as D
from quern.functions import ensemble as E
from quern.functions import text as T
from quern.operators import dedup as U
from quern.operators import graph as G
from quern.operators import series as Z
from quern.operators import splits as X
from quern.operators import stats as S
from quern.operators.quantiles import quantiles
from quern.plans.ship import ship


def column(spark, values, build, kind="string"):
    ship(spark)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", build(F.col("v")).alias("x")).orderBy("i").collect()]


def test_ensembles(spark):
    given = [["a-b", "a-b", "acb"], ["", ""], ["", "a-b"], ["a-b"], ["ab", "cd"], ["abc", "ab", "ab "]]
    want = {
        "majority": ["a-b", "", "", "a-b", "ab", "abc"],
        "longest": ["a-b", "", "a-b", "a-b", "ab", "abc"],
        "shortest": ["a-b", "", "", "a-b", "ab", "ab"],
        "char_voting": ["a-b", "", "", "a-b", "ab", "ab"],
        "rover": ["acb", "", "ab", "a-b", "ab", "abc"],
        "mbr": ["a-b", "", "a-b", "a-b", "ab", "abc"],
    }
    for name, expected in want.items():
        assert column(spark, given, lambda p, n=name: E.ensemble(p, n), "array<string>") == expected, name
    with pytest.raises(ValueError):
        E.ensemble(F.col("v"), "unknown")


def test_repetitions():
    assert D.cut_repetitions("say " + "the " * 6 + "end here") == "say"
    assert D.cut_repetitions("say " + "- " * 7 + "end here now") == "say " + "- " * 7 + "end here now"
    assert D.cut_repetitions("say " + "- " * 8 + "end here now") == "say"
    assert D.cut_repetitions("x " + "of the " * 6 + "end") == "x"
    assert D.cut_repetitions("a a a a a") == "a a a a a"
    assert D.cut_repetitions(None) is None


def restated(text, most=5):
    tokens = text.split()
    if len(text) < 10 or len(tokens) < most:
        return text
    for size in (1, 2, 3):
        for i in range(len(tokens) - size * most):
            n, at = 1, i + size
            while tokens[at : at + size] == tokens[i : i + size] and at + size <= len(tokens):
                n, at = n + 1, at + size
            if n > (7 if size == 1 and tokens[i] in ("-", "~", "–", "—", "*", ".") else most):
                return " ".join(tokens[:i])
    return text


def test_repetitions_at_random():
    rng = random.Random(5)
    for _ in range(3000):
        text = " ".join(rng.choice(["a", "b", "-"]) for _ in range(rng.randrange(24)))
        assert all(D.cut_repetitions(text, most) == restated(text, most) for most in (3, 5)), text


def test_word_distance(spark):
    assert D.distance("a b".split(), "a c b".split()) == 1
    assert D.distance([], "a c b".split()) == 3
    df = spark.createDataFrame([("a b", "a c b"), ("x", None), (None, ""), ("naïve é", "nave é")], "a string, b string")
    assert [tuple(r) for r in df.select(D.word_distance("a", "b"), D.char_distance("a", "b")).collect()] == [(1, 2), (1, 1), (0, 0), (1, 1)]
    rng = random.Random(6)
    for _ in range(800):
        a, b = (["".join(rng.choice("ab日é") for _ in range(rng.randrange(70)))] for _ in "ab")
        assert D.distance(a[0], b[0]) == table(a[0], b[0]), (a, b)


def table(a, b):
    """Edit distance by its whole table."""
    d = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        d.append([i])
        for j, y in enumerate(b, 1):
            d[i].append(min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (x != y)))
    return d[-1][-1]


def test_quantiles(spark):
    import numpy as np

    rng = random.Random(7)
    values = [rng.choice([rng.random() * 100, float(rng.randrange(5)), None]) for _ in range(700)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    qs = [0.0, 0.05, 0.25, 1 / 3, 0.5, 0.9, 1.0]
    want = np.quantile([v for v in values if v is not None], qs)
    for few in (10**6, 0):
        assert quantiles(df, "v", qs, few=few).first()[0] == pytest.approx(want.tolist())
    assert quantiles(df.where("v is null"), "v", [0.5]).first()[0] is None
    grouped = spark.createDataFrame([(i % 3 or None, v) for i, v in enumerate(values)], "g int, v double")
    for few in (10**6, 0):
        got = {r.g: r.q for r in quantiles(grouped, "v", qs, few=few, by=["g"]).collect()}
        for g in (None, 1, 2):
            assert got[g] == pytest.approx(np.quantile([v for i, v in enumerate(values) if v is not None and (i % 3 or None) == g], qs).tolist())


def test_whole_texts(spark):
    """Letters of every alphabet count: no text is read for what is left of it in ASCII."""
    texts = ["naïve", "nave", "ééé", "日本語", "日本語 ", "Élan Vital 12 ١٢", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    assert sorted(r.doc_id for r in U.keep_first(U.keyed(df), "doc_id").collect()) == [0, 1, 2, 3, 5, 6]
    got = {r.doc_id: r for r in U.scored(df).collect()}
    assert [got[i].text_length for i in range(7)] == [len(t or "") for t in texts] and got[5].word_count == 4
    assert got[5].number_complexity == pytest.approx(min(100, 2 / 4 * 300 + 2 * 5)) and got[5].named_entity_score == pytest.approx(min(100, 1 / 4 * 500))


def test_text_scores(spark):
    text = ["London the 26: March 1669. ffor 100 Sterl:", "   ", "", None]
    x = [
        r[0] for r in spark.createDataFrame([(t,) for t in text], "t string").select(
            T.historical_spelling(T.whole("t"), T.words(T.whole("t")))
        ).collect()
    ]
    assert x == [pytest.approx(62.5), 0.0, 0.0, 0.0]
    assert column(spark, ["b\r\n\r\n c "], T.clean_lines) == ["b c"]
    assert column(spark, ["say assistant x Assistant: y"], T.after_artifacts) == [" y"]


def test_qcut(spark):
    import pandas as pd

    values = [float(v) for v in range(1, 11)] + [None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r.b for r in S.qcut(df, "v", 4, "b").orderBy("i").collect()]
    assert [None if pd.isna(x) else x for x in pd.qcut(pd.Series(values), 4, labels=False)] == got
    flat = spark.createDataFrame([(1.0,), (1.0,)], "v double")
    assert [r.b for r in S.qcut(flat, "v", 3, "b", ["easy", "medium", "hard"]).collect()] == ["medium", "medium"]
    named = S.qcut(df, "v", 3, "b", ["easy", "medium", "hard"]).orderBy("i").collect()
    assert [r.b for r in named] == ["easy"] * 4 + ["medium"] * 3 + ["hard"] * 3 + [None]  # a missing value has no bin
    assert [r.b for r in S.qcut(spark.createDataFrame([(1.0,), (1.0,), (None,)], "v double"), "v", 3, "b", ["a", "b", "c"]).orderBy("v").collect()] == [None, "b", "b"]
    doubled = spark.createDataFrame([(float(v),) for v in (0, 0, 0, 0, 1, 2)], "v double")
    assert sorted(r.b for r in S.qcut(doubled, "v", 3, "b").collect()) == sorted(
        pd.qcut(pd.Series([0, 0, 0, 0, 1, 2]), 3, labels=False, duplicates="drop").tolist()
    )


def test_windows(spark):
    for days, inclusive, n in ((37, True, 1), (37, False, 0), (36, True, 0), (38, False, 1)):
        df = spark.range(days).select(F.lit(1).alias("s"), F.col("id").alias("d"), F.col("id").cast("double").alias("q"))
        assert Z.sliding(df, "s", "d", ["q"], "q", inclusive=inclusive).count() == n


def test_diamond(spark):
    nodes = spark.createDataFrame([(k, 1.0) for k in range(4)], "id long, v double")
    edges = spark.createDataFrame([(0, 1), (0, 2), (1, 3), (2, 3)], "a_id long, b_id long")
    got = {r.id: r.total for r in G.accumulate(nodes, edges, "v").collect()}
    assert got == {0: 1.0, 1: 2.0, 2: 2.0, 3: 5.0}  # the two paths from 0 count twice
    parts = G.components(spark.createDataFrame([(5, 6), (6, 7), (1, 2)], "a long, b long"))
    assert {r.id: r.component for r in parts.collect()} == {5: 5, 6: 5, 7: 5, 1: 1, 2: 1}


def test_components_end_with_stars(spark):
    """Stars take no round, and other graphs none after they have become stars."""
    made = []

    def put(df):
        made.append(df.localCheckpoint())
        return made[-1]

    def parts(edges):
        made.clear()
        return {r.id: r.component for r in G.components(spark.createDataFrame(edges, "a long, b long"), put).collect()}

    assert parts([(k, 0) for k in range(1, 30)] + [(50, 40), (50, 40), (7, 7)]) == {k: 0 for k in range(30)} | {40: 40, 50: 40} and len(made) == 1
    assert parts([]) == {} and len(made) == 1
    assert parts([(0, 2), (1, 2)]) == {0: 0, 1: 0, 2: 0} and len(made) == 2
    assert parts([(k, k + 1) for k in range(40)]) == {k: 0 for k in range(41)}


def test_group_folds(spark):
    df = spark.createDataFrame([(i, f"g{i % 17}" if i % 17 else None, str(i % 3) if i % 5 else None) for i in range(300)], "i int, g string, y string")
    out = X.group_kfold(df, "g", "y", 5)
    assert out.count() == 300 and out.columns == ["i", "g", "y", "fold"]
    assert out.groupBy("g").agg(F.countDistinct("fold").alias("n")).where("n > 1").isEmpty()
    sizes = [r["count"] for r in out.groupBy("fold").count().collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 36
    assert X.group_kfold(df.limit(0), "g", "y", 5).isEmpty()


def test_no_row_without_a_stratum_is_lost(spark):
    """Null strata and groups are kept, also beside columns that are named like helpers."""
    rows = [(i, [None, "a", "b"][i % 3], [None, "x", "y", "z"][i % 4], i, i, i) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, s string, g string, rows int, place int, part int")
    held = X.holdout(df, "i", ["s"], 0.2)
    assert held.count() == 60 and {r.s: r.n for r in held.where("in_val").groupBy("s").agg(F.count("*").alias("n")).collect()} == {None: 4, "a": 4, "b": 4}
    folds = X.kfold(df, "i", ["s"], 5)
    assert folds.count() == 60 and {r["count"] for r in folds.groupBy("s", "fold").count().collect()} == {4}
    assert X.holdout(df, "i", [], 0.1).where("in_val").count() == 6
    sides = X.group_holdout(df, "i", "g", 0.25)
    assert sides.count() == 60 and sides.select("g", "in_val").distinct().count() == 4 and sides.where("in_val").count() == 15
    assert X.fallback(df, "i", ["s"], 0.2).count() == 60
    assert held.columns[:6] == df.columns == sides.columns[:0] + df.columns


def test_arrays(spark):
    a = spark.createDataFrame([([3, 1, 2, 5, 1, 2, 7, 0],), ([9],)], "a array<bigint>")
    part = F.array(F.lit(1), F.lit(2)).cast("array<bigint>")
    got = a.select(R.rfind(F.col("a"), part).alias("r"), R.find(F.col("a"), part).alias("f"), R.masked(F.col("a"), part, 0).alias("m")).collect()
    assert [(r.r, r.f, r.m) for r in got] == [(4, 1, [-100] * 6 + [7, -100]), (-1, -1, [9])]
    assert column(spark, ['{"rec_text": "x"}', '[[[0],["y", 0.9]]]', "[]"], R.ocr_text) == ["x", "y", ""]


def test_sources(spark, tmp_path):
    from quern.sources import tables as Q

    (tmp_path / "t.csv").write_text("ID,Target\na,The land\nb,NA\nc,\n")
    df = Q.read_csv(spark, str(tmp_path / "t.csv"), "ID string, Target string")
    assert [tuple(r) for r in df.orderBy("ID").collect()] == [("a", "The land"), ("b", None), ("c", None)]
    Q.write_csv(df, str(tmp_path / "out"), single=True)
    assert Q.read_csv(spark, str(tmp_path / "out"), "ID string, Target string").count() == 3
    fold = spark.createDataFrame([("a", " x "), ("b", None)], "id string, pred string")
    path = str(tmp_path / "fold.json")
    for _ in range(2):  # computed, then read from the cache
        got = Q.cached(spark, path, str(tmp_path / "none.csv"), lambda: fold)
        assert {r.id: r.pred for r in got.collect()} == {"a": "x", "b": ""}
    assert Q.resolve(df.withColumnRenamed("ID", "trapp_id")).columns == ["id", "target"]
