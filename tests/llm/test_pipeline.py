"""The five stages together against a brute-force version, and each stage on its predecessor's output."""

import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from quern.llm import oracles

from .test_operators import DOC, duck, invented, near_brute

INSULTS = ["idiot", "zurblic", "zurblon"]


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def test_pipeline(spark, tmp_path):
    path = pytest.importorskip("public_tokenizers").path(corpus_pipeline.TOKENIZER)
    from tokenizers import Tokenizer

    rng = random.Random(12)
    items = [(k, invented(rng, 30, 9000)) for k in range(5)]
    texts = []
    for i in range(360):
        t = invented(rng, 50, 9000)
        if i % 6 == 0:
            t += ". you are an " + rng.choice(INSULTS) + ". " + invented(rng, 8, 9000)
        if i % 11 == 0:
            t += " " + items[i % 5][1]
        if i % 7 == 0 and texts:
            w = texts[-1].split()
            w[-1] = f"edit{i}"
            t = " ".join(w)
        texts.append(t)
    toxic = [any(x in t.split() or f"{x}." in t.split() for x in INSULTS) for t in texts]
    rows = [(i, t, "en", f"s{i % 4}", "x") for i, t in enumerate(texts)]
    folder = str(tmp_path)
    spark.createDataFrame(rows, DOC).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(
        [(i, 1, int(x)) for i, x in enumerate(toxic)],
        "doc_id long, quality int, toxic int",
    ).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")

    left = [r for r, x in zip(rows, toxic, strict=True) if not x]
    _, component = near_brute([r[1] for r in left], 5, 80)
    left = [r for k, r in enumerate(left) if component[k] == k]
    grams = {tuple(w[k : k + 10]) for w in (words_of(t) for _, t in items) for k in range(len(w) - 9)}
    left = [r for r in left if not any(tuple(w[k : k + 10]) in grams for w in [words_of(r[1])] for k in range(len(w) - 9))]
    mix = duck(oracles.MIXING, documents=spark.createDataFrame(left, DOC))
    copies = {r.doc_id: r.taken // r.size for r in mix.itertuples()}
    library, start, want = Tokenizer.from_file(path), 0, []
    for r in left:
        for _ in range(copies[r[0]]):
            ids = np.array([*library.encode(r[1], add_special_tokens=False).ids, 2], "<u4")
            want.append((r[0], start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
    got = corpus_pipeline.run(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == want and len(corpus_pipeline.STAGES) == 5


def test_odd_inputs(spark, tmp_path):
    """Null, empty and long texts, repeated rows, null ids, clashing columns and empty tables through all stages."""
    pytest.importorskip("public_tokenizers")
    folder = str(tmp_path)
    odd = [
        (1, None, "en", None, 1),
        (2, "", "en", "a", 2),
        (3, " \n", "en", "a", 3),
        (4, "one", "en", "b", 4),
        (4, "one", "en", "b", 4),
        (None, "no id at all", "de", "b", 5),
        (None, "no id at all", "de", "b", 5),
        (7, "word " * 30000, "en", "b", 6),
    ]
    schema = "doc_id long, text string, lang string, source string, `a-b` int"
    spark.createDataFrame(odd, schema).selectExpr("*", "1 as doc", "2 as _id", "3 as copies").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(2, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, None), (None, "one")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    columns = spark.read.parquet(f"{folder}/documents.parquet").columns
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        after = stage(spark, docs, folder)
        assert after.columns == columns, name
        after.write.parquet(f"{folder}/stage{k}")
        docs = spark.read.parquet(f"{folder}/stage{k}")
        ids = [r.doc_id for r in docs.collect()]
        assert name == "mixing" or sorted(map(str, ids)) == sorted(map(str, [1, 2, 3, 4, None, None, 7] + [4] * (name == "toxicity"))), name
    got = corpus_pipeline.run(spark, folder).collect()
    assert len(got) == len(ids) and sorted(str(r.doc_id) for r in got) == sorted(map(str, ids))
    spark.createDataFrame([], "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/none/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/none/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{folder}/none").collect() == []
