"""Token counts, collocations and fill-in-middle against the library, brute force, SQL and odd inputs."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.llm import collocations, counts, infill, oracles
from quern.llm.text import utf8

DOC = "doc_id long, text string, lang string, n long, phrase string, output string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, 5, "x", "y") for i, t, lang in rows], DOC)


def tokenizer(name="byte_bpe_50k.json"):
    public = pytest.importorskip("public_tokenizers")
    return public.path(name)


MARKS = ["<|endoftext|>", "'s", "'re", "  ", "\n\n", "<|endoftext", "|>", "é", "ß", "中", "　", "😀", "’", "\r", "\x0b", "\xa0", "×", "ـ", "\x1c", "\x85", *"ab Z09'\n\t ."]


def spelt(rng, n):
    return "".join(rng.choice(MARKS) for _ in range(n))


def counted_by_library(path, texts):
    from tokenizers import Tokenizer

    return [len(e.ids) for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("chunk, frequent, own", [(1 << 20, 1 << 15, 600_000), (700, 16, 20)])
def test_counts_of_any_text(monkeypatch, chunk, frequent, own):
    """Stretches, both tables full or not, and added tokens wherever they are: the library's numbers."""
    monkeypatch.setattr(counts, "CHUNK", chunk)
    rng, path = random.Random(5), tokenizer()
    texts = [spelt(rng, rng.randrange(60)) for _ in range(800)] + [None, "", "x" * 5000, "ab c" * 900 + "<|endoftext|>" + " d 12\n" * 500, "w " * 3000]
    known, table, mine = counts.library(path), counts.Lengths(frequent), counts.Lengths(own)
    data, at = utf8(pa.array(texts))
    n = np.zeros(len(texts), int)
    for place, part, start in counts.stretches(data, at, known.added):
        np.add.at(n, np.searchsorted(at, start + place, "right") - 1, counts.lengths(counts.Pieces(part, start), table, mine, known))
    assert n.tolist() == counted_by_library(path, texts) and mine.held <= own


def test_frequent_pieces(monkeypatch):
    """A piece above its share is in the summary whatever the order, and however summaries are merged; counts are never too high."""
    monkeypatch.setattr(counts, "FREQUENT", 8)
    rng = random.Random(2)
    words = [f"r{i}" for i in range(300)] + ["the"] * 120 + ["of"] * 90
    rng.shuffle(words)
    parts = [counts.Summary() for _ in range(3)]
    for i, w in enumerate(words):
        p = counts.Pieces(np.frombuffer(w.encode(), np.uint8), np.array([0]))
        parts[i % 3].add(p.hash, np.array([1]), p.length.astype(np.uint8), p.key)
    total = counts.Summary()
    for s in parts:
        total.merge(s.pack())
    raw = np.stack(total.key, 1).astype("<u8").tobytes()
    got = {raw[24 * i : 24 * i + n]: int(c) for i, (n, c) in enumerate(zip(total.size.tolist(), total.n, strict=True))}
    true = Counter(w.encode() for w in words)
    assert len(got) <= 8 and {b"the", b"of"} <= set(got) and all(true[w] - len(words) / 8 <= c <= true[w] for w, c in got.items())


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts(spark, name):
    rng, path = random.Random(7), tokenizer(name)
    texts = [" ".join(f"word{int(rng.paretovariate(0.7)) % 50}" for _ in range(rng.randrange(40))) for _ in range(150)] + [None, "", "tok " * 1500, "déjà\nvu " * 3]
    rows = [(i, t, None) for i, t in enumerate(texts)] + [(None, "no id", "en"), (3, texts[3], "en")]
    got = counts.count(docs_of(spark, rows), path)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and counts.count(docs_of(spark, rows).limit(0), path).isEmpty()
    if name.endswith(".json"):
        want = counted_by_library(path, [t for _, t, _ in rows])
    else:
        import sentencepiece

        want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode([t or "" for _, t, _ in rows])]
    want = [(i, len((t or "").encode()), n, n > 1024) for (i, t, _), n in zip(rows, want, strict=True)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def mined(rows, least=10, share=50, first=2000):
    """By the contract's words: lang, rank, phrase, a, l, r, n, score."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    out = []
    for lang in n:
        found = []
        for (own, p), a in f.items():
            if own != lang or len(p) < 2 or a < least:
                continue
            if any(len(q) == 3 and len(p) == 2 and p in (q[:2], q[1:]) and c >= least and 100 * c >= share * a for (o, q), c in f.items() if o == lang):
                continue
            cut = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            found.append((-cut[0], -a, " ".join(p).encode(), f[lang, p[: cut[1]]], f[lang, p[cut[1] :]]))
        out += [(lang, k, p.decode(), -a, x, y, n[lang], -s) for k, (s, a, p, x, y) in enumerate(sorted(found)[:first], 1)]
    return sorted(out)


def sayings(rng, n):
    said = ["New York City", "of the", "a b c", "a b c", "in the\tmiddle", "é ß", "x  y", "X Y;z", "end. of, the"]
    return [" ".join(rng.choice([*said, f"w{rng.randrange(30)}"]) for _ in range(rng.randrange(40))) for _ in range(n)]


@pytest.mark.parametrize("stretch, width, first", [(2 << 20, 1 << 20, 2000), (40, 64, 7)])
def test_collocations(spark, monkeypatch, stretch, width, first):
    """Whole stretches and tiny ones, a wide sketch and one that lets nearly everything through."""
    monkeypatch.setattr(collocations, "STRETCH", stretch)
    monkeypatch.setattr(collocations, "LEAST_WIDTH", width)
    monkeypatch.setattr(collocations, "MOST_WIDTH", width)
    rng = random.Random(9)
    rows = [(i, t, rng.choice(["en", "en", "de", None, "und"])) for i, t in enumerate(sayings(rng, 120))]
    rows += [(900, None, "en"), (901, "", "en"), (None, "of the of the", "en"), (902, "w" * 3000 + " q " * 20, "fr"), (903, " \t . ,", "xx"), (904, "m m m m " * 9, "mm")]
    got = collocations.collocations(docs_of(spark, rows), first=first)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    got = sorted(map(tuple, got.collect()))
    assert got == mined(rows, first=first) and {g[0] for g in got} >= {"en", "de", "und", "mm"}
    assert collocations.collocations(docs_of(spark, rows).limit(0)).isEmpty()


def test_counts_beyond_64_bits(spark):
    """Scores of counts whose products pass 64 bits are exact."""
    a, x, y = 3_000_000_007, 5_000_000_021, 4_000_000_019
    rows = [("en", 1, "p", x), ("en", 1, "q", y), ("en", 2, "p q", a), ("en", 0, "", 9 * x), ("en", 1, "s", 10**15), ("en", 2, "s s", 10**15 - 1)]
    counted = spark.createDataFrame(rows, "lang string, k int, phrase string, f long")
    got = {r.phrase: r.score for r in collocations.ranked(counted, 50, 10, collocations.Stages(spark, "test")).collect()}
    assert got == {"p q": 1_000_000 * a * a // (x * y), "s s": 1_000_000 * (10**15 - 1) ** 2 // 10**30}


def test_collocations_sql():
    rng = random.Random(4)
    rows = [(i, t, rng.choice(["en", "de", None])) for i, t in enumerate(sayings(rng, 80))]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar)")
    con.executemany("insert into documents values (?, ?, ?)", rows)
    assert sorted(con.execute(oracles.COLLOCATIONS).fetchall()) == mined(rows)


def filled(doc_id, text):
    """By the contract's words."""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    digest = hashlib.sha256(f"7:{doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return doc_id, n, "plain", None, None, text
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    if h[3] % 100 < 50:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_infill(spark, monkeypatch):
    monkeypatch.setattr(infill, "HELD", 200)
    rng = random.Random(3)
    parts = ["a line\n", "\n", "é😀\n", "\r\n", "last", "<", "<P", "S>", "P><", "<M", ">", " "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(300)] + ["", "\n", "x <S> y\n", "l\n" * 20000, "no end" * 5000]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(5, texts[5], "de")]
    out = infill.transform(docs_of(spark, rows))
    assert sorted(map(tuple, out.collect())) == sorted(filled(i, t) for i, t, _ in rows)
    back = infill.restore(out.withColumn("restored_", F.lit(1))).select("doc_id", "restored").distinct().collect()
    assert {r.doc_id: r.restored for r in back} == dict(enumerate(texts))
    odd = infill.restore(infill.transform(docs_of(spark, [(None, "a\nb\n", "en"), (1, None, "en")]))).collect()
    assert {(r.doc_id, r.n, r.restored) for r in odd} == {(None, 2, "a\nb\n"), (1, 0, "")}
    assert infill.transform(docs_of(spark, rows).limit(0)).isEmpty()
    forms = Counter(r.form for r in out.collect())
    assert forms["psm"] > 80 and forms["spm"] > 80


def test_infill_keeps_no_units():
    """Only two offsets are kept of a text of many units, and the iterator is read no further than the higher rank."""
    import tracemalloc

    pattern, text = re.compile(infill.LINES), "x\n" * 1_000_000
    tracemalloc.start()
    assert infill.counted(pattern, text) == 1_000_000 and infill.ends(pattern, text, 10, 999_000) == (20, 1_998_000)
    assert tracemalloc.get_traced_memory()[1] < 100_000
    tracemalloc.stop()


def test_infill_rates(spark):
    df = docs_of(spark, [(i, "a\nb\nc\n", "en") for i in range(400)])
    forms = Counter(r.form for r in infill.transform(df, infill.Rules(rate=50, suffix_first=0)).collect())
    assert 140 < forms["plain"] < 260 and not forms["spm"]
    words = infill.transform(df, infill.Rules(units=r"\S+\s*")).first()
    assert words.n == 3


@pytest.mark.parametrize("form", ["psm", "spm"])
def test_sentinels_in_the_way(form):
    """Parts that begin or end like sentinels are told from them."""
    rng = random.Random(1)
    for _ in range(2000):
        p, m, s = ("".join(rng.choice("<PSM>") for _ in range(rng.randrange(4))) for _ in range(3))
        if any(x in p + m + s for x in ("<P>", "<S>", "<M>")):
            continue
        out = f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"
        assert infill.restored(out, form) == p + m + s
