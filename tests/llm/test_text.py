"""Byte-level text handling against regular expressions and the tokenizers library, in blocks too small for a word."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from quern.llm import decontaminate, language, tokens
from quern.llm import text as T

WORDS = {"blank": r"[^\x20\x09-\x0D]+", "alnum": r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"}


def texts_of(rng, n=40):
    parts = ["a", "Zz", "é", "日本", " ", "  ", "\n", "\t", ".", "-", "9", "x" * 40, "\0", "😀"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(n)] + ["", None, "one"]


@pytest.fixture
def blocks(monkeypatch):
    def to(size):
        monkeypatch.setattr(T, "BLOCK", size)
        T._powers.clear()

    yield to
    monkeypatch.undo()
    T._powers.clear()


@pytest.mark.parametrize("kind", sorted(WORDS))
def test_words(blocks, kind):
    texts, table = texts_of(random.Random(51)), T.word_bytes(kind)
    data, at = T.utf8(pa.array(texts, pa.string()))
    for size in (1 << 18, 13, 5):
        blocks(size)
        w = T.words(data, at, table)
        assert w.first.tolist() == np.concatenate([[0], np.cumsum(np.bincount(w.doc, minlength=len(texts)))]).tolist()
        for i, t in enumerate(texts):
            lowered = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
            found = re.findall(WORDS[kind], lowered)
            mine = range(int(w.first[i]), int(w.first[i + 1]))
            assert [re.sub("[A-Z]", lambda m: m[0].lower(), bytes(data[w.start[k] : w.end[k]]).decode()) for k in mine] == found
            assert [int(w.hash[k]) for k in mine] == [T.hash_of(x, table) for x in found]
        for size, some, hashes in T.starts_hash(data, at, w, table, [3, 1, 5]):
            long = [k for k in range(len(w.start)) if w.end[k] - w.start[k] >= size]
            assert some.tolist() == long and len(hashes) == len(long)
            whole = [h for k, h in zip(long, hashes, strict=True) if w.end[k] - w.start[k] == size]
            assert whole == [w.hash[k] for k in long if w.end[k] - w.start[k] == size]


def test_trigrams_in_blocks(monkeypatch):
    data, at = T.utf8(pa.array(texts_of(random.Random(52)), pa.string()))
    join = lambda: [np.concatenate(c).tolist() for c in zip(*language.trigrams(data, at), strict=True)]
    whole = join()
    monkeypatch.setattr(language, "BLOCK", 7)
    assert join() == whole and len(whole[0]) == sum(max(0, n - 2) for n in np.diff(at))


def test_encoder_against_the_library(monkeypatch):
    """Odd characters, contractions, spelled-out special tokens, a table too small for the pieces, and texts longer than a chunk."""
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    rng, library = random.Random(53), Tokenizer.from_file(path)
    parts = ["a", "b", " ", "  ", "\n", "\t", "\r\n", "é", "ß", "1", "23", "'s", "'ll", "'", "!", "??", "-", "_", "\xa0", "\x85", "日本", "<|endoftext|>", "<|end", "\x1c", "don't", " Word", "😀", "\0", "×", "÷", "ª"]
    parts += ["½", "Ω", "жжж", " ", "　", "​", "᠎", "﻿", "é", "ǅ", "٣", "क्ष", "'S", "’s", " ", "\x7f", "\x0b", " supercalifragilisticexpialidocious"]
    small = type("Small", (tokens.Encoder,), {"SLOT_BITS": 4, "MOST": 8, "PROBES": 3, "CHUNK": 64})
    for kind, rounds in ((tokens.Encoder, 12), (small, 12)):
        known = kind(path)
        for _ in range(rounds):
            texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(120))) for _ in range(60)] + [None, "", "x" * 500]
            data, at = T.utf8(pa.array(texts, pa.string()))
            got = []
            for lo, hi in T.chunks(at, known.CHUNK):
                ids, n = known.encode(data, at[lo : hi + 1])
                got += [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
            for t, ids in zip(texts, got, strict=True):
                assert ids == [*library.encode(t or "", add_special_tokens=False).ids, 2], t
    assert small(path).held == 0 and known.used <= 8 * 24 + 1


@pytest.mark.parametrize("stretch", [1 << 20, 7])
def test_matches_of_repeated_words(monkeypatch, stretch):
    """Hits, items and longest matches of texts that repeat few words, against every pair of places."""
    monkeypatch.setattr(decontaminate, "STRETCH", stretch)
    monkeypatch.setattr(decontaminate, "PAIRS", 3)
    rng = random.Random(54)
    for _ in range(60):
        some, window = rng.choice(["ab", "abc", "abcdefghij"]), rng.choice([3, 4, 10])
        say = lambda n: [rng.choice(some) for _ in range(rng.randrange(n))]
        items, docs = [say(25) for _ in range(4)], [say(50) for _ in range(5)]
        data, at = T.utf8(pa.array([" ".join(d) for d in docs]))
        m = decontaminate.matches(data, at, decontaminate.tests([str(i) for i in range(4)], [" ".join(i) for i in items], window), window)
        for d, words in enumerate(docs):
            hit, held, most = set(), set(), 0
            for k, item in enumerate(items):
                need = min(window, len(item))
                for p in range(len(words)):
                    for q in range(len(item) - need + 1) if need else ():
                        n = 0
                        while p + n < len(words) and q + n < len(item) and words[p + n] == item[q + n]:
                            n += 1
                        if n >= need:
                            hit |= set(range(p, p + n))
                            held.add(k)
                            most = max(most, n)
            covered = {x for i in np.flatnonzero(m.covered[0] == d) for x in range(m.covered[1][i], m.covered[2][i])}
            assert covered == hit and set(m.pairs[1][m.pairs[0] == d].tolist()) == held
            rows = [[int(c[i]) for c in m.found[1:]] for i in np.flatnonzero(m.found[0] == d)]
            assert all(words[to : to + n] == items[k][at_ : at_ + n] for k, at_, to, n in rows)
            assert max((r[3] for r in rows), default=0) == most and {x for r in rows for x in range(r[2], r[2] + r[3])} == hit
