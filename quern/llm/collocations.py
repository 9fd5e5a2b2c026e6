"""Phrase collocations: count-min sketches, an exact second pass over what they let through, scores and subsumption.

Texts are cut into pieces at marks and line ends, pieces into words; phrases are runs of one to ``MOST_WORDS`` words inside a piece, counted by language.

First pass: every task adds the hashes of all its phrases to a count-min sketch of its own, with counters that stop at the least count asked for. Sketches
are merged slice by slice and become one bit a counter, "may have reached the least count", which all workers hold. An estimate is never below the
true count, so a phrase whose bits are not all set, or that holds a phrase whose bits are not, is too rare for certain.
Second pass: only the survivors are counted, by their words and exactly; those that a collision let through fall out here. The
sketch thus decides how much is shuffled, never what is found. Its width grows with the corpus up to ``MOST_WIDTH``.

A phrase's parts are at least as frequent as itself, so the counts of the survivors are all that scores need. A score is the lowest over a phrase's cuts of
count**2 / (left * right) in millionths, floored, in decimals of 38 digits: exact for counts up to 10**16. Phrases that a longer one holds at least
``SHARE`` percent of are dropped. Each language's first rows are taken in rounds, part by part, so that no task sorts a language.

Defined cases: null and empty texts hold no words; a null language is ``und``; repeated rows count each; ties go by count and phrase; an empty table
gives an empty result; other columns are ignored. Words are bytes, hence texts of any length and language are read alike.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import Stages, small_side
from .text import lean, mix, utf8, words

MOST_WORDS = 3
LEAST, SHARE, FIRST = 10, 50, 2000
UNKNOWN = "und"
#: Rows of a sketch, bounds of a row's counters, and counters of a slice. Bits of both rows take 16 MB at most.
DEPTH, LEAST_WIDTH, MOST_WIDTH, SLICE = 2, 1 << 20, 1 << 26, 1 << 20
#: Bytes of text that a task of the first pass reads, where that makes more tasks than cores.
TASK_BYTES = 4 << 30
#: Bytes of text that are worked on at once.
STRETCH = 1 << 20
#: Parts that a language's candidates are ranked in, each time the best of those before.
PARTS = (256, 16, 1)
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
LINE_END = 10


def _bytes() -> tuple[np.ndarray, np.ndarray]:
    """Value of every byte in words (0 outside of them, A-Z lowered), and whether it ends a piece."""
    ends = np.zeros(256, bool)
    ends[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
    value = np.arange(256, dtype=np.uint64) + np.uint64(1)
    value[65:91] += np.uint64(32)
    value[ends] = value[[9, 32]] = 0
    return value, ends


VALUE, PIECE_END = _bytes()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Run(NamedTuple):
    """Words of a stretch: bytes of all, a space after each; where each begins there and how long it is; language; hash; how many words, from each on, its
    piece has (up to MOST_WORDS); and how many words at the head were counted with the stretch before."""

    joined: np.ndarray
    at: np.ndarray
    length: np.ndarray
    lang: np.ndarray
    hash: np.ndarray
    room: np.ndarray
    known: int


def runs(data: np.ndarray, at: np.ndarray, lang: np.ndarray) -> Iterator[Run]:
    """The words of texts with offsets ``at`` and languages ``lang`` (numbers), in stretches; the last words of one come again before the next."""
    lo = 0
    data = np.insert(data[at[0] : at[-1]], at[1:] - at[0], LINE_END)  # a text's end is a piece's
    ends = at[1:] - at[0] + np.arange(len(at) - 1)
    known = hi = 0
    while hi < len(data):
        hi = min(hi + STRETCH, len(data))
        while hi < len(data) and VALUE[data[hi - 1]]:  # on to the end of a word
            more = np.flatnonzero(VALUE[data[hi : hi + STRETCH]] == 0)
            hi = hi + int(more[0]) + 1 if len(more) else min(hi + STRETCH, len(data))
        part = data[lo:hi]
        w = words(part, np.array([0, len(part)]), VALUE)
        if len(w.start):
            length = w.end - w.start
            ends_before = np.cumsum(PIECE_END[part], dtype=np.int32)[w.start]
            room = np.ones(len(length), np.int8)
            for k in range(1, MOST_WORDS):
                room[: len(length) - k] += (ends_before[k:] == ends_before[: len(length) - k]) if k < len(length) else 0
            keep = VALUE[part] != 0
            keep[w.end] = True
            joined = np.where(VALUE[part] != 0, LOWER[part], np.uint8(32))[keep]
            stops = np.cumsum(length + 1)
            yield Run(joined, stops - length - 1, length, lang[np.searchsorted(ends, w.start + lo, "left")], w.hash, room, known)
        known = min(len(w.start), MOST_WORDS - 1)
        lo = lo + int(w.start[-known]) if known else hi


def phrases(run: Run, salt: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each size: it, the first words of all phrases of that size that end in a new word, and their hashes (with the language's ``salt``)."""
    h = run.hash + salt[run.lang]
    n = len(h)
    for k in range(1, MOST_WORDS + 1):
        if k > n:
            return
        first = np.flatnonzero(run.room[: n - k + 1] >= k)
        first = first[first + k - 1 >= run.known]
        x = h[first] + np.uint64(k)
        for j in range(1, k):
            x = mix(x) * np.uint64(_ODD[2]) + run.hash[first + j]
        yield k, first, mix(x)


def places(h: np.ndarray, width: int) -> list[np.ndarray]:
    """The counter of each hash in every row of a sketch."""
    shift = np.uint64(64 - width.bit_length() + 1)
    return [((h * np.uint64(odd)) >> shift).astype(np.uint32) for odd in _ODD[:DEPTH]]


def _salts(langs: list[str]) -> np.ndarray:
    """A number a language, the same in every task."""
    return mix(np.array([zlib.crc32(x.encode()) for x in langs], np.uint64) + np.uint64(1))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], Iterator[Run]]]:
    """Languages of a batch, and its stretches."""
    for batch in batches:
        if batch.num_rows:
            coded = batch.column("lang").dictionary_encode()
            data, at = utf8(batch.column("text"))
            yield coded.dictionary.to_pylist(), runs(data, at, coded.indices.to_numpy())


class Sketch(NamedTuple):
    """Bits of a merged sketch, one row after another."""

    width: int
    bits: np.ndarray

    def may(self, h: np.ndarray) -> np.ndarray:
        """Whether the estimate of each hash reaches the least count."""
        out = np.ones(len(h), bool)
        for row, at in enumerate(places(h, self.width)):
            out &= (self.bits[(row * self.width >> 3) + (at >> 3)] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return out


def width_for(n_bytes: int, least: int) -> int:
    """Counters of a row: about one for ``least`` phrases, between the bounds."""
    wanted = MOST_WORDS * n_bytes / 6 / least
    return min(max(1 << max(int(wanted), 1).bit_length(), LEAST_WIDTH), MOST_WIDTH)


def sketch(texts: DataFrame, least: int, stages: Stages) -> Sketch:
    """The merged sketch of all phrases of ``texts`` (lang, text)."""
    spark = texts.sparkSession
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    width = width_for(size, least)
    kind = np.uint8 if least < 256 else np.uint32
    per = min(SLICE, width)

    @lean
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = None
        for langs, some in _texts(batches):
            salt = _salts(langs)
            rows = np.zeros((DEPTH, width), kind) if rows is None else rows
            for run in some:
                for _, _, h in phrases(run, salt):
                    for row, at in zip(rows, places(h, width), strict=True):
                        at.sort()
                        new = np.flatnonzero(np.append(True, at[1:] != at[:-1])[: len(at)])
                        n = np.diff(np.append(new, len(at)))
                        at = at[new]
                        row[at] = np.minimum(row[at] + n, least).astype(kind)
        if rows is not None:
            for k, part in enumerate(rows.reshape(-1, per)):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["slice", "counters"])

    @lean
    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, counters in zip(batch.column("slice").to_pylist(), batch.column("counters"), strict=True):
                got = np.frombuffer(counters.as_buffer(), kind)
                total[k] = np.minimum(total[k].astype(np.int64) + got, least).astype(kind) if k in total else got.copy()
        for k, counters in total.items():
            bits = np.packbits(counters >= least, bitorder="little").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([bits], pa.binary())], ["slice", "bits"])

    # few tasks, one sketch each, so that what is shuffled is a small share of the texts
    tasks = max(spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
    few = texts.coalesce(tasks).mapInArrow(counted, "slice int, counters binary")
    slices = DEPTH * width // per
    bits = stages.put(few.repartition(slices, "slice").mapInArrow(merged, "slice int, bits binary"), "sketch")
    out = np.zeros(DEPTH * width >> 3, np.uint8)
    for row in bits.toLocalIterator():
        out[row.slice * per >> 3 : (row.slice + 1) * per >> 3] = np.frombuffer(row.bits, np.uint8)
    return Sketch(width, out)


def _surviving(run: Run, salt: np.ndarray, found: Sketch) -> Iterator[tuple[int, np.ndarray]]:
    """For each size: it, and the first words of the phrases that may reach the least count, as may all the phrases in them."""
    held = np.zeros(0, bool)
    for k, first, h in phrases(run, salt):
        if k > 1:  # phrases of k - 1 words that begin here and at the next word; those of known words only were judged before
            some = held[first] & held[first + 1]
            first, h = first[some], h[some]
        first = first[found.may(h)]
        held = np.zeros(len(run.hash) + 1, bool)
        held[first] = True
        if k < MOST_WORDS:
            held[: max(run.known - k + 1, 0)] = True
        yield k, first


def _same_words(run: Run) -> np.ndarray:
    """A number for each word, equal where language and bytes are."""
    _, first, of = np.unique(run.hash + _ODD[1] * run.lang.astype(np.uint64), return_index=True, return_inverse=True)
    lead = first[of]
    same = (run.length[lead] == run.length) & (run.lang[lead] == run.lang)
    if same.all():  # all bytes against the first word of the same hash
        move = np.repeat(run.at[lead] - run.at, run.length + 1)
        if (run.joined == run.joined[np.arange(len(run.joined)) + move]).all():
            return of
    names: dict[tuple, int] = {}
    spelt = ((g, run.joined[a : a + n].tobytes()) for g, a, n in zip(run.lang.tolist(), run.at.tolist(), run.length.tolist(), strict=True))
    return np.array([names.setdefault(x, len(names)) for x in spelt])


def counts(texts: DataFrame, least: int, found: Broadcast) -> DataFrame:
    """lang, k, phrase, f of every phrase that occurs ``least`` times, and with k = 0 the words of each language."""

    @lean
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = found.value
        for langs, some in _texts(batches):
            salt, total = _salts(langs), np.zeros(len(langs), np.int64)
            for run in some:
                total += np.bincount(run.lang[run.known :], minlength=len(langs))
                of = _same_words(run)
                for k, first in _surviving(run, salt, sketch):
                    key = of[first].astype(np.uint64)
                    for j in range(1, k):
                        if j == 1:
                            key = key * np.uint64(of.max() + 1) + of[first + 1].astype(np.uint64)
                        else:  # numbers of pairs first, so that keys stay below 64 bits
                            key = np.unique(key, return_inverse=True)[1].astype(np.uint64) * np.uint64(of.max() + 1) + of[first + j].astype(np.uint64)
                    _, lead, n = np.unique(key, return_index=True, return_counts=True)
                    if len(lead):
                        yield _rows(run, first[lead], k, n, langs)
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array([0] * len(langs), pa.int32()), pa.array([""] * len(langs)), pa.array(total)], ["lang", "k", "phrase", "f"]
            )

    rows = texts.mapInArrow(counted, "lang string, k int, phrase string, f long")
    return rows.groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("k") == 0))


def _rows(run: Run, first: np.ndarray, k: int, n: np.ndarray, langs: list[str]) -> pa.RecordBatch:
    """Phrases as text: k words one after another, with single spaces."""
    last = first + k - 1
    start, size = run.at[first], run.at[last] + run.length[last] - run.at[first]
    ends = np.concatenate([[0], np.cumsum(size)])
    spelt = run.joined[np.arange(ends[-1]) + np.repeat(start - ends[:-1], size)]
    text = pa.Array.from_buffers(pa.large_string(), len(n), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(spelt.tobytes())]).cast(pa.string())
    lang = pa.DictionaryArray.from_arrays(pa.array(run.lang[first], pa.int32()), pa.array(langs, pa.string())).cast(pa.string())
    return pa.RecordBatch.from_arrays([lang, pa.array(np.full(len(n), k, np.int32)), text, pa.array(n.astype(np.int64))], ["lang", "k", "phrase", "f"])


def collocations(docs: DataFrame, least: int = LEAST, share: int = SHARE, first: int = FIRST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first candidates."""
    stages = Stages(docs.sparkSession, "collocations")
    texts = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    found = docs.sparkSession.sparkContext.broadcast(sketch(texts, least, stages))
    return ranked(stages.put(counts(texts, least, found), "counts"), share, first, stages)


def ranked(counted: DataFrame, share: int, first: int, stages: Stages) -> DataFrame:
    """Scores, subsumption and ranks from the exact counts: lang, k, phrase, f."""
    parts = counted.where((F.col("k") > 0) & (F.col("k") < MOST_WORDS)).select("lang", F.col("phrase").alias("part"), "f")
    cuts = counted.where("k > 1").select("lang", "k", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.withColumn("left", F.expr("substring_index(phrase, ' ', cut)")).withColumn("right", F.expr("substring_index(phrase, ' ', cut - k)"))
    for side, count in (("left", "l"), ("right", "r")):
        own = parts.select(F.col("lang").alias("p_lang"), "part", F.col("f").alias(count))
        cuts = cuts.join(own, (F.col("lang") == F.col("p_lang")) & (F.col(side) == F.col("part"))).drop("p_lang", "part", side)
    wide = {c: f"cast({c} as decimal(16,0))" for c in "alr"}
    exact = F.expr(f"({wide['a']} * {wide['a']} * cast(1000000 as decimal(7,0))) div ({wide['l']} * {wide['r']})")
    scored = cuts.select("lang", "phrase", "a", F.struct(exact.alias("score"), "cut", "l", "r").alias("best"), F.lit(None).cast("long").alias("longer"))
    held = counted.where("k > 2").select("lang", F.explode(F.array(*_inside())).alias("phrase"), F.col("f").alias("longer"))
    held = held.select("lang", "phrase", F.lit(None).cast("long").alias("a"), F.lit(None).cast(scored.schema["best"].dataType).alias("best"), "longer")
    each = scored.union(held).groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.min("best").alias("best"), F.max("longer").alias("longer"))
    kept = each.where(F.col("a").isNotNull() & (F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a"))))
    kept = kept.select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    order = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    for n in PARTS:
        part = F.pmod(F.xxhash64("phrase"), F.lit(n))
        kept = kept.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= first)
    n = small_side(counted.where("k = 0").select("lang", F.col("f").alias("n")))
    return kept.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _inside() -> list[Column]:
    """The runs of two words in a phrase of three."""
    return [F.substring_index("phrase", " ", k) for k in (2, -2)]
