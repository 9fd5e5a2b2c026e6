"""Benchmark decontamination by training suffix arrays.

Documents are indexed shard by shard: a shard is a run of whole documents of about ``SHARD_BYTES`` as it comes from the scan, cut
into stretches of ``STRETCH`` words that overlap by a window, and the suffix array of a stretch sorts its word positions by the words that follow
(prefix doubling on word hashes, as deep as a window). Every distinct test suffix that can hold a window is binary-searched
in it. What it finds are ranges of the suffix array, which for suffixes of one length do not overlap: marks are set on at most as many
positions as the stretch has words, however often a word repeats. The marked words, ordered together with the items
that they hit, give the longest verbatim matches and their locations. Nothing is shuffled: a shard's documents are decided
where they are read. Benchmark items are broadcast in blocks of at most ``BLOCK_BYTES`` of text; with more than one block the documents
pass once for each, through a staged table.

A window is ``window`` consecutive words of an item, or the whole of a shorter item. Words are maximal runs of letters, digits and
non-ASCII characters with A-Z lowered, held as 64-bit hashes.

Defined cases: null and empty texts have no words and no hits; items without words or without id match nothing; rows that
repeat an id are judged one by one; rows of one item id count as one item; an empty table on either side gives no hits; a
document's other columns, whatever their names, are carried unchanged by ``remove``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .staging import Stages, filtered
from .text import chunks, lean, mix, utf8, word_bytes, words

WINDOW = 10
SHARD_BYTES = 4 << 20
STRETCH = 1 << 20
BLOCK_BYTES = 32 << 20
#: Pairs of a document and an item that are listed before repeats are dropped.
PAIRS = 1 << 21
ALNUM = word_bytes("alnum")
RANGES = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))
FOUND = ArrayType(StructType([StructField("item", StringType()), *[StructField(c, IntegerType()) for c in ("item_start", "doc_start", "length")]]))
RESULT = [
    StructField("n_words", LongType()),
    StructField("items", ArrayType(StringType())),
    StructField("covered", RANGES),
    StructField("found", FOUND),
]


class Tests(NamedTuple):
    """Words of the items in one row, and the distinct suffixes that hold a window: a start, words needed, and the items that hold it."""

    hash: np.ndarray
    first: np.ndarray
    start: np.ndarray
    need: np.ndarray
    holders: np.ndarray
    ends: np.ndarray
    ids: list[str]


def tests(ids: list[str], texts: list[str], window: int) -> Tests:
    data, at = utf8(pa.array(texts, pa.string()))
    w = words(data, at, ALNUM)
    hashes = np.concatenate([w.hash | np.uint64(1), np.zeros(window, np.uint64)])
    count = np.diff(w.first)
    n = np.where(count >= window, count - window + 1, (count > 0).astype(np.int64))
    item = np.repeat(np.arange(len(ids)), n)
    start = w.first[:-1][item] + np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n)
    need = np.minimum(count, window)[item]
    key = need.astype(np.uint64)
    for d in range(window):
        key = np.where(need > d, mix(key * np.uint64(0x2545F4914F6CDD1D) + hashes[start + d]), key)
    _, one, same = np.unique(key, return_index=True, return_inverse=True)
    held = np.unique(np.stack([same, item]), axis=1) if len(item) else np.empty((2, 0), np.int64)
    return Tests(hashes, w.first, start[one], need[one], held[1], np.searchsorted(held[0], np.arange(len(one) + 1)), ids)


def suffix_array(sequence: np.ndarray, depth: int) -> np.ndarray:
    """Positions ordered by the next ``depth`` or more values, by prefix doubling."""
    order = np.argsort(sequence)
    rank = np.empty(len(sequence), np.int64)
    ordered = sequence[order]
    rank[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
    step = 1
    while step < depth and rank[order[-1]] < len(sequence) - 1:
        key = rank * (len(sequence) + 1)
        key[:-step] += rank[step:] + 1
        order = np.argsort(key)
        ordered = key[order]
        rank[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
        step *= 2
    return order


def search(sequence: np.ndarray, order: np.ndarray, t: Tests, some: np.ndarray, upper: bool) -> np.ndarray:
    """For each of ``some`` test suffixes, the first place in ``order`` whose words are not below (``upper``: are above) it."""
    lo, hi = np.zeros(len(some), np.int64), np.full(len(some), len(order))
    start, needed = t.start[some], t.need[some]
    most = int(needed.max(initial=0))
    for _ in range(int(len(order)).bit_length() + 1):
        live = np.flatnonzero(lo < hi)
        if not len(live):
            break
        mid = (lo[live] + hi[live]) // 2
        at, test, need = order[mid], start[live], needed[live]
        sign = np.zeros(len(live), np.int8)
        equal = np.arange(len(live))
        for d in range(most):
            equal = equal[need[equal] > d]
            if not len(equal):
                break
            a, b = sequence[at[equal] + d], t.hash[test[equal] + d]
            sign[equal] = (a > b).astype(np.int8) - (a < b)
            equal = equal[a == b]
        right = sign <= 0 if upper else sign < 0
        lo[live[right]] = mid[right] + 1
        hi[live[~right]] = mid[~right]
    return lo


def _spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every place of the ranges, with the number of its range."""
    n = hi - lo
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(len(of)) + np.repeat(lo - (np.cumsum(n) - n), n), of


def _hits(sequence: np.ndarray, t: Tests, window: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Words needed, positions and test of the hits in each stretch; the sequence ends with ``window`` zeros."""
    length = len(sequence) - window
    for b in range(0, length, STRETCH):
        own = sequence[b : b + STRETCH + 2 * window]
        if b + STRETCH < length:
            own = np.concatenate([own[: STRETCH + window], np.zeros(window, np.uint64)])
        order = suffix_array(own[: len(own) - window], window)
        heads = own[order]
        at = np.minimum(np.searchsorted(heads, t.hash[t.start]), len(heads) - 1)
        some = np.flatnonzero(heads[at] == t.hash[t.start])
        lo, hi = search(own, order, t, some, False), search(own, order, t, some, True)
        some, lo, hi = some[hi > lo], lo[hi > lo], hi[hi > lo]
        for need in np.unique(t.need[some]):
            k = np.flatnonzero(t.need[some] == need)
            place, of = _spread(lo[k], hi[k])
            place, test = order[place], some[k][of]
            mine = place < STRETCH  # the next stretch begins there
            yield int(need), b + place[mine], test[mine]


class Matches(NamedTuple):
    """Of a shard: words of each document; (document, item) pairs; covered ranges and longest matches with their document."""

    n_words: np.ndarray
    pairs: tuple[np.ndarray, np.ndarray]
    covered: tuple[np.ndarray, np.ndarray, np.ndarray]
    found: tuple[np.ndarray, ...]


def matches(data: np.ndarray, at: np.ndarray, t: Tests, window: int, located: bool = True) -> Matches:
    w = words(data, at, ALNUM)
    n_words = np.diff(w.first)
    nothing = np.empty(0, np.int64)
    none = Matches(n_words, (nothing,) * 2, (nothing,) * 3, (nothing,) * 5)
    if not len(w.hash) or not len(t.start):
        return none
    # one zero after each document keeps matches inside it; zeros at the end keep reads in range
    length, starts = len(w.hash) + len(n_words), w.first[:-1] + np.arange(len(n_words))
    sequence = np.zeros(length + window, np.uint64)
    sequence[np.arange(len(w.hash)) + w.doc] = w.hash | np.uint64(1)
    edge, whole = np.zeros(length + 1, np.int32), np.zeros(length, bool)
    pairs, held, short = [nothing], 0, []
    for need, place, test in _hits(sequence, t, window):
        edge[place] += 1
        edge[place + need] -= 1
        doc = np.searchsorted(starts, place, "right") - 1
        lead = np.unique(doc * len(t.start) + test)  # a document meets a suffix once
        d, k = lead // len(t.start), lead % len(t.start)
        sizes = np.cumsum(t.ends[k + 1] - t.ends[k])
        for cut in np.split(np.arange(len(k)), np.searchsorted(sizes, np.arange(PAIRS, int(sizes[-1]) if len(sizes) else 0, PAIRS))):
            holder, of = _spread(t.ends[k[cut]], t.ends[k[cut] + 1])
            pairs.append(np.unique(d[cut][of] * len(t.ids) + t.holders[holder]))
            held += len(pairs[-1])
            if held > PAIRS:
                pairs = [np.unique(np.concatenate(pairs))]
                held = len(pairs[0])
        if need == window:
            whole[place] = True
        else:
            short.append((place, t.holders[t.ends[test]], np.zeros(len(place), np.int64), np.full(len(place), need)))
    pair = np.unique(np.concatenate(pairs))
    if not len(pair):
        return none
    inside = np.cumsum(edge) > 0
    turn = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    lo, hi = turn[::2], turn[1::2]
    doc = np.searchsorted(starts, lo, "right") - 1
    covered = (doc, lo - starts[doc], hi - starts[doc])
    pair = (pair // len(t.ids), pair % len(t.ids))
    if not located:
        return Matches(n_words, pair, covered, none.found)
    place, item, item_start, size = (np.concatenate(c) for c in zip(*short, _longest(sequence, lo, hi, whole, t, np.unique(pair[1])), strict=True))
    doc = np.searchsorted(starts, place, "right") - 1
    by = np.lexsort((item, size, place))
    return Matches(n_words, pair, covered, tuple(x[by] for x in (doc, item, item_start, place - starts[doc], size)))


def _longest(sequence: np.ndarray, lo: np.ndarray, hi: np.ndarray, whole: np.ndarray, t: Tests, items: np.ndarray) -> tuple[np.ndarray, ...]:
    """Place, item, place in the item and length of every match that no word before or after it prolongs.

    The covered ranges and the items are ordered together; of all suffixes of items, a neighbour in that order shares most with a place.
    """
    mine, _ = _spread(lo, hi + 1)  # each with a word after it, which none of the two shares
    theirs, of = _spread(t.first[items], t.first[items + 1] + 1)
    last = np.append(np.diff(of) > 0, True) if len(of) else np.empty(0, bool)
    values = np.concatenate([sequence[mine], np.where(last, np.uint64(0), t.hash[theirs])])
    stop = np.concatenate([np.zeros(len(mine), bool), last])
    stop[np.cumsum(hi + 1 - lo) - 1] = True
    values[stop] = 0
    n = len(mine)
    ahead = np.flatnonzero(stop)
    left = ahead[np.searchsorted(ahead, np.arange(len(values)))] - np.arange(len(values))
    order = suffix_array(values, int(left.max()) + 1)
    theirs_at = np.where(order >= n, np.arange(len(order)), -1)
    above = np.maximum.accumulate(theirs_at)
    below = np.minimum.accumulate(np.where(theirs_at >= 0, theirs_at, len(order))[::-1])[::-1]
    slot = np.empty(len(order), np.int64)
    slot[order] = np.arange(len(order))
    p = np.flatnonzero(whole[mine])
    power = np.cumprod(np.full(len(values), 0x9E3779B97F4A7C15, np.uint64))
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(values) * power)])
    best, where = np.zeros(len(p), np.int64), np.full(len(p), -1)
    for near in (above, below):
        at = near[slot[p]]
        real = (at >= 0) & (at < len(order))
        q = np.where(real, order[np.clip(at, 0, len(order) - 1)], n)
        size, most = np.zeros(len(p), np.int64), np.where(real, np.minimum(left[p], left[q]), 0)
        step = 1 << int(most.max(initial=0)).bit_length()
        while step:  # the greatest length at which the sums agree
            more = size + step
            fits = more <= most
            a, b = total[np.where(fits, p + more, p)] - total[p], total[np.where(fits, q + more, q)] - total[q]
            size = np.where(fits & (a * power[q] == b * power[p]), more, size)
            step >>= 1
        better = size > best
        best, where = np.where(better, size, best), np.where(better, q, where)
    before = np.full(len(values) + 1, -1)
    before[p + 1] = best - 1
    new = best != before[p]
    p, best, q = p[new], best[new], where[new] - n
    return mine[p], items[of[q]], theirs[q] - t.first[items[of[q]]], best


def _lists(doc: np.ndarray, rows: pa.Array, n: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)), rows)


def _structs(names: Sequence[str], columns: Sequence[pa.Array]) -> pa.StructArray:
    return pa.StructArray.from_arrays(list(columns), list(names))


def _searched(t, window: int):
    @lean
    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = t.value
        ids = pa.array(known.ids, pa.string())
        for batch in batches:
            data, at = utf8(batch.column(1))
            for lo, hi in chunks(at, SHARD_BYTES):
                m = matches(data, at[lo : hi + 1], known, window)
                covered = _structs(("start", "end"), map(pa.array, m.covered[1:]))
                ints = [pa.array(x.astype(np.int32)) for x in m.found[2:]]
                found = _structs(("item", "item_start", "doc_start", "length"), [ids.take(pa.array(m.found[1])), *ints])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[lo:hi],
                        batch.column(1)[lo:hi],
                        pa.array(m.n_words),
                        _lists(m.pairs[0], ids.take(pa.array(m.pairs[1])), hi - lo),
                        _lists(m.covered[0], covered, hi - lo),
                        _lists(m.found[0], found, hi - lo),
                    ],
                    ["doc", "text", "n_words", "items", "covered", "found"],
                )

    return searched


def _usable(items: DataFrame) -> tuple[DataFrame, int]:
    """Items with an id and a text, and the number of blocks of about ``BLOCK_BYTES`` of text that they make."""
    items = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    return items, int((items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES) + 1


def _block(items: DataFrame, blocks: int, k: int, window: int):
    """The tests of block ``k``, broadcast."""
    part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else items
    rows = part.toArrow().sort_by([("item_id", "ascending"), ("text", "ascending")])
    return items.sparkSession.sparkContext.broadcast(tests(rows["item_id"].to_pylist(), rows["text"].to_pylist(), window))


def annotate(docs: DataFrame, items: DataFrame, window: int = WINDOW, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """For every document: ``doc`` (its columns of ``keep``), n_words, items, covered, found.

    items: ids of items with a window in the document. covered: ranges of words inside windows, which may overlap between blocks of items.
    found: longest verbatim matches, each with one item, its place there and in the document.
    """
    items, blocks = _usable(items)
    stages = Stages(docs.sparkSession, "decontaminate")
    now = docs.select(F.struct(*[_named(docs, c) for c in keep]).alias("doc"), "text")
    for k in range(blocks):
        schema = StructType([now.schema["doc"], StructField("text", StringType()), *RESULT])
        out = now.mapInArrow(_searched(_block(items, blocks, k, window), window), schema)
        if k:  # what the blocks before found travels in doc
            out = out.select("doc.doc", "text", "n_words", *[F.concat(f"doc.{c}", c).alias(c) for c in ("items", "covered", "found")])
        if k == blocks - 1:
            return out.drop("text")
        before, now = now, stages.put(out.select(F.struct("doc", "items", "covered", "found").alias("doc"), "text"), f"block{k}")
        stages.drop(before)
    raise AssertionError("at least one block")


def _named(docs: DataFrame, column: str):
    return docs["`" + column.replace("`", "``") + "`"]


def judged(docs: DataFrame, items: DataFrame, window: int = WINDOW, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``doc`` (the columns of ``keep``), n_words, n_hit, n_items, items_sha256, contaminated, longest, found for every row."""
    long = lambda x: F.lit(x).cast("long")
    zero = F.struct(long(0).alias("n"), long(0).alias("to"))
    hit = F.aggregate(
        F.array_sort("covered"),
        zero,
        lambda a, x: F.struct(
            (a["n"] + F.greatest(long(0), x["end"] - F.greatest(x["start"], a["to"]))).alias("n"),
            F.greatest(a["to"], x["end"]).alias("to"),
        ),
        lambda a: a["n"],
    )
    names = F.array_sort(F.array_distinct("items"))
    return annotate(docs, items, window, keep).select(
        "doc",
        "n_words",
        hit.alias("n_hit"),
        F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (F.size("items") > 0).alias("contaminated"),
        F.coalesce(F.array_max(F.transform("found", lambda x: x["length"])), F.lit(0)).alias("longest"),
        "found",
    )


def _clean(t, place: int, window: int):
    @lean
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(place))
            for lo, hi in chunks(at, SHARD_BYTES):
                kept = np.ones(hi - lo, bool)
                kept[matches(data, at[lo : hi + 1], t.value, window, located=False).pairs[0]] = False
                yield batch.slice(lo, hi - lo).filter(pa.array(kept))

    return clean


def remove(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without any hit, with the columns they came with, whatever their names.

    Each row is judged by its own text, repeated ids and texts alike; null and empty texts stay; without items, or without documents, nothing goes.
    """
    items, blocks = _usable(items)
    stages, place = Stages(docs.sparkSession, "decontaminate"), docs.columns.index("text")
    for k in range(blocks):
        before, docs = docs, filtered(docs, _clean(_block(items, blocks, k, window), place, window))
        if k < blocks - 1:
            docs = stages.put(docs, f"block{k}")
            stages.drop(before)
    return docs
