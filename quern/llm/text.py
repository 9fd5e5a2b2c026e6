"""Vectorised text handling on UTF-8 bytes: whole Arrow columns become arrays of word positions and hashes.

A text stays bytes throughout. Words are maximal runs of word bytes inside one document; the hash of a word is a polynomial in
its bytes modulo 2**64, mixed at the end. Bytes are read in blocks of ``BLOCK``, and a word that crosses a block's end is put together from
its parts, so what is held beside the words themselves does not grow with a text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
BLOCK = 1 << 18
FREE_EVERY = 4
_BASE = 0x9E3779B97F4A7C15
_ALL = (1 << 64) - 1
_powers: list[np.ndarray] = []


def free() -> None:
    """Hands memory that is free in this process back to the system, where its allocator can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(function: Callable) -> Callable:
    """A function of Arrow batches that frees memory every few batches and at its end.

    Workers live on between tasks, beside an executor's heap; what they keep for later, the heap can't have.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def watched() -> Iterator[pa.RecordBatch]:
            for k, batch in enumerate(batches, 1):
                yield batch
                if k % FREE_EVERY == 0:
                    free()

        yield from function(watched())
        free()

    return run


def word_bytes(pattern: str) -> np.ndarray:
    """Value of every byte for hashing: 0 for a separator, else the byte with A-Z lowered, plus 1.

    ``blank``: words are ``[^\\x20\\x09-\\x0D]+``. ``alnum``: words are
    ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lowering.
    """
    value = np.arange(256, dtype=np.uint64)
    value[65:91] += 32
    word = np.ones(256, bool)
    if pattern == "blank":
        word[[32, 9, 10, 11, 12, 13]] = False
    elif pattern == "alnum":
        word[:128] = False
        word[48:58] = word[97:123] = word[65:91] = True
    else:
        raise ValueError(pattern)
    return np.where(word, value + np.uint64(1), np.uint64(0))


def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, 0 to ``BLOCK``."""
    if not _powers:
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(BLOCK + 1, base, np.uint64)
            p[0] = 1
            _powers.append(np.cumprod(p))
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)), at


def chunks(at: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of at most ``limit`` bytes, or of one document."""
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


class Words(NamedTuple):
    """Words of a chunk: byte range in the chunk, document index in the chunk, hash, first word of each document."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    first: np.ndarray


def words(data: np.ndarray, at: np.ndarray, table: np.ndarray) -> Words:
    """``at``: offsets of the chunk's documents in ``data``."""
    lo, size = int(at[0]), int(at[-1] - at[0])
    at = at - lo
    cuts = np.unique(at[1:-1])
    power, inverse = powers()
    found: list[list[np.ndarray]] = []
    for b in range(0, size, BLOCK):
        value = table[data[lo + b : lo + min(b + BLOCK, size)]]
        inside = np.zeros(len(value) + 2, bool)
        inside[1:-1] = value != 0
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edge[::2], edge[1::2]
        own = cuts[np.searchsorted(cuts, b, "right") : np.searchsorted(cuts, b + len(value))] - b
        own = own[inside[own] & inside[own + 1]]  # a word that runs on from one document into the next
        if len(own):
            starts, ends = np.sort(np.concatenate([starts, own])), np.sort(np.concatenate([ends, own]))
        total = np.zeros(len(value) + 1, np.uint64)
        np.cumsum(value * power[: len(value)], out=total[1:])
        raw = (total[ends] - total[starts]) * inverse[starts]
        starts, ends = starts + b, ends + b
        last = found[-1] if found else None
        if last and len(starts) and starts[0] == b == last[1][-1] and not _has(cuts, b):
            # the last word of the block before goes on
            more = pow(_BASE, int(last[1][-1] - last[0][-1]), 1 << 64)
            last[2][-1] = (int(last[2][-1]) + int(raw[0]) * more) & _ALL
            last[1][-1] = ends[0]
            starts, ends, raw = starts[1:], ends[1:], raw[1:]
        if len(starts):
            found.append([starts, ends, raw])
    starts, ends, raw = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (
        np.empty(0, np.int64),
        np.empty(0, np.int64),
        np.empty(0, np.uint64),
    )
    first = np.searchsorted(starts, at)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(first))
    return Words(starts, ends, doc, mix(raw), first)


def _has(ordered: np.ndarray, x: int) -> bool:
    k = int(np.searchsorted(ordered, x))
    return k < len(ordered) and ordered[k] == x


def starts_hash(data: np.ndarray, at: np.ndarray, w: Words, table: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each size in rising order: it, the words of at least so many bytes, and the hashes of their first bytes."""
    some, raw, done = np.arange(len(w.start)), np.zeros(len(w.start), np.uint64), 0
    place = w.start + at[0]
    for size in sorted(sizes):
        keep = (w.end - w.start)[some] >= size
        some, raw = some[keep], raw[keep]
        for k in range(done, size):
            raw = raw + table[data[place[some] + k]] * np.uint64(pow(_BASE, k, 1 << 64))
        done = size
        yield size, some, mix(raw)


def hash_of(text: str, table: np.ndarray) -> int:
    """The hash that ``words`` and ``starts_hash`` give to a text."""
    raw = sum(int(table[b]) * pow(_BASE, k, 1 << 64) for k, b in enumerate(text.encode())) & _ALL
    return int(mix(np.array([raw], np.uint64))[0])
