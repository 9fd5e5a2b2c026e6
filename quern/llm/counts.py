"""Token counts by a two-tier lookup of pre-token lengths, without a shuffle of pre-tokens.

Texts of a byte-level tokenizer are cut into pieces that no token reaches across (``tokens.pieces``). How many tokens a piece has is looked up

1. in a table of the frequent pieces of all documents, of a fixed size, broadcast to every worker;
2. else in a table of the worker's own, of a fixed size too, which remembers what the library said of the pieces missed before;
3. else the library encodes the piece, many at once.

The frequent pieces come from a first pass: every task keeps a summary of at most ``FREQUENT`` counters (Misra and Gries), and summaries, one row a task
and not one a piece, are merged round by round; a piece that makes up more than 1/FREQUENT of all pieces is in the table whatever the partitions.
What the table holds decides where a length is looked up, never what it is: both tables compare all bytes of a piece.

Tokenizers with a normalizer or another pre-tokenizer, and ``.model`` files, encode whole texts by their library.

Defined cases: null and empty texts have no bytes and no tokens; added tokens spelt in a text count as the library takes them by default; repeated rows are
counted one by one; an empty table gives an empty result; null ids are kept; other columns are ignored.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import Stages
from .text import chunks, lean, mix, utf8
from .tokens import MASK, PLAIN, pieces

#: Counters of a summary, which is also the most that the broadcast table holds: 33 bytes each.
FREQUENT = 1 << 15
#: Summaries, about, that a task merges after the first round.
FAN = 16
#: Entries of a worker's own table.
OWN = 600_000
LIMIT = 1024
LONGEST = 24
PROBES = 8
CHUNK = 1 << 20
GROUP = 64


class Pieces:
    """Pieces of a stretch of bytes: where they start, their lengths, and for short ones their bytes as three words and a hash."""

    def __init__(self, data: np.ndarray, start: np.ndarray):
        self.start, self.length = start, np.diff(np.append(start, len(data)))
        self.data = np.zeros(len(data) + 32, np.uint8)
        self.data[: len(data)] = data
        view = np.ndarray(len(self.data) - 7, "<u8", self.data, strides=(1,))  # the eight bytes from each place on
        self.key = [view[np.minimum(start + 8 * k, len(view) - 1)] & MASK[np.clip(self.length - 8 * k, 0, 8)] for k in range(3)]
        self.short = self.length <= LONGEST
        self.hash = hashed(self.key, self.length)

    def raw(self, i: int) -> bytes:
        return self.data[self.start[i] : self.start[i] + self.length[i]].tobytes()


def hashed(key: list[np.ndarray], length: np.ndarray) -> np.ndarray:
    return mix(key[0] ^ mix(key[1] + mix(key[2] + length.astype(np.uint64))))


class Lengths:
    """An open-addressed table from pieces of at most ``LONGEST`` bytes to their numbers of tokens; never more than ``most`` entries."""

    def __init__(self, most: int):
        self.bits, self.most, self.held = max(4, int(most * 1.6).bit_length()), most, 0
        slots = 1 << self.bits
        self.key = [np.zeros(slots, np.uint64) for _ in range(3)]
        self.size, self.n = np.zeros(slots, np.uint8), np.zeros(slots, np.uint8)

    def find(self, key: list[np.ndarray], size: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of tokens, and whether each piece is in the table."""
        n, found = np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        todo, slot = np.arange(len(h)), (h >> np.uint64(64 - self.bits)).astype(np.int64)
        for _ in range(PROBES):
            hit = self.size[slot] == size[todo]
            for own, other in zip(self.key, key, strict=True):
                hit &= own[slot] == other[todo]
            n[todo[hit]], found[todo[hit]] = self.n[slot[hit]], True
            on = ~hit & (self.size[slot] > 0)
            todo, slot = todo[on], (slot[on] + 1) & ((1 << self.bits) - 1)
            if not len(todo):
                break
        return n, found

    def put(self, key: list[np.ndarray], size: np.ndarray, h: np.ndarray, n: np.ndarray) -> None:
        """Adds distinct new pieces, each in the first free slot from its own; those that find none are left out."""
        todo = np.flatnonzero(n < 256)[: self.most - self.held]
        slot = (h[todo] >> np.uint64(64 - self.bits)).astype(np.int64)
        for _ in range(PROBES):
            free = np.flatnonzero(self.size[slot] == 0)
            _, one = np.unique(slot[free], return_index=True)
            mine = free[one]
            at, k = slot[mine], todo[mine]
            for own, other in zip(self.key, key, strict=True):
                own[at] = other[k]
            self.size[at], self.n[at] = size[k], n[k]
            self.held += len(k)
            left = np.ones(len(todo), bool)
            left[mine] = False
            todo, slot = todo[left], (slot[left] + 1) & ((1 << self.bits) - 1)
            if not len(todo):
                break


class Library:
    """A tokenizer file as its own library reads it."""

    def __init__(self, path: str):
        self.cuts, self.whole = False, None
        if path.endswith(".model"):
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.whole = lambda texts: [len(x) for x in self.model.encode(texts, num_threads=1)]
            return
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.whole = lambda texts: [len(e.ids) for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]
        stage = json.loads(self.model.to_str())
        split, added = stage.get("pre_tokenizer") or {}, stage.get("added_tokens") or []
        self.added = [t["content"].encode() for t in added]
        plain = not any(t.get(k) for t in added for k in ("lstrip", "rstrip", "single_word"))
        apart = all(len(a) and not any(a is not b and (a in b or _meet(a, b)) for b in self.added) and not _meet(a, a) for a in self.added)
        byte_level = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
        self.cuts = stage.get("normalizer") is None and byte_level and plain and apart
        if self.cuts:
            vocabulary = self.model.get_vocab()
            self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)
            self.width[list(vocabulary.values())] = list(map(len, vocabulary))  # one character a byte

    def lengths(self, raw: list[bytes]) -> np.ndarray:
        """Numbers of tokens of pieces: those of one word are encoded many at once, told apart by the bytes of their tokens."""
        out = np.zeros(len(raw), np.int64)
        texts = [x.decode() for x in raw]
        plain = [i for i, t in enumerate(texts) if PLAIN.fullmatch(t)]
        groups = ["".join(texts[i] + "\n" for i in plain[k : k + GROUP]) for k in range(0, len(plain), GROUP)]
        if groups:
            ids = np.concatenate([np.array(e.ids, np.int64) for e in self.model.encode_batch_fast(groups, add_special_tokens=False)])
            ends = np.concatenate([[0], np.cumsum(self.width[ids])])
            stop = np.cumsum([len(raw[i]) + 1 for i in plain]) - 1
            start = np.concatenate([[0], stop[:-1] + 1])
            lo, hi = np.searchsorted(ends, start), np.searchsorted(ends, stop)
            if not ((ends[lo] == start) & (ends[np.minimum(hi, len(ends) - 1)] == stop)).all():
                raise ValueError("a token reaches across a line end")
            out[plain] = hi - lo
        rest = sorted(set(range(len(raw))) - set(plain))
        if rest:
            out[rest] = self.whole([texts[i] for i in rest])
        return out


def _meet(a: bytes, b: bytes) -> bool:
    """Whether a proper head of ``b`` is a tail of ``a``."""
    return any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b))))


_libraries: dict[str, Library] = {}
_own: dict[str, Lengths] = {}


def library(path: str) -> Library:
    """The tokenizer, loaded once a worker."""
    if path not in _libraries:
        _libraries.clear()
        _own.clear()
        _libraries[path] = Library(path)
    return _libraries[path]


def stretches(data: np.ndarray, at: np.ndarray, added: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place, bytes, where pieces start) of stretches that end at a cut: whole texts, or parts of one long text."""
    edge = max([64, *map(len, added)])
    for lo, hi in chunks(at, CHUNK):
        begin, end, step = int(at[lo]), int(at[hi]), CHUNK if hi - lo == 1 else int(at[hi] - at[lo])
        while begin < end:
            stop = min(begin + step, end)
            part = data[begin:stop]
            cut = _cuts(part, added)
            ends = at[lo + 1 : hi] - begin
            cut[ends[(ends >= 0) & (ends < len(part))]] = True
            cut[0] = True
            start = np.flatnonzero(cut)
            if stop < end:
                # the last piece may go on, and an added token may begin in it
                last = start[start <= len(part) - edge]
                if len(last) < 2:
                    step *= 2
                    continue
                stop = begin + int(last[-1])
                part, start = part[: last[-1]], last[:-1]
            yield begin, part, start
            begin, step = stop, CHUNK


def _cuts(part: np.ndarray, added: list[bytes]) -> np.ndarray:
    """Cuts of a stretch; an added token is a piece of its own."""
    cut = pieces(part)
    raw = part.tobytes() if added else b""
    for token in added:
        k = raw.find(token)
        while k >= 0:
            cut[k : k + len(token)] = False
            cut[k] = True
            if k + len(token) < len(cut):
                cut[k + len(token)] = True
            k = raw.find(token, k + len(token))
    return cut


class Summary:
    """Counts of frequent short pieces (Misra and Gries): each is at most the true count, and short of it by at most the sum over FREQUENT."""

    def __init__(self):
        self.hash, self.n, self.size = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.uint8)
        self.key = [np.empty(0, np.uint64) for _ in range(3)]

    def add(self, h: np.ndarray, n: np.ndarray, size: np.ndarray, key: list[np.ndarray]) -> None:
        h, n, size = np.append(self.hash, h), np.append(self.n, n), np.append(self.size, size)
        key = [np.append(a, b) for a, b in zip(self.key, key, strict=True)]
        self.hash, first, group = np.unique(h, return_index=True, return_inverse=True)
        self.n = np.bincount(group, n, len(first)).astype(np.int64)
        self.size, self.key = size[first], [k[first] for k in key]
        if len(first) > FREQUENT:
            self.n = self.n - np.partition(self.n, len(first) - FREQUENT - 1)[len(first) - FREQUENT - 1]
            some = self.n > 0
            self.hash, self.n, self.size, self.key = self.hash[some], self.n[some], self.size[some], [k[some] for k in self.key]

    def pack(self) -> bytes:
        return b"".join(x.tobytes() for x in (self.hash, self.n, *self.key, self.size))

    def merge(self, packed: bytes) -> None:
        k = len(packed) // 41
        words = np.frombuffer(packed, "<u8", 5 * k).reshape(5, k)
        self.add(words[0], words[1].astype(np.int64), np.frombuffer(packed, np.uint8, k, 40 * k), list(words[2:]))


def frequent(docs: DataFrame, tokenizer: str) -> bytes:
    """The packed summary of all texts' pieces."""

    @lean
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = library(tokenizer), Summary()
        for batch in batches:
            data, at = utf8(batch.column("text"))
            for _, part, start in stretches(data, at, known.added):
                p = Pieces(part, start)
                h, first, n = np.unique(p.hash[p.short], return_index=True, return_counts=True)
                first = np.flatnonzero(p.short)[first]
                total.add(h, n, p.length[first].astype(np.uint8), [k[first] for k in p.key])
        yield pa.RecordBatch.from_arrays([pa.array([total.pack()], pa.binary())], ["packed"])

    @lean
    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Summary()
        for batch in batches:
            for packed in batch.column("packed"):
                total.merge(packed.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([total.pack()], pa.binary())], ["packed"])

    spark = docs.sparkSession
    some = docs.select("text").mapInArrow(summed, "packed binary")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    while True:  # no task merges all summaries of a large table
        some = some.where(F.length("packed") > 0).repartition(n).mapInArrow(merged, "packed binary")
        if n == 1:
            break
        n = -(-n // FAN)
    rows = some.collect()
    return bytes(rows[0].packed) if rows else b""


def count(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """A row a document: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens), by the tokenizer of a file."""
    spark = docs.sparkSession
    Stages(spark, "counts")  # sends the package's source and bounds batches
    if not library(tokenizer).cuts:
        return _whole(docs, tokenizer, limit)
    table = Lengths(FREQUENT)
    packed = Summary()
    packed.merge(frequent(docs, tokenizer))
    if len(packed.hash):
        raw = np.stack(packed.key, 1).astype("<u8").tobytes()
        texts = [raw[LONGEST * i : LONGEST * i + n] for i, n in enumerate(packed.size.tolist())]
        table.put(packed.key, packed.size, packed.hash, library(tokenizer).lengths(texts))
    shared = spark.sparkContext.broadcast(table)

    @lean
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = library(tokenizer)
        own = _own.setdefault(tokenizer, Lengths(OWN))
        for batch in batches:
            data, at = utf8(batch.column("text"))
            n = np.zeros(len(at) - 1, np.int64)
            for place, part, start in stretches(data, at, known.added):
                doc = np.searchsorted(at, start + place, "right") - 1
                np.add.at(n, doc, lengths(Pieces(part, start), shared.value, own, known))
            yield _rows(batch.column("doc_id"), np.diff(at), n, limit)

    return docs.select("doc_id", "text").mapInArrow(counted, SCHEMA)


SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def lengths(p: Pieces, table: Lengths, own: Lengths, known: Library) -> np.ndarray:
    """The number of tokens of each piece."""
    n, found = table.find(p.key, p.length.clip(0, 255), p.hash)
    found &= p.short
    miss = np.flatnonzero(~found & p.short)
    key, size, h = [k[miss] for k in p.key], p.length[miss], p.hash[miss]
    m, found = own.find(key, size, h)
    n[miss[found]] = m[found]
    rest = np.flatnonzero(~found)
    if len(rest):
        # one of each, by all bytes
        order = rest[np.lexsort((size[rest], key[2][rest], key[1][rest], key[0][rest]))]
        new = np.ones(len(order), bool)
        new[1:] = size[order[1:]] != size[order[:-1]]
        for k in key:
            new[1:] |= k[order[1:]] != k[order[:-1]]
        one = order[new]
        m = known.lengths([p.raw(i) for i in miss[one].tolist()])
        n[miss[order]] = m[np.cumsum(new) - 1]
        if own.held < own.most:
            own.put([k[one] for k in key], size[one], h[one], m)
    texts: dict[bytes, list[int]] = {}
    for i in np.flatnonzero(~p.short).tolist():
        texts.setdefault(p.raw(i), []).append(i)
    if texts:
        for m, some in zip(known.lengths(list(texts)).tolist(), texts.values(), strict=True):
            n[some] = m
    return n


def _rows(doc_id: pa.Array, n_bytes: np.ndarray, n: np.ndarray, limit: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([doc_id.cast(pa.int64()), pa.array(n_bytes), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])


def _whole(docs: DataFrame, tokenizer: str, limit: int) -> DataFrame:
    """Whole texts by the library, some at a time."""

    @lean
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = library(tokenizer)
        for batch in batches:
            data, at = utf8(batch.column("text"))
            n = []
            for lo, hi in chunks(at, CHUNK):
                n += known.whole([data[a:b].tobytes().decode() for a, b in zip(at[lo:hi], at[lo + 1 : hi + 1], strict=True)])
            yield _rows(batch.column("doc_id"), np.diff(at), np.array(n, np.int64), limit)

    return docs.select("doc_id", "text").mapInArrow(counted, SCHEMA)
