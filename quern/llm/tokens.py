"""Token ids in files of static range asymmetric numeral system (rANS) blocks.

All documents are tokenized once into a staged table. Their ids are counted over the whole corpus into one shared
frequency table, scaled to 2**SCALE slots with at least one for every id that occurs. Documents are then dealt by ranges of
doc_id and each range writes one file: independent blocks of whole documents, about ``BLOCK_IDS`` ids each. A block codes its ids
in up to ``LANES`` interleaved states of 64 bits that shed 32-bit words, so encoder and decoder step all lanes at once.

File: magic, version, lanes limit, scale, the digest of the frequency table; the blocks; a JSON directory with, for each block, its byte
offset, length, CRC-32, first document and first id in the file (a checkpoint: decoding may start there), and documents' ids
and lengths in order; the directory's length and CRC-32. The table is one file beside them, named by its digest. Files get a name that
is new for every task attempt, and only those that a finished task reports are listed in the manifest.

Files go through pyarrow's file systems, which reach any shared folder that pyarrow has a scheme for.

Defined cases: null and empty texts are the end id alone; null ids come first, equal ids in order of a hash of their token ids; an empty
table writes no file and reads back empty; other columns are ignored. A block with a wrong checksum raises.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import Stages
from .text import chunks, lean, mix, utf8

END = 2
LANES = 1024
SCALE = 20
BLOCK_IDS = 1 << 18
LOW = np.uint64(1 << 31)
MAGIC = b"QRNS"
HEAD, HEAD_BYTES = "<4sIII32s", 48
TAIL, TAIL_BYTES = "<QI", 12


def frequencies(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Counts scaled to sum to 2**scale, at least 1 where a count is not 0."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if not len(used):
        return out
    room = (1 << scale) - len(used)
    if room < 0:
        raise ValueError("more ids than slots")
    exact = counts[used].astype(np.float64) / counts[used].sum() * room
    out[used] = np.floor(exact).astype(np.int64) + 1
    rest = (1 << scale) - int(out.sum())
    out[used[np.argsort(-(exact - np.floor(exact)), kind="stable")[:rest]]] += 1
    return out


class Coder:
    """Encodes and decodes blocks with one frequency table."""

    def __init__(self, freq: np.ndarray, scale: int = SCALE):
        self.scale = np.uint64(scale)
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(freq) - freq).astype(np.uint64)
        self.of_slot = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
        self.mask = np.uint64((1 << scale) - 1)
        self.digest = hashlib.sha256(freq.astype("<u4").tobytes()).digest()

    def encode(self, ids: np.ndarray) -> bytes:
        """n, lanes, words; states at the start of decoding; words in decoding order."""
        lanes = max(1, min(LANES, len(ids)))
        state = np.full(lanes, LOW, np.uint64)
        freq, start = self.freq[ids], self.start[ids]
        limit = freq << np.uint64(63 - int(self.scale))
        shed = []
        for at in range((len(ids) - 1) // lanes * lanes, -1, -lanes):
            f, s, x = freq[at : at + lanes], start[at : at + lanes], state[: min(lanes, len(ids) - at)]
            over = x >= limit[at : at + lanes]
            shed.append(x[over].astype(np.uint32))
            x = np.where(over, x >> np.uint64(32), x)
            q = x // f
            state[: len(x)] = (q << self.scale) + (x - q * f) + s
        words = np.concatenate(shed[::-1]) if shed else np.empty(0, np.uint32)
        return struct.pack("<III", len(ids), lanes, len(words)) + state.astype("<u8").tobytes() + words.astype("<u4").tobytes()

    def decode(self, block: bytes) -> np.ndarray:
        n, lanes, n_words = struct.unpack_from("<III", block)
        state = np.frombuffer(block, "<u8", lanes, 12).copy()
        words = np.frombuffer(block, "<u4", n_words, 12 + 8 * lanes).astype(np.uint64)
        out, used = np.empty(n, np.uint32), 0
        for at in range(0, n, lanes):
            x = state[: min(lanes, n - at)]
            slot = x & self.mask
            ids = self.of_slot[slot]
            out[at : at + lanes] = ids
            x = self.freq[ids] * (x >> self.scale) + slot - self.start[ids]
            under = np.flatnonzero(x < LOW)
            x[under] = (x[under] << np.uint64(32)) | words[used : used + len(under)]
            used += len(under)
            state[: len(x)] = x
        return out


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def write_bytes(uri: str, data: bytes) -> None:
    system, path = _fs(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(path) as out:
        out.write(data)


def read_bytes(uri: str) -> bytes:
    system, path = _fs(uri)
    with system.open_input_file(path) as f:
        return f.read()


_loaded: dict[str, Encoder] = {}


def _classes() -> np.ndarray:
    """Classes of ASCII bytes; what is not listed, and every other byte at first, is ``UNKNOWN``."""
    c = np.full(256, UNKNOWN, np.uint8)
    c[33:127] = PUNCTUATION
    for lo, hi, kind in (("A", "Z", LETTER), ("a", "z", LETTER), ("0", "9", DIGIT), ("'", "'", APOSTROPHE), (" ", " ", SPACE), ("\t", "\r", BLANK)):
        c[ord(lo) : ord(hi) + 1] = kind
    return c


UNKNOWN, LETTER, DIGIT, PUNCTUATION, APOSTROPHE, SOLID, SPACE, BLANK = range(8)
CLASSES = _classes()


def pieces(data: np.ndarray) -> np.ndarray:
    """Whether a text may be cut before each of its bytes without any token reaching across.

    Byte-level tokenizers first split a text into contractions, runs of letters, of digits, of other marks, each with a space before it, and
    white space. A cut is made only where the bytes around it leave no doubt; ``UNKNOWN`` ones may be white space, letters or marks.
    """
    kind = CLASSES[data]
    lead = np.flatnonzero((data >= 0xC3) & ~((data >= 0xE1) & (data <= 0xE3)))  # the others' characters may be white space
    for k in range(4):
        some = lead[(data[lead] >= (0, 0xC3, 0xE0, 0xF0)[k]) & (lead + k < len(data))]
        kind[some + k] = SOLID
    latin = lead[(data[lead] <= 0xC9) & (lead + 1 < len(data))]
    latin = latin[(data[latin] != 0xC3) | ((data[latin + 1] != 0x97) & (data[latin + 1] != 0xB7))]  # but for the signs of times and division
    kind[latin] = kind[latin + 1] = LETTER
    return RULES[np.concatenate([[UNKNOWN, UNKNOWN], kind[:-2]])[: len(kind)], np.concatenate([[UNKNOWN], kind[:-1]])[: len(kind)], kind]


def _rules() -> np.ndarray:
    """Whether to cut between the second and the third of three classes."""
    out = np.zeros((8, 8, 8), bool)
    full = (LETTER, DIGIT, PUNCTUATION, APOSTROPHE, SOLID)
    for before in range(8):
        for p in range(8):
            for c in range(8):
                white = p in full and c in (SPACE, BLANK)
                after = p == BLANK and before in full and c in full
                other = {p, c} <= {LETTER, DIGIT, PUNCTUATION, APOSTROPHE} and p != c and p != APOSTROPHE and (p, c) != (PUNCTUATION, APOSTROPHE)
                out[before, p, c] = white or after or other
    return out


RULES = _rules()


class Encoder:
    """A byte-level tokenizer that remembers what the library made of the pieces of texts.

    Pieces of up to 24 bytes are looked up by their bytes, as three 64-bit words and a length, in an open-addressed table of a fixed
    size; the first ``MOST`` that come, which are the commonest, are kept. The others go to the library, many at once and once a chunk.
    Tokenizers of another kind encode whole texts by the library.
    """

    SLOT_BITS, MOST, PROBES = 20, 600_000, 8
    CHUNK = 1 << 20
    GROUP = 64

    def __init__(self, path: str, end: int = END):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab()
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.width[list(vocabulary.values())] = list(map(len, vocabulary))  # one character a byte
        self.kind = "<u2" if len(self.width) <= 1 << 16 else "<u4"
        self.added = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        stage = json.loads(self.library.to_str())
        split = stage.get("pre_tokenizer") or {}
        self.cuts = stage.get("normalizer") is None and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
        self.pool, self.used, self.kept, self.held = np.full(1 << 16, end, self.kind), 1, 1, 0
        if self.cuts:
            slots = 1 << self.SLOT_BITS
            self.words = [np.zeros(slots, np.uint64) for _ in range(3)]
            self.bytes, self.at, self.count = np.zeros(slots, np.uint8), np.zeros(slots, np.int32), np.zeros(slots, np.uint16)

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a chunk's texts one after another, each with the end id, and how many each has."""
        size = int(at[-1] - at[0])
        if not self.cuts:
            texts = [data[a:b].tobytes().decode() for a, b in zip(at[:-1], at[1:], strict=True)]
            ids = [np.append(np.array(e.ids, self.kind), self.pool[0]) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
            return np.concatenate([np.empty(0, self.kind), *ids]), np.array([len(x) for x in ids], np.int64)
        if len(at) == 2 and size > 2 * self.CHUNK:
            return self._long(data[at[0] : at[1]])
        return self._chunk(data[at[0] : at[-1]], at - at[0])

    def _long(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One long text by stretches that end at a cut."""
        ids, lo, step = [], 0, self.CHUNK
        whole = any(t in data.tobytes() for t in self.added)
        while lo < len(data):
            hi = len(data) if whole else min(lo + step, len(data))
            if hi < len(data):
                cut = np.flatnonzero(pieces(data[lo:hi]))
                if not len(cut):
                    step *= 2
                    continue
                hi = lo + int(cut[-1])
            ids.append(self._chunk(data[lo:hi], np.array([0, hi - lo]))[0][:-1])
            lo, step = hi, self.CHUNK
        ids.append(self.pool[:1])
        return np.concatenate(ids), np.array([sum(map(len, ids))])

    def _chunk(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size, n = len(data), len(at) - 1
        cut = pieces(data) if size else np.zeros(0, bool)
        for token in self.added:  # a text that spells an added token is one piece
            raw, k = data.tobytes(), -1
            while (k := raw.find(token, k + 1)) >= 0:
                d = int(np.searchsorted(at, k, "right")) - 1
                cut[at[d] : at[d + 1]] = False
        cut[at[:-1][at[:-1] < size]] = True
        start = np.flatnonzero(cut)
        length = np.diff(np.append(start, size))
        padded = np.zeros(size + 32, np.uint8)
        padded[:size] = data
        place, count = self._known(padded, start, length)
        doc = np.searchsorted(at, start, "right") - 1
        slot = np.arange(len(start)) + doc
        places, counts = np.zeros(len(start) + n, np.int64), np.ones(len(start) + n, np.int64)
        places[slot], counts[slot] = place, count
        ends = np.cumsum(counts)
        ids = self.pool[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(places - (ends - counts), counts)]
        self.used = self.kept
        last = ends[np.cumsum(np.bincount(doc, minlength=n)) + np.arange(n)]
        return ids, np.diff(last, prepend=0)

    def _known(self, padded: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in ``pool`` the ids of each piece are, and how many; new pieces are learnt."""
        view = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))  # the eight bytes from each place on
        key = [view[np.minimum(start + 8 * k, len(view) - 1)] & MASK[np.clip(length - 8 * k, 0, 8)] for k in range(3)]
        size = np.minimum(length, 255).astype(np.uint8)
        h = mix(key[0] ^ mix(key[1] + mix(key[2] + length.astype(np.uint64))))
        short = length <= 24
        place, count = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        todo = np.flatnonzero(short)
        slot = (h[todo] >> np.uint64(64 - self.SLOT_BITS)).astype(np.int64)
        missed = []
        for _ in range(self.PROBES):
            hit = (self.bytes[slot] == size[todo]) & (self.words[0][slot] == key[0][todo]) & (self.words[1][slot] == key[1][todo]) & (self.words[2][slot] == key[2][todo])
            place[todo[hit]], count[todo[hit]] = self.at[slot[hit]], self.count[slot[hit]]
            empty = self.bytes[slot] == 0
            missed.append(todo[empty])
            todo, slot = todo[~hit & ~empty], (slot[~hit & ~empty] + 1) & ((1 << self.SLOT_BITS) - 1)
            if not len(todo):
                break
        todo = np.concatenate([*missed, todo])
        # one of each: by hash, and by all bytes among equal hashes
        todo = todo[np.argsort(h[todo], kind="stable")]
        new = np.ones(len(todo), bool)
        new[1:] = h[todo[1:]] != h[todo[:-1]]
        lead = todo[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(todo) else todo
        same = (size[todo] == size[lead]) & (key[0][todo] == key[0][lead]) & (key[1][todo] == key[1][lead]) & (key[2][todo] == key[2][lead])
        first = todo[new]
        alone = np.concatenate([todo[~same], np.flatnonzero(~short)])
        texts = {}
        for i in alone.tolist():
            texts.setdefault(padded[start[i] : start[i] + length[i]].tobytes(), []).append(i)
        p, c = self._learn([padded[a : a + n].tobytes() for a, n in zip(start[first].tolist(), length[first].tolist(), strict=True)])
        of = np.cumsum(new) - 1
        place[todo[same]], count[todo[same]] = p[of[same]], c[of[same]]
        if self.held < self.MOST:
            self._hold(first, h, key, size, p, c)
            self.kept = self.used
        p, c = self._learn(list(texts))
        for k, some in enumerate(texts.values()):
            place[some], count[some] = p[k], c[k]
        return place, count

    def _hold(self, first: np.ndarray, h: np.ndarray, key: list[np.ndarray], size: np.ndarray, place: np.ndarray, count: np.ndarray) -> None:
        """Puts pieces into the table, each in the first free slot from its own."""
        todo = np.flatnonzero(count < 1 << 16)
        self.held += len(todo)
        slot = (h[first[todo]] >> np.uint64(64 - self.SLOT_BITS)).astype(np.int64)
        for _ in range(self.PROBES):
            free = np.flatnonzero(self.bytes[slot] == 0)
            _, one = np.unique(slot[free], return_index=True)
            mine = free[one]
            at, k = slot[mine], todo[mine]
            for w, x in zip(self.words, key, strict=True):
                w[at] = x[first[k]]
            self.bytes[at], self.at[at], self.count[at] = size[first[k]], place[k], count[k]
            left = np.ones(len(todo), bool)
            left[mine] = False
            todo, slot = todo[left], (slot[left] + 1) & ((1 << self.SLOT_BITS) - 1)
            if not len(todo):
                break

    def _learn(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Encodes pieces into ``pool``: those of one word many at once, told apart by the bytes of their ids, and others one by one."""
        place, count = np.zeros(len(raw), np.int64), np.zeros(len(raw), np.int64)
        texts = [x.decode() for x in raw]
        plain = [i for i, t in enumerate(texts) if PLAIN.fullmatch(t)]
        if plain:
            groups = ["".join(texts[i] + "\n" for i in plain[k : k + self.GROUP]) for k in range(0, len(plain), self.GROUP)]
            ids = np.concatenate([np.array(e.ids, self.kind) for e in self.library.encode_batch_fast(groups, add_special_tokens=False)])
            ends = np.concatenate([[0], np.cumsum(self.width[ids])])
            stop = np.cumsum([len(raw[i]) + 1 for i in plain]) - 1
            lo = np.searchsorted(ends, np.concatenate([[0], stop[:-1] + 1]))
            hi = np.searchsorted(ends, stop)
            exact = (ends[np.minimum(hi, len(ends) - 1)] == stop) & (ends[lo] == np.concatenate([[0], stop[:-1] + 1]))
            if not exact.all():
                raise ValueError("a token reaches across a line end")
            at = self._put(ids)
            place[plain], count[plain] = at + lo, hi - lo
        rest = sorted(set(range(len(raw))) - set(plain)) if len(plain) < len(raw) else []
        for i, e in zip(rest, self.library.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
            place[i], count[i] = self._put(np.array(e.ids, self.kind)), len(e.ids)
        return place, count

    def _put(self, ids: np.ndarray) -> int:
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        at, self.used = self.used, self.used + len(ids)
        self.pool[at : self.used] = ids
        return at


MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: A piece with white space at its head only, one space, and no character that tokenizers may take for white space.
PLAIN = re.compile(r" ?[^\s\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff]+")


def encoder(path: str, end: int = END) -> Encoder:
    if (path, end) not in _loaded:
        _loaded.clear()
        _loaded[path, end] = Encoder(path, end)
    return _loaded[path, end]


def tokenize(docs: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    """doc_id, n, ids (little-endian unsigned integers of the tokenizer's ``kind``) for every row."""

    @lean
    def tokenized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(tokenizer, end)
        for batch in batches:
            data, at = utf8(batch.column("text"))
            for lo, hi in chunks(at, known.CHUNK):
                ids, n = known.encode(data, at[lo : hi + 1])
                ends = np.concatenate([[0], np.cumsum(n)]) * ids.itemsize
                rows = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64())[lo:hi], pa.array(n), rows], ["doc_id", "n", "ids"])

    return docs.select("doc_id", "text").mapInArrow(tokenized, "doc_id long, n long, ids binary")


def id_counts(tokens: DataFrame, kind: str) -> np.ndarray:
    """How often each id occurs in all documents; its length is the vocabulary's."""

    @lean
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            column = batch.column("ids")
            if not len(column):
                continue
            _, ends, data = column.buffers()
            ends = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1]
            found = np.bincount(np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(kind))
            if len(found) > len(total):
                found[: len(total)] += total
                total = found
            else:
                total[: len(found)] += found
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["id", "n"])

    rows = tokens.select("ids").mapInArrow(counted, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(int(rows["id"].to_numpy().max(initial=-1)) + 1, np.int64)
    counts[rows["id"].to_numpy()] = rows["n"].to_numpy()
    return counts


def write(tokens: DataFrame, folder: str, partitions: int, kind: str, scale: int = SCALE) -> DataFrame:
    """Writes the files; the manifest: path, first and last doc_id, n_docs, n_ids, bytes."""
    freq = frequencies(id_counts(tokens, kind), scale)
    coder = Coder(freq, scale)
    write_bytes(f"{folder}/{coder.digest.hex()}.table", freq.astype("<u4").tobytes())
    shared = tokens.sparkSession.sparkContext.broadcast(freq)

    @lean
    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value, scale)
        path = f"{folder}/{uuid.uuid4().hex}.rans"
        blocks, docs, ids, held, offset, n_ids, first, last = [], [], [], 0, HEAD_BYTES, 0, None, None
        stream = None

        def flush():
            nonlocal held, offset, n_ids, stream
            if stream is None:
                system, at = _fs(path)
                system.create_dir(at.rsplit("/", 1)[0], recursive=True)
                stream = system.open_output_stream(at)
                stream.write(struct.pack(HEAD, MAGIC, 1, LANES, scale, coder.digest))
            data = coder.encode(np.concatenate(ids))
            stream.write(data)
            blocks.append({"offset": offset, "bytes": len(data), "crc32": zlib.crc32(data), "first_id": n_ids, "docs": list(docs)})
            offset, n_ids, held = offset + len(data), n_ids + held, 0
            ids.clear()
            docs.clear()

        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            first, last = (names[0] if first is None and names else first), (names[-1] if names else last)
            for name, x in zip(names, batch.column("ids"), strict=True):
                ids.append(np.frombuffer(x.as_buffer(), kind))
                docs.append((name, len(ids[-1])))
                held += len(ids[-1])
                if held >= BLOCK_IDS:
                    flush()
        if held:
            flush()
        if stream is not None:
            directory = json.dumps(blocks).encode()
            stream.write(directory + struct.pack(TAIL, len(directory), zlib.crc32(directory)))
            stream.close()
            rows = {
                "path": [path],
                "first": [first],
                "last": [last],
                "n_docs": [sum(len(b["docs"]) for b in blocks)],
                "n_ids": [n_ids],
                "bytes": [offset + len(directory) + TAIL_BYTES],
            }
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.string() if k == "path" else pa.int64()) for k, v in rows.items()], list(rows))

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("ids")]  # ranges are sampled in the driver: of numbers, not of ids
    dealt = tokens.repartitionByRange(partitions, *order).sortWithinPartitions(*order, "ids")
    return dealt.select("doc_id", "ids").mapInArrow(written, "path string, first long, last long, n_docs long, n_ids long, bytes long")


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files, block by block."""
    # files hold ranges in order; only files that one id fills may share their ends
    low = -(1 << 63)
    files = sorted(
        manifest.select("path", "first", "last", "n_ids").toArrow().to_pylist(),
        key=lambda f: (low if f["first"] is None else f["first"], low if f["last"] is None else f["last"], f["n_ids"]),
    )
    start, units = 0, []
    for f in files:
        units.append((f["path"], start))
        start += f["n_ids"]
    spark = manifest.sparkSession

    @lean
    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                system, at = _fs(path)
                with system.open_input_file(at) as f:
                    magic, version, _, scale, digest = struct.unpack(HEAD, f.read(HEAD_BYTES))
                    if magic != MAGIC or version != 1:
                        raise ValueError(f"not a token file: {path}")
                    f.seek(f.size() - TAIL_BYTES)
                    size, check = struct.unpack(TAIL, f.read(TAIL_BYTES))
                    f.seek(f.size() - TAIL_BYTES - size)
                    directory = f.read(size)
                    if zlib.crc32(directory) != check:
                        raise ValueError(f"wrong checksum of the directory: {path}")
                    if coder is None or coder.digest != digest:
                        coder = Coder(np.frombuffer(read_bytes(f"{folder}/{digest.hex()}.table"), "<u4").astype(np.int64), scale)
                    for block in json.loads(directory):
                        f.seek(block["offset"])
                        data = f.read(block["bytes"])
                        if zlib.crc32(data) != block["crc32"]:
                            raise ValueError(f"wrong checksum of a block: {path}")
                        ids = coder.decode(data).astype("<u4")
                        names, counts = [d[0] for d in block["docs"]], np.array([d[1] for d in block["docs"]], np.int64)
                        ends = np.cumsum(counts)
                        raw = memoryview(ids.tobytes())
                        sums = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(names, pa.int64()),
                                pa.array(start + block["first_id"] + ends - counts),
                                pa.array(counts),
                                pa.array(sums, pa.int64()),
                            ],
                            ["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

    if not units:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    listed = spark.createDataFrame(units, "path string, start long").repartition(len(units))
    return listed.mapInArrow(decoded, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encoded(docs: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    """Tokenizes, writes and reads back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    stages = Stages(spark, "tokens")
    tokens = stages.put(tokenize(docs, tokenizer, end), "ids")
    folder = stages.folder("files")
    manifest = stages.put(write(tokens, folder, _partitions(tokens), encoder(tokenizer, end).kind), "manifest")
    stages.drop(tokens)
    return read(manifest, folder)


def _partitions(tokens: DataFrame, ids: int = 32_000_000) -> int:
    """Files of about so many ids, as many as the session shuffles at least."""
    total = tokens.agg(F.sum("n")).first()[0] or 0
    return max(int(total // ids) + 1, int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions")))
