"""Fill-in-middle transformation by a constant-memory two-pass streaming matcher.

A text is cut into units, the matches of a pattern from left to right. The first pass only counts them; two seeded draws of a rank from 0 to
that count then give the units that the prefix and the middle end after. The second pass advances a lazy match iterator to the lower rank and on to
the higher one, and keeps two offsets: no list of units or offsets is ever stored, whatever the length of a text.

The parts are put together between sentinels, prefix-suffix-middle (``psm``) or suffix-prefix-middle (``spm``). Texts that hold a sentinel stay as they
are (``plain``), so that ``restored`` can take every other output apart again: sentinels have no border with each other or themselves, hence none
can arise where a part meets one.

Defined cases: null and empty texts are plain, with no units and an empty output; a null id draws as an empty one; repeated rows and ids draw alike, row by
row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .text import lean

LINES = r"[^\n]*\n|[^\n]+"
SEED = 7
#: Percentages of texts that are rearranged at all, and of those that put the suffix first.
RATE, SUFFIX_FIRST = 100, 50
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Characters of output that a batch holds before it is handed on.
HELD = 4 << 20

SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


class Rules(NamedTuple):
    """How texts are cut and rearranged."""

    units: str = LINES
    seed: int = SEED
    rate: int = RATE
    suffix_first: int = SUFFIX_FIRST


def draws(seed: int, doc_id: int | None) -> list[int]:
    """Four 32-bit numbers of a document: the first groups of eight digits of a digest of seed and id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


def counted(pattern: re.Pattern, text: str) -> int:
    """First pass: how many units a text has."""
    return sum(1 for _ in pattern.finditer(text))


def ends(pattern: re.Pattern, text: str, low: int, high: int) -> tuple[int, int]:
    """Second pass: where the unit of rank ``low`` and that of rank ``high`` (from 1, not below it) end; 0 for rank 0."""
    units, at = pattern.finditer(text), 0
    found = []
    for step in (low, high - low):
        if step:
            at = next(islice(units, step - 1, None)).end()
        found.append(at)
    return found[0], found[1]


def rearranged(text: str, doc_id: int | None, pattern: re.Pattern, rules: Rules) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, code points of prefix and middle, output."""
    n = counted(pattern, text)
    h = draws(rules.seed, doc_id)
    if not text or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= rules.rate:
        return n, PLAIN, None, None, text
    a, b = ends(pattern, text, *sorted((h[0] % (n + 1), h[1] % (n + 1))))
    if h[3] % 100 < rules.suffix_first:
        return n, SPM, a, b - a, "".join((SUFFIX, text[b:], PREFIX, text[:a], MIDDLE, text[a:b]))
    return n, PSM, a, b - a, "".join((PREFIX, text[:a], SUFFIX, text[b:], MIDDLE, text[a:b]))


def restored(output: str, form: str) -> str:
    """The text that an output of that form was made from."""
    if form == PLAIN:
        return output
    one, two = (PREFIX, SUFFIX) if form == PSM else (SUFFIX, PREFIX)
    if not output.startswith(one):
        raise ValueError(f"no {one} at the head of a text of form {form}")
    cut = output.index(two, len(one))
    last = output.index(MIDDLE, cut + len(two))
    head, tail, middle = output[len(one) : cut], output[cut + len(two) : last], output[last + len(MIDDLE) :]
    return head + middle + tail if form == PSM else tail + middle + head


def transform(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """A row a document: doc_id, n, form, prefix_chars, middle_chars (null where plain), output."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, rows, held = re.compile(rules.units), [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                rows.append((doc_id, *rearranged(text.as_py() or "", doc_id, pattern, rules)))
                held += len(rows[-1][-1])
                if held > HELD:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [f.split()[0] for f in SCHEMA.split(", ")])


def restore(outputs: DataFrame) -> DataFrame:
    """``outputs`` (with ``output`` and ``form``) and the text that each was made from, as ``restored``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [restored(o.as_py() or "", f) for o, f in zip(batch.column("output"), batch.column("form").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "restored"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in outputs.schema)
    return outputs.mapInArrow(lean(run), f"{schema}, restored string")
