"""Edit distances, error rates and repetitions."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from .text import words as split_words

# Runs of these marks may be seven long, whatever the limit of other tokens.
LOOSE, LOOSE_MOST = ("-", "~", "–", "—", "*", "."), 7


def distance(a: Sequence[Hashable], b: Sequence[Hashable]) -> int:
    """Edit distance of two sequences, of characters or words.

    The differences along a column of the table are two integers of as many bits as the longer sequence has members, so a step costs a few
    operations on whole columns and memory is linear.
    """
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    where: dict[Hashable, list[int]] = {}
    for i, x in enumerate(a):
        where.setdefault(x, []).append(i)
    equal = {x: _bits(where[x], len(a)) for x in set(b) if x in where}
    full, top = (1 << len(a)) - 1, len(a) - 1
    up, down, total = full, 0, len(a)  # where the column rises and falls
    for y in b:
        same = equal.get(y, 0)
        across = (((same & up) + up) ^ up) | same
        rises, falls = down | (full & ~(across | up)), up & across
        total += (rises >> top & 1) - (falls >> top & 1)
        rises, falls = (rises << 1 | 1) & full, falls << 1 & full
        up, down = falls | (full & ~(same | down | rises)), rises & (same | down)
    return total


def _bits(places: list[int], n: int) -> int:
    out = bytearray(n // 8 + 1)
    for i in places:
        out[i >> 3] |= 1 << (i & 7)
    return int.from_bytes(out, "little")


def _measured(parts: Iterator[tuple[pd.Series, pd.Series]], cut: Callable[[str], Sequence]) -> Iterator[pd.Series]:
    for a, b in parts:
        yield pd.Series([distance(cut(x or ""), cut(y or "")) for x, y in zip(a, b, strict=True)], dtype="int64")


@F.pandas_udf(LongType())
def char_distance(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    yield from _measured(parts, str)


@F.pandas_udf(LongType())
def word_distance(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    yield from _measured(parts, str.split)


def cut_repetitions(text: str | None, most: int = 5) -> str | None:
    """The text up to the first excessive run of a token, else of a phrase of two or three."""
    if not text or len(text) < 10:
        return text
    tokens = text.split()
    n = len(tokens)
    if n < most:
        return text
    for size in (1, 2, 3):
        # run[i]: how often the phrase at i is repeated back to back
        run = [1] * (n + 1)
        for i in range(n - 2 * size, -1, -1):
            if tokens[i : i + size] == tokens[i + size : i + 2 * size]:
                run[i] = run[i + size] + 1
        for i in range(n - size * most):
            if run[i] > (LOOSE_MOST if size == 1 and tokens[i] in LOOSE else most):
                return " ".join(tokens[:i])
    return text


@F.pandas_udf(StringType())
def without_repetitions(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in parts:
        yield texts.map(cut_repetitions, na_action="ignore")


def micro(edits: Column, length: Column) -> Column:
    """Summed edits over summed reference lengths, at least 1."""
    return F.sum(edits) / F.greatest(F.sum(length), F.lit(1))


def weighted(edits: Column, length: Column, factor: float) -> Column:
    """Error rates, cut at 1, averaged with weights of the reference's length to the power ``factor``; empty references have none."""
    some = length > 0
    weight = F.when(some, F.pow(length.cast("double"), F.lit(factor)))
    return F.sum(weight * F.least(F.lit(1.0), edits / length.cast("double"))) / F.sum(weight)


def evaluated(
    refs: DataFrame,
    preds: DataFrame,
    keys: list[str],
    name: str,
    factor: float = 0.5,
    cer_weight: float = 0.7,
    wer_weight: float = 0.3,
) -> DataFrame:
    """A row a set of references: samples (references with a prediction), total, cer, wer, final; all rates are 1 where nothing matched."""
    both = refs.join(preds.withColumn("matched", F.lit(True)), keys, "left")
    words = F.size(split_words(F.col("ref")))
    each = both.select(
        name,
        "matched",
        *[
            F.when(F.col("matched"), x).alias(n) for n, x in (
                ("ce", char_distance("ref", "pred")),
                ("cn", F.length("ref")),
                ("we", word_distance("ref", "pred")),
                ("wn", words),
            )
        ],
    )
    per = each.groupBy(name).agg(
        F.count("matched").alias("samples"),
        F.count(F.lit(1)).alias("total"),
        weighted(F.col("ce"), F.col("cn"), factor).alias("cer"),
        weighted(F.col("we"), F.col("wn"), factor).alias("wer"),
    )
    rate = lambda c: F.when(F.col("samples") == 0, 1.0).otherwise(F.col(c)).alias(c)
    per = per.select(name, "samples", "total", rate("cer"), rate("wer"))
    return per.withColumn("final", cer_weight * F.col("cer") + wer_weight * F.col("wer"))
