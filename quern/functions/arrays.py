"""Sequence search, masking, schedules and nested results as columns."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _places(a: Column, part: Column) -> Column:
    n = F.size(a) - F.size(part) + 1
    every = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.filter(every, lambda i: F.slice(a, i, F.size(part)) == part)


def rfind(a: Column, part: Column) -> Column:
    """Zero-based place of the last occurrence of a sub-sequence, -1 if none."""
    return F.coalesce(F.array_max(_places(a, part)) - 1, F.lit(-1))


def find(a: Column, part: Column) -> Column:
    return F.coalesce(F.array_min(_places(a, part)) - 1, F.lit(-1))


def masked(a: Column, marker: Column, pad: int, ignore: int = -100) -> Column:
    """Values up to the end of the last marker, and padding, become ``ignore``."""
    end = F.when(rfind(a, marker) >= 0, rfind(a, marker) + F.size(marker)).otherwise(0)
    return F.transform(a, lambda x, i: F.when((i < end) | (x == pad), F.lit(ignore).cast("long")).otherwise(x))


def schedule(n: Column, batch: int, accumulate: int, epochs: int, warm: float) -> list[Column]:
    per = F.ceil(F.ceil(n / F.lit(float(batch))) / F.lit(float(accumulate)))
    return [
        per.cast("long").alias("per_epoch"),
        (per * epochs).cast("long").alias("total"),
        F.greatest(F.lit(1), F.floor(per * epochs * warm)).cast("long").alias("warmup"),
    ]


def recognised(node) -> str | None:
    """The text of a parsed recognition result.

    An object says it itself. In nested lists it is the string that heads the second member or the last; failing that, it is looked for in the first.
    """
    if isinstance(node, dict):
        return next((node[k] for k in ("rec_text", "text") if isinstance(node.get(k), str)), None)
    while isinstance(node, list) and node:
        heads = [part[0] for part in (node[1], node[-1]) if isinstance(part, list) and part] if len(node) > 1 else []
        said = [h for h in heads if isinstance(h, str)]
        if said:
            return said[0]
        if len(node) > 1 and not isinstance(node[0], list):
            return None
        node = node[0]
    return None


@F.pandas_udf(StringType())
def ocr_text(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The text of recognition results as JSON of any depth; what holds none, or is no JSON, gives an empty text."""
    for rows in parts:
        yield pd.Series([_text(x) for x in rows], dtype=object)


def _text(raw: str | None) -> str:
    try:
        return recognised(json.loads(raw or "null")) or ""
    except (ValueError, RecursionError):
        return ""
