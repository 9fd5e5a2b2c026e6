"""Row-wise reductions of an ordered array of predictions.

Votes by place and the least risk walk the characters of all predictions together, which columns can only do by cutting every text anew for each
place; they are Pandas UDFs that take Arrow batches. The others are columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import zip_longest

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .edit import distance


def _first_by(values: Column, order) -> Column:
    """The value whose (order..., place) is least."""
    keyed = F.transform(values, lambda x, i: F.struct(*order(x), i.alias("at"), x.alias("value")))
    return F.array_min(keyed)["value"]


def times(values: Column, x: Column) -> Column:
    return F.size(F.filter(values, lambda y: y == x))


def majority(p: Column) -> Column:
    """Most frequent value, the first seen on ties."""
    return _first_by(p, lambda x: [(-times(p, x)).alias("n")])


def longest(p: Column) -> Column:
    return _first_by(p, lambda x: [(-F.length(x)).alias("n")])


def shortest(p: Column) -> Column:
    return _first_by(p, lambda x: [F.length(x).alias("n")])


def first(p: Column) -> Column:
    return p[0]


def modal(values) -> str:
    """The most frequent of some values, the first seen on ties; none gives nothing."""
    counts: dict[str, int] = {}
    for v in values:
        counts[v] = counts.get(v, 0) + 1
    return max(counts, key=counts.__getitem__) if counts else ""


def vote(texts: list[str]) -> str:
    """Modal character of each place after padding with spaces, right-stripped."""
    if len(texts) == 1:
        return texts[0]
    return "".join(x[0] if x.count(x[0]) == len(x) else modal(x) for x in zip_longest(*texts, fillvalue=" ")).rstrip()


def align(texts: list[str]) -> str:
    """Modal character of each place among non-empty predictions; hyphens count as gaps, as do missing places."""
    if len(texts) == 1:
        return texts[0]
    some = [t for t in texts if t]
    return "".join(modal(c for c in x if c and c != "-") for x in zip_longest(*some, fillvalue=""))


def least_risk(texts: list[str]) -> str:
    """The non-empty prediction of least mean edit distance to those with another value; the first on ties."""
    if len(texts) == 1:
        return texts[0]
    counts: dict[str, int] = {}
    for t in texts:
        if t:
            counts[t] = counts.get(t, 0) + 1
    if not counts:
        return ""
    values, total = list(counts), sum(counts.values())
    risk = [0] * len(values)
    for i, x in enumerate(values):
        for j in range(i):
            d = distance(x, values[j])
            risk[i] += d * counts[values[j]]
            risk[j] += d * counts[x]
    mean = [r / (total - counts[v]) if total > counts[v] else 0.0 for r, v in zip(risk, values, strict=True)]
    return values[mean.index(min(mean))]


def _reduced(parts: Iterator[pd.Series], reduce: Callable[[list[str]], str]) -> Iterator[pd.Series]:
    for rows in parts:
        yield pd.Series([None if r is None or not len(r) else reduce([x or "" for x in r]) for r in rows], dtype=object)


@F.pandas_udf(StringType())
def char_voting(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    yield from _reduced(parts, vote)


@F.pandas_udf(StringType())
def rover(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    yield from _reduced(parts, align)


rover_mbr = rover


@F.pandas_udf(StringType())
def mbr(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    yield from _reduced(parts, least_risk)


STRATEGIES = {
    "char_voting": char_voting,
    "rover": rover,
    "rover_mbr": rover_mbr,
    "mbr": mbr,
    "majority": majority,
    "longest": longest,
    "shortest": shortest,
    "first": first,
}


def ensemble(p: Column, strategy: str = "char_voting") -> Column:
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy: {strategy}")
    return STRATEGIES[strategy](p)


def two_model(a: Column, b: Column, strategy: str = "shortest") -> Column:
    """Equal predictions stand; majority trusts the first model."""
    both = F.array(a, b)
    if strategy == "char_voting":
        return F.when(a == b, a).otherwise(char_voting(both))
    chosen = {"majority": a, "longest": longest(both)}
    return F.when(a == b, a).otherwise(chosen[strategy] if strategy in chosen else shortest(both))
