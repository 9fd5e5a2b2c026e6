"""Helper columns that meet no column of the user's, and joins that keep null keys."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unused(df: DataFrame, *wanted: str) -> list[str]:
    """Names like those wanted that no column of ``df`` has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def join_same(df: DataFrame, other: DataFrame, keys: Iterable[str], how: str = "inner") -> DataFrame:
    """``df`` with the other columns of ``other`` where all keys are equal, null keys among each other too; without keys ``other`` is one row."""
    keys = list(keys)
    if not keys:
        return df.crossJoin(F.broadcast(other))
    own = unused(df, *keys)
    renamed = other.select(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)], *[c for c in other.columns if c not in keys])
    return df.join(renamed, [df[k].eqNullSafe(renamed[o]) for k, o in zip(keys, own, strict=True)], how).drop(*own)
