"""Splits and folds, ordered by a hash of the id so that they repeat everywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .names import join_same, unused
from .ranks import ranked


def drawn(id_: str, seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.col(id_).cast("string"), F.lit(str(seed))).cast("binary"))


def place(df: DataFrame, by: list[str], order: list[str], out: str = "place") -> DataFrame:
    """Adds ``out``, the place from 1 in order inside each group; rows without a group are a group of their own.

    Ranks are dealt by the first hex digits of a hash: counts of each range give its offset, and only the rows of one range are
    sorted in one task, so that a large group is no single task.
    """
    part, n, before = unused(df, "part", "n", "before")
    ranged = df.withColumn(part, F.substring(order[0], 1, 3))
    counts = ranged.groupBy(*by, part).agg(F.count("*").alias(n))
    over = Window.partitionBy(*by).orderBy(part) if by else Window.orderBy(part)
    offsets = counts.withColumn(before, F.sum(n).over(over) - F.col(n)).drop(n)
    inside = Window.partitionBy(*by, part).orderBy(*order)
    return join_same(ranged, offsets, [*by, part]).withColumn(out, F.row_number().over(inside) + F.col(before)).drop(part, before)


def holdout(df: DataFrame, id_: str, strata: list[str], share: float, seed: int = 42) -> DataFrame:
    """Adds in_val: ceil(share * n) rows of every stratum, that of the rows without one included."""
    h, n, at = unused(df, "drawn", "rows", "place")
    size = df.groupBy(*strata).agg(F.count("*").alias(n))
    placed = join_same(place(df.withColumn(h, drawn(id_, seed)), strata, [h, id_], at), size, strata)
    return placed.withColumn("in_val", F.col(at) <= F.ceil(F.col(n) * share)).drop(h, n, at)


def kfold(df: DataFrame, id_: str, strata: list[str], k: int, seed: int = 42) -> DataFrame:
    """Adds fold, 0 to k-1, dealt in turn inside every stratum, that of the rows without one included."""
    h, at = unused(df, "drawn", "place")
    placed = place(df.withColumn(h, drawn(id_, seed)), strata, [h, id_], at)
    return placed.withColumn("fold", ((F.col(at) - 1) % k).cast("int")).drop(h, at)


def feasible(df: DataFrame, key: str, share: float) -> bool:
    """Whether every stratum has two rows and either side has room for all strata."""
    per = df.groupBy(key).count()
    x = per.agg(F.sum("count").alias("n"), F.count("*").alias("k"), F.min("count").alias("least")).first()
    n_val = -(-(x.n or 0) * share // 1)
    return bool(x.n) and x.least >= 2 and n_val >= x.k and x.n - n_val >= x.k


def fallback(df: DataFrame, id_: str, keys: list[str], share: float, seed: int = 42) -> DataFrame:
    """``holdout`` by the first key that is feasible, else by none; adds level, its place in ``keys`` from 0."""
    for level, key in enumerate(keys):
        if feasible(df, key, share):
            return holdout(df, id_, [key], share, seed).withColumn("level", F.lit(level))
    return holdout(df, id_, [], share, seed).withColumn("level", F.lit(len(keys)))


def representatives(df: DataFrame, group: str, order: str) -> DataFrame:
    """The first non-null value of every column in each group, column by column."""
    return df.groupBy(group).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in df.columns if c not in (group,)])


def group_holdout(df: DataFrame, id_: str, group: str, share: float, seed: int = 42) -> DataFrame:
    """Splits groups and hands the side to their members; rows without a group are one group."""
    return join_same(df, holdout(df.select(group).distinct(), group, [], share, seed), [group])


def group_kfold(df: DataFrame, group: str, label: str, k: int) -> DataFrame:
    """Adds fold, 0 to k-1: stratified folds that keep groups whole; rows without a group are one group, a null label is a label.

    Groups stand in line by their commonest label (the least of several), then by falling size, then by name, and are dealt
    to the folds to and fro: 0 to k-1, k-1 to 0, and on. Two folds thus differ in groups of a label by at most two, and their sizes by less than the largest
    groups of each label. Places in line are global ranks from range partitions, so any number of groups is dealt without the driver.
    """
    per = df.groupBy(F.col(group).alias("name"), F.col(label).alias("kind")).agg(F.count("*").alias("rows"))
    sized = per.groupBy("name").agg(F.sum("rows").alias("size"), F.min(F.struct(-F.col("rows"), "kind")).getField("kind").alias("kind"))
    line = ranked(sized, [F.col("kind").asc_nulls_first(), F.desc("size"), F.col("name").asc_nulls_first()])
    turn, at = F.floor((F.col("rank") - 1) / k), (F.col("rank") - 1) % k
    folds = line.select(F.col("name").alias(group), F.when(turn % 2 == 0, at).otherwise(k - 1 - at).cast("int").alias("fold"))
    return join_same(df, folds, [group])


def chronological(df: DataFrame, order: list[str], shares: tuple[float, float] = (0.7, 0.15)) -> DataFrame:
    """Adds split: the first rows train, the next val, the rest test. Ranks come from range partitions and their offsets."""
    n = df.count()
    a, b = int(n * shares[0]), int(n * shares[0]) + int(n * shares[1])
    return ranked(df, order).withColumn("split", F.when(F.col("rank") <= a, "train").when(F.col("rank") <= b, "val").otherwise("test")).drop("rank")
