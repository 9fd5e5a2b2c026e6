"""Word frequencies, difficulty scores and exact duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.sources.shared import cut

from .quantiles import with_quantiles
from .ranks import ranked

#: A word of this share of all words is common, whatever the median.
COMMON = 1e-4


def document_words(docs: DataFrame) -> DataFrame:
    """doc_id, word, n: words counted inside their document before anything is shuffled by word."""
    each = docs.select("doc_id", F.explode(T.words(F.lower(T.whole("text")))).alias("word"))
    return each.groupBy("doc_id", "word").agg(F.count("*").alias("n"))


def word_counts(counted: DataFrame) -> DataFrame:
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def word_frequencies(counted: DataFrame) -> DataFrame:
    """word, freq (share of all words), median (of all frequencies)."""
    per = word_counts(counted)
    total = per.agg(F.sum("n").alias("all"))
    freq = per.crossJoin(F.broadcast(total)).select("word", (F.col("n").cast("double") / F.col("all")).alias("freq"))
    return with_quantiles(freq, "freq", median=0.5)


def rare_ratio(counted: DataFrame) -> DataFrame:
    """doc_id, rare: share of words that are no boilerplate and rarer than the median word.

    A word of at least ``COMMON`` of all words, of which there are at most 1 / ``COMMON``, meets a broadcast; only rows of others, none of which
    fills a task, are shuffled by word.
    """
    per = cut(word_counts(counted))
    bounds = with_quantiles(per, "n", median=0.5)
    bounds = bounds.crossJoin(F.broadcast(per.agg(F.sum("n").alias("all"))))
    common = bounds.where(F.col("n") >= F.greatest("median", F.col("all") * COMMON)).select("word")
    rare = bounds.where(
        (F.col("n") < F.col("median")) & ~F.regexp_replace("word", f"[^{T.LETTERS}{T.SPACE}]", "").isin(*T.BOILERPLATE)
    ).select("word")
    found = counted.join(F.broadcast(common), "word", "left_anti").join(rare, "word", "left_semi").groupBy("doc_id").agg(F.sum("n").alias("some"))
    total = counted.groupBy("doc_id").agg(F.sum("n").alias("every"))
    return total.join(found, "doc_id", "left").select("doc_id", (F.coalesce("some", F.lit(0)) / F.col("every").cast("double")).alias("rare"))


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, text_length, word_count, the eight scores and their weighted sum; the words of a text are cut once."""
    counted = cut(document_words(docs))
    x, w, lower = F.col("x"), F.col("w"), F.col("lower")
    out = docs.select("doc_id", T.whole("text").alias("x"))
    out = out.select("doc_id", "x", T.words(x).alias("w"), T.words(F.lower(x)).alias("lower"))
    out = out.select(
        "doc_id",
        F.length(x).alias("text_length"),
        F.size(w).alias("word_count"),
        T.vocabulary_diversity(lower).alias("vocabulary_diversity"),
        T.named_entity_score(x, w).alias("named_entity_score"),
        T.number_complexity(x, w).alias("number_complexity"),
        T.special_char_complexity(x, w).alias("special_char_complexity"),
        T.historical_spelling(x, w).alias("historical_spelling"),
        T.text_length_complexity(x).alias("text_length_complexity"),
        T.punctuation_complexity(x).alias("punctuation_complexity"),
    )
    out = out.join(rare_ratio(counted), "doc_id", "left").withColumn("rare_word_ratio", T.capped(F.coalesce("rare", F.lit(0.0)), 200)).drop("rare")
    return out.withColumn("difficulty_score", T.difficulty())


def keyed(docs: DataFrame) -> DataFrame:
    """Adds key, and its SHA-256, by which copies meet: what is shuffled does not grow with the texts."""
    return docs.withColumn("key", T.key(T.whole("text"))).withColumn("digest", F.unhex(F.sha2("key", 256)))


def with_keys(groups: DataFrame, df: DataFrame, order: str) -> DataFrame:
    """Adds to groups (first: the id of one of their rows) the key of that row, which is made of its text once the row is found."""
    return groups.join(df.select(F.col(order).alias("first"), "text"), "first").withColumn("key", T.key(T.whole("text"))).drop("text")


def keep_first(df: DataFrame, order: str) -> DataFrame:
    """One id a key, the first in order (an aggregate: a hot key is combined before the shuffle)."""
    return df.groupBy("digest").agg(F.min(order).alias(order)).select(order)


def flags(df: DataFrame, order: str) -> DataFrame:
    """later: a copy after the first; any_copy: the key occurs again."""
    per = df.groupBy("digest").agg(F.min(order).alias("_first"), F.count("*").alias("_n"))
    joined = df.select(order, "digest").join(per, "digest")
    return joined.select(order, (F.col(order) > F.col("_first")).alias("later"), (F.col("_n") > 1).alias("any_copy"))


def report(df: DataFrame, order: str, most: int = 5) -> DataFrame:
    """key, copies, first_ids for keys that occur more than once.

    Ids are thinned to ``most`` in each of many parts of a key before they meet, so no array grows with the group.
    """
    part = F.pmod(F.xxhash64(order), F.lit(64))
    copies = df.groupBy("digest").agg(F.count("*").alias("copies")).where("copies > 1")
    some = df.select("digest", order).join(copies, "digest")
    inside = Window.partitionBy("digest", part).orderBy(order)
    thin = some.withColumn("_n", F.row_number().over(inside)).where(F.col("_n") <= most)
    groups = thin.groupBy("digest").agg(F.first("copies").alias("copies"), F.slice(F.sort_array(F.collect_list(order)), 1, most).alias("first_ids"))
    return with_keys(groups.withColumn("first", F.col("first_ids")[0]), df, order).select("key", "copies", "first_ids")


def group_ids(df: DataFrame, order: str) -> DataFrame:
    """dup_group: from 0 in order of falling frequency, then key, -1 for unique keys."""
    groups = df.groupBy("digest").agg(F.count("*").alias("n"), F.min(order).alias("first")).where("n > 1")
    numbered = ranked(with_keys(groups, df, order), [F.desc("n"), F.col("key")]).select("digest", (F.col("rank") - 1).cast("int").alias("dup_group"))
    return df.select(order, "digest").join(numbered, "digest", "left").select(order, F.coalesce("dup_group", F.lit(-1)).alias("dup_group"))


def leaks(df: DataFrame, order: str, held_out: Column) -> DataFrame:
    """key, n_train, n_val of keys that occur on both sides of a split."""
    per = df.groupBy("digest").agg(F.count_if(~held_out).alias("n_train"), F.count_if(held_out).alias("n_val"), F.min(order).alias("first"))
    return with_keys(per.where("n_train > 0 and n_val > 0"), df, order).select("key", "n_train", "n_val")
