"""Mixing sources to target weights by Pareto order sampling (DataFrame functions only).

Every source gets a share of all words by weight, at most ``max_copies`` times its own words; what is
above is shared again by weight among the others. A source whose target is r times its words takes
floor(r) certain copies of each document. The rest of its target is a sample of fixed size in words. Its inclusion probabilities
grow with a document's measure, its length relative to the source's mean in steps of a quarter octave between 1/4 and 4:
p = min(1, c times the measure), with c such that the expected words are the rest. Documents with p = 1 are certain and set
aside. The others draw a uniform number u from a hash of id and seed and rank by the odds u/(1-u) over their inclusion odds p/(1-p). The
ranks are taken up to the crossing of the remaining words, then the one document more whose length brings the
source nearest to its target, if any does. All that a document's lot depends on is its own row and a few facts of its source, so no
row is shuffled to be taken.

Defined cases: a null or empty text has size 0 and takes 0 words; a null source is a source of its own, last in
order; rows that repeat in id, source and size draw alike and rank as peers, so all or none are in the ranked prefix, and share the extra
document's place; rows without id draw by their text; a text of any length is one row; an empty table gives an empty result; other columns
are ignored by ``mix`` and carried unchanged, whatever their names, by ``mixed``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import Stages, small_side

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
SEED = "42"
#: Documents of a source for each range of ranks whose words are summed before the exact cut.
RANGE_DOCS = 256
MAX_RANGES = 65536


def sizes(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", *[c.alias(n) for n, c in _own().items()])


def _own() -> dict[str, Column]:
    """What is known of a row by itself: its words, and what it draws by."""
    by = F.when(F.col("doc_id").isNull(), F.concat(F.lit("null|"), F.md5(F.coalesce("text", F.lit(""))))).otherwise(F.col("doc_id").cast("string"))
    return {"size": F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"), "drawn_by": by}


def targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """One row a source: n_docs, source_size, target, whole (certain copies), rest (words still to sample).

    Shares are water-filled: with sources in order of cap over weight, those before the first one whose share stays
    under its cap are at their cap, and the others divide what is left. The windows run over sources, not rows.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    full = Window.orderBy("fills_at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    per = per.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * max_copies)
    per = per.withColumn("fills_at", F.col("cap").cast("double") / F.col("weight")).withColumn("all_size", F.sum("source_size").over(every))
    per = per.withColumn("left", F.col("all_size") - F.coalesce(F.sum("cap").over(full), F.lit(0)))
    per = per.withColumn("weight_left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(full), F.lit(0)))
    per = per.withColumn("level", F.col("left").cast("double") / F.col("weight_left"))
    level = F.max(F.when(F.col("fills_at") >= F.col("level"), F.col("level"))).over(every)  # past the first it falls
    per = per.withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce(level, F.lit(float("inf"))) * F.col("weight")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    return per.withColumn("whole", whole).select(
        "source",
        "source_size",
        "n_docs",
        "target",
        "whole",
        (F.col("target") - F.col("whole") * F.col("source_size")).alias("rest"),
    )


def inclusion(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """One row a source with a rest: c, and certain, the words of documents whose probability is 1.

    The windows run over the at most seventeen measures of a source.
    """
    some = _by_source(sized.where("size > 0"), plan.where("rest > 0")).withColumn("measure", _measure())
    per = some.groupBy("source", "measure").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    down = Window.partitionBy("source").orderBy(F.desc("measure"))
    above, on = down.rowsBetween(Window.unboundedPreceding, -1), down.rowsBetween(0, Window.unboundedFollowing)
    per = per.withColumn("before", F.coalesce(F.sum("words").over(above), F.lit(0)))
    per = per.withColumn("c", (F.col("rest") - F.col("before")) / F.sum(F.col("measure") * F.col("words")).over(on))
    # the greatest measure that is not certain fixes c
    fixed = per.groupBy("source").agg(
        F.max(F.when(F.col("c") * F.col("measure") < 1, F.struct("measure", "c", "before"))).alias("at"),
        F.sum("words").alias("all"),
    )
    return fixed.select("source", F.coalesce("at.c", F.lit(float("inf"))).alias("c"), F.coalesce("at.before", "all").alias("certain"))


def _measure() -> Column:
    """Length relative to the source's mean, rounded to quarter octaves, between 1/4 and 4."""
    step = F.round(F.log2(F.col("size").cast("double") * F.col("n_docs") / F.col("source_size")) * 4)
    return F.pow(F.lit(2.0), F.least(F.lit(8.0), F.greatest(F.lit(-8.0), step)) / 4)


def _ranked(rows: DataFrame, plan: DataFrame, seed: str) -> DataFrame:
    """Rows with size, drawn_by and source, and: the source's facts, p, rank, at (its place among ranks) and range."""
    out = _by_source(rows, plan)
    u = (F.conv(F.substring(F.md5(F.concat_ws("|", "drawn_by", F.lit(seed))), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    p = F.when((F.col("size") > 0) & (F.col("rest") > 0), F.least(F.lit(1.0), F.col("c") * _measure())).otherwise(0.0)
    out = out.withColumn("p", p).withColumn("u", u)
    out = out.withColumn("rank", F.when((F.col("p") > 0) & (F.col("p") < 1), F.col("u") / (1 - F.col("u")) * (1 - F.col("p")) / F.col("p")))
    out = out.withColumn("at", F.struct("rank", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), F.col("size").alias("words")))
    n_ranges = F.least(F.lit(MAX_RANGES), F.ceil(F.col("n_docs") / RANGE_DOCS))
    return out.withColumn("range", F.floor(F.col("rank") / (1 + F.col("rank")) * n_ranges))


def _facts(sized: DataFrame, weights: Sequence[int], max_copies: int, seed: str, stages: Stages) -> tuple[DataFrame, DataFrame]:
    """(plan, cuts): one row a source each, what it needs and where its ranks end."""
    plan = stages.put(targets(sized, weights, max_copies), "targets")
    odds = stages.put(inclusion(sized, small_side(plan)), "odds")
    plan = stages.put(_by_source(plan, odds, "left").withColumn("left", F.col("rest") - F.coalesce("certain", F.lit(0))), "plan")
    ranked = _ranked(sized, small_side(plan), seed).where("rank is not null and left > 0")

    # where each source's words run out: first by ranges, then inside the one that crosses
    running = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranges = ranked.groupBy("source", "range").agg(F.sum("size").alias("words"), F.first("left").alias("left"))
    ranges = ranges.withColumn("before", F.sum("words").over(running) - F.col("words")).where("before <= left and before + words > left")
    crossing = stages.put(ranges.select("source", F.col("range").alias("cross"), "before"), "ranges")
    inside = _by_source(ranked, small_side(crossing)).where("range = cross")
    inside = inside.withColumn("sum", F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy("at")))
    last = inside.where("sum <= left").groupBy("source").agg(F.max("at").alias("last"), F.max("sum").alias("sum"))
    cut = stages.put(_by_source(crossing, last, "left").select("source", "cross", F.coalesce("sum", "before").alias("got"), "last"), "cuts")
    gap = F.abs(F.col("left") - F.col("got") - F.col("size"))
    later = _by_source(ranked, small_side(cut)).where(_beyond()).where(gap < F.col("left") - F.col("got"))
    extra = later.groupBy("source").agg(F.min_by("at", F.struct(gap, F.col("at"))).alias("extra"))
    return plan, stages.put(_by_source(cut, extra, "left").select("source", "cross", "last", "extra"), "chosen")


def _decided(rows: DataFrame, plan: DataFrame, chosen: DataFrame, seed: str, max_copies: int) -> DataFrame:
    """Adds copies to rows with size, drawn_by and source."""
    out = _by_source(_ranked(rows, small_side(plan), seed), small_side(chosen), "left")
    drawn = F.col("rank").isNotNull() & (F.col("left") > 0) & (
        F.col("cross").isNull() | ~_beyond() | F.coalesce(F.col("at") == F.col("extra"), F.lit(False))
    )
    more = F.when(F.col("whole") < max_copies, ((F.col("p") >= 1) | F.coalesce(drawn, F.lit(False))).cast("long")).otherwise(0)
    return out.withColumn("copies", F.col("whole") + more)


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_copies: int = MAX_COPIES, seed: str = SEED) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, p (of its sampled copy), copies, taken."""
    stages = Stages(docs.sparkSession, "mixing")
    sized = stages.put(sizes(docs), "sizes")
    plan, chosen = _facts(sized, weights, max_copies, seed, stages)
    out = _decided(sized, plan, chosen, seed, max_copies)
    return out.select("doc_id", "source", "size", "source_size", "target", "p", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _beyond():
    """Whether a row ranks after its source's cut."""
    return (F.col("range") > F.col("cross")) | ((F.col("range") == F.col("cross")) & (F.col("last").isNull() | (F.col("at") > F.col("last"))))


def _by_source(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Joins source facts to rows; null is a source too."""
    right = right.withColumnRenamed("source", "source_of_facts")
    return left.join(right, left["source"].eqNullSafe(right["source_of_facts"]), how).drop("source_of_facts")


def mixed(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_copies: int = MAX_COPIES, seed: str = SEED) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as it is taken, with the columns they came with."""
    stages = Stages(docs.sparkSession, "mix")
    sized = stages.put(sizes(docs), "sizes")
    plan, chosen = _facts(sized, weights, max_copies, seed, stages)
    stages.drop(sized)
    # the whole row in one struct, so that none of its names can meet one of ours
    rows = docs.select(
        F.struct(*[docs["`" + c.replace("`", "``") + "`"] for c in docs.columns]).alias("row"),
        "doc_id",
        "source",
        *[c.alias(n) for n, c in _own().items()],
    )
    taken = _decided(rows, plan, chosen, seed, max_copies).where("copies > 0")
    out = taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
