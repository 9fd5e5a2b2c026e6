"""N-gram Jaccard join by grouped prefixes, and the groups of near copies that it implies.

Shingles are hashed to 64 bits and ordered once for all documents: by the (logarithmic) count of the hash's bucket in a sketch of
all shingles, rarest first, then by hash. A document of n shingles can only reach the threshold with one that shares a shingle of its
prefix, its first n - ceil(t n) + 1. Documents with equal sets are one class; classes with the same size and the
same prefix are one group, and only groups are joined.

Pairs are made in two rounds, so that a large family of near copies costs its size and not its square. First each group meets its
neighbour and the first group under every prefix shingle, in order of its place, and each class the next of its group; the pairs that pass the size and
position filters are verified on whole sets, and links merged into components. Then all other group pairs that pass the filters and
are not yet in one component are expanded to their classes and verified. Pairs inside a component need no
check: they could not change it. Before whole sets are read, whole prefixes of a pair bound its overlap. Frequent shingles are
salted by their sketch count in the first round. In the second, a component with more than half of the groups under a shingle is its family, whose
groups meet those strange to it and not one another. Groups meet by a join where a shingle has at most ``SMALL`` pairs of different components
a group. Elsewhere they are compared block by block, bounded by signatures (counts of a set's shingles in ``SIGNATURE`` buckets), and only
pairs that pass leave the task. A shingle's groups are cut into blocks inside steps of size where they are more than ``BLOCK``, each step the
threshold's ratio above the one before, and only blocks of one step or of neighbouring steps meet.

Defined cases: null and empty texts have no shingles, stand alone and have their own id as component; texts of fewer words than a
shingle are one shingle; rows that repeat an id are separate rows of that id; a null id is never linked and gets a null
component; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .staging import Stages, small_side, unused
from .text import chunks, free, lean, mix, utf8, word_bytes, words

WORDS = 5
PERCENT = 80
SKETCH_BITS = 18
#: A shingle is salted into as many parts as its sketch count holds this many mean counts.
SALT_AT = 4
#: Shingles with more pairs of different components than this a group are paired block by block in Python, under a signature bound, instead of by a join.
SMALL = 32
BLOCK = 512
#: Pairs whose signatures are compared at once.
SIGNED = 4096
#: A signature counts a set's shingles in so many buckets; larger sets than its counters hold have none.
SIGNATURE, COUNTED = 128, 60_000
BLANK = word_bytes("blank")


def shingles(data: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a chunk's documents: (document, hash), sorted by document, then hash."""
    w = words(data, at, BLANK)
    count = np.diff(w.first)
    last = len(w.hash) - size + 1
    k = np.flatnonzero(w.doc[:last] == w.doc[size - 1 :]) if last > 0 else np.empty(0, np.int64)
    h = np.zeros(len(k), np.uint64)
    for j in range(size):
        h = mix(h * np.uint64(0x2545F4914F6CDD1D) + w.hash[k + j])
    doc = w.doc[k]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        whole = count[short].astype(np.uint64)
        for j in range(size - 1):
            more = count[short] > j
            whole[more] = mix(whole[more] * np.uint64(0x9E6C63D0876A9A47) + w.hash[w.first[short][more] + j])
        h, doc = np.concatenate([h, whole]), np.concatenate([doc, short])
    order = np.argsort(h, kind="stable")
    order = order[np.argsort(doc[order].astype(np.uint16 if len(at) <= 1 << 16 else np.int64), kind="stable")]
    doc, h = doc[order], h[order]
    if not len(h):
        return doc, h
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])])
    return doc[new], h[new]


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def sketch(docs: DataFrame, size: int) -> np.ndarray:
    """Counts of shingles by hash bucket over all documents; its length is fixed."""

    @lean
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            data, at = utf8(batch.column("text"))
            for lo, hi in chunks(at):
                total += np.bincount(_bucket(shingles(data, at[lo : hi + 1], size)[1]), minlength=1 << SKETCH_BITS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    rows = docs.select("text").mapInArrow(counted, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << SKETCH_BITS, np.int64)
    counts[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return counts


def _keys(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Order keys of shingles: the logarithm of the sketch count, then the hash. Non-negative, rarest first.

    Keys that collide only add candidates and weaken a bound; whole hashes are compared in the end.
    """
    rare = np.minimum(np.log2(counts[_bucket(h)] + 1.0) * 64, (1 << 12) - 1).astype(np.uint64)
    return ((rare << np.uint64(51)) | (mix(h) >> np.uint64(13))).view(np.int64)


def _digests(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each document's set; zeros for empty ones."""
    sums = []
    for salt in (1, 0x51_7C_C1_B7_27_22_0A_95):
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(mix(h ^ np.uint64(salt)), out=total[1:])
        sums.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
    return sums[0], sums[1]


def prefixes(docs: DataFrame, counts: np.ndarray, size: int, percent: int) -> DataFrame:
    """doc_id, n, d1, d2, prefix (order keys), salts, signature for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    @lean
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        full = max(float(counts[counts > 0].mean()) if counts.any() else 1.0, 1.0) * SALT_AT
        for batch in batches:
            data, at = utf8(batch.column("text"))
            for lo, hi in chunks(at):
                doc, h = shingles(data, at[lo : hi + 1], size)
                first = np.searchsorted(doc, np.arange(hi - lo + 1))
                n = np.diff(first)
                d1, d2 = _digests(h, first)
                often, keys = counts[_bucket(h)], _keys(h, counts)
                order = np.lexsort((h, keys, doc))
                take = n - (n * percent + 99) // 100 + (n > 0)
                place = np.arange(len(h)) - first[:-1][doc]
                chosen = order[place < take[doc]]
                ends = np.concatenate([[0], np.cumsum(take)]).astype(np.int32)
                salts = np.ceil(often[chosen] / full).astype(np.int32)
                slot = (mix(h ^ np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(57)).astype(np.int64)
                marks = np.bincount(doc * SIGNATURE + slot, minlength=(hi - lo) * SIGNATURE).astype("<u2").reshape(hi - lo, SIGNATURE)
                signature = pa.array([m.tobytes() if k <= COUNTED else None for m, k in zip(marks, n, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").cast(pa.int64())[lo:hi],
                        pa.array(n.astype(np.int32)),
                        pa.array(d1),
                        pa.array(d2),
                        pa.ListArray.from_arrays(ends, pa.array(keys[chosen])),
                        pa.ListArray.from_arrays(ends, pa.array(salts)),
                        signature,
                    ],
                    ["doc_id", "n", "d1", "d2", "prefix", "salts", "signature"],
                )

    return docs.select("doc_id", "text").mapInArrow(
        made,
        "doc_id long, n int, d1 long, d2 long, prefix array<long>, salts array<int>, signature binary",
    )


def _fits(percent: int) -> Column:
    """Size and position filters for a prefix shingle that two groups (n, at; n2, at2) share.

    What comes before the first shingle that a pair shares is in neither overlap, so that shingle passes for every pair that
    reaches the threshold; others need not.
    """
    n, n2 = F.col("n").cast("long"), F.col("n2").cast("long")
    size = F.least(n, n2) * 100 >= F.greatest(n, n2) * percent
    need = F.ceil((n + n2) * percent / (100 + percent))
    most = F.least(F.col("n") - F.col("at"), F.col("n2") - F.col("at2"))
    return size & (most >= need)


def _blocks(percent: int):
    """Pairs of two blocks of the groups under one shingle, under the size, position and signature bounds."""

    def paired(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        i, j = key[-2:]
        a, b = rows[rows["block"] == i], rows[rows["block"] == j]
        (g, n, at, lo, hi), (g2, n2, at2, lo2, hi2) = ([x[k].to_numpy() for k in ("g", "n", "at", "lo", "hi")] for x in (a, b))
        g, n, at, lo, hi = (x[:, None] for x in (g, n, at, lo, hi))
        need = -((n + n2) * -percent // (100 + percent))
        ok = (np.minimum(n, n2) * 100 >= np.maximum(n, n2) * percent) & (np.minimum(n - at, n2 - at2) >= need)
        ok &= ~((lo == hi) & (lo2 == hi2) & (lo == lo2)) & ((g < g2) if i == j else (g != g2))
        r, k = np.nonzero(ok)
        if len(r):
            marks, exact = zip(*(_marks(x["signature"], x["classes"].to_numpy()) for x in (a, b)), strict=True)
            keep = []
            for p in range(0, len(r), SIGNED):
                x, y = r[p : p + SIGNED], k[p : p + SIGNED]
                most = np.minimum(marks[0][x], marks[1][y]).sum(axis=1, dtype=np.int64)
                keep.append(~(exact[0][x] & exact[1][y]) | (most >= need[x, y]))
            keep = np.concatenate(keep)
            r, k = r[keep], k[keep]
        if len(rows) >= BLOCK:
            free()
        return pd.DataFrame({"g": g[r, 0].astype(np.int64), "g2": g2[k].astype(np.int64)})

    return paired


def _marks(signatures: pd.Series, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures as rows, and whether each stands for its whole group: a signature is that of one class."""
    none = np.full(SIGNATURE, 65535, "<u2").tobytes()
    marks = np.frombuffer(b"".join(none if m is None else m for m in signatures), "<u2").reshape(-1, SIGNATURE)
    return marks, np.array([m is not None for m in signatures], bool) & (classes == 1)


def _crossing(entries: DataFrame, signatures: DataFrame, percent: int, stages: Stages) -> DataFrame:
    """g, g2 of the group pairs not yet in one component that pass the filters."""
    apart = ~((F.col("lo") == F.col("hi")) & (F.col("lo2") == F.col("hi2")) & (F.col("lo") == F.col("lo2")))
    ordered = (F.col("n") < F.col("n2")) | ((F.col("n") == F.col("n2")) & (F.col("g") < F.col("g2")))
    second = lambda df, *more: df.select("token", *more, *[F.col(c).alias(f"{c}2") for c in ("g", "n", "at", "lo", "hi")])
    small = entries.where(F.col("members") <= SMALL)
    few = small.join(second(small), "token").where(ordered & apart & _fits(percent)).select("g", "g2")

    # a group is of one component, or apart from all
    hot = entries.where(F.col("members") > SMALL).withColumn("own", F.when(F.col("lo") == F.col("hi"), F.col("lo")))
    of = hot.groupBy("token", "own").agg(F.count("*").alias("k")).groupBy("token").agg(
        F.sum("k").alias("k"),
        F.sum(F.when(F.col("own").isNotNull(), F.col("k") * F.col("k"))).alias("inside"),
        F.max(F.when(F.col("own").isNotNull(), F.struct("k", "own"))).alias("most"),
    )
    crossing = (F.col("k") * F.col("k") - F.coalesce("inside", F.lit(0))) / 2
    of = of.select(
        "token",
        F.when(F.col("most.k") * 2 > F.col("k"), F.col("most.own")).alias("family"),
        (crossing <= F.col("k") * SMALL).alias("thin"),
    )
    hot = hot.join(small_side(stages.put(of, "hot")), "token").withColumn("stranger", ~F.coalesce(F.col("own") == F.col("family"), F.lit(False)))
    thin = hot.where("thin")
    strangers = small_side(stages.put(thin.where("stranger").select("token", "g", "n", "at", "lo", "hi"), "strangers"))
    met = second(thin, "stranger").join(strangers, "token").where((~F.col("stranger") | ordered) & apart & _fits(percent))
    few = few.union(met.select("g", "g2"))

    # two sizes within the ratio are in one step or in neighbouring ones
    steps = F.floor(F.ln(F.col("n").cast("double")) / (float(np.log(100 / percent)) * (1 + 1e-6))).cast("int") if percent < 100 else F.col("n")
    many = hot.where("not thin").withColumn("step", F.when(F.col("members") <= BLOCK, 0).otherwise(steps))
    # one row a hot shingle and step: where few, no row of a hot shingle moves to meet it; blocks of strangers come before those of the family
    counted = lambda whom: F.ceil(F.count_if(whom) / BLOCK).cast("int")
    per = many.groupBy("token", "step").agg(
        counted(F.col("stranger")).alias("strange"),
        (counted(F.col("stranger")) + counted(~F.col("stranger"))).alias("blocks"),
    )
    per = small_side(stages.put(per, "steps"))
    above, below = (
        per.select("token", (F.col("step") + by).alias("step"), *[F.col(c).alias(f"{c}_{name}") for c in ("strange", "blocks")])
        for by, name in ((-1, "above"), (1, "below"))
    )
    many = many.join(per, ["token", "step"]).join(above, ["token", "step"], "left").join(below, ["token", "step"], "left").join(signatures, "g", "left")
    dealt = lambda count: F.pmod(F.xxhash64("g"), F.greatest(count, F.lit(1))).cast("int")
    many = many.withColumn("block", F.when(F.col("stranger"), dealt(F.col("strange"))).otherwise(F.col("strange") + dealt(F.col("blocks") - F.col("strange"))))
    faced = lambda at="": F.when(F.col("stranger"), F.col(f"blocks{at}")).otherwise(F.col(f"strange{at}"))
    none = F.array().cast("array<struct<step:int,i:int,j:int,across:boolean>>")
    met = lambda step, i, j, across: F.struct(
        step.cast("int").alias("step"),
        i.cast("int").alias("i"),
        j.cast("int").alias("j"),
        F.lit(across).alias("across"),
    )
    listed = lambda count, to: F.when(F.coalesce(count, F.lit(0)) > 0, F.transform(F.sequence(F.lit(0), count - 1), to)).otherwise(none)
    own = listed(faced(), lambda k: met(F.col("step"), F.least("block", k), F.greatest("block", k), False))
    up = listed(faced("_above"), lambda k: met(F.col("step"), F.col("block"), k, True))
    down = listed(faced("_below"), lambda k: met(F.col("step") - 1, k, F.col("block"), True))
    many = many.withColumn("home", F.col("step")).withColumn("met", F.explode(F.concat(own, up, down)))
    side = F.when(F.col("met.across"), F.col("home") - F.col("met.step")).otherwise(F.col("block"))  # which of the two blocks a row is of
    many = many.select(
        "token",
        F.col("met.step").alias("step"),
        F.col("met.across").alias("across"),
        F.when(F.col("met.across"), 0).otherwise(F.col("met.i")).alias("i"),
        F.when(F.col("met.across"), 1).otherwise(F.col("met.j")).alias("j"),
        F.col("met.i").alias("bi"),
        F.col("met.j").alias("bj"),
        side.alias("block"),
        "g",
        F.col("n").cast("long").alias("n"),
        F.col("at").cast("long").alias("at"),
        "lo",
        "hi",
        "classes",
        "signature",
    )
    return few.union(many.groupBy("token", "step", "across", "bi", "bj", "i", "j").applyInPandas(_blocks(percent), "g long, g2 long"))


def _sets(docs: DataFrame, classes: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(id, n, set) of the classes in ``ids``, whose texts alone are read again."""
    wanted = small_side(ids).withColumnRenamed("id", "_id")

    @lean
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column("text"))
            for lo, hi in chunks(at):
                doc, h = shingles(data, at[lo : hi + 1], size)
                first = np.searchsorted(doc, np.arange(hi - lo + 1))
                d1, d2 = _digests(h, first)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").cast(pa.int64())[lo:hi],
                        pa.array(d1),
                        pa.array(d2),
                        pa.ListArray.from_arrays(first.astype(np.int32), pa.array(h.view(np.int64))),
                    ],
                    ["id", "d1", "d2", "set"],
                )

    read = docs.select("doc_id", "text").join(
        wanted,
        F.col("doc_id") == F.col("_id"),
        "left_semi",
    ).mapInArrow(made, "id long, d1 long, d2 long, set array<long>")
    known = classes.join(small_side(ids), "id", "left_semi").select("id", "d1", "d2", "n")
    return read.join(small_side(known), ["id", "d1", "d2"]).select("id", "n", "set")


def _survive(pairs: DataFrame, rows: DataFrame, classes: DataFrame, percent: int, stages: Stages) -> DataFrame:
    """The pairs that whole prefixes don't rule out.

    A prefix key of one side that comes before the other side's last and is not among its keys is in no part of the other set,
    so each side's overlap is at most its size less the number of those.
    """
    ids = stages.put(
        pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct().join(classes.select("id", "n", "d1", "d2"), "id"),
        "ids",
    )
    known = rows.withColumnRenamed("doc_id", "id").join(small_side(ids), ["id", "n", "d1", "d2"], "left_semi").select("id", "n", "prefix")
    left, right = (known.select(F.col("id").alias(k), F.col("n").alias(f"n_{k}"), F.col("prefix").alias(f"prefix_{k}")) for k in "ab")
    alone = lambda x, y: F.size(F.array_except(F.filter(f"prefix_{x}", lambda t: t < F.element_at(f"prefix_{y}", -1)), f"prefix_{y}"))
    most = F.least(F.col("n_a") - alone("a", "b"), F.col("n_b") - alone("b", "a"))
    need = F.ceil((F.col("n_a").cast("long") + F.col("n_b")) * percent / (100 + percent))
    return pairs.join(left, "a").join(right, "b").where(most >= need).select("a", "b")


def _ordered(pairs: DataFrame) -> DataFrame:
    """The distinct pairs (a, b), a < b."""
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct()


def _verified(pairs: DataFrame, docs: DataFrame, rows: DataFrame, classes: DataFrame, size: int, percent: int, stages: Stages) -> DataFrame:
    """Those of the pairs (a, b) of class ids, ordered and staged, whose sets reach the threshold."""
    pairs = stages.put(_survive(pairs, rows, classes, percent, stages).distinct(), "survivors")
    ids = stages.put(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct(), "ids")
    sets = stages.put(_sets(docs, classes, ids, size), "sets")
    left, right = (sets.select(F.col("id").alias(k), F.col("n").alias(f"n_{k}"), F.col("set").alias(f"set_{k}")) for k in "ab")
    both = F.size(F.array_intersect("set_a", "set_b")).cast("long")
    linked = pairs.join(left, "a").join(right, "b").withColumn("both", both).where(
        (F.col("n_a").cast("long") + F.col("n_b") - F.col("both")) * percent <= F.col("both") * 100
    )
    out = stages.put(linked.select("a", "b").distinct(), "links")
    for done in (sets, pairs, ids):
        stages.drop(done)
    return out


def join(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row."""
    stages = Stages(docs.sparkSession, "jaccard")
    rows = stages.put(prefixes(docs, sketch(docs, size), size, percent), "prefixes")
    real = rows.where("n > 0 and doc_id is not null").withColumn("group", F.xxhash64("n", "prefix"))
    classes = real.groupBy("n", "d1", "d2", "group").agg(F.min("doc_id").alias("id"))
    inside = Window.partitionBy("n", "group").orderBy("id")
    kept = stages.put(classes.withColumn("before", F.lag("id").over(inside)).withColumn("g", F.first("id").over(inside)).drop("group"), "classes")

    heads = small_side(stages.put(kept.where("id = g").select(F.col("g").alias("doc_id"), "n", "d1", "d2"), "heads"))
    groups = rows.join(heads, ["doc_id", "n", "d1", "d2"], "left_semi").withColumnRenamed("doc_id", "g")
    each = groups.select("g", "n", F.posexplode(F.arrays_zip("prefix", "salts")).alias("at", "p")).select(
        "g",
        "n",
        "at",
        F.col("p.prefix").alias("token"),
        F.col("p.salts").alias("salts"),
    )
    each = each.withColumn("salt", F.pmod(F.xxhash64("g"), F.col("salts").cast("long")).cast("int"))
    part = Window.partitionBy("token", "salt")
    order = part.orderBy("at", "n", "g")
    each = each.withColumn(
        "near",
        F.array(F.lag(F.struct("g", "n", "at")).over(order), F.first(F.struct("g", "n", "at")).over(order)),
    ).withColumn("members", F.count("*").over(part)).where("members > 1 or salts > 1")
    shared = stages.put(each.drop("members"), "shared")
    leads = shared.where("salts > 1 and near[0] is null").withColumn(
        "near",
        F.array(F.lag(F.struct("g", "n", "at")).over(Window.partitionBy("token").orderBy("at", "n", "g"))),
    )
    met = shared.unionByName(leads).select(
        "g",
        "n",
        "at",
        F.explode(F.array_distinct("near")).alias("near"),
    ).where("near is not null and near.g != g")
    chained = met.select(
        "g",
        "n",
        "at",
        F.col("near.g").alias("g2"),
        F.col("near.n").alias("n2"),
        F.col("near.at").alias("at2"),
    ).where(_fits(percent))
    first = chained.select(F.col("g").alias("a"), F.col("g2").alias("b")).union(
        kept.where("before is not null").select(F.col("id").alias("a"), F.col("before").alias("b"))
    )
    first = stages.put(_ordered(first), "pairs")
    tried = _verified(first, docs, rows, kept, size, percent, stages)
    found = stages.put(components(tried, stages), "components")

    label = lambda df, key, found=found: df.join(
        small_side(found).select(F.col("node").alias(key), F.col("component").alias("_component")),
        key,
        "left",
    ).withColumn("component", F.coalesce("_component", key)).drop("_component")
    labelled = stages.put(label(kept.select("id", "n", "g"), "id"), "labelled")
    mixed = labelled.groupBy("g").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("classes"))
    entries = shared.drop("near", "salts", "salt").join(mixed, "g")
    open_tokens = entries.groupBy("token").agg(
        F.min("lo").alias("lo"),
        F.max("hi").alias("hi"),
        F.count("*").alias("members"),
    ).where("lo != hi").select("token", "members")
    entries = stages.put(entries.join(open_tokens, "token"), "entries")
    pairs = _crossing(entries, groups.select("g", "signature"), percent, stages).distinct()
    pairs = pairs.union(mixed.where("lo != hi").select("g", F.col("g").alias("g2")))
    members = labelled.select("g", F.col("id").alias("a"), F.col("component").alias("c"))
    wide = pairs.join(members, "g").join(
        members.select(F.col("g").alias("g2"), F.col("a").alias("b"), F.col("c").alias("c2")),
        "g2",
    ).where("c != c2").select("a", "b")
    wide = stages.put(_ordered(wide).join(first, ["a", "b"], "left_anti"), "others")
    final = label(kept.select("id", "n", "d1", "d2"), "id")
    if not wide.isEmpty():
        more = _verified(wide, docs, rows, kept, size, percent, stages)
        if not more.isEmpty():
            # links between components are fewer than those inside them: only the components are joined
            more = label(more, "a").select(F.col("component").alias("a"), "b")
            more = label(more, "b").select("a", F.col("component").alias("b"))
            joined = stages.put(components(more, stages), "components")
            final = label(final.drop("id").withColumnRenamed("component", "id"), "id", joined)
    final = final.select("n", "d1", "d2", "component")

    for done in (shared, first, labelled, entries, wide):
        stages.drop(done)
    out = rows.select("doc_id", "n", "d1", "d2").join(final, ["n", "d1", "d2"], "left")
    return out.select(
        "doc_id",
        F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
    )


def keep_one(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One document of each component, the one of least id, with the columns they came with, whatever their names.

    Rows without text or words, or without id, stay. Rows that share an id are told apart by their texts: of those with the same text one
    stays, if its component has no other document before it.
    """
    stages = Stages(docs.sparkSession, "distinct")
    key, many, gone = (unused(c, docs) for c in ("row_key", "shares_id", "dropped_key"))
    again = stages.put(docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select(F.col("doc_id").alias(key)), "again")
    if again.isEmpty():
        keyed = docs.withColumn(key, F.col("doc_id"))
    else:
        # an id of several rows is replaced by one of the id and the text, greater than any other
        rows = docs.join(small_side(again).withColumn(many, F.lit(True)), F.col("doc_id") == F.col(key), "left")
        own = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 2) + F.lit(1 << 62)
        keyed = stages.put(rows.withColumn(key, F.when(F.col(many), own).otherwise(F.col("doc_id"))), "keyed")
    found = stages.put(join(keyed.select(F.col(key).alias("doc_id"), "text"), size, percent), "joined")
    dropped = small_side(stages.put(found.where("component_id != doc_id").select(F.col("doc_id").alias(gone)).distinct(), "dropped"))
    kept = keyed.join(dropped, F.col(key) == F.col(gone), "left_anti")
    if not again.isEmpty():
        kept = kept.where(f"{many} is null").unionByName(kept.where(many).dropDuplicates([key]))
    return kept.select(*["`" + c.replace("`", "``") + "`" for c in docs.columns])
