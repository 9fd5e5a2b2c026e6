"""Embedding near-dedup on a robust-pruned flat graph.

Vectors with equal components are one class. Inside each cell of a coarse clustering, classes within half the link angle of a leader
form a ball: by the triangle inequality on angles all its members link with each other, so a family of near copies is counted
and not paired. The graph is over leaders. Every leader goes to its ``overlap`` nearest cells; each cell builds a flat graph (nearest
candidates and random ones, robust-pruned with ``ALPHA``, both directions), and the adjacency lists of all cells
are united. Each leader then searches its home cell greedily from the cell's medoid, and expands from every node in range
(the link angle and both balls' radii) along the united lists until no new node is in range; expansion that leaves the cell
goes on by joins. Leader pairs are verified: certain by their angle and radii, or by comparing the balls' members.

Recall is audited: a bounded number of linked vectors, chosen by hash, is compared with all vectors in blocks, and each counts alike however
many links it has, so that a large family hides no small one; a count above the true one lowers it too. Below ``AUDIT_LEAST`` the graph is built again
with a wider overlap; where recall stays below ``LEAST`` at the widest, all classes are compared in pairs of blocks (``exact_links``). Cells number as many as hold ``CELL`` vectors each, or the root of all
vectors beyond ``MOST_CELLS``; those above ``PIECE`` rows are salted into pieces, and a query visits all pieces of its home cell.
Centroids are fitted on ``FIT_ROWS`` vectors, or ``FIT_EACH`` a cell if that is more, chosen by hash.

Defined cases: vectors that are null, empty, zero, with null or non-finite components, of another length than the commonest, or without an
id link with nothing and keep their own id as component; components may be of any numeric type and are compared as doubles; rows that repeat an id
are separate vectors of that id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .staging import Stages, small_side
from .text import lean

COSINE = 0.9
CELL = 1500
MOST_CELLS = 1024
FIT_ROWS, FIT_EACH = 20_000, 8
PIECE = 4096
OVERLAP = 2
POOL, RANDOM, DEGREE, ALPHA = 32, 8, 16, 1.2
BEAM = 16
AUDIT_QUERIES, AUDIT_LEAST, LEAST = 256, 0.95, 0.9
SLACK = 1e-9
#: Classes of a block where all are compared.
EXACT_BLOCK = 4096


def unit(rows) -> np.ndarray:
    """Rows of one length, as unit vectors in double precision."""
    if isinstance(rows, pa.Array):
        flat = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        x = flat.reshape(len(rows), -1) if len(rows) else np.empty((0, 0))
    else:
        x = np.array([np.asarray(r, np.float64) for r in rows])
    top = np.abs(x).max(axis=1, keepdims=True) if x.size else 1.0
    x = x / top  # neither overflow nor underflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True)) if x.size else x


def classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): rows has vec_id, k1, k2 (null if it links with nothing); classes has least (vec_id), copies, k1, k2, embedding.

    A class is known by what its vectors are: rows of one vec_id may be of several classes, and a class may have rows of several.
    """
    size = vectors.where("embedding is not null").groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    e = F.col("embedding")
    finite = F.forall(e, lambda x: F.coalesce((x == x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(e, lambda x: x != 0)
    valid = F.coalesce(e.isNotNull() & (F.size(e) == (size.n if size and size.n else -1)) & finite & F.col("vec_id").isNotNull(), F.lit(False))
    rows = vectors.select("vec_id", "embedding", valid.alias("valid"))
    rows = rows.withColumn("k1", F.when(F.col("valid"), F.xxhash64("embedding"))).withColumn(
        "k2",
        F.when(F.col("valid"), F.xxhash64(F.lit(17), "embedding")),
    )
    found = rows.where("valid").groupBy("k1", "k2").agg(
        F.min("vec_id").alias("least"),
        F.count("*").alias("copies"),
        F.first("embedding").alias("embedding"),
    )
    return rows.select("vec_id", "k1", "k2"), found


def centroids(found: DataFrame, n: int) -> np.ndarray:
    """Spherical k-means on a bounded sample."""
    cells = -(-n // CELL)
    cells = cells if cells <= MOST_CELLS else max(MOST_CELLS, int(n**0.5))
    share = min(1.0, max(FIT_ROWS, FIT_EACH * cells) / max(n, 1))
    some = found.where(
        F.pmod(F.xxhash64(F.lit("fit"), "id"), F.lit(1 << 20)) < int(share * (1 << 20))
    ).select("id", "embedding").toArrow().sort_by("id")
    x = unit(some["embedding"].combine_chunks())
    k = min(max(1, cells), max(len(x), 1))
    if not len(x):
        return np.zeros((1, 1))
    rng = np.random.default_rng(11)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(6):
        near = np.concatenate([(x[lo : lo + 4096] @ c.T).argmax(axis=1) for lo in range(0, len(x), 4096)])
        order = np.argsort(near, kind="stable")
        own, first = np.unique(near[order], return_index=True)
        m = np.add.reduceat(x[order], first, axis=0)
        c[own] = m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-12)
    return c


def assigned(found: DataFrame, c: np.ndarray, overlap: int) -> DataFrame:
    """id, copies, embedding, cells (nearest first)."""
    shared = found.sparkSession.sparkContext.broadcast(c)

    @lean
    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            x = unit(batch.column("embedding"))
            cells = np.concatenate(
                [
                    np.empty((0, min(overlap, len(c)))),
                    *[np.argsort(-(x[lo : lo + 1024] @ c.T), axis=1, kind="stable")[:, :overlap] for lo in range(0, len(x), 1024)],
                ]
            )
            ends = np.arange(len(cells) + 1, dtype=np.int32) * cells.shape[1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(k) for k in ("id", "copies", "embedding")] + [pa.ListArray.from_arrays(ends, pa.array(cells.ravel().astype(np.int32)))],
                ["id", "copies", "embedding", "cells"],
            )

    return found.select("id", "copies", "embedding").mapInArrow(
        near,
        f"id long, copies long, embedding {found.schema['embedding'].dataType.simpleString()}, cells array<int>",
    )


def pieces(rows: DataFrame) -> DataFrame:
    """Adds pieces, how many its cell is cut into, and piece; there is one row a cell to broadcast."""
    per = rows.groupBy("cell").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("pieces"))
    return rows.join(F.broadcast(per), "cell").withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int"))


def balls(group: pd.DataFrame) -> pd.DataFrame:
    """Leaders in order of id: id, leader, cos."""
    group = group.sort_values("id", kind="stable")
    x, ids = unit(group["embedding"]), group["id"].to_numpy()
    least = np.cos(np.arccos(COSINE) / 2 - SLACK)
    leader, cos = np.full(len(x), -1), np.ones(len(x))
    heads: list[int] = []
    for lo in range(0, len(x), 256):
        block = x[lo : lo + 256]
        if heads:
            c = block @ x[heads].T
            best = c.argmax(axis=1)
            top = c[np.arange(len(block)), best]
            hit = np.flatnonzero(top >= least)
            leader[lo + hit], cos[lo + hit] = np.array(heads)[best[hit]], top[hit]
        own = block @ block.T
        new: list[int] = []
        for i in np.flatnonzero(leader[lo : lo + 256] < 0):
            if new and (own[i, new] >= least).any():
                j = new[int(own[i, new].argmax())]
                leader[lo + i], cos[lo + i] = lo + j, own[i, j]
            else:
                leader[lo + i] = lo + i
                new.append(int(i))
        heads += [lo + j for j in new]
    return pd.DataFrame({"id": ids, "leader": ids[leader], "cos": np.minimum(cos, 1.0), "copies": group["copies"].to_numpy()})


def graph(group: pd.DataFrame) -> pd.DataFrame:
    """Robust-pruned edges of a piece: src, dst, cos, both ways."""
    group = group.sort_values("id", kind="stable")
    x, ids = unit(group["embedding"]), group["id"].to_numpy()
    n = len(x)
    if n < 2:
        return pd.DataFrame({"src": ids[:0], "dst": ids[:0], "cos": np.zeros(0)})
    rng = np.random.default_rng(n)
    pool = min(POOL, n - 1)
    src, dst, cos = [], [], []
    for lo in range(0, n, 256):
        c = x[lo : lo + 256] @ x.T
        m = len(c)
        c[np.arange(m), lo + np.arange(m)] = -2
        near = np.argpartition(-c, pool - 1, axis=1)[:, :pool] if pool < n - 1 else np.argsort(-c, axis=1)[:, :pool]
        some = np.concatenate([near, rng.integers(0, n, (m, RANDOM))], axis=1)
        d = 2 - 2 * np.take_along_axis(c, some, 1)
        order = np.argsort(d, axis=1, kind="stable")
        some, d = np.take_along_axis(some, order, 1), np.take_along_axis(d, order, 1)
        among = 2 - 2 * np.einsum("nid,njd->nij", x[some], x[some])
        alive, kept = d < 4.5, np.zeros(d.shape, bool)  # a node is no candidate of its own
        for j in range(some.shape[1]):
            now = alive[:, j] & (kept.sum(axis=1) < DEGREE)
            kept[:, j] = now
            alive[:, j + 1 :] &= ~(now[:, None] & (ALPHA * among[:, j, j + 1 :] <= d[:, j + 1 :]))
        a, b = np.nonzero(kept)
        src.append(lo + a)
        dst.append(some[a, b])
        cos.append(1 - d[a, b] / 2)
    # the medoid keeps far links too, so that a search from it reaches every part
    hub = medoid(x)
    far = rng.choice(n, min(n, 64), replace=False)
    far = far[far != hub]
    src, dst = np.concatenate([*src, np.full(len(far), hub)]), np.concatenate([*dst, far])
    cos = np.concatenate([*cos, x[far] @ x[hub]])
    both = pd.DataFrame({"src": ids[np.concatenate([src, dst])], "dst": ids[np.concatenate([dst, src])], "cos": np.concatenate([cos, cos])})
    return both.drop_duplicates(["src", "dst"])


def medoid(x: np.ndarray) -> int:
    return int((x @ x.mean(axis=0)).argmax())


def search(group: pd.DataFrame) -> pd.DataFrame:
    """Range search of a piece's queries over its nodes: q, node, cos. Columns: id, embedding, radius, near, role (0 node, 1 query)."""
    nodes = group[group["role"] == 0].sort_values("id", kind="stable").drop_duplicates("id")
    queries = group[group["role"] == 1]
    none = pd.DataFrame({"q": np.empty(0, np.int64), "node": np.empty(0, np.int64), "cos": np.empty(0)})
    if not len(nodes) or not len(queries):
        return none
    x, ids, radius = unit(nodes["embedding"]), nodes["id"].to_numpy(), nodes["radius"].to_numpy()
    lists = [np.asarray(v, np.int64) if v is not None else np.empty(0, np.int64) for v in nodes["near"]]
    flat = np.concatenate(lists) if lists else np.empty(0, np.int64)
    at = np.minimum(np.searchsorted(ids, flat), len(ids) - 1)
    owner = np.repeat(np.arange(len(ids)), [len(v) for v in lists])
    here = ids[at] == flat
    owner, to = owner[here], at[here]
    first = np.searchsorted(owner, np.arange(len(ids) + 1))
    hub, width = medoid(x), int(np.diff(first).max(initial=0))
    table = np.full((len(ids), max(width, 1)), -1)
    table[owner, np.arange(len(owner)) - first[owner]] = to
    out = []
    y, y_ids, y_radius = unit(queries["embedding"]), queries["id"].to_numpy(), queries["radius"].to_numpy()
    for lo in range(0, len(y), 256):
        q = y[lo : lo + 256]
        m = len(q)
        seen = np.zeros((m, len(ids)), bool)
        cand = np.full((m, BEAM), -1)
        score, done = np.full((m, BEAM), -9.0), np.ones((m, BEAM), bool)
        cand[:, 0], score[:, 0], done[:, 0], seen[:, hub] = hub, q @ x[hub], False, True
        pairs = [(np.arange(m), np.full(m, hub), score[:, 0].copy())]
        while True:
            open_ = np.where(done, -9.0, score)
            j = open_.argmax(axis=1)
            live = np.flatnonzero(open_[np.arange(m), j] > -9.0)
            if not len(live):
                break
            done[live, j[live]] = True
            r, c = np.nonzero((near := table[cand[live, j[live]]]) >= 0)
            r, node = live[r], near[r, c]
            new = ~seen[r, node]
            r, node = r[new], node[new]
            seen[r, node] = True
            s = np.einsum("nd,nd->n", q[r], x[node])
            pairs.append((r, node, s))
            slot = np.arange(len(r)) - np.searchsorted(r, r)
            more_c, more_s = np.full((m, width + 1), -1), np.full((m, width + 1), -9.0)
            more_c[r, slot], more_s[r, slot] = node, s
            all_c, all_s = np.concatenate([cand, more_c], 1), np.concatenate([score, more_s], 1)
            all_d = np.concatenate([done, more_s == -9.0], 1)
            top = np.argsort(-all_s, axis=1, kind="stable")[:, :BEAM]
            cand, score, done = (np.take_along_axis(v, top, 1) for v in (all_c, all_s, all_d))
        # from every node in range on along the lists, until none is new
        r, node, s = (np.concatenate(v) for v in zip(*pairs, strict=True))
        bound = lambda r, node: np.cos(np.minimum(np.arccos(COSINE) + y_radius[lo + r] + radius[node] + SLACK, np.pi))
        hit = s >= bound(r, node)
        r, node, s = r[hit], node[hit], s[hit]
        while len(r):
            out.append((y_ids[lo + r], ids[node], s))
            i, c = np.nonzero((near := table[node]) >= 0)
            r, node = r[i], near[i, c]
            key = np.unique(r * len(ids) + node)
            r, node = key // len(ids), key % len(ids)
            new = ~seen[r, node]
            r, node = r[new], node[new]
            seen[r, node] = True
            s = np.einsum("nd,nd->n", q[r], x[node])
            hit = s >= bound(r, node)
            r, node, s = r[hit], node[hit], s[hit]
    if not out:
        return none
    a, b, s = (np.concatenate(v) for v in zip(*out, strict=True))
    return pd.DataFrame({"q": a, "node": b, "cos": np.minimum(s, 1.0)})[a != b]


def _cosines(pairs: DataFrame, leaders: DataFrame) -> DataFrame:
    """Adds cos and both radii to leader pairs (a, b)."""

    @lean
    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cos = np.einsum("nd,nd->n", unit(batch.column("e_a")), unit(batch.column("e_b"))) if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(k) for k in ("a", "b", "r_a", "r_b")] + [pa.array(np.minimum(cos, 1.0))],
                ["a", "b", "r_a", "r_b", "cos"],
            )

    left, right = (leaders.select(F.col("id").alias(k), F.col("embedding").alias(f"e_{k}"), F.col("radius").alias(f"r_{k}")) for k in "ab")
    return pairs.select("a", "b").join(left, "a").join(right, "b").mapInArrow(added, "a long, b long, r_a double, r_b double, cos double")


def _members(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """Links between the members of two balls: id, more (copies linked), and whether any."""
    c = unit(a["embedding"]) @ unit(b["embedding"]).T >= COSINE
    more = np.concatenate([c @ b["copies"].to_numpy(), a["copies"].to_numpy() @ c])
    ids = np.concatenate([a["id"].to_numpy(), b["id"].to_numpy()])
    return pd.DataFrame({"a": int(key[0]), "b": int(key[1]), "id": ids, "more": more.astype(np.int64)})[more > 0]


def links(found: DataFrame, stages: Stages, overlap: int) -> tuple[DataFrame, DataFrame]:
    """(counts, edges): id, n_links of every class; edges (a, b) that join all linked classes."""
    n = found.count()
    near = stages.put(assigned(found, centroids(found, n), overlap), "assigned")
    home = pieces(near.withColumn("cell", F.element_at("cells", 1)))
    ball = stages.put(home.groupBy("cell", "piece").applyInPandas(balls, "id long, leader long, cos double, copies long"), "balls")
    heads = ball.groupBy("leader").agg(
        F.acos(F.min("cos")).alias("radius"),
        F.sum("copies").alias("weight"),
        F.count("*").alias("members"),
    ).withColumn("radius", F.when(F.col("members") == 1, 0.0).otherwise(F.col("radius")))
    leaders = stages.put(near.join(heads, F.col("id") == F.col("leader")).select("id", "embedding", "cells", "radius", "weight"), "leaders")

    spread = pieces(leaders.withColumn("cell", F.explode("cells")))
    edges = spread.groupBy("cell", "piece").applyInPandas(graph, "src long, dst long, cos double")
    edges = stages.put(edges.groupBy("src", "dst").agg(F.max("cos").alias("cos")), "graph")
    lists = edges.groupBy("src").agg(F.collect_list("dst").alias("near"))
    nodes = spread.join(lists, F.col("id") == F.col("src"), "left").select(
        "cell",
        "piece",
        "id",
        "embedding",
        "radius",
        "near",
        F.lit(0).alias("role"),
    )
    asked = spread.where(F.col("cell") == F.element_at("cells", 1)).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    asked = asked.select("cell", "piece", "id", "embedding", "radius", F.lit(None).cast("array<bigint>").alias("near"), F.lit(1).alias("role"))
    hits = nodes.union(asked).groupBy("cell", "piece").applyInPandas(search, "q long, node long, cos double")

    # united lists: edges whose own cosine is in range, then on from every hit
    wide = lambda gap: gap <= F.lit(float(np.arccos(COSINE)) + SLACK) + F.col("r_a") + F.col("r_b")
    r = leaders.select(F.col("id").alias("a"), F.col("radius").alias("r_a"))
    s = leaders.select(F.col("id").alias("b"), F.col("radius").alias("r_b"))
    direct = edges.select(
        F.col("src").alias("a"),
        F.col("dst").alias("b"),
        "cos",
    ).where(F.col("cos") > 0).join(r, "a").join(s, "b").where(wide(F.acos(F.least("cos", F.lit(1.0))))).select("a", "b")
    pairs = hits.select(F.least("q", "node").alias("a"), F.greatest("q", "node").alias("b")).union(
        direct.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    ).distinct()
    known = stages.put(_cosines(pairs, leaders).where(wide(F.acos("cos"))), "pairs")
    fresh = known
    while True:
        ends = fresh.select("a", "b", "cos").union(fresh.select(F.col("b").alias("a"), F.col("a").alias("b"), "cos"))
        on = ends.withColumnRenamed("b", "src").withColumnRenamed("cos", "c1").join(
            edges.withColumnRenamed("cos", "c2"),
            "src",
        ).where("dst != a").withColumnRenamed("dst", "b")
        on = on.join(r, "a").join(s, "b").where(wide(F.acos("c2") - F.acos("c1"))).select(
            F.least("a", "b").alias("a"),
            F.greatest("a", "b").alias("b"),
        ).distinct()
        fresh = stages.put(_cosines(on.join(known, ["a", "b"], "left_anti"), leaders).where(wide(F.acos("cos"))), "expanded")
        if fresh.isEmpty():
            break
        known = known.union(fresh)

    alone = (F.col("r_a") == 0) & (F.col("r_b") == 0)
    judged = known.withColumn(
        "sure",
        F.when(alone, F.col("cos") >= COSINE).otherwise(F.acos("cos") + F.col("r_a") + F.col("r_b") <= float(np.arccos(COSINE)) - SLACK),
    )
    sure = stages.put(judged.where("sure").select("a", "b"), "sure")
    open_ = stages.put(judged.where(~F.col("sure") & ~alone).select("a", "b"), "open")
    own = ball.join(near.select("id", "embedding"), "id").select("id", "leader", "copies", "embedding")
    sides = [
        open_.join(own.withColumnRenamed("leader", k), k).select(*[F.col(c).alias(c) for c in ("a", "b", "id", "copies", "embedding")]) for k in "ab"
    ]
    some = sides[0].groupBy("a", "b").cogroup(
        sides[1].toDF("a", "b", "id", "copies", "embedding").groupBy("a", "b")
    ).applyInPandas(_members, "a long, b long, id long, more long")
    some = stages.put(some, "members")
    w = leaders.select("id", "weight")
    more = sure.join(w.withColumnRenamed("id", "b"), "b").select(F.col("a").alias("leader"), "weight").union(
        sure.join(w.withColumnRenamed("id", "a"), "a").select(F.col("b").alias("leader"), "weight")
    )
    more = more.groupBy("leader").agg(F.sum("weight").alias("weight"))
    weight = heads.select("leader", "weight").union(more).groupBy("leader").agg(F.sum("weight").alias("weight"))
    counts = ball.join(weight, "leader").select("id", (F.col("weight") - 1).alias("n")).union(
        some.select("id", F.col("more").alias("n"))
    ).groupBy("id").agg(F.sum("n").cast("long").alias("n_links"))
    joined = sure.union(some.select("a", "b").distinct()).union(ball.where("id != leader").select(F.col("id").alias("a"), F.col("leader").alias("b")))
    return counts, joined


def exact_links(found: DataFrame, stages: Stages) -> tuple[DataFrame, DataFrame]:
    """The same (counts, edges) without a graph: blocks of about ``EXACT_BLOCK`` classes, and every pair of blocks meets once.

    The work is quadratic, but what leaves a pair of blocks is not: a count and an edge a class.
    """
    n = found.count()
    blocks = max(1, -(-n // EXACT_BLOCK), min(-(-n // 64), int((2 * found.sparkSession.sparkContext.defaultParallelism) ** 0.5)))
    mine = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    rows = found.select("id", "copies", "embedding", mine.alias("block")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    rows = rows.select("id", "copies", "embedding", "block", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"))
    met = stages.put(rows.groupBy("p", "q").applyInPandas(_pair_of_blocks, "a long, b long, n long"), "blocks")
    every = met.where("n is not null").select(F.col("a").alias("id"), "n").union(found.select("id", (F.col("copies") - 1).alias("n")))
    counts = every.groupBy("id").agg(F.sum("n").cast("long").alias("n_links"))
    return counts, met.where("b is not null").select("a", "b").distinct()


def _pair_of_blocks(key, rows: pd.DataFrame) -> pd.DataFrame:
    """(a, null, n): how many vectors of the other block a class links with; (a, b, null): from each class to the first that it reaches here."""
    p, q = key
    one = rows[rows["block"] == p]
    two = rows[rows["block"] == q] if p != q else one
    x, y = unit(one["embedding"]), unit(two["embedding"])
    copies = one["copies"].to_numpy(), two["copies"].to_numpy()
    own, n = len(one), np.zeros(len(one) + (len(two) if p != q else 0), np.int64)
    label, at = np.arange(len(n)), 0 if p == q else own  # the other block's classes come after the own
    for lo in range(0, own if len(two) else 0, 512):
        hit = x[lo : lo + 512] @ y.T >= COSINE
        if p == q:
            hit[np.arange(len(hit)), lo + np.arange(len(hit))] = False
        else:
            n[at:] += copies[0][lo : lo + 512] @ hit
        n[lo : lo + len(hit)] += hit @ copies[1]
        r, c = np.nonzero(hit)
        r, c = r + lo, c + at
        while (label[r] != label[c]).any():
            low = np.minimum(label[r], label[c])
            np.minimum.at(label, label[r], low)
            np.minimum.at(label, label[c], low)
            while (label[label] != label).any():
                label = label[label]
    ids = np.concatenate([one["id"].to_numpy(), two["id"].to_numpy()])[: len(n)]
    some = label != np.arange(len(n))
    counted = pd.DataFrame({"a": ids[n > 0], "b": pd.NA, "n": n[n > 0]})
    return pd.concat([counted, pd.DataFrame({"a": ids[some], "b": ids[label[some]], "n": pd.NA})]).astype({"a": "int64", "b": "Int64", "n": "Int64"})


def audit(found: DataFrame, counts: DataFrame) -> float:
    """Mean share of their links that ``counts`` has, of a bounded number of linked vectors that are compared with every vector in blocks.

    Half of them are drawn from all vectors and half from those that have links by ``counts``, so that links are met where few vectors have any.
    """
    every = found.join(counts, "id").select("id", "embedding", "n_links", "copies")
    order = [F.xxhash64(F.lit("audit"), "id"), F.col("id")]
    half = AUDIT_QUERIES // 2
    some = every.orderBy(*order).limit(half).union(every.where("n_links > 0").orderBy(*order).limit(half)).toArrow()
    if not some.num_rows:
        return 1.0
    shared = found.sparkSession.sparkContext.broadcast(unit(some["embedding"].combine_chunks()))

    @lean
    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        total = np.zeros(len(q), np.int64)
        for batch in batches:
            copies = batch.column("copies").to_numpy()
            for lo in range(0, batch.num_rows, 4096):
                total += copies[lo : lo + 4096] @ (unit(batch.column("embedding")[lo : lo + 4096]) @ q.T >= COSINE)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(q), dtype=np.int32)), pa.array(total)], ["k", "n"])

    rows = found.select("copies", "embedding").mapInArrow(compared, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    true = np.zeros(some.num_rows, np.int64)
    true[rows["k"].to_numpy()] = rows["n"].to_numpy()
    true -= 1
    got = some["n_links"].to_numpy()
    met = (true > 0) | (got > 0)
    return float((np.minimum(got, true)[met] / np.maximum(got, true)[met]).mean()) if met.any() else 1.0


def dedup(vectors: DataFrame, overlap: int = OVERLAP, widest: int = 8) -> DataFrame:
    """vec_id, n_links, component_id, kept, audited_recall for every row."""
    stages = Stages(vectors.sparkSession, "vectors")
    rows, found = classes(vectors)
    found = stages.put(found.withColumn("id", F.monotonically_increasing_id()), "classes")  # numbered once, as written
    while True:
        inner = Stages(vectors.sparkSession, "links")
        counts, edges = links(found, inner, overlap)
        counts = stages.put(counts, "counts")
        recall = audit(found, counts)
        if recall >= AUDIT_LEAST or overlap >= widest:
            if recall < LEAST:
                inner.clear()
                counts, edges = exact_links(found, inner)
                counts = stages.put(counts, "exact")
                recall = audit(found, counts)
            break
        overlap += 2
        inner.clear()
    groups = components(edges, stages).withColumnRenamed("node", "id")
    inner.clear()
    per = found.select("id", "least", "k1", "k2").join(counts, "id").join(groups, "id", "left").withColumn("group", F.coalesce("component", "id"))
    per = stages.put(per.select("k1", "k2", "n_links", "group", "least"), "judged")
    component = per.groupBy("group").agg(F.min("least").alias("component"))
    per = per.join(component, "group").select("k1", "k2", "n_links", "component")
    out = rows.join(per, ["k1", "k2"], "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
    )
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id")).withColumn("audited_recall", F.lit(recall))
