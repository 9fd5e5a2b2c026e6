"""Spatial graphs: range joins on a k-d partition, accumulation, balance, components."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import physics as P
from quern.sources.shared import cut, fresh

from . import space as S
from .components import components  # noqa: F401

#: Nodes of a leaf in which pairs are sought, and of a part of the graph that is contracted.
PER_LEAF, PART = 4096, 16384
#: Edges of a contracted graph that one task may hold, and the share of the edges before it beyond which contraction is no help.
BLOCK, SHRINKS = 2_000_000, 0.7
#: Links a node from which on a graph is dense: most nodes of a part are entries then. Totals up to which they are broadcast, 16 bytes each.
DENSE, SMALL = 16, 1_000_000
#: In place of a link's other part: the link is inside its part, or it is no link but marks an entry.
INSIDE, ENTRY = -2, -1


def within(nodes: DataFrame, reach: float, pair: Column | None = None) -> DataFrame:
    """Ordered pairs of nodes (id, x, y, ...) nearer than ``reach``: a, b prefixes the columns of each side.

    Nodes are parted by a k-d tree, and each is copied to the leaves that its reach meets; inside a leaf an equi-join on grid cells as wide as the
    reach finds the pairs: a node looks into the nine cells around it. A leaf of many nodes in one place is dealt out by id, with the copies repeated.
    """
    known = S.tree(nodes, PER_LEAF)
    cell = lambda c, d: F.floor(F.col(c) / reach) + d
    steps = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    a = nodes.select(*[F.col(c).alias(f"a_{c}") for c in nodes.columns], cell("x", 0).alias("cx"), cell("y", 0).alias("cy"))
    b = nodes.select(*[F.col(c).alias(f"b_{c}") for c in nodes.columns], cell("x", 0).alias("cx"), cell("y", 0).alias("cy"))
    on = ["cx", "cy"]
    if known.depth:
        on = ["leaf", "deal", *on]
        a = a.withColumn("leaf", S.leaf(nodes, known, "a_x", "a_y"))
        deals = a.groupBy("leaf").agg(F.ceil(F.count("*") / (4 * PER_LEAF)).cast("int").alias("deals"))  # at most 65,536 rows
        a = a.join(F.broadcast(deals), "leaf").withColumn("deal", F.pmod(F.xxhash64("a_id"), F.col("deals")).cast("int")).drop("deals")
        b = b.withColumn("leaf", F.explode(S.around(nodes, known, reach, "b_x", "b_y"))).join(F.broadcast(deals), "leaf")
        b = b.withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1))).drop("deals")
    a = a.withColumn("cx", F.explode(F.transform(steps, lambda d: F.col("cx") + d))).withColumn("cy", F.explode(F.transform(steps, lambda d: F.col("cy") + d)))
    near = a.join(b, on).drop(*on).withColumn("distance", P.distance(F.col("a_x"), F.col("a_y"), F.col("b_x"), F.col("b_y")))
    near = near.where((F.col("a_id") != F.col("b_id")) & (F.col("distance") < reach))
    return near.where(pair) if pair is not None else near


def river(nodes: DataFrame, reach: float, lowest: float = 1e-4, highest: float = 0.1, once: bool = False) -> DataFrame:
    """Downhill edges; with ``once`` only from the lower to the higher id."""
    slope = (F.col("a_elevation") - F.col("b_elevation")) / (F.col("distance") * 1000)
    near = within(nodes, reach).where(F.col("b_elevation") < F.col("a_elevation")).withColumn("slope", slope)
    near = near.where(F.col("a_id") < F.col("b_id")) if once else near.where((F.col("slope") > lowest) & (F.col("slope") < highest))
    return near


def karst(nodes: DataFrame, reach: float, least: float) -> DataFrame:
    """Edges between karst nodes (the filter comes before the join)."""
    return within(nodes.where(F.col("karst") > least), reach)


def accumulate(nodes: DataFrame, edges: DataFrame, value: str, most: int | None = None) -> DataFrame:
    """id, total: each node's value, and everything that flows into it, once a path.

    Level by level: what arrived in one round moves on along the edges in the next, summed by node, until nothing moves. With ``most``,
    flow that moves on after so many levels is an error.
    """
    moving = nodes.select("id", F.col(value).alias("v"))
    rounds = [moving]
    out = edges.select(F.col("a_id").alias("id"), F.col("b_id").alias("to"))
    while True:
        moving = moving.join(out, "id").groupBy(F.col("to").alias("id")).agg(F.sum("v").alias("v"))
        moving = cut(moving)
        if moving.isEmpty():
            break
        if most is not None and len(rounds) > most:
            raise RuntimeError(f"flow still moves after {most} levels")
        rounds.append(moving)
    every = rounds[0]
    for r in rounds[1:]:
        every = every.union(r)
    return every.groupBy("id").agg(F.sum("v").alias("total"))


def accumulate_down(nodes: DataFrame, edges: DataFrame, value: str, height: str) -> DataFrame:
    """The same for edges between places (a_x, a_y, b_x, b_y) that all lead to a lower ``height`` (a_height, b_height), however long the paths are.

    The graph is contracted. Nodes are parted by place. A part's nodes that edges of other parts lead to are its entries; each part works out by itself
    what reaches the entries of other parts from its own nodes, and how much of one unit at each of its entries does. These sums are a graph of entries
    alone, whose parts are the old ones put together: it is solved in the same way, and what then enters each part is walked through it once more.
    Where nodes have more than ``DENSE`` links on average, the graph is walked by bands of heights instead. What is left in the end fits in one part of at most ``BLOCK`` edges. Where entries are as many as edges were, flow moves level by level instead.
    """
    rows = cut(nodes.select("id", "x", "y", F.col(height).cast("double").alias("h"), F.col(value).cast("double").alias("v")))
    path = fresh(nodes.sparkSession, "links")
    ends = [F.col(f"{k}_{c}").alias(f"{k}{c}") for k in "ab" for c in "xy"]
    high, low = (F.col(f"{k}_{height}").cast("double").alias(name) for k, name in (("a", "high"), ("b", "low")))
    edges.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), high, low, *ends).write.parquet(path)
    links = nodes.sparkSession.read.schema(f"a {dict(nodes.dtypes)['id']}, b {dict(nodes.dtypes)['id']}, high double, low double, ax double, ay double, bx double, by double").parquet(path)
    n, many = links.count(), rows.count()
    if n > DENSE * many:
        return _by_bands(rows.select("id", "h", "v"), links.select("a", "b", "high", "low"), n, many)
    known = S.tree(rows, PART, nodes.sparkSession.sparkContext.defaultParallelism)
    at = lambda x, y: S.leaf(nodes, known, x, y) if known.depth else F.lit(0)
    rows = cut(rows.select("id", "h", "v", at("x", "y").alias("part")))
    return _solved(rows, cut(links.select("a", "b", F.lit(1.0).alias("w"), "low", at("ax", "ay").alias("pa"), at("bx", "by").alias("pb"))), known.depth)


def _by_bands(rows: DataFrame, links: DataFrame, n: int, many: int) -> DataFrame:
    """The same for ``n`` links (a, b, high, low: the heights of both) of ``many`` nodes (id, h, v), band by band of heights from the highest down.

    What the bands above send down is summed by node, by all tasks; inside a band, which holds at most ``BLOCK`` links, one task walks down. Of k bands
    each holds about one link in k * k, so that there are few.
    """
    k, kind = max(1, int(np.ceil((n / BLOCK) ** 0.5)), -(-many // BLOCK)), dict(rows.dtypes)["id"]
    while True:
        cuts = sorted(set(rows.approxQuantile("h", [i / k for i in range(1, k)], 0.05 / k)), reverse=True) if k > 1 else []
        band = lambda h, cuts=cuts: F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c > F.col(h))) if cuts else F.lit(0)
        # by a column, as a literal would be taken for a position where there are no cuts
        inside = links.where(band("high") == band("low")).select(band("high").alias("band")).groupBy("band").count().agg(F.max("count")).first()[0] or 0
        if inside <= BLOCK or k > 2 * many:  # bands of one height hold no link
            break
        k *= 2
    done: DataFrame | None = None
    for i in range(len(cuts) + 1):
        # the band's heights as bounds, which readers of files know to skip by; nodes without a height stand in the last band
        below = lambda h, i=i: F.col(h) < F.lit(cuts[i - 1]) if i else F.lit(True)
        there = lambda h, i=i, below=below: below(h) & (F.col(h) >= F.lit(cuts[i])) if i < len(cuts) else below(h) | F.col(h).isNull()
        own = rows.where(there("h"))
        if done is not None:
            above = F.broadcast(done) if many <= SMALL else done
            sent = links.where(there("low") & (F.col("high") >= cuts[i - 1])).select("a", "b").join(above, F.col("a") == F.col("id"))
            sent = sent.groupBy(F.col("b").alias("id")).agg(F.sum("total").alias("more"))
            own = own.join(sent, "id", "left").select("id", "h", (F.col("v") + F.coalesce("more", F.lit(0.0))).alias("v"))
        inner = links.where(there("low") & there("high")).select("a", "b", F.lit(1.0).alias("w"), F.lit(0).alias("pa"), F.lit(0).alias("pb"))
        found = cut(_solved(own.withColumn("part", F.lit(0)), inner, 0).select(F.col("id").cast(kind).alias("id"), "total"))
        done = found if done is None else done.union(found)
    return done


def _solved(rows: DataFrame, links: DataFrame, depth: int) -> DataFrame:
    """id, total of nodes (id, h, v, part) with weighted links (a, b, w, low, pa, pb); parts have ``depth`` bits."""
    inner = links.where("pa = pb").select(F.col("pa").alias("part"), "a", "b", "w")
    totals = lambda r: r.groupBy("part").cogroup(inner.groupBy("part")).applyInPandas(_walk, "id long, total double")
    if not depth:
        return totals(rows)
    across = links.where("pa != pb")
    tasks = inner.withColumn("low", F.lit(0.0)).withColumn("pb", F.lit(INSIDE))
    tasks = tasks.union(across.select(F.col("pa").alias("part"), "a", "b", "w", "low", "pb"))
    entered = across.select(F.col("pb").alias("part"), F.col("b").alias("a"), "b", F.lit(0.0).alias("w"), F.lit(0.0).alias("low"), F.lit(ENTRY).alias("pb"))
    tasks = tasks.union(entered.distinct())
    passed = cut(rows.groupBy("part").cogroup(tasks.groupBy("part")).applyInPandas(_condense, "part int, a long, b long, w double, low double, pb int"))
    entries = passed.where("a is null").groupBy(F.col("b").alias("id")).agg(F.max("low").alias("h"), F.sum("w").alias("v"), F.max("pb").alias("part"))
    joins = passed.where("a is not null").select("a", "b", "w", "low", F.col("part").alias("pa"), "pb")
    n, before, many = joins.count(), links.count(), entries.count()
    if n > BLOCK and n > before * SHRINKS:
        arrived = _by_level(entries, joins)
    else:
        left = 0 if n <= BLOCK else min(depth - 1, int(-(-many // PART) - 1).bit_length())
        up = lambda c: F.shiftright(F.col(c), depth - left)
        arrived = _solved(
            cut(entries.withColumn("part", up("part"))),
            joins.withColumn("pa", up("pa")).withColumn("pb", up("pb")),
            left,
        )
    arrived = arrived.select("id", F.col("total").alias("more"))
    return totals(rows.join(arrived, "id", "left").select("id", "h", (F.col("v") + F.coalesce("more", F.lit(0.0))).alias("v"), "part"))


def _by_level(rows: DataFrame, links: DataFrame) -> DataFrame:
    """The same by rounds: what arrived in one moves on in the next, until nothing moves."""
    moving = cut(rows.select("id", F.col("v").alias("total")))
    rounds = [moving]
    while True:
        moved = moving.join(links, F.col("id") == F.col("a")).groupBy(F.col("b").alias("id")).agg(F.sum(F.col("total") * F.col("w")).alias("total"))
        moving = cut(moved)
        if moving.isEmpty():
            break
        rounds.append(moving)
    every = rounds[0]
    for r in rounds[1:]:
        every = every.union(r)
    return every.groupBy("id").agg(F.sum("total").alias("total"))


class _Part:
    """A part's nodes from the highest down, and its links by source; equal links are one."""

    def __init__(self, nodes: pd.DataFrame, links: pd.DataFrame):
        nodes = nodes.iloc[np.lexsort((nodes["id"].to_numpy(), -nodes["h"].to_numpy()))]
        self.ids, self.v = nodes["id"].to_numpy(), nodes["v"].to_numpy(np.float64)
        self.by_id = np.argsort(self.ids, kind="stable")
        a, b = self.place(links["a"].to_numpy(np.int64)), self.place(links["b"].to_numpy(np.int64))
        key, at = np.unique(a * len(self.ids) + b, return_inverse=True)
        self.w = np.bincount(at, links["w"].to_numpy(np.float64), len(key))
        self.src, self.dst = (key // len(self.ids), key % len(self.ids)) if len(key) else (key, key)
        starts = np.flatnonzero(np.diff(self.src, prepend=-1))
        self.spans = list(zip(starts.tolist(), np.append(starts, len(key))[1:].tolist(), strict=True))

    def place(self, ids: np.ndarray) -> np.ndarray:
        return self.by_id[np.searchsorted(self.ids, ids, sorter=self.by_id)] if len(ids) else np.empty(0, np.int64)

    def down(self, total: np.ndarray) -> np.ndarray:
        """Moves what each node has (a number or a row) along the links, from the highest node down."""
        wide = (slice(None), None) if total.ndim > 1 else slice(None)
        for lo, hi in self.spans:
            now = total[self.src[lo]]
            if now.any():
                total[self.dst[lo:hi]] += self.w[lo:hi][wide] * now
        return total


def _walk(nodes: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
    part = _Part(nodes, links)
    return pd.DataFrame({"id": part.ids, "total": part.down(part.v.copy())})


def _condense(nodes: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
    """What reaches other parts' entries b: from the part's own values (a is null), and of one unit at each entry a."""
    inner, out, entered = links[links["pb"] == INSIDE], links[links["pb"] >= 0], links[links["pb"] == ENTRY]
    part = _Part(nodes, inner)
    entries = np.sort(part.place(entered["b"].to_numpy(np.int64)))
    goals, first, goal = np.unique(out["b"].to_numpy(np.int64), return_index=True, return_inverse=True)
    low, pb, w, exit_ = out["low"].to_numpy()[first], out["pb"].to_numpy()[first], out["w"].to_numpy(np.float64), part.place(out["a"].to_numpy(np.int64))
    own = np.bincount(goal, w * part.down(part.v.copy())[exit_], len(goals))
    found = [(np.full(len(goals), -1), np.arange(len(goals)), own)]
    for lo in range(0, len(entries) if len(goals) else 0, 128):
        some = entries[lo : lo + 128]
        unit = np.zeros((len(part.ids), len(some)))
        unit[some, np.arange(len(some))] = 1.0
        part.down(unit)
        sums = np.zeros((len(goals), len(some)))
        np.add.at(sums, goal, w[:, None] * unit[exit_])
        g, e = np.nonzero(sums)
        found.append((some[e], g, sums[g, e]))
    a, g, w = (np.concatenate(c) for c in zip(*found, strict=True))
    names = pd.array(np.where(a >= 0, part.ids[a], 0) if len(part.ids) else a, dtype="Int64")
    names[a < 0] = pd.NA
    k = nodes["part"].iloc[0] if len(nodes) else links["part"].iloc[0] if len(links) else 0
    return pd.DataFrame({"part": k, "a": names, "b": goals[g], "w": w, "low": low[g], "pb": pb[g].astype(np.int32)})


def balance(nodes: DataFrame, edges: DataFrame, flow: str) -> DataFrame:
    """id, inflow, outflow, residual: sums over edges (src, dst), 0 where there are none."""
    into = edges.groupBy(F.col("dst").alias("id")).agg(F.sum(flow).alias("inflow"))
    out = edges.groupBy(F.col("src").alias("id")).agg(F.sum(flow).alias("outflow"))
    both = nodes.select("id").join(into, "id", "left").join(out, "id", "left").fillna(0.0, ["inflow", "outflow"])
    gap = F.abs(F.col("inflow") - F.col("outflow"))
    return both.withColumn("residual", gap).withColumn("relative", gap / (F.col("inflow") + F.col("outflow") + 1e-6))


def statistics(n_nodes: int, edges: DataFrame) -> DataFrame:
    """n_nodes, n_edges, mean_degree, density of a directed graph in which parallel edges count once."""
    e = edges.select("src", "dst").distinct().agg(F.count("*").alias("n_edges"))
    return e.select(
        F.lit(n_nodes).cast("long").alias("n_nodes"),
        "n_edges",
        (2 * F.col("n_edges") / F.lit(float(max(n_nodes, 1)))).alias("mean_degree"),
        (F.col("n_edges") / F.lit(float(max(n_nodes * (n_nodes - 1), 1)))).alias("density"),
    )
