"""Layered layout of graphs: arcs turned so that no cycle is left, ranks, orders within ranks by barycentres, crossings.

1. Arcs within a strong component that go against the order of nodes are turned round: what is left has no cycle.
2. A node's rank is the longest path to it; nodes without predecessors then move towards their nearest successor.
3. An arc over several ranks becomes a chain of places, one in each rank between, so that every piece joins neighbouring ranks.
4. Sweeps down and up order each rank by the mean place of the neighbours in the rank before; the best order seen is kept.

Crossings of the pieces between two ranks are inversions: pieces sorted by their upper end, counted by their lower. They are counted in cells of
CELL by CELL places by merging sorted halves: within a stripe of cells in the stripe's task, between cells over a table of their counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discarded, stored
from .graphs import strong_components, topological_levels
from .numbering import placed

#: Places of a stripe of a rank that one task counts.
CELL = 4096


def acyclic(arcs: DataFrame) -> DataFrame:
    """[G-11] (u, v, turned) of arcs (u, v), each once and without loops; where the two ways of an arc meet, it counts as not turned."""
    given = stored(arcs.select("u", "v").where("u <> v").distinct(), "arcs")
    parts = strong_components(given)
    ends = parts.select(F.col("node").alias("u"), F.col("component").alias("cu")), parts.select(F.col("node").alias("v"), F.col("component").alias("cv"))
    back = (F.col("cu") == F.col("cv")) & (F.col("u") > F.col("v"))
    both = given.join(ends[0], "u").join(ends[1], "v").select(F.when(back, F.col("v")).otherwise(F.col("u")).alias("u"), F.when(back, F.col("u")).otherwise(F.col("v")).alias("v"), back.alias("turned"))
    return both.groupBy("u", "v").agg(F.bool_and("turned").alias("turned"))


def ranks(arcs: DataFrame) -> DataFrame:
    """[G-11] (node, rank) for arcs (u, v) without cycles; a source stands one rank above its nearest successor."""
    levels = stored(topological_levels(arcs), "levels")
    ahead = arcs.join(levels, F.col("v") == F.col("node")).groupBy("u").agg((F.min("level") - 1).alias("nearest"))
    return levels.join(ahead, F.col("node") == F.col("u"), "left").select("node", F.when(F.col("level") == 0, F.coalesce("nearest", "level")).otherwise(F.col("level")).alias("rank"))


def pieces(arcs: DataFrame, ranked: DataFrame) -> DataFrame:
    """[G-11] (rank, a, b): pieces from rank to rank + 1 between places, structs (node, via, step): a node itself (via null, step 0), or the step of the arc
    node -> via."""
    kind = dict(ranked.dtypes)["node"]
    ends = arcs.select("u", "v").join(ranked.select(F.col("node").alias("u"), F.col("rank").alias("ru")), "u").join(ranked.select(F.col("node").alias("v"), F.col("rank").alias("rv")), "v")
    steps = ends.select("u", "v", "ru", "rv", F.explode(F.sequence(F.col("ru"), F.col("rv") - 1)).alias("rank"))

    def place(rank):
        node = F.when(rank == F.col("rv"), F.col("v")).otherwise(F.col("u"))
        between = (rank > F.col("ru")) & (rank < F.col("rv"))
        return F.struct(node.alias("node"), F.when(between, F.col("v")).cast(kind).alias("via"), F.when(between, rank - F.col("ru")).otherwise(0).alias("step"))

    return steps.select("rank", place(F.col("rank")).alias("a"), place(F.col("rank") + 1).alias("b"))


def first_order(joined: DataFrame, ranked: DataFrame) -> DataFrame:
    """[G-11] (rank, place, at): places of each rank in the order of their nodes, at from 1."""
    kind = dict(ranked.dtypes)["node"]
    alone = ranked.select("rank", F.struct("node", F.lit(None).cast(kind).alias("via"), F.lit(0).alias("step")).alias("place"))
    every = alone.union(joined.select("rank", F.col("a").alias("place"))).union(joined.select(F.col("rank") + 1, F.col("b").alias("place"))).distinct()
    return placed(every, ["rank"], [F.col("place")], "at")


def inversions(y: np.ndarray, weight: np.ndarray) -> int:
    """Sum over i < j with y[i] > y[j] of weight[i] * weight[j]: sorted halves merged, from pairs of rows up, all pairs of halves at once."""
    n = len(y)
    if n < 2:
        return 0
    size, total, at = 1, 0, np.arange(n)
    y, weight = np.asarray(y, np.int64), np.asarray(weight, np.int64)
    order = np.arange(n)  # rows in blocks of `size`, sorted by y within each
    while size < n:
        block = at // (2 * size)
        right = (order // size) % 2 == 1
        merged = np.lexsort((order, y[order], block))  # equal values of the left half come first
        order, right = order[merged], right[merged]
        left_weight = np.where(right, 0, weight[order])
        before = np.cumsum(left_weight)
        base = np.concatenate([[0], before])[block * 2 * size]
        all_left = np.concatenate([[0], before])[np.minimum((block + 1) * 2 * size, n)] - base
        total += int((weight[order] * np.where(right, all_left - (before - base), 0)).sum())
        size *= 2
    return total


def _stripe_inversions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rank, sign, n) of each stripe: rows come by rank, stripe and x, y."""
    key, held = None, []

    def emit() -> pa.RecordBatch:
        y, w = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[3]], pa.int64()), pa.array([inversions(y, w)], pa.int64())], ["rank", "sign", "n"])

    for batch in batches:
        columns = [batch.column(c).to_numpy() for c in ("rank", "i", "j", "sign", "y", "w")]
        keys = np.stack(columns[:4])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if lo == hi:
                continue
            own = tuple(keys[:, lo].tolist())
            if own != key and held:
                yield emit()
                held = []
            key = own
            held.append((columns[4][lo:hi], columns[5][lo:hi]))
    if held:
        yield emit()


def crossings(joined: DataFrame, order: DataFrame, cell: int | None = None) -> DataFrame:
    """[G-11] (rank, crossings) of the pieces (rank, a, b) between rank and the next, with places as in order (rank, place, at); a piece that comes
    twice counts twice. Ranks without crossings are there with 0."""
    cell = cell or CELL
    upper = order.select("rank", F.col("place").alias("a"), F.col("at").alias("x"))
    lower = order.select((F.col("rank") - 1).alias("rank"), F.col("place").alias("b"), F.col("at").alias("y"))
    rows = joined.join(upper, ["rank", "a"]).join(lower, ["rank", "b"]).groupBy(F.col("rank").cast("long").alias("rank"), "x", "y").agg(F.count("*").alias("w"))
    rows = stored(rows.select("rank", "x", "y", "w", F.floor((F.col("x") - 1) / cell).cast("long").alias("i"), F.floor((F.col("y") - 1) / cell).cast("long").alias("j")), "piece_places")
    # pairs within a stripe of either direction, and within a cell, which is in both
    none = F.lit(-1).cast("long")
    stripes = rows.select("rank", "i", none.alias("j"), F.lit(1).cast("long").alias("sign"), "x", "y", "w")
    stripes = stripes.union(rows.select("rank", none, "j", F.lit(1).cast("long"), "x", "y", "w")).union(rows.select("rank", "i", "j", F.lit(-1).cast("long"), "x", "y", "w"))
    # pairs of cells that differ in both: inversions of a table of cells in the order of i, j, as pairs of one i or one j are in order there
    cells = rows.groupBy("rank", "i", "j").agg(F.sum("w").alias("w"))
    stripes = stripes.union(cells.select("rank", none, none, F.lit(1).cast("long"), "i", "j", "w"))
    stripes = stripes.repartition("rank", "i", "j", "sign").sortWithinPartitions("rank", "i", "j", "sign", "x", "y")
    within = stripes.mapInArrow(_stripe_inversions, "rank long, sign long, n long").select("rank", (F.col("sign") * F.col("n")).alias("n"))
    zero = rows.select("rank", F.lit(0).cast("long").alias("n")).distinct()
    return within.union(zero).groupBy("rank").agg(F.sum("n").alias("crossings"))


def _swept(joined: DataFrame, order: DataFrame, down: bool) -> DataFrame:
    """The order after one sweep: places by the mean place of their neighbours in the rank before, those without keep their own."""
    last = order.agg(F.max("rank"), F.min("rank")).first()
    turn = range(last[1] + 1, last[0] + 1) if down else range(last[0] - 1, last[1] - 1, -1)
    fixed = order.where(F.col("rank") == (last[1] if down else last[0]))
    done = [fixed]
    for rank in turn:
        near, own, at = ("a", "b", rank - 1) if down else ("b", "a", rank)
        beside = joined.where(F.col("rank") == at).select(F.col(near).alias("place"), F.col(own).alias("own"))
        means = beside.join(fixed.select("place", "at"), "place").groupBy("own").agg(F.avg("at").alias("mean"))
        level = order.where(F.col("rank") == rank).join(means, F.col("place") == F.col("own"), "left").select("rank", "place", F.coalesce("mean", F.col("at").cast("double")).alias("mean"), F.col("at").alias("old"))
        fixed = stored(placed(level, ["rank"], [F.col("mean"), F.col("old")], "at").select("rank", "place", "at"), "swept")
        done.append(fixed)
    out = done[0]
    for part in done[1:]:
        out = out.union(part)
    return stored(out, "order")


def ordered_layers(joined: DataFrame, order: DataFrame, sweeps: int = 4) -> tuple[DataFrame, int]:
    """[G-11] The best order (rank, place, at) that sweeps from the given one find, and its crossings: never more than at first. Sweeps end when
    `sweeps` in turn have found nothing better."""
    total = lambda o: crossings(joined, o).agg(F.sum("crossings")).first()[0] or 0
    best, least, now, idle, turn = order, total(order), order, 0, 0
    while idle < sweeps and least:
        swept = _swept(joined, now, turn % 2 == 0)
        if now is not best:
            discarded(now)
        now, found = swept, total(swept)
        turn, idle = turn + 1, 0 if found < least else idle + 1
        if found < least:
            best, least = now, found
    return best, least


def layout(arcs: DataFrame, sweeps: int = 4) -> DataFrame:
    """[G-11] (node, rank, at) of the nodes of arcs (u, v)."""
    free = stored(acyclic(arcs), "acyclic")
    ranked = stored(ranks(free), "ranks")
    joined = stored(pieces(free, ranked), "pieces")
    order, _ = ordered_layers(joined, stored(first_order(joined, ranked), "order"), sweeps)
    # places of chains go; nodes close up
    return placed(order.where("place.step = 0").select(F.col("place.node").alias("node"), "rank", F.col("at").alias("old")), ["rank"], [F.col("old")], "at").drop("old")
