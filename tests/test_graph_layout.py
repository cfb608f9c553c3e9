"""Numbering, all pairs of distances, layers and crossings against plain versions."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import graphs as G
from millrace.operators import layout as Y
from millrace.operators.numbering import placed


def test_placed_numbers_groups_that_span_partitions(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", "a", "a", "b", None, "c"]), r.randint(0, 400), i) for i in range(3000)]
    got = placed(spark.createDataFrame(rows, "g string, v int, i int"), ["g"], [F.desc("v"), F.col("i")]).collect()
    groups = {}
    for g, v, i in sorted(rows, key=lambda x: (-x[1], x[2])):
        groups.setdefault(g, []).append((g, v, i))
    assert sorted(map(str, (tuple(x) for x in got))) == sorted(str((*x, n)) for g in groups.values() for n, x in enumerate(g, 1))
    assert {x.place for x in placed(spark.range(50), [], [F.desc("id")]).where("id = 49 or id = 0").collect()} == {1, 50}
    assert placed(spark.range(0), [], [F.col("id")]).count() == 0


def plain_distances(edges, nodes):
    d = {(u, v): 0.0 if u == v else float("inf") for u in nodes for v in nodes}
    for u, v, w in edges:
        d[u, v] = min(d[u, v], w)
    for k in nodes:
        for i in nodes:
            for j in nodes:
                d[i, j] = min(d[i, j], d[i, k] + d[k, j])
    return {k: v for k, v in d.items() if v < float("inf")}


@pytest.mark.parametrize("negative", [False, True])
def test_all_pairs_and_single_sources(spark, negative):
    r = random.Random(3)
    lift = {n: r.randint(0, 30) if negative else 0 for n in range(23)}
    edges = [(u, v, float(r.randint(0, 20) + lift[u] - lift[v])) for _ in range(60) for u, v in [(r.randrange(23), r.randrange(23))]]
    nodes = sorted({x for u, v, _ in edges for x in (u, v)})
    want, table = plain_distances(edges, nodes), spark.createDataFrame(edges, "u long, v long, w double")
    assert {(x.source, x.node): x.distance for x in G.all_pairs(table, size=5).collect()} == want
    sources = spark.createDataFrame([(nodes[0],), (nodes[5],)], "node long")
    assert {(x.source, x.node): x.distance for x in G.shortest_paths(table, sources).collect()} == {k: v for k, v in want.items() if k[0] in (nodes[0], nodes[5])}


def test_negative_cycles_raise(spark):
    bad = spark.createDataFrame([(1, 2, 1.0), (2, 3, -4.0), (3, 1, 2.0), (3, 4, 1.0)], "u long, v long, w double")
    with pytest.raises(ValueError, match="negative cycle"):
        G.all_pairs(bad)
    with pytest.raises(ValueError, match="negative cycle"):
        G.shortest_paths(bad, spark.createDataFrame([(1,)], "node long"))


def test_inversions_by_merging():
    r = np.random.default_rng(4)
    for n in (0, 1, 2, 3, 17, 64, 200):
        y, w = r.integers(0, 30, n), r.integers(1, 4, n)
        assert Y.inversions(y, w) == sum(int(w[i] * w[j]) for i, j in combinations(range(n), 2) if y[i] > y[j])


def plain_crossings(pieces, at):
    found = {}
    for rank in {p[0] for p in pieces}:
        own = [(at[rank, a], at[rank + 1, b]) for q, a, b in pieces if q == rank]
        found[rank] = sum((a - c) * (b - d) < 0 for (a, b), (c, d) in combinations(own, 2))
    return found


@pytest.mark.parametrize("cell", [1, 3, 4096])
def test_crossings_in_cells(spark, cell):
    r = random.Random(5)
    arcs = [(u, v) for _ in range(70) for u, v in [(r.randrange(26), r.randrange(26))]]
    table = spark.createDataFrame(arcs, "u long, v long")
    free = Y.acyclic(table)
    rows = free.collect()
    assert {frozenset((x.u, x.v)) for x in rows} == {frozenset(a) for a in arcs if a[0] != a[1]}
    ranked = Y.ranks(free)
    rank = {x.node: x["rank"] for x in ranked.collect()}
    assert all(rank[x.u] < rank[x.v] for x in rows) and all(min(rank[x.v] for x in rows if x.u == u) == rank[u] + 1 for u in {x.u for x in rows} - {x.v for x in rows})
    joined = Y.pieces(free, ranked)
    pieces = [(p["rank"], tuple(p.a), tuple(p.b)) for p in joined.collect()]
    assert len(pieces) == sum(rank[x.v] - rank[x.u] for x in rows)
    order = Y.first_order(joined, ranked)
    at = {(o["rank"], tuple(o.place)): o.at for o in order.collect()}
    assert {c["rank"]: c.crossings for c in Y.crossings(joined, order, cell).collect()} == plain_crossings(pieces, at)


def test_sweeps_never_add_crossings(spark):
    r = random.Random(6)
    arcs = [(a, 100 + b) for a in range(8) for b in r.sample(range(9), 2)] + [(100 + b, 200 + c) for b in range(9) for c in r.sample(range(8), 2)] + [(0, 205), (3, 207)]
    table = spark.createDataFrame(arcs, "u long, v long")
    free = Y.acyclic(table)
    ranked = Y.ranks(free)
    joined = Y.pieces(free, ranked)
    order = Y.first_order(joined, ranked)
    first = sum(c.crossings for c in Y.crossings(joined, order).collect())
    best, least = Y.ordered_layers(joined, order, 2)
    at = {(o["rank"], tuple(o.place)): o.at for o in best.collect()}
    pieces = [(p["rank"], tuple(p.a), tuple(p.b)) for p in joined.collect()]
    assert sum(plain_crossings(pieces, at).values()) == least < first
    assert {k: 1 for k in at} == {(o["rank"], tuple(o.place)): 1 for o in order.collect()}
