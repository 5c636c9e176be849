"""Contracted roads against Dijkstra on the whole network."""

import heapq
import random

import pytest

from terrane.operators import graph, roads


def plain(segments, source):
    near = {}
    for a, b, w in segments:
        if a != b:
            near.setdefault(a, []).append((b, w))
            near.setdefault(b, []).append((a, w))
    best, todo = {}, [(0.0, source)]
    while todo:
        cost, node = heapq.heappop(todo)
        if node not in best:
            best[node] = cost
            for b, w in near.get(node, []):
                heapq.heappush(todo, (cost + w, b))
    return best


def network(seed):
    """Chains, rings with and without a junction, stubs, doubled segments, loops of one node, several parts."""
    rng = random.Random(seed)
    out, n = [], 0
    for _ in range(3):
        hubs = list(range(n, n + 4))
        n += 4
        for _ in range(6):
            a, b, inner = rng.choice(hubs), rng.choice(hubs), rng.randint(0, 6)
            chain = [a, *range(n, n + inner), b]
            n += inner
            out += [(p, q, float(rng.randint(1, 9))) for p, q in zip(chain, chain[1:], strict=False)]
    ring = [*range(n, n + 5), n]
    out += [(p, q, 2.0) for p, q in zip(ring, ring[1:], strict=False)]
    return [*out, (out[0][0], out[0][1], 20.0), (1, 1, 3.0)]


@pytest.mark.parametrize("seed", [1, 2])
def test_contracted_ways(spark, seed):
    segments = network(seed)
    df = spark.createDataFrame(segments, "a long, b long, w double").repartition(3)
    net = roads.contract(df)
    nodes = sorted({x for a, b, _ in segments if a != b for x in (a, b)})
    pairs = spark.createDataFrame([(o, d) for o in nodes for d in nodes], "o long, d long")
    got = {(r["o"], r["d"]): r["metres"] for r in roads.ways(net, pairs).collect()}
    assert got == {(o, d): w for o in nodes for d, w in plain(segments, o).items()}
    degree = {x: len({a if b == x else b for a, b, _ in segments if x in (a, b) and a != b}) for x in nodes}
    assert {r["node"] for r in net.access.where("chain IS NULL").collect()} >= {x for x in nodes if degree[x] != 2}
    assert net.access.where("chain IS NULL").count() < len(nodes)
    both = df.unionByName(df.selectExpr("b AS a", "a AS b", "w")).where("a <> b")
    whole = {r["node"]: r["cost"] for r in graph.shortest(both, spark.createDataFrame([(0,)], "source long")).collect()}
    assert whole == {d: w for (o, d), w in got.items() if o == 0}


def test_ways_within_a_reach(spark):
    df = spark.createDataFrame([(k, k + 1, 10.0) for k in range(6)] + [(2, 9, 1.0), (4, 10, 1.0)], "a long, b long, w double")
    got = {(r["o"], r["d"]): r["metres"] for r in roads.ways(roads.contract(df), spark.createDataFrame([(0, 5), (0, 2), (0, 77)], "o long, d long"), 30.0).collect()}
    assert got == {(0, 5): None, (0, 2): 20.0}


def test_safeguards(spark):
    df = spark.createDataFrame([(1, 2, 10_000.0), (3, 4, 500.0)], "a long, b long, w double")
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 400.0, 0.0), (3, 5000.0, 0.0), (4, 5400.0, 0.0)], "id long, x double, y double")
    rows = [("far", 0.0, 0.0, 400.0, 0.0, 400.0), ("apart", 0.0, 0.0, 5000.0, 0.0, 5000.0), ("near", 5000.0, 0.0, 5010.0, 0.0, 10.0), ("road", 5000.0, 0.0, 5400.0, 0.0, 400.0)]
    trips = spark.createDataFrame(rows, "id string, ox double, oy double, dx double, dy double, beeline double")
    got = {r["id"]: (r["distance"], r["seconds"], r["source"]) for r in roads.road_impedance(roads.contract(df), nodes, trips).collect()}
    assert got == {"far": (1400, 126, "road"), "apart": (6500, 585, "beeline"), "near": (150, 45, "road"), "road": (500, 45, "road")}
