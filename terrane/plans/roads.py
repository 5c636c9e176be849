"""Queries on a road network whose nodes are all suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.operators import roads as W
from terrane.plans.base import registry, shared

QUERIES, ORACLES, query = registry()

SPOTS = "SELECT s_suppkey AS id, s_suppkey * 37 % 1000 * 1e1 AS x, s_suppkey * 53 % 1000 * 1e1 AS y FROM supplier"
#: Chains of suppliers in turn, rungs between some of them, stubs, rings of four without a junction.
ROADS = """SELECT a.s_suppkey AS a, b.s_suppkey AS b, CAST(400 + a.s_suppkey * 71 % 900 AS DOUBLE) AS w FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1 WHERE a.s_suppkey % 40 < 34
UNION ALL SELECT a.s_suppkey, b.s_suppkey, CAST(700 + a.s_suppkey * 31 % 500 AS DOUBLE) FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 9 WHERE a.s_suppkey % 40 < 20 AND a.s_suppkey % 8 = 0
UNION ALL SELECT a.s_suppkey, b.s_suppkey, CAST(100 + a.s_suppkey % 7 AS DOUBLE) FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1 WHERE a.s_suppkey % 40 BETWEEN 35 AND 37
UNION ALL SELECT a.s_suppkey, b.s_suppkey, 50e0 FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 3 WHERE a.s_suppkey % 40 = 35"""
PLAIN = f"""e AS MATERIALIZED ({ROADS}), s AS MATERIALIZED (SELECT a, b, min(w) AS w FROM (SELECT a, b, w FROM e UNION ALL SELECT b, a, w FROM e) x GROUP BY a, b),
r(o, d, metres, hops) AS (SELECT DISTINCT a, a, 0::DOUBLE, 0 FROM s UNION SELECT o, b, min(metres + w), min(hops + 1) FROM r JOIN s ON s.a = r.d WHERE hops < 36 GROUP BY o, b, hops), m AS MATERIALIZED (SELECT o, d, min(metres) AS metres FROM r GROUP BY o, d)"""


@query(f"WITH RECURSIVE {PLAIN} SELECT * FROM m")
def road_ways(spark, sf):
    """Ways between all connected nodes on the contracted network; SQL walks the whole one."""
    network = W.contract(shared(spark, sf, ROADS))
    parts = network.parts
    pairs = parts.select(F.col("node").alias("o"), "part").join(parts.select(F.col("node").alias("d"), "part"), "part")
    return W.ways(network, pairs)


TRIPS = "SELECT c_custkey AS id, c_custkey * 41 % 1000 * 1e1 AS ox, c_custkey * 59 % 1000 * 1e1 AS oy, c_custkey * 23 % 1000 * 1e1 AS dx, c_custkey * 67 % 1000 * 1e1 AS dy FROM customer"
BEELINE = "SELECT *, sqrt(pow(dx - ox, 2) + pow(dy - oy, 2)) AS beeline FROM"


@query(f"""WITH RECURSIVE {PLAIN}, p AS ({SPOTS}), n AS (SELECT * FROM p WHERE id IN (SELECT a FROM s)), t AS ({BEELINE} ({TRIPS}) t),
c AS (SELECT t.id, beeline, n.id AS node, 'o' AS side, sqrt(pow(x - ox, 2) + pow(y - oy, 2)) AS far FROM t, n UNION ALL SELECT t.id, beeline, n.id, 'd', sqrt(pow(x - dx, 2) + pow(y - dy, 2)) FROM t, n),
k AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY id, side ORDER BY far, node) = 1), j AS (SELECT a.id, a.beeline, greatest(a.beeline, 150) AS least, a.far + b.far + metres AS road FROM k a JOIN k b ON a.id = b.id AND a.side = 'o' AND b.side = 'd' LEFT JOIN m ON m.o = a.node AND m.d = b.node),
f AS (SELECT id, CASE WHEN road IS NULL THEN round_even(least * 1.3, 0) ELSE least(greatest(road, least), 3.5 * least) END AS v, road IS NOT NULL AS on_road FROM j)
SELECT id, CAST(round_even(v, 0) AS BIGINT) AS distance, greatest(45, CAST(round_even(v / (40 / 3.6), 0) AS BIGINT)) AS seconds, CASE WHEN on_road THEN 'road' ELSE 'beeline' END AS source FROM f""")
def road_impedance(spark, sf):
    """Trips of customers over the roads: never under the beeline, never over three and a half times it, the beeline's rule where roads do not connect."""
    network = W.contract(shared(spark, sf, ROADS))
    nodes = shared(spark, sf, SPOTS).join(network.parts.select(F.col("node").alias("id")), "id", "left_semi")
    return W.road_impedance(network, nodes, shared(spark, sf, f"{BEELINE} ({TRIPS}) t"), start=600.0)
