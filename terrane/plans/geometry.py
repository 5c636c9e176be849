"""Queries on rings, distances, roads and layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.functions import geo as G
from terrane.operators import allocation as A
from terrane.operators import graph
from terrane.operators import relational as R
from terrane.plans.base import registry, shared, table
from terrane.plans.spatial import RING
from terrane.sources import readers, writers
from terrane.sources.scratch import folder

QUERIES, ORACLES, query = registry()

POINTS = "SELECT c_custkey AS id, c_custkey * 37 % 1000 / 10e0 AS x, c_custkey * 53 % 1000 / 10e0 AS y, c_custkey % 9 AS residents, c_custkey % 6 AS jobs FROM customer"
SIDES = "r(x1, y1, x2, y2) AS (VALUES " + ", ".join(f"({a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)" for a, b in zip(RING, RING[1:] + RING[:1], strict=True)) + ")"
IN_RING = "count(CASE WHEN (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 THEN 1 END) % 2 = 1"


NEAR = "least(greatest(((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / (pow(x2 - x1, 2) + pow(y2 - y1, 2)), 0), 1)"
ON_RING = f"min(sqrt(pow(x - x1 - {NEAR} * (x2 - x1), 2) + pow(y - y1 - {NEAR} * (y2 - y1), 2))) <= 0.001"


def ring():
    return F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in RING])


@query(f"WITH p AS ({POINTS} UNION ALL SELECT -1, 50, 15, 0, 0), {SIDES}, s AS (SELECT id, residents, jobs FROM p, r GROUP BY id, x, y, residents, jobs HAVING {IN_RING} OR {ON_RING}), t AS (SELECT count(*) AS points, sum(residents) AS residents, sum(jobs) AS jobs FROM s) SELECT points, CAST(residents AS BIGINT) AS residents, CAST(jobs AS BIGINT) AS jobs, (jobs - residents) / (jobs + residents) AS balance, residents / (SELECT sum(residents) FROM p) AS share FROM t")
def polygon_selection(spark, sf):
    """Points a ring holds, one of them on its border: totals, balance and share."""
    border = spark.createDataFrame([(-1, 50.0, 15.0, 0, 0)], "id long, x double, y double, residents long, jobs long")  # on the side from (10, 10) to (90, 20)
    p = shared(spark, sf, POINTS).unionByName(border)
    s = p.where(G.ring_contains(ring(), F.col("x"), F.col("y"))).agg(F.count("*").alias("points"), F.sum("residents").alias("residents"), F.sum("jobs").alias("jobs"))
    total = p.agg(F.sum("residents").alias("_t"))
    return s.join(total).select("points", "residents", "jobs", ((F.col("jobs") - F.col("residents")) / (F.col("jobs") + F.col("residents"))).alias("balance"), (F.col("residents") / F.col("_t")).alias("share"))


@query("SELECT s_suppkey AS id, CASE s_suppkey % 5 WHEN 1 THEN 'crossing sides' WHEN 2 THEN 'too few vertices' WHEN 3 THEN 'repeated vertex' WHEN 4 THEN 'no area' END AS problem FROM supplier")
def ring_problems(spark, sf):
    """Rings round every supplier, of which one kind in five is simple."""
    kinds = (RING, [(0, 0), (10, 10), (10, 0), (0, 10)], [(0, 0), (1, 1)], [(0, 0), (5, 0), (5, 5), (5, 0)], [(0, 0), (5, 0), (10, 0)])
    k = F.col("s_suppkey")
    at = lambda ring: F.array(*[F.struct((F.lit(float(x)) + k % 100).alias("x"), (F.lit(float(y)) + k % 70).alias("y")) for x, y in ring])
    return table(spark, sf, "supplier").select(k.alias("id"), G.ring_problem(F.get(F.array(*map(at, kinds)), (k % 5).cast("int"))).alias("problem"))


@query(f"WITH p AS ({POINTS}) SELECT count(*) AS compared, CAST(sum(CASE WHEN x % 10 <= 6 AND y % 10 <= 7 THEN 1 ELSE 0 END) AS BIGINT) AS inside FROM p WHERE floor(x / 10) + floor(y / 10) <= 9")
def block_containment(spark, sf):
    """Points joined with the polygon of their block by key, and whether that covers them."""
    p = shared(spark, sf, POINTS).withColumns({"bx": F.floor(F.col("x") / 10), "by": F.floor(F.col("y") / 10)})
    v = lambda dx, dy: F.struct((F.col("bx") * 10 + dx).cast("double").alias("x"), (F.col("by") * 10 + dy).cast("double").alias("y"))
    blocks = spark.range(100).select((F.col("id") % 10).alias("bx"), F.floor(F.col("id") / 10).alias("by")).where("bx + by <= 9").withColumn("ring", F.array(v(0, 0), v(6, 0), v(6, 7), v(0, 7)))
    j = R.many_to_one(p, blocks, ["bx", "by"]).where("ring is not null")
    return j.agg(F.count("*").alias("compared"), F.sum(G.ring_contains(F.col("ring"), F.col("x"), F.col("y")).cast("long")).alias("inside"))


@query("SELECT r_regionkey AS id FROM region WHERE r_regionkey * 20 <= 47 AND r_regionkey * 20 + 15 >= 33")
def region_semijoin(spark, sf):
    """Regions whose box meets a studied area."""
    k = F.col("r_regionkey") * 20
    return table(spark, sf, "region").withColumns({"x1": k, "x2": k + 15}).where((F.col("x1") <= 47) & (F.col("x2") >= 33)).select(F.col("r_regionkey").alias("id"))


@query("SELECT s_suppkey AS id, round(CASE s_suppkey % 3 WHEN 0 THEN 111319.4908 WHEN 1 THEN 110574.3886 ELSE 0 END, 3)::DOUBLE AS metres FROM supplier")
def geodesic_metres(spark, sf):
    """One degree east at the equator, one degree north from it, and no distance, on the ellipsoid."""
    k = F.col("s_suppkey")
    lon2, lat2 = F.when(k % 3 == 0, 1.0).otherwise(0.0), F.when(k % 3 == 1, 1.0).otherwise(0.0)
    return table(spark, sf, "supplier").select(k.alias("id"), F.round(G.geodesic(F.lit(0.0), F.lit(0.0), lon2, lat2), 3).alias("metres"))


@query(f"WITH p AS ({POINTS}), m AS (SELECT avg(y / 10) AS lat FROM p) SELECT id, round(sqrt(pow((x / 10 - 5) * 111.32 * cos(radians(lat)), 2) + pow((y / 10 - 5) * 110.574, 2)), 6) AS km FROM p, m")
def city_scale_km(spark, sf):
    p = shared(spark, sf, POINTS)
    m = p.agg(F.avg(F.col("y") / 10).alias("lat"))
    km = G.flat_km(F.lit(5.0), F.lit(5.0), F.col("x") / 10, F.col("y") / 10, F.col("lat"))
    return p.join(F.broadcast(m)).select("id", F.round(km, 6).alias("km"))


@query(f"WITH p AS ({POINTS}), m AS (SELECT (min(y) + max(y)) / 20 AS lat FROM p) SELECT CAST(floor(6371008.8 * radians(x / 10) * cos(radians(lat)) / 50000) AS BIGINT) AS i, CAST(floor(6371008.8 * radians(y / 10) / 50000) AS BIGINT) AS j, CAST(sum(residents) AS BIGINT) AS residents, CAST(sum(jobs) AS BIGINT) AS jobs, count(*) AS points FROM p, m GROUP BY 1, 2")
def metric_cells(spark, sf):
    """Cells of 50 km in a projection anchored at the middle latitude."""
    p = shared(spark, sf, POINTS).withColumns({"lon": F.col("x") / 10, "lat": F.col("y") / 10})
    m = p.agg(((F.min("lat") + F.max("lat")) / 2).alias("ref"))
    q = p.join(F.broadcast(m)).withColumn("m", G.projected(F.col("lon"), F.col("lat"), F.col("ref")))
    return q.groupBy(F.floor(F.col("m.x") / 50000).cast("long").alias("i"), F.floor(F.col("m.y") / 50000).cast("long").alias("j")).agg(F.sum("residents").alias("residents"), F.sum("jobs").alias("jobs"), F.count("*").alias("points"))


ROADS = "SELECT n_nationkey AS a, (n_nationkey + 3) % 25 AS b, CAST(n_nationkey % 4 + 1 AS DOUBLE) AS w FROM nation UNION ALL SELECT n_nationkey, (n_nationkey + 7) % 25, CAST(5 + n_nationkey % 3 AS DOUBLE) FROM nation WHERE n_nationkey % 2 = 0"


@query(f"WITH RECURSIVE e AS ({ROADS}), w(source, node, cost, hops) AS (SELECT n_nationkey, n_nationkey, 0::DOUBLE, 0 FROM nation WHERE n_nationkey < 2 UNION SELECT source, b, min(cost + w), min(hops + 1) FROM w JOIN e ON a = node WHERE hops < 24 GROUP BY source, b, hops) SELECT source, node, min(cost) AS cost FROM w GROUP BY 1, 2")
def shortest_paths(spark, sf):
    """Road costs from two junctions to all they reach."""
    return graph.shortest(shared(spark, sf, ROADS), table(spark, sf, "nation").where("n_nationkey < 2").select(F.col("n_nationkey").alias("source")))


PAIRS = "SELECT s_suppkey AS o, s_nationkey AS d, CAST(s_suppkey * 91 % 7000 AS DOUBLE) AS beeline FROM supplier"


@query(f"WITH p AS ({PAIRS}), q AS (SELECT *, round_even(greatest(beeline, 150) * 1.3, 0) AS road FROM p) SELECT o, d, CAST(CASE WHEN o % 3 = 0 THEN beeline + 40 ELSE road END AS BIGINT) AS distance, CAST(CASE WHEN o % 3 = 0 THEN 77 ELSE greatest(45, round_even(road / (40 / 3.6), 0)) END AS BIGINT) AS seconds, CASE o % 3 WHEN 0 THEN 'route' WHEN 1 THEN 'refused' ELSE 'no route' END AS source FROM q")
def routed_lookup(spark, sf):
    """Pairs looked up in a routes table; routes shorter than the beeline are refused; the rest follows the beeline rule."""
    p = shared(spark, sf, PAIRS)
    routes = p.where("o % 3 < 2").select("o", "d", F.when(F.col("o") % 3 == 0, F.col("beeline") + 40).otherwise(-1.0).cast("long").alias("metres"), F.lit(77).cast("long").alias("seconds"))
    return A.routed(p, routes)


@query("SELECT c_nationkey AS o, CAST(count(*) * 3 AS BIGINT) AS travellers, true AS within FROM customer GROUP BY 1")
def two_layer_demand(spark, sf):
    """Two quotas, then a balance of the rest: every origin's travellers are placed, no cohort is larger than asked."""
    origins = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("o")).agg((F.count("*") * 3).alias("travellers"))
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("d"), (F.col("n_nationkey") % 7 + 1).alias("jobs"))
    edges = origins.select("o").join(nations.select("d")).where("o <> d").select("o", "d", F.exp(-0.1 * F.abs(F.col("o") - F.col("d"))).alias("w"))
    reach = origins.select("o", F.explode(F.array(F.lit("AIR_1"), F.lit("UNI_1"))).alias("d"), (F.col("o") * 1.0).alias("distance"))
    c = A.two_layers(edges, origins, nations, [("AIR_1", 60), ("UNI_1", 25)], reach, cohort=20, rounds=4)
    return c.groupBy("o").agg(F.sum("size").alias("travellers"), (F.max("size") <= 20).alias("within"))


@query(f"WITH p AS ({POINTS}) SELECT CAST(floor(x / 20) AS BIGINT) AS gx, CAST(floor(y / 20) AS BIGINT) AS gy, CAST(sum(residents) AS BIGINT) AS residents, count(*) AS points FROM p WHERE id % 10 <> 0 AND residents > 0 GROUP BY 1, 2")
def density_preview(spark, sf):
    """Residential density without the places that are configured apart (every tenth)."""
    p = shared(spark, sf, POINTS)
    special = p.where("id % 10 = 0").select("id")
    kept = p.where("residents > 0").join(special, "id", "left_anti")
    return kept.groupBy(F.floor(F.col("x") / 20).cast("long").alias("gx"), F.floor(F.col("y") / 20).cast("long").alias("gy")).agg(F.sum("residents").alias("residents"), F.count("*").alias("points"))


@query(f"WITH p AS ({POINTS}), {SIDES}, s AS (SELECT id, jobs FROM p, r WHERE jobs > 0 GROUP BY id, x, y, jobs HAVING {IN_RING}) SELECT count(*) AS establishments, CAST(sum(jobs) AS BIGINT) AS base, CAST(round_even(sum(jobs) * 1.5, 0) AS BIGINT) AS boosted, CAST(sum(CASE WHEN id % 10 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS places FROM s")
def affluence_inspect(spark, sf):
    """What a zone of a multiplier holds: establishments, jobs before and after, configured places."""
    p = shared(spark, sf, POINTS).where("jobs > 0").where(G.in_ring(F.col("x"), F.col("y"), RING))
    return p.agg(F.count("*").alias("establishments"), F.sum("jobs").alias("base"), F.bround(F.sum("jobs") * 1.5).cast("long").alias("boosted"), F.sum((F.col("id") % 10 == 0).cast("long")).alias("places"))


@query(f"WITH p AS ({POINTS}), a AS (SELECT id, residents AS m FROM p WHERE id % 7 <> 0), b AS (SELECT id, residents + id % 2 AS m FROM p WHERE id % 5 <> 0) SELECT CAST(sum(CASE WHEN a.id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS gained, CAST(sum(CASE WHEN b.id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS lost, CAST(sum(CASE WHEN a.id IS NOT NULL AND b.id IS NOT NULL THEN b.m - a.m ELSE 0 END) AS BIGINT) AS common_change, CAST(sum(coalesce(b.m, 0) - coalesce(a.m, 0)) AS BIGINT) AS change, 0::BIGINT AS unexplained FROM a FULL JOIN b ON a.id = b.id")
def placement_reconciliation(spark, sf):
    """Gained, lost and changed blocks explain the whole difference of two placements."""
    p = shared(spark, sf, POINTS)
    a = p.where("id % 7 <> 0").select("id", F.col("residents").alias("ma"))
    b = p.where("id % 5 <> 0").select("id", (F.col("residents") + F.col("id") % 2).alias("mb"))
    j = a.join(b, "id", "full_outer")
    gained, lost = F.col("ma").isNull(), F.col("mb").isNull()
    part = lambda test, c: F.sum(F.when(test, c).otherwise(0))
    s = j.agg(part(gained, F.lit(1)).cast("long").alias("gained"), part(lost, F.lit(1)).cast("long").alias("lost"), part(~gained & ~lost, F.col("mb") - F.col("ma")).alias("common_change"), part(gained, F.col("mb")).alias("_g"), part(lost, F.col("ma")).alias("_l"), F.sum(F.coalesce("mb", F.lit(0)) - F.coalesce("ma", F.lit(0))).alias("change"))
    return s.select("gained", "lost", "common_change", "change", (F.col("change") - F.col("_g") + F.col("_l") - F.col("common_change")).alias("unexplained"))


@query("SELECT s_suppkey AS config, CAST(CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN s_suppkey % 4 = 0 THEN 1 ELSE 0 END + CASE WHEN s_suppkey % 5 = 0 AND s_suppkey % 3 <> 0 THEN 2 ELSE 0 END AS BIGINT) AS problems FROM supplier")
def config_source(spark, sf):
    """Configurations of as many cities as there are suppliers, written as one line each, read and checked."""
    path = folder(spark, "config")
    city_configs(spark, sf).select(F.to_json(F.struct("config", "city", "zones", "pois"), {"ignoreNullFields": "false"}).alias("value")).write.text(path)
    rows = spark.read.text(path)
    found = readers.config_problems(rows.select(F.get_json_object("value", "$.config").cast("long").alias("config"), "value"), "config", "value")
    return found.select("config", F.size("problems").cast("long").alias("problems"))


def city_configs(spark, sf):
    """(config, city, zones, pois): every third with its box turned round, every fourth with a code too long, every fifth with a place given twice and undecided demand."""
    k = F.col("s_suppkey")
    west = F.lit(-99.0) + k % 50
    box = F.when(k % 3 == 0, F.array(west + 1, F.lit(19.0), west, F.lit(20.0))).otherwise(F.array(west, F.lit(19.0), west + 1, F.lit(20.0)))
    place = lambda name, jobs: F.struct(F.lit(name).alias("id"), F.array(west + 0.5, F.lit(19.5)).alias("loc"), jobs.cast("long").alias("jobs"))
    none = F.array().cast("array<struct<id: string, loc: array<double>, jobs: bigint>>")
    pois = F.when(k % 3 == 0, none).when(k % 5 == 0, F.array(place("a", F.lit(3)), place("a", F.lit(None)))).otherwise(F.array(place("c", k)))
    code = F.when(k % 4 == 0, "TOOLONG").otherwise("ABC")
    zones = F.array(F.struct(k.alias("id"), box.alias("bbox")))
    return table(spark, sf, "supplier").select(k.alias("config"), F.struct(box.alias("bbox"), code.alias("code")).alias("city"), zones.alias("zones"), pois.alias("pois"))


@query("SELECT count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS keys FROM customer")
def verified_cache(spark, sf):
    """A table made once, kept under the digest of its inputs, and checked when it is taken again."""
    root, c = folder(spark, "cache"), table(spark, sf, "customer").select("c_custkey")
    writers.cached_table(c, {"customer": "1"}, root)
    again = writers.cached_table(c.where("false"), {"customer": "1"}, root)
    return again.agg(F.count("*").alias("n"), F.sum("c_custkey").alias("keys"))


@query(f"WITH p AS ({POINTS}) SELECT id % 4 AS sector, CAST(sum(jobs) AS BIGINT) AS before, CAST(sum(CASE WHEN x <= 50 THEN jobs ELSE 0 END) AS BIGINT) AS captured, sum(CASE WHEN x <= 50 THEN jobs ELSE 0 END) / sum(jobs) AS share FROM p GROUP BY 1")
def sector_capture(spark, sf):
    """Jobs of a sector and how many of them the grid captures."""
    s = shared(spark, sf, POINTS).groupBy((F.col("id") % 4).alias("sector")).agg(F.sum("jobs").alias("before"), F.sum(F.when(F.col("x") <= 50, F.col("jobs")).otherwise(0)).alias("captured"))
    return s.withColumn("share", F.col("captured") / F.col("before"))


@query("WITH e AS (SELECT l_suppkey % 50 AS o, l_partkey % 50 AS d, CAST(l_quantity AS BIGINT) AS size FROM lineitem) SELECT CAST(sum(size) AS BIGINT) AS travellers, count(DISTINCT o) AS origins, count(DISTINCT o * 100 + d) AS pairs, CAST(sum(CASE WHEN o = d THEN size ELSE 0 END) AS BIGINT) AS internal, max(size) AS largest FROM e")
def dataset_totals(spark, sf):
    e = shared(spark, sf, "SELECT l_suppkey % 50 AS o, l_partkey % 50 AS d, CAST(l_quantity AS BIGINT) AS size FROM lineitem")
    p = e.groupBy("o", "d").agg(F.sum("size").alias("s"), F.max("size").alias("m"))
    return p.agg(F.sum("s").alias("travellers"), F.countDistinct("o").alias("origins"), F.count("*").alias("pairs"), F.sum(F.when(F.col("o") == F.col("d"), F.col("s")).otherwise(0)).alias("internal"), F.max("m").alias("largest"))
