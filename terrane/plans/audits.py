"""Checks, reports and small analyses."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.functions import geo as G
from terrane.functions import scalars as S
from terrane.operators import aggregates as AG
from terrane.operators import audit as U
from terrane.operators import incomes as I
from terrane.plans.base import registry, shared, table
from terrane.sources import readers
from terrane.sources.scratch import folder

QUERIES, ORACLES, query = registry()

POPS = "SELECT l_linenumber * 1000000000 + l_orderkey * 1000 + l_partkey % 1000 AS id, l_suppkey % 50 AS o, l_partkey % 50 AS d, CAST(l_quantity AS BIGINT) AS size FROM lineitem"


@query(f"WITH p AS ({POPS}), q AS (SELECT o, d, count(*) AS cohorts, sum(size) AS travellers FROM p GROUP BY 1, 2) SELECT CASE o % 3 WHEN 0 THEN 'osrm' WHEN 1 THEN 'fallback' ELSE 'unknown' END AS source, CASE o % 3 WHEN 0 THEN 'accepted' WHEN 1 THEN 'no route' ELSE 'missing' END AS reason, count(*) AS pairs, CAST(sum(cohorts) AS BIGINT) AS cohorts, CAST(sum(travellers) AS BIGINT) AS travellers FROM q GROUP BY 1, 2")
def provenance_totals(spark, sf):
    p = shared(spark, sf, POPS)
    known = p.where("o % 3 < 2").select("o", "d").distinct().withColumns({"source": F.when(F.col("o") % 3 == 0, "osrm").otherwise("fallback"), "reason": F.when(F.col("o") % 3 == 0, "accepted").otherwise("no route")})
    return U.provenance_totals(p, known)


@query(f"WITH p AS ({POPS}) SELECT (SELECT count(*) FROM supplier) AS points, count(*) AS cohorts, CAST(sum(size) AS BIGINT) AS travellers, CAST(sum(CASE WHEN o = d THEN 1 ELSE 0 END) AS BIGINT) AS loops, CAST(sum(CASE WHEN o = d THEN size ELSE 0 END) AS BIGINT) AS loop_travellers FROM p")
def stage_summary(spark, sf):
    return U.stage_summary(table(spark, sf, "supplier"), shared(spark, sf, POPS))


@query("SELECT c_mktsegment AS source, count(*) AS rows, CAST(sum(c_custkey) AS BIGINT) AS people, CAST(sum(c_custkey % 7) AS BIGINT) AS employed FROM customer GROUP BY 1")
def mass_by_source(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("source"), F.col("c_custkey").alias("people"), (F.col("c_custkey") % 7).alias("employed"))
    return U.mass_by_source(c, "source", ["people", "employed"])


@query("WITH p AS (SELECT c_custkey * 37 % 1000 / 10.0::DOUBLE AS lon, c_custkey * 53 % 1000 / 10.0::DOUBLE AS lat, c_custkey % 9 + 1.5 * (c_custkey % 4) AS w FROM customer) SELECT sum(lon * w) / sum(w) AS lon, sum(lat * w) / sum(w) AS lat FROM p")
def camera_barycentre(spark, sf):
    k = F.col("c_custkey")
    return U.camera(table(spark, sf, "customer").select((k * 37 % 1000 / 10.0).alias("lon"), (k * 53 % 1000 / 10.0).alias("lat"), (k % 9).alias("residents"), (k % 4).alias("jobs")))


@query("SELECT s_suppkey AS id, CAST(CASE WHEN log2(900.0 / greatest(s_suppkey % 40 / 10.0, 0.05)) > 12 THEN 12 WHEN log2(900.0 / greatest(s_suppkey % 40 / 10.0, 0.05)) < 9 THEN 9 ELSE round_even(log2(900.0 / greatest(s_suppkey % 40 / 10.0, 0.05)), 0) END AS INTEGER) AS zoom FROM supplier")
def min_zoom(spark, sf):
    span = F.col("s_suppkey") % 40 / 10.0
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), U.min_zoom(F.lit(0.0), F.lit(0.0), span, F.lit(0.01)).alias("zoom"))


@query("SELECT s_nationkey AS g, count(*) AS n, sum(w) AS weight, sum(w * v) / sum(w) AS mean, round(sqrt(greatest(sum(w * v * v) / sum(w) - pow(sum(w * v) / sum(w), 2), 0)), 6) AS std, pow(sum(w), 2) / sum(w * w) AS ess FROM (SELECT s_nationkey, CAST(s_suppkey % 11 + 1 AS DOUBLE) AS w, CAST(s_suppkey % 23 AS DOUBLE) AS v FROM supplier) GROUP BY 1")
def weighted_stats(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("g"), (F.col("s_suppkey") % 11 + 1).cast("double").alias("w"), (F.col("s_suppkey") % 23).cast("double").alias("v"))
    return U.weighted_stats(s, ["g"], "v", "w").withColumn("std", F.round("std", 6))


MOVED = "SELECT c_custkey AS id, -99 + c_custkey * 37 % 1000 / 1000e0 AS lon, 19 + c_custkey * 53 % 1000 / 1000e0 AS lat, -99 + c_custkey * 37 % 1000 / 1000e0 + c_custkey % 20 / 1000e1 AS lon2, 19 + c_custkey * 53 % 1000 / 1000e0 + c_custkey % 7 / 1000e1 AS lat2 FROM customer"


@query(f"WITH m AS ({MOVED}), d AS (SELECT sqrt(pow((lon2 - lon) * 111320 * cos(radians(lat)), 2) + pow((lat2 - lat) * 110574, 2)) AS d FROM m) SELECT count(*) AS n, round(quantile_cont(d, 0.5), 6) AS p50, round(quantile_cont(d, 0.95), 6) AS p95, round(quantile_cont(d, 0.99), 6) AS p99, round(max(d), 6) AS max FROM d")
def displacement_percentiles(spark, sf):
    d = U.displacement(shared(spark, sf, MOVED))
    return d.select("n", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99", "max")])


ROUTED = f"SELECT o, d, size, CAST((o * 31 + d * 17) % 9000 + 100 AS DOUBLE) AS beeline, (o + d) % 4 = 0 AS exact FROM ({POPS}) p"


@query(f"WITH r AS ({ROUTED}) SELECT o, d, CAST(sum(size) AS BIGINT) AS travellers, count(*) AS cohorts FROM r WHERE exact GROUP BY 1, 2")
def fallback_audit(spark, sf):
    """Pairs whose distance and time are those of the beeline rule to the metre and second."""
    rule = S.driving_fallback(F.col("beeline"))
    r = shared(spark, sf, ROUTED).withColumns({"distance": F.when(F.col("exact"), rule["distance"]).otherwise(rule["distance"] + 7), "seconds": rule["seconds"]})
    return U.inferred_fallbacks(r)


@query(f"WITH r AS ({ROUTED}), p AS (SELECT o, d, sum(size) AS t FROM r WHERE exact GROUP BY 1, 2), e AS (SELECT o AS id, t FROM p UNION ALL SELECT d, t FROM p) SELECT id, CAST(sum(t) AS BIGINT) AS travellers FROM e GROUP BY 1")
def fallback_endpoints(spark, sf):
    return U.endpoint_incidence(shared(spark, sf, ROUTED).where("exact").groupBy("o", "d").agg(F.sum("size").alias("travellers")))


BUILD = "SELECT c_nationkey AS place, c_custkey AS id, c_custkey % 9 AS jobs FROM customer"
REBUILT = "SELECT c_nationkey AS place, c_custkey AS id, c_custkey % 9 + CASE WHEN c_custkey % 5 = 0 AND c_nationkey % 2 = 0 THEN 2 ELSE 0 END AS jobs FROM customer WHERE c_nationkey % 7 <> 3 OR c_custkey % 2 = 0"


@query(f"WITH a AS (SELECT place, count(*) AS n, sum(jobs) AS jobs FROM ({BUILD}) x GROUP BY 1), b AS (SELECT place, count(*) AS n, sum(jobs) AS jobs FROM ({REBUILT}) x GROUP BY 1), d AS (SELECT place, count(*) AS moved FROM (SELECT * FROM ({BUILD}) x EXCEPT ALL SELECT * FROM ({REBUILT}) y UNION ALL SELECT * FROM (SELECT * FROM ({REBUILT}) y EXCEPT ALL SELECT * FROM ({BUILD}) x) z) m GROUP BY 1) SELECT place, coalesce(a.n, 0) AS units_before, coalesce(b.n, 0) AS units_after, CAST(coalesce(a.jobs, 0) AS BIGINT) AS before, CAST(coalesce(b.jobs, 0) AS BIGINT) AS after, CAST(coalesce(b.jobs, 0) - coalesce(a.jobs, 0) AS BIGINT) AS change, coalesce(moved, 0) = 0 AS same FROM a FULL JOIN b USING (place) LEFT JOIN d USING (place)")
def employment_compare(spark, sf):
    """Two builds place by place: units, jobs, what changed, and whether their units are the same ones."""
    return U.compare_builds(shared(spark, sf, BUILD), shared(spark, sf, REBUILT), "place", ["id", "jobs"], "jobs")


MAP = "SELECT s_suppkey AS id, s_suppkey % 10 + 1 AS o, CASE WHEN s_suppkey % 20 = 0 THEN -1 ELSE s_suppkey % 15 + 1 END AS d, s_suppkey % 9 AS size FROM supplier"


@query(f"WITH m AS ({MAP}), e AS (SELECT DISTINCT o AS point, id AS pop FROM m UNION SELECT DISTINCT d, id FROM m), s AS (SELECT s_suppkey AS point FROM supplier), k AS (SELECT * FROM e WHERE pop % 6 <> 0) SELECT 'repeated point' AS rule, 0::BIGINT AS violations UNION ALL SELECT 'repeated cohort', 0 UNION ALL SELECT 'size not positive', count(*) FROM m WHERE size <= 0 UNION ALL SELECT 'unknown end', count(*) FROM e WHERE point NOT IN (SELECT point FROM s) UNION ALL SELECT 'missing member', count(*) FROM e WHERE pop % 6 = 0 AND point IN (SELECT point FROM s) UNION ALL SELECT 'foreign member', count(*) FROM s WHERE point % 25 = 0")
def package_validation(spark, sf):
    """A map with empty cohorts, an unknown end, members left out (every sixth cohort) and members that are none."""
    pops = shared(spark, sf, MAP)
    points = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"))
    ends = pops.select(F.explode(F.array("o", "d")).alias("point"), F.col("id").alias("pop")).distinct().where("pop % 6 <> 0")
    foreign = points.where("id % 25 = 0").select(F.col("id").alias("point"), F.lit(-5).cast("long").alias("pop"))
    return U.package_violations(points, pops, ends.unionByName(foreign))


@query(f"WITH p AS ({POPS}), i AS (SELECT range AS id FROM range(50)), o AS (SELECT o AS id, sum(size) AS outgoing FROM p GROUP BY 1), n AS (SELECT d AS id, sum(size) AS incoming FROM p GROUP BY 1) SELECT id, CAST(coalesce(outgoing, 0) + CASE WHEN id % 7 = 0 THEN 1 ELSE 0 END AS BIGINT) AS residents, CAST(coalesce(incoming, 0) AS BIGINT) AS jobs, CAST(coalesce(outgoing, 0) AS BIGINT) AS outgoing, CAST(coalesce(incoming, 0) AS BIGINT) AS incoming FROM i LEFT JOIN o USING (id) LEFT JOIN n USING (id) WHERE id % 7 = 0")
def display_mismatch(spark, sf):
    p = shared(spark, sf, POPS)
    ids = spark.range(50)
    out = p.groupBy(F.col("o").alias("id")).agg(F.sum("size").alias("r"))
    into = p.groupBy(F.col("d").alias("id")).agg(F.sum("size").alias("j"))
    shown = ids.join(out, "id", "left").join(into, "id", "left").fillna(0).select("id", (F.col("r") + F.when(F.col("id") % 7 == 0, 1).otherwise(0)).alias("residents"), F.col("j").alias("jobs"))
    return U.display_mismatch(shown, p)


@query("SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS year FROM orders")
def available_years(spark, sf):
    o = table(spark, sf, "orders").select(F.year("o_orderdate").cast("string").alias("y"))
    odd = spark.createDataFrame([("1850",), ("20x",), ("2020.5",), (None,), (" 2101 ",)], "y string")
    return U.years_available(o.unionByName(odd), "y")


@query("SELECT c_custkey AS id, round(pow(ln(1 + 32 * least(1, c_custkey % 120 / 100.0)) / ln(33.0), 1 / 2.0), 9) AS tone FROM customer")
def heat_tone(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.round(U.heat_tone(F.col("c_custkey") % 120 / 100.0, 2.0), 9).alias("tone"))


@query("WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey % 3 * 400.0::DOUBLE AS seconds, l_suppkey % 50 * 100.0::DOUBLE AS distance FROM lineitem), c AS (SELECT *, CASE WHEN seconds > 0 THEN greatest(45, seconds * 40.0 / 22.0) WHEN distance > 0 THEN greatest(45, distance / (22.0 / 3.6)) ELSE 45 END AS car FROM p) SELECT CAST(sum(greatest(45, CAST(round_even(0.4 * car + 0.6 * (car * 2 + 300), 0) AS BIGINT))) AS BIGINT) AS seconds FROM c")
def modal_impedance(spark, sf):
    s = U.modal_seconds(F.col("l_partkey") % 3 * 400.0, F.col("l_suppkey") % 50 * 100.0)
    return table(spark, sf, "lineitem").agg(F.sum(s).alias("seconds"))


SURVEY = "SELECT event_id AS id, user_id % 3 AS r_def, event_id % 4 + 1 AS c_res, event_id % 110 AS eda, event_id % 2 + 1 AS clase2, CASE event_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 999998 ELSE event_id % 9000 + 1 END AS ingocup, CASE event_id % 5 WHEN 0 THEN 6 WHEN 1 THEN CASE WHEN event_id % 2 = 0 THEN event_id % 5 + 1 ELSE 7 END ELSE 3 END AS ing7c, CAST(event_id % 17 + 1 AS DOUBLE) AS fac, event_id % 80 AS hrsocup FROM events"
DOMAIN = f"s AS ({SURVEY}), d AS (SELECT * FROM s WHERE r_def = 0 AND c_res IN (1, 3) AND eda BETWEEN 15 AND 98 AND clase2 = 1), st AS (SELECT *, CASE WHEN ingocup > 0 AND ingocup < 999998 THEN 'exact' WHEN ingocup = 0 AND ing7c = 6 THEN 'zero' WHEN ing7c BETWEEN 1 AND 5 THEN 'band' ELSE 'unspecified' END AS status FROM d)"


@query(f"WITH {DOMAIN} SELECT status, count(*) AS n, sum(fac) AS weight, sum(fac) / (SELECT sum(fac) FROM st) AS share FROM st GROUP BY 1")
def survey_income_status(spark, sf):
    """Employed residents by what is known of their income."""
    d = U.survey_domain(shared(spark, sf, SURVEY))
    s = d.groupBy(U.income_status(F.col("ingocup"), F.col("ing7c")).alias("status")).agg(F.count("*").alias("n"), F.sum("fac").alias("weight"))
    return s.join(F.broadcast(s.agg(F.sum("weight").alias("_t")))).select("status", "n", "weight", (F.col("weight") / F.col("_t")).alias("share"))


@query(f"WITH {DOMAIN}, i AS (SELECT fac, CASE WHEN status IN ('exact', 'zero') THEN ingocup WHEN status = 'band' THEN CASE ing7c WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 3 ELSE 5 END * 8364 ELSE 0 END::DOUBLE AS lo, CASE WHEN status IN ('exact', 'zero') THEN ingocup WHEN status = 'band' THEN CASE ing7c WHEN 1 THEN 8364 WHEN 2 THEN 16728 WHEN 3 THEN 25092 WHEN 4 THEN 41820 ELSE 'infinity'::DOUBLE END ELSE 'infinity'::DOUBLE END::DOUBLE AS hi FROM st), l AS (SELECT lo, sum(sum(fac)) OVER (ORDER BY lo) AS c, sum(sum(fac)) OVER () AS t FROM i GROUP BY 1), h AS (SELECT hi, sum(sum(fac)) OVER (ORDER BY hi) AS c, sum(sum(fac)) OVER () AS t FROM i GROUP BY 1) SELECT (SELECT min(lo) FROM l WHERE c >= 0.25 * t) AS lo25, (SELECT min(lo) FROM l WHERE c >= 0.5 * t) AS lo50, (SELECT CASE WHEN min(hi) < 'infinity'::DOUBLE THEN min(hi) END FROM h WHERE c >= 0.25 * t) AS hi25, (SELECT CASE WHEN min(hi) < 'infinity'::DOUBLE THEN min(hi) END FROM h WHERE c >= 0.5 * t) AS hi50")
def censored_income_bounds(spark, sf):
    """Quantile bounds of incomes known as intervals; an open edge is null."""
    d = U.survey_domain(shared(spark, sf, SURVEY)).select("fac", U.income_interval(F.col("ingocup"), F.col("ing7c"), F.lit(8364.0)).alias("i")).select("fac", "i.lo", "i.hi")
    low = AG.weighted_quantiles(d, [], "lo", "fac", (0.25, 0.5)).select(F.col("p25").alias("lo25"), F.col("p50").alias("lo50"))
    high = AG.weighted_quantiles(d, [], "hi", "fac", (0.25, 0.5))
    closed = lambda c: F.when(F.col(c) < float("inf"), F.col(c))
    return low.join(high.select(closed("p25").alias("hi25"), closed("p50").alias("hi50")))


@query(f"WITH {DOMAIN} SELECT CAST(ing7c AS BIGINT) AS band, count(*) AS n, sum(fac) / (SELECT sum(fac) FROM st) AS share FROM st GROUP BY 1")
def income_band_shares(spark, sf):
    d = U.survey_domain(shared(spark, sf, SURVEY))
    s = d.groupBy(F.col("ing7c").cast("long").alias("band")).agg(F.count("*").alias("n"), F.sum("fac").alias("w"))
    return s.join(F.broadcast(s.agg(F.sum("w").alias("_t")))).select("band", "n", (F.col("w") / F.col("_t")).alias("share"))


POIS = "SELECT 'AIR_Field_' || CAST(n_nationkey AS STRING) AS id, CASE WHEN n_nationkey % 3 = 0 THEN ' Stadium ' END AS kind, CASE WHEN n_nationkey % 4 = 0 THEN 'Given' END AS name FROM nation UNION ALL SELECT 'MUS_House', NULL, NULL FROM nation WHERE n_nationkey = 0 UNION ALL SELECT 'gran_hotel_x', '', '' FROM nation WHERE n_nationkey = 0"


@query(f"WITH p AS ({POIS}), q AS (SELECT s_suppkey AS id, 'AIR_Field_' || (s_suppkey % 30) AS d FROM supplier) SELECT p.id AS point_id, CASE WHEN trim(coalesce(kind, '')) <> '' THEN 'stadium' WHEN starts_with(p.id, 'AIR_') THEN 'airport' WHEN starts_with(p.id, 'MUS_') THEN 'museum' ELSE 'resort' END AS type, CASE WHEN coalesce(name, '') <> '' THEN name WHEN starts_with(p.id, 'AIR_') THEN 'Aeropuerto Internacional de ' || replace(substr(p.id, 5), '_', ' ') WHEN p.id = 'MUS_House' THEN 'House' ELSE 'gran hotel x' END AS name, (SELECT count(*) FROM q WHERE q.d = p.id) AS cohorts FROM p")
def special_places(spark, sf):
    """Special places with their type, name and cohorts."""
    pops = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("x").alias("o"), F.concat(F.lit("AIR_Field_"), (F.col("s_suppkey") % 30).cast("string")).alias("d"))
    return U.special_points(shared(spark, sf, POIS), pops).select("point_id", "type", "name", F.size("pop_ids").cast("long").alias("cohorts"))


@query("WITH c AS (SELECT CAST(floor(c_custkey * 37 % 1000 / 50.0) AS BIGINT) AS gx, CAST(floor(c_custkey * 53 % 1000 / 50.0) AS BIGINT) AS gy, c_custkey % 9 AS residents, c_custkey % 6 AS jobs FROM customer), s AS (SELECT gx, gy, CAST(sum(residents) AS BIGINT) AS residents, CAST(sum(jobs) AS BIGINT) AS jobs, count(*) AS points FROM c GROUP BY 1, 2) SELECT gx, gy, residents, jobs, jobs - residents AS surplus, CASE WHEN jobs + residents > 0 THEN (jobs - residents) / (jobs + residents)::DOUBLE END AS balance, points FROM s")
def balance_grid(spark, sf):
    k = F.col("c_custkey")
    c = table(spark, sf, "customer").select(F.floor(k * 37 % 1000 / 50.0).cast("long").alias("gx"), F.floor(k * 53 % 1000 / 50.0).cast("long").alias("gy"), (k % 9).alias("r"), (k % 6).alias("j"))
    s = c.groupBy("gx", "gy").agg(F.sum("r").alias("residents"), F.sum("j").alias("jobs"), F.count("*").alias("points"))
    both = F.col("jobs") + F.col("residents")
    return s.select("gx", "gy", "residents", "jobs", (F.col("jobs") - F.col("residents")).alias("surplus"), F.when(both > 0, (F.col("jobs") - F.col("residents")) / both).alias("balance"), "points")


@query("SELECT c_custkey AS id, row_number() OVER (PARTITION BY c_custkey % 20, c_nationkey % 3 ORDER BY c_custkey) - 1 AS ordinal FROM customer")
def colocated_ordinals(spark, sf):
    """The place of each point among those at the same coordinates, for stable ids."""
    from pyspark.sql import Window

    w = Window.partitionBy("lon", "lat").orderBy("id")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 20).alias("lon"), (F.col("c_nationkey") % 3).alias("lat"))
    return c.select("id", (F.row_number().over(w) - 1).cast("long").alias("ordinal"))


@query("WITH p AS (SELECT c_custkey AS id, c_custkey * 37 % 1000 / 10.0::DOUBLE AS x, c_custkey * 53 % 1000 / 10.0::DOUBLE AS y, CAST(c_custkey % 9 + 1 AS DOUBLE) AS w FROM customer), m AS (SELECT sum(x * w) / sum(w) AS mx, sum(y * w) / sum(w) AS my FROM p) SELECT id FROM p, m WHERE sqrt(pow(x - mx, 2) + pow(y - my, 2)) <= 25")
def urban_core(spark, sf):
    """Points within reach of the weighted barycentre, from which a core is drawn."""
    k = F.col("c_custkey")
    p = table(spark, sf, "customer").select(k.alias("id"), (k * 37 % 1000 / 10.0).alias("x"), (k * 53 % 1000 / 10.0).alias("y"), (k % 9 + 1).cast("double").alias("w"))
    m = p.agg((F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("mx"), (F.sum(F.col("y") * F.col("w")) / F.sum("w")).alias("my"))
    return p.join(F.broadcast(m)).where(F.sqrt(F.pow(F.col("x") - F.col("mx"), 2) + F.pow(F.col("y") - F.col("my"), 2)) <= 25).select("id")


AREAS = "SELECT s_suppkey AS id, s_suppkey * 37 % 1000 / 10e0 AS x, s_suppkey * 53 % 1000 / 10e0 AS y, CAST(s_suppkey % 9 AS DOUBLE) AS w, CAST(s_suppkey % 6 AS DOUBLE) AS h FROM supplier"


@query(f"WITH a AS ({AREAS}) SELECT id, w * h AS area, CASE WHEN w * h > 0 THEN round(x + w / 2, 9) END AS cx, CASE WHEN w * h > 0 THEN round(y + h / 2, 9) END AS cy, w * h > 12 AS kept FROM a")
def building_filter(spark, sf):
    """Footprints as rings: shoelace area, centroid, and whether they are large enough to keep."""
    a = shared(spark, sf, AREAS)
    p = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    ring = F.array(p(F.lit(0.0), F.lit(0.0)), p(F.col("w"), F.lit(0.0)), p(F.col("w"), F.col("h")), p(F.lit(0.0), F.col("h")))
    b = a.withColumn("ring", ring).withColumns({"area": F.round(G.ring_area(F.col("ring")), 6), "c": G.ring_centroid(F.col("ring"))})
    flat = F.col("area") == 0
    return b.select("id", "area", F.when(~flat, F.round("c.x", 6)).alias("cx"), F.when(~flat, F.round("c.y", 6)).alias("cy"), (F.col("area") > 12).alias("kept"))


@query("SELECT s_suppkey AS id, round((s_suppkey * 37 % 360 - 180 + 180) / 360.0 * 256 * 1024, 6) AS x, round((1 - asinh(tan(radians(s_suppkey * 53 % 160 - 80))) / pi()) / 2 * 256 * 1024, 4) AS y FROM supplier")
def mercator_pixels(spark, sf):
    k = F.col("s_suppkey")
    m = G.mercator(k * 37 % 360 - 180, (k * 53 % 160 - 80).cast("double"), 10)
    return table(spark, sf, "supplier").select(k.alias("id"), m.alias("m")).select("id", F.round("m.x", 6).alias("x"), F.round("m.y", 4).alias("y"))


@query("SELECT s_suppkey AS id, substr(sha256(CAST(s_suppkey AS VARCHAR) || '|' || s_name), 1, 16) AS hash, CASE WHEN s_acctbal > 0 THEN s_acctbal ELSE 25.0 END AS km FROM supplier")
def hash_ids(spark, sf):
    """Short ids from hashes, and a setting that falls back where it is not a positive number."""
    s = table(spark, sf, "supplier")
    km = F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).otherwise(F.lit(float("nan")))
    return s.select(F.col("s_suppkey").alias("id"), S.hash_id(F.col("s_suppkey").cast("string"), F.col("s_name")).alias("hash"), S.positive_or(F.when(~F.isnan(km), km), 25.0).alias("km"))


@query("SELECT p_partkey AS id, round(CASE p_partkey % 3 WHEN 0 THEN -1.959964 WHEN 1 THEN 0.0 ELSE 2.326348 END, 4)::DOUBLE AS z FROM part")
def normal_quantiles(spark, sf):
    """Standard normal quantiles at 0.025, 0.5 and 0.99."""
    p = F.element_at(F.array(F.lit(0.025), F.lit(0.5), F.lit(0.99)), (F.col("p_partkey") % 3).cast("int") + 1)
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.round(S.normal_quantile(p), 4).alias("z"))


@query("SELECT p_partkey AS id, p_name AS name FROM part WHERE p_name ILIKE '%1%' AND p_partkey IS NOT NULL")
def substring_filter(spark, sf):
    return table(spark, sf, "part").where(F.col("p_name").ilike("%1%") & F.col("p_partkey").isNotNull()).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))


@query("SELECT 's' || s_suppkey AS id, round(s_suppkey * 37 % 1000 / 10.0, 5)::DOUBLE AS lon, CAST(s_suppkey % 90 AS INTEGER) AS jobs, CAST(s_suppkey % 70 AS INTEGER) AS residents FROM supplier")
def export_schema(spark, sf):
    """The columns an exported point keeps, cast; all else is dropped."""
    k = F.col("s_suppkey")
    p = table(spark, sf, "supplier").select("*", F.concat(F.lit("s"), k.cast("string")).alias("id"), (k * 37 % 1000 / 10.0).alias("lon"), (k % 90 + 0.0).alias("jobs"), (k % 70 + 0.0).alias("residents"))
    return p.select("id", F.round("lon", 5).alias("lon"), F.col("jobs").cast("int").alias("jobs"), F.col("residents").cast("int").alias("residents"))


@query("SELECT s_suppkey AS id, s_suppkey % 4 <> 0 AND s_suppkey * 37 % 1000 / 10.0 BETWEEN 10 AND 90 AND NOT (s_suppkey * 37 % 1000 / 10.0 BETWEEN 30 AND 40) AS allowed FROM supplier")
def allowed_locations(spark, sf):
    """In the same zone, inside the core and in no exclusion zone."""
    k = F.col("s_suppkey")
    x = k * 37 % 1000 / 10.0
    excluded = G.in_bbox(x, F.lit(5.0), (30.0, 0.0, 40.0, 10.0))
    core = G.in_bbox(x, F.lit(5.0), (10.0, 0.0, 90.0, 10.0))
    return table(spark, sf, "supplier").select(k.alias("id"), ((k % 4 != 0) & core & ~excluded).alias("allowed"))


CONFIG_PROBLEMS = (("city.bbox must run from west to east and south to north", "s_suppkey % 3 = 0"), ("city.code must have two to four letters or digits", "s_suppkey % 4 = 0"), ("special place a is given twice", "s_suppkey % 5 = 0 AND s_suppkey % 3 <> 0"), ("special place a has undecided demand", "s_suppkey % 5 = 0 AND s_suppkey % 3 <> 0"))


@query(" UNION ALL ".join(f"SELECT s_suppkey AS config, '{p}' AS problem FROM supplier WHERE {c}" for p, c in CONFIG_PROBLEMS))
def config_constraints(spark, sf):
    """What is wrong with each of as many configurations as there are suppliers."""
    from terrane.plans.geometry import city_configs

    text = city_configs(spark, sf).select("config", F.to_json(F.struct("city", "zones", "pois"), {"ignoreNullFields": "false"}).alias("value"))
    return readers.config_problems(text, "config", "value").select("config", F.explode("problems").alias("problem"))


@query("WITH f AS (SELECT DISTINCT 'own/nation=' || s_nationkey AS path, 0 AS own FROM supplier UNION SELECT DISTINCT 'shared/nation=' || c_nationkey, 1 FROM customer), k AS (SELECT * FROM f WHERE NOT ends_with(path, '=7')) SELECT CAST(row_number() OVER (ORDER BY own, path) - 1 AS INTEGER) AS n, path FROM k")
def source_discovery(spark, sf):
    """Sources found in a folder, the project's own first, each once, without an excluded one."""
    root = folder(spark, "sources")
    table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"), "s_name").write.partitionBy("nation").csv(f"{root}/own")
    table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), "c_name").write.partitionBy("nation").csv(f"{root}/shared")
    found = [r["source"] for r in readers.discovered(spark, root).collect()]  # one for each source of a project
    own = [p for p in found if p.startswith("own/")]
    return spark.createDataFrame(list(enumerate(readers.select_sources(own, [p for p in found if p not in own], ["nation=7"]))), "n int, path string")


INCOMES = "SELECT c_nationkey AS domain, round(c_acctbal * 10, 0) AS income, CAST(c_custkey % 13 + 1 AS DOUBLE) AS fac FROM customer WHERE c_acctbal > 0"
QUANTILE_SQL = ", ".join(f"min(CASE WHEN run >= {q} * total THEN income END) AS p{round(q * 100)}" for q in I.QUANTILES)


@query(f"WITH i AS ({INCOMES}), v AS (SELECT domain, income, sum(fac) AS w FROM i GROUP BY ALL), r AS (SELECT *, sum(w) OVER (PARTITION BY domain ORDER BY income) AS run, sum(w) OVER (PARTITION BY domain) AS total FROM v), q AS (SELECT domain, {QUANTILE_SQL} FROM r GROUP BY domain), m AS (SELECT domain, count(*) AS n, sum(fac) AS weight, sum(fac * income) / sum(fac) AS mean, sqrt(sum(fac * income * income) / sum(fac) - pow(sum(fac * income) / sum(fac), 2)) AS std, pow(sum(fac), 2) / sum(fac * fac) AS effective FROM i GROUP BY domain) SELECT * FROM m JOIN q USING (domain)")
def survey_quantiles(spark, sf):
    """Incomes of each domain: sample, weight, mean, deviation, effective sample, quantiles."""
    return I.survey_stats(shared(spark, sf, INCOMES), ["domain"], "income", "fac")


@query()
def income_fit(spark, sf):
    """Generator parameters fitted to each domain's incomes; tests/test_incomes.py recovers known ones."""
    return I.fitted(I.survey_stats(shared(spark, sf, INCOMES), ["domain"], "income", "fac"), "domain")
