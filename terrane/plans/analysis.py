"""Analysis queries: grids, selections, comparisons, statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from terrane.functions import scalars as S
from terrane.operators import aggregates as A
from terrane.operators import analysis as N
from terrane.plans.base import CX, CY, EDGES, SX, SY, edges, place, registry, table

QUERIES, ORACLES, query = registry()


def customers(spark, sf):
    x, y = place(F.col("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey", "c_nationkey", x.alias("x"), y.alias("y"), F.greatest(F.col("c_acctbal"), F.lit(0.0)).cast("long").alias("residents"), (F.col("c_custkey") % 11).alias("jobs"))


CUST = f"c AS (SELECT c_custkey, c_nationkey, {CX} AS x, {CY} AS y, CAST(trunc(greatest(c_acctbal, 0)) AS BIGINT) AS residents, c_custkey % 11 AS jobs FROM customer)"
CELLS = f"WITH {CUST}, g AS (SELECT CAST(floor(x / 10) AS BIGINT) AS gx, CAST(floor(y / 10) AS BIGINT) AS gy, count(*) AS points, CAST(sum(residents) AS BIGINT) AS residents, CAST(sum(jobs) AS BIGINT) AS jobs, sum(greatest(0.1, residents::DOUBLE) * x) / sum(greatest(0.1, residents::DOUBLE)) AS x, sum(greatest(0.1, residents::DOUBLE) * y) / sum(greatest(0.1, residents::DOUBLE)) AS y FROM c GROUP BY 1, 2)"


def cells(spark, sf):
    return A.grid(customers(spark, sf), F.col("x"), F.col("y"), 10.0, F.col("residents"), {"residents": F.col("residents"), "jobs": F.col("jobs")})


@query(CELLS + " SELECT gx, gy, points, residents, jobs, jobs - residents AS gap, round(CASE WHEN jobs + residents > 0 THEN (jobs - residents) / (jobs + residents) END, 6) AS balance FROM g")
def grid_density(spark, sf):
    both = F.col("jobs") + F.col("residents")
    return cells(spark, sf).select("gx", "gy", "points", "residents", "jobs", (F.col("jobs") - F.col("residents")).alias("gap"), F.round(F.when(both > 0, (F.col("jobs") - F.col("residents")) / both), 6).alias("balance"))


@query(CELLS + " SELECT gx, gy, round(x, 4) AS x, round(y, 4) AS y, residents FROM g")
def grid_weighted_centroid(spark, sf):
    return cells(spark, sf).select("gx", "gy", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), "residents")


@query(CELLS + " SELECT gx, gy, residents, jobs FROM g WHERE jobs >= 60 OR residents >= 50000")
def grid_threshold_having(spark, sf):
    return cells(spark, sf).where("jobs >= 60 or residents >= 50000").select("gx", "gy", "residents", "jobs")


@query(CELLS + " SELECT gx, gy, round(residents * 100000.0 / sum(residents) OVER (), 4) AS scaled FROM g")
def target_rescale(spark, sf):
    c = cells(spark, sf)
    total = c.agg(F.sum("residents").alias("t"))
    return c.crossJoin(F.broadcast(total)).select("gx", "gy", F.round(F.col("residents") * 100000.0 / F.col("t"), 4).alias("scaled"))


@query(CELLS + " SELECT count(*) AS n, round(least(greatest(corr(residents::DOUBLE, jobs::DOUBLE), -1), 1), 6) AS r FROM g WHERE residents > 0 OR jobs > 0")
def correlation_occupied(spark, sf):
    return A.correlation(cells(spark, sf), "residents", "jobs").withColumn("r", F.round("r", 6))


@query(CELLS + ", r AS (SELECT residents, row_number() OVER (ORDER BY residents DESC, gx, gy) AS k, CAST(ceil(0.1 * (SELECT count(*) FROM g)) AS BIGINT) AS n FROM g) SELECT max(n) AS cells, round(sum(CASE WHEN k <= n THEN residents ELSE 0 END) / sum(residents), 6) AS share FROM r")
def top_decile_concentration(spark, sf):
    return A.concentration(cells(spark, sf), "residents").withColumn("share", F.round("share", 6))


@query(f"WITH {CUST} SELECT c_nationkey, round(sum(residents) * sum(residents) / sum(residents * residents), 6) AS ess, count(*) AS n FROM (SELECT c_nationkey, residents::DOUBLE + 1 AS residents FROM c) GROUP BY 1")
def kish_ess(spark, sf):
    c = customers(spark, sf).withColumn("w", F.col("residents").cast("double") + 1)
    return A.kish(c, ["c_nationkey"], "w").withColumn("ess", F.round("ess", 6))


@query(f"""WITH {CUST}, m AS (SELECT c_nationkey, sum((jobs + 1) * x) / sum(jobs + 1) AS mx, sum((jobs + 1) * y) / sum(jobs + 1) AS my, sum(jobs + 1)::DOUBLE AS sw FROM c GROUP BY 1),
v AS (SELECT c_nationkey, any_value(mx) AS mx, any_value(my) AS my, sum((jobs + 1) * (x - mx) * (x - mx)) / any_value(sw) AS vx, sum((jobs + 1) * (y - my) * (y - my)) / any_value(sw) AS vy, sum((jobs + 1) * (x - mx) * (y - my)) / any_value(sw) AS cxy FROM c JOIN m USING (c_nationkey) GROUP BY 1)
SELECT c_nationkey, round(mx, 4) AS mx, round(my, 4) AS my, round(sqrt(vx + vy), 4) AS gyration, round(sqrt(((vx + vy) / 2 + sqrt(pow((vx - vy) / 2, 2) + pow(cxy, 2))) / greatest((vx + vy) / 2 - sqrt(pow((vx - vy) / 2, 2) + pow(cxy, 2)), 1e-12)), 4) AS elongation, round(atan2(2 * cxy, vx - vy) / 2, 4) AS orientation FROM v""")
def weighted_moments(spark, sf):
    m = A.moments(customers(spark, sf), ["c_nationkey"], F.col("x"), F.col("y"), F.col("jobs") + 1)
    return m.select("c_nationkey", *[F.round(c, 4).alias(c) for c in ("mx", "my", "gyration", "elongation", "orientation")])


@query("""WITH l AS (SELECT p_brand, CAST(floor(p_size / 10) * 10 AS BIGINT) AS lo, CASE WHEN p_size >= 40 THEN NULL ELSE CAST(floor(p_size / 10) * 10 + 10 AS BIGINT) END AS hi FROM part),
a AS (SELECT p_brand, lo, sum(count(*)) OVER (PARTITION BY p_brand ORDER BY lo) AS c, sum(count(*)) OVER (PARTITION BY p_brand) AS n FROM l GROUP BY 1, 2), b AS (SELECT p_brand, hi, sum(count(*)) OVER (PARTITION BY p_brand ORDER BY hi NULLS LAST) AS c, sum(count(*)) OVER (PARTITION BY p_brand) AS n FROM l GROUP BY 1, 2)
SELECT p_brand, (SELECT min(lo) FROM a WHERE a.p_brand = p.p_brand AND c >= 0.5 * n) AS low, (SELECT min(coalesce(hi, 9999)) FROM b WHERE b.p_brand = p.p_brand AND c >= 0.5 * n) AS high FROM (SELECT DISTINCT p_brand FROM part) p""")
def interval_quantile_bounds(spark, sf):
    lo = (F.floor(F.col("p_size") / 10) * 10).cast("long")
    p = table(spark, sf, "part").select("p_brand", lo.alias("lo"), F.when(F.col("p_size") >= 40, F.lit(9999)).otherwise(lo + 10).cast("long").alias("hi"), F.lit(1).alias("w"))
    low = A.weighted_quantiles(p, ["p_brand"], "lo", "w", (0.5,)).withColumnRenamed("p50", "low")
    return low.join(A.weighted_quantiles(p, ["p_brand"], "hi", "w", (0.5,)).withColumnRenamed("p50", "high"), "p_brand")


@query(f"WITH {EDGES}, s AS (SELECT n_nationkey AS id FROM nation WHERE n_nationkey % 4 = 1), a AS (SELECT d AS cell, sum(size) AS leaving FROM e WHERE o IN (SELECT id FROM s) AND d NOT IN (SELECT id FROM s) GROUP BY 1), b AS (SELECT o AS cell, sum(size) AS entering FROM e WHERE d IN (SELECT id FROM s) AND o NOT IN (SELECT id FROM s) GROUP BY 1) SELECT coalesce(a.cell, b.cell) AS cell, CAST(coalesce(leaving, 0) AS BIGINT) AS leaving, CAST(coalesce(entering, 0) AS BIGINT) AS entering, CAST(row_number() OVER (ORDER BY coalesce(leaving, 0) + coalesce(entering, 0) DESC, coalesce(a.cell, b.cell)) AS INTEGER) AS rank FROM a FULL JOIN b ON a.cell = b.cell")
def selected_trips_ranked(spark, sf):
    chosen = table(spark, sf, "nation").where("n_nationkey % 4 = 1").select(F.col("n_nationkey").alias("id"))
    return N.selected_trips(edges(spark, sf), chosen, "size")


@query(f"WITH {EDGES}, r AS (SELECT size, a.n_regionkey AS ro, b.n_regionkey AS rd FROM e JOIN nation a ON a.n_nationkey = o JOIN nation b ON b.n_nationkey = d) SELECT CAST(sum(CASE WHEN ro = 0 AND rd = 1 THEN size ELSE 0 END) AS BIGINT) AS a_to_b, CAST(sum(CASE WHEN ro = 1 AND rd = 0 THEN size ELSE 0 END) AS BIGINT) AS b_to_a, CAST(sum(CASE WHEN ro = 0 THEN size ELSE 0 END) AS BIGINT) AS out_a, CAST(sum(CASE WHEN rd = 1 THEN size ELSE 0 END) AS BIGINT) AS in_b, round(sum(CASE WHEN ro = 0 AND rd = 1 THEN size ELSE 0 END) / sum(CASE WHEN ro = 0 THEN size ELSE 0 END), 6) AS share_of_a FROM r")
def area_pair_demand(spark, sf):
    n = table(spark, sf, "nation")
    a, b = (n.where(F.col("n_regionkey") == k).select(F.col("n_nationkey").alias("id")) for k in (0, 1))
    return N.area_pair(edges(spark, sf), a, b, "size").withColumn("share_of_a", F.round("share_of_a", 6))


@query(f"WITH {CUST} SELECT count(*) AS points, CAST(sum(residents) AS BIGINT) AS residents, CAST(sum(jobs) AS BIGINT) AS jobs, round((sum(jobs) - sum(residents)) / (sum(jobs) + sum(residents)), 6) AS balance, round(sum(residents) / (30.0 * 40.0), 6) AS density, round(sum(residents) / (SELECT sum(residents) FROM c), 6) AS share FROM c WHERE x BETWEEN 20 AND 50 AND y BETWEEN 30 AND 70")
def select_geometry_bbox(spark, sf):
    return N.select_area(customers(spark, sf), F.col("x").between(20, 50) & F.col("y").between(30, 70), 1200.0)


@query(f"WITH {CUST} SELECT count(*) AS points, CAST(sum(residents) AS BIGINT) AS residents, CAST(sum(jobs) AS BIGINT) AS jobs, round((sum(jobs) - sum(residents)) / (sum(jobs) + sum(residents)), 6) AS balance, round(sum(residents) / (3.141592653589793 * 15 * 15), 6) AS density, round(sum(residents) / (SELECT sum(residents) FROM c), 6) AS share FROM c WHERE sqrt(pow(x - 40, 2) + pow(y - 40, 2)) <= 15")
def select_radius(spark, sf):
    inside = F.sqrt(F.pow(F.col("x") - 40, 2) + F.pow(F.col("y") - 40, 2)) <= 15
    return N.select_area(customers(spark, sf), inside, 3.141592653589793 * 15 * 15)


AB = "WITH a AS (SELECT c_nationkey AS cell, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE year(o_orderdate) = 1996 GROUP BY 1), b AS (SELECT c_nationkey AS cell, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE year(o_orderdate) = 1997 AND c_nationkey <> 3 GROUP BY 1)"


def ab(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("cell"), F.year("o_orderdate").alias("y"))
    return o.where("y = 1996").groupBy("cell").agg(F.count("*").alias("n")), o.where("y = 1997 and cell <> 3").groupBy("cell").agg(F.count("*").alias("n"))


@query(AB + " SELECT coalesce(a.cell, b.cell) AS cell, coalesce(a.n, 0) AS before, coalesce(b.n, 0) AS after, coalesce(b.n, 0) - coalesce(a.n, 0) AS delta, CASE WHEN coalesce(a.n, 0) = 0 AND coalesce(b.n, 0) = 0 THEN 'empty' WHEN coalesce(a.n, 0) = 0 THEN 'new' WHEN a.n = coalesce(b.n, 0) THEN 'unchanged' ELSE 'changed' END AS status FROM a FULL JOIN b ON a.cell = b.cell")
def compare_cells_ab(spark, sf):
    a, b = ab(spark, sf)
    return N.compare(a, b, ["cell"], "n").withColumn("status", S.change_status(F.col("before"), F.col("after")))


@query(f"WITH {EDGES}, a AS (SELECT o, d, sum(size) AS n FROM e WHERE year = 1996 GROUP BY 1, 2), b AS (SELECT o, d, sum(size) AS n FROM e WHERE year = 1997 GROUP BY 1, 2), f AS (SELECT coalesce(a.o, b.o) AS o, coalesce(a.d, b.d) AS d, CAST(coalesce(a.n, 0) AS BIGINT) AS before, CAST(coalesce(b.n, 0) AS BIGINT) AS after FROM a FULL JOIN b ON a.o = b.o AND a.d = b.d) SELECT o, d, before, after, after - before AS delta FROM f")
def compare_trips_ab(spark, sf):
    e = edges(spark, sf)
    a, b = (e.where(F.col("year") == y).groupBy("o", "d").agg(F.sum("size").alias("n")) for y in (1996, 1997))
    return N.compare(a, b, ["o", "d"], "n").orderBy(F.desc(F.abs("delta")), "o", "d")


@query("SELECT n_regionkey, n_nationkey, c_mktsegment, CAST(grouping(n_regionkey) * 4 + grouping(n_nationkey) * 2 + grouping(c_mktsegment) AS INTEGER) AS level, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, n_nationkey, c_mktsegment)")
def coverage_rollup(spark, sf):
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return A.rollup_counts(c, ["n_regionkey", "n_nationkey", "c_mktsegment"], F.col("c_custkey"))


@query("WITH t AS (SELECT p_partkey, p_retailprice, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS k FROM part), c AS (SELECT p_retailprice AS v FROM t WHERE k = 100) SELECT p_partkey, round(p_retailprice, 2) AS price, (SELECT count(*) FROM part, c WHERE p_retailprice = v) AS tied_at_cutoff, (SELECT count(*) FROM t, c WHERE p_retailprice = v AND k <= 100) AS tied_kept FROM t WHERE k <= 100")
def topn_with_ties_audit(spark, sf):
    return N.top_with_ties(table(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("price")), "price", "p_partkey", 100).withColumn("price", F.round("price", 2))


@query("SELECT p_partkey, p_size FROM part ORDER BY p_size DESC, p_partkey LIMIT 20 OFFSET 40")
def paged_topk(spark, sf):
    return table(spark, sf, "part").select("p_partkey", "p_size").orderBy(F.desc("p_size"), "p_partkey").offset(40).limit(20)


@query("WITH f AS (SELECT l_suppkey, CAST(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) - sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS BIGINT) AS delta FROM lineitem GROUP BY 1) SELECT l_suppkey, delta FROM f ORDER BY abs(delta) DESC, l_suppkey LIMIT 30")
def abs_delta_sort(spark, sf):
    q = lambda k: F.sum(F.when(F.col("l_returnflag") == k, F.col("l_quantity")).otherwise(0))
    f = table(spark, sf, "lineitem").groupBy("l_suppkey").agg((q("R") - q("A")).cast("long").alias("delta"))
    return f.orderBy(F.desc(F.abs("delta")), "l_suppkey").limit(30)


@query("SELECT event_type, (epoch(time_bucket(INTERVAL '6 hours', ts)) / 3600)::BIGINT AS hour, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2")
def window_event_counts(spark, sf):
    e = table(spark, sf, "events").groupBy("event_type", F.window(F.col("ts").cast("timestamp"), "6 hours").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))
    return e.select("event_type", (F.unix_timestamp("w.start") / 3600).cast("long").alias("hour"), "n", "total")


@query("SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def json_props_extract(spark, sf):
    return table(spark, sf, "events").groupBy(F.from_json("props", "k long")["k"].alias("k")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("SELECT event_type, CAST(round(quantile_cont(value, 0.5), 4) AS DOUBLE) AS p50, round(quantile_cont(value, 0.95), 4) AS p95, round(quantile_cont(value, 0.99), 4) AS p99, round(max(value), 4) AS p100 FROM events GROUP BY 1")
def percentile_set(spark, sf):
    p = A.percentiles(table(spark, sf, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0})
    return p.select("event_type", *[F.round(n, 4).alias(n) for n in ("p50", "p95", "p99", "p100")])


KERNEL = (0.0545, 0.2442, 0.4026, 0.2442, 0.0545)  # fixed values: five Gaussian taps, sigma one cell, summing to one
VALUES = ", ".join(f"({i - 2}, {k})" for i, k in enumerate(KERNEL))


@query(f"""WITH s AS (SELECT {SX} / 5 - 0.5 AS fx, {SY} / 5 - 0.5 AS fy, 1 + s_suppkey % 5 AS w FROM supplier), q AS (SELECT CAST(floor(fx) AS BIGINT) + i AS gx, CAST(floor(fy) AS BIGINT) + j AS gy, w * CASE WHEN i = 1 THEN fx - floor(fx) ELSE 1 - (fx - floor(fx)) END * CASE WHEN j = 1 THEN fy - floor(fy) ELSE 1 - (fy - floor(fy)) END AS m FROM s, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j)),
g AS (SELECT gx, gy, sum(m) AS m FROM q GROUP BY 1, 2), k(i, v) AS (VALUES {VALUES}), h AS (SELECT gx + i AS gx, gy, sum(m * v) AS m FROM g, k GROUP BY 1, 2) SELECT gx, gy + i AS gy, round(sum(m * v), 5) AS heat FROM h, k GROUP BY 1, 2""")
def heat_splat_kernel(spark, sf):
    x, y = place(F.col("s_suppkey"))
    s = table(spark, sf, "supplier").select((x / 5 - 0.5).alias("fx"), (y / 5 - 0.5).alias("fy"), (1 + F.col("s_suppkey") % 5).alias("w"))
    return N.heat(s, KERNEL).withColumn("heat", F.round("heat", 5))


@query("SELECT c_mktsegment, round(avg(c_acctbal), 4) AS mean, round(median(c_acctbal), 4) AS median, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, c_mktsegment) AS INTEGER) AS rank FROM customer GROUP BY 1")
def summary_card(spark, sf):
    s = table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.round(F.avg("c_acctbal"), 4).alias("mean"), F.round(F.percentile("c_acctbal", 0.5), 4).alias("median"), F.count("*").alias("n"))
    return s.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "c_mktsegment")))


@query(f"WITH {CUST}, a AS (SELECT CAST(floor(x / 10) AS BIGINT) AS gx, CAST(floor(y / 10) AS BIGINT) AS gy, sum(residents)::DOUBLE AS w FROM c GROUP BY 1, 2), b AS (SELECT CAST(floor(x / 10) AS BIGINT) AS gx, CAST(floor(y / 10) AS BIGINT) AS gy, sum(jobs)::DOUBLE AS w FROM c GROUP BY 1, 2) SELECT round(0.5 * sum(abs(a.w / (SELECT sum(w) FROM a) - b.w / (SELECT sum(w) FROM b))), 6) AS tv FROM a JOIN b USING (gx, gy)")
def destination_tile_shift(spark, sf):
    c = cells(spark, sf)
    a, b = (c.select("gx", "gy", F.col(k).cast("double").alias("w")) for k in ("residents", "jobs"))
    return A.total_variation(a, b, ["gx", "gy"]).select(F.round("tv", 6).alias("tv"))
