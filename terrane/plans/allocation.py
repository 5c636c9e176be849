"""Allocation queries: soft targets, entropy balance, reservations, integer transport, sites."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.operators import allocation as A
from terrane.operators import flows as X
from terrane.operators import relational as R
from terrane.operators import sites as T
from terrane.plans.base import registry, shared, table

QUERIES, ORACLES, query = registry()

# Customers' nations are origins, suppliers' destinations; distances on a circle of nations.
GRID = "SELECT o.n_nationkey AS o, d.n_nationkey AS d, o.n_regionkey * 10 + d.n_regionkey AS g, CAST(abs(o.n_nationkey - d.n_nationkey) AS DOUBLE) AS distance FROM nation o CROSS JOIN nation d WHERE o.n_nationkey <> d.n_nationkey AND (o.n_nationkey + d.n_nationkey) % 4 <> 0"
OUT = "SELECT c_nationkey AS o, CAST(count(*) AS DOUBLE) AS budget FROM customer GROUP BY c_nationkey"
PULL = "SELECT n_nationkey AS d, CAST(n_nationkey % 7 + 1 AS DOUBLE) AS pull FROM nation"
EDGES = f"SELECT e.o, e.d, g, budget, ln(pull) - 12e-2 * distance AS score FROM ({GRID}) e JOIN ({OUT}) q ON q.o = e.o JOIN ({PULL}) p ON p.d = e.d"
TARGETS = f"SELECT d, pull * (SELECT sum(budget) FROM ({OUT}) q) / (SELECT sum(pull) FROM ({PULL}) p2) AS target FROM ({PULL}) p"
GOALS = f"SELECT g, CAST(sum(budget) / 6 AS DOUBLE) AS goal, CASE WHEN g % 2 = 0 THEN 1e-1 ELSE 2e0 END AS reliability FROM ({EDGES}) e GROUP BY g"


def balance_sql(rounds: int) -> str:
    """CTEs v, w and f of the balance after some rounds, from tables e, t and h."""
    out = ["v0 AS (SELECT d, target, 0::DOUBLE AS v FROM t)", "w0 AS (SELECT g, goal, reliability AS r, 0::DOUBLE AS w FROM h)"]

    def flow(n, v, w):
        return f"f{n} AS (SELECT o, d, g, exp(s - m) / sum(exp(s - m)) OVER (PARTITION BY o) * budget AS flow FROM (SELECT o, d, g, budget, s, max(s) OVER (PARTITION BY o) AS m FROM (SELECT o, e.d, e.g, budget, score - v - w AS s FROM e JOIN {v} USING (d) JOIN {w} USING (g))))"

    for k in range(rounds):
        out += [flow(2 * k, f"v{k}", f"w{k}"), f"v{k + 1} AS (SELECT d, target, CASE WHEN target > 0 AND n > 0 THEN least(greatest(v + ln(n / target), -15), 15) ELSE v END AS v FROM v{k} LEFT JOIN (SELECT d, sum(flow) AS n FROM f{2 * k} GROUP BY 1) USING (d))"]
        out += [flow(2 * k + 1, f"v{k + 1}", f"w{k}"), f"w{k + 1} AS (SELECT g, goal, r, CASE WHEN goal > 0 AND n > 0 THEN least(greatest(w + r / (1 + r) * (ln(n / goal) - w / r), -15 * r), 15 * r) ELSE w END AS w FROM w{k} LEFT JOIN (SELECT g, sum(flow) AS n FROM f{2 * k + 1} GROUP BY 1) USING (g))"]
    return ", ".join([*out, flow("", f"v{rounds}", f"w{rounds}")])


@query(f"WITH e AS ({EDGES}), t AS ({TARGETS}), h AS ({GOALS}), {balance_sql(2)} SELECT o, d, round(flow, 6) AS flow FROM f")
def entropy_balance_k2(spark, sf):
    out = A.entropy_balance(shared(spark, sf, EDGES), shared(spark, sf, TARGETS), shared(spark, sf, GOALS), rounds=2)
    return out.withColumn("flow", F.round("flow", 6))


@query(f"WITH e AS ({EDGES}), f AS (SELECT o, d, g, budget, exp(score) / sum(exp(score)) OVER (PARTITION BY o) * budget AS flow FROM e), a AS (SELECT 'd' AS kind, d AS id, o, sum(flow) AS f, max(budget) AS b FROM f GROUP BY d, o UNION ALL SELECT 'g', g, o, sum(flow), max(budget) FROM f GROUP BY g, o) SELECT kind, CAST(id AS VARCHAR) AS id, sum(f) AS total, sum(f * (1 - f / b)) AS curvature FROM a GROUP BY 1, 2")
def dual_statistics(spark, sf):
    return A.dual_statistics(A.normalised(shared(spark, sf, EDGES), F.col("score"), "budget"))


PRIOR = "SELECT c_nationkey AS a, c_custkey % 25 AS b, CAST(count(*) AS DOUBLE) AS flow FROM customer GROUP BY c_nationkey, c_custkey % 25"
SEEN = "SELECT c_nationkey AS a, c_custkey % 9 * 4 AS b, CAST(sum(c_custkey % 5) AS DOUBLE) AS weight, CAST(count(*) * 9 AS DOUBLE) AS ess FROM customer WHERE c_nationkey % 4 <> 0 GROUP BY c_nationkey, c_custkey % 9"


@query(f"WITH p AS ({PRIOR}), s AS ({SEEN}), m AS (SELECT a, sum(flow) AS mass FROM p GROUP BY 1), t AS (SELECT a, sum(weight) AS t FROM s GROUP BY 1), j AS (SELECT p.a, p.b, flow, mass, coalesce(weight, 0) AS seen, ess, coalesce(t, 0) AS t FROM p LEFT JOIN s USING (a, b) JOIN m USING (a) LEFT JOIN t USING (a)), i AS (SELECT *, sum(seen) OVER (PARTITION BY a) AS inside FROM j), k AS (SELECT *, greatest(CASE WHEN t > 0 THEN seen / t * mass + (1 - inside / t) * flow ELSE flow END, flow * 1e-6) AS goal FROM i) SELECT a, b, goal * mass / sum(goal) OVER (PARTITION BY a) AS target, CASE WHEN t > 0 THEN least(greatest(coalesce(ess, 0) / 100, 0.1), 10) ELSE 0.1 END::DOUBLE AS reliability FROM k")
def soft_municipal_targets(spark, sf):
    p = shared(spark, sf, PRIOR)
    return A.soft_targets(p, shared(spark, sf, SEEN), p.groupBy("a").agg(F.sum("flow").alias("mass")))


def projection_sql(rounds: int) -> str:
    out = ["w0 AS (SELECT o, d, exp(score) AS w FROM e)"]
    for k in range(rounds):
        out += [f"c{k} AS (SELECT o, w{k}.d, w * target / sum(w) OVER (PARTITION BY w{k}.d) AS w FROM w{k} JOIN t USING (d))", f"w{k + 1} AS (SELECT c{k}.o, d, w * budget / sum(w) OVER (PARTITION BY c{k}.o) AS w FROM c{k} JOIN q USING (o))"]
    return ", ".join(out)


@query(f"WITH e AS ({EDGES}), t AS ({TARGETS}), q AS ({OUT}), {projection_sql(4)} SELECT o, d, round(w, 6) AS flow FROM w4")
def margin_projection_k4(spark, sf):
    """Column and row scaling in turn; with a tolerance instead of rounds it goes on until no column is off."""
    e = shared(spark, sf, EDGES).select("o", "d", F.exp("score").alias("w"))
    out = X.ipf(e, shared(spark, sf, OUT).withColumnRenamed("budget", "out"), shared(spark, sf, TARGETS).withColumnRenamed("target", "in"), rounds=4)
    return out.withColumn("flow", F.round("flow", 6))


FORBIDDEN = "SELECT DISTINCT l_suppkey AS o, l_partkey % 97 + 1 AS d FROM lineitem"
PLACES = "SELECT s_suppkey AS id, s_suppkey * 37 % 1000 / 10e0 AS x, s_suppkey * 53 % 1000 / 10e0 AS y, s_nationkey % 3 AS zone, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_suppkey % 2 END AS component FROM supplier"


@query(f"WITH p AS ({PLACES}) SELECT a.id AS o, b.id AS d, round(sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2)), 6) AS distance FROM p a JOIN p b ON a.zone = b.zone AND a.id <> b.id AND (a.component IS NULL OR a.component = b.component) WHERE sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2)) BETWEEN 1e-9 AND 30 AND NOT EXISTS (SELECT 1 FROM ({FORBIDDEN}) f WHERE f.o = a.id AND f.d = b.id)")
def permitted_destinations(spark, sf):
    p = shared(spark, sf, PLACES)
    origins = p.select(F.col("id").alias("o"), "x", "y", "zone", "component")
    destinations = p.select(F.col("id").alias("d"), F.col("x").alias("dx"), F.col("y").alias("dy"), "zone", "component")
    return A.permitted(origins, destinations, shared(spark, sf, FORBIDDEN), reach=30.0).withColumn("distance", F.round("distance", 6))


@query(f"WITH q AS ({OUT}) SELECT CAST(sum(budget) AS BIGINT) AS travellers, least(300, CAST(sum(budget) AS BIGINT)) AS airport, 0::BIGINT AS beyond FROM q")
def poi_reservation(spark, sf):
    """Two quotas: the airport's comes first and is met in full if there are travellers; nobody is reserved twice."""
    q = shared(spark, sf, OUT).select("o", F.col("budget").cast("long").alias("travellers"))
    e = q.select("o", F.explode(F.array(F.struct(F.lit("AIR_1").alias("d"), (F.col("o") * 0.9).alias("distance")), F.struct(F.lit("MUS_1").alias("d"), (25 - F.col("o") * 0.5).alias("distance")))).alias("e")).select("o", "e.d", "e.distance")
    r = A.reserve(e, q, [("MUS_1", 45), ("AIR_1", 300)], cohort=10)
    used = r.groupBy("o").agg(F.sum("reserved").alias("used"))
    j = q.join(used, "o", "left").agg(F.sum("travellers").alias("travellers"), F.sum((F.coalesce("used", F.lit(0)) > F.col("travellers")).cast("long")).alias("beyond"))
    return j.join(r.where("d = 'AIR_1'").agg(F.sum("reserved").alias("airport")))


BUCKETS = "SELECT s_suppkey AS d, s, CAST((s_suppkey * 7 + s) % 11 / 3e0 AS DOUBLE) AS count FROM supplier CROSS JOIN (SELECT 50 AS s UNION ALL SELECT 20 UNION ALL SELECT 5) z"


def feedback_sql(sizes: list[int]) -> str:
    out, debt = [], "SELECT d, 0::DOUBLE AS owed FROM b"
    for k, s in enumerate(sizes):
        out.append(f"g{k} AS (SELECT d, count, CASE WHEN count > 0 THEN greatest(0, count + owed / {s}) ELSE 0 END AS raw FROM (SELECT d, count FROM b WHERE s = {s}) JOIN (SELECT d, sum(owed) AS owed FROM ({debt}) GROUP BY 1) USING (d))")
        out.append(f"h{k} AS (SELECT d, count, raw * (sum(count) OVER ()) / (sum(raw) OVER ()) AS goal FROM g{k})")
        out.append(f"i{k} AS (SELECT d, count, CAST(floor(goal) AS BIGINT) + CASE WHEN row_number() OVER (ORDER BY round(goal - floor(goal), 9) DESC, d) <= floor(sum(goal) OVER () + 0.5) - sum(floor(goal)) OVER () THEN 1 ELSE 0 END AS cohorts FROM h{k})")
        debt += f" UNION ALL SELECT d, {s} * (count - cohorts) FROM i{k}"
    return ", ".join(out)


@query(f"WITH b AS ({BUCKETS}), {feedback_sql([50, 20, 5])} SELECT size, CAST(sum(cohorts) AS BIGINT) AS cohorts FROM (SELECT 50 AS size, cohorts FROM i0 UNION ALL SELECT 20, cohorts FROM i1 UNION ALL SELECT 5, cohorts FROM i2) GROUP BY 1")
def feedback_rounding(spark, sf):
    """Cohorts by size after rounding, each bucket's total kept; who gets them follows the debt of the buckets before."""
    b = shared(spark, sf, BUCKETS).withColumnRenamed("s", "size")
    return A.round_with_feedback(b, [50, 20, 5]).groupBy("size").agg(F.sum("cohorts").alias("cohorts"))


WISHES = "SELECT c_nationkey % 4 AS zone, c_custkey % 12 AS o, s AS d, count(*) AS proposal FROM customer CROSS JOIN (SELECT 0 AS s UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) z WHERE (c_custkey + s) % 3 <> 0 GROUP BY c_nationkey % 4, c_custkey % 12, s"
SUPPLY = f"SELECT zone, o, CAST(sum(proposal) AS BIGINT) AS out FROM ({WISHES}) w GROUP BY zone, o"


@query(f"WITH w AS ({WISHES}) SELECT zone, CAST(sum(proposal) AS BIGINT) AS flow, 0::BIGINT AS bad_rows, 0::BIGINT AS bad_columns FROM w GROUP BY 1")
def integer_transport_bounds(spark, sf):
    """Mass, rows and columns of integer transport to even targets: rows exact, columns at the floor or ceiling."""
    w, s = shared(spark, sf, WISHES), shared(spark, sf, SUPPLY)
    w = w.withColumn("distance", F.abs(F.col("o") - F.col("d")).cast("double"))
    total = s.groupBy("zone").agg(F.sum("out").alias("t"))
    targets = w.select("zone", "d").distinct().join(total, "zone").select("zone", "d", (F.col("t") / 5).alias("target"))
    f = A.integer_transport(w, s, targets)
    rows = f.groupBy("zone", "o").agg(F.sum("flow").alias("n")).join(s, ["zone", "o"], "full_outer").groupBy("zone").agg(F.sum((F.coalesce("n", F.lit(0)) != F.col("out")).cast("long")).alias("bad_rows"))
    columns = f.groupBy("zone", "d").agg(F.sum("flow").alias("n")).join(targets, ["zone", "d"], "full_outer").groupBy("zone").agg(F.sum((F.abs(F.coalesce("n", F.lit(0)) - F.col("target")) >= 1).cast("long")).alias("bad_columns"))
    return f.groupBy("zone").agg(F.sum("flow").alias("flow")).join(rows, "zone").join(columns, "zone")


@query(f"WITH w AS ({WISHES}), s AS (SELECT zone, sum(proposal) AS t FROM w GROUP BY 1) SELECT zone, CAST(t AS DOUBLE) AS supply, CASE WHEN zone = 3 THEN t ELSE 0 END::DOUBLE AS deficit FROM s")
def transport_feasibility(spark, sf):
    """What cannot arrive: nothing where all pairs serve, everything in the zone whose targets lie at an end that no pair reaches."""
    w, s = shared(spark, sf, WISHES), shared(spark, sf, SUPPLY)
    total = s.groupBy("zone").agg(F.sum("out").alias("t"))
    near = w.select("zone", "d").distinct().where("zone <> 3").join(total, "zone").select("zone", "d", (F.col("t") / 5).alias("target"))
    far = total.where("zone = 3").select("zone", F.lit(99).alias("d"), F.col("t").cast("double").alias("target"))
    none = w.where("zone = 3").select("zone", "d").distinct().select("zone", "d", F.lit(0.0).alias("target"))
    return A.feasibility(w.withColumn("distance", F.lit(1.0)), s, near.unionByName(far).unionByName(none))


@query("WITH p AS (SELECT s_suppkey AS id, s_suppkey % 20 AS component FROM supplier), e AS (SELECT DISTINCT component AS a, (component + 10) % 20 AS b FROM p WHERE component % 3 = 0) SELECT p.id, CASE WHEN component % 10 IN (0, 3, 6, 9) OR component IN (2, 5, 8, 12, 15, 18) THEN least(component, (component + 10) % 20) ELSE component END AS component FROM p")
def connectivity_reconcile(spark, sf):
    """Components joined where a route is accepted both ways: k with k + 10 for multiples of 3."""
    p = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 20).alias("component"))
    first = p.groupBy("component").agg(F.min("id").alias("id"))
    pairs = first.alias("x").join(first.alias("y"), (F.col("x.component") + 10) % 20 == F.col("y.component")).where("x.component % 3 = 0").select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    one_way = first.alias("x").join(first.alias("y"), F.col("x.component") + 1 == F.col("y.component")).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.lit(True).alias("accepted"))
    evidence = pairs.select("a", "b", F.lit(True).alias("accepted")).unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(True).alias("accepted"))).unionByName(one_way)
    return A.reconcile(p, evidence)


NO_ROUTE = "SELECT DISTINCT s_nationkey AS o, s_suppkey * 7 % 25 AS d FROM supplier"


@query(f"WITH e AS ({GRID}), n AS ({NO_ROUTE}), k AS (SELECT e.o, e.d, n.o IS NULL AS good FROM e LEFT JOIN n ON n.o = e.o AND n.d = e.d), f AS (SELECT o, min(CASE WHEN good THEN d END) AS d FROM k GROUP BY o), b AS (SELECT k.o, count(CASE WHEN f.d IS NULL OR k.d < f.d THEN 1 END) + CASE WHEN f.d IS NULL THEN 0 ELSE 1 END AS tries FROM k JOIN f ON f.o = k.o GROUP BY k.o, f.d) SELECT o, d, (SELECT CAST(max(tries) AS INTEGER) FROM b) AS rounds FROM f WHERE d IS NOT NULL")
def support_refinement(spark, sf):
    """Each origin takes its first destination; used pairs without a route in a table of them are left out, until all used ones have one."""
    pairs, lacking = shared(spark, sf, GRID).select("o", "d"), shared(spark, sf, NO_ROUTE)

    def solve(p):
        return p.groupBy("o").agg(F.min("d").alias("d"))

    def route(f):
        return f.select("o", "d").join(lacking, ["o", "d"], "left_semi")

    flows, rounds = A.refine_support(pairs, solve, route, rounds=30)
    return flows.withColumn("rounds", F.lit(rounds))


SITES = "SELECT c_custkey AS id, c_custkey % 30 AS lon, c_custkey % 7 AS lat, c_nationkey % 5 AS municipality, 1 AS zone, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE 1 END AS component, c_custkey % 3 AS attraction, c_custkey % 41 = 0 AS special FROM customer"


@query(f"WITH s AS ({SITES}), k AS (SELECT *, CASE WHEN special THEN id END AS lone FROM s) SELECT id, first_value(id) OVER (PARTITION BY lon, lat, municipality, zone, component, lone ORDER BY attraction <= 0, id) AS site FROM k")
def site_collapse(spark, sf):
    return T.collapse_sites(shared(spark, sf, SITES))


TRAVEL = "SELECT c_custkey AS id, 1 AS zone, CAST(NULL AS INT) AS component, c_nationkey AS municipality, -99 + c_custkey * 37 % 1000 / 1000e2 AS lon, 19 + c_custkey * 53 % 1000 / 1000e2 AS lat, c_custkey % 40 AS travellers FROM customer"


@query(f"WITH t AS ({TRAVEL}) SELECT id, CAST(travellers AS BIGINT) AS taken FROM t WHERE travellers > 0")
def fixed_groups_mass(spark, sf):
    """Every traveller is in exactly one group, and no group is larger than asked."""
    g = T.fixed_groups(shared(spark, sf, TRAVEL), 25)
    over = g.groupBy("grp").agg(F.sum("taken").alias("n")).where("n > 25").count()
    if over:
        raise ValueError("a group is too large")
    return g.groupBy("id").agg(F.sum("taken").alias("taken"))


@query("WITH c AS (SELECT s_suppkey AS id, s_suppkey * 37 % 1000 * 1.0 AS x, s_suppkey * 53 % 1000 * 1.0 AS y, s_suppkey % 10 = 0 AS big FROM supplier) SELECT count(*) AS cells, CAST(sum(CASE WHEN big THEN 1 ELSE 0 END) AS BIGINT) AS big, 0::BIGINT AS far FROM c")
def small_cells(spark, sf):
    """Small cells go to a larger one within reach or stay: no cell moves further than reach."""
    k = F.col("s_suppkey")
    c = table(spark, sf, "supplier").select(k.alias("id"), F.lit(1).alias("zone"), (k * 37 % 1000 * 1.0).alias("x"), (k * 53 % 1000 * 1.0).alias("y"), F.lit(1.0).alias("weight"), F.when(k % 10 == 0, 100).otherwise(1).alias("jobs"), F.lit(1).alias("residents"))
    m = T.merge_small_cells(c, jobs=50, residents=50, reach=120.0)
    to = c.select(F.col("id").alias("cell"), F.col("x").alias("cx"), F.col("y").alias("cy"))
    j = m.join(c, "id").join(to, "cell")
    far = F.sqrt(F.pow(F.col("x") - F.col("cx"), 2) + F.pow(F.col("y") - F.col("cy"), 2)) > 120
    return j.agg(F.count("*").alias("cells"), F.sum((F.col("jobs") >= 50).cast("long")).alias("big"), F.sum(far.cast("long")).alias("far"))


@query("SELECT CAST(sum(c_custkey % 90 + 1) AS BIGINT) AS travellers, CAST(max(c_custkey % 90 + 1) AS BIGINT) <= 120 AS within FROM customer")
def small_flow_consolidation(spark, sf):
    """Two passes, by job and by residence: the mass stays, no cohort exceeds the most that one may hold."""
    k = F.col("c_custkey")
    f = table(spark, sf, "customer").select((k % 60).alias("o"), F.col("c_nationkey").alias("d"), (k % 90 + 1).cast("long").alias("size"), F.lit(300).cast("long").alias("seconds"), F.lit(2000).cast("long").alias("metres"), (k % 60 * 40.0).alias("x"), (k % 7 * 100.0).alias("y"))
    f = T.consolidate(f, anchor="d", other="o", small=25, reach=2000.0, most=120)
    f = T.consolidate(f, anchor="o", other="d", small=25, reach=2000.0, most=120)
    return f.agg(F.sum("size").alias("travellers"), (F.max("size") <= 120).alias("within"))


@query("SELECT CAST(sum(c_custkey % 300) AS BIGINT) AS size, count(*) AS points, 0::BIGINT AS shared FROM customer")
def point_clusters(spark, sf):
    """Greedy clusters: every point has one site, and no commute has both ends in one."""
    k = F.col("c_custkey")
    points = table(spark, sf, "customer").select(k.alias("id"), (k % 4).cast("int").alias("zone"), (-99 + k * 37 % 1000 / 100000.0).alias("lon"), (19 + k * 53 % 1000 / 100000.0).alias("lat"), (k % 300).cast("double").alias("size"), (k % 97 == 0).alias("special"))
    commutes = table(spark, sf, "customer").select(k.alias("a"), (k + 4).alias("b"))
    c = T.cluster_points(points, commutes)
    site = c.select("id", "site")
    ends = commutes.join(site.select(F.col("id").alias("a"), F.col("site").alias("sa")), "a").join(site.select(F.col("id").alias("b"), F.col("site").alias("sb")), "b")
    both = ends.agg(F.coalesce(F.sum((F.col("sa") == F.col("sb")).cast("long")), F.lit(0)).alias("shared"))
    return points.join(site, "id").agg(F.sum("size").cast("long").alias("size"), F.count("*").alias("points")).join(both)


@query("SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN greatest(s_suppkey % 50, s_suppkey % 80) WHEN 1 THEN s_suppkey % 50 + s_suppkey % 80 WHEN 2 THEN s_suppkey % 50 ELSE greatest(s_suppkey % 50, s_suppkey % 80) END AS jobs FROM supplier")
def absorbed_jobs(spark, sf):
    k = F.col("s_suppkey")
    mode = F.element_at(F.array(F.lit("MAX"), F.lit("boost"), F.lit("REPLACE"), F.lit("?")), (k % 4).cast("int") + 1)
    p = table(spark, sf, "supplier").select(k.alias("id"), (k % 50).alias("manual"), (k % 80 + 0.25).alias("captured"), mode.alias("mode"))
    return p.select("id", T.absorb("manual", "captured", "mode").alias("jobs"))


@query("WITH l AS (SELECT c_nationkey AS a, c_custkey % 25 AS b, c_custkey % 7 + 1 AS w FROM customer), s AS (SELECT * FROM (VALUES (0.06, 0.02), (0.09, 0.01), (0.12, 0.03), (0.18, 0.02), (0.24, 0.05)) c(beta, error)), x AS (SELECT beta, error, sum(w * abs(beta - 0.17)) / sum(w) AS loss FROM s, l GROUP BY 1, 2), m AS (SELECT min(loss) AS best FROM x) SELECT min_by(beta, abs(beta - 0.12) * 1000 + beta)::DOUBLE AS beta FROM x, m WHERE loss - best <= error + 1e-12")
def beta_selection(spark, sf):
    """The decay nearest to the reference within one standard error of the best loss."""
    s = spark.createDataFrame([(0.06, 0.02), (0.09, 0.01), (0.12, 0.03), (0.18, 0.02), (0.24, 0.05)], "beta double, error double")
    w = F.col("c_custkey") % 7 + 1
    losses = table(spark, sf, "customer").join(F.broadcast(s)).groupBy("beta", "error").agg((F.sum(w * F.abs(F.col("beta") - 0.17)) / F.sum(w)).alias("loss"))
    return spark.createDataFrame([(A.choose_beta(losses, base=0.12, guard_gain=1.0, margin=0.0),)], "beta double")


HALVES = "(SELECT sum(CASE WHEN d <= 9 THEN 1 ELSE -1 END * n * exp(-(low + high) / 2 * d)) FROM h)"


@query(f"WITH RECURSIVE h AS (SELECT c_custkey % 40 AS d, count(*) AS n FROM customer GROUP BY 1), b(k, low, high) AS (SELECT 0, 0e0, 2e0 UNION ALL SELECT k + 1, CASE WHEN {HALVES} < 0 THEN (low + high) / 2 ELSE low END, CASE WHEN {HALVES} < 0 THEN high ELSE (low + high) / 2 END FROM b WHERE k < 60) SELECT round((low + high) / 2, 9) AS beta, round((SELECT sum(CASE WHEN d <= 9 THEN n * exp(-(low + high) / 2 * d) ELSE 0 END) / sum(n * exp(-(low + high) / 2 * d)) FROM h), 6) AS near FROM b WHERE k = 60")
def beta_for_median(spark, sf):
    """The decay whose opportunities have their median at 9 km, and their share on the near side."""
    h = table(spark, sf, "customer").groupBy((F.col("c_custkey") % 40).alias("d")).agg(F.count("*").alias("n"))
    beta = X.beta_for_median([(float(r["d"]), float(r["n"])) for r in h.collect()], 9.0)  # forty bins
    w = F.col("n") * F.exp(-beta * F.col("d"))
    near = F.sum(F.when(F.col("d") <= 9, w)) / F.sum(w)
    return h.agg(F.round(F.lit(beta), 9).alias("beta"), F.round(near, 6).alias("near"))


SCREEN = "SELECT o.n_nationkey AS o, d.n_nationkey AS d, CAST(abs(o.n_nationkey - d.n_nationkey) AS DOUBLE) AS km, CAST(d.n_nationkey % 7 + 1 AS DOUBLE) AS pull FROM nation o CROSS JOIN nation d WHERE o.n_nationkey <> d.n_nationkey"


def screen_sql(beta: float) -> str:
    return f"SELECT d, sum(flow) AS w, sum(CASE WHEN km > 10 THEN flow ELSE 0 END) AS tail FROM (SELECT d, km, pull * exp(-{beta} * km) / sum(pull * exp(-{beta} * km)) OVER (PARTITION BY o) AS flow FROM s) GROUP BY d"


@query(f"WITH s AS ({SCREEN}), a AS ({screen_sql(0.12)}), b AS ({screen_sql(0.24)}) SELECT sum(abs(a.w - b.w)) / 2 / sum(a.w) AS variation, abs(sum(a.tail) - sum(b.tail)) / sum(a.w) AS tail_change FROM a JOIN b USING (d)")
def sensitivity_screen(spark, sf):
    """How far destination shares and long trips move when the decay doubles."""
    s = shared(spark, sf, SCREEN)

    def shares(beta, name):
        f = A.normalised(s.withColumn("one", F.lit(1.0)), F.ln("pull") - beta * F.col("km"), "one")
        return f.groupBy("d").agg(F.sum("flow").alias(name), F.sum(F.when(F.col("km") > 10, F.col("flow")).otherwise(0.0)).alias(f"{name}_tail"))

    j = shares(0.12, "a").join(shares(0.24, "b"), "d")
    return j.agg((F.sum(F.abs(F.col("a") - F.col("b"))) / 2 / F.sum("a")).alias("variation"), (F.abs(F.sum("a_tail") - F.sum("b_tail")) / F.sum("a")).alias("tail_change"))


NODES = "SELECT CAST(p_partkey AS STRING) AS code, CASE WHEN length(CAST(p_partkey AS STRING)) = 1 THEN NULL ELSE CASE WHEN p_partkey % 11 = 0 THEN '9' ELSE substr(CAST(p_partkey AS STRING), 1, length(CAST(p_partkey AS STRING)) - 1) END END AS parent FROM part"


@query(f"WITH RECURSIVE n AS ({NODES}), w AS (SELECT code, code AS root, 0 AS level FROM n WHERE parent IS NULL UNION ALL SELECT n.code, w.root, level + 1 FROM n JOIN w ON n.parent = w.code AND starts_with(n.code, w.code) AND length(n.code) > length(w.code)) SELECT * FROM w")
def hierarchy_walk(spark, sf):
    """Children that extend their parent's code, from one-digit roots; wrong parents lead nowhere."""
    n = shared(spark, sf, NODES)
    return R.walk_hierarchy(n.where("parent is not null"), n.where("parent is null"), depth=9)


@query("WITH c AS (SELECT c_custkey AS id, c_custkey * 37 % 1000 / 10.0::DOUBLE AS x, c_custkey * 53 % 1000 / 10.0::DOUBLE AS y FROM customer), s AS (SELECT s_suppkey AS target, s_suppkey * 37 % 1000 / 10.0::DOUBLE AS tx, s_suppkey * 53 % 1000 / 10.0::DOUBLE AS ty FROM supplier), d AS (SELECT id, target, sqrt(pow(tx - x, 2) + pow(ty - y, 2)) AS distance FROM c, s) SELECT id, target, round(distance, 6) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY distance, target) = 1")
def nearest_any_distance(spark, sf):
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    points = table(spark, sf, "customer").select(k.alias("id"), (k * 37 % 1000 / 10.0).alias("x"), (k * 53 % 1000 / 10.0).alias("y"))
    targets = table(spark, sf, "supplier").select(s.alias("target"), (s * 37 % 1000 / 10.0).alias("tx"), (s * 53 % 1000 / 10.0).alias("ty"))
    return R.nearest(points, targets, start=1.0).withColumn("distance", F.round("distance", 6))


LINES = "SELECT s_suppkey AS segment, s_suppkey * 37 % 1000 / 10e0 AS ax, s_suppkey * 53 % 1000 / 10e0 AS ay, s_suppkey * 37 % 1000 / 10e0 + s_suppkey % 5 AS bx, s_suppkey * 53 % 1000 / 10e0 + s_suppkey % 4 AS b_y FROM supplier"


@query(f"WITH c AS (SELECT c_custkey AS id, c_custkey * 37 % 1000 / 10.0::DOUBLE AS px, c_custkey * 59 % 1000 / 10.0::DOUBLE AS py FROM customer), s AS ({LINES}), t AS (SELECT *, CASE WHEN pow(bx - ax, 2) + pow(b_y - ay, 2) > 0 THEN least(greatest(((px - ax) * (bx - ax) + (py - ay) * (b_y - ay)) / (pow(bx - ax, 2) + pow(b_y - ay, 2)), 0), 1) ELSE 0 END AS t FROM c, s), d AS (SELECT id, segment, ax + t * (bx - ax) AS x, ay + t * (b_y - ay) AS y, sqrt(pow(px - ax - t * (bx - ax), 2) + pow(py - ay - t * (b_y - ay), 2)) AS distance FROM t) SELECT id, segment, round(distance, 6) AS distance, round(x, 6) AS x, round(y, 6) AS y FROM d WHERE distance <= 3 QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(distance, 9), segment) = 1")
def nearest_line(spark, sf):
    k = F.col("c_custkey")
    points = table(spark, sf, "customer").select(k.alias("id"), (k * 37 % 1000 / 10.0).alias("x"), (k * 59 % 1000 / 10.0).alias("y"))
    out = R.nearest_line(points, shared(spark, sf, LINES).withColumnRenamed("b_y", "by"), 3.0)
    return out.select("id", "segment", *[F.round(c, 6).alias(c) for c in ("distance", "x", "y")])
