"""Queries of converged and blocked allocation, controlled rounding and the choice of a decay."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from terrane.operators import dual as D
from terrane.operators import friction as B
from terrane.operators import rounding as N
from terrane.plans.allocation import EDGES, GOALS, TARGETS, balance_sql
from terrane.plans.base import registry, shared

QUERIES, ORACLES, query = registry()
ROUNDS = 40  # of plain scaling in SQL, by which these small problems stand still


def settled_sql(edges: str, targets: str, goals: str, rounds: int = ROUNDS) -> str:
    """The balance after many rounds of scaling one side after the other, each step computed once."""
    steps = balance_sql(rounds).replace(" AS (SELECT", " AS MATERIALIZED (SELECT")
    return f"WITH e AS MATERIALIZED ({edges}), t AS MATERIALIZED ({targets}), h AS MATERIALIZED ({goals}), {steps}"


@query(settled_sql(EDGES, TARGETS, GOALS) + " SELECT o, CAST(d AS VARCHAR) AS d, round(flow, 2) AS flow FROM f")
def entropy_optimum(spark, sf):
    """Flows at the optimum of the dual, from a table of pairs."""
    p = D.Edges(shared(spark, sf, EDGES))
    fit = D.fit(p, shared(spark, sf, TARGETS), shared(spark, sf, GOALS))
    return p.flows(fit.prices).withColumn("flow", F.round("flow", 2))


# Nations on a circle: origins with their customers, destinations with a pull, all pairs of a zone.
SPOTS = "SELECT n_nationkey AS id, 10 * cos(n_nationkey) AS x, 10 * sin(n_nationkey) AS y, n_regionkey % 2 AS zone, n_regionkey AS place, n_nationkey % 7 + 1 AS pull FROM nation"
TRAVELLERS = "SELECT c_nationkey AS id, CAST(count(*) AS DOUBLE) AS budget FROM customer GROUP BY c_nationkey"
ALL_PAIRS = f"SELECT a.id AS o, b.id AS d, CAST(a.place AS VARCHAR) || '>' || CAST(b.place AS VARCHAR) AS g, q.budget, ln(b.pull) - 12e-2 * sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS score FROM ({SPOTS}) a JOIN ({TRAVELLERS}) q ON q.id = a.id JOIN ({SPOTS}) b ON b.zone = a.zone AND b.id <> a.id"
ZONE_TARGETS = f"SELECT b.id AS d, b.pull * m.mass / m.pull AS target FROM ({SPOTS}) b JOIN (SELECT zone, sum(coalesce(budget, 0)) AS mass, sum(pull) AS pull FROM ({SPOTS}) s LEFT JOIN ({TRAVELLERS}) q USING (id) GROUP BY zone) m ON m.zone = b.zone"
PLACE_GOALS = f"SELECT g, CAST(sum(budget) / 7 AS DOUBLE) AS goal, 5e-1 AS reliability FROM ({ALL_PAIRS}) e GROUP BY g"


@query(settled_sql(ALL_PAIRS, ZONE_TARGETS, PLACE_GOALS) + " SELECT o, CAST(d AS VARCHAR) AS d, round(flow, 2) AS flow FROM f")
def blocked_allocation(spark, sf):
    """The same optimum from points alone: blocks of origins meet all destinations in memory, no table of pairs is made before the result."""
    spots = shared(spark, sf, SPOTS)
    origins = spots.join(shared(spark, sf, TRAVELLERS), "id").select(F.col("id").alias("o"), "x", "y", "zone", "place", "budget")
    p = D.Blocks(origins, spots.select(F.col("id").alias("d"), "x", "y", "zone", "place", "pull"), beta=0.12)
    # Goals of pairs of places: what the origins of one have, times the destinations of the other they may choose.
    name = lambda c: F.col("place").cast("string").alias(c)
    ends = spots.groupBy(name("b"), "zone").agg(F.count("*").alias("n"))
    whole = origins.groupBy(name("a"), "zone").agg(F.sum("budget").alias("m")).join(ends, "zone").select("a", "b", (F.col("m") * F.col("n")).alias("w"))
    own = origins.select(name("a"), name("b"), (-F.col("budget")).alias("w"))  # nobody travels to where they start
    goals = whole.unionByName(own).groupBy("a", "b").agg((F.sum("w") / 7).alias("goal")).where("goal > 1e-9")
    goals = goals.select(F.concat("a", F.lit(">"), "b").alias("g"), "goal", F.lit(0.5).alias("reliability"))
    pull = spots.groupBy("zone").agg(F.sum("pull").alias("pulls")).join(origins.groupBy("zone").agg(F.sum("budget").alias("mass")), "zone")
    targets = spots.join(pull, "zone").select(F.col("id").alias("d"), (F.col("pull") * F.col("mass") / F.col("pulls")).alias("target"))
    fit = D.fit(p, targets, goals)
    return p.flows(fit.prices).withColumn("flow", F.round("flow", 2))


TABLE = "SELECT CAST(n.n_regionkey AS VARCHAR) AS g, c_nationkey AS i, c_mktsegment AS j, count(*) AS n, max(c_custkey) AS k FROM customer JOIN nation n ON n.n_nationkey = c_nationkey GROUP BY n.n_regionkey, c_nationkey, c_mktsegment"
SHARES = f"SELECT g, i, j, round(t.people / 3) * n / t.people AS value FROM ({TABLE}) c JOIN (SELECT i, sum(n) AS people FROM ({TABLE}) x GROUP BY i) t USING (i)"


@query(f"SELECT g, i, CAST(round(sum(value)) AS BIGINT) AS units, 0::BIGINT AS far FROM ({SHARES}) s GROUP BY g, i UNION ALL SELECT g, -1, CAST(round(sum(value)) AS BIGINT), 0 FROM ({SHARES}) s GROUP BY g")
def controlled_rounding(spark, sf):
    """Cohorts of nations by segment: each nation's and region's units, and how many cells, columns or regions pass their bounds."""
    cells = shared(spark, sf, SHARES.replace("VARCHAR", "STRING"))
    done = cells.join(N.controlled(cells), ["g", "i", "j"])
    rows = done.groupBy("g", "i").agg(F.sum("units").alias("units"), F.sum((F.abs(F.col("units") - F.col("value")) >= 1).cast("long")).alias("far"))
    columns = done.groupBy("g", "j").agg(F.sum("units").alias("units"), F.sum("value").alias("value"), F.sum(F.abs(F.col("units") - F.col("value"))).alias("cost"))
    whole = columns.groupBy("g").agg(F.sum("units").alias("units"), F.sum((F.abs(F.col("units") - F.col("value")) >= 1).cast("long")).alias("far"), F.sum("cost").alias("cost"))
    whole = whole.join(N.bound(cells), "g").select("g", F.lit(-1).cast("int").alias("i"), "units", (F.col("far") + (F.col("cost") > F.col("bound") + 1e-6).cast("long")).alias("far"))
    return rows.unionByName(whole)


# Trips of customers to the nations of their suppliers: six in ten tell the flows, two choose, two guard.
TRIPS = "SELECT l_orderkey * 10 + l_linenumber AS id, c_nationkey AS o, s_nationkey AS d, CAST(1 + l_linenumber % 3 AS DOUBLE) AS weight, CASE WHEN l_orderkey % 2 = 0 THEN 'selection' ELSE 'guard' END AS side FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE abs(c_nationkey - s_nationkey) <= 3 + l_linenumber"
PULLED = "SELECT s_nationkey AS d, count(*) AS pull FROM supplier GROUP BY s_nationkey"
CHOICES = " UNION ALL ".join(f"SELECT {b} AS beta" for b in B.RIVALS)
WEIGHTED = f"SELECT CAST(beta AS DOUBLE) AS beta, n_nationkey AS o, d, pull * exp(-CAST(beta AS DOUBLE) * abs(n_nationkey - d)) AS w FROM ({CHOICES}) b CROSS JOIN nation CROSS JOIN ({PULLED}) p"
PROBABLE = f"SELECT w.beta, w.o, d, w / t.total AS p FROM ({WEIGHTED}) w JOIN (SELECT beta, o, sum(w) AS total FROM ({WEIGHTED}) x GROUP BY beta, o) t ON t.beta = w.beta AND t.o = w.o"
DRAWS = " + ".join(f"(u >= {sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))!r}::DOUBLE)::INTEGER" for k in range(12))
REPLICATES = 40


@query(f"""WITH r AS MATERIALIZED ({TRIPS}), p AS MATERIALIZED ({PROBABLE}), x AS MATERIALIZED (SELECT side, id, weight, beta, -ln(greatest(p, 1e-12)) AS loss FROM r JOIN p USING (o, d)),
u AS MATERIALIZED (SELECT DISTINCT id, rep, CAST('0x' || substr(md5(id || '|' || rep), 1, 8) AS BIGINT) / 4294967296e0 AS u FROM r, range({REPLICATES + 1}) q(rep)), w AS MATERIALIZED (SELECT id, rep, CASE WHEN rep = 0 THEN 1 ELSE {DRAWS} END AS times FROM u),
l AS MATERIALIZED (SELECT side, rep, beta, sum(times * weight * loss) / sum(times * weight) AS loss FROM x JOIN w USING (id) GROUP BY ALL), k AS (SELECT side, pow(sum(weight), 2) / sum(pow(weight, 2)) AS n FROM r GROUP BY side),
best AS (SELECT beta FROM l WHERE side = 'selection' AND rep = 0 ORDER BY loss, abs(beta - 0.12), beta LIMIT 1), s AS (SELECT l.beta, l.rep, l.loss, l.loss - m.loss AS gain FROM l JOIN l m ON m.side = 'selection' AND l.side = 'selection' AND m.rep = l.rep AND m.beta = (SELECT beta FROM best)),
d AS (SELECT beta, max(CASE WHEN rep = 0 THEN loss END) AS loss, max(CASE WHEN rep = 0 THEN gain END) AS gain, stddev_samp(CASE WHEN rep > 0 THEN gain END) AS error FROM s GROUP BY beta), c AS (SELECT beta FROM d WHERE gain <= error + 1e-12 ORDER BY abs(beta - 0.12), beta LIMIT 1),
g AS (SELECT a.rep, a.loss - b.loss AS gain FROM l a JOIN l b ON a.side = 'guard' AND b.side = 'guard' AND a.rep = b.rep AND a.beta = 0.12 AND b.beta = (SELECT beta FROM c)), v AS (SELECT max(CASE WHEN rep = 0 THEN gain END) AS gain, quantile_cont(gain, 0.05) FILTER (rep > 0) AS low FROM g),
o AS (SELECT (SELECT min(n) FROM k) >= 30 AS enough)
SELECT d.beta, round(loss, 8) AS loss, round(d.gain, 8) AS gain, round(error, 8) AS error, d.gain <= error + 1e-12 AS eligible, (SELECT beta FROM c) AS proposed, CASE WHEN low > 0 AND (SELECT beta FROM c) <> 0.12 THEN (SELECT beta FROM c) ELSE 0.12e0 END AS selected, round(v.gain, 8) AS guard_gain, round(low, 8) AS guard_low FROM d, v, o WHERE enough""")
def beta_bootstrap(spark, sf):
    """The decay that trips choose and others guard, by paired Poisson replicates that SQL repeats with the same hash."""
    got = B.select_beta(shared(spark, sf, TRIPS), shared(spark, sf, PROBABLE), replicates=REPLICATES)
    r8 = lambda c, n: F.round(c, 8).alias(n)
    return got.select("*", F.explode("decays").alias("x")).select("x.beta", r8("x.loss", "loss"), r8("x.gain", "gain"), r8("x.error", "error"), "x.eligible", "proposed", "selected", r8("guard_gain", "guard_gain"), r8("guard_low", "guard_low"))
