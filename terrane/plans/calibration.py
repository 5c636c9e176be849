"""Calibration queries: controls, residuals, rounding."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.functions import scalars as S
from terrane.operators import calibrate as C
from terrane.operators.relational import keep_first
from terrane.plans.base import registry, table

QUERIES, ORACLES, query = registry()


@query("""WITH u AS (SELECT s_nationkey AS g, CAST(l_quantity AS BIGINT) AS jobs, p_size <= 25 AS is_micro FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey),
s AS (SELECT g, sum(CASE WHEN is_micro THEN jobs ELSE 0 END) AS micro, sum(CASE WHEN NOT is_micro THEN jobs ELSE 0 END) AS large, count(*) AS units FROM u GROUP BY g),
c AS (SELECT s_nationkey AS g, CAST(sum(l_quantity) * (0.8 + (s_nationkey % 5) * 0.2) AS BIGINT) AS control FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey % 6 <> 0 GROUP BY 1),
j AS (SELECT s.*, control, (control - large) / micro AS raw FROM s LEFT JOIN c USING (g)),
k AS (SELECT *, CASE WHEN control IS NULL THEN 'no control' WHEN units < 1500 THEN 'small sample' WHEN micro <= 0 THEN 'no micro' WHEN large >= control THEN 'formal excess' WHEN raw > 1 / 0.55 THEN 'capped' ELSE 'calibrated' END AS status FROM j)
SELECT g, CAST(micro AS BIGINT) AS micro, CAST(large AS BIGINT) AS large, units, control, round(CASE WHEN status IN ('no control', 'small sample') THEN 1.45 WHEN status IN ('no micro', 'formal excess') THEN 1.0 ELSE least(greatest(raw, 1.0), 1 / 0.55) END, 6)::DOUBLE AS factor, status FROM k""")
def calibrate_asymmetric(spark, sf):
    line, sup, part = (table(spark, sf, t) for t in ("lineitem", "supplier", "part"))
    ls = line.join(sup, F.col("l_suppkey") == F.col("s_suppkey"))
    units = ls.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("s_nationkey").alias("g"), F.col("l_quantity").cast("long").alias("jobs"), (F.col("p_size") <= 25).alias("is_micro"))
    scale = F.lit(0.8).cast("decimal(3,1)") + (F.col("s_nationkey") % 5) * F.lit(0.2).cast("decimal(3,1)")
    control = ls.where("s_nationkey % 6 <> 0").groupBy("s_nationkey").agg(F.sum("l_quantity").alias("q")).select(F.col("s_nationkey").alias("g"), F.round(F.col("q") * scale.cast("double")).cast("long").alias("control"))
    return C.asymmetric(units, control, group="g", informal=0.45, least=1500).withColumn("factor", F.round("factor", 6))


KIDS = "k AS (SELECT c_custkey AS id, c_nationkey AS parent, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey % 50 END AS v, 10 + c_custkey % 40 AS cap FROM customer), t AS (SELECT c_nationkey AS parent, CAST(30 * count(*) AS BIGINT) AS control FROM customer WHERE c_nationkey % 5 <> 0 GROUP BY 1)"


def kids(spark, sf):
    c = table(spark, sf, "customer")
    k = c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("parent"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey") % 50).alias("v"), (10 + F.col("c_custkey") % 40).alias("cap"))
    return k, c.where("c_nationkey % 5 <> 0").groupBy(F.col("c_nationkey").alias("parent")).agg((30 * F.count("*")).alias("control"))


@query(f"WITH {KIDS}, w AS (SELECT k.*, control, sum(coalesce(v, 0)) OVER (PARTITION BY k.parent) AS p, sum(CASE WHEN v IS NULL THEN cap ELSE 0 END) OVER (PARTITION BY k.parent) AS c FROM k LEFT JOIN t ON k.parent = t.parent) SELECT id, parent, v, cap, round(CASE WHEN v IS NOT NULL THEN v WHEN control IS NULL OR c <= 0 THEN NULL ELSE least(cap::DOUBLE, greatest(control - p, 0) * cap / c::DOUBLE) END, 6)::DOUBLE AS filled, CASE WHEN v IS NOT NULL THEN 'published' WHEN control IS NULL OR c <= 0 THEN 'unresolved' ELSE 'allocated' END AS source FROM w")
def parent_residual_allocation(spark, sf):
    k, t = kids(spark, sf)
    return C.parent_residual(k, t, parent="parent", value="v", capacity="cap").withColumn("filled", F.round("filled", 6))


@query("""WITH k AS (SELECT c_custkey AS id, c_mktsegment || c_nationkey AS a, c_nationkey AS l, CASE WHEN c_custkey % 4 = 0 OR (c_nationkey % 3 = 0 AND c_mktsegment <= 'C') THEN NULL ELSE c_custkey % 50 END AS v, c_custkey % 40 AS cap FROM customer),
r AS (SELECT *, sum(v) OVER (PARTITION BY a)::DOUBLE / nullif(sum(CASE WHEN v IS NOT NULL THEN cap END) OVER (PARTITION BY a), 0) AS ra, sum(v) OVER (PARTITION BY l)::DOUBLE / nullif(sum(CASE WHEN v IS NOT NULL THEN cap END) OVER (PARTITION BY l), 0) AS rl FROM k)
SELECT id, a, l, v, cap, round(CASE WHEN v IS NOT NULL THEN v WHEN cap = 0 THEN 0 ELSE cap * coalesce(ra, rl) END, 6)::DOUBLE AS filled, CASE WHEN v IS NOT NULL THEN 'published' WHEN cap = 0 THEN 'zero' WHEN ra IS NOT NULL THEN 'a' WHEN rl IS NOT NULL THEN 'l' END AS source FROM r""")
def hierarchical_rate_imputation(spark, sf):
    hole = (F.col("c_custkey") % 4 == 0) | ((F.col("c_nationkey") % 3 == 0) & (F.col("c_mktsegment") <= "C"))
    k = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.concat("c_mktsegment", F.col("c_nationkey").cast("string")).alias("a"), F.col("c_nationkey").alias("l"), F.when(~hole, F.col("c_custkey") % 50).alias("v"), (F.col("c_custkey") % 40).alias("cap"))
    return C.hierarchical_rate(k, ["a", "l"], value="v", capacity="cap").withColumn("filled", F.round("filled", 6))


LR = "WITH r AS (SELECT c_custkey, c_nationkey, (c_custkey * 7919 % 1000) / 128.0::DOUBLE AS v, c_custkey % 8 AS cap FROM customer), f AS (SELECT *, CAST(floor(v) AS BIGINT) AS whole FROM r), n AS (SELECT *, CAST(floor(sum(v) OVER (PARTITION BY c_nationkey) + 0.5) - sum(whole) OVER (PARTITION BY c_nationkey) AS BIGINT) AS need, {may} AS may FROM f), k AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY may DESC, v - whole DESC, c_custkey) AS k FROM n) SELECT c_custkey, c_nationkey, v, cap, whole + CASE WHEN may AND k <= need THEN 1 ELSE 0 END AS units FROM k"


def shares(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", "c_nationkey", ((F.col("c_custkey") * 7919 % 1000) / 128.0).alias("v"), (F.col("c_custkey") % 8).alias("cap"))


@query(LR.format(may="TRUE"))
def largest_remainder(spark, sf):
    return C.largest_remainder(shares(spark, sf), group="c_nationkey", key="c_custkey", value="v")


@query(LR.format(may="whole < cap"))
def largest_remainder_capped(spark, sf):
    return C.largest_remainder(shares(spark, sf), group="c_nationkey", key="c_custkey", value="v", capacity="cap")


@query("""WITH b AS (SELECT p_brand AS g, p_size::DOUBLE AS prior, floor(p_size * 0.5) AS lo, CASE WHEN p_size >= 45 THEN NULL ELSE p_size * 2.0::DOUBLE END AS hi FROM part),
e AS (SELECT g, lo / prior AS pos, prior AS s, -lo AS b FROM b UNION ALL SELECT g, hi / prior, -prior, hi FROM b WHERE hi IS NOT NULL), z AS (SELECT g, pos, sum(s) AS s, sum(b) AS b FROM e GROUP BY g, pos),
r AS (SELECT g, pos, sum(s) OVER w AS s, sum(b) OVER w AS b, lead(pos) OVER (PARTITION BY g ORDER BY pos) AS until FROM z WINDOW w AS (PARTITION BY g ORDER BY pos ROWS UNBOUNDED PRECEDING)),
t AS (SELECT g, sum(lo) AS low, count(hi) = count(*) AS closed, sum(hi) AS high, floor(sum(prior) * CASE WHEN g LIKE '%5' THEN 0.3 ELSE 1.25 END) AS target FROM b GROUP BY g),
h AS (SELECT r.g, min(struct_pack(pos := pos, f := greatest(CASE WHEN s > 1e-12 THEN (target - low - b) / s ELSE pos END, pos))) AS x FROM r JOIN t USING (g) WHERE until IS NULL OR low + b + s * until >= target GROUP BY r.g)
SELECT t.g, target::DOUBLE AS target, CASE WHEN target >= low AND (NOT closed OR target <= high) THEN round(x.f, 6) END AS factor, CASE WHEN target >= low AND (NOT closed OR target <= high) THEN 'fitted' ELSE 'infeasible' END AS status FROM t LEFT JOIN h USING (g)""")
def bounded_fit_breakpoints(spark, sf):
    p = F.col("p_size").cast("double")
    b = table(spark, sf, "part").select(F.col("p_brand").alias("g"), p.alias("prior"), F.floor(p * 0.5).cast("double").alias("lo"), F.when(F.col("p_size") >= 45, float("inf")).otherwise(p * 2.0).alias("hi"))
    target = b.groupBy("g").agg(F.floor(F.sum("prior") * F.when(F.col("g").endswith("5"), 0.3).otherwise(1.25)).cast("double").alias("target"))
    return C.bounded_fit(b, target, group="g").withColumn("factor", F.round("factor", 6))


@query("WITH y AS (SELECT c_nationkey AS g, CAST(year(o_orderdate) AS INTEGER) AS y, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) SELECT a.g, round_even(least(greatest(b.n / a.n::DOUBLE, 0.9), 1.6), 4) AS factor, CASE WHEN b.n IS NULL THEN 'none' ELSE 'observed' END AS basis FROM (SELECT * FROM y WHERE y = 1995) a LEFT JOIN (SELECT * FROM y WHERE y = 2000) b ON a.g = b.g")
def growth_factor_clamped(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("g"), F.year("o_orderdate").alias("y"))
    n = o.where("y in (1995, 2000)").groupBy("g").agg(F.sum((F.col("y") == 1995).cast("long")).alias("a"), F.sum((F.col("y") == 2000).cast("long")).alias("b")).where("a > 0")
    factor = F.when(F.col("b") > 0, F.bround(S.clamp(F.col("b") / F.col("a"), 0.9, 1.6), 4))
    return n.select("g", factor.alias("factor"), F.when(F.col("b") > 0, "observed").otherwise("none").alias("basis"))


@query("WITH y AS (SELECT o_orderpriority AS g, CAST(year(o_orderdate) AS INTEGER) AS y, count(*) AS n FROM orders WHERE year(o_orderdate) <> 1998 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY abs(y - 1998), y) AS k FROM y) SELECT g, y, n FROM r WHERE k = 1")
def nearest_year_pick(spark, sf):
    y = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("g"), F.year("o_orderdate").alias("y")).where("y <> 1998").groupBy("g", "y").agg(F.count("*").alias("n"))
    return keep_first(y, ["g"], [F.abs(F.col("y") - 1998), F.col("y")])


@query("SELECT CASE WHEN l_returnflag = 'R' THEN 'excluded' WHEN l_linestatus = 'O' THEN 'outside' ELSE 'retained' END AS stage, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS mass, CAST(sum(floor(l_quantity * 0.37 + 0.5)) AS BIGINT) AS rounded FROM lineitem GROUP BY 1")
def grid_accounting(spark, sf):
    stage = F.when(F.col("l_returnflag") == "R", "excluded").when(F.col("l_linestatus") == "O", "outside").otherwise("retained")
    return table(spark, sf, "lineitem").groupBy(stage.alias("stage")).agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("mass"), F.sum(S.half_up(F.col("l_quantity") * 0.37)).cast("long").alias("rounded"))
