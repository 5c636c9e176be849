"""Identity, conflict and join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.operators import relational as R
from terrane.plans.base import shared, registry, table

QUERIES, ORACLES, query = registry()

L = "l AS (SELECT l_orderkey * 1000000 + l_partkey * 100 + l_linenumber AS seq, CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_orderkey * 10 + l_linenumber END AS a, CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_partkey * 100 + l_linenumber END AS b, l_suppkey FROM lineitem)"


def lines(spark, sf):
    k = lambda c: F.col(c)
    return table(spark, sf, "lineitem").select(
        (k("l_orderkey") * 1000000 + k("l_partkey") * 100 + k("l_linenumber")).alias("seq"),
        F.when(k("l_orderkey") % 7 != 0, k("l_orderkey") * 10 + k("l_linenumber")).alias("a"),
        F.when(k("l_partkey") % 5 != 0, k("l_partkey") * 100 + k("l_linenumber")).alias("b"),
        "l_suppkey",
    )


@query(f"WITH {L}, d AS (SELECT seq, min(a) AS a, min(b) AS b, min(l_suppkey) AS l_suppkey FROM l GROUP BY seq), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY seq) AS ka, row_number() OVER (PARTITION BY b ORDER BY seq) AS kb FROM d) SELECT seq, a, b, l_suppkey FROM r WHERE (a IS NULL OR ka = 1) AND (b IS NULL OR kb = 1)")
def ledger_dedup(spark, sf):
    d = lines(spark, sf).groupBy("seq").agg(*[F.min(c).alias(c) for c in ("a", "b", "l_suppkey")])
    return R.ledger(d, ["a", "b"], "seq")


@query("SELECT l_orderkey, l_linenumber, count(DISTINCT l_suppkey) AS values FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_suppkey) > 1")
def conflict_keys(spark, sf):
    return R.conflicts(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], "l_suppkey")


@query("WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) AS k FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM r WHERE k = 1")
def keep_first(spark, sf):
    k = R.keep_first(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], [F.col(c) for c in ("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")])
    return k.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("WITH a AS (SELECT l_partkey, l_returnflag FROM lineitem WHERE l_linenumber = 1), b AS (SELECT l_partkey, l_returnflag FROM lineitem WHERE l_linenumber = 2), u AS (SELECT *, 1 AS s FROM a UNION ALL SELECT *, -1 FROM b) SELECT l_partkey, l_returnflag, CAST(sum(s) AS BIGINT) AS surplus FROM u GROUP BY 1, 2 HAVING sum(s) <> 0")
def multiset_diff(spark, sf):
    line = table(spark, sf, "lineitem")
    a, b = (line.where(F.col("l_linenumber") == n).select("l_partkey", "l_returnflag") for n in (1, 2))
    return R.multiset_difference(a, b)


C3 = "WITH p AS (SELECT p_partkey, p_partkey % 200 AS blk, p_size FROM part), a AS (SELECT k AS blk, k / 10.0::DOUBLE AS lon, CASE WHEN k % 4 = 0 THEN NULL ELSE k / 20.0::DOUBLE END AS lat FROM (SELECT DISTINCT p_partkey % 200 AS k FROM part) WHERE k % 3 <> 0), b AS (SELECT DISTINCT p_size, p_size * 1.5::DOUBLE AS lon, p_size * 0.5::DOUBLE AS lat FROM part WHERE p_size % 2 = 0)"


@query(C3 + " SELECT p_partkey, p.p_size, p.blk, CASE WHEN a.lat IS NOT NULL THEN a.lon ELSE b.lon END AS lon, CASE WHEN a.lat IS NOT NULL THEN a.lat ELSE b.lat END AS lat, CASE WHEN a.lat IS NOT NULL THEN 'block' WHEN b.lon IS NOT NULL THEN 'area' END AS provenance FROM p LEFT JOIN a ON p.blk = a.blk LEFT JOIN b ON p.p_size = b.p_size")
def cascade_coalesce_join(spark, sf):
    part = table(spark, sf, "part")
    p = part.select("p_partkey", (F.col("p_partkey") % 200).alias("blk"), "p_size")
    a = p.select("blk").distinct().where("blk % 3 <> 0").select("blk", (F.col("blk") / 10.0).alias("lon"), F.when(F.col("blk") % 4 != 0, F.col("blk") / 20.0).alias("lat"))
    b = part.select("p_size").distinct().where("p_size % 2 = 0").select("p_size", (F.col("p_size") * 1.5).alias("lon"), (F.col("p_size") * 0.5).alias("lat"))
    return R.cascade(p, [("block", a, ["blk"]), ("area", b, ["p_size"])], ["lon", "lat"]).select("p_partkey", "p_size", "blk", "lon", "lat", "provenance")


S5 = "s AS (SELECT s_suppkey % 60 AS short, s_suppkey AS long, s_nationkey FROM supplier)"


@query(f"WITH {S5}, u AS (SELECT short, min(s_nationkey) AS s_nationkey FROM s GROUP BY 1 HAVING count(DISTINCT long) = 1) SELECT p_partkey, p_partkey % 90 AS short, u.s_nationkey FROM part LEFT JOIN u ON p_partkey % 90 = u.short")
def unique_guarded_join(spark, sf):
    s = table(spark, sf, "supplier").select((F.col("s_suppkey") % 60).alias("short"), F.col("s_suppkey").alias("long"), "s_nationkey")
    p = table(spark, sf, "part").select("p_partkey", (F.col("p_partkey") % 90).alias("short"))
    return R.guarded(p, s, "short", "long", ["s_nationkey"]).select("p_partkey", "short", "s_nationkey")


@query(f"WITH {S5}, u AS (SELECT short FROM s GROUP BY 1 HAVING count(DISTINCT long) > 1) SELECT p_partkey, p_partkey % 90 AS short FROM part WHERE p_partkey % 90 NOT IN (SELECT short FROM u)")
def anti_ambiguous(spark, sf):
    s = table(spark, sf, "supplier").select((F.col("s_suppkey") % 60).alias("short"), F.col("s_suppkey").alias("long"))
    p = table(spark, sf, "part").select("p_partkey", (F.col("p_partkey") % 90).alias("short"))
    return R.anti_ambiguous(p, s, "short", "long").select("p_partkey", "short")


@query("WITH a AS (SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) = 1996), b AS (SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) = 1997) SELECT o_custkey, 'gained' AS change FROM b WHERE o_custkey NOT IN (SELECT o_custkey FROM a) UNION ALL SELECT o_custkey, 'lost' FROM a WHERE o_custkey NOT IN (SELECT o_custkey FROM b)")
def gained_lost(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", F.year("o_orderdate").alias("y"))
    return R.gained_lost(o.where("y = 1996"), o.where("y = 1997"), ["o_custkey"])


@query("WITH n(node) AS (VALUES ('31'), ('311'), ('4'), ('46'), ('4611'), ('12'), ('1234')), p AS (SELECT p_partkey, CAST(100000 + p_partkey * 7919 % 900000 AS VARCHAR) AS code FROM part) SELECT p_partkey, code, (SELECT max_by(node, length(node)) FROM n WHERE starts_with(code, node)) AS node FROM p")
def longest_prefix_join(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", (100000 + F.col("p_partkey") * 7919 % 900000).cast("string").alias("code"))
    n = spark.createDataFrame([(x,) for x in ("31", "311", "4", "46", "4611", "12", "1234")], "node string")
    return R.longest_prefix(p, "code", n, "node", range(1, 5)).select("p_partkey", "code", "node")


CATALOGUES = "SELECT c_custkey AS l, c_custkey + 1 AS r, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS ln, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'none' END AS rn, c_custkey - c_custkey % 2 AS lk, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey - c_custkey % 4 END AS rk FROM customer"


@query(f"WITH c AS ({CATALOGUES}), h AS (SELECT a.l AS left_id, b.r AS right_id, 0 AS o, 'n' AS rule FROM c a JOIN c b ON a.ln = b.rn UNION ALL SELECT a.l, b.r, 1, 'k' FROM c a JOIN c b ON a.lk = b.rk), p AS (SELECT left_id, right_id, min_by(rule, o) AS rule FROM h GROUP BY 1, 2) SELECT * FROM p QUALIFY count(*) OVER (PARTITION BY left_id) = 1 AND count(*) OVER (PARTITION BY right_id) = 1")
def merge_catalogs_one_to_one(spark, sf):
    """Two catalogues of all customers with gaps in their names and shared, partly wider keys."""
    c = shared(spark, sf, CATALOGUES)
    left = c.select(F.col("l").alias("id"), F.col("ln").alias("n"), F.col("lk").alias("k"))
    right = c.select(F.col("r").alias("id"), F.col("rn").alias("n"), F.col("rk").alias("k"))
    return R.merge_one_to_one(left, right, ["n", "k"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 50 <> 0)")
def dangling_references(spark, sf):
    c = table(spark, sf, "customer").where("c_custkey % 50 <> 0")
    return R.dangling(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey", c, "c_custkey").select("o_orderkey", "o_custkey")


@query("WITH y AS (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS y FROM orders), z AS (SELECT DISTINCT CAST(year(l_shipdate) AS INTEGER) AS y FROM lineitem) SELECT y FROM y INTERSECT SELECT y FROM z")
def coverage_intersect(spark, sf):
    a = table(spark, sf, "orders").select(F.year("o_orderdate").alias("y"))
    return a.intersect(table(spark, sf, "lineitem").select(F.year("l_shipdate").alias("y")))


@query("SELECT s_suppkey, sha256(concat_ws('|', CAST(s_suppkey AS VARCHAR), s_name, CAST(s_nationkey AS VARCHAR))) AS digest FROM supplier")
def content_digests(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", F.sha2(F.concat_ws("|", F.col("s_suppkey").cast("string"), "s_name", F.col("s_nationkey").cast("string")), 256).alias("digest"))
