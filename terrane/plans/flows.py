"""Flow queries: pairs, margins, balance, lengths."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from terrane.functions import scalars as S
from terrane.operators import aggregates as A
from terrane.operators import allocation
from terrane.operators import calibrate as C
from terrane.operators import flows as O
from terrane.plans.base import EDGES, edges, place, place_sql, registry, table

QUERIES, ORACLES, query = registry()
OX, OY = place_sql("o")
DX, DY = place_sql("d")
DIST = f"sqrt(pow({DX} - {OX}, 2) + pow({DY} - {OY}, 2))"
PAIRS = f"WITH {EDGES}, t AS (SELECT o, d, CAST(sum(size) AS BIGINT) AS size FROM e GROUP BY o, d)"


def dist():
    ox, oy = place(F.col("o"))
    dx, dy = place(F.col("d"))
    return F.sqrt(F.pow(dx - ox, 2) + F.pow(dy - oy, 2))


def pairs(spark, sf):
    return edges(spark, sf).groupBy("o", "d").agg(F.sum("size").alias("size"))


@query(PAIRS + " SELECT o, d, size, o = d AS internal, round(size / sum(size) OVER (PARTITION BY o), 6) AS share, CAST(row_number() OVER (PARTITION BY o ORDER BY size DESC, d) AS INTEGER) AS rank FROM t")
def od_flows(spark, sf):
    return O.pair_totals(edges(spark, sf), "size").withColumn("share", F.round("share", 6))


@query(PAIRS + " SELECT o, round(sum(CASE WHEN o = d THEN size ELSE 0 END) / sum(size), 6) AS internal_share, CAST(sum(size) AS BIGINT) AS total FROM t GROUP BY o")
def od_internal_share(spark, sf):
    return edges(spark, sf).groupBy("o").agg(F.round(F.sum(F.when(F.col("o") == F.col("d"), F.col("size")).otherwise(0)) / F.sum("size"), 6).alias("internal_share"), F.sum("size").alias("total"))


@query(PAIRS + " SELECT o, d, round(size / sum(size) OVER (PARTITION BY o), 8) AS probability FROM t")
def od_row_probabilities(spark, sf):
    return pairs(spark, sf).select("o", "d", F.round(F.col("size") / F.sum("size").over(Window.partitionBy("o")), 8).alias("probability"))


@query(f"WITH {EDGES}, b AS (SELECT o AS id, size AS a, 0 AS z FROM e UNION ALL SELECT d, 0, size FROM e) SELECT id, CAST(sum(a) AS BIGINT) AS outgoing, CAST(sum(z) AS BIGINT) AS incoming FROM b GROUP BY id")
def margins_in_out(spark, sf):
    return O.margins(edges(spark, sf), "size")


@query(f"WITH {EDGES} SELECT o, d, CAST(sum(size) AS BIGINT) AS size, CAST(round_even(sum(year * size) / sum(size), 0) AS BIGINT) AS year FROM e GROUP BY o, d")
def merge_identical_pairs(spark, sf):
    return O.merge_pairs(edges(spark, sf), "size", ["year"])


@query(f"""WITH {EDGES}, n AS (SELECT n_nationkey AS id FROM nation WHERE n_nationkey < 20)
SELECT 'self loop' AS rule, CAST(sum(CASE WHEN o = d THEN 1 ELSE 0 END) AS BIGINT) AS violations FROM e
UNION ALL SELECT 'size not positive', CAST(sum(CASE WHEN size <= 0 THEN 1 ELSE 0 END) AS BIGINT) FROM e
UNION ALL SELECT 'unknown o', count(*) FROM e WHERE o NOT IN (SELECT id FROM n)
UNION ALL SELECT 'unknown d', count(*) FROM e WHERE d NOT IN (SELECT id FROM n)""")
def integrity_violations(spark, sf):
    points = table(spark, sf, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("id"))
    return O.violations(points, edges(spark, sf), "size")


@query(PAIRS + f""", b AS (SELECT CASE WHEN {DIST} < 5 THEN 0 WHEN {DIST} < 10 THEN 1 WHEN {DIST} < 15 THEN 2 WHEN {DIST} < 25 THEN 3 ELSE 4 END AS bracket, size FROM t)
SELECT CAST(r.range AS INTEGER) AS bracket, CAST(coalesce(sum(size), 0) AS BIGINT) AS weight, round(coalesce(sum(size), 0) / (SELECT sum(size) FROM t), 6) AS share FROM range(5) r LEFT JOIN b ON b.bracket = r.range GROUP BY r.range""")
def tld_brackets(spark, sf):
    return A.brackets(pairs(spark, sf).withColumn("km", dist()), "km", "size", (5, 10, 15, 25)).withColumn("share", F.round("share", 6))


@query(PAIRS + f""", s AS (SELECT o, {DIST} AS km, sum(size) AS w FROM t GROUP BY 1, 2), r AS (SELECT o, km, sum(w) OVER (PARTITION BY o ORDER BY km ROWS UNBOUNDED PRECEDING) AS c, sum(w) OVER (PARTITION BY o) AS n FROM s)
SELECT o, round(min(CASE WHEN c >= 0.25 * n THEN km END), 6) AS p25, round(min(CASE WHEN c >= 0.5 * n THEN km END), 6) AS p50, round(min(CASE WHEN c >= 0.75 * n THEN km END), 6) AS p75 FROM r GROUP BY o""")
def weighted_quantiles(spark, sf):
    q = A.weighted_quantiles(pairs(spark, sf).withColumn("km", dist()), ["o"], "km", "size", (0.25, 0.5, 0.75))
    return q.select("o", *[F.round(c, 6).alias(c) for c in ("p25", "p50", "p75")])


@query(PAIRS + f""", h AS (SELECT CAST(floor({DIST} / 2.5) AS BIGINT) AS bin, sum(size) AS weight FROM t GROUP BY 1), r AS (SELECT bin, weight, sum(weight) OVER (ORDER BY bin ROWS UNBOUNDED PRECEDING) AS c, (SELECT sum(weight) FROM h) AS n FROM h)
SELECT round((bin + (0.8 * n - (c - weight)) / weight) * 2.5, 6) AS quantile FROM r WHERE c >= 0.8 * n ORDER BY bin LIMIT 1""")
def opportunity_histogram_quantile(spark, sf):
    bins = A.histogram(pairs(spark, sf).withColumn("km", dist()), "km", "size", 2.5)
    return A.histogram_quantile(bins, 2.5, 0.8).select(F.round("quantile", 6).alias("quantile"))


@query(PAIRS + f""", s AS (SELECT o, d, size, sum(size) OVER (PARTITION BY o) AS budget, -0.05 * {DIST} AS score FROM t), x AS (SELECT o, d, budget, exp(score - max(score) OVER (PARTITION BY o)) AS v FROM s)
SELECT o, d, round(v / sum(v) OVER (PARTITION BY o) * budget, 4) AS flow FROM x""")
def row_softmax(spark, sf):
    t = pairs(spark, sf).withColumn("budget", F.sum("size").over(Window.partitionBy("o"))).withColumn("score", -0.05 * dist())
    return O.row_softmax(t, "score", "budget").select("o", "d", F.round("flow", 4).alias("flow"))


def _ipf_sql(rounds: int) -> str:
    steps, last = "", "w0"
    for r in range(rounds):
        steps += f", c{r} AS (SELECT o, d, w * din / sum(w) OVER (PARTITION BY d) AS w, oout, din FROM {last}), w{r + 1} AS (SELECT o, d, w * oout / sum(w) OVER (PARTITION BY o) AS w, oout, din FROM c{r})"
        last = f"w{r + 1}"
    first = f""", w0 AS (SELECT t.o, t.d, exp(-0.05 * {DIST.replace('(o *', '(t.o *').replace('(d *', '(t.d *')}) AS w, oo.n::DOUBLE AS oout, dd.n::DOUBLE AS din FROM t
 JOIN (SELECT o, sum(size) AS n FROM t GROUP BY o) oo ON t.o = oo.o JOIN (SELECT d, sum(size) AS n FROM t GROUP BY d) dd ON t.d = dd.d)"""
    return PAIRS + first + steps + f" SELECT o, d, round(w, 3) AS flow FROM {last}"


@query(_ipf_sql(5))
def ipf_k5(spark, sf):
    t = pairs(spark, sf)
    out = t.groupBy("o").agg(F.sum("size").cast("double").alias("out"))
    into = t.groupBy("d").agg(F.sum("size").cast("double").alias("in"))
    return O.ipf(t.select("o", "d", F.exp(-0.05 * dist()).alias("w")), out, into, 5).select("o", "d", F.round("flow", 3).alias("flow"))


NODES = f"SELECT n_nationkey AS id, n_regionkey AS zone, {place_sql('n_nationkey')[0]} AS x, {place_sql('n_nationkey')[1]} AS y FROM nation"


def nodes(spark, sf):
    x, y = place(F.col("n_nationkey"))
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("zone"), x.alias("x"), y.alias("y"))


@query(f"WITH n AS ({NODES}) SELECT a.id AS o, b.id AS d, round(sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2)), 6) AS distance FROM n a JOIN n b ON a.zone = b.zone WHERE sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2)) <= 60 AND sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2)) > 0")
def od_support_theta(spark, sf):
    n = nodes(spark, sf)
    return O.support(n, n, 60.0, 60.0).withColumn("distance", F.round("distance", 6))


@query(f"WITH n AS ({NODES}), p AS (SELECT a.id AS o, b.id AS d, sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2)) AS distance FROM n a JOIN n b ON a.zone = b.zone AND a.id <> b.id), r AS (SELECT o, d, round(distance, 6) AS distance, CAST(row_number() OVER (PARTITION BY o ORDER BY distance, d) AS INTEGER) AS rank FROM p) SELECT * FROM r WHERE rank <= 5")
def knn5_fallback(spark, sf):
    n = nodes(spark, sf)
    return O.nearest_k_any(n, n, 5, 20.0).withColumn("distance", F.round("distance", 6))


@query("SELECT n_nationkey AS id, n_regionkey AS component, round(sum(n_nationkey + 1) OVER (PARTITION BY n_regionkey) * (n_nationkey % 7) / nullif(sum(n_nationkey % 7) OVER (PARTITION BY n_regionkey), 0), 6) AS target FROM nation")
def component_targets(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("component"), (F.col("n_nationkey") + 1).alias("mass"), (F.col("n_nationkey") % 7).alias("attraction"))
    return O.component_targets(n, mass="mass", attraction="attraction").select("id", "component", F.round("target", 6).alias("target"))


SPLITS = f"WITH {EDGES}, t AS (SELECT o, d, CAST(sum(size) AS BIGINT) AS size, CAST(ceil(sum(size) / 500.0) AS BIGINT) AS n FROM e GROUP BY o, d)"


@query(SPLITS + " SELECT o, d, size, i AS cohort, size // n + CASE WHEN i < size % n THEN 1 ELSE 0 END AS cohort_size FROM (SELECT o, d, size, n, unnest(range(n)) AS i FROM t)")
def cohort_split_explode(spark, sf):
    return C.split_cohorts(pairs(spark, sf), "size", 500)


@query(PAIRS + """, p AS (SELECT o, d, size, sum(size) OVER (PARTITION BY o ORDER BY d ROWS UNBOUNDED PRECEDING) AS c, sum(size) OVER (PARTITION BY o) AS n, CAST(('0x' || substr(sha256(CAST(o AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS ph FROM t),
h AS (SELECT o, d, size, CAST(floor(c * 20 / n::DOUBLE + 1 - ph) AS BIGINT) - CAST(floor((c - size) * 20 / n::DOUBLE + 1 - ph) AS BIGINT) AS hits FROM p) SELECT o, d, size, hits FROM h WHERE hits > 0""")
def systematic_sample(spark, sf):
    return C.systematic_sample(pairs(spark, sf), group="o", key="d", weight="size", draws=20)


M = f"(({DIST}) * 1000)"


@query(PAIRS + f""" SELECT o, d, CAST(round_even(greatest({M} * 1.3, 150), 0) AS BIGINT) AS after_m, greatest(CAST(round_even(greatest({M} * 1.3, 150) / (40 / 3.6), 0) AS BIGINT), 45) AS after_s,
CAST(round_even(greatest({M}, 150) * 1.3, 0) AS BIGINT) AS before_m, greatest(CAST(round_even(greatest({M}, 150) * 1.3 / (40 / 3.6), 0) AS BIGINT), 45) AS before_s FROM t""")
def impedance_canonical(spark, sf):
    t = pairs(spark, sf).withColumn("m", dist() * 1000)
    t = t.withColumns({"a": S.impedance_after(F.col("m")), "b": S.impedance_before(F.col("m"))})
    return t.select("o", "d", F.col("a.distance").alias("after_m"), F.col("a.seconds").alias("after_s"), F.col("b.distance").alias("before_m"), F.col("b.seconds").alias("before_s"))


@query(PAIRS + f" SELECT o, d, round(CASE WHEN {DIST} <= 3 THEN greatest(exp(-0.12 * (1 - least(o % 10 / 10.0::DOUBLE, 0.6)) * {DIST}), 0.6) ELSE exp(-0.12 * (1 - least(o % 10 / 10.0::DOUBLE, 0.6)) * {DIST}) END, 8) AS friction, round(0.7 * {DIST} * 90 + 0.3 * (2 * {DIST} * 90 + 300), 6) AS mixed_seconds FROM t", name="friction_reach")
def friction_reach(spark, sf):
    km = dist()
    auto = km * 90
    return pairs(spark, sf).select("o", "d", F.round(S.friction(km, 0.12, F.col("o") % 10 / 10.0), 8).alias("friction"), F.round(0.7 * auto + 0.3 * (2 * auto + 300), 6).alias("mixed_seconds"))


SPLIT = "CAST(('0x' || substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 8)) AS BIGINT) % 10"


@query(f"SELECT o_orderstatus, CAST(sum(CASE WHEN {SPLIT} < 6 THEN 1 ELSE 0 END) AS BIGINT) AS training, CAST(sum(CASE WHEN {SPLIT} BETWEEN 6 AND 7 THEN 1 ELSE 0 END) AS BIGINT) AS selection, CAST(sum(CASE WHEN {SPLIT} > 7 THEN 1 ELSE 0 END) AS BIGINT) AS guard FROM orders GROUP BY 1")
def hash_split_60_20_20(spark, sf):
    b = S.hash_bucket(F.col("o_orderkey").cast("string"))
    o = table(spark, sf, "orders").select("o_orderstatus", b.alias("b"))
    part = lambda c: F.sum(F.when(c, 1).otherwise(0)).alias
    return o.groupBy("o_orderstatus").agg(part(F.col("b") < 6)("training"), part(F.col("b").between(6, 7))("selection"), part(F.col("b") > 7)("guard"))


BY_YEAR = "WITH " + EDGES + ", a AS (SELECT o, d, sum(size) AS w FROM e WHERE year < 1998 GROUP BY 1, 2), b AS (SELECT o, d, sum(size) AS w FROM e WHERE year >= 1998 GROUP BY 1, 2)"


def by_year(spark, sf):
    e = edges(spark, sf)
    return e.where("year < 1998").groupBy("o", "d").agg(F.sum("size").alias("w")), e.where("year >= 1998").groupBy("o", "d").agg(F.sum("size").alias("w"))


@query(BY_YEAR + ", p AS (SELECT o, d, w, w / sum(w) OVER (PARTITION BY o) AS p FROM b), q AS (SELECT o, d, w / sum(w) OVER (PARTITION BY o) AS q FROM a) SELECT round(sum(p.w * ln(p.p / greatest(coalesce(q.q, 0), 1e-12))) / sum(p.w), 6) AS kl FROM p LEFT JOIN q USING (o, d)")
def conditional_kl(spark, sf):
    a, b = by_year(spark, sf)
    return A.kl(b, a, ["o", "d"], ["o"]).select(F.round("kl", 6).alias("kl"))


@query(BY_YEAR + ", q AS (SELECT o, d, w / sum(w) OVER (PARTITION BY o) AS q FROM a) SELECT round(-sum(b.w * ln(greatest(coalesce(q.q, 0), 1e-12))) / sum(b.w), 6) AS log_loss FROM b LEFT JOIN q USING (o, d)")
def log_loss(spark, sf):
    a, b = by_year(spark, sf)
    q = a.select("o", "d", (F.col("w") / F.sum("w").over(Window.partitionBy("o"))).alias("q"))
    j = b.join(q, ["o", "d"], "left")
    return j.agg(F.round(-F.sum(F.col("w") * F.ln(F.greatest(F.coalesce("q", F.lit(0.0)), F.lit(1e-12)))) / F.sum("w"), 6).alias("log_loss"))


@query(BY_YEAR + " SELECT round(0.5 * sum(abs(coalesce(a.w, 0) / (SELECT sum(w) FROM a) - coalesce(b.w, 0) / (SELECT sum(w) FROM b))), 6) AS tv FROM a FULL JOIN b ON a.o = b.o AND a.d = b.d")
def total_variation(spark, sf):
    a, b = by_year(spark, sf)
    return A.total_variation(a, b, ["o", "d"]).select(F.round("tv", 6).alias("tv"))


@query(PAIRS + """, z AS (SELECT n_nationkey AS id, n_regionkey AS zone FROM nation) SELECT zone, count(*) AS points, CAST(sum(coalesce(f.n, 0)) AS BIGINT) AS outflow, CAST(sum(coalesce(g.n, 0)) AS BIGINT) AS inflow, CAST(sum(coalesce(f.n, 0)) - sum(coalesce(g.n, 0)) AS BIGINT) AS delta
FROM z LEFT JOIN (SELECT o, sum(size) AS n FROM t GROUP BY o) f ON f.o = id LEFT JOIN (SELECT d, sum(size) AS n FROM t GROUP BY d) g ON g.d = id GROUP BY zone""")
def territorial_budget(spark, sf):
    z = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("zone"))
    m = z.join(O.margins(edges(spark, sf), "size"), "id", "left").na.fill(0, ["outgoing", "incoming"])
    return m.groupBy("zone").agg(F.count("*").alias("points"), F.sum("outgoing").alias("outflow"), F.sum("incoming").alias("inflow"), (F.sum("outgoing") - F.sum("incoming")).alias("delta"))


@query()
def integer_transport(spark, sf):
    """Supplies and demands of each region met by whole flows near the observed ones."""
    n = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    t = pairs(spark, sf).join(n.toDF("o", "zone"), "o").join(n.toDF("d", "_zone"), "d").where("zone = _zone")
    need = t.groupBy("zone", "o").agg(F.sum("size").alias("out"))
    have = t.groupBy("zone", "d").agg(F.sum("size").alias("target"))
    cells = t.select("zone", "o", "d", (F.col("size") - F.col("size") % 10).alias("proposal"), dist().alias("distance"))
    return allocation.integer_transport(cells, need, have).select("zone", "o", "d", "flow")
