"""Dual prices from pairs and from blocks, and the choice of a decay."""

import math

import pytest
from pyspark.sql import functions as F

from terrane.operators import dual, friction
from terrane.sources import scratch


@pytest.fixture
def spots(spark):
    rows = [(k, math.cos(k) * 5, math.sin(k) * 5, k % 2, k % 3, 10.0 + k, 1 + k % 4) for k in range(12)]
    return spark.createDataFrame(rows, "id int, x double, y double, zone int, place int, budget double, pull int")


def both(spots):
    """The same problem as blocks and as pairs."""
    o = spots.select(F.col("id").alias("o"), "x", "y", "zone", "place", "budget")
    d = spots.select(F.col("id").alias("d"), "x", "y", "zone", "place", "pull")
    j = o.alias("l").join(d.alias("r"), F.expr("l.zone = r.zone AND l.o <> r.d"))
    distance = F.sqrt((F.col("l.x") - F.col("r.x")) ** 2 + (F.col("l.y") - F.col("r.y")) ** 2)
    pairs = j.select("l.o", "r.d", F.concat_ws(">", "l.place", "r.place").alias("g"), (F.ln("r.pull") - 0.2 * distance).alias("score"), "l.budget")
    return dual.Blocks(o, d, beta=0.2, cells=30), dual.Edges(pairs), pairs


def test_blocks_and_pairs_agree(spark, spots):
    blocks, edges, pairs = both(spots)
    prices = spark.createDataFrame([("d", str(k), 0.1 * k) for k in range(12)] + [("g", f"{a}>{b}", 0.05 * a - 0.02 * b) for a in range(3) for b in range(3)], "kind string, id string, x double")
    with scratch.released():
        one, loss = blocks.sums(prices, curvature=True)
        two, other = edges.sums(prices, curvature=True)
        rows = lambda df: {(r["kind"], r["id"]): (pytest.approx(r["total"]), pytest.approx(r["curvature"])) for r in df.collect()}
        assert loss == pytest.approx(other) and {k: (v[0].expected, v[1].expected) for k, v in rows(one).items()} == rows(two)
        flows = {(r["o"], r["d"]): r["flow"] for r in blocks.flows(prices).collect()}
        assert flows == {(r["o"], r["d"]): pytest.approx(r["flow"]) for r in edges.flows(prices).collect()} and len(flows) == pairs.count()


def test_optimum_meets_its_targets(spark, spots):
    _, edges, pairs = both(spots)
    mass = spots.groupBy("zone").agg(F.sum("budget").alias("mass"), F.sum("pull").alias("pulls"))
    targets = spots.join(mass, "zone").select(F.col("id").alias("d"), (F.col("pull") * F.col("mass") / F.col("pulls")).alias("target"))
    goals = pairs.groupBy("g").agg((F.sum("budget") / 6).alias("goal"), F.lit(0.3).alias("reliability"))
    fit = dual.fit(edges, targets, goals, tolerance=1e-8)
    into = edges.flows(fit.prices).groupBy("d").agg(F.sum("flow").alias("n")).join(targets.select(F.col("d").cast("string").alias("d"), "target"), "d")
    assert fit.gradient <= 1e-8 and 1 < fit.rounds < 100 and into.where(F.abs(F.col("n") - F.col("target")) > 1e-4).isEmpty()
    with pytest.raises(ValueError, match="no optimum after 1 rounds"):
        dual.fit(edges, targets, goals, tolerance=1e-12, rounds=1)


def test_blocks_name_an_origin_without_support(spark, spots):
    lonely = spots.withColumn("zone", F.when(F.col("id") == 3, 9).otherwise(F.col("zone")))
    with pytest.raises(Exception, match="origin 3 has no permitted destination"):
        both(lonely)[0].flows(None).collect()


def test_decay_needs_evidence(spark):
    p = [(b, 1, d, math.exp(-b * d)) for b in friction.RIVALS for d in range(1, 6)]
    total = {b: sum(x[3] for x in p if x[0] == b) for b in friction.RIVALS}
    probabilities = spark.createDataFrame([(b, o, d, w / total[b]) for b, o, d, w in p], "beta double, o int, d int, p double")

    def chosen(n, decay, probabilities=probabilities):
        w = [math.exp(-decay * d) for d in range(1, 6)]
        rows, k = [], 0
        for side in ("selection", "guard"):
            for d in range(1, 6):
                for _ in range(round(n * w[d - 1] / sum(w))):
                    k += 1
                    rows.append((side, k, 1, d, 1.0))
        return friction.select_beta(spark.createDataFrame(rows, "side string, id int, o int, d int, weight double"), probabilities, replicates=60).first()

    assert chosen(20, 0.24)["reason"] == "insufficient_evidence"
    assert chosen(4000, 0.24)["selected"] == 0.24 and chosen(4000, 0.24)["reason"] == "stable_guard_improvement"
    assert chosen(4000, 0.12)["selected"] == 0.12 and chosen(4000, 0.12)["reason"] == "no_stable_improvement"
    assert chosen(4000, 0.24, probabilities.where("d = 1"))["reason"] == "municipal_flows_uninformative"


def test_draws_have_mean_one(spark):
    u = friction.uniform(F.col("id"), F.lit(1))
    r = spark.range(4000).select(friction.poisson_draw(u).alias("n"), u.alias("u")).agg(F.avg("n"), F.var_samp("n"), F.min("u"), F.max("u")).first()
    assert abs(r[0] - 1) < 0.06 and abs(r[1] - 1) < 0.12 and 0 <= r[2] < 0.01 and 0.99 < r[3] < 1
