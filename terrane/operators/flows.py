"""Origin-destination operators on edge lists (o, d, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.sources.scratch import Rounds, settled


def pair_totals(edges: DataFrame, size: str) -> DataFrame:
    """Directed totals with the share of the origin's total and rank by size, ties by pair."""
    t = edges.groupBy("o", "d").agg(F.sum(size).alias("size"))
    row, every = Window.partitionBy("o"), Window.partitionBy("o").orderBy(F.desc("size"), "d")
    return t.select("o", "d", "size", (F.col("o") == F.col("d")).alias("internal"), (F.col("size") / F.sum("size").over(row)).alias("share"), F.row_number().over(every).alias("rank"))


def merge_pairs(edges: DataFrame, size: str, attributes: list[str]) -> DataFrame:
    """One row per pair: summed size, attributes as half-even rounded means weighted by size."""
    means = [F.bround(F.sum(F.col(a) * F.col(size)) / F.sum(size)).cast("long").alias(a) for a in attributes]
    return edges.groupBy("o", "d").agg(F.sum(size).alias("size"), *means)


def margins(edges: DataFrame, size: str) -> DataFrame:
    """(id, outgoing, incoming) of every node that an edge touches."""
    both = edges.select(F.col("o").alias("id"), F.col(size).alias("outgoing"), F.lit(0).cast("long").alias("incoming")).unionByName(edges.select(F.col("d").alias("id"), F.lit(0).cast("long").alias("outgoing"), F.col(size).alias("incoming")))
    return both.groupBy("id").agg(F.sum("outgoing").alias("outgoing"), F.sum("incoming").alias("incoming"))


def support(origins: DataFrame, destinations: DataFrame, reach: float, size: float) -> DataFrame:
    """Permitted pairs (o, d, distance): within reach, in one zone, not the same place; an equi join on zone and cells of `size` >= reach."""
    cells = F.array(*[F.struct((F.floor(F.col("dx") / size) + i).alias("cx"), (F.floor(F.col("dy") / size) + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    spread = destinations.select(F.col("id").alias("d"), F.col("x").alias("dx"), F.col("y").alias("dy"), "zone").withColumn("_c", F.explode(cells)).select("d", "dx", "dy", "zone", "_c.cx", "_c.cy")
    placed = origins.select(F.col("id").alias("o"), "x", "y", "zone", F.floor(F.col("x") / size).alias("cx"), F.floor(F.col("y") / size).alias("cy"))
    d = F.sqrt(F.pow(F.col("dx") - F.col("x"), 2) + F.pow(F.col("dy") - F.col("y"), 2))
    return placed.join(spread, ["zone", "cx", "cy"]).withColumn("distance", d).where((F.col("distance") <= reach) & (F.col("distance") > 0)).select("o", "d", "distance")


def nearest_k(pairs: DataFrame, k: int) -> DataFrame:
    """The k nearest destinations of each origin, ties by destination."""
    w = Window.partitionBy("o").orderBy("distance", "d")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest_k_any(origins: DataFrame, destinations: DataFrame, k: int, start: float) -> DataFrame:
    """The k nearest permitted destinations of each origin however far: (o, d, distance, rank), by cells whose size grows for origins that lack some.

    With k hits within one cell size these are the nearest; the others go on to
    larger cells until these span everything.
    """
    span = origins.select("x", "y").unionByName(destinations.select("x", "y")).agg(F.max("x") - F.min("x"), F.max("y") - F.min("y")).first()
    if span[0] is None:
        return nearest_k(support(origins, destinations, start, start), k)
    radius, widest, open_, out = start, 1.5 * (span[0] + span[1]) + start, origins, None
    while True:
        found = settled(nearest_k(support(open_, destinations, radius, radius), k))
        last = radius >= widest
        full = found.groupBy("o").agg(F.count("*").alias("n")).where(F.col("n") >= (1 if last else k)).select("o")
        done = found.join(full, "o", "left_semi")
        out = done if out is None else out.unionByName(done)
        if last:
            return out
        open_ = open_.join(full.select(F.col("o").alias("id")), "id", "left_anti")
        radius *= 3


def row_softmax(edges: DataFrame, score: str, budget: str) -> DataFrame:
    """Each origin's budget spread by exp(score), shifted by the row's maximum."""
    w = Window.partitionBy("o")
    e = edges.withColumn("_e", F.exp(F.col(score) - F.max(score).over(w)))
    return e.withColumn("flow", F.col("_e") / F.sum("_e").over(w) * F.col(budget)).drop("_e")


def ipf(edges: DataFrame, origins: DataFrame, destinations: DataFrame, rounds: int, tolerance: float | None = None) -> DataFrame:
    """Doubly constrained balance of (o, d, w) to origin totals (o, out) and destination totals (d, in).

    Each round scales columns, then rows; rows are exact at the end. The edge list is
    written once and never changes: a round is a factor for each destination, then one
    for each origin, as aggregations with map-side combining over a join of the edges
    with the other side's factors, which are written in each round. With a tolerance
    the loop ends when no column is off by a larger share (columns nobody can reach
    are left out); the sums that tell are those that the next round needs anyway.
    """
    work = Rounds(edges.sparkSession, "ipf")
    e = work.keep("edges", edges.join(origins, "o").join(destinations, "d").where("w > 0").select("o", "d", "w", "in", "out"))
    rows = columns = None
    for r in range(rounds):
        scaled = e.withColumn("_a", F.lit(1.0)) if rows is None else e.join(rows, "o")
        sums = scaled.groupBy("d").agg(F.first("in").alias("in"), F.sum(F.col("w") * F.col("_a")).alias("_s"))
        if tolerance is not None and columns is not None:
            sums = work.keep("sums", sums)
            off = sums.join(columns, "d").agg(F.max(F.abs(F.col("_s") * F.col("_b") / F.nullif(F.col("in"), F.lit(0.0)) - 1))).first()[0]
            if off is None or off <= tolerance:
                break
        columns = work.keep("columns", sums.select("d", F.when(F.col("_s") > 0, F.col("in") / F.col("_s")).otherwise(0.0).alias("_b")))
        sums = e.join(columns, "d").groupBy("o").agg(F.first("out").alias("out"), F.sum(F.col("w") * F.col("_b")).alias("_s"))
        rows = work.keep("rows", sums.select("o", F.when(F.col("_s") > 0, F.col("out") / F.col("_s")).otherwise(0.0).alias("_a")))
    if rows is None:
        return e.select("o", "d", F.col("w").alias("flow"))
    return e.join(rows, "o").join(columns, "d").select("o", "d", (F.col("w") * F.col("_a") * F.col("_b")).alias("flow"))


def component_targets(nodes: DataFrame, *, mass: str, attraction: str) -> DataFrame:
    """Destination targets: the component's mass shared by attraction. nodes: (id, component, ...)."""
    w = Window.partitionBy("component")
    return nodes.withColumn("target", F.sum(mass).over(w) * F.col(attraction) / F.nullif(F.sum(attraction).over(w), F.lit(0)))


def beta_for_median(bins: list[tuple[float, float]], median: float, low: float = 0.0, high: float = 2.0, steps: int = 60) -> float:
    """The decay for which sum h(d) exp(-beta d) has its median at the given distance; bins are (distance, opportunities)."""
    import math

    for _ in range(steps):
        beta = (low + high) / 2
        w = [h * math.exp(-beta * d) for d, h in bins]
        near = sum(x for x, (d, _) in zip(w, bins, strict=True) if d <= median)
        low, high = (beta, high) if near < sum(w) / 2 else (low, beta)
    return (low + high) / 2


def violations(points: DataFrame, edges: DataFrame, size: str) -> DataFrame:
    """Constraint counts that must all be zero: self loops, sizes that are not positive, ends that do not exist."""
    ids = points.select("id").distinct()
    # One pass: edges are summed by pair first, ends are looked up on the distinct pairs.
    pairs = edges.groupBy("o", "d").agg(F.count("*").alias("n"), F.sum((F.col(size) <= 0).cast("long")).alias("bad"))
    for end in ("o", "d"):
        pairs = pairs.join(ids.select(F.col("id").alias(end), F.lit(1).alias(f"_{end}")), end, "left")
    s = pairs.agg(
        F.sum(F.when(F.col("o") == F.col("d"), F.col("n")).otherwise(0)).alias("self loop"),
        F.sum("bad").alias("size not positive"),
        *[F.sum(F.when(F.col(f"_{end}").isNull(), F.col("n")).otherwise(0)).alias(f"unknown {end}") for end in ("o", "d")],
    )
    rules = F.array(*[F.struct(F.lit(c).alias("rule"), F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias("violations")) for c in s.columns])
    return s.select(F.explode(rules).alias("r")).select("r.*")
