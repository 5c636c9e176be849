"""Travel on roads: chains contracted to junctions by pointer jumping, ways between points with safeguards."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions.scalars import driving_fallback
from terrane.operators.graph import components
from terrane.operators.relational import nearest
from terrane.sources.scratch import Rounds


@dataclass
class Network:
    """links: (a, b, w) between junctions, both ways; access: (node, junction, metres, chain, at, total), one row of a junction, two of a node within a chain."""

    links: DataFrame
    access: DataFrame
    parts: DataFrame  # node, part: what is connected


def undirected(segments: DataFrame) -> DataFrame:
    """(a, b, w): each pair of distinct nodes both ways, the shortest of several segments."""
    both = segments.select("a", "b", "w").unionByName(segments.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    return both.where("a <> b AND w IS NOT NULL").groupBy("a", "b").agg(F.min("w").alias("w"))


def contract(segments: DataFrame) -> Network:
    """The network of segments (a, b, w >= 0) without its nodes of degree two.

    Junctions are all other nodes, and the least node of a ring that has none. Every
    directed side (a to b) points at the one after it until it arrives at a junction;
    pointers double in each round, so a chain of n sides takes log2 n joins.
    """
    work = Rounds(segments.sparkSession, "roads")
    sides = work.keep("sides", undirected(segments))
    degree = sides.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("degree"))
    parts = work.keep("parts", components(degree.select(F.col("node").alias("id")), sides.select("a", "b")).select(F.col("id").alias("node"), F.col("component").alias("part")))
    kinds = degree.join(parts, "node").withColumn("junction", F.col("degree") != 2)
    bare = kinds.groupBy("part").agg(F.max("junction").alias("some"))
    kinds = kinds.join(bare, "part").withColumn("junction", F.col("junction") | (~F.col("some") & (F.col("node") == F.col("part"))))
    junctions = work.keep("junctions", kinds.where("junction").select("node"))
    ends = junctions.select(F.col("node").alias("b"), F.lit(True).alias("ends"))
    onward = sides.select(F.col("a").alias("b"), F.col("b").alias("c"))
    first = sides.join(ends, "b", "left").withColumn("ends", F.coalesce("ends", F.lit(False)))
    stopped = first.where("ends").select("a", "b", "w", F.col("a").alias("na"), F.col("b").alias("nb"), F.lit(True).alias("done"))
    moving = first.where("NOT ends").join(onward, "b").where("c <> a").select("a", "b", "w", F.col("b").alias("na"), F.col("c").alias("nb"), F.lit(False).alias("done"))
    walk = work.keep("walk", stopped.unionByName(moving))
    # w: metres from a up to where the pointed side begins, until done, then up to its end.
    while not walk.where("NOT done").isEmpty():
        at = walk.select(F.col("a").alias("na"), F.col("b").alias("nb"), F.col("w").alias("_w"), F.col("na").alias("_a"), F.col("nb").alias("_b"), F.col("done").alias("_done"))
        going = walk.where("NOT done").join(at, ["na", "nb"]).select("a", "b", (F.col("w") + F.col("_w")).alias("w"), F.col("_a").alias("na"), F.col("_b").alias("nb"), F.col("_done").alias("done"))
        walk = work.keep("walk", walk.where("done").unionByName(going))
    # Each side now knows the junction it leads to (nb), by which last side, and how far that is.
    arrived = walk.select("a", "b", "w", F.col("nb").alias("junction"), F.struct(F.col("na").alias("p"), F.col("nb").alias("q")).alias("last"))
    here = junctions.select(F.col("node").alias("a"))
    links = arrived.join(here, "a", "left_semi").where("a <> junction").groupBy("a", F.col("junction").alias("b")).agg(F.min("w").alias("w"))
    chain = Window.partitionBy("a")
    within = arrived.join(here, "a", "left_anti").withColumn("chain", F.min("last").over(chain)).withColumn("total", F.sum("w").over(chain))
    within = within.withColumn("at", F.min(F.struct("last", "w")).over(chain)["w"])
    inner = within.select(F.col("a").alias("node"), "junction", F.col("w").alias("metres"), "chain", "at", "total")
    own = junctions.select("node", F.col("node").alias("junction"), F.lit(0.0).alias("metres"), F.lit(None).cast(inner.schema["chain"].dataType).alias("chain"), F.lit(None).cast("double").alias("at"), F.lit(None).cast("double").alias("total"))
    return Network(work.keep("links", links), work.keep("access", own.unionByName(inner)), parts)


def ways(network: Network, pairs: DataFrame, reach: Column | float | None = None) -> DataFrame:
    """(o, d, metres) of pairs of nodes (o, d) that are connected: the shortest way, null beyond `reach`.

    Ways go along one chain, or from the junctions next to o over links to those next to
    d. The search starts from the junctions next to any o, and drops ways longer than the
    largest reach.
    """
    work = Rounds(pairs.sparkSession, "ways")
    pairs = work.keep("pairs", pairs.select("o", "d").distinct())
    out = network.access.select(*[F.col(c).alias(f"o_{c}") for c in network.access.columns])
    into = network.access.select(*[F.col(c).alias(f"d_{c}") for c in network.access.columns])
    best = work.keep("best", network.access.join(pairs.select(F.col("o").alias("node")).distinct(), "node", "left_semi").select(F.col("junction").alias("source")).distinct().withColumns({"node": F.col("source"), "cost": F.lit(0.0)}))
    front = best
    limit = F.lit(float("inf") if reach is None else reach)
    while not front.isEmpty():
        step = front.join(network.links, F.col("node") == F.col("a")).groupBy("source", F.col("b").alias("node")).agg(F.min(F.col("cost") + F.col("w")).alias("new")).where(F.col("new") <= limit)
        j = best.join(step, ["source", "node"], "full_outer").select("source", "node", F.least("cost", "new").alias("cost"), (F.col("new").isNotNull() & (F.col("cost").isNull() | (F.col("new") < F.col("cost")))).alias("better"))
        j = work.keep("best", j)
        best, front = j.select("source", "node", "cost"), j.where("better").select("source", "node", "cost")
    costs = best.select(F.col("source").alias("o_junction"), F.col("node").alias("d_junction"), "cost")
    ends = pairs.join(out, F.col("o") == F.col("o_node")).join(into, F.col("d") == F.col("d_node"))
    straight = F.abs(F.col("o_at") - F.col("d_at"))
    over = F.col("o_metres") + F.col("cost") + F.col("d_metres")
    along = F.when(F.col("o_chain") == F.col("d_chain"), straight)
    found = ends.join(costs, ["o_junction", "d_junction"], "left").groupBy("o", "d").agg(F.min(F.least(over, along)).alias("metres"))
    part = lambda k: network.parts.select(F.col("node").alias(k), F.col("part").alias(f"{k}_part"))
    joined = pairs.join(part("o"), "o").join(part("d"), "d").where("o_part = d_part").join(found, ["o", "d"], "left")
    return joined.select("o", "d", F.when(F.col("metres") <= limit, F.col("metres")).alias("metres"))


def road_impedance(network: Network, nodes: DataFrame, trips: DataFrame, *, detour: float = 3.5, start: float = 500.0) -> DataFrame:
    """(id, distance, seconds, source) of trips (id, ox, oy, dx, dy, beeline) over the roads, in metres of one plane.

    Both ends are taken to their nearest node (nodes: id, x, y). The way is never
    shorter than the beeline (of at least 150 m) and never longer than `detour` times it;
    where the roads do not connect the ends, the beeline rule stands in.
    """
    ends = trips.select("id", F.explode(F.array(F.struct(F.lit("o").alias("end"), F.col("ox").alias("x"), F.col("oy").alias("y")), F.struct(F.lit("d").alias("end"), F.col("dx").alias("x"), F.col("dy").alias("y")))).alias("e")).select(F.struct("id", "e.end").alias("id"), "e.x", "e.y")
    near = nearest(ends, nodes.select(F.col("id").alias("target"), F.col("x").alias("tx"), F.col("y").alias("ty")), start=start)
    near = Rounds(trips.sparkSession, "snapped").keep("near", near)
    snapped = near.groupBy("id.id").pivot("id.end", ["o", "d"]).agg(F.first(F.struct(F.col("target").alias("node"), "distance")))
    t = trips.join(snapped.select("id", F.col("o.node").alias("o"), F.col("d.node").alias("d"), (F.col("o.distance") + F.col("d.distance")).alias("walk")), "id")
    beeline = F.greatest("beeline", F.lit(150.0))
    longest = trips.agg(F.max(F.greatest("beeline", F.lit(150.0))) * detour).first()[0] or 0.0
    found = ways(network, t.select("o", "d"), longest).withColumn("connected", F.lit(True))
    j = t.join(found, ["o", "d"], "left")
    road = F.least(F.greatest(F.coalesce(F.col("metres") + F.col("walk"), F.lit(float("inf"))), beeline), detour * beeline)
    rule = driving_fallback(F.col("beeline"))
    seconds = F.greatest(F.lit(45).cast("long"), F.bround(road / (40 / 3.6)).cast("long"))
    on_road = F.coalesce("connected", F.lit(False))
    return j.select("id", F.when(on_road, F.bround(road).cast("long")).otherwise(rule["distance"]).alias("distance"), F.when(on_road, seconds).otherwise(rule["seconds"]).alias("seconds"), F.when(on_road, "road").otherwise("beeline").alias("source"))
