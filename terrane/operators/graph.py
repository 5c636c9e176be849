"""Iterative graph operators: components, greedy anchors, shortest ways."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.sources.scratch import Rounds


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, by minimum labels with pointer jumping."""
    both = Rounds(nodes.sparkSession, "edges").keep("edges", edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())  # read in every round
    work = Rounds(nodes.sparkSession, "components")
    labels = work.keep("labels", nodes.select("id", F.col("id").alias("component")))
    while True:
        heard = both.join(labels, both["a"] == labels["id"]).groupBy("b").agg(F.min("component").alias("m")).withColumnRenamed("b", "id")
        low = labels.join(heard, "id", "left").select("id", "component", F.least("component", F.coalesce("m", "component")).alias("n"))
        jump = low.select(F.col("id").alias("n"), F.col("n").alias("j"))
        after = work.keep("labels", low.join(jump, "n", "left").select("id", "component", F.least("n", F.coalesce("j", "n")).alias("n")))
        labels = after.select("id", F.col("n").alias("component"))
        if after.where("n <> component").isEmpty():
            return labels


def anchors(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, anchor): the greedy choice by score (descending, then id) of nodes no two of which form a pair.

    Rounds pick every undecided node that outranks all undecided neighbours and
    drop its neighbours, which gives exactly what one node after the other would.
    nodes: (id, score); pairs: (a, b).
    """
    both = Rounds(nodes.sparkSession, "edges").keep("edges", pairs.select("a", "b").union(pairs.select("b", "a")).distinct())  # read in every round
    work = Rounds(nodes.sparkSession, "anchors")
    rank = F.struct((-F.col("score")).alias("s"), F.col("id").alias("i"))
    state = work.keep("state", nodes.select("id", rank.alias("r"), F.lit(None).cast("boolean").alias("anchor")))
    while True:
        free = state.where("anchor is null")
        if not free.limit(1).count():
            return state.select("id", "anchor")
        near = both.join(free.select(F.col("id").alias("a"), F.col("r").alias("ra")), "a").groupBy("b").agg(F.min("ra").alias("best")).withColumnRenamed("b", "id")
        chosen = free.join(near, "id", "left").where(F.col("best").isNull() | (F.col("r") < F.col("best"))).select("id", F.lit(True).alias("yes"))
        beaten = both.join(chosen.select(F.col("id").alias("a")), "a").select(F.col("b").alias("id"), F.lit(True).alias("no")).distinct()
        state = work.keep("state", state.join(chosen, "id", "left").join(beaten, "id", "left").select("id", "r", F.when(F.col("anchor").isNotNull(), F.col("anchor")).when(F.col("yes"), True).when(F.col("no"), False).alias("anchor")))


def shortest(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, node, cost): the least cost of a way from each source to every node it reaches, by relaxing the nodes that the last round improved.

    edges: (a, b, w >= 0), directed; sources: (source). A round is a join of the
    improved nodes with their edges and a minimum; rounds end when nothing improves.
    """
    work = Rounds(edges.sparkSession, "shortest")
    best = work.keep("best", sources.select("source", F.col("source").alias("node"), F.lit(0.0).alias("cost")))
    front = best
    while True:
        step = front.join(edges, F.col("node") == F.col("a")).groupBy("source", F.col("b").alias("node")).agg(F.min(F.col("cost") + F.col("w")).alias("new"))
        j = work.keep("best", best.join(step, ["source", "node"], "full_outer").select("source", "node", F.least("cost", "new").alias("cost"), (F.col("new").isNotNull() & (F.col("cost").isNull() | (F.col("new") < F.col("cost")))).alias("better")))
        best, front = j.select("source", "node", "cost"), j.where("better").select("source", "node", "cost")
        if front.isEmpty():
            return best
