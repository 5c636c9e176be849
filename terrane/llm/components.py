"""Connected components of an edge list by alternating large and small stars."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root): root is the smallest node reachable from each node that has an edge.

    edges: (u, v), either way round. Each round is two aggregations with map-side
    combining and two joins, written to shared storage; no neighbourhood is ever
    collected, so a node may have any number of edges. Rounds go on until one
    changes nothing, however long the longest chain is.
    """
    both = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, state = scratch.keep(both, "stars-0"), None
    for n in itertools.count(1):
        around = now.union(now.select("v", "u"))
        low = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = around.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        after = scratch.keep(small, f"stars-{n}")
        scratch.free(f"stars-{n - 1}")
        seen = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        now = after
        if seen == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
        state = seen
