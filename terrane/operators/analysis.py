"""Selections, comparisons, top-n with audit and heat surfaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def selected_trips(edges: DataFrame, chosen: DataFrame, size: str) -> DataFrame:
    """Cells outside a selection by what leaves it to them and enters it from them, ranked by the sum."""
    inside = chosen.select("id").distinct()  # of any size: it is broadcast at run time while it is small
    ends = edges.join(inside.select(F.col("id").alias("o"), F.lit(True).alias("_o")), "o", "left").join(inside.select(F.col("id").alias("d"), F.lit(True).alias("_d")), "d", "left")
    out = ends.where("_o and _d is null").select(F.col("d").alias("cell"), F.col(size).alias("leaving"), F.lit(0).cast("long").alias("entering"))
    into = ends.where("_d and _o is null").select(F.col("o").alias("cell"), F.lit(0).cast("long").alias("leaving"), F.col(size).alias("entering"))
    sums = out.unionByName(into).groupBy("cell").agg(F.sum("leaving").alias("leaving"), F.sum("entering").alias("entering"))
    return sums.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.col("leaving") + F.col("entering")), "cell")))


def area_pair(edges: DataFrame, a: DataFrame, b: DataFrame, size: str) -> DataFrame:
    """Demand between two areas, both ways, with the totals it is a share of."""

    def mark(df: DataFrame, end: str, ids: DataFrame, name: str) -> DataFrame:
        return df.join(ids.select(F.col("id").alias(end), F.lit(True).alias(name)).distinct(), end, "left")

    e = edges
    for end in ("o", "d"):
        e = mark(mark(e, end, a, f"_{end}a"), end, b, f"_{end}b")
    total = lambda c: F.sum(F.when(F.expr(c), F.col(size)).otherwise(0))
    return e.agg(total("_oa and _db").alias("a_to_b"), total("_ob and _da").alias("b_to_a"), total("_oa").alias("out_a"), total("_db").alias("in_b"), (total("_oa and _db") / total("_oa")).alias("share_of_a"))


def select_area(points: DataFrame, inside: Column, area: float) -> DataFrame:
    """Totals, balance, density and share of the points inside."""
    p = points.withColumn("_in", inside)
    t = lambda c: F.sum(F.when(F.col("_in"), F.col(c)).otherwise(0))
    s = p.agg(F.sum(F.col("_in").cast("long")).alias("points"), t("residents").alias("residents"), t("jobs").alias("jobs"), F.sum("residents").alias("_all"))
    both = F.col("jobs") + F.col("residents")
    return s.select("points", "residents", "jobs", F.round((F.col("jobs") - F.col("residents")) / both, 6).alias("balance"), F.round(F.col("residents") / area, 6).alias("density"), F.round(F.col("residents") / F.col("_all"), 6).alias("share"))


def compare(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Full outer comparison with zeros for what is missing: keys, before, after, delta."""
    j = a.select(*keys, F.col(value).alias("before")).join(b.select(*keys, F.col(value).alias("after")), keys, "full_outer").na.fill(0, ["before", "after"])
    return j.withColumn("delta", F.col("after") - F.col("before"))


def top_with_ties(df: DataFrame, value: str, key: str, n: int) -> DataFrame:
    """The n largest (ties to the smaller key) with how many rows tie at the cut-off and how many of them stayed."""
    top = df.orderBy(F.desc(value), key).limit(n)
    cut = top.agg(F.min(value).alias("_v"))
    tied = df.join(F.broadcast(cut), F.col(value) == F.col("_v")).agg(F.count("*").alias("tied_at_cutoff"))
    kept = top.join(F.broadcast(cut), F.col(value) == F.col("_v")).agg(F.count("*").alias("tied_kept"))
    return top.crossJoin(F.broadcast(tied)).crossJoin(F.broadcast(kept))


def heat(points: DataFrame, kernel: tuple[float, ...]) -> DataFrame:
    """Mass (fx, fy in cells, w) split bilinearly over four cells, then blurred along x and along y; the mass stays."""
    fx, fy = F.col("fx") - F.floor("fx"), F.col("fy") - F.floor("fy")
    corners = F.array(*[F.struct((F.floor("fx") + i).cast("long").alias("gx"), (F.floor("fy") + j).cast("long").alias("gy"), (F.col("w") * (fx if i else 1 - fx) * (fy if j else 1 - fy)).alias("m")) for i in (0, 1) for j in (0, 1)])
    cells = points.select(F.explode(corners).alias("c")).select("c.*").groupBy("gx", "gy").agg(F.sum("m").alias("m"))
    half = len(kernel) // 2
    for axis, other in (("gx", "gy"), ("gy", "gx")):
        taps = F.array(*[F.struct(F.lit(i - half).alias("i"), F.lit(v).alias("v")) for i, v in enumerate(kernel)])
        spread = cells.select(other, axis, "m", F.explode(taps).alias("t"))
        cells = spread.groupBy((F.col(axis) + F.col("t.i")).alias(axis), other).agg(F.sum(F.col("m") * F.col("t.v")).alias("m"))
    return cells.select("gx", "gy", F.col("m").alias("heat"))
