"""Weighted and grid aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.sources.scratch import Rounds


def weighted_quantiles(df: DataFrame, group: list[str], value: str, weight: str, qs: tuple[float, ...]) -> DataFrame:
    """Inverse ECDF without interpolation: the smallest value whose cumulative weight reaches q of the total.

    Weights of equal values are summed first, so the windows run over distinct values only.
    """
    sums = df.where(F.col(weight) > 0).groupBy(*group, value).agg(F.sum(weight).alias("_w"))
    ordered = Window.partitionBy(*group).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    run = sums.withColumn("_c", F.sum("_w").over(ordered)).withColumn("_t", F.sum("_w").over(Window.partitionBy(*group)))
    return run.groupBy(*group).agg(*[F.min(F.when(F.col("_c") >= q * F.col("_t"), F.col(value))).alias(f"p{round(q * 100)}") for q in qs])


def percentiles(df: DataFrame, group: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """(group, n, one column for each name in qs): interpolated percentiles, from sorted ranges of the distinct values.

    Equal values are counted first; the counts are sorted into ranges over all groups,
    and each range adds what the ranges before it hold, so no task sorts a whole group.
    """
    work = Rounds(df.sparkSession, "percentiles")
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("_c"))
    ranged = counts.repartitionByRange(*group, value).withColumn("_range", F.spark_partition_id())
    counts = work.keep("counts", ranged)
    sums = counts.groupBy(*group, "_range").agg(F.sum("_c").alias("_s"))  # ranges, and groups that begin in one
    before = Window.partitionBy(*group).orderBy("_range")
    sums = sums.select(*group, "_range", (F.sum("_s").over(before) - F.col("_s")).alias("_before"), F.sum("_s").over(Window.partitionBy(*group)).alias("n"))
    run = counts.join(sums, [*group, "_range"]).withColumn("_end", F.col("_before") + F.sum("_c").over(Window.partitionBy(*group, "_range").orderBy(value)))
    at = lambda q, up: (F.ceil if up else F.floor)(q * (F.col("n") - 1))
    first = lambda q, up: F.min(F.when(F.col("_end") > at(q, up), F.col(value)))
    ends = [f(q, up).alias(f"_{name}{int(up)}") for name, q in qs.items() for up in (False, True) for f in (first,)]
    found = run.groupBy(*group, "n").agg(*ends)
    part = lambda q: q * (F.col("n") - 1) - F.floor(q * (F.col("n") - 1))
    return found.select(*group, "n", *[(F.col(f"_{name}0") + part(q) * (F.col(f"_{name}1") - F.col(f"_{name}0"))).alias(name) for name, q in qs.items()])


def histogram(df: DataFrame, value: str, weight: str, width: float) -> DataFrame:
    return df.groupBy(F.floor(F.col(value) / width).cast("long").alias("bin")).agg(F.sum(weight).alias("weight"))


def histogram_quantile(bins: DataFrame, width: float, q: float) -> DataFrame:
    """Quantile by linear interpolation within the bin that reaches it; bins are few by construction."""
    w = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    run = bins.withColumn("_c", F.sum("weight").over(w)).crossJoin(F.broadcast(bins.agg(F.sum("weight").alias("_t"))))
    hit = run.where(F.col("_c") >= q * F.col("_t")).agg(F.min(F.struct("bin", "weight", "_c", "_t")).alias("h")).select("h.*")
    return hit.select(((F.col("bin") + (q * F.col("_t") - (F.col("_c") - F.col("weight"))) / F.col("weight")) * width).alias("quantile"))


def brackets(df: DataFrame, value: str, weight: str, edges: tuple[float, ...]) -> DataFrame:
    """Weight and share of each bracket between edges, empty brackets too."""
    spark = df.sparkSession
    bucket = F.lit(len(edges))
    for i in reversed(range(len(edges))):
        bucket = F.when(F.col(value) < edges[i], i).otherwise(bucket)
    sums = df.groupBy(bucket.cast("int").alias("bracket")).agg(F.sum(weight).alias("weight"))
    every = spark.range(len(edges) + 1).select(F.col("id").cast("int").alias("bracket"))
    total = sums.agg(F.sum("weight").alias("_t"))
    out = every.join(F.broadcast(sums), "bracket", "left").crossJoin(F.broadcast(total))
    return out.select("bracket", F.coalesce("weight", F.lit(0)).alias("weight"), (F.coalesce("weight", F.lit(0)) / F.col("_t")).alias("share"))


def kish(df: DataFrame, group: list[str], weight: str) -> DataFrame:
    w = F.col(weight)
    return df.groupBy(*group).agg((F.sum(w) * F.sum(w) / F.sum(w * w)).alias("ess"), F.count("*").alias("n"))


def moments(df: DataFrame, group: list[str], x: Column, y: Column, w: Column) -> DataFrame:
    """Weighted centre, covariance, radius of gyration, elongation and orientation."""
    d = df.select(*group, x.alias("x"), y.alias("y"), w.alias("w"))
    s = d.groupBy(*group).agg(F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("x")).alias("sx"), F.sum(F.col("w") * F.col("y")).alias("sy"))
    c = s.select(*group, "sw", (F.col("sx") / F.col("sw")).alias("mx"), (F.col("sy") / F.col("sw")).alias("my"))
    dx, dy = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    v = d.join(c, group).groupBy(*group, "mx", "my", "sw").agg(
        (F.sum(F.col("w") * dx * dx) / F.first("sw")).alias("vx"),
        (F.sum(F.col("w") * dy * dy) / F.first("sw")).alias("vy"),
        (F.sum(F.col("w") * dx * dy) / F.first("sw")).alias("cxy"),
    )
    gap = F.sqrt(F.pow((F.col("vx") - F.col("vy")) / 2, 2) + F.pow(F.col("cxy"), 2))
    mid = (F.col("vx") + F.col("vy")) / 2
    return v.select(
        *group,
        "mx",
        "my",
        F.sqrt(F.col("vx") + F.col("vy")).alias("gyration"),
        F.sqrt((mid + gap) / F.greatest(mid - gap, F.lit(1e-12))).alias("elongation"),
        (F.atan2(2 * F.col("cxy"), F.col("vx") - F.col("vy")) / 2).alias("orientation"),
    )


def grid(df: DataFrame, x: Column, y: Column, size: float, mass: Column, sums: dict[str, Column]) -> DataFrame:
    """Cells with the centroid weighted by max(0.1, mass), sums and number of rows."""
    w = F.greatest(F.lit(0.1), mass.cast("double"))
    keyed = df.select(F.floor(x / size).cast("long").alias("gx"), F.floor(y / size).cast("long").alias("gy"), x.alias("_x"), y.alias("_y"), w.alias("_w"), *[c.alias(n) for n, c in sums.items()])
    return keyed.groupBy("gx", "gy").agg(
        (F.sum(F.col("_w") * F.col("_x")) / F.sum("_w")).alias("x"), (F.sum(F.col("_w") * F.col("_y")) / F.sum("_w")).alias("y"), F.count("*").alias("points"), *[F.sum(n).alias(n) for n in sums]
    )


def correlation(cells: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson's r over cells where either is positive, clamped; null under 3 cells or without variance."""
    r = cells.where((F.col(a) > 0) | (F.col(b) > 0)).agg(F.count("*").alias("n"), F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias("r"))
    ok = (F.col("n") >= 3) & ~F.isnan("r")
    return r.select("n", F.when(ok, F.least(F.greatest("r", F.lit(-1.0)), F.lit(1.0))).alias("r"))


def concentration(df: DataFrame, value: str, share: float = 0.1) -> DataFrame:
    """Share of the total held by the ceil(share n) largest rows, ranked through the counts of equal values."""
    counts = df.groupBy(value).agg(F.count("*").alias("_n"))
    total = df.agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    w = Window.orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, 0)
    run = counts.withColumn("_c", F.sum("_n").over(w)).crossJoin(F.broadcast(total)).withColumn("_k", F.ceil(F.col("n") * share))
    taken = F.greatest(F.lit(0), F.least(F.col("_n"), F.col("_k") - (F.col("_c") - F.col("_n"))))
    return run.agg(F.max("_k").cast("long").alias("cells"), (F.sum(taken * F.col(value)) / F.max("total")).alias("share"))


def kl(observed: DataFrame, model: DataFrame, keys: list[str], row: list[str]) -> DataFrame:
    """Conditional divergence sum w ln(p / q) / sum w of observed rows from a model, both as shares of their row."""
    o = observed.withColumn("p", F.col("w") / F.sum("w").over(Window.partitionBy(*row)))
    m = model.withColumn("q", F.col("w") / F.sum("w").over(Window.partitionBy(*row))).select(*keys, "q")
    j = o.where("w > 0").join(m, keys, "left").withColumn("q", F.greatest(F.coalesce("q", F.lit(0.0)), F.lit(1e-12)))
    return j.agg((F.sum(F.col("w") * F.ln(F.col("p") / F.col("q"))) / F.sum("w")).alias("kl"))


def total_variation(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Half the sum of absolute differences of shares over all keys of either."""
    pa = a.crossJoin(F.broadcast(a.agg(F.sum("w").alias("_t")))).select(*keys, (F.col("w") / F.col("_t")).alias("p"))
    pb = b.crossJoin(F.broadcast(b.agg(F.sum("w").alias("_t")))).select(*keys, (F.col("w") / F.col("_t")).alias("q"))
    return pa.join(pb, keys, "full_outer").agg((F.sum(F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0)))) / 2).alias("tv"))


def rollup_counts(df: DataFrame, levels: list[str], measure: Column) -> DataFrame:
    """Counts and sums at every level of a hierarchy, from one pass."""
    return df.rollup(*levels).agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"), F.sum(measure).alias("total"))
