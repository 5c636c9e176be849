"""Calibration of counts to published controls, and integer rounding that keeps totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asymmetric(df: DataFrame, controls: DataFrame, *, group: str, informal: float, least: int) -> DataFrame:
    """A factor for small units per group, large ones stay: (group, micro, large, control, factor, status).

    df: (group, jobs, is_micro); controls: (group, control). Without a control, or
    with fewer than `least` units, the micro factor is 1 + informal. Otherwise it
    fills the gap between the large units and the control, between 1 and
    1 / (1 - informal).
    """
    most = 1 / (1 - informal)
    sums = df.groupBy(group).agg(F.sum(F.when(F.col("is_micro"), F.col("jobs")).otherwise(0)).alias("micro"), F.sum(F.when(~F.col("is_micro"), F.col("jobs")).otherwise(0)).alias("large"), F.count("*").alias("units"))
    j = sums.join(controls, group, "left")
    raw = (F.col("control") - F.col("large")) / F.col("micro")
    status = (
        F.when(F.col("control").isNull(), "no control")
        .when(F.col("units") < least, "small sample")
        .when(F.col("micro") <= 0, "no micro")
        .when(F.col("large") >= F.col("control"), "formal excess")
        .when(raw > most, "capped")
        .otherwise("calibrated")
    )
    factor = F.when(status.isin("no control", "small sample"), 1 + informal).when(status.isin("no micro", "formal excess"), 1.0).otherwise(F.least(F.greatest(raw, F.lit(1.0)), F.lit(most)))
    return j.select(group, "micro", "large", "units", "control", factor.cast("double").alias("factor"), status.alias("status"))


def asymmetric_employment(df: DataFrame, controls: DataFrame, totals: DataFrame | None = None, *, group: str, informal: float, least: float = 500) -> DataFrame:
    """The full rule: (group, jobs, share, target, factor, status); `factor` is for micro and small units, but for `fallback`, where it is for all.

    df: (group, jobs, is_micro); controls: (group, control); totals: (group, total)
    of all jobs of the group, also outside the studied box. The control is scaled by
    the group's share of its total. No control, or fewer than `least` jobs: 1 +
    informal for all. Else the micro units fill the gap to the target, between 1
    (floor) and 1 / (1 - informal) (ceiling); with large units at or above a positive
    target they stay; without a target or micro units the factor is 1 + informal.
    """
    ceiling = 1 / max(0.01, 1 - informal)
    micro, large = F.sum(F.when(F.col("is_micro"), F.col("jobs")).otherwise(0)), F.sum(F.when(~F.col("is_micro"), F.col("jobs")).otherwise(0))
    s = df.groupBy(group).agg(micro.alias("micro"), large.alias("large"), F.sum("jobs").alias("jobs")).join(controls, group, "left")
    s = s.join(totals, group, "left") if totals is not None else s.withColumn("total", F.lit(None).cast("double"))
    s = s.withColumn("share", F.when(F.col("total") > 0, F.least(F.lit(1.0), F.col("jobs") / F.col("total"))).otherwise(F.lit(1.0)))
    s = s.withColumn("target", F.col("control") * F.col("share"))
    s = s.withColumn("raw", (F.col("target") - F.col("large")) / F.nullif(F.col("micro").cast("double"), F.lit(0.0)))
    fills = (F.col("micro") > 0) & (F.col("target") > F.col("large"))
    status = (
        F.when(F.col("control").isNull() | (F.col("jobs") < least), "fallback")
        .when(fills & (F.col("raw") > ceiling), "ceiling")
        .when(fills & (F.col("raw") < 1), "floor")
        .when(fills, "calibrated")
        .when((F.col("large") >= F.col("target")) & (F.col("target") > 0), "formal excess")
        .otherwise("global")
    )
    s = s.withColumn("status", status)
    factor = F.when(F.col("status").isin("fallback", "global"), 1 + informal).when(F.col("status") == "formal excess", 1.0).otherwise(F.least(F.greatest("raw", F.lit(1.0)), F.lit(ceiling)))
    return s.select(group, "jobs", F.when(F.col("status") == "fallback", 1.0).otherwise(F.col("share")).alias("share"), F.when(F.col("status") != "fallback", F.col("target")).alias("target"), factor.cast("double").alias("factor"), "status")


def parent_residual(df: DataFrame, controls: DataFrame, *, parent: str, value: str, capacity: str) -> DataFrame:
    """Null children get the parent's control less its published children, in proportion to capacity, capped by it.

    Adds `filled` and `source`: published, allocated, or unresolved (no control or no capacity).
    """
    free = F.when(F.col(value).isNull(), F.col(capacity)).otherwise(0)
    sums = df.groupBy(parent).agg(F.sum(F.coalesce(F.col(value), F.lit(0))).alias("_p"), F.sum(free).alias("_c")).join(controls, parent, "left")
    j = df.join(sums, parent, "left").withColumns({"_p": F.coalesce("_p", F.lit(0)), "_c": F.coalesce("_c", F.lit(0))})
    rest = F.greatest(F.col("control") - F.col("_p"), F.lit(0))
    share = F.when(F.col("_c") > 0, F.least(F.col(capacity).cast("double"), rest * F.col(capacity) / F.col("_c")))
    source = F.when(F.col(value).isNotNull(), "published").when(F.col("control").isNull() | (F.col("_c") <= 0), "unresolved").otherwise("allocated")
    return j.select(*df.columns, F.when(source == "published", F.col(value).cast("double")).when(source == "allocated", share).alias("filled"), source.alias("source"))


def hierarchical_rate(df: DataFrame, levels: list[str], *, value: str, capacity: str) -> DataFrame:
    """Null values get capacity times the rate (published sum over its capacity) of the nearest level that has one; adds `filled` and `source`."""
    known = F.when(F.col(value).isNotNull(), F.col(capacity))
    out, rates = df, []
    for level in levels:
        rate = df.groupBy(level).agg((F.sum(value) / F.nullif(F.sum(known), F.lit(0))).alias(f"_r_{level}"))
        out = out.join(rate, level, "left")
        rates.append((level, F.col(f"_r_{level}")))
    source = F.when(F.col(value).isNotNull(), "published").when(F.col(capacity) == 0, "zero")
    for level, r in rates:
        source = source.when(r.isNotNull(), level)
    filled = F.when(F.col(value).isNotNull(), F.col(value).cast("double")).when(F.col(capacity) == 0, 0.0).otherwise(F.col(capacity) * F.coalesce(*[r for _, r in rates]))
    return out.withColumns({"filled": filled, "source": source}).select(*df.columns, "filled", "source")


def bounded_fit(df: DataFrame, targets: DataFrame, *, group: str) -> DataFrame:
    """The factor f with sum clip(prior f, lo, hi) = target per group, exactly: (group, factor, status).

    The sum is piecewise linear in f with breaks at lo/prior and hi/prior. Slope
    and offset events are summed along the breaks, and the piece that holds the
    target is solved. df: (group, prior > 0, lo, hi; hi may be infinite).
    """
    low = df.select(group, (F.col("lo") / F.col("prior")).alias("at"), F.col("prior").alias("slope"), (-F.col("lo")).alias("base"))
    high = df.where(F.col("hi") < float("inf")).select(group, (F.col("hi") / F.col("prior")).alias("at"), (-F.col("prior")).alias("slope"), F.col("hi").alias("base"))
    steps = low.unionByName(high).groupBy(group, "at").agg(F.sum("slope").alias("slope"), F.sum("base").alias("base"))
    sums = df.groupBy(group).agg(F.sum("lo").alias("low"), F.sum("hi").alias("high"))
    w = Window.partitionBy(group).orderBy("at")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    pieces = steps.select(group, "at", F.sum("slope").over(run).alias("s"), F.sum("base").over(run).alias("b"), F.lead("at").over(w).alias("until"))
    j = pieces.join(sums.join(targets, group), group)
    # On a piece, sum(f) = low + b + s f.
    reached = F.coalesce(F.col("low") + F.col("b") + F.col("s") * F.col("until"), F.lit(float("inf")))
    f = F.when(F.col("s") > 1e-12, (F.col("target") - F.col("low") - F.col("b")) / F.col("s")).otherwise(F.col("at"))
    hit = j.where(reached >= F.col("target")).groupBy(group).agg(F.min(F.struct("at", F.greatest(f, F.col("at")).alias("f"))).alias("h"))
    out = sums.join(targets, group).join(hit, group, "left")
    ok = (F.col("target") >= F.col("low")) & (F.col("target") <= F.col("high"))
    return out.select(group, "target", F.when(ok, F.col("h.f")).alias("factor"), F.when(ok, "fitted").otherwise("infeasible").alias("status"))


def largest_remainder(df: DataFrame, *, group: str, key: str, value: str, capacity: str | None = None) -> DataFrame:
    """Integers with each group's total floor(sum + 0.5): floors, and one more for the largest fractions, ties by key.

    With a capacity only rows below it may get one more.
    """
    whole = F.floor(F.col(value)).cast("long")
    may = (whole < F.col(capacity)) if capacity else F.lit(True)
    d = df.withColumns({"_f": whole, "_may": may}).withColumn("_r", F.col(value) - F.col("_f"))
    w = Window.partitionBy(group)
    need = (F.floor(F.sum(value).over(w) + 0.5) - F.sum("_f").over(w)).cast("long")
    rank = F.row_number().over(w.orderBy(F.desc("_may"), F.desc("_r"), key))
    return d.withColumns({"_need": need, "_k": rank}).select(*df.columns, (F.col("_f") + (F.col("_may") & (F.col("_k") <= F.col("_need"))).cast("long")).alias("units"))


def split_cohorts(df: DataFrame, size: str, most: int) -> DataFrame:
    """Each row as ceil(size / most) balanced cohorts: adds `cohort` (from 0) and `cohort_size`."""
    n = F.ceil(F.col(size) / most).cast("long")
    out = df.where(F.col(size) > 0).withColumn("_n", n).withColumn("cohort", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    base = F.floor(F.col(size) / F.col("_n")).cast("long")
    return out.withColumn("cohort_size", base + (F.col("cohort") < F.col(size) - base * F.col("_n")).cast("long")).drop("_n")


def systematic_sample(df: DataFrame, *, group: str, key: str, weight: str, draws: int) -> DataFrame:
    """`draws` systematic draws per group along cumulative integer weights, from a hashed phase: adds `hits` (0 rows dropped)."""
    w = Window.partitionBy(group)
    run = F.sum(weight).over(w.orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    phase = F.conv(F.substring(F.sha2(F.col(group).cast("string"), 256), 1, 8), 16, 10).cast("double") / 2**32
    d = df.withColumns({"_c": run, "_t": F.sum(weight).over(w), "_p": phase})

    def marks(c):
        return F.floor(c * draws / F.col("_t") + 1 - F.col("_p")).cast("long")

    return d.withColumn("hits", marks(F.col("_c")) - marks(F.col("_c") - F.col(weight))).where("hits > 0").drop("_c", "_t", "_p")
