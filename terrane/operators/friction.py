"""Choosing the decay of distance by paired bootstrap, and how much a choice of it matters."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The decay that holds without better evidence, its rivals, replicates, the least effective sample, the least probability.
BASE, RIVALS, REPLICATES, LEAST_SAMPLE, LEAST_P = 0.12, (0.06, 0.09, 0.12, 0.18, 0.24), 200, 30.0, 1e-12


def uniform(*keys: Column) -> Column:
    """A number in [0, 1) that depends on the keys alone, the same in every engine: the first 32 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[k.cast("string") for k in keys])), 1, 8), 16, 10).cast("double") / 2.0**32


def poisson_draw(u: Column, most: int = 12) -> Column:
    """A Poisson count of mean one from a uniform number."""
    total, term, steps = 0.0, math.exp(-1.0), []
    for k in range(most):
        total += term
        term /= k + 1
        steps.append((u >= F.lit(total)).cast("int"))
    return sum(steps[1:], steps[0])


def candidates(probabilities: DataFrame) -> list[float]:
    """The decays that are compared, a handful."""
    return sorted({float(r["beta"]) for r in probabilities.select("beta").distinct().collect()})


def losses(records: DataFrame, probabilities: DataFrame) -> DataFrame:
    """(side, id, weight, losses): the records with -ln p of their pair under every decay, as a map; a pair without a flow has the least probability."""
    by_pair = probabilities.groupBy("o", "d").agg(F.map_from_entries(F.collect_list(F.struct("beta", "p"))).alias("ps"))
    betas = F.array(*[F.lit(b) for b in candidates(probabilities)])
    p = lambda b: F.greatest(F.coalesce(F.try_element_at("ps", b), F.lit(0.0)), F.lit(LEAST_P))
    return records.join(by_pair, ["o", "d"], "left").select("side", "id", "weight", F.transform(betas, lambda b: F.struct(b.alias("beta"), (-F.ln(p(b))).alias("loss"))).alias("losses"))


def compared(records: DataFrame, probabilities: DataFrame, replicates: int = REPLICATES) -> DataFrame:
    """(side, rep, beta, mass, lost): weighted losses of every decay over the records (rep 0), and over paired Poisson replicates of them (rep 1 on).

    A record is drawn equally often for every decay. All replicates come from one pass
    with sums on the map side; what is shuffled are parts x replicates x decays.
    """
    # The number is a column before it is compared, and no filter stands above it, or its MD5 would be taken anew for each comparison.
    # Each record becomes many rows: they are dealt over all cores first, for a small table is read by few tasks.
    dealt = records.repartition(4 * records.sparkSession.sparkContext.defaultParallelism, "id")
    x = losses(dealt, probabilities).select("side", "id", "weight", F.explode(F.sequence(F.lit(0), F.lit(replicates))).alias("rep"), "losses")
    x = x.withColumn("u", uniform(F.col("id"), F.col("rep")))
    x = x.select("side", "rep", (F.when(F.col("rep") == 0, 1).otherwise(poisson_draw(F.col("u"))) * F.col("weight")).alias("w"), "losses")
    betas = candidates(probabilities)
    sums = x.groupBy("side", "rep").agg(F.sum("w").alias("mass"), *[F.sum(F.col("w") * F.get("losses", k)["loss"]).alias(f"_{k}") for k in range(len(betas))]).where("mass > 0")
    each = F.array(*[F.struct(F.lit(b).alias("beta"), F.col(f"_{k}").alias("lost")) for k, b in enumerate(betas)])
    return sums.select("side", "rep", "mass", F.explode(each).alias("l")).select("side", "rep", "l.beta", "mass", "l.lost")


def sample_size(records: DataFrame) -> DataFrame:
    """(side, effective): Kish's effective number of records."""
    return records.groupBy("side").agg((F.sum("weight") ** 2 / F.sum(F.col("weight") ** 2)).alias("effective"))


def select_beta(records: DataFrame, probabilities: DataFrame, *, base: float = BASE, replicates: int = REPLICATES, least: float = LEAST_SAMPLE) -> DataFrame:
    """One row: proposed, selected, reason, and per decay (beta, loss, gain over it of the best, error, eligible), by beta; with what the guard says of the proposal.

    records: (side "selection" or "guard", id, o, d, weight > 0); probabilities: (beta,
    o, d, p) of every candidate. The best decay has the least loss on the selection
    (ties: nearest to base, then smallest). Eligible are those that it beats by no more
    than one standard error of the paired replicates; the one nearest to base is proposed, and
    selected only if 95 in 100 replicates of the guard gain over base. Without enough
    records on both sides, or flows that tell nothing, base stays.
    """
    sums = compared(records, probabilities, replicates).withColumn("loss", F.col("lost") / F.col("mass"))
    rows = sums.groupBy("side", "beta").agg(F.map_from_entries(F.collect_list(F.struct("rep", "loss"))).alias("by_rep")).collect()  # candidates x 2, replicates each
    tables = {(r["side"], r["beta"]): r["by_rep"] for r in rows}
    sizes = {r["side"]: r["effective"] for r in sample_size(records).collect()}
    told = probabilities.where(F.col("beta") == base).groupBy("o").agg(F.countDistinct("d").alias("n")).agg(F.max("n")).first()[0] or 0
    betas = sorted({b for side, b in tables if side == "selection"})
    enough = min(sizes.get("selection", 0.0), sizes.get("guard", 0.0)) >= least
    proposed, selected, reason, shown = base, base, "insufficient_evidence", []
    gain, low = None, None
    if told <= 1:
        reason = "municipal_flows_uninformative"
    elif enough and base in betas:
        nearest = lambda b: (abs(b - base), b)
        loss = {b: tables["selection", b][0] for b in betas}
        best = min(betas, key=lambda b: (loss[b], *nearest(b)))
        for b in betas:
            _, error, _ = paired(tables["selection", b], tables["selection", best])
            shown.append((b, loss[b], loss[b] - loss[best], error, loss[b] - loss[best] <= (error or 0.0) + 1e-12))
        proposed = min((s[0] for s in shown if s[4]), key=nearest)
        if ("guard", proposed) in tables:
            gain, _, low = paired(tables["guard", base], tables["guard", proposed])
        stable = proposed != base and low is not None and low > 0
        selected, reason = (proposed, "stable_guard_improvement") if stable else (base, "no_stable_improvement")
    schema = "proposed double, selected double, reason string, guard_gain double, guard_low double, decays array<struct<beta: double, loss: double, gain: double, error: double, eligible: boolean>>"
    return records.sparkSession.createDataFrame([(proposed, selected, reason, gain, low, shown)], schema)


def paired(reference: dict[int, float], other: dict[int, float]) -> tuple[float, float | None, float | None]:
    """(gain of `other` over all records, its standard error, its fifth percentile) from losses by replicate."""
    gains = sorted(reference[r] - other[r] for r in reference if r and r in other)
    n = len(gains)
    mean = sum(gains) / n if n else 0.0
    error = math.sqrt(sum((g - mean) ** 2 for g in gains) / (n - 1)) if n > 1 else None
    at = 0.05 * (n - 1)
    low = gains[int(at)] + (at - int(at)) * (gains[min(int(at) + 1, n - 1)] - gains[int(at)]) if n else None
    return reference[0] - other[0], error, low
