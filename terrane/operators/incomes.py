"""Survey incomes of domains, and generator parameters fitted to them by differential evolution."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.operators.aggregates import weighted_quantiles

# Quantiles of the target; the generator's cohort size, jitter and redistribution constants.
QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9, 0.95)
LABELS = ("p10", "p25", "p50", "p75", "p90", "p95")
COHORT, JITTER, BUMP, MARGIN, SPREAD = 50, 362436069, 123456789, 5000.0, 100000.0


def survey_stats(rows: DataFrame, group: list[str], value: str, weight: str) -> DataFrame:
    """(group, n, weight, mean, std, effective, p10 .. p95) of positive weights; quantiles without interpolation."""
    v, w = F.col(value), F.col(weight)
    some = rows.where((w > 0) & v.isNotNull())
    sums = some.groupBy(*group).agg(F.count("*").alias("n"), F.sum(w).alias("weight"), (F.sum(w * v) / F.sum(w)).alias("mean"), (F.sum(w) ** 2 / F.sum(w * w)).alias("effective"))
    spread = some.join(sums.select(*group, F.col("mean").alias("_m")), group) if group else some.join(F.broadcast(sums.select(F.col("mean").alias("_m"))))
    spread = spread.groupBy(*group).agg(F.sqrt(F.sum(w * (v - F.col("_m")) ** 2) / F.sum(w)).alias("std"))
    out = sums
    for other in (spread, weighted_quantiles(some, group, value, weight, QUANTILES)):
        out = out.join(other, group) if group else out.join(F.broadcast(other))
    return out.select(*group, "n", "weight", "mean", "std", "effective", *LABELS)


def normal_quantiles(p: np.ndarray) -> np.ndarray:
    """As scalars.normal_quantile, for arrays within (0.0001, 0.9999)."""
    # Published coefficients of P. J. Acklam's approximation.
    a = [-3.969683028665376e1, 2.209460984245205e2, -2.759285104469687e2, 1.383577518672690e2, -3.066479806614716e1, 2.506628277459239]
    b = [-5.447609879822406e1, 1.615858368580409e2, -1.556989798598866e2, 6.680131188771972e1, -1.328068155288572e1, 1.0]
    c = [-7.784894002430293e-3, -3.223964580411365e-1, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783]
    d = [7.784695709041462e-3, 3.224671290700398e-1, 2.445134137142996, 3.754408661907416, 1.0]
    p = np.clip(p, 0.0001, 0.9999)
    q = p - 0.5
    tail = np.sqrt(-2 * np.log(np.minimum(p, 1 - p)))
    outer = np.copysign(np.polyval(c, tail) / np.polyval(d, tail), 1) * np.where(p < 0.5, -1, 1)
    return np.where(np.abs(q) <= 0.47575, np.polyval(a, q * q) * q / np.polyval(b, q * q), outer)


def generated(parameters: np.ndarray) -> np.ndarray:
    """Incomes of one cohort for each row of (mean, deviation, least, most): normal by rank, bounded, the lowest and a tenth of all moved."""
    mean, deviation, least, most = (parameters[:, k : k + 1] for k in range(4))
    i = np.arange(COHORT, dtype=float)
    base = np.clip(mean + normal_quantiles(i / (COHORT - 1)) * deviation, least, most)
    jitter = (i * JITTER % 1_000_000) / 1_000_000
    other = mean + normal_quantiles(0.1 + jitter * 0.85) * deviation
    bump = (i * BUMP % 1_000_000) / 1_000_000 * SPREAD
    return np.clip(np.where(base <= least + MARGIN, other, np.where(jitter < 0.1, base + bump, base)), least, most)


def misfit(parameters: np.ndarray, wanted: np.ndarray, mean: float) -> np.ndarray:
    """Of each row: the mean square of the quantiles' relative errors, and a quarter of that of the mean."""
    incomes = np.sort(generated(parameters), axis=1)
    at = np.minimum(np.searchsorted(np.cumsum(np.full(COHORT, 1 / COHORT)), QUANTILES), COHORT - 1)
    errors = incomes[:, at] / wanted - 1
    return (errors**2).mean(1) + 0.25 * (incomes.mean(1) / mean - 1) ** 2


def evolved(wanted: np.ndarray, mean: float, seed: int, *, members: int = 48, rounds: int = 160, tolerance: float = 1e-8) -> tuple[np.ndarray, float]:
    """The best parameters of a seeded population: each generation moves from its best by differences of others (0.5 to 1 times), crossing seven in ten."""
    middle = wanted[2]
    low, high = np.array([0.2 * middle, 0.02 * middle, 0.0, wanted[4]]), np.array([2 * middle, 2 * middle, wanted[1], 4 * wanted[5]])
    rng = np.random.default_rng(seed)
    strata = np.stack([rng.permutation(members) for _ in range(4)], 1)
    people = (strata + rng.random((members, 4))) / members  # every parameter's range evenly covered
    score = misfit(low + people * (high - low), wanted, mean)
    for _ in range(rounds):
        if score.std() <= tolerance * abs(score.mean()):
            break
        others = np.stack([rng.permutation(members) for _ in range(2)])
        trial = people[score.argmin()] + rng.uniform(0.5, 1.0) * (people[others[0]] - people[others[1]])
        cross = rng.random((members, 4)) < 0.7
        cross[np.arange(members), rng.integers(0, 4, members)] = True
        trial = np.where(cross, trial, people)
        outside = (trial < 0) | (trial > 1)
        trial[outside] = rng.random(int(outside.sum()))
        new = misfit(low + trial * (high - low), wanted, mean)
        better = new <= score
        people[better], score[better] = trial[better], new[better]
    best = int(score.argmin())
    return low + people[best] * (high - low), float(score[best])


def fitted(targets: DataFrame, domain: str, *, units: float = 1.0, rounds: int = 160) -> DataFrame:
    """(domain, mean, deviation, least, most, misfit, worst) from survey_stats of positive monthly incomes, one row a domain.

    Parameters are yearly, in units of `units` each; worst is the largest relative error
    of a quantile. The seed is the domain's name, so a run repeats itself.
    """
    kind = targets.schema[domain].dataType.simpleString()

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for row in f.itertuples(index=False):
                wanted = np.array(row[2:], float) * 12 / units
                parameters, score = evolved(wanted, row[1] * 12 / units, zlib.crc32(str(row[0]).encode()), rounds=rounds)
                incomes = np.sort(generated(parameters[None])[0])
                at = np.minimum(np.searchsorted(np.cumsum(np.full(COHORT, 1 / COHORT)), QUANTILES), COHORT - 1)
                out.append((row[0], *np.round(parameters, 6), score, float(np.abs(incomes[at] / wanted - 1).max())))
            yield pd.DataFrame(out, columns=[domain, "mean", "deviation", "least", "most", "misfit", "worst"])

    some = targets.where("p10 > 0").select(domain, "mean", *LABELS)
    return some.mapInPandas(run, f"{domain} {kind}, mean double, deviation double, least double, most double, misfit double, worst double")
