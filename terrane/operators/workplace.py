"""Employment of establishments: bounded fits to published controls, transfer of historical means, allocation of population.

Units are rows (id, group columns, lo, hi, prior); a null band (lo, hi, prior)
is an unknown size. Controls are small published tables, joined by key, so units
are never gathered on one side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.operators.calibrate import bounded_fit

# Published size strata as (name, lower, upper; open above).
STRATA = (("0 A 10", 0.0, 10.0), ("11 A 50", 11.0, 50.0), ("51 A 250", 51.0, 250.0), ("251 Y MAS", 251.0, float("inf")))
UNKNOWN_PRIOR = 2.24


def stratum(lo: Column) -> Column:
    """The published stratum of a size band, by its lower bound."""
    out = F.when(lo.isNull(), F.lit(None).cast("string"))
    for name, _, high in STRATA:
        out = out.when(lo <= high, name)
    return out


def stratum_bounds(name: Column) -> tuple[Column, Column]:
    low, high = F.lit(None).cast("double"), F.lit(None).cast("double")
    for n, a, b in STRATA:
        low, high = F.when(name == n, a).otherwise(low), F.when(name == n, b).otherwise(high)
    return low, high


def with_fit(units: DataFrame, targets: DataFrame, group: list[str]) -> DataFrame:
    """Units with `jobs`: prior times the group's factor between the bounds where (group, target) can be met, else the prior; and the group's `factor`."""
    key = F.to_json(F.struct(*group))
    keyed = units.withColumn("_g", key)
    fits = bounded_fit(keyed.where("prior > 0").select("_g", "prior", "lo", "hi"), targets.select(key.alias("_g"), "target"), group="_g")
    fitted = F.least(F.greatest(F.col("prior") * F.col("factor"), F.col("lo")), F.col("hi"))
    out = keyed.join(fits.where("status = 'fitted'").select("_g", "factor"), "_g", "left")
    return out.withColumn("jobs", F.coalesce(F.when(F.col("factor").isNotNull(), fitted), F.col("prior"), F.lit(UNKNOWN_PRIOR))).drop("_g")


def sums(units: DataFrame, group: list[str]) -> DataFrame:
    """Per group: units, unknown bands, priors, and bounds of the known."""
    return units.groupBy(*group).agg(
        F.count("*").alias("units"),
        F.sum(F.col("lo").isNull().cast("long")).alias("unknown"),
        F.sum(F.coalesce("prior", F.lit(UNKNOWN_PRIOR))).alias("baseline"),
        F.coalesce(F.sum("lo"), F.lit(0.0)).alias("low"),
        F.coalesce(F.sum("hi"), F.lit(0.0)).alias("high"),
    )


def assign_prefix(units: DataFrame, controls: DataFrame, lengths: range = range(0, 7)) -> DataFrame:
    """Units with the `prefix` of the control of their municipality that begins their six-digit industry; the longest, if several do."""
    known = F.col("industry").rlike("^[0-9]{6}$")
    spread = units.select("id", "municipality", "industry", F.explode(F.array(*[F.lit(n) for n in lengths])).alias("n"))
    spread = spread.where((F.col("n") == 0) | known).withColumn("prefix", F.expr("substring(industry, 1, n)"))
    hit = spread.join(controls.select("municipality", "prefix"), ["municipality", "prefix"]).groupBy("id").agg(F.max_by("prefix", "n").alias("prefix"))
    return units.join(hit, "id", "left")


def bounded_controls(units: DataFrame, controls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(outcomes, units with jobs) of fitting disjoint groups (municipality, industry prefix) to published controls.

    controls: (municipality, prefix, employment, establishments); check
    relational.overlapping_prefixes first. A group is fitted only if its control is
    published, counts as many establishments, every band is known and the total lies
    between the bands' bounds.
    """
    own = assign_prefix(units, controls)
    group = ["municipality", "prefix"]
    s = controls.join(sums(own.where("prefix is not null"), group), group, "left")
    status = (
        F.when(F.col("employment").isNull() | F.col("establishments").isNull(), "suppressed")
        .when(F.coalesce("units", F.lit(0)) != F.col("establishments"), "count mismatch")
        .when(F.col("unknown") > 0, "unknown band")
        .when(~F.col("employment").between(F.col("low"), F.col("high")), "infeasible")
        .otherwise("fitted")
    )
    s = s.withColumn("status", status)
    jobs = with_fit(own, s.where("status = 'fitted'").select(*group, F.col("employment").cast("double").alias("target")), group)
    made = jobs.where("prefix is not null").groupBy(*group).agg(F.sum("jobs").alias("jobs"))
    out = s.join(made, group, "left").select(*group, F.coalesce("units", F.lit(0)).alias("units"), "status", F.coalesce("jobs", F.lit(0.0)).alias("jobs"))
    return out, jobs


def historical_transfer(units: DataFrame, controls: DataFrame, *, strength: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(outcomes, units with jobs): each cell (municipality, prefix, stratum) is moved towards its units times the published mean size.

    controls: (municipality, prefix, stratum, employment, establishments). The deepest
    prefix with a control owns a unit (assign_prefix). The mean must lie in its
    stratum and the full target between the bounds, whatever the strength is.
    """
    nodes = controls.select("municipality", "prefix").distinct()
    cell = ["municipality", "prefix", "stratum"]
    own = assign_prefix(units.withColumn("stratum", stratum(F.col("lo"))), nodes)
    open_ = own.where("prefix is not null and stratum is not null")
    s = sums(open_, cell).join(controls, cell, "left")
    low, high = stratum_bounds(F.col("stratum"))
    mean = F.col("employment") / F.col("establishments")
    s = s.withColumns({"mean": F.when(F.col("establishments") > 0, mean), "_low": low, "_high": high, "_known": F.col("establishments").isNotNull() | F.col("employment").isNotNull()})
    s = s.withColumn("full", F.col("units") * F.col("mean"))
    status = (
        F.when(~F.coalesce("_known", F.lit(False)), "missing control")
        .when(F.col("employment").isNull() | F.col("establishments").isNull(), "suppressed")
        .when(F.col("establishments") <= 0, "no establishments")
        .when(~F.col("mean").between(F.col("_low"), F.col("_high")), "invalid mean")
        .when(~F.col("full").between(F.col("low"), F.col("high")), "infeasible")
        .when(F.lit(strength == 0), "zero strength")
        .otherwise("transferred")
    )
    s = s.withColumns({"status": status, "target": F.col("baseline") * (1 - strength) + F.col("full") * strength})
    jobs = with_fit(own, s.where("status = 'transferred'").select(*cell, "target"), cell)
    made = jobs.where("prefix is not null and stratum is not null").groupBy(*cell).agg(F.sum("jobs").alias("jobs"))
    return s.join(made, cell).select(*cell, "units", "status", F.when(F.col("status") == "transferred", F.col("target")).alias("target"), "jobs"), jobs


def transfer_coverage(jobs: DataFrame) -> DataFrame:
    """(level, units, jobs) of transferred units by the depth of the code that owns them."""
    depth = F.length("prefix")
    level = F.when(depth == 2, "sector").when(depth == 3, "subsector").when(depth == 4, "branch").when(depth == 5, "subbranch").when(depth == 6, "class")
    return jobs.where("factor is not null").groupBy(level.alias("level")).agg(F.count("*").alias("units"), F.sum("jobs").alias("jobs"))


def inspect_controls(units: DataFrame, controls: DataFrame) -> DataFrame:
    """Per control (municipality, prefix): records left in scope, their bounds and whether the published total lies between them; nothing is changed.

    units have `scope` candidate, review or excluded.
    """
    own = assign_prefix(units, controls).where("prefix is not null")
    kept = F.col("scope") != "excluded"
    s = own.groupBy("municipality", "prefix").agg(
        F.count("*").alias("records"),
        F.sum((~kept).cast("long")).alias("excluded"),
        F.sum((F.col("scope") == "review").cast("long")).alias("review"),
        F.sum((kept & F.col("lo").isNull()).cast("long")).alias("unknown"),
        F.sum(F.when(kept, F.col("lo"))).alias("low"),
        F.sum(F.when(kept, F.col("hi"))).alias("high"),
    )
    j = controls.join(s, ["municipality", "prefix"], "left").fillna(0, ["records", "excluded", "review", "unknown"]).fillna(0.0, ["low", "high"])
    published = F.col("employment").isNotNull() & F.col("establishments").isNotNull()
    left = F.col("records") - F.col("excluded")
    return j.select(
        "municipality",
        "prefix",
        "records",
        "excluded",
        "review",
        "unknown",
        "low",
        F.when(F.col("high") < float("inf"), F.col("high")).alias("high"),
        F.when(published & (F.col("unknown") == 0), F.col("employment").between(F.col("low"), F.col("high"))).alias("feasible"),
        (left - F.col("establishments")).alias("surplus"),
        F.when(published & (left > 0), "benchmark").otherwise("unavailable").alias("status"),
    )


def choose_mode(controls: DataFrame) -> DataFrame:
    """One row (mode, groups, years, reason): transfer where one year's size cells are published, else bounded priors; several years are a conflict.

    controls: (year, municipality, prefix, stratum, employment, establishments).
    """
    cells = controls.where(F.col("stratum").isin(*[s[0] for s in STRATA]))
    published = F.col("employment").isNotNull() & (F.col("establishments") > 0)
    s = cells.agg(F.countDistinct("year").alias("years"), F.countDistinct(F.when(published, F.struct("municipality", "prefix"))).alias("groups"), F.count("*").alias("cells"))
    mode = F.when(F.col("years") > 1, "conflict").when(F.col("groups") > 0, "historical_transfer").otherwise("bounded")
    reason = F.when(F.col("years") > 1, "several years").when(F.col("groups") > 0, "published size cells").when(F.col("cells") == 0, "no controls").otherwise("no published size cells")
    return s.select(mode.alias("mode"), "groups", "years", reason.alias("reason"))


def scale_to_reference(blocks: DataFrame, reference: DataFrame) -> DataFrame:
    """Blocks with population, occupied and commuters scaled to a survey's municipal totals.

    blocks: (municipality, people, employed); reference: (municipality, base_people,
    base_employed, population, occupied, commuters), the base being full municipal
    census totals, so that a part of a municipality keeps its part only.
    """
    j = blocks.join(reference, "municipality")
    factor = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    j = j.withColumns({"growth": factor("population", "base_people"), "_e": factor("occupied", "base_employed"), "_c": factor("commuters", "occupied")})
    return j.select(*blocks.columns, "growth", (F.col("people") * F.col("growth")).alias("population"), (F.col("employed") * F.col("_e")).alias("occupied"), (F.col("employed") * F.col("_e") * F.col("_c")).alias("commuters"))


def allocate_population(blocks: DataFrame, reference: DataFrame) -> DataFrame:
    """As scale_to_reference, but nobody is occupied beyond a block's population: one factor a municipality, clipped by capacity.

    What the census has outside the blocks is a residual row (id null) that takes its
    part. blocks: (id, municipality, people, employed).
    """
    totals = blocks.groupBy("municipality").agg(F.sum("people").alias("_p"), F.sum("employed").alias("_e"))
    rest = reference.join(totals, "municipality").select(F.lit(None).cast(blocks.schema["id"].dataType).alias("id"), "municipality", F.greatest(F.col("base_people") - F.col("_p"), F.lit(0.0)).alias("people"), F.greatest(F.col("base_employed") - F.col("_e"), F.lit(0.0)).alias("employed"))
    rows = blocks.select("id", "municipality", F.col("people").cast("double").alias("people"), F.col("employed").cast("double").alias("employed")).unionByName(rest).join(reference, "municipality")
    growth = F.when(F.col("base_people") > 0, F.col("population") / F.col("base_people")).otherwise(0.0)
    rows = rows.withColumn("hi", F.col("people") * growth).withColumn("prior", F.greatest(F.col("employed"), F.col("hi") * 1e-9 + 1e-12)).withColumn("lo", F.lit(0.0))
    fits = bounded_fit(rows.select("municipality", "prior", "lo", "hi"), reference.select("municipality", F.col("occupied").cast("double").alias("target")), group="municipality")
    j = rows.join(fits.select("municipality", "factor"), "municipality")
    occupied = F.least(F.col("prior") * F.col("factor"), F.col("hi"))
    share = F.when(F.col("occupied") > 0, F.col("commuters") / F.col("occupied")).otherwise(0.0)
    return j.select("id", "municipality", F.col("hi").alias("population"), occupied.alias("employed"), (occupied * share).alias("travelling"))


def population_violations(df: DataFrame) -> DataFrame:
    """Rows that break travelling <= employed <= population, or are negative or not finite."""
    bad = (F.col("travelling") > F.col("employed") + 1e-6) | (F.col("employed") > F.col("population") + 1e-6)
    for c in ("population", "employed", "travelling"):
        bad |= F.col(c).isNull() | F.isnan(c) | (F.col(c) < -1e-8) | (F.col(c) == float("inf"))
    return df.where(bad)
