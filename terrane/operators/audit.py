"""Checks and comparisons of what a build made: provenance, stages, displacement, packages, surveys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions import geo
from terrane.functions import scalars as S
from terrane.operators.aggregates import percentiles


def provenance_totals(pops: DataFrame, provenance: DataFrame) -> DataFrame:
    """(source, reason, pairs, cohorts, travellers): cohorts by the route evidence of their pair; pairs without any are unknown."""
    pairs = pops.groupBy("o", "d").agg(F.count("*").alias("cohorts"), F.sum("size").alias("travellers")).join(provenance, ["o", "d"], "left")
    return pairs.groupBy(F.coalesce("source", F.lit("unknown")).alias("source"), F.coalesce("reason", F.lit("missing")).alias("reason")).agg(F.count("*").alias("pairs"), F.sum("cohorts").alias("cohorts"), F.sum("travellers").alias("travellers"))


def stage_summary(points: DataFrame, pops: DataFrame) -> DataFrame:
    """One row: points, cohorts, travellers, and the cohorts and travellers that start where they end."""
    loop = (F.col("o") == F.col("d")) & (F.col("size") > 0)
    s = pops.agg(F.count("*").alias("cohorts"), F.coalesce(F.sum("size"), F.lit(0)).alias("travellers"), F.coalesce(F.sum(loop.cast("long")), F.lit(0)).alias("loops"), F.coalesce(F.sum(F.when(loop, F.col("size"))), F.lit(0)).alias("loop_travellers"))
    return points.agg(F.count("*").alias("points")).join(s)


def mass_by_source(df: DataFrame, source: str, masses: list[str]) -> DataFrame:
    """Rows and masses by how they were placed or estimated."""
    return df.groupBy(source).agg(F.count("*").alias("rows"), *[F.sum(m).alias(m) for m in masses])


def camera(points: DataFrame) -> DataFrame:
    """(lon, lat): the barycentre of residents plus one and a half jobs."""
    w = F.col("residents") + 1.5 * F.col("jobs")
    return points.agg((F.sum(F.col("lon") * w) / F.sum(w)).alias("lon"), (F.sum(F.col("lat") * w) / F.sum(w)).alias("lat"))


def min_zoom(lon0: Column, lat0: Column, lon1: Column, lat1: Column) -> Column:
    """The zoom at which a box fills a screen 1920 pixels wide, 9 to 12."""
    span = F.greatest(F.abs(lon1 - lon0), F.abs(lat1 - lat0), F.lit(0.05))
    return F.bround(F.greatest(F.lit(9.0), F.least(F.lit(12.0), F.log2(900 / span)))).cast("int")


def weighted_stats(df: DataFrame, group: list[str], value: str, weight: str) -> DataFrame:
    """Weighted mean, standard deviation and effective sample size."""
    v, w = F.col(value), F.col(weight)
    s = df.where(w > 0).groupBy(*group).agg(F.count("*").alias("n"), F.sum(w).alias("weight"), F.sum(w * v).alias("_v"), F.sum(w * v * v).alias("_vv"), F.sum(w * w).alias("_ww"))
    mean = F.col("_v") / F.col("weight")
    return s.select(*group, "n", "weight", mean.alias("mean"), F.sqrt(F.greatest(F.col("_vv") / F.col("weight") - mean * mean, F.lit(0.0))).alias("std"), (F.col("weight") * F.col("weight") / F.col("_ww")).alias("ess"))


def displacement(pairs: DataFrame) -> DataFrame:
    """One row: p50, p95, p99 and the largest (interpolated) of the metres between (lon, lat) and (lon2, lat2)."""
    d = pairs.select(geo.flat_metres(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2")).alias("d"))
    return percentiles(d, [], "d", {"p50": 0.5, "p95": 0.95, "p99": 0.99, "max": 1.0})


def inferred_fallbacks(pairs: DataFrame) -> DataFrame:
    """Pairs whose distance and time are exactly those of the beeline rule, though no evidence was kept: (o, d, travellers, cohorts).

    pairs: one row a cohort (o, d, size, distance, seconds, beeline metres).
    """
    rule = S.driving_fallback(F.col("beeline"))
    same = (F.col("distance") == rule["distance"]) & (F.col("seconds") == rule["seconds"])
    s = pairs.groupBy("o", "d").agg(F.min(same).alias("all"), F.sum("size").alias("travellers"), F.count("*").alias("cohorts"))
    return s.where("all").drop("all")


def endpoint_incidence(pairs: DataFrame) -> DataFrame:
    """(id, travellers): how many travellers of the pairs start or end at each node."""
    ends = F.explode(F.array("o", "d"))
    return pairs.select(ends.alias("id"), "travellers").groupBy("id").agg(F.sum("travellers").alias("travellers"))


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """(rows, digest, sums...): equal for equal contents in any order."""
    digest = F.sum(F.xxhash64(*[F.col(c).cast("string") for c in columns]).cast("decimal(38,0)"))
    return df.agg(F.count("*").alias("rows"), digest.cast("string").alias("digest"), *[F.sum(c).alias(c) for c in columns if c.startswith("sum_")])


def compare_builds(before: DataFrame, after: DataFrame, place: str, columns: list[str], jobs: str) -> DataFrame:
    """(place, units_before, units_after, before, after, change, same): two builds by place; same: their units agree in all columns, in any order."""
    digest = F.sum(F.xxhash64(*[F.col(c).cast("string") for c in columns]).cast("decimal(38,0)"))

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(place).agg(F.count("*").alias(f"units_{name}"), F.sum(jobs).alias(name), digest.alias(f"_{name}"))

    both = side(before, "before").join(side(after, "after"), place, "full_outer")
    same = (F.col("units_before") == F.col("units_after")) & (F.col("_before") == F.col("_after"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    change = (F.coalesce("after", F.lit(0)) - F.coalesce("before", F.lit(0))).alias("change")
    return both.select(place, zero("units_before"), zero("units_after"), zero("before"), zero("after"), change, F.coalesce(same, F.lit(False)).alias("same"))


def package_violations(points: DataFrame, pops: DataFrame, membership: DataFrame) -> DataFrame:
    """(rule, violations) of a map package: repeated ids, sizes that are not positive, ends or members that do not exist or are missing.

    points: (id), pops: (id, o, d, size), membership: (point, pop).
    """
    rule = lambda name, df: df.agg(F.lit(name).alias("rule"), F.count("*").alias("violations"))
    twice = lambda df: df.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")
    ends = pops.select(F.explode(F.array("o", "d")).alias("point"), F.col("id").alias("pop")).distinct()
    ids = points.select(F.col("id").alias("point")).distinct()
    out = rule("repeated point", twice(points))
    for name, df in (
        ("repeated cohort", twice(pops)),
        ("size not positive", pops.where(F.col("size").isNull() | (F.col("size") <= 0))),
        ("unknown end", ends.join(ids, "point", "left_anti")),
        ("missing member", ends.join(membership, ["point", "pop"], "left_anti").join(ids, "point")),
        ("foreign member", membership.distinct().join(ends, ["point", "pop"], "left_anti")),
    ):
        out = out.unionByName(rule(name, df))
    return out


def display_mismatch(points: DataFrame, pops: DataFrame) -> DataFrame:
    """Points whose shown residents or jobs are not the sums of their trips."""
    out = pops.groupBy(F.col("o").alias("id")).agg(F.sum("size").alias("outgoing"))
    into = pops.groupBy(F.col("d").alias("id")).agg(F.sum("size").alias("incoming"))
    j = points.join(out, "id", "left").join(into, "id", "left").fillna(0, ["outgoing", "incoming"])
    return j.where((F.col("residents") != F.col("outgoing")) | (F.col("jobs") != F.col("incoming"))).select("id", "residents", "jobs", "outgoing", "incoming")


def years_available(df: DataFrame, column: str) -> DataFrame:
    """Distinct whole years from 1900 to 2100 in a text column."""
    year = F.trim(F.col(column).cast("string")).try_cast("double")
    return df.select(F.when((year == F.floor(year)) & year.between(1900, 2100), year.cast("int")).alias("year")).where("year is not null").distinct()


def heat_tone(fraction: Column, strength: float = 1.0) -> Column:
    """A logarithmic display curve that keeps zero, the peak and the order."""
    return F.pow(F.log1p(32 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), fraction))) / F.log1p(F.lit(32.0)), F.lit(1 / strength))


def modal_seconds(seconds: Column, distance: Column, *, speed: float = 22.0, motorised: float = 0.4) -> Column:
    """Seconds of a mix of cars at a traffic speed (10 to 60 km/h) and buses that take twice as long and five minutes, motorised share 0.05 to 1."""
    speed, motorised = max(10.0, min(60.0, speed)), max(0.05, min(1.0, motorised))
    car = F.when(seconds > 0, F.greatest(F.lit(45.0), seconds * (40.0 / speed))).when(distance > 0, F.greatest(F.lit(45.0), distance / (speed / 3.6))).otherwise(45.0)
    return F.greatest(F.lit(45), F.bround(motorised * car + (1 - motorised) * (car * 2 + 300)).cast("long"))


def survey_domain(df: DataFrame) -> DataFrame:
    """Employed residents of a labour survey: complete interviews, present, 15 to 98 years."""
    return df.where((F.col("r_def") == 0) & F.col("c_res").isin(1, 3) & F.col("eda").between(15, 98) & (F.col("clase2") == 1))


def income_status(income: Column, band: Column) -> Column:
    """What is known of an income: exact, zero, its band of minimum wages only, or nothing; a positive income in a band for none is refused."""
    positive = (income > 0) & (income < 999998)
    refused = F.raise_error(F.lit("a positive income in a band for none")).cast("string")
    return F.when(positive & band.isin(0, 6, 7), refused).when(positive, "exact").when((income == 0) & (band == 6), "zero").when(band.between(1, 5), "band").otherwise("unspecified")


def income_interval(income: Column, band: Column, wage: Column) -> Column:
    """struct(lo, hi) in which an income lies; hi is infinite where it is open."""
    # Bands of the general minimum wage.
    edges = {1: (0, 1), 2: (1, 2), 3: (2, 3), 4: (3, 5), 5: (5, None)}
    status = income_status(income, band)
    lo, hi = F.lit(0.0), F.lit(float("inf"))
    for b, (a, z) in edges.items():
        on = (status == "band") & (band == b)
        lo, hi = F.when(on, a * wage).otherwise(lo), F.when(on, z * wage if z else F.lit(float("inf"))).otherwise(hi)
    exact = status.isin("exact", "zero")
    return F.struct(F.when(exact, income.cast("double")).otherwise(lo).alias("lo"), F.when(exact, income.cast("double")).otherwise(hi).alias("hi"))


def display_category(poi: Column, kind: Column) -> Column:
    """The type of a special place: as given, else by the prefix of its id, else by words in it."""
    # Short type names, id prefixes and words of kinds of places.
    short = {"air": "airport", "uni": "university", "spo": "stadium", "tou": "resort", "med": "hospital", "tra": "transit_station", "cen": "convention_center", "cul": "cultural_center", "mus": "museum", "amu": "amusement_park", "prk": "park", "rel": "religious_institution", "gov": "government_facility", "rst": "resort"}
    prefixes = {"airport": ("AIR",), "university": ("UNI",), "sports_facility": ("SPO", "STA"), "hospital": ("MED", "HOS"), "shopping_center": ("MAL", "SHP", "COM"), "resort": ("TOU", "RST"), "cultural_center": ("CUL",), "museum": ("MUS",), "amusement_park": ("AMU",), "convention_center": ("CNV",), "park": ("PRK",), "religious_institution": ("REL",), "government_facility": ("GOV",), "port": ("PORT",), "transit_station": ("TRA",), "outside_connection": ("EXT",)}
    words = {"airport": ("aeropuerto", "airport"), "university": ("universidad", "tecnológico", "facultad"), "shopping_center": ("plaza", "mall", "centro comercial"), "resort": ("hotel", "resort", "punta"), "sports_facility": ("estadio", "stadium", "deportivo"), "hospital": ("hospital", "clínica", "médico"), "park": ("parque", "park")}
    given = F.lower(F.trim(kind))
    long = given
    for k, name in short.items():
        long = F.when(given == k, name).otherwise(long)
    out = F.when(F.coalesce(given, F.lit("")) != "", long)
    for name, some in prefixes.items():
        out = out.when(poi.rlike(f"^({'|'.join(some)})_"), name)
    for name, some in words.items():
        hit = F.lit(False)
        for w in some:
            hit |= F.lower(poi).contains(w)
        out = out.when(hit, name)
    return out.otherwise("custom")


def readable_name(poi: Column) -> Column:
    """An id without its prefix of three or four capitals, underscores as blanks."""
    return F.trim(F.replace(F.regexp_replace(poi, "^[A-Z]{3,4}_", ""), F.lit("_"), F.lit(" ")))


def localised_name(poi: Column, given: Column) -> Column:
    """A map of names: the given one, else one made of the id; airports in two languages."""
    name = F.coalesce(F.nullif(F.trim(given), F.lit("")), readable_name(poi))
    air = poi.startswith("AIR_") & (F.trim(F.coalesce(given, F.lit(""))) == "")
    spanish = F.when(air, F.concat(F.lit("Aeropuerto Internacional de "), name)).otherwise(name)
    two = F.create_map(F.lit("__default__"), spanish, F.lit("es"), spanish, F.lit("en"), F.concat(name, F.lit(" International Airport")))
    return F.when(air, two).otherwise(F.create_map(F.lit("__default__"), spanish, F.lit("es"), spanish))


def special_points(pois: DataFrame, pops: DataFrame) -> DataFrame:
    """Special places with the ids of the cohorts that reach them, in order; places without any too. pois: (id, kind, name), pops: (id, o, d)."""
    reach = pops.groupBy(F.col("d").alias("_d")).agg(F.array_sort(F.collect_list("id")).alias("pop_ids"))
    j = pois.join(reach, F.col("id") == F.col("_d"), "left")
    return j.select(F.col("id").alias("point_id"), display_category(F.col("id"), F.col("kind")).alias("type"), localised_name(F.col("id"), F.col("name"))["__default__"].alias("name"), F.coalesce("pop_ids", F.array().cast("array<long>")).alias("pop_ids"))
