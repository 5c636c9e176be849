"""Queries on establishments and population: bounded controls, transfer of historical means, survey references."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.functions import scalars as S
from terrane.operators import calibrate as C
from terrane.operators import relational as R
from terrane.operators import workplace as W
from terrane.plans.base import registry, shared

QUERIES, ORACLES, query = registry()

BAND = "b(i, lo, hi, prior) AS (VALUES " + ", ".join(f"({i}, {lo}e0, {'NULL' if hi is None else f'{hi}e0'}, {p}e0)" for i, (_, lo, hi, p) in enumerate(S.BANDS)) + ")"
UNITS = "SELECT p_partkey AS id, lpad(CAST(p_partkey % 12 AS STRING), 5, '0') AS municipality, CASE WHEN p_partkey % 29 = 0 THEN 'x' ELSE CAST(310000 + p_partkey * 7919 % 30000 AS STRING) END AS industry, CASE WHEN p_partkey % 211 = 0 THEN 7 ELSE p_size % 7 END AS band, CASE p_partkey % 10 WHEN 0 THEN 'excluded' WHEN 1 THEN 'review' ELSE 'candidate' END AS scope FROM part"
UNIT_SQL = f"{BAND}, u AS (SELECT id, municipality, industry, scope, lo, CASE WHEN i IS NOT NULL THEN coalesce(hi, 'infinity'::DOUBLE) END AS hi, prior FROM ({UNITS}) x LEFT JOIN b ON band = i)"


def units(spark, sf):
    label = F.element_at(F.array(*[F.lit(b[0]) for b in S.BANDS], F.lit("?")), F.col("band").cast("int") + 1)
    rows = shared(spark, sf, UNITS).withColumn("b", S.band_bounds(label))
    return rows.select("id", "municipality", "industry", "scope", "b.lo", "b.hi", "b.prior")


def fit_sql(units_: str, targets: str) -> str:
    """CTEs that solve sum clip(prior f, lo, hi) = target for each g, from tables of (g, lo, hi, prior) and (g, target): factor in table fx."""
    return f"""ev AS (SELECT g, lo / prior AS pos, prior AS slope, -lo AS base FROM {units_} UNION ALL SELECT g, hi / prior, -prior, hi FROM {units_} WHERE hi < 'infinity'::DOUBLE),
st AS (SELECT g, pos, sum(slope) AS slope, sum(base) AS base FROM ev GROUP BY 1, 2),
pc AS (SELECT g, pos, sum(slope) OVER (PARTITION BY g ORDER BY pos) AS s, sum(base) OVER (PARTITION BY g ORDER BY pos) AS b0, lead(pos) OVER (PARTITION BY g ORDER BY pos) AS nxt FROM st),
lw AS (SELECT g, sum(lo) AS low FROM {units_} GROUP BY 1),
hit AS (SELECT g, pos, CASE WHEN s > 1e-12 THEN greatest(pos, (target - low - b0) / s) ELSE pos END AS f, row_number() OVER (PARTITION BY g ORDER BY pos) AS k FROM pc JOIN lw USING (g) JOIN {targets} USING (g) WHERE nxt IS NULL OR low + b0 + s * nxt >= target),
fx AS (SELECT g, f AS factor FROM hit WHERE k = 1)"""


# Groups: whole industry 31 in even municipalities, 311 and 312 apart in odd ones.
GROUPS = "SELECT municipality, CASE WHEN CAST(municipality AS INTEGER) % 2 = 0 THEN '31' ELSE substr(industry, 1, 3) END AS prefix, count(*) AS n, sum(band) AS weight FROM (" + UNITS + ") u WHERE length(industry) = 6 AND substr(industry, 1, 2) = '31' AND (CAST(municipality AS INTEGER) % 2 = 0 OR substr(industry, 3, 1) IN ('1', '2')) GROUP BY 1, 2"
CONTROLS = f"SELECT municipality, prefix, CASE WHEN CAST(municipality AS INTEGER) % 5 = 4 THEN NULL ELSE CAST(n * (20 + CAST(municipality AS INTEGER) * 9) AS BIGINT) END AS employment, CASE WHEN CAST(municipality AS INTEGER) % 6 = 3 THEN n + 1 ELSE n END AS establishments FROM ({GROUPS}) g"


@query(f"""WITH {UNIT_SQL}, c AS ({CONTROLS}), o AS (SELECT u.*, c.prefix, u.municipality || c.prefix AS g FROM u JOIN c ON u.municipality = c.municipality AND length(industry) = 6 AND starts_with(industry, c.prefix)),
s AS (SELECT g, count(*) AS units, sum(CASE WHEN lo IS NULL THEN 1 ELSE 0 END) AS unknown, sum(lo) AS low, sum(hi) AS high, sum(coalesce(prior, 2.24)) AS base FROM o GROUP BY 1),
q AS (SELECT municipality, prefix, municipality || prefix AS g, employment, units, base, CASE WHEN employment IS NULL THEN 'suppressed' WHEN units <> establishments THEN 'count mismatch' WHEN unknown > 0 THEN 'unknown band' WHEN employment NOT BETWEEN low AND high THEN 'infeasible' ELSE 'fitted' END AS status FROM c JOIN s ON s.g = c.municipality || c.prefix)
SELECT municipality, prefix, units, status, CASE WHEN status = 'fitted' THEN employment::DOUBLE ELSE base END AS jobs FROM q""")
def bounded_workplaces(spark, sf):
    controls = shared(spark, sf, CONTROLS)
    outcomes, _ = W.bounded_controls(units(spark, sf), controls)
    return outcomes.withColumn("jobs", F.round("jobs", 6))


@query(f"WITH c AS ({CONTROLS} UNION ALL SELECT municipality, '3', 1, 1 FROM ({GROUPS}) h WHERE prefix = '31') SELECT a.municipality, a.prefix, b.prefix AS other FROM c a JOIN c b ON a.municipality = b.municipality AND a.prefix <> b.prefix AND starts_with(b.prefix, a.prefix)")
def overlapping_controls(spark, sf):
    """Prefixes of one municipality that contain each other: declarations a build refuses."""
    c = shared(spark, sf, f"SELECT municipality, prefix FROM ({CONTROLS}) c UNION ALL SELECT municipality, '3' FROM ({GROUPS}) h WHERE prefix = '31'")
    return R.overlapping_prefixes(c, "municipality", "prefix")


CELLS = f"SELECT municipality, prefix, stratum, CASE WHEN length(prefix) = 3 AND CAST(municipality AS INTEGER) % 4 = 1 THEN NULL ELSE CAST(n * CASE stratum WHEN '0 A 10' THEN 5 WHEN '11 A 50' THEN 25 WHEN '51 A 250' THEN CASE WHEN CAST(municipality AS INTEGER) % 3 = 0 THEN 900 ELSE 110 END ELSE 400 END AS BIGINT) END AS employment, CASE WHEN CAST(municipality AS INTEGER) % 7 = 6 THEN 0 ELSE n END AS establishments FROM (SELECT municipality, substr(industry, 1, CASE WHEN CAST(municipality AS INTEGER) % 2 = 0 THEN 2 ELSE 3 END) AS prefix, CASE WHEN band <= 1 THEN '0 A 10' WHEN band <= 3 THEN '11 A 50' WHEN band <= 5 THEN '51 A 250' ELSE '251 Y MAS' END AS stratum, count(*) + 1 AS n FROM ({UNITS}) u WHERE length(industry) = 6 AND band < 6 GROUP BY 1, 2, 3) k"
OWNED = f"c AS ({CELLS}), o AS (SELECT u.id, u.municipality, u.lo, u.hi, u.prior, max(c.prefix) AS prefix, CASE WHEN u.lo <= 10 THEN '0 A 10' WHEN u.lo <= 50 THEN '11 A 50' WHEN u.lo <= 250 THEN '51 A 250' ELSE '251 Y MAS' END AS stratum FROM u JOIN (SELECT DISTINCT municipality, prefix FROM c) c ON u.municipality = c.municipality AND length(u.industry) = 6 AND starts_with(u.industry, c.prefix) WHERE u.lo IS NOT NULL GROUP BY ALL)"
OUTCOMES = """s AS (SELECT municipality, prefix, stratum, count(*) AS units, sum(lo) AS low, sum(hi) AS high, sum(prior) AS base FROM o GROUP BY 1, 2, 3),
b9(stratum, a, z) AS (VALUES ('0 A 10', 0, 10::DOUBLE), ('11 A 50', 11, 50), ('51 A 250', 51, 250), ('251 Y MAS', 251, 'infinity'::DOUBLE)),
q AS (SELECT s.*, employment, establishments, units * employment / nullif(establishments, 0) AS full_, CASE WHEN c.municipality IS NULL THEN 'missing control' WHEN employment IS NULL OR establishments IS NULL THEN 'suppressed' WHEN establishments <= 0 THEN 'no establishments' WHEN employment / establishments NOT BETWEEN a AND z THEN 'invalid mean' WHEN units * employment / establishments NOT BETWEEN low AND high THEN 'infeasible' ELSE 'transferred' END AS status FROM s LEFT JOIN c USING (municipality, prefix, stratum) JOIN b9 USING (stratum))"""


@query(f"WITH {UNIT_SQL}, {OWNED}, {OUTCOMES} SELECT municipality, prefix, stratum, units, status, CASE WHEN status = 'transferred' THEN base * 0.4 + full_ * 0.6 END AS target, CASE WHEN status = 'transferred' THEN base * 0.4 + full_ * 0.6 ELSE base END AS jobs FROM q")
def historical_transfer(spark, sf):
    outcomes, _ = W.historical_transfer(units(spark, sf), shared(spark, sf, CELLS), strength=0.6)
    return outcomes.withColumns({"target": F.round("target", 6), "jobs": F.round("jobs", 6)})


@query(f"WITH {UNIT_SQL}, {OWNED}, {OUTCOMES} SELECT CASE length(prefix) WHEN 2 THEN 'sector' ELSE 'subsector' END AS level, CAST(sum(units) AS BIGINT) AS units, sum(full_) AS jobs FROM q WHERE status = 'transferred' GROUP BY 1")
def fine_transfer_coverage(spark, sf):
    """Full transfer by the deepest node that owns a record, and how much of it each level of the code carries."""
    _, jobs = W.historical_transfer(units(spark, sf), shared(spark, sf, CELLS))
    return W.transfer_coverage(jobs).withColumn("jobs", F.round("jobs", 6))


@query(f"WITH {UNIT_SQL}, {OWNED}, {OUTCOMES}, v AS (SELECT municipality || prefix || stratum AS g, lo, hi, prior, id FROM o JOIN q USING (municipality, prefix, stratum) WHERE status = 'transferred'), t AS (SELECT municipality || prefix || stratum AS g, base * 0.4 + full_ * 0.6 AS target FROM q WHERE status = 'transferred'), {fit_sql('v', 't')} SELECT id, round(least(greatest(prior * factor, lo), hi), 6) AS jobs FROM v JOIN fx USING (g)")
def transferred_units(spark, sf):
    """Each record's jobs under its cell's factor, clipped by its band."""
    _, jobs = W.historical_transfer(units(spark, sf), shared(spark, sf, CELLS), strength=0.6)
    return jobs.where("factor is not null").select("id", F.round("jobs", 6).alias("jobs"))


@query(f"WITH {UNIT_SQL}, c AS ({CONTROLS}), s AS (SELECT c.municipality, c.prefix, count(*) AS records, sum(CASE WHEN scope = 'excluded' THEN 1 ELSE 0 END) AS excluded, sum(CASE WHEN scope = 'review' THEN 1 ELSE 0 END) AS review, sum(CASE WHEN scope <> 'excluded' AND lo IS NULL THEN 1 ELSE 0 END) AS unknown, sum(CASE WHEN scope <> 'excluded' THEN lo END) AS low, sum(CASE WHEN scope <> 'excluded' THEN hi END) AS high FROM c JOIN u ON u.municipality = c.municipality AND length(industry) = 6 AND starts_with(industry, c.prefix) GROUP BY 1, 2) SELECT municipality, prefix, records, CAST(excluded AS BIGINT) AS excluded, CAST(review AS BIGINT) AS review, CAST(unknown AS BIGINT) AS unknown, low, CASE WHEN high < 'infinity'::DOUBLE THEN high END AS high, CASE WHEN employment IS NOT NULL AND unknown = 0 THEN employment BETWEEN low AND high END AS feasible, CAST(records - excluded - establishments AS BIGINT) AS surplus, CASE WHEN employment IS NOT NULL AND records > excluded THEN 'benchmark' ELSE 'unavailable' END AS status FROM s JOIN c USING (municipality, prefix)")
def inspect_benchmark(spark, sf):
    return W.inspect_controls(units(spark, sf), shared(spark, sf, CONTROLS))


@query(f"WITH c AS (SELECT CASE WHEN municipality = '00001' THEN 2018 ELSE 2023 END AS year, * FROM ({CELLS}) c), g AS (SELECT municipality < '00001' AS first, year, municipality, prefix, employment, establishments FROM c) SELECT a.name, CASE WHEN count(DISTINCT year) > 1 THEN 'conflict' WHEN count(DISTINCT CASE WHEN employment IS NOT NULL AND establishments > 0 THEN municipality || prefix END) > 0 THEN 'historical_transfer' ELSE 'bounded' END AS mode, count(DISTINCT CASE WHEN employment IS NOT NULL AND establishments > 0 THEN municipality || prefix END) AS groups FROM (VALUES ('all'), ('rest'), ('none')) a(name) LEFT JOIN g ON a.name = 'all' OR (a.name = 'rest' AND municipality <> '00001') GROUP BY 1")
def automatic_mode(spark, sf):
    """The mode for all cells (two years), for those of one year, and for none."""
    c = shared(spark, sf, f"SELECT CASE WHEN municipality = '00001' THEN 2018 ELSE 2023 END AS year, * FROM ({CELLS}) c")
    out = None
    for name, some in (("all", c), ("rest", c.where("municipality <> '00001'")), ("none", c.where("municipality = ''"))):
        one = W.choose_mode(some).select(F.lit(name).alias("name"), "mode", "groups")
        out = one if out is None else out.unionByName(one)
    return out


BLOCKS = "SELECT c_custkey AS id, c_nationkey AS municipality, CAST(c_custkey % 80 AS DOUBLE) AS people, CAST((c_custkey % 80) * (c_custkey % 3) / 4e0 AS DOUBLE) AS employed FROM customer"
REFERENCE = f"SELECT municipality, sum(people) + 40 AS base_people, sum(employed) + 25 AS base_employed, floor(sum(people) * 12e-1) + 50 AS population, floor(sum(people) * 7e-1) AS occupied, floor(sum(people) * 5e-1) AS commuters FROM ({BLOCKS}) b GROUP BY municipality"


@query(f"WITH b AS ({BLOCKS}), r AS ({REFERENCE}) SELECT id, municipality, people, employed, round(population / base_people, 6) AS growth, round(people * population / base_people, 6) AS population, round(employed * occupied / base_employed, 6) AS occupied, round(employed * occupied / base_employed * commuters / occupied, 6) AS commuters FROM b JOIN r USING (municipality)")
def reference_scaling(spark, sf):
    out = W.scale_to_reference(shared(spark, sf, BLOCKS), shared(spark, sf, REFERENCE))
    return out.withColumns({c: F.round(c, 6) for c in ("growth", "population", "occupied", "commuters")})


@query(f"""WITH b AS ({BLOCKS}), r AS ({REFERENCE}), a AS (SELECT id, municipality, people, employed FROM b UNION ALL SELECT NULL, municipality, greatest(base_people - sum(people), 0), greatest(base_employed - sum(employed), 0) FROM b JOIN r USING (municipality) GROUP BY municipality, base_people, base_employed),
v AS (SELECT a.id, municipality AS g, 0::DOUBLE AS lo, people * population / base_people AS hi, greatest(employed, people * population / base_people * 1e-9 + 1e-12) AS prior, commuters / occupied AS share FROM a JOIN r USING (municipality)), t AS (SELECT municipality AS g, occupied AS target FROM r), {fit_sql('v', 't')}
SELECT id, g AS municipality, round(hi, 6) AS population, round(least(prior * factor, hi), 6) AS employed, round(least(prior * factor, hi) * share, 6) AS travelling FROM v JOIN fx USING (g)""")
def population_allocation(spark, sf):
    """Blocks and a residual row for what lies outside; violations of travelling <= employed <= population raise none here."""
    out = W.allocate_population(shared(spark, sf, BLOCKS), shared(spark, sf, REFERENCE))
    return out.select("id", "municipality", *[F.round(c, 6).alias(c) for c in ("population", "employed", "travelling")])


@query(f"WITH b AS ({BLOCKS}) SELECT id FROM b WHERE employed > people OR employed * 15e-1 > employed + 1e-6 AND employed * 15e-1 > employed")
def population_invariants(spark, sf):
    """Rows that break the order of population, employed and travelling, in made-up rows where travelling is one and a half times employed."""
    b = shared(spark, sf, BLOCKS).select("id", F.col("people").alias("population"), "employed", (F.col("employed") * 1.5).alias("travelling"))
    return W.population_violations(b).select("id")


JOBS = "SELECT s_nationkey AS g, CAST(l_quantity AS BIGINT) AS jobs, p_size <= 25 AS is_micro FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey"
CONTROL = f"SELECT g, CAST(floor(sum(jobs) * (CASE WHEN g % 5 = 0 THEN 4e-1 WHEN g % 5 = 1 THEN 9e-1 WHEN g % 5 = 2 THEN 12e-1 WHEN g % 5 = 3 THEN 3e0 ELSE 0e0 END)) AS BIGINT) AS control FROM ({JOBS}) j WHERE g % 6 <> 0 GROUP BY g"
TOTAL = f"SELECT g, CAST(sum(jobs) * (1 + g % 3 * 25e-2) AS DOUBLE) AS total FROM ({JOBS}) j GROUP BY g"


@query(f"""WITH j AS ({JOBS}), c AS ({CONTROL}), t AS ({TOTAL}), s AS (SELECT g, CAST(sum(jobs) AS BIGINT) AS jobs, sum(CASE WHEN is_micro THEN jobs ELSE 0 END) AS micro, sum(CASE WHEN is_micro THEN 0 ELSE jobs END) AS large FROM j GROUP BY g),
q AS (SELECT s.*, control, least(1, jobs / total) AS share, control * least(1, jobs / total) AS target FROM s LEFT JOIN c USING (g) JOIN t USING (g)), k AS (SELECT *, (target - large) / nullif(micro, 0) AS raw FROM q),
z AS (SELECT *, CASE WHEN control IS NULL OR jobs < 5000 THEN 'fallback' WHEN micro > 0 AND target > large THEN CASE WHEN raw > 1 / 0.55 THEN 'ceiling' WHEN raw < 1 THEN 'floor' ELSE 'calibrated' END WHEN large >= target AND target > 0 THEN 'formal excess' ELSE 'global' END AS status FROM k)
SELECT g, jobs, CASE WHEN status = 'fallback' THEN 1.0 ELSE share END::DOUBLE AS share, CASE WHEN status <> 'fallback' THEN target END AS target, round(CASE WHEN status IN ('fallback', 'global') THEN 1.45 WHEN status = 'formal excess' THEN 1.0 ELSE least(greatest(raw, 1.0), 1 / 0.55) END, 6)::DOUBLE AS factor, status FROM z""")
def calibrate_employment(spark, sf):
    """The full rule of the asymmetric calibration: shares of the box, floor and ceiling, excess, global and fallback factors."""
    out = C.asymmetric_employment(shared(spark, sf, JOBS), shared(spark, sf, CONTROL), shared(spark, sf, TOTAL), group="g", informal=0.45, least=5000)
    return out.withColumn("factor", F.round("factor", 6))
