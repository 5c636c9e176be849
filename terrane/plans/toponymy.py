"""Queries on place names in full: taxonomy, title case, cleaning, duplicates, witnesses, labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.functions import scalars as S
from terrane.operators import relational as R
from terrane.operators import toponymy as T
from terrane.plans.base import registry, shared

QUERIES, ORACLES, query = registry()

NAMES = """SELECT p_partkey AS seq, CASE p_partkey % 19 WHEN 0 THEN 'Colonia ' || p_name WHEN 1 THEN 'SM ' || CAST(p_partkey % 300 AS STRING) WHEN 2 THEN CAST(p_partkey % 300 AS STRING) WHEN 3 THEN 'FRACC. jardín de la ' || p_brand WHEN 4 THEN 'Región ' || CAST(p_partkey % 90 AS STRING) || '-A' WHEN 5 THEN 'LAS ÁGUILAS  II' WHEN 6 THEN 'residencial los pinos' WHEN 7 THEN 'cda. del mar' WHEN 8 THEN 'u.h. ' || p_name WHEN 9 THEN 'Barrio de santiago' WHEN 10 THEN '' WHEN 11 THEN 'super manzana 23b' WHEN 12 THEN 'EJIDO alfredo v bonfil' WHEN 13 THEN CAST(p_partkey % 90 AS STRING) || '-b' WHEN 14 THEN 'villas de las flores' WHEN 15 THEN 'mz-12 lote-3 XIV' WHEN 16 THEN 'REG. ' || CAST(p_partkey % 90 AS STRING) WHEN 17 THEN 'santa-maría de-los ángeles' ELSE p_name END AS name, p_brand, p_size FROM part"""
# The Spanish names above, kind by kind, spelt out: category, prefix, core and number of each.
KINDS = """k AS (SELECT seq, name, CASE seq % 19 WHEN 0 THEN 'COLONIA' WHEN 1 THEN 'SUPERMANZANA' WHEN 2 THEN 'BARE_NUMERIC' WHEN 3 THEN 'FRACCIONAMIENTO' WHEN 4 THEN 'REGION' WHEN 5 THEN 'GENERIC' WHEN 6 THEN 'RESIDENCIAL' WHEN 7 THEN 'PRIVADA_CERRADA' WHEN 8 THEN 'UNIDAD_HABITACIONAL' WHEN 9 THEN 'BARRIO_PUEBLO' WHEN 10 THEN 'EMPTY' WHEN 11 THEN 'SUPERMANZANA' WHEN 12 THEN 'BARRIO_PUEBLO' WHEN 13 THEN 'BARE_NUMERIC' WHEN 16 THEN 'REGION' ELSE 'GENERIC' END AS category,
CASE seq % 19 WHEN 0 THEN 'Colonia' WHEN 1 THEN 'SM' WHEN 3 THEN 'FRACC.' WHEN 4 THEN 'Región' WHEN 6 THEN 'residencial' WHEN 7 THEN 'cda.' WHEN 8 THEN 'u.h.' WHEN 9 THEN 'Barrio de' WHEN 11 THEN 'super manzana' WHEN 12 THEN 'EJIDO' WHEN 16 THEN 'REG.' ELSE '' END AS prefix,
CASE seq % 19 WHEN 1 THEN CAST(seq % 300 AS VARCHAR) WHEN 2 THEN CAST(seq % 300 AS VARCHAR) WHEN 4 THEN CAST(seq % 90 AS VARCHAR) || '-A' WHEN 11 THEN '23b' WHEN 13 THEN CAST(seq % 90 AS VARCHAR) || '-b' WHEN 16 THEN CAST(seq % 90 AS VARCHAR) END AS number FROM n)"""
TITLE = "CASE seq % 19 WHEN 0 THEN 'Colonia ' || {name} WHEN 1 THEN 'SM ' || CAST(seq % 300 AS VARCHAR) WHEN 3 THEN 'Fracc. Jardín de la ' || {brand} WHEN 4 THEN 'Región ' || CAST(seq % 90 AS VARCHAR) || '-A' WHEN 5 THEN 'Las Águilas II' WHEN 6 THEN 'Residencial Los Pinos' WHEN 7 THEN 'Cda. del Mar' WHEN 8 THEN 'U.H. ' || {name} WHEN 9 THEN 'Barrio de Santiago' WHEN 11 THEN 'Super Manzana 23b' WHEN 12 THEN 'Ejido Alfredo V Bonfil' WHEN 13 THEN upper(name) WHEN 14 THEN 'Villas de las Flores' WHEN 15 THEN 'MZ-12 Lote-3 XIV' WHEN 16 THEN 'Reg. ' || CAST(seq % 90 AS VARCHAR) WHEN 17 THEN 'Santa-María de-Los Ángeles' WHEN 18 THEN {name} ELSE name END"


@query(f"WITH n AS ({NAMES}), {KINDS} SELECT seq, category, prefix, number FROM k")
def taxonomy(spark, sf):
    t = T.taxonomy(F.col("name"))
    return shared(spark, sf, NAMES).select("seq", t.alias("t")).select("seq", "t.category", "t.prefix", "t.number")


@query(f"WITH n AS ({NAMES}), {KINDS}, r AS (SELECT category, name, row_number() OVER (PARTITION BY category ORDER BY name) AS r FROM (SELECT DISTINCT category, name FROM k)) SELECT category, count(*) AS n, (SELECT string_agg(name, ' | ' ORDER BY name) FROM r WHERE r.category = k.category AND r <= 3) AS samples FROM k GROUP BY 1")
def name_diagnosis(spark, sf):
    return T.diagnosis(shared(spark, sf, NAMES), "name")


# Fixed names only: those made of part names are title case in both engines by their words.
@query(f"WITH n AS ({NAMES}) SELECT seq, {TITLE.format(name='p', brand='b')} AS title FROM (SELECT seq, name, NULL AS p, NULL AS b FROM n WHERE seq % 19 NOT IN (0, 3, 8, 18)) q")
def spanish_title(spark, sf):
    n = shared(spark, sf, NAMES).where("seq % 19 not in (0, 3, 8, 18)")
    return n.select("seq", T.spanish_title(F.col("name")).alias("title"))


@query(f"WITH n AS ({NAMES}) SELECT seq, CASE seq % 19 WHEN 1 THEN 'Supermanzana ' || CAST(seq % 300 AS VARCHAR) WHEN 2 THEN 'Supermanzana ' || CAST(seq % 300 AS VARCHAR) WHEN 4 THEN 'Supermanzana ' || CAST(seq % 90 AS VARCHAR) || '-A' WHEN 11 THEN 'Supermanzana 23b' WHEN 13 THEN 'Supermanzana ' || CAST(seq % 90 AS VARCHAR) || '-B' WHEN 16 THEN 'Supermanzana ' || CAST(seq % 90 AS VARCHAR) ELSE {TITLE.format(name='p', brand='b')} END AS clean FROM (SELECT seq, name, NULL AS p, NULL AS b FROM n WHERE seq % 19 NOT IN (0, 3, 8, 18, 12)) q")
def homogenised_names(spark, sf):
    """The cleaning steps as one projection: blocks in one form, prefixes, title case."""
    n = shared(spark, sf, NAMES).where("seq % 19 not in (0, 3, 8, 18, 12)")
    # A block's number gets its capital in the last step: 23b stays as found, 5-B by the rule for codes.
    return T.homogenise(n, "name").select("seq", "clean")


@query(f"WITH n AS ({NAMES}) SELECT seq, CASE seq % 3 WHEN 0 THEN 'Supermanzana ' || CAST(seq % 300 AS VARCHAR) WHEN 1 THEN 'Región ' || CAST(seq % 300 AS VARCHAR) ELSE 'Fracc. Los Pinos' END AS name, CASE WHEN seq % 3 = 2 THEN 'neighbourhood' ELSE 'suburb' END AS place FROM n")
def display_names(spark, sf):
    k = F.col("seq")
    raw = F.when(k % 3 == 2, "COLONIA LOS PINOS").otherwise((k % 300).cast("string"))
    kind = F.when(k % 3 == 0, "COLONIA").when(k % 3 == 1, "REGION").otherwise("FRACCIONAMIENTO")
    return shared(spark, sf, NAMES).select("seq", T.display_name(raw, kind).alias("d")).select("seq", "d.name", "d.place")


@query("SELECT s_suppkey AS id, CASE s_suppkey % 5 WHEN 0 THEN 'large' WHEN 1 THEN 'medium' WHEN 2 THEN 'small' WHEN 3 THEN 'medium' ELSE 'small' END AS scale FROM supplier")
def place_scale(spark, sf):
    kind = F.element_at(F.array(F.lit("Town"), F.lit("quarter"), F.lit(" hamlet "), F.lit(None), F.lit("colonia")), (F.col("id") % 5).cast("int") + 1)
    return shared(spark, sf, "SELECT s_suppkey AS id FROM supplier").select("id", T.scale(kind).alias("scale"))


@query(f"WITH n AS ({NAMES}), {KINDS} SELECT seq, CASE seq % 4 WHEN 0 THEN 600 WHEN 1 THEN 350 WHEN 2 THEN 200 ELSE 50 END + CASE seq % 3 WHEN 0 THEN 500 WHEN 1 THEN 200 ELSE 40 END + CASE category WHEN 'SUPERMANZANA' THEN 350 WHEN 'REGION' THEN 350 WHEN 'COLONIA' THEN 200 WHEN 'BARRIO_PUEBLO' THEN 180 WHEN 'FRACCIONAMIENTO' THEN 120 WHEN 'RESIDENCIAL' THEN 70 WHEN 'UNIDAD_HABITACIONAL' THEN 90 WHEN 'BARE_NUMERIC' THEN 220 ELSE 0 END + (seq % 7) * 2.5::DOUBLE AS density, CASE seq % 4 WHEN 0 THEN 600 WHEN 1 THEN 200 WHEN 2 THEN 350 ELSE 50 END + CASE seq % 3 WHEN 0 THEN 500 WHEN 1 THEN 200 ELSE 40 END::DOUBLE AS balanced, greatest(0, 150 - length(trim(name)) * 3)::DOUBLE AS shortest FROM k")
def place_score_full(spark, sf):
    """The three heuristics of a place's weight."""
    k = F.col("seq")
    source = F.element_at(F.array(*[F.lit(x) for x in ("YAML_CURATED", "OSM_NODE", "OSM_POLYGON", "INEGI_DENUE")]), (k % 4).cast("int") + 1)
    kind = F.element_at(F.array(*[F.lit(x) for x in ("city", "suburb", "village")]), (k % 3).cast("int") + 1)
    n = shared(spark, sf, NAMES)
    return n.select("seq", *[T.score(F.col("name"), source, kind, k % 7, heuristic=h).alias(h) for h in ("density", "balanced", "shortest")])


PLACES = "SELECT s_suppkey AS seq, CASE WHEN s_suppkey % 13 = 0 THEN 'i' || CAST(s_suppkey % 4 AS STRING) END AS id, CASE WHEN s_suppkey % 17 = 0 THEN 'c' || CAST(s_suppkey % 3 AS STRING) END AS official_code, CASE WHEN s_suppkey % 6 = 0 THEN 'locality' WHEN s_suppkey % 6 = 1 THEN 'settlement' END AS feature_kind, CASE WHEN s_suppkey % 5 = 0 THEN 'town' ELSE 'suburb' END AS type, 'la toscana ' || CAST(s_suppkey % 3 AS STRING) AS name, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE CAST(s_suppkey % 2 AS STRING) END AS cve_ent, CAST(NULL AS STRING) AS cve_mun, CAST(NULL AS STRING) AS cve_loc, CASE s_suppkey % 4 WHEN 0 THEN 'OSM_NODE' WHEN 1 THEN 'INEGI_DENUE' WHEN 2 THEN 'OSM_POLYGON' ELSE 'YAML_CURATED' END AS source, -99 + s_suppkey * 37 % 1000 / 1000e2 AS lon, 19 + s_suppkey * 53 % 1000 / 1000e2 AS lat, CAST(s_suppkey % 50 AS DOUBLE) AS score FROM supplier"
HAVERSINE = "2 * 6371000.0 * asin(least(1, sqrt(pow(sin(radians(r.lat - l.lat) / 2), 2) + cos(radians(l.lat)) * cos(radians(r.lat)) * pow(sin(radians(r.lon - l.lon) / 2), 2))))"
AGREE = "(coalesce(l.cve_ent, '') = '' OR coalesce(r.cve_ent, '') = '' OR l.cve_ent = r.cve_ent) AND (l.feature_kind IS NULL OR r.feature_kind IS NULL OR l.feature_kind = r.feature_kind) AND (l.official_code IS NULL OR r.official_code IS NULL OR l.official_code = r.official_code)"


def places(spark, sf):
    return shared(spark, sf, PLACES).withColumn("key", S.place_key(F.col("name"))).withColumn("old_key", F.lit(""))


@query(f"WITH p AS ({PLACES}) SELECT l.seq AS a, r.seq AS b FROM p l JOIN p r ON l.seq < r.seq AND {AGREE} AND {HAVERSINE} <= 500 AND (coalesce(l.id = r.id, false) OR coalesce(l.official_code = r.official_code, false) OR l.name = r.name)")
def same_place_pairs(spark, sf):
    """Pairs within 500 m that are one place by id, code or name, in territories, kinds and codes that agree."""
    return T.same_place_pairs(places(spark, sf), 500.0)


@query()
def spatial_dedup(spark, sf):
    """Which places give way to another of the same place, by rank of source and order; compared with the plain loop in tests."""
    return T.spatial_dedup(places(spark, sf))


@query()
def fuzzy_duplicates(spark, sf):
    """Groups of places that may be one, with their winners; compared with the plain loop in tests."""
    return T.duplicate_groups(places(spark, sf), 600.0)


@query(f"WITH p AS ({PLACES}), f AS (SELECT * FROM p WHERE seq % 2 = 0), k AS (SELECT * FROM p WHERE seq % 2 = 1), j AS (SELECT f.seq, k.name, sqrt(pow((f.lon - k.lon) * 111320 * cos(radians(f.lat)), 2) + pow((f.lat - k.lat) * 110574, 2)) AS d, f.name = k.name AS same, regexp_extract(f.name, '([0-9]+)', 1) = regexp_extract(k.name, '([0-9]+)', 1) AS num FROM f, k) SELECT f.seq, min(CASE WHEN d < 40 OR (same AND d < 120) OR (num AND d < 80) THEN j.name END) AS matched FROM f LEFT JOIN j USING (seq) GROUP BY 1")
def covered_places(spark, sf):
    """Found places (even) that known ones (odd) cover."""
    p = places(spark, sf)
    return T.covered(p.where("seq % 2 = 0"), p.where("seq % 2 = 1"), close=40.0, named=120.0, numbered=80.0)


@query(f"WITH p AS ({PLACES}), c AS (SELECT * FROM p WHERE seq % 2 = 0 AND name <> 'la toscana 2'), n AS (SELECT * FROM p WHERE seq % 2 = 1 AND name <> 'la toscana 2'), m AS (SELECT DISTINCT r.seq FROM c l JOIN n r ON l.seq < r.seq + 1000000 AND {AGREE} AND (coalesce(l.id = r.id, false) OR coalesce(l.official_code = r.official_code, false) OR l.name = r.name) AND (({HAVERSINE} <= 7500 AND (coalesce(l.id = r.id, false) OR coalesce(l.official_code = r.official_code, false))) OR {HAVERSINE} <= CASE WHEN l.type = 'town' AND r.type = 'town' THEN 7500 ELSE 500 END)) SELECT seq, name, 'curated' AS origin FROM c UNION ALL SELECT seq + 1000000, name, 'native' FROM n WHERE seq NOT IN (SELECT seq FROM m)")
def curated_merge(spark, sf):
    """The curated list with the native places it does not match, without removed names."""
    p = places(spark, sf)
    native = p.where("seq % 2 = 1").withColumn("seq", F.col("seq") + 1000000)
    removed = spark.createDataFrame([("LA TOSCANA 2 ",)], "name string")
    return T.curated_over_native(p.where("seq % 2 = 0"), native, removed).select("seq", "name", "origin")


WITNESSES = "SELECT c_custkey AS k, CASE WHEN c_custkey % 20 = 0 THEN 'Centro' ELSE 'Col. Jardín ' || CAST(c_custkey % 5 AS STRING) END AS settlement, CAST(c_nationkey % 3 AS STRING) AS cve_ent, '' AS cve_mun, '' AS cve_loc, CASE c_custkey % 3 WHEN 0 THEN 'COLONIA' ELSE 'FRACC' END AS kind, -99 + CASE WHEN c_nationkey % 2 = 0 THEN 0 ELSE 5e-1 END + c_custkey * 37 % 100 / 100e2 AS lon, 19 + c_custkey * 53 % 100 / 100e2 AS lat FROM customer"


@query(f"WITH w AS ({WITNESSES}), g AS (SELECT replace(lower(replace(settlement, 'Col. ', '')), 'jardín ', 'jardin') AS key, cve_ent, lon > -98.75 AS east, lon, lat FROM w WHERE settlement <> 'Centro') SELECT key, cve_ent, count(*) AS witnesses, CAST(round(median(lon) * 100000) AS BIGINT) AS lon, CAST(round(median(lat) * 100000) AS BIGINT) AS lat FROM g GROUP BY key, cve_ent, east HAVING count(*) >= 3")
def territorial_groups(spark, sf):
    """Witnesses of one name and territory in parts at most 5 km wide: two lots, half a degree apart."""
    g = T.territorial_groups(shared(spark, sf, WITNESSES), name="settlement", least=3)
    whole = lambda c: F.round(F.col(c) * 100000).cast("long").alias(c)
    return g.select("key", "cve_ent", "witnesses", whole("lon"), whole("lat"))


@query(f"WITH w AS ({WITNESSES}), c AS (SELECT settlement, count(*) AS n, median(lon) AS lon, median(lat) AS lat FROM w GROUP BY 1 HAVING count(*) >= 6), d AS (SELECT settlement, quantile_cont(sqrt(pow((w.lon - c.lon) * 111320 * cos(radians(c.lat)), 2) + pow((w.lat - c.lat) * 110574, 2)), 0.8) AS radius FROM w JOIN c USING (settlement) GROUP BY 1), m AS (SELECT settlement, kind FROM (SELECT settlement, kind, count(*) AS n FROM w GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY settlement ORDER BY n DESC, kind) = 1) SELECT settlement, n, round(lon, 9) AS lon, round(lat, 9) AS lat, round(radius, 4) AS radius, kind FROM c JOIN d USING (settlement) JOIN m USING (settlement)")
def settlement_dispersion(spark, sf):
    d = T.dispersion(shared(spark, sf, WITNESSES), "settlement", "kind", least=6)
    return d.select("settlement", "n", F.round("lon", 9).alias("lon"), F.round("lat", 9).alias("lat"), F.round("radius", 4).alias("radius"), "kind")


@query(f"WITH n AS ({NAMES}) SELECT seq, CASE WHEN seq % 5 = 0 THEN 'small' WHEN seq % 5 = 1 AND seq % 1000 * 400 >= 100000 THEN 'large' WHEN seq % 5 = 1 THEN 'medium' WHEN seq % 5 = 2 AND seq % 1000 * 10 >= 2500 THEN 'medium' WHEN seq % 5 = 3 THEN 'medium' ELSE 'small' END AS scale, CASE WHEN seq % 5 = 0 THEN 15 WHEN seq % 5 = 1 AND seq % 1000 * 400 >= 100000 THEN 6 WHEN seq % 5 = 1 THEN 10 WHEN seq % 5 = 2 AND seq % 1000 * 10 >= 2500 THEN 11 WHEN seq % 5 = 3 THEN 12 ELSE 14 END AS zoom, CASE WHEN seq % 8 = 0 THEN 'hidden' END AS hidden FROM n WHERE name <> ''")
def label_presentation(spark, sf):
    """How labels start: villages without people, towns by size, villages, urban references, others; and which are hidden."""
    k = F.col("seq")
    local = (k % 5).isin(0, 1, 2)
    people = F.when(k % 5 == 0, 0).when(k % 5 == 1, k % 1000 * 400 + F.when(k % 1000 == 0, 1).otherwise(0)).when(k % 5 == 2, k % 1000 * 10 + 1)
    p = T.presentation(F.when(k % 5 == 3, "suburb").otherwise("hamlet"), local, k % 5 == 1, people, F.lit(None))
    hidden = T.eligible(F.col("name"), F.lit(-99.0), F.lit(19.0), (-100.0, 18.0, -98.0, 20.0), F.lit(True), k % 8 == 0)
    n = shared(spark, sf, NAMES).where("name <> ''")
    return n.select("seq", p.alias("p"), hidden.alias("hidden")).select("seq", "p.scale", "p.zoom", "hidden")


KEYS = "SELECT p_partkey AS seq, CASE p_partkey % 9 WHEN 0 THEN 'S. M. ' || CAST(p_partkey % 50 AS STRING) WHEN 1 THEN 'Super Manzana' || CAST(p_partkey % 50 AS STRING) WHEN 2 THEN CAST(p_partkey % 50 AS STRING) || 'B' WHEN 3 THEN 'Reg. ' || CAST(p_partkey % 50 AS STRING) WHEN 4 THEN 'REGIÓN ' || CAST(p_partkey % 50 AS STRING) WHEN 5 THEN 'Col. Peña-Blanca' WHEN 6 THEN 'Fraccionamiento Los Álamos' WHEN 7 THEN 'Smith' ELSE 'Regional' END AS name FROM part"


@query(f"WITH k AS ({KEYS}) SELECT seq, CASE seq % 9 WHEN 0 THEN 'supermanzana' || seq % 50 WHEN 1 THEN 'supermanzana' || seq % 50 WHEN 2 THEN 'supermanzana' || seq % 50 || 'b' WHEN 3 THEN 'region' || seq % 50 WHEN 4 THEN 'region' || seq % 50 WHEN 5 THEN 'peñablanca' WHEN 6 THEN 'losalamos' WHEN 7 THEN 'smith' ELSE 'regional' END AS key FROM k")
def place_key_rules(spark, sf):
    return shared(spark, sf, KEYS).select("seq", S.place_key(F.col("name")).alias("key"))


@query(f"WITH n AS ({NAMES}) SELECT p_brand AS name, count(*) AS n FROM n GROUP BY 1 ORDER BY n DESC, name LIMIT 20")
def most_common_names(spark, sf):
    """The twenty most frequent values: a top-k report."""
    return R.most_common(shared(spark, sf, NAMES).withColumn("name", F.col("p_brand")), "name", 20)


@query(f"WITH p AS ({PLACES}) SELECT coalesce(cve_ent, '?') AS cve_ent, count(*) AS places, count(DISTINCT source) AS sources FROM p GROUP BY 1")
def coverage_by_territory(spark, sf):
    return shared(spark, sf, PLACES).groupBy(F.coalesce("cve_ent", F.lit("?")).alias("cve_ent")).agg(F.count("*").alias("places"), F.countDistinct("source").alias("sources"))
