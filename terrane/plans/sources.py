"""Source queries: driver rows written as files in the layouts of official sources, read back by the readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.functions import scalars as S
from terrane.operators import relational as R
from terrane.plans.base import registry, shared, table
from terrane.sources import official as O
from terrane.sources import readers, writers
from terrane.sources.scratch import folder

QUERIES, ORACLES, query = registry()


def lines(df, path, *, encoding="UTF-8"):
    """One text file of (n, value) lines in order."""
    df.repartition(1).sortWithinPartitions("n").select("value").write.option("encoding", encoding).text(path)
    return f"{path}/*.txt"


def table_file(spark, name, df, **options):
    path = folder(spark, name)
    df.write.option("header", True).options(**options).csv(path)
    return path


SHOPS = """SELECT p_partkey AS k, CAST(p_partkey AS STRING) AS id, CASE WHEN p_partkey % 9 = 0 THEN '' ELSE 'C' || CAST(p_partkey - p_partkey % 2 * CASE WHEN p_partkey % 10 = 1 THEN 1 ELSE 0 END AS STRING) END AS clee, p_name AS nom_estab,
CAST(19 + p_partkey * 53 % 1000 / 1000e0 AS STRING) AS latitud, CASE WHEN p_partkey % 50 = 0 THEN 'x' ELSE CAST(-99 + p_partkey * 37 % 1000 / 1000e0 AS STRING) END AS longitud,
CAST(p_partkey % 30 + 1 AS STRING) AS cve_ent, CAST(p_partkey % 120 AS STRING) AS cve_mun, p_size % 8 AS band FROM part"""
BAND_ROWS = "b(i, prior, micro) AS (VALUES " + ", ".join(f"({i}, {p}::DOUBLE, {'true' if hi is not None and hi <= 50 else 'false'})" for i, (_, lo, hi, p) in enumerate(S.BANDS)) + ", (7, 2.24::DOUBLE, true))"
SHOP_ROWS = f"""s AS ({SHOPS}), first_clee AS (SELECT clee, min_by(k, CASE WHEN k % 2 = 0 THEN k + 1000000000 ELSE k END) AS k FROM s WHERE clee <> '' GROUP BY 1), u AS (SELECT s.* FROM s LEFT JOIN first_clee f USING (clee) WHERE s.clee = '' OR s.k = f.k), {BAND_ROWS},
m AS (SELECT k, CASE WHEN CAST(cve_mun AS INTEGER) >= 1 THEN lpad(cve_ent, 2, '0') || lpad(cve_mun, 3, '0') ELSE '-1' END AS municipality, try_cast(longitud AS DOUBLE) AS lon, CAST(latitud AS DOUBLE) AS lat, prior AS jobs, micro AS is_micro FROM u JOIN b ON band = i)"""
BOX = (-98.8, 19.1, -98.1, 19.9)


def shop_files(spark, sf):
    """Two files of establishments: one with semicolons and one column for the band, one in Latin-1 with the other."""
    rows = shared(spark, sf, SHOPS)
    label = F.element_at(F.array(*[F.lit(b[0]) for b in S.BANDS], F.lit("?")), F.col("band").cast("int") + 1)
    first = rows.where("k % 2 = 1").select("id", "clee", "nom_estab", "latitud", "longitud", "cve_ent", "cve_mun", label.alias("personal_ocupado"))
    other = rows.where("k % 2 = 0").select(F.col("id").alias("ID "), "clee", "nom_estab", F.col("latitud").alias("LAT"), F.col("longitud").alias("LON"), "cve_ent", "cve_mun", label.alias("per_ocu"))
    a, b = table_file(spark, "shops", first, sep=";"), table_file(spark, "shops", other, encoding="ISO-8859-1")
    return [readers.read_csv(spark, [a], sep=";"), readers.read_csv(spark, [b], encoding="ISO-8859-1")]


# Twins share a clee with other places: for the check of totals, conflicts are looked at apart.
@query(f"WITH {SHOP_ROWS} SELECT count(*) AS n, CAST(sum(jobs) AS DOUBLE) AS jobs, CAST(sum(CASE WHEN is_micro THEN 1 ELSE 0 END) AS BIGINT) AS micro FROM m WHERE lon BETWEEN {BOX[0]} AND {BOX[2]} AND lat BETWEEN {BOX[1]} AND {BOX[3]}")
def denue_scan(spark, sf):
    rows, _, _ = O.establishments(shop_files(spark, sf), bbox=BOX)
    return rows.agg(F.count("*").alias("n"), F.sum("jobs").alias("jobs"), F.sum(F.col("is_micro").cast("long")).alias("micro"))


@query(f"WITH {SHOP_ROWS} SELECT municipality, sum(jobs) AS jobs FROM m WHERE municipality <> '-1' GROUP BY 1")
def denue_municipal_totals(spark, sf):
    _, totals, _ = O.establishments(shop_files(spark, sf))
    return totals


@query(f"WITH s AS ({SHOPS}) SELECT 'C' || CAST(p AS VARCHAR) AS clee, 2::BIGINT AS copies FROM (SELECT CAST(substr(clee, 2) AS BIGINT) AS p FROM s WHERE clee <> '' GROUP BY 1 HAVING count(*) > 1)")
def denue_conflicts(spark, sf):
    """Records under one clee that differ; a build refuses such sources."""
    _, _, clashes = O.establishments(shop_files(spark, sf))
    return clashes.where("k = 0").select(F.get_json_object("alias", "$.a").alias("clee"), F.col("values").alias("copies"))


CENSUS = """SELECT ent, mun, loc, ageb, mza, CASE WHEN n % 11 = 0 THEN '*' ELSE CAST(people AS STRING) END AS pobtot, CASE WHEN n % 7 = 0 THEN 'N/D' ELSE CAST(people - people % 3 AS STRING) END AS pocupada, CAST(people + 5 AS STRING) AS p_15ymas FROM (
SELECT CAST(c_nationkey + 1 AS STRING) AS ent, CAST(c_custkey % 6 + 1 AS STRING) AS mun, CAST(c_custkey % 4 + 1 AS STRING) AS loc, lpad(CAST(c_custkey % 9 + 1 AS STRING), 3, '0') || 'A' AS ageb, CAST(c_custkey % 90 + 1 AS STRING) AS mza, count(*) * 10 + min(c_custkey) % 100 AS people, min(c_custkey) AS n FROM customer GROUP BY c_nationkey, c_custkey % 6, c_custkey % 4, c_custkey % 9, c_custkey % 90
UNION ALL SELECT CAST(c_nationkey + 1 AS STRING), CAST(c_custkey % 6 + 1 AS STRING), '0', '0', '0', count(*) * 20, 1 FROM customer GROUP BY c_nationkey, c_custkey % 6) t"""


def census_rows(spark, sf):
    rows = shared(spark, sf, CENSUS).select(F.col("ent").alias("ENTIDAD"), F.col("mun").alias("MUN"), F.col("loc").alias("LOC"), F.col("ageb").alias("AGEB"), F.col("mza").alias("MZA"), F.col("pobtot").alias("POBTOT"), F.col("pocupada").alias("POCUPADA"), F.col("p_15ymas").alias("P_15YMAS"))
    return O.census(spark, table_file(spark, "census", rows.unionByName(rows.where("MZA = '7'")), sep="\t"), sep="\t", counts=("pobtot", "pocupada", "p_15ymas"))


PADDED = f"c AS ({CENSUS}), p AS (SELECT lpad(ent, 2, '0') || lpad(mun, 3, '0') AS municipality, lpad(loc, 4, '0') AS loc, lpad(ageb, 4, '0') AS ageb, lpad(mza, 3, '0') AS mza, try_cast(pobtot AS DOUBLE) AS pobtot, CASE WHEN pobtot = '*' THEN '*' ELSE '' END AS pobtot_status, try_cast(pocupada AS DOUBLE) AS pocupada, CASE WHEN pocupada = 'N/D' THEN 'N/D' ELSE '' END AS pocupada_status, CAST(p_15ymas AS DOUBLE) AS p15 FROM c)"


@query(f"WITH {PADDED} SELECT municipality, loc, ageb, mza, pobtot, pobtot_status, pocupada, pocupada_status FROM p WHERE mza <> '000'")
def employed_census_scan(spark, sf):
    blocks, _ = O.employed_census(census_rows(spark, sf), ["pobtot", "pocupada"])
    return blocks


@query(f"WITH {PADDED} SELECT municipality, pobtot AS people FROM p WHERE loc = '0000' AND ageb = '0000' AND mza = '000' AND pobtot > 0")
def census_municipal_totals(spark, sf):
    return O.municipal_totals(census_rows(spark, sf), "pobtot").withColumnRenamed("pobtot", "people")


@query(f"WITH {PADDED} SELECT round(sum(pocupada) / sum(p15), 4) AS rate FROM p WHERE loc = '0000' AND p15 > 0 AND pocupada IS NOT NULL")
def participation_rate(spark, sf):
    return O.participation_rate(census_rows(spark, sf), "pocupada", "p_15ymas")


@query(f"WITH {PADDED}, b AS (SELECT municipality AS m, count(*) AS blocks, coalesce(sum(pobtot), 0) AS people FROM p WHERE mza <> '000' GROUP BY 1) SELECT m, blocks, CAST(people AS DOUBLE) AS people FROM b WHERE m IN ('01001', '02002', '03003')")
def census_early_filter(spark, sf):
    """The census scan restricted to municipalities before anything is kept, copies of a row once."""
    path = folder(spark, "census")
    shared(spark, sf, CENSUS).withColumnsRenamed({"ent": "entidad"}).write.option("header", True).csv(path)
    rows = O.census(spark, path, municipalities=["01001", "02002", "03003"])
    blocks, _ = O.employed_census(rows, ["pobtot", "pocupada"])
    return blocks.groupBy(F.col("municipality").alias("m")).agg(F.count("*").alias("blocks"), F.coalesce(F.sum("pobtot"), F.lit(0.0)).alias("people"))


CONTROLS = """SELECT s_nationkey AS n, s_suppkey % 5 AS k, CASE WHEN s_suppkey % 7 = 0 THEN 2018 ELSE 2023 END AS y, count(*) AS c FROM supplier GROUP BY s_nationkey, s_suppkey % 5, CASE WHEN s_suppkey % 7 = 0 THEN 2018 ELSE 2023 END"""


def saic_file(spark, sf):
    rows = shared(spark, sf, CONTROLS)
    act = F.element_at(F.array(*[F.lit(x) for x in ("Total municipal", '"Sector 31-33 Industrias, manufactureras"', "Subsector 311 Alimentos", "Rama 311 Mal rotulada", "Sin actividad")]), F.col("k").cast("int") + 1)
    line = F.concat_ws(",", "y", F.concat(F.lpad((F.col("n") + 1).cast("string"), 2, "0"), F.lit(" Estado")), F.concat(F.lpad((F.col("n") % 9).cast("string"), 3, "0"), F.lit(" Pueblo")), act, F.when(F.col("k") == 2, "0 a 10").otherwise("Suma de estratos"), F.when(F.col("n") % 4 == 0, "*").otherwise((F.col("c") * 10).cast("string")), F.col("c").cast("string"))
    body = rows.select((F.col("y") * 1000 + F.col("n") * 10 + F.col("k")).alias("n"), line.alias("value"))
    head = spark.createDataFrame([(-4, "Instituto"), (-3, ""), (-2, "2023,23 Estado,001 Pueblo,Total municipal,Suma,1,1"), (-1, "Año Censal,Entidad,Municipio,Actividad económica,Estrato,H001A Personal ocupado total,UE Unidades económicas"), (10**9, "\0\0")], "n long, value string")
    return lines(body.unionByName(head), folder(spark, "saic"), encoding="ISO-8859-1")


CONTROL_SQL = f"c AS ({CONTROLS}), t AS (SELECT y AS year, 'municipality' AS level, lpad(CAST(n + 1 AS VARCHAR), 2, '0') || lpad(CAST(n % 9 AS VARCHAR), 3, '0') AS geography, CASE k WHEN 0 THEN '' WHEN 1 THEN '31-33' WHEN 2 THEN '311' END AS activity, CASE WHEN k = 2 THEN '0 A 10' ELSE 'TOTAL' END AS stratum, CASE WHEN n % 4 = 0 THEN NULL ELSE c * 10 END AS employment, c AS establishments FROM c WHERE n % 9 <> 0 AND k < 3)"


@query(f"WITH {CONTROL_SQL} SELECT * FROM t")
def saic_controls(spark, sf):
    controls, _ = O.saic_controls(spark, saic_file(spark, sf))
    return controls.drop("name")


@query(f"WITH {CONTROL_SQL} SELECT geography AS municipality, CAST(employment AS DOUBLE) AS employment FROM t WHERE activity = '' AND stratum = 'TOTAL' AND employment IS NOT NULL AND year = (SELECT max(year) FROM t WHERE activity = '' AND employment IS NOT NULL)")
def census_employment_saic(spark, sf):
    return O.municipal_employment(spark, saic_file(spark, sf))


@query("WITH t AS (SELECT n_nationkey AS n FROM nation) SELECT lpad(CASE WHEN n % 5 = 0 THEN '23' ELSE CAST(n + 1 AS VARCHAR) END, 2, '0') || lpad(CAST(n + 2 AS VARCHAR), 3, '0') AS municipality, CAST(n * 1000 + 5 AS DOUBLE) AS employment FROM t WHERE n % 6 <> 0")
def census_employment_tabulate(spark, sf):
    """The tabulate layout: a preamble, totals among other rows, thousands with commas."""
    n = F.col("n_nationkey")
    t = table(spark, sf, "nation").withColumn("t", F.explode(F.array(F.lit("TOTAL SECTOR"), F.lit("31-33"))))
    line = F.concat_ws(",", F.when(n % 5 == 0, "23").otherwise((n + 1).cast("string")), (n + 2).cast("string"), "t", F.when(n % 6 == 0, "99,C,").otherwise(F.concat(F.lit('99,"'), F.format_number(n * 1000 + 5, 0), F.lit('"'))))
    head = spark.createDataFrame([(-2, "Censos"), (-1, "E03,E04,CODIGO,ID_ESTRATO,H001A")], "n long, value string")
    body = t.select((n * 2 + (F.col("t") == "31-33").cast("int")).cast("long").alias("n"), line.alias("value"))
    return O.municipal_employment(spark, lines(body.unionByName(head), folder(spark, "tabulate")))


@query("WITH s AS (SELECT count(*) AS n FROM supplier) SELECT round(55 + n % 10 + 0.25, 2) / 100 AS participation, 0.45::DOUBLE AS informality FROM s")
def labour_indicators(spark, sf):
    """The rate is the first number in range of the first row that names it; a rate that is missing keeps its default."""
    n = table(spark, sf, "supplier").agg(F.count("*").alias("c"))
    rows = n.select(F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("n"), v.alias("value")) for i, v in enumerate((F.lit("Indicador;2024-T1;2024-T2"), F.lit("Tasa de desocupación;3,1;2,9"), F.concat(F.lit("Tasa de participación;7;"), (55 + F.col("c") % 10).cast("string"), F.lit(",25;61,0")), F.lit("Informalidad laboral 2;50;51")))])).alias("r")).select("r.*")
    path = lines(rows, folder(spark, "labour"))
    return O.labour_indicators(spark, path, sep=";")


PEOPLE = "SELECT c_nationkey + 1001 AS code, y, s, count(*) * (100 + y - 2020) AS people FROM customer CROSS JOIN (SELECT 2020 AS y UNION ALL SELECT 2025 UNION ALL SELECT 2030) yy CROSS JOIN (SELECT 'TOTAL' AS s UNION ALL SELECT 'HOMBRES') ss GROUP BY 1, 2, 3"


def projection_file(spark, sf):
    rows = shared(spark, sf, PEOPLE).select(F.col("code").alias("CLAVE"), F.col("y").alias("AÑO"), F.col("s").alias("SEXO"), F.format_number("people", 0).alias("POB_MIT_MUN"))
    return table_file(spark, "projection", rows.repartition(1)) + "/*.csv"


@query(f"WITH p AS ({PEOPLE}) SELECT lpad(CAST(code AS VARCHAR), 5, '0') AS municipality, CAST(people AS DOUBLE) AS value, 2025 AS effective_year FROM p WHERE s = 'TOTAL' AND y = 2025")
def conapo_projection(spark, sf):
    """Year 2027 is not there: 2025 is nearer than 2030."""
    return O.projections(spark, projection_file(spark, sf), 2027)


@query(f"WITH p AS ({PEOPLE}), a AS (SELECT code, people FROM p WHERE s = 'TOTAL' AND y = 2030), b AS (SELECT code, people FROM p WHERE s = 'TOTAL' AND y = 2020) SELECT lpad(CAST(code AS VARCHAR), 5, '0') AS municipality, round(a.people / b.people, 4) AS value, 2030 AS effective_year FROM a JOIN b USING (code)")
def conapo_growth(spark, sf):
    return O.projections(spark, projection_file(spark, sf), 2030, base=2020)


PERSONS = "SELECT lpad(CAST(1001 + c_nationkey AS STRING), 5, '0') AS code, CAST(c_custkey AS STRING) AS id, CAST(c_custkey % 95 AS STRING) AS age, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE CAST(8 + c_custkey % 16 AS STRING) END AS act, CAST(CASE WHEN c_custkey % 8 = 0 THEN 9 ELSE c_custkey % 8 END AS STRING) AS travel, CAST(c_custkey % 50 + 1 AS STRING) AS w FROM customer"


@query(f"WITH p AS ({PERSONS}), q AS (SELECT code, CAST(w AS DOUBLE) AS w, CAST(age AS INTEGER) BETWEEN 12 AND 130 AND try_cast(act AS INTEGER) BETWEEN 10 AND 20 AS occ, CAST(travel AS INTEGER) AS t FROM p) SELECT code AS municipality, sum(w) AS population, sum(CASE WHEN occ THEN w ELSE 0 END) AS occupied, sum(CASE WHEN occ AND t <= 6 THEN w ELSE 0 END) AS commuters, sum(CASE WHEN occ AND t = 7 THEN w ELSE 0 END) AS no_travel, sum(CASE WHEN occ AND t = 9 THEN w ELSE 0 END) AS unspecified FROM q GROUP BY 1")
def microdata_scan(spark, sf):
    """Persons, some given twice alike in overlapping files."""
    p = shared(spark, sf, PERSONS)
    p = p.unionByName(p.where("id % 3 = 0")).select(F.col("code").alias("CVEGEO"), F.col("id").alias("ID_PERSONA"), F.col("age").alias("EDAD"), F.col("act").alias("CONACT"), F.col("travel").alias("TIE_TRASLADO_TRAB"), F.col("w").alias("FACTOR"))
    totals, _ = O.people(spark, table_file(spark, "persons", p))
    return totals


@query("SELECT lpad(CAST(n_nationkey + 1 AS VARCHAR), 2, '0') || '001' AS municipality, CAST(n_nationkey * 100 + 50 AS DOUBLE) AS pobtot_value, CAST(n_nationkey * 40 + 20 AS DOUBLE) AS pocupada_value, CAST(n_nationkey * 100 + 50 + CASE WHEN n_nationkey % 8 = 3 THEN -5 ELSE 9 END AS DOUBLE) AS pobtot_high, n_nationkey % 8 = 3 AS fault FROM nation")
def eic_controls(spark, sf):
    """Survey controls in rows of estimators, one of eight with a broken interval."""
    n = F.col("n_nationkey")
    est = F.array(*[F.struct(F.lit(e).alias("estimador"), d.alias("d")) for e, d in zip(O.ESTIMATORS, (F.lit(0), F.lit(0), F.lit(-9), F.when(n % 8 == 3, -5).otherwise(9), F.lit(0)), strict=True)])
    rows = table(spark, sf, "nation").withColumn("e", F.explode(est)).select((n + 1).cast("string").alias("cve_ent"), F.lit("1").alias("cve_mun"), F.lit("0").alias("cve_loc"), F.col("e.estimador").alias("estimador"), (n * 100 + 50 + F.col("e.d")).cast("string").alias("pobtot"), (n * 40 + 20 + F.greatest(F.col("e.d"), F.lit(-9))).cast("string").alias("pocupada"))
    wide, faults = O.estimator_controls(rows)
    bad = faults.select("municipality", F.lit(True).alias("fault"))
    return wide.join(bad, "municipality", "left").select("municipality", "pobtot_value", "pocupada_value", "pobtot_high", F.coalesce("fault", F.lit(False)).alias("fault"))


@query("SELECT c_custkey, 'Peñón ' || c_name || CASE WHEN c_custkey % 3 = 2 THEN ' Á' ELSE '' END AS text, CASE c_custkey % 3 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'cp1252' ELSE 'cp1252+utf8' END AS encoding, CASE WHEN c_custkey % 3 = 2 THEN 1 ELSE 0 END AS repairs FROM customer")
def strict_decode(spark, sf):
    """Names as bytes: in UTF-8, in a one-byte code, and in the latter with one character of the former, which is found and counted."""
    k, text = F.col("c_custkey"), F.concat(F.lit("Peñón "), "c_name")
    raw = F.when(k % 3 == 0, F.encode(text, "UTF-8")).when(k % 3 == 1, F.encode(text, "ISO-8859-1")).otherwise(F.concat(F.encode(text, "ISO-8859-1"), F.encode(F.lit(" Á"), "UTF-8")))
    return table(spark, sf, "customer").select("c_custkey", O.decoded(raw).alias("d")).select("c_custkey", "d.text", "d.encoding", "d.repairs")


WITNESS = "SELECT p_partkey AS k, CASE WHEN p_partkey % 10 = 3 THEN '' ELSE 'C' || CAST(p_partkey - p_partkey % 2 AS STRING) END AS clee, CAST(p_partkey % 400 AS STRING) AS id, CAST(p_partkey % 3 AS STRING) AS cve_ent, p_brand AS asentamiento, CAST(19 + p_partkey * 53 % 1000 / 1000e0 AS STRING) AS latitud, CAST(-99 + p_partkey * 37 % 1000 / 1000e0 AS STRING) AS longitud FROM part"


@query(f"WITH w AS ({WITNESS}), i AS (SELECT *, CASE WHEN clee <> '' THEN 'clee:' || clee ELSE 'id:' || cve_ent || ':' || id END AS key FROM w WHERE CAST(longitud AS DOUBLE) BETWEEN {BOX[0]} AND {BOX[2]} AND CAST(latitud AS DOUBLE) BETWEEN {BOX[1]} AND {BOX[3]}) SELECT min(k) AS k FROM i GROUP BY key")
def settlement_witnesses(spark, sf):
    rows = table_file(spark, "witness", shared(spark, sf, WITNESS))
    return O.settlement_rows(readers.read_csv(spark, [rows]), BOX, "k").select(F.col("k").cast("long").alias("k"))


NATIVE = "SELECT s_suppkey AS id, CASE s_suppkey % 6 WHEN 0 THEN 'Calle ' || s_name WHEN 1 THEN '' WHEN 2 THEN '12-3' ELSE s_name END AS name, CASE WHEN s_suppkey % 7 = 0 THEN 'municipality' WHEN s_suppkey % 7 = 1 THEN 'Village' ELSE 'suburb' END AS place, -99 + s_suppkey * 37 % 1000 / 1000e0 AS lon, 19 + s_suppkey * 53 % 1000 / 1000e0 AS lat FROM supplier"


@query(f"WITH n AS ({NATIVE}) SELECT CAST(id AS VARCHAR) AS id, name, lower(place) AS type, lon, lat FROM n WHERE id % 6 > 2 AND place <> 'municipality' AND lon BETWEEN {BOX[0]} AND {BOX[2]} AND lat BETWEEN {BOX[1]} AND {BOX[3]}")
def native_places(spark, sf):
    """Point features written line by line and read feature by feature."""
    path = folder(spark, "native")
    writers.write_features(shared(spark, sf, NATIVE), path, "lon", "lat")
    return readers.native_places(readers.read_feature_lines(spark, path), BOX)


@query(f"WITH n AS ({NATIVE}) SELECT CAST(id AS VARCHAR) AS id, place, lon, lat FROM n")
def feature_collection(spark, sf):
    """One document of features in order, written and read."""
    path = folder(spark, "collection")
    writers.write_feature_collection(shared(spark, sf, NATIVE), path, "lon", "lat", "id")
    f = readers.read_geojson(spark, f"{path}/*.txt").withColumn("c", F.from_json("coordinates", "array<double>"))
    return f.select(F.col("properties")["id"].alias("id"), F.col("properties")["place"].alias("place"), F.col("c")[0].alias("lon"), F.col("c")[1].alias("lat"))


DEMAND_POINTS = "SELECT 's' || CAST(s_suppkey AS STRING) AS id, -99 + s_suppkey * 37 % 1000 / 1000e0 AS lon, 19 + s_suppkey * 53 % 1000 / 1000e0 AS lat, s_suppkey % 90 AS jobs, s_suppkey % 70 AS residents FROM supplier"
DEMAND_POPS = "SELECT 'p' || CAST(s_suppkey AS STRING) AS id, s_suppkey % 40 AS size, 's' || CAST(s_suppkey AS STRING) AS o, 's' || CAST(CASE WHEN s_suppkey % 9 = 0 THEN 999999 ELSE s_suppkey % 10 + 1 END AS STRING) AS d FROM supplier"


def demand_tables(spark, sf):
    points = shared(spark, sf, DEMAND_POINTS).select("id", F.array("lon", "lat").alias("location"), F.col("jobs").cast("long").alias("jobs"), F.col("residents").cast("long").alias("residents"))
    pops = shared(spark, sf, DEMAND_POPS).select("id", F.col("size").cast("long").alias("size"), F.col("o").alias("residenceId"), F.col("d").alias("jobId"), F.lit(60).cast("long").alias("drivingSeconds"), F.lit(150).cast("long").alias("drivingDistance"))
    return points, pops


def demand_zip(spark, sf):
    """A map package: the document and a configuration in one ZIP, stored as a binary file that any reader opens."""
    points, pops = demand_tables(spark, sf)
    doc = writers.demand_document(points, pops).select(F.lit("map").alias("package"), F.lit("demand_data.json").alias("name"), "value")
    config = spark.createDataFrame([("map", "config.json", '{"code": "MAP"}')], "package string, name string, value string")
    return writers.packaged(doc.unionByName(config))


@query(f"WITH p AS ({DEMAND_POPS}), s AS ({DEMAND_POINTS}) SELECT (SELECT count(*) FROM s) AS points, (SELECT CAST(sum(jobs) AS BIGINT) FROM s) AS jobs, (SELECT count(*) FROM p) AS pops, (SELECT CAST(sum(size) AS BIGINT) FROM p) AS travellers, 1 AS packages")
def demand_package(spark, sf):
    """Two ZIPs of equal members have equal bytes; what is unpacked from the document is what went in."""
    zips = demand_zip(spark, sf).unionByName(demand_zip(spark, sf))
    member = F.udf(lambda data: __import__("zipfile").ZipFile(__import__("io").BytesIO(bytes(data))).read("demand_data.json").decode(), "string")
    doc = zips.limit(1).select(F.from_json(member("content"), f"points array<{readers.POINT}>, pops array<{readers.POP}>").alias("d"))
    p, q = doc.select(F.explode("d.points").alias("p")).select("p.*"), doc.select(F.explode("d.pops").alias("q")).select("q.*")
    same = zips.agg(F.countDistinct("sha256").cast("int").alias("packages"))
    return p.agg(F.count("*").alias("points"), F.sum("jobs").alias("jobs")).join(q.agg(F.count("*").alias("pops"), F.sum("size").alias("travellers"))).join(same)


@query(f"WITH p AS ({DEMAND_POPS}), s AS ({DEMAND_POINTS}) SELECT 'missing id' AS rule, 0::BIGINT AS violations UNION ALL SELECT 'repeated id', 0 UNION ALL SELECT 'place out of range', 0 UNION ALL SELECT 'count missing or negative', 0 UNION ALL SELECT 'size not positive', count(*) FROM p WHERE size <= 0 UNION ALL SELECT 'unknown residence', 0 UNION ALL SELECT 'unknown job', count(*) FROM p WHERE d NOT IN (SELECT id FROM s)")
def demand_import(spark, sf):
    """A demand document is written, read and checked."""
    path = folder(spark, "demand")
    writers.demand_document(*demand_tables(spark, sf)).write.text(path)
    return readers.demand_violations(*readers.read_demand(spark, f"{path}/*.txt"))


@query("WITH b AS (SELECT s_suppkey AS id, s_suppkey * 37 % 1000 / 10.0::DOUBLE AS x, s_suppkey * 53 % 1000 / 10.0::DOUBLE AS y, (s_suppkey % 5) * 4.0::DOUBLE AS w FROM supplier), c AS (SELECT id, unnest(range(CAST(floor(x / 10) AS BIGINT), CAST(floor((x + w) / 10) AS BIGINT) + 1)) AS cx, y FROM b) SELECT cx, CAST(floor(y / 10) AS BIGINT) AS cy, count(*) AS n, min(id) AS first, max(id) AS last FROM c GROUP BY 1, 2")
def cell_index(spark, sf):
    k = F.col("s_suppkey")
    x, y, w = k * 37 % 1000 / 10.0, k * 53 % 1000 / 10.0, (k % 5) * 4.0
    boxes = table(spark, sf, "supplier").select(k.alias("id"), x.alias("x1"), y.alias("y1"), (x + w).alias("x2"), y.alias("y2"))
    return writers.cell_index(boxes, 10.0).select("cx", "cy", F.size("ids").cast("long").alias("n"), F.col("ids")[0].alias("first"), F.element_at("ids", -1).alias("last"))


@query("SELECT n_nationkey AS id, n_name AS name, 'suburb' AS place FROM nation")
def osm_patch(spark, sf):
    """Nodes as XML text, parsed again."""
    n = F.col("n_nationkey")
    rows = table(spark, sf, "nation").select(n.alias("id"), F.col("n_name").alias("name"), F.lit("suburb").alias("place"), (n / 10.0).alias("lon"), (n / 5.0).alias("lat"))
    x = F.col("value")
    return writers.osm_patch(rows).select(F.xpath_int(x, F.lit("/node/@id")).alias("id"), F.xpath_string(x, F.lit("/node/tag[@k='name']/@v")).alias("name"), F.xpath_string(x, F.lit("/node/tag[@k='place']/@v")).alias("place"))


@query("SELECT n_nationkey AS id, n_name AS name FROM nation")
def csv_export(spark, sf):
    path = folder(spark, "export")
    writers.write_csv(table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), path)
    return spark.read.option("header", True).schema("id int, name string").csv(path)


@query("SELECT count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS keys, 2::BIGINT AS files FROM customer WHERE c_acctbal BETWEEN 0 AND 5000")
def remote_parquet(spark, sf):
    """Partitioned Parquet written as a whole and scanned with a pushed box predicate."""
    path = folder(spark, "parquet")
    c = table(spark, sf, "customer").withColumn("half", F.col("c_custkey") % 2)
    c.repartition(1).write.partitionBy("half").parquet(path)
    rows = spark.read.parquet(path).where(F.col("c_acctbal").between(0, 5000))
    return rows.agg(F.count("*").alias("n"), F.sum("c_custkey").alias("keys"), F.countDistinct("half").alias("files"))


# Catalogue rows are contradictory where a code has two editions.
CATALOGUE = "SELECT c_custkey % 400 AS code, CASE WHEN c_custkey % 31 = 0 THEN 'other' ELSE 'name' || CAST(c_custkey % 400 AS STRING) END AS name, c_nationkey * 0 + c_custkey % 400 % 25 AS mun FROM customer"


@query(f"WITH c AS ({CATALOGUE}), o AS (SELECT code, min(name) AS name, min(mun) AS mun FROM c GROUP BY 1 HAVING count(DISTINCT name) = 1) SELECT code, name, n_name AS municipality FROM o JOIN nation ON n_nationkey = mun WHERE code % 7 <> 0")
def official_catalogue(spark, sf):
    """Codes with contradictory editions go, municipality names are looked up, unlocated rows (every seventh) are left out."""
    once = R.without_conflicts(shared(spark, sf, CATALOGUE), "code", ["name", "mun"])
    names = table(spark, sf, "nation").select(F.col("n_nationkey").alias("mun"), F.col("n_name").alias("municipality"))
    unlocated = once.where("code % 7 = 0").select("code")
    return R.many_to_one(once, names, ["mun"]).join(unlocated, "code", "left_anti").select("code", "name", "municipality")
