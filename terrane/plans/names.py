"""Text and code queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.functions import scalars as S
from terrane.operators import places as P
from terrane.plans.base import registry, table

QUERIES, ORACLES, query = registry()
RAW = "r AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN CAST(p_partkey % 300 AS VARCHAR) WHEN 1 THEN CAST(p_partkey % 40 AS VARCHAR) || '.0' WHEN 2 THEN CAST(1000 + p_partkey * 17 % 40000 AS VARCHAR) WHEN 3 THEN 'a' || (p_partkey % 9) WHEN 4 THEN '' ELSE ' ' || (p_partkey % 700) || ' ' END AS m, CAST(p_partkey % 40 AS VARCHAR) AS e FROM part)"


def raw(spark, sf):
    k = F.col("p_partkey")
    m = (
        F.when(k % 6 == 0, (k % 300).cast("string"))
        .when(k % 6 == 1, F.concat((k % 40).cast("string"), F.lit(".0")))
        .when(k % 6 == 2, (1000 + k * 17 % 40000).cast("string"))
        .when(k % 6 == 3, F.concat(F.lit("a"), (k % 9).cast("string")))
        .when(k % 6 == 4, "")
        .otherwise(F.concat(F.lit(" "), (k % 700).cast("string"), F.lit(" ")))
    )
    return table(spark, sf, "part").select("p_partkey", m.alias("m"), (k % 40).cast("string").alias("e"))


@query(f"""WITH {RAW}, b AS (SELECT p_partkey, regexp_replace(upper(trim(m)), '\\.0$', '') AS m, e FROM r), c AS (SELECT p_partkey, m, coalesce(CASE WHEN regexp_matches(m, '^[0-9]{{4,5}}$') THEN lpad(m, 5, '0') END, CASE WHEN regexp_matches(m, '^[0-9]{{1,3}}$') AND regexp_matches(e, '^[0-9]{{1,2}}$') THEN lpad(e, 2, '0') || lpad(m, 3, '0') END) AS code FROM b)
SELECT p_partkey, CASE WHEN CAST(substr(code, 1, 2) AS INTEGER) BETWEEN 1 AND 32 AND CAST(substr(code, 3, 3) AS INTEGER) >= 1 THEN code ELSE '-1' END AS municipality, CASE WHEN regexp_matches(m, '^[0-9A-Z]+$') AND length(m) <= 4 THEN lpad(m, 4, '0') END AS area FROM c""")
def format_codes(spark, sf):
    return raw(spark, sf).select("p_partkey", S.municipality_code(F.col("m"), F.col("e")).alias("municipality"), S.geo_code(F.col("m"), 4).alias("area"))


BANDS_SQL = "b(i, lo, hi, prior) AS (VALUES " + ", ".join(f"({i}, {lo}::DOUBLE, {'NULL' if hi is None else hi}::DOUBLE, {p}::DOUBLE)" for i, (_, lo, hi, p) in enumerate(S.BANDS)) + ")"


@query(f"WITH {BANDS_SQL} SELECT p_partkey, lo, hi, prior FROM part LEFT JOIN b ON p_size % 8 = i")
def band_lookup(spark, sf):
    label = F.element_at(F.array(*[F.lit(b[0]) for b in S.BANDS], F.lit("unknown")), (F.col("p_size") % 8 + 1).cast("int"))
    b = table(spark, sf, "part").select("p_partkey", S.band_bounds(label).alias("b"))
    return b.select("p_partkey", "b.lo", F.when(F.col("b.hi") < float("inf"), F.col("b.hi")).alias("hi"), "b.prior")


@query("""WITH r AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '31-33 Manufacturing' WHEN 1 THEN (100000 + p_partkey * 7919 % 900000) || ' Class' WHEN 2 THEN (10 + p_partkey % 80) || ' Sector' WHEN 3 THEN 'Total ' || p_partkey ELSE (1000 + p_partkey % 9000) || ' Branch' END AS t FROM part), c AS (SELECT p_partkey, regexp_extract(trim(t), '^(31-33|48-49|[0-9]{2,6})( |$)', 1) AS c FROM r)
SELECT p_partkey, nullif(c, '') AS code, CASE WHEN c IN ('31-33', '48-49') THEN 'sector' WHEN length(c) = 2 THEN 'sector' WHEN length(c) = 3 THEN 'subsector' WHEN length(c) = 4 THEN 'branch' WHEN length(c) = 5 THEN 'subbranch' WHEN length(c) = 6 THEN 'class' END AS level FROM c""")
def activity_codes(spark, sf):
    k = F.col("p_partkey")
    t = (
        F.when(k % 5 == 0, "31-33 Manufacturing")
        .when(k % 5 == 1, F.concat((100000 + k * 7919 % 900000).cast("string"), F.lit(" Class")))
        .when(k % 5 == 2, F.concat((10 + k % 80).cast("string"), F.lit(" Sector")))
        .when(k % 5 == 3, F.concat(F.lit("Total "), k.cast("string")))
        .otherwise(F.concat((1000 + k % 9000).cast("string"), F.lit(" Branch")))
    )
    a = table(spark, sf, "part").select("p_partkey", S.activity_code(t).alias("code"))
    return a.withColumn("level", S.activity_level(F.col("code")))


NAME = "CASE p_partkey % 7 WHEN 0 THEN 'Colonia ' || p_name WHEN 1 THEN 'SM ' || (p_partkey % 300) WHEN 2 THEN CAST(p_partkey % 300 AS VARCHAR) WHEN 3 THEN 'Fracc. Jardín de la ' || p_brand WHEN 4 THEN 'el peñón ' || (p_partkey % 50) || 'b y manzana ' || (p_partkey % 9) WHEN 5 THEN 'LAS ÁGUILAS  II' ELSE p_name END"


def names(spark, sf):
    k = F.col("p_partkey")
    n = (
        F.when(k % 7 == 0, F.concat(F.lit("Colonia "), "p_name"))
        .when(k % 7 == 1, F.concat(F.lit("SM "), (k % 300).cast("string")))
        .when(k % 7 == 2, (k % 300).cast("string"))
        .when(k % 7 == 3, F.concat(F.lit("Fracc. Jardín de la "), "p_brand"))
        .when(k % 7 == 4, F.concat(F.lit("el peñón "), (k % 50).cast("string"), F.lit("b y manzana "), (k % 9).cast("string")))
        .when(k % 7 == 5, "LAS ÁGUILAS  II")
        .otherwise(F.col("p_name"))
    )
    return table(spark, sf, "part").select("p_partkey", n.alias("name"), "p_brand", "p_size")


NS = f"n AS (SELECT p_partkey, {NAME} AS name, p_brand, p_size FROM part)"
FOLD = f"translate(name, '{S.ACCENTED}', '{S.PLAIN}')"
KEY = f"k0 AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(trim(lower({FOLD})), '^(super *manzana|s[.]? *m[.]?)(\\s+|[0-9]|$)', 'supermanzana \\2'), '^(region|reg[.]?)(\\s+|[0-9]|$)', 'region \\2'), '^(colonia|col[.]?|fraccionamiento|fracc[.]?)\\s+', '') AS s FROM n), k AS (SELECT *, regexp_replace(CASE WHEN regexp_matches(trim(s), '^[0-9]+[a-z]?$') THEN 'supermanzana ' || s ELSE s END, '[^a-z0-9ñ]', '', 'g') AS key FROM k0)"


@query(f"WITH {NS}, {KEY} SELECT p_partkey, key FROM k")
def place_name_key(spark, sf):
    return names(spark, sf).select("p_partkey", S.place_key(F.col("name")).alias("key"))


@query(f"WITH {NS} SELECT p_partkey, array_to_string(regexp_extract_all(lower(name), '[0-9]+[a-z]?'), ',') AS tokens FROM n")
def numeric_tokens(spark, sf):
    return names(spark, sf).select("p_partkey", F.array_join(S.number_tokens(F.col("name")), ",").alias("tokens"))


@query(f"""WITH {NS}, w AS (SELECT p_partkey, unnest(string_split(trim(regexp_replace(lower(name), ' +', ' ', 'g')), ' ')) AS w, unnest(range(len(string_split(trim(regexp_replace(lower(name), ' +', ' ', 'g')), ' ')))) AS i FROM n)
SELECT p_partkey, string_agg(CASE WHEN regexp_matches(w, '^(i|ii|iii|iv|v|vi|vii|viii|ix|x)$') OR regexp_matches(w, '[0-9]') THEN upper(w) WHEN i > 0 AND w IN ('de', 'del', 'la', 'las', 'los', 'el', 'y', 'en') THEN w ELSE upper(substr(w, 1, 1)) || substr(w, 2) END, ' ' ORDER BY i) AS title FROM w GROUP BY 1""")
def smart_title_case(spark, sf):
    return names(spark, sf).select("p_partkey", S.title_case(F.col("name")).alias("title"))


CLASS = "CASE WHEN regexp_matches(lower({f}), '^(sm|smz|supermanzana)[ .]*[0-9]+') THEN 'supermanzana' WHEN regexp_matches({f}, '^[0-9]+$') THEN 'number' WHEN regexp_matches(lower({f}), '^(colonia|col[.]) ') THEN 'colonia' WHEN regexp_matches(lower({f}), '^(fraccionamiento|fracc[.]?) ') THEN 'fraccionamiento' WHEN regexp_matches(lower({f}), '[0-9]') THEN 'mixed' ELSE 'other' END"


@query(f"WITH {NS}, c AS (SELECT p_partkey, {CLASS.format(f=FOLD)} AS category, nullif(regexp_extract({FOLD}, '([0-9]+)', 1), '') AS number FROM n) SELECT category, count(*) AS n, min(number) AS low FROM c GROUP BY 1")
def classify_names(spark, sf):
    c = names(spark, sf).select(P.classify(F.col("name")).alias("c")).select("c.*")
    return c.groupBy("category").agg(F.count("*").alias("n"), F.min("number").alias("low"))


@query(f"WITH {NS}, d AS (SELECT p_partkey, name AS before, regexp_replace(name, '(^| )SM ([0-9]+)', '\\1Supermanzana \\2', 'g') AS after FROM n) SELECT * FROM d WHERE before <> after")
def regex_diff(spark, sf):
    return P.regex_changes(names(spark, sf).select("p_partkey", "name"), "name", "(^| )SM ([0-9]+)", "$1Supermanzana $2")


@query(f"WITH {NS}, {KEY} SELECT key, p_brand, count(*) AS n, min(p_partkey) AS winner, CAST(max(p_size) AS INTEGER) AS size FROM k GROUP BY 1, 2 HAVING count(*) >= 2")
def duplicate_groups_exact(spark, sf):
    return P.exact_groups(names(spark, sf).withColumn("key", S.place_key(F.col("name"))), ["key", "p_brand"], "p_partkey", "p_size")


@query(f"WITH {NS}, {KEY}, g AS (SELECT key, p_brand, p_size, min(p_partkey) AS id FROM k GROUP BY 1, 2, 3) SELECT a.id AS a, b.id AS b FROM g a JOIN g b ON a.key = b.key AND a.p_brand = b.p_brand AND a.id < b.id AND abs(a.p_size - b.p_size) <= 2")
def name_blocking_pairs(spark, sf):
    g = names(spark, sf).withColumn("key", S.place_key(F.col("name"))).groupBy("key", "p_brand", "p_size").agg(F.min("p_partkey").alias("id"))
    return P.block_pairs(g, ["key", "p_brand"], "id", F.abs(F.col("l.p_size") - F.col("r.p_size")) <= 2)


@query("SELECT l.doc_id, CASE WHEN d.n_chars < 100 THEN 'excluded' WHEN l.quality = 1 AND l.toxic = 0 THEN 'candidate' ELSE 'review' END AS disposition FROM labels l JOIN documents d USING (doc_id)")
def scope_triage(spark, sf):
    j = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    return j.select("doc_id", F.when(F.col("n_chars") < 100, "excluded").when((F.col("quality") == 1) & (F.col("toxic") == 0), "candidate").otherwise("review").alias("disposition"))


@query("SELECT source, CASE WHEN count(DISTINCT quality) = 1 THEN CAST(min(quality) AS VARCHAR) ELSE 'review' END AS label, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def consensus_label(spark, sf):
    j = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    return P.consensus(j, "source", "quality")


@query(f"WITH {NS}, {KEY}, s AS (SELECT p_partkey, key, p_size * 10 + CASE WHEN p_brand LIKE '%1' THEN 200 WHEN p_brand LIKE '%2' THEN 350 ELSE 0 END + CASE WHEN regexp_matches(key, '[0-9]') THEN -50 ELSE 100 END AS score FROM k) SELECT p_partkey, CAST(score AS INTEGER) AS score, CASE WHEN score >= 600 THEN 'large' WHEN score >= 300 THEN 'medium' ELSE 'small' END AS tier FROM s")
def place_scores(spark, sf):
    n = names(spark, sf).withColumn("key", S.place_key(F.col("name")))
    return P.scores(n).select("p_partkey", "score", "tier")


@query()
def label_planning(spark, sf):
    """Labels of suppliers by zoom: higher priority first, no overlap, shown labels stay."""
    k = F.col("s_suppkey")
    s = table(spark, sf, "supplier").select(k.alias("id"), (-99 + k * 37 % 1000 / 1000.0).alias("lon"), (19 + k * 53 % 1000 / 1000.0).alias("lat"), F.length("s_name").alias("chars"), F.col("s_acctbal").alias("priority"), F.col("s_nationkey").alias("zone"))
    return P.plan_labels(s, range(8, 12))
