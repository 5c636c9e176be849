"""Official tabulates and microdata: strict decoding, header search, typed rows with their gaps kept apart.

Small control files (tabulates of some megabytes) are decoded whole, one file in
one task; large microdata and establishment files are read by Spark's own CSV
reader, which splits them.
"""

from __future__ import annotations

import csv
import io
import unicodedata
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.functions import scalars as S
from terrane.operators.relational import keep_first, ledger, ledger_conflicts
from terrane.sources.workbooks import read_workbooks

# Bytes without a character in Windows-1252, tokens of suppressed or missing counts, size strata of controls.
UNDEFINED = frozenset({0x81, 0x8D, 0x8F, 0x90, 0x9D})
MISSING = ("", "*", "N/D", "N/A", "NAN", "NONE")
STRATA = ("TOTAL", "0 A 10", "11 A 50", "51 A 250", "251 Y MAS", "AGRUPADOS POR CONFIDENCIALIDAD")
TOTALS = ("", "TOTAL", "SUMA", "SUMA DE ESTRATOS", "TOTAL DE ESTRATOS")
YEAR_NAMES = ("ANO", "ANIO", "YEAR", "AO")
ESTIMATORS = ("Valor", "Error estándar", "Límite inferior de confianza", "Límite superior de confianza", "Coeficiente de variación")


def decode_strict(data: bytes) -> tuple[str, str, list[int]]:
    """(text, encoding, repaired offsets): UTF-8, else Windows-1252, else the latter with whole UTF-8 characters in it.

    A byte that Windows-1252 does not define must be part of a valid, visible UTF-8
    character; otherwise the file is refused with the byte's offset.
    """
    body, shift = (data[3:], 3) if data[:3] == b"\xef\xbb\xbf" else (data, 0)
    for name in ("utf-8", "cp1252"):
        try:
            return body.decode(name), name, []
        except UnicodeDecodeError:
            pass
    text, at, repairs = [], 0, []
    for bad in (i for i, b in enumerate(body) if b in UNDEFINED):
        if bad < at:
            continue
        lead = bad - 1
        while lead >= at and lead > bad - 4 and 0x80 <= body[lead] <= 0xBF:
            lead -= 1
        try:
            first = body[lead] if lead >= at else 0
            size = 2 if first < 0xE0 else 3 if first < 0xF0 else 4
            shown = body[lead : lead + size].decode("utf-8") if first >= 0xC2 else ""
        except UnicodeDecodeError:
            shown = ""
        if len(shown) != 1 or unicodedata.category(shown).startswith("C"):
            raise ValueError(f"byte {bad + shift} (0x{body[bad]:02x}) is neither Windows-1252 nor part of a UTF-8 character")
        text += [body[at:lead].decode("cp1252"), shown]
        repairs.append(bad + shift)
        at = lead + size
    return "".join([*text, body[at:].decode("cp1252")]), "cp1252+utf8", repairs


def decoded(content: Column) -> Column:
    """struct(text, encoding, repairs, offsets) of bytes, by decode_strict."""

    @F.pandas_udf("text string, encoding string, repairs int, offsets array<int>")
    def run(data: pd.Series) -> pd.DataFrame:
        rows = [decode_strict(bytes(d)) for d in data]
        return pd.DataFrame([(t, e, len(r), r[:32]) for t, e, r in rows], columns=["text", "encoding", "repairs", "offsets"])

    return run(content)


def file_rows(spark: SparkSession, paths: str | list[str], *, sep: str = ",") -> DataFrame:
    """(file, n, fields): the rows of small delimited files, quoted line breaks kept; trailing NUL bytes are padding.

    Paths that end with .xlsx are workbooks: their sheets one after the other.
    """
    if isinstance(paths, str) and paths.lower().endswith(".xlsx"):
        b = read_workbooks(spark, paths.removesuffix("*.xlsx"))
        return b.select(F.concat_ws("#", "file", "sheet").alias("file"), "n", "fields")

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                rows = list(csv.reader(io.StringIO(decode_strict(bytes(data).rstrip(b"\0"))[0], newline=""), delimiter=sep))
                yield pd.DataFrame({"file": name, "n": range(len(rows)), "fields": rows})

    found = spark.read.format("binaryFile").load(paths).select("path", "content")
    return found.mapInPandas(run, "file string, n long, fields array<string>")


def headed(rows: DataFrame, markers: list[str], *, within: int | None = None) -> DataFrame:
    """(file, n, r): each row after its file's header as a map from upper-case plain header names to trimmed text.

    The header is the first row (among the first `within`) in which every marker
    occurs. Files without one give no rows.
    """
    line = F.upper(S.fold_accents(F.array_join("fields", "\x1f")))
    test = F.lit(True) if within is None else F.col("n") < within
    for m in markers:
        test &= line.contains(m)
    head = rows.where(test).groupBy("file").agg(F.min("n").alias("at"), F.min_by("fields", "n").alias("head"))  # a row for each file
    names = F.transform("head", lambda h: F.trim(S.normal_text(h)))
    body = rows.join(F.broadcast(head), "file").where(F.col("n") > F.col("at"))
    # A header without text names no column; of equal headers the first counts.
    keys = F.transform(names, lambda h, i: F.when((h == "") | (F.array_position(names, h) <= i), F.concat(F.lit("\x1f"), i.cast("string"))).otherwise(h))
    values = F.transform(F.sequence(F.lit(0), F.size("head") - 1), lambda i: F.trim(F.coalesce(F.get("fields", i), F.lit(""))))
    return body.select("file", "n", F.map_from_arrays(keys, values).alias("r"))


def field(prefix: str, r: str = "r") -> Column:
    """The value of the first header that starts with a prefix; empty text if there is none."""
    hit = F.filter(F.map_entries(r), lambda e: e["key"].startswith(prefix))
    return F.coalesce(F.get(hit, 0)["value"], F.lit(""))


def whole_number(c: Column) -> Column:
    return F.when(c.rlike("^[0-9]+$"), c.cast("long"))


def saic_controls(spark: SparkSession, paths: str | list[str], year: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(controls, contradictions) of SAIC tables whose header follows a preamble.

    controls: year, level, geography, activity, stratum, employment, establishments,
    name; suppressed counts stay null. One row for each key; keys with several
    different pairs of counts are contradictions, and the caller must refuse them.
    """
    r = headed(file_rows(spark, paths), ["H001A", "MUNICIPIO"], within=12)
    entity, town, activity = field("ENTIDAD"), field("MUNICIPIO"), S.normal_text(field("ACTIVIDAD ECONOMICA"))
    stratum = S.normal_text(field("ESTRATO"))
    r = r.select(
        "file",
        "n",
        whole_number(F.when(field("ANO CENSAL").rlike("^[0-9]{4}$"), field("ANO CENSAL"))).cast("int").alias("year"),
        F.regexp_extract(entity, r"^([0-9]{2})\b", 1).alias("ent"),
        F.regexp_extract(town, r"^([0-9]{3})\b", 1).alias("mun"),
        town.alias("name"),
        activity.alias("label"),
        S.labelled_activity(activity).alias("activity"),
        F.when(stratum.isin(*TOTALS), "TOTAL").otherwise(stratum).alias("stratum"),
        whole_number(field("H001A")).alias("employment"),
        whole_number(field("UE ")).alias("establishments"),
    )
    has_mun = (F.col("mun") != "") & (F.col("mun") != "000")
    level = F.when(has_mun & ~F.col("label").isin("TOTAL ESTATAL", "TOTAL NACIONAL"), "municipality").when(~has_mun & (F.col("name") == "") & (F.col("label") != "TOTAL MUNICIPAL"), "state")
    r = r.withColumn("level", level).where(F.col("year").isNotNull() & (F.col("ent") != "") & F.col("ent").try_cast("int").between(1, 32))
    r = r.where(F.col("level").isNotNull() & F.col("activity").isNotNull() & F.col("stratum").isin(*STRATA))
    r = r.where(F.col("year") == year) if year is not None else r
    r = r.withColumn("geography", F.when(F.col("level") == "state", F.col("ent")).otherwise(F.concat("ent", "mun")))
    keys = ["year", "level", "geography", "activity", "stratum"]
    pair = F.struct(F.coalesce("employment", F.lit(-1)), F.coalesce("establishments", F.lit(-1)))
    contradictions = r.groupBy(*keys).agg(F.countDistinct(pair).alias("values")).where("values > 1")
    return keep_first(r, keys, [F.col("file"), F.col("n")]).select(*keys, "employment", "establishments", "name"), contradictions


def municipal_employment(spark: SparkSession, paths: str | list[str], year: int | None = None) -> DataFrame:
    """(municipality, employment) of an economic census tabulate in either of its layouts.

    Layout A has E03 (state), E04 (municipality), H001A; only total activities
    without a stratum count, and a missing state is 23. Layout B is SAIC's, from
    which the all-industry totals of the year (by default the latest) are taken.
    """
    rows = file_rows(spark, paths)
    a = headed(rows, ["E04", "H001A"], within=8)
    state = F.coalesce(F.try_element_at("r", F.lit("E03")), F.lit("23"))
    total = F.coalesce(F.try_element_at("r", F.lit("CODIGO")), F.lit("TOTAL")).ilike("%total%")
    stratum = F.coalesce(F.try_element_at("r", F.lit("ID_ESTRATO")), F.lit("")).isin("", "nan", "99")
    count = F.regexp_replace(field("H001A"), ",", "").try_cast("double")
    a = a.where(total & stratum & F.col("r")["E04"].rlike("^[0-9]+$") & (count > 0))
    a = a.groupBy(F.concat(F.lpad(state, 2, "0"), F.lpad(F.col("r")["E04"], 3, "0")).alias("municipality")).agg(F.max_by(count, F.struct("file", "n")).alias("employment"))
    b, _ = saic_controls(spark, paths, year)
    b = b.where((F.col("level") == "municipality") & (F.col("activity") == "") & (F.col("stratum") == "TOTAL") & F.col("employment").isNotNull())
    if year is None:
        b = b.join(F.broadcast(b.agg(F.max("year").alias("year"))), "year")
    b = b.select(F.col("geography").alias("municipality"), F.col("employment").cast("double").alias("employment"))
    return a.unionByName(b.join(a, "municipality", "left_anti"))


def labour_indicators(spark: SparkSession, paths: str | list[str], *, sep: str = ",", participation: float = 0.62, informality: float = 0.45) -> DataFrame:
    """One row (participation, informality) from a key and value table: in the first row that names the rate, the first number in its range, as a share."""
    rows = file_rows(spark, paths, sep=sep).withColumn("line", F.lower(F.array_join("fields", " ")))

    def rate(test: Column, low: float, high: float) -> Column:
        numbers = F.transform("fields", lambda v: F.replace(F.trim(v), F.lit(","), F.lit(".")).try_cast("double"))
        first = F.get(F.filter(numbers, lambda v: v.between(low, high)), 0)
        return F.min_by(F.when(test, first), F.when(test & first.isNotNull(), F.struct("file", "n")))

    named = F.col("line").contains("tasa de participaci") | F.col("line").contains("participacion")
    informal = F.col("line").contains("informalidad laboral 1") | F.col("line").contains("til1")
    found = rows.agg(rate(named, 30, 90).alias("p"), rate(informal, 10, 90).alias("i"))
    return found.select(F.coalesce(F.bround(F.col("p") / 100, 4), F.lit(participation)).alias("participation"), F.coalesce(F.bround(F.col("i") / 100, 4), F.lit(informality)).alias("informality"))


def projections(spark: SparkSession, paths: str | list[str], target: int, *, base: int | None = None) -> DataFrame:
    """(municipality, value, effective_year): population of the target year, or of the nearest there is (the earlier of two).

    With a `base` year that the table has, value is the ratio to that year's
    population, rounded to four places. Where a TOTAL of the sexes is given, only that counts.
    """
    r = headed(file_rows(spark, paths), ["CLAVE", "POB"])
    year = F.coalesce(*[F.try_element_at("r", F.lit(n)) for n in YEAR_NAMES])
    sex = F.upper(F.coalesce(F.try_element_at("r", F.lit("SEXO")), F.lit("")))
    r = r.select(F.col("r")["CLAVE"].try_cast("double").cast("int").alias("code"), F.coalesce(F.regexp_replace(field("POB"), ",", "").try_cast("double"), F.lit(0.0)).alias("people"), year.try_cast("double").cast("int").alias("year"), sex.alias("sex"))
    r = r.where("code > 0")
    facts = r.agg(F.max((F.col("sex") == "TOTAL").cast("int")).alias("totals"), F.array_sort(F.collect_set("year")).alias("years")).first()  # a few dozen years
    if facts["totals"]:
        r = r.where("sex = 'TOTAL'")
    years = facts["years"] or []
    chosen = min(years, key=lambda y: (abs(y - target), y)) if years else None
    municipality = F.lpad(F.col("code").cast("string"), 5, "0").alias("municipality")

    def people(y: int | None, name: str) -> DataFrame:
        some = r if y is None else r.where(F.col("year") == y)
        return some.groupBy(municipality).agg(F.sum("people").alias(name))

    out = people(chosen, "value").where("value > 0")
    if base is not None and base in years:
        out = out.join(people(base, "before").where("before > 0"), "municipality").select("municipality", F.round(F.col("value") / F.col("before"), 4).alias("value"))
    return out.withColumn("effective_year", F.lit(chosen).cast("int"))


def census(spark: SparkSession, path: str, *, sep: str = ",", encoding: str = "UTF-8", counts: tuple[str, ...] = ("pobtot", "pocupada"), municipalities: list[str] | None = None) -> DataFrame:
    """Census rows with padded keys (ent, mun, loc, ageb, mza, municipality) and each count with the token that stood in for it; a path that ends with .xlsx is a workbook."""
    if path.lower().endswith(".xlsx"):
        r = headed(file_rows(spark, path), ["ENTIDAD", "MUN"], within=12)
        df = r.select(*[F.try_element_at("r", F.lit(c.upper())).alias(c) for c in ("entidad", "mun", "loc", "ageb", "mza", *counts)])
    else:
        df = spark.read.option("header", True).option("sep", sep).option("encoding", encoding).csv(path)
        df = df.toDF(*[c.strip().lower().lstrip("\ufeff") for c in df.columns])
    keys = [F.lpad(F.trim("entidad"), 2, "0").alias("ent"), F.lpad(F.trim("mun"), 3, "0").alias("mun"), S.geo_code(F.col("loc"), 4).alias("loc"), S.geo_code(F.col("ageb"), 4).alias("ageb"), S.geo_code(F.col("mza"), 3).alias("mza")]
    out = []
    for c in counts:
        token = F.upper(F.trim(F.coalesce(F.col(c), F.lit(""))))
        out += [F.when(~token.isin(*MISSING), token.try_cast("double")).alias(c), F.when(token.isin(*MISSING), token).otherwise("").alias(f"{c}_status")]
    rows = df.select(*keys, *out).withColumn("municipality", F.concat("ent", "mun"))
    return rows.where(F.col("municipality").isin(*municipalities)) if municipalities else rows


# What a suppressed count of people, and of those from 15 years on, stands for; bounds of growth and of what is taken for a ratio.
SUPPRESSED_PEOPLE, SUPPRESSED_ADULTS = 1.5, 1.0
GROWTH, RATIO = (0.90, 1.60), (0.70, 2.50)


def populated_blocks(rows: DataFrame, people: str = "pobtot", adults: str = "p_15ymas") -> DataFrame:
    """Block rows of census() with people: suppressed counts estimated, other gaps and impossible values zero, no more adults than people.

    A block is a number above zero: a suppressed block code never passes for one.
    """

    def value(c: str, stand_in: float) -> Column:
        finite = F.when(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")), F.greatest(F.col(c), F.lit(0.0))).otherwise(0.0)
        return F.when(F.col(f"{c}_status") == "*", stand_in).otherwise(finite)

    out = rows.withColumns({people: value(people, SUPPRESSED_PEOPLE), adults: value(adults, SUPPRESSED_ADULTS)})
    return out.withColumn(adults, F.least(adults, people)).where((F.coalesce(F.col("mza").try_cast("int"), F.lit(0)) > 0) & (F.col(people) > 0))


def growth_factors(projected: DataFrame, blocks: DataFrame, people: str = "pobtot") -> DataFrame:
    """(municipality, growth): a projected value near one is the ratio itself, a larger one is divided by the people of the blocks; bounded, to four places."""
    totals = blocks.groupBy("municipality").agg(F.sum(people).alias("_people"))
    ratio = F.when(F.col("value").between(*RATIO), F.col("value")).when(F.col("_people") > 0, F.col("value") / F.col("_people"))
    bounded = F.bround(F.least(F.greatest(ratio, F.lit(GROWTH[0])), F.lit(GROWTH[1])), 4)
    return projected.join(totals, "municipality", "left").select("municipality", F.when(ratio.isNotNull(), bounded).alias("growth")).where("growth IS NOT NULL")


def invalid_counts(rows: DataFrame, counts: list[str]) -> DataFrame:
    """Rows of census() with a count that is neither a known token nor a whole number from 0 on."""
    bad = F.lit(False)
    for c in counts:
        bad |= (F.col(c).isNull() & (F.col(f"{c}_status") == "")) | (F.col(c) < 0) | (F.col(c) != F.floor(c)) | (F.abs(c) == float("inf"))
    return rows.where(bad)


def is_zero(c: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(c), F.lit("")), "^0+", "") == ""


def municipal_totals(rows: DataFrame, value: str) -> DataFrame:
    """(municipality, value): rows whose locality, area and block are zero; a municipality with several different values is a conflict (see relational.conflicts)."""
    whole = rows.where(is_zero("loc") & is_zero("ageb") & is_zero("mza") & ~is_zero("mun") & (F.col(value) > 0))
    return whole.groupBy("municipality").agg(F.max(value).alias(value))


def employed_census(rows: DataFrame, counts: list[str]) -> tuple[DataFrame, DataFrame]:
    """(blocks, conflicts): block rows once each; a block given twice with different counts or tokens is a conflict."""
    blocks = rows.where(~is_zero("mza"))
    keys = ["municipality", "loc", "ageb", "mza"]
    fields = [x for c in counts for x in (c, f"{c}_status")]
    return blocks.select(*keys, *fields).distinct(), ledger_conflicts(blocks, [F.struct(*keys)], fields)


def participation_rate(rows: DataFrame, active: str, eligible: str) -> DataFrame:
    """One row: the active among the eligible over municipal rows (locality zero), to four places."""
    some = rows.where(is_zero("loc") & ~is_zero("mun") & (F.col(eligible) > 0) & F.col(active).isNotNull())
    return some.agg(F.round(F.sum(active) / F.sum(eligible), 4).alias("rate"))


def people(spark: SparkSession, path: str, municipalities: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(totals, conflicts) of person microdata: weighted population, occupied, commuters, no_travel, unspecified by municipality.

    A person (state and id) given twice alike counts once; given twice in different
    ways is a conflict. Occupied: 12 to 130 years and activity 10 to 20; of these,
    travel codes 1 to 6 commute, 7 does not travel, 9 is unspecified.
    """
    df = spark.read.option("header", True).csv(path)
    df = df.select(*[F.trim(c).alias(c.lower()) for c in ("CVEGEO", "ID_PERSONA", "EDAD", "CONACT", "TIE_TRASLADO_TRAB", "FACTOR")])
    df = df.withColumn("municipality", F.lpad("cvegeo", 5, "0")).withColumn("state", F.substring("municipality", 1, 2))
    df = df.where(F.col("municipality").isin(*municipalities)) if municipalities else df
    values = ["municipality", "edad", "conact", "tie_traslado_trab", "factor"]
    once = df.select("state", "id_persona", *values).distinct()
    conflicts = once.groupBy("state", "id_persona").agg(F.count("*").alias("values")).where("values > 1")
    w = F.col("factor").cast("double")
    occupied = F.col("edad").cast("double").between(12, 130) & F.col("conact").try_cast("double").between(10, 20)
    travel = F.col("tie_traslado_trab").try_cast("double")
    part = lambda test: F.sum(F.when(test, w).otherwise(0.0))
    totals = once.groupBy("municipality").agg(F.sum(w).alias("population"), part(occupied).alias("occupied"), part(occupied & (travel <= 6)).alias("commuters"), part(occupied & (travel == 7)).alias("no_travel"), part(occupied & (travel == 9)).alias("unspecified"))
    return totals, conflicts


def estimator_controls(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(controls, faults) of survey controls in rows of estimators: one row a municipality with value, low, high and cv of both counts.

    A fault is a municipality that lacks an estimator, whose occupied exceed the
    population, whose interval does not hold the value, or whose positive value has no precision.
    """
    code = F.concat(F.lpad("cve_ent", 2, "0"), F.lpad("cve_mun", 3, "0"))
    rows = df.where(F.lpad("cve_loc", 4, "0") == "0000").select(code.alias("municipality"), F.col("estimador").alias("e"), *[F.col(c).try_cast("double").alias(c) for c in ("pobtot", "pocupada")])
    wide = rows.groupBy("municipality").pivot("e", list(ESTIMATORS)).agg(F.first("pobtot", True).alias("pobtot"), F.first("pocupada", True).alias("pocupada"))
    short = {"value": ESTIMATORS[0], "error": ESTIMATORS[1], "low": ESTIMATORS[2], "high": ESTIMATORS[3], "cv": ESTIMATORS[4]}
    wide = wide.select("municipality", *[F.col(f"`{long}_{c}`").alias(f"{c}_{s}") for s, long in short.items() for c in ("pobtot", "pocupada")])
    bad = F.col("pocupada_value") > F.col("pobtot_value")
    for c in ("pobtot", "pocupada"):
        v = F.col(f"{c}_value")
        bad = bad | v.isNull() | F.col(f"{c}_low").isNull() | F.col(f"{c}_high").isNull() | F.col(f"{c}_error").isNull() | ~v.between(F.col(f"{c}_low"), F.col(f"{c}_high")) | ((v > 0) & F.col(f"{c}_cv").isNull())
    return wide, wide.where(bad)


def establishments(frames: list[DataFrame], *, bbox: tuple[float, float, float, float] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, municipal totals, conflicts) of establishment tables: alias columns resolved, each record once, then the box.

    Totals are taken before the box, so that a municipality's share inside it is
    known. Without a box every record stays (full scope). An unknown size band is the smallest.
    """
    aliases = {"id": ["id"], "clee": ["clee"], "name": ["nom_estab", "nombre"], "lat": ["latitud", "lat"], "lon": ["longitud", "lon"], "cve_ent": ["cve_ent"], "cve_mun": ["cve_mun"], "band": ["per_ocu", "personal_ocupado"], "activity": ["codigo_act"], "ageb": ["ageb"], "block": ["manzana"]}
    from terrane.sources.readers import with_aliases

    rows = None
    for k, df in enumerate(frames):
        one = with_aliases(df, aliases).withColumn("_file", F.lit(k))
        rows = one if rows is None else rows.unionByName(one)
    bounds = S.band_bounds(F.regexp_replace("band", " ", " "))
    rows = rows.select(
        "id",
        "clee",
        "name",
        F.col("lat").try_cast("double").alias("lat"),
        F.col("lon").try_cast("double").alias("lon"),
        S.municipality_code(F.col("cve_mun"), F.col("cve_ent")).alias("municipality"),
        F.coalesce(bounds["prior"], F.lit(S.BANDS[0][3])).alias("jobs"),
        F.coalesce(bounds["hi"] <= 50, F.lit(True)).alias("is_micro"),
        "band",
        "activity",
        F.when(F.col("ageb").isNull(), "0000").otherwise(F.lpad(F.regexp_replace(F.upper("ageb"), "-", ""), 4, "0")).alias("ageb"),
        F.coalesce(F.col("block").try_cast("double").cast("int").cast("string"), F.lit("-1")).alias("block"),
        F.struct("_file", F.monotonically_increasing_id()).alias("_at"),
    )
    payload = ["municipality", "jobs", "is_micro", "lat", "lon", "ageb", "block"]
    known = [F.when(~F.upper(F.trim(a)).isin("", "NAN", "NONE", "N/D", "-1", "0"), F.upper(F.trim(a))) for a in ("clee", "id")]
    rows = rows.withColumns({"_clee": known[0], "_id": known[1]})
    clashes = ledger_conflicts(rows, [F.col("_clee"), F.col("_id")], payload)
    rows = ledger(rows, ["_clee", "_id"], "_at").drop("_clee", "_id", "_at")
    totals = rows.where("municipality <> '-1'").groupBy("municipality").agg(F.sum("jobs").alias("jobs"))
    if bbox:
        rows = rows.where(F.col("lon").between(bbox[0], bbox[2]) & F.col("lat").between(bbox[1], bbox[3]))
    return rows, totals, clashes


def settlement_rows(df: DataFrame, bbox: tuple[float, float, float, float], order: str) -> DataFrame:
    """Establishments as witnesses of place names: inside the box, one for each clee, else for each state and id; rows without either stay."""
    from terrane.sources.readers import with_aliases

    aliases = {c: [c] for c in ("id", "clee", "cve_ent", "cve_mun", "cve_loc", "localidad", "municipio", order)} | {"lat": ["latitud"], "lon": ["longitud"], "settlement": ["nomb_asent", "asentamiento"], "kind": ["tipo_asent", "tipo_asentamiento"]}
    rows = with_aliases(df, aliases).withColumns({"lat": F.col("lat").try_cast("double"), "lon": F.col("lon").try_cast("double")})
    rows = rows.where(F.col("lon").between(bbox[0], bbox[2]) & F.col("lat").between(bbox[1], bbox[3]))
    key = F.when(F.col("clee").isNotNull(), F.concat(F.lit("clee:"), "clee")).when(F.col("id").isNotNull(), F.concat_ws(":", F.lit("id"), F.coalesce("cve_ent", F.lit("")), "id"))
    rows = rows.withColumn("_key", F.coalesce(key, F.concat(F.lit("row:"), F.col(order).cast("string"))))
    return keep_first(rows, ["_key"], [F.col(order).cast("long")]).drop("_key")
