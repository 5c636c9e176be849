"""Codes, names and numbers as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented letters and their plain forms (ñ stays in name keys).
ACCENTED, PLAIN = "áàâäãåéèêëíìîïóòôöõúùûüçÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÇ", "aaaaaaeeeeiiiiooooouuuucAAAAAAEEEEIIIIOOOOOUUUUC"
# Size bands of establishments as (label, lower, upper, prior).
BANDS = (
    ("0 a 5 personas", 0, 5, 2.24),
    ("6 a 10 personas", 6, 10, 7.75),
    ("11 a 30 personas", 11, 30, 18.17),
    ("31 a 50 personas", 31, 50, 39.37),
    ("51 a 100 personas", 51, 100, 71.41),
    ("101 a 250 personas", 101, 250, 158.11),
    ("251 y más personas", 251, None, 450.0),
)


def fold_accents(c: Column) -> Column:
    return F.translate(c, ACCENTED, PLAIN)


def bare_code(c: Column) -> Column:
    """Upper case, no blanks, no trailing `.0` that a number format left."""
    return F.regexp_replace(F.upper(F.trim(c.cast("string"))), r"\.0$", "")


def geo_code(c: Column, width: int) -> Column:
    """Zero-padded code of letters and digits; null when empty, too long or of other characters."""
    code = bare_code(c)
    return F.when(code.rlike("^[0-9A-Z]+$") & (F.length(code) <= width), F.lpad(code, width, "0"))


def municipality_code(mun: Column, state: Column) -> Column:
    """Five digits, state then municipality; '-1' when neither form is valid."""
    m, e = bare_code(mun), bare_code(state)
    whole = F.when(m.rlike("^[0-9]{4,5}$"), F.lpad(m, 5, "0"))
    parts = F.when(m.rlike("^[0-9]{1,3}$") & e.rlike("^[0-9]{1,2}$"), F.concat(F.lpad(e, 2, "0"), F.lpad(m, 3, "0")))
    code = F.coalesce(whole, parts)
    state_ok = F.substring(code, 1, 2).cast("int").between(1, 32) & (F.substring(code, 3, 3).cast("int") >= 1)
    return F.when(state_ok, code).otherwise(F.lit("-1"))


def normal_text(c: Column) -> Column:
    """Upper case without accents, blanks collapsed."""
    return F.trim(F.regexp_replace(F.upper(fold_accents(F.translate(c, "ñÑ", "nN"))), " +", " "))


# The words and abbreviations that name kinds of settlement in front of a place's own name.
BLOCK_WORDS = ("super manzana", "s. m.")
REGION_WORDS = ("region", "reg.")
DROPPED_WORDS = ("colonia", "col.", "fraccionamiento", "fracc.")


def leading(words: tuple[str, ...], glued: bool) -> str:
    """A pattern for one of the words in front, dots and blanks of abbreviations at will; what follows is white space or, if glued, a digit or the end too."""
    some = "|".join(w.replace(".", "[.]?").replace(" ", r"\s*") for w in words)
    return f"^({some})" + (r"(?=[0-9\s]|$)\s*" if glued else r"\s+")


def place_key(c: Column) -> Column:
    """Comparable form of a place name: lower, accents folded (ñ kept), block and region words unified, kinds of settlement dropped, letters and digits only.

    A bare number, with a letter perhaps, is a block's.
    """
    s = F.trim(F.lower(fold_accents(c)))
    s = F.regexp_replace(s, leading(BLOCK_WORDS, True), "supermanzana ")
    s = F.regexp_replace(s, leading(REGION_WORDS, True), "region ")
    s = F.trim(F.regexp_replace(s, leading(DROPPED_WORDS, False), ""))
    s = F.when(s.rlike("^[0-9]+[a-z]?$"), F.concat(F.lit("supermanzana "), s)).otherwise(s)
    return F.regexp_replace(s, r"[^\p{L}\p{N}]", "")


def number_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("([0-9]+[a-z]?)"), F.lit(1))


def title_case(c: Column, small: tuple[str, ...] = ("de", "del", "la", "las", "los", "el", "y", "en")) -> Column:
    """Each word with a capital, small words lower except in front; words with digits and Roman numerals upper."""
    words = F.split(F.trim(F.regexp_replace(F.lower(c), " +", " ")), " ")

    def word(w: Column, i: Column) -> Column:
        return (
            F.when(w.rlike("^(i|ii|iii|iv|v|vi|vii|viii|ix|x)$") | w.rlike("[0-9]"), F.upper(w))
            .when((i > 0) & w.isin(*small), w)
            .otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, F.length(w))))
        )

    return F.array_join(F.transform(words, word), " ")


def band_bounds(label: Column) -> Column:
    """struct(lo, hi, prior) of a size band; hi is infinite for the open one, null for an unknown label."""
    key = normal_text(label)
    out = None
    for name, lo, hi, prior in BANDS:
        row = F.struct(F.lit(float(lo)).alias("lo"), F.lit(float("inf") if hi is None else float(hi)).alias("hi"), F.lit(prior).alias("prior"))
        test = key == normal_text(F.lit(name))
        out = F.when(test, row) if out is None else out.when(test, row)
    return out


def activity_code(c: Column) -> Column:
    """The leading industry code of a label: 2 to 6 digits, or the ranges 31-33, 48-49."""
    code = F.regexp_extract(F.trim(c), "^(31-33|48-49|[0-9]{2,6})( |$)", 1)
    return F.when(code != "", code)


# Labels of activity levels in tabulates with the length of their codes, totals without a code.
LEVEL_LABELS = {"SECTOR": None, "SUBSECTOR": 3, "RAMA": 4, "SUBRAMA": 5, "CLASE": 6}
TOTAL_LABELS = ("TOTAL MUNICIPAL", "TOTAL ESTATAL", "TOTAL NACIONAL")


def labelled_activity(c: Column) -> Column:
    """The code of a normal_text label such as `RAMA 3121 ...`; empty for a total, null if there is none or its length is not the level's."""
    level = F.element_at(F.split(c, " "), 1)
    code = activity_code(F.when(level.isin(*LEVEL_LABELS), F.substring(c, F.length(level) + 2, F.length(c))).otherwise(c))
    fits = F.lit(True)
    for name, n in LEVEL_LABELS.items():
        if n:
            fits &= (level != name) | (F.length(code) == n)
    return F.when(c.isin(*TOTAL_LABELS), "").when(fits, code)


def activity_level(code: Column) -> Column:
    names = {2: "sector", 3: "subsector", 4: "branch", 5: "subbranch", 6: "class"}
    out = F.when(code.isin("31-33", "48-49"), "sector")
    for n, name in names.items():
        out = out.when(F.length(code) == n, name)
    return out


def hash_bucket(key: Column, buckets: int = 10) -> Column:
    """The first 32 bits of SHA-256, modulo buckets."""
    return (F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long") % buckets).cast("long")


def hash_id(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def positive_or(c: Column, default: float) -> Column:
    """The number where it is finite and above zero."""
    return F.when((c > 0) & (c < float("inf")), c).otherwise(F.lit(default))


def half_up(c: Column) -> Column:
    return F.floor(c + 0.5)


def impedance_after(metres: Column) -> Column:
    """struct(distance, seconds) of a drive: 1.3 times the beeline, at least 150 m, at 40 km/h, at least 45 s."""
    d = F.greatest(metres * 1.3, F.lit(150.0))
    return F.struct(F.bround(d).cast("long").alias("distance"), F.greatest(F.bround(d / (40 / 3.6)).cast("long"), F.lit(45)).alias("seconds"))


def impedance_before(metres: Column) -> Column:
    """As impedance_after, but the beeline itself is at least 150 m."""
    d = F.greatest(metres, F.lit(150.0)) * 1.3
    return F.struct(F.bround(d).cast("long").alias("distance"), F.greatest(F.bround(d / (40 / 3.6)).cast("long"), F.lit(45)).alias("seconds"))


def driving_fallback(metres: Column) -> Column:
    """struct(distance, seconds) where no route is known: 1.3 times the beeline of at least 150 m, rounded, at 40 km/h, at least 45 s."""
    road = F.bround(F.greatest(metres, F.lit(150.0)) * 1.3)
    return F.struct(road.cast("long").alias("distance"), F.greatest(F.bround(road / (40 / 3.6)).cast("long"), F.lit(45)).alias("seconds"))


def friction(km: Column, beta: float, reach: Column, floor_km: float = 3.0, floor: float = 0.6) -> Column:
    """exp(-beta (1 - reach) d), with a floor for short trips."""
    base = F.exp(-beta * (1 - F.least(reach, F.lit(0.6))) * km)
    return F.when(km <= floor_km, F.greatest(base, F.lit(floor))).otherwise(base)


def change_status(before: Column, after: Column) -> Column:
    return F.when((before == 0) & (after == 0), "empty").when(before == 0, "new").when(before == after, "unchanged").otherwise("changed")


def normal_quantile(p: Column) -> Column:
    """Inverse of the standard normal distribution by the rational approximation of P. J. Acklam."""
    # Published coefficients.
    a = (-3.969683028665376e1, 2.209460984245205e2, -2.759285104469687e2, 1.383577518672690e2, -3.066479806614716e1, 2.506628277459239)
    b = (-5.447609879822406e1, 1.615858368580409e2, -1.556989798598866e2, 6.680131188771972e1, -1.328068155288572e1)
    c = (-7.784894002430293e-3, -3.223964580411365e-1, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
    d = (7.784695709041462e-3, 3.224671290700398e-1, 2.445134137142996, 3.754408661907416)

    def poly(ks: tuple, x: Column) -> Column:
        out = F.lit(ks[0])
        for k in ks[1:]:
            out = out * x + k
        return out

    low, r = F.sqrt(-2 * F.ln(p)), (p - 0.5) * (p - 0.5)
    high = F.sqrt(-2 * F.ln(1 - p))
    tail = lambda q: poly(c, q) / (poly(d, q) * q + 1)
    return F.when(p < 0.02425, tail(low)).when(p > 1 - 0.02425, -tail(high)).otherwise(poly(a, r) * (p - 0.5) / (poly(b, r) * r + 1))
