"""Identity, conflict and join operators with explicit null and tie rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.sources.scratch import settled


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in a total order; rows with a null key are one group each key combination."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def conflicts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys that carry more than one distinct value, with how many."""
    return df.groupBy(*keys).agg(F.countDistinct(value).alias("values")).where("values > 1")


def ledger(df: DataFrame, aliases: list[str], order: str) -> DataFrame:
    """Rows whose aliases are all new at their turn in `order`; rows without any alias always stay.

    A row stays when it is the first of every alias it has. `order` must be unique.
    First occurrences are aggregated before they are joined, so a common alias is
    no task of its own. Conflicting records are ledger_conflicts'.
    """
    held = [F.col(a).isNotNull().cast("int") for a in aliases]
    have, names = sum(held[1:], held[0]), F.array(*[F.struct(F.lit(i).alias("k"), F.col(a).cast("string").alias("v")) for i, a in enumerate(aliases)])
    firsts = df.select(F.col(order).alias("_o"), F.explode(names).alias("a")).where("a.v is not null").groupBy("a.k", "a.v").agg(F.min("_o").alias("_o"))
    count = firsts.groupBy("_o").agg(F.count("*").alias("_n"))
    out = df.withColumn("_have", have).join(count, F.col(order) == F.col("_o"), "left")
    return out.where(F.col("_have") == F.coalesce("_n", F.lit(0))).select(*df.columns)


def ledger_conflicts(df: DataFrame, aliases: list[Column], payload: list[str]) -> DataFrame:
    """Aliases (k, alias, values) under which records differ in their payload; a source that has any must be refused."""
    names = F.array(*[F.struct(F.lit(i).alias("k"), F.to_json(F.struct(a.alias("a"))).alias("v"), a.isNotNull().alias("on")) for i, a in enumerate(aliases)])
    seen = df.select(F.explode(names).alias("a"), F.sha2(F.to_json(F.struct(*payload), {"ignoreNullFields": "false"}), 256).alias("p")).where("a.on")
    return seen.groupBy(F.col("a.k").alias("k"), F.col("a.v").alias("alias")).agg(F.countDistinct("p").alias("values")).where("values > 1")


def many_to_one(df: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """A left join that fails where the table has a key more than once."""
    once = table.groupBy(*keys).agg(F.count("*").alias("_n"), *[F.min(c).alias(c) for c in table.columns if c not in keys])
    checked = once.withColumn("_n", F.when(F.col("_n") > 1, F.raise_error(F.lit("a key of the right side is not unique"))).otherwise(F.lit(0)))
    return df.join(checked, keys, "left").where(F.coalesce("_n", F.lit(0)) == 0).drop("_n")


def same_or_unknown(keys: list[str], left: str = "l", right: str = "r") -> Column:
    """Equality of territories in which a null (or empty) key matches anything."""
    out = F.lit(True)
    for k in keys:
        a, b = F.col(f"{left}.{k}"), F.col(f"{right}.{k}")
        out &= F.coalesce(a.cast("string"), F.lit("")).eqNullSafe("") | F.coalesce(b.cast("string"), F.lit("")).eqNullSafe("") | (a == b)
    return out


def overlapping_prefixes(df: DataFrame, group: str, prefix: str, longest: int = 6) -> DataFrame:
    """(group, prefix, other): prefixes of one group of which one begins another; an equi join on the group and the shorter prefix."""
    long = df.select(group, F.col(prefix).alias("other"), F.explode(F.sequence(F.lit(0), F.least(F.length(prefix), F.lit(longest)))).alias("_n"))
    long = long.select(group, "other", F.expr("substring(other, 1, _n)").alias(prefix)).where(F.col(prefix) != F.col("other"))
    return df.select(group, prefix).join(long, [group, prefix])


def nearest(points: DataFrame, targets: DataFrame, *, start: float, target: str = "target") -> DataFrame:
    """(id, target, distance): each point's nearest target however far, by cells whose size doubles for the points still without one.

    A hit within one cell size is the nearest; others go on to the next, larger
    cells. points: (id, x, y); targets: (target, tx, ty), not empty. Points without
    finite coordinates get none.
    """
    radius, open_, out = start, points.where(F.abs("x") + F.abs("y") < float("inf")), None
    span = targets.agg(F.min("tx"), F.max("tx"), F.min("ty"), F.max("ty")).first()
    reach = open_.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if span[0] is None or reach[0] is None:
        return nearest_within(points, targets, start, target=target)
    widest = max(abs(a - b) for k in (0, 2) for a in (span[k], span[k + 1]) for b in (reach[k], reach[k + 1])) * 1.5 + start
    while True:
        found = settled(nearest_within(open_, targets, radius, target=target))
        out = found.where(F.col(target).isNotNull()) if out is None else out.unionByName(found.where(F.col(target).isNotNull()))
        if radius >= widest:
            return out
        radius *= 4
        open_ = open_.join(out.select("id"), "id", "left_anti")


def nearest_line(points: DataFrame, segments: DataFrame, reach: float) -> DataFrame:
    """(id, segment, distance, x, y): the nearest segment within reach and the point's foot on it.

    segments: (segment, ax, ay, bx, by) in the points' metric plane. A segment is
    dealt to the cells that its box, widened by reach, touches; cells have the size
    of reach, so long segments should be cut before. Every place is looked up once.
    """
    lo = lambda a, b: F.floor((F.least(a, b) - reach) / reach).cast("long")
    hi = lambda a, b: F.floor((F.greatest(a, b) + reach) / reach).cast("long")
    cells = segments.withColumn("cx", F.explode(F.sequence(lo("ax", "bx"), hi("ax", "bx")))).withColumn("cy", F.explode(F.sequence(lo("ay", "by"), hi("ay", "by"))))
    spots = points.select(F.col("x").alias("px"), F.col("y").alias("py")).where("px is not null and py is not null").distinct()
    placed = spots.withColumns({"cx": F.floor(F.col("px") / reach).cast("long"), "cy": F.floor(F.col("py") / reach).cast("long")})
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    n = dx * dx + dy * dy
    t = F.when(n > 0, F.least(F.greatest(((F.col("px") - F.col("ax")) * dx + (F.col("py") - F.col("ay")) * dy) / n, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))
    hit = placed.join(cells, ["cx", "cy"]).withColumns({"x": F.col("ax") + t * dx, "y": F.col("ay") + t * dy})
    hit = hit.withColumn("distance", F.sqrt(F.pow(F.col("px") - F.col("x"), 2) + F.pow(F.col("py") - F.col("y"), 2))).where(F.col("distance") <= reach)
    best = hit.groupBy("px", "py").agg(F.min(F.struct("distance", "segment", "x", "y")).alias("b"))
    at = points.select("id", F.col("x").alias("px"), F.col("y").alias("py"))
    return at.join(best, ["px", "py"]).select("id", "b.segment", "b.distance", "b.x", "b.y")


def walk_hierarchy(nodes: DataFrame, roots: DataFrame, depth: int = 6) -> DataFrame:
    """(code, root, level): nodes reached from the roots, each child's code an extension of its parent's; (code, parent) rows, level 0 for roots."""
    level = roots.select("code", F.col("code").alias("root"), F.lit(0).alias("level"))
    out = level
    for n in range(1, depth + 1):
        above = level.select(F.col("code").alias("parent"), "root")
        level = nodes.join(above, "parent").where(F.col("code").startswith(F.col("parent")) & (F.length("code") > F.length("parent"))).select("code", "root", F.lit(n).alias("level"))
        out = out.unionByName(level)
    return out


def without_conflicts(df: DataFrame, key: str, values: list[str]) -> DataFrame:
    """One row for each key whose rows agree; keys with contradictory editions are left out altogether."""
    s = df.groupBy(key).agg(F.countDistinct(F.struct(*values)).alias("_n"), *[F.min(v).alias(v) for v in values])
    return s.where("_n = 1").drop("_n")


def most_common(df: DataFrame, value: str, k: int = 20) -> DataFrame:
    """The k most frequent values with their counts, ties to the smaller value."""
    return df.groupBy(value).agg(F.count("*").alias("n")).orderBy(F.desc("n"), value).limit(k)


def cascade(df: DataFrame, tables: list[tuple[str, DataFrame, list[str]]], fields: list[str]) -> DataFrame:
    """Left joins in order of priority; all `fields` come from the first table that has the key and no null among them.

    tables: (label, table, keys); each table has one row per key. Adds the fields and `provenance`.
    """
    picks, out = [], df
    for label, table, keys in tables:
        s = F.struct(*[F.col(f) for f in fields], F.lit(label).alias("provenance"))
        whole = F.lit(True)
        for f in fields:
            whole &= F.col(f).isNotNull()
        out = out.join(table.select(*keys, F.when(whole, s).alias(f"_{label}")), keys, "left")
        picks.append(F.col(f"_{label}"))
    pick = F.coalesce(*picks)
    return out.select(*df.columns, *[pick[f].alias(f) for f in fields], pick["provenance"].alias("provenance"))


def guarded(df: DataFrame, table: DataFrame, key: str, full_key: str, fields: list[str]) -> DataFrame:
    """Join on a short key only where it names one full key in the table; others keep nulls."""
    unique = table.groupBy(key).agg(F.countDistinct(full_key).alias("_n"), *[F.min(f).alias(f) for f in fields]).where("_n = 1")
    return df.join(unique.drop("_n"), key, "left")


def anti_ambiguous(df: DataFrame, table: DataFrame, key: str, full_key: str) -> DataFrame:
    """Rows whose key does not name several full keys in the table."""
    many = table.groupBy(key).agg(F.countDistinct(full_key).alias("_n")).where("_n > 1").select(key)
    return df.join(many, key, "left_anti")


def gained_lost(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    gained = new.select(*keys).distinct().join(old, keys, "left_anti").withColumn("change", F.lit("gained"))
    lost = old.select(*keys).distinct().join(new, keys, "left_anti").withColumn("change", F.lit("lost"))
    return gained.unionByName(lost)


def longest_prefix(df: DataFrame, code: str, nodes: DataFrame, node: str, lengths: range) -> DataFrame:
    """The deepest node that is a prefix of the code, by one equi join for each length; null without one."""
    exploded = df.select(code).distinct().withColumn("_n", F.explode(F.array(*[F.lit(n) for n in lengths])))
    exploded = exploded.withColumn("_p", F.expr(f"substring({code}, 1, _n)")).where(F.length("_p") == F.col("_n"))
    hit = exploded.join(nodes.select(F.col(node).alias("_p")), "_p").groupBy(code).agg(F.max_by("_p", "_n").alias(node))
    return df.join(hit, code, "left")


def nearest_within(points: DataFrame, targets: DataFrame, radius: float, *, point: str = "id", target: str = "target") -> DataFrame:
    """Each point with its nearest target within `radius` (planar, same unit), ties to the smaller target; null without one.

    points: (id, x, y); targets: (target, tx, ty). Targets are dealt to the 3 x 3
    cells around their own, so the join is an equi join on cells. Every place is looked
    up once, and of the targets of one place only the smallest is.
    """
    cells = F.array(*[F.struct((F.floor(F.col("tx") / radius) + i).alias("cx"), (F.floor(F.col("ty") / radius) + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    around = targets.groupBy("tx", "ty").agg(F.min(target).alias(target)).withColumn("_c", F.explode(cells)).select("*", "_c.cx", "_c.cy").drop("_c")
    placed = points.select("x", "y").distinct().withColumn("cx", F.floor(F.col("x") / radius)).withColumn("cy", F.floor(F.col("y") / radius))
    d2 = F.pow(F.col("tx") - F.col("x"), 2) + F.pow(F.col("ty") - F.col("y"), 2)
    hit = placed.join(around, ["cx", "cy"]).withColumn("_d2", d2).where(F.col("_d2") <= radius * radius)
    best = hit.groupBy("x", "y").agg(F.min(F.struct("_d2", target)).alias("_b")).select("x", "y", F.col(f"_b.{target}").alias(target), F.sqrt("_b._d2").alias("distance"))
    return points.select(point, "x", "y").join(best, ["x", "y"], "left").select(point, target, "distance")


def places_of(points: DataFrame, order: Column | None = None) -> DataFrame:
    """(id, x, y, place): every point with the point that stands for its place, the first by `order` (by default the smallest id); without finite coordinates it stands for itself."""
    first = points.where(F.abs("x") + F.abs("y") < float("inf")).groupBy("x", "y").agg((F.min("id") if order is None else F.min_by("id", order)).alias("place"))
    return points.select("id", "x", "y").join(first, ["x", "y"], "left").withColumn("place", F.coalesce("place", "id"))


def pairs_within(points: DataFrame, radius: float, digits: int | None = None) -> DataFrame:
    """Pairs (a, b, distance), a < b, of points (id, x, y) within the radius, each once, by cells; distances rounded to `digits`, if given.

    Places are compared, not points: a distance is computed once for the points of two places.
    """
    left = points.select(F.col("x").alias("ax"), F.col("y").alias("ay")).distinct()
    left = left.withColumn("cx", F.floor(F.col("ax") / radius)).withColumn("cy", F.floor(F.col("ay") / radius))
    cells = F.array(*[F.struct((F.floor(F.col("x") / radius) + i).alias("cx"), (F.floor(F.col("y") / radius) + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    right = points.select("x", "y").distinct().withColumn("_c", F.explode(cells)).select(F.col("x").alias("bx"), F.col("y").alias("by"), "_c.cx", "_c.cy")
    d = F.sqrt(F.pow(F.col("ax") - F.col("bx"), 2) + F.pow(F.col("ay") - F.col("by"), 2))
    near = left.join(right, ["cx", "cy"]).withColumn("distance", d).where(F.col("distance") <= radius)
    near = near.select("ax", "ay", "bx", "by", "distance" if digits is None else F.round("distance", digits).alias("distance"))
    member = lambda k: points.select(F.col("id").alias(k), F.col("x").alias(f"{k}x"), F.col("y").alias(f"{k}y"))
    return near.join(member("a"), ["ax", "ay"]).join(member("b"), ["bx", "by"]).where("a < b").select("a", "b", "distance")


def merge_one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs (left_id, right_id, rule) that match by some key, each side once; the first key that gives a pair names the rule.

    A key's rows are counted before anything is paired: a side that meets several is
    ambiguous whoever they are, so pairs are only made where the other side is one row.
    """
    sides: list = [None, None]
    for n, k in enumerate(keys):
        counts = [df.where(F.col(k).isNotNull()).groupBy(F.col(k).alias("_k")).agg(F.count("*").alias(c), F.min("id").alias(o)) for df, c, o in ((left, "_l", "_lo"), (right, "_r", "_ro"))]
        groups = counts[0].join(counts[1], "_k")
        for s, (df, other, partner) in enumerate(((left, "_r", "_ro"), (right, "_l", "_lo"))):
            rows = df.select("id", F.col(k).alias("_k")).join(groups, "_k").select("id", F.when(F.col(other) == 1, F.col(partner)).alias("p"), (F.col(other) > 1).alias("many"), F.lit(n).alias("n"), F.lit(k).alias("rule"))
            sides[s] = rows if sides[s] is None else sides[s].unionByName(rows)
    single = [s.groupBy("id").agg(F.max("many").alias("many"), F.min("p").alias("p"), F.max("p").alias("q"), F.min_by("rule", "n").alias("rule")).where("not many and p = q") for s in sides]
    l, r = (x.select(F.col("id").alias(a), F.col("p").alias(b), "rule") for x, a, b in ((single[0], "left_id", "right_id"), (single[1], "right_id", "left_id")))
    return l.join(r.drop("rule"), ["left_id", "right_id"])


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows with how often more they are in a (positive) or in b (negative)."""
    both = a.withColumn("_s", F.lit(1)).unionByName(b.withColumn("_s", F.lit(-1)))
    return both.groupBy(*a.columns).agg(F.sum("_s").alias("surplus")).where("surplus <> 0")


def dangling(edges: DataFrame, column: str, points: DataFrame, key: str) -> DataFrame:
    """Edges whose end is missing among the points."""
    return edges.join(points.select(F.col(key).alias(column)), column, "left_anti")
