"""Tables of polygons: joins with points, overlay, buffers, simplification, hulls.

A polygon is a column `rings`, array<array<struct<x, y>>>: every ring of every part,
holes too, not closed; what an odd number of rings surrounds belongs to it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions import geo as G

RINGS = "array<array<struct<x: double, y: double>>>"
ACROSS = 8  # cells along the longer side of a polygon's box


def cover(polygons: DataFrame, key: str, border: float = 0.0) -> DataFrame:
    """(key, level, i, j, inside, sides): the cells of each polygon, of side 2^level, a size of its own, so that a polygon has about ACROSS^2 at most.

    Cells that a side touches (or comes within `border` of) carry the sides that meet
    their row; the others lie inside as a whole and carry none.
    """
    s = polygons.select(F.col(key).alias("key"), G.sides(F.col("rings")).alias("s")).where(F.size("s") > 0)
    ends = lambda a, b, least: (F.array_min if least else F.array_max)(F.transform("s", lambda t: (F.least if least else F.greatest)(t[a], t[b])))
    extent = F.greatest(ends("ax", "bx", False) - ends("ax", "bx", True), ends("ay", "by", False) - ends("ay", "by", True), F.lit(1e-9))
    s = s.withColumn("level", F.ceil(F.log2(extent / ACROSS)).cast("int")).withColumn("size", F.pow(F.lit(2.0), F.col("level")))
    row = lambda y: F.floor(y / F.col("size"))
    s = s.select("key", "level", "size", F.explode("s").alias("t"))
    s = s.withColumn("j", F.explode(F.sequence(row(F.least("t.ay", "t.by") - border), row(F.greatest("t.ay", "t.by") + border))))
    low, high = F.col("j") * F.col("size") - border, (F.col("j") + 1) * F.col("size") + border
    at = lambda y: G.side_x(F.col("t"), F.least(F.greatest(y, F.least("t.ay", "t.by")), F.greatest("t.ay", "t.by")))
    flat = F.col("t.ay") == F.col("t.by")
    xs = [F.when(flat, F.col("t.ax")).otherwise(at(low)), F.when(flat, F.col("t.bx")).otherwise(at(high))]
    touched = F.sequence(row(F.least(*xs) - border), row(F.greatest(*xs) + border))
    bands = s.groupBy("key", "level", "size", "j").agg(F.collect_list("t").alias("sides"), F.array_distinct(F.flatten(F.collect_list(touched))).alias("touched"))
    middle = (F.col("j") + 0.5) * F.col("size")
    cuts = F.array_sort(F.transform(F.filter("sides", lambda t: (t["ay"] > middle) != (t["by"] > middle)), lambda t: G.side_x(t, middle)))
    centre = lambda x: x / F.col("size") - 0.5
    spans = F.transform(F.sequence(F.lit(0), F.size(cuts) - 2, F.lit(2)), lambda k: F.struct(F.ceil(centre(F.get(cuts, k))).alias("a"), F.floor(centre(F.get(cuts, k + 1))).alias("b")))
    within = F.flatten(F.transform(F.filter(spans, lambda p: p["a"] <= p["b"]), lambda p: F.sequence(p["a"], p["b"])))
    within = F.array_except(F.when(F.size(cuts) >= 2, within).otherwise(F.array().cast("array<bigint>")), F.col("touched"))
    cell = lambda cells, inside: F.transform(cells, lambda i: F.struct(i.alias("i"), F.lit(inside).alias("inside")))
    out = bands.select("key", "level", "j", "sides", F.explode(F.concat(cell(F.col("touched"), False), cell(within, True))).alias("c"))
    return out.select(F.col("key").alias(key), "level", F.col("c.i").alias("i"), "j", F.col("c.inside").alias("inside"), F.when(~F.col("c.inside"), F.col("sides")).alias("sides"))


def join_points(points: DataFrame, polygons: DataFrame, key: str, x: str = "x", y: str = "y", border: float = 0.0) -> DataFrame:
    """Every point with the key of every polygon that covers it; within `border` of a side counts as covered.

    An equality join on cells; sides are tested in the cells they touch alone. A point
    is looked up once for each size of cells in use, a few dozen at most.
    """
    cells = cover(polygons, key, border)
    levels = [r["level"] for r in cells.select("level").distinct().collect()]
    if not levels:
        return points.withColumn(key, F.lit(None).cast(polygons.schema[key].dataType)).limit(0)
    at = F.explode(F.array(*[F.lit(v) for v in sorted(levels)]))
    floor = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("_level")))
    looked_up = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("_level", at).withColumns({"_i": floor(x), "_j": floor(y)})
    cells = cells.toDF(key, "_level", "_i", "_j", "_inside", "_sides")
    found = looked_up.join(cells, ["_level", "_i", "_j"]).where(F.col("_inside") | G.sides_cover(F.col("_sides"), F.col(x), F.col(y), border))
    return found.select(*points.columns, key)


def label_points(points: DataFrame, polygons: DataFrame, id_col: str, key: str, pick: Callable[[str], Column] = F.max, border: float = 0.0) -> DataFrame:
    """(id, key) of every point: of the polygons that cover it the one that `pick` chooses (the last by default), null where there is none. Every place is looked up once, however many points it has."""
    found = join_points(points.select("x", "y").distinct(), polygons, key, border=border).groupBy("x", "y").agg(pick(key).alias(key))
    return points.select(id_col, "x", "y").join(found.toDF("x", "y", key), ["x", "y"], "left").select(id_col, key)


def outside(points: DataFrame, polygons: DataFrame, id_col: str, key: str, border: float = 0.0) -> DataFrame:
    """The points that no polygon covers."""
    covered = join_points(points.select("x", "y").distinct(), polygons, key, border=border).select("x", "y").distinct()
    return points.join(covered, ["x", "y"], "left_anti").select(*points.columns)


def sums_in(points: DataFrame, polygons: DataFrame, key: str, sums: list[str], border: float = 0.0) -> DataFrame:
    """(key, points, *sums): points and sums of columns in every polygon that covers any, summed by place before the join."""
    places = points.groupBy("x", "y").agg(F.count("*").alias("points"), *[F.sum(c).alias(c) for c in sums])
    return join_points(places, polygons, key, border=border).groupBy(key).agg(*[F.sum(c).alias(c) for c in ("points", *sums)])


# --- overlay ------------------------------------------------------------------

#: What belongs to a result: from the numbers of the shapes that are open at a place, and the number of shapes.
UNION = lambda held, n: F.size(held) > 0
INTERSECTION = lambda held, n: F.size(held) == n
DIFFERENCE = lambda held, n: F.array_contains(held, 0) & (F.size(held) == 1)  # noqa: E731  shape 0 without the others
EITHER = lambda held, n: F.size(held) % 2 == 1


def crossings(sides: DataFrame) -> DataFrame:
    """(group, y): where two sides of a group cross. Only sides that share a cell are compared; cells are as large as a group's mean side."""
    mean = F.avg(F.greatest(F.abs(F.col("bx") - F.col("ax")), F.col("by") - F.col("ay")))
    s = sides.join(sides.groupBy("group").agg(mean.alias("size")).hint("merge"), "group")
    row = lambda v: F.floor(v / F.col("size"))
    s = s.withColumn("j", F.explode(F.sequence(row(F.col("ay")), row(F.col("by")))))
    t = F.struct("ax", "ay", "bx", "by")
    low, high = (G.side_x(t, F.least(F.greatest(v, F.col("ay")), F.col("by"))) for v in (F.col("j") * F.col("size"), (F.col("j") + 1) * F.col("size")))
    s = s.withColumn("i", F.explode(F.sequence(row(F.least(low, high)), row(F.greatest(low, high))))).select("group", "i", "j", "number", t.alias("s"))
    p = s.join(s.select("group", "i", "j", F.col("number").alias("other"), F.col("s").alias("t")).hint("merge"), ["group", "i", "j"]).where("number < other")
    dx, dy = (lambda v: v["bx"] - v["ax"]), (lambda v: v["by"] - v["ay"])
    a, b = F.col("s"), F.col("t")
    turn = dx(a) * dy(b) - dy(a) * dx(b)
    share = lambda v: ((b["ax"] - a["ax"]) * dy(v) - (b["ay"] - a["ay"]) * dx(v)) / F.nullif(turn, F.lit(0.0))
    inner = lambda v: (v > 0) & (v < 1)
    return p.where(inner(share(b)) & inner(share(a))).select("group", (a["ay"] + share(b) * dy(a)).alias("y"))


def overlay(shapes: DataFrame, rule: Callable[[Column, Column], Column]) -> DataFrame:
    """From (group, shape from 0, rings): the part of the plane that `rule` picks in each group, as trapezoids (group, y0, y1, l0, l1, r0, r1).

    Horizontal slabs reach from one vertex or crossing of a group to the next, so no
    sides cross within one; in a slab the sides are walked from left to right. One
    task holds the sides of one slab, not those of a group. Touching, overlapping and
    self-crossing rings are fine; a single shape under UNION is repaired that way. The
    joins are merged: a table's size on disk says nothing of the sides and slabs that
    come of it, and a join that Spark takes for small would pass them through the driver.
    """
    s = shapes.select("group", "shape", F.explode(G.sides(F.col("rings"))).alias("t")).where("t.ay <> t.by")
    up = F.col("t.ay") < F.col("t.by")
    end = lambda a, b: F.when(up, F.col(f"t.{a}")).otherwise(F.col(f"t.{b}")) + F.lit(0.0)
    s = s.select("group", "shape", end("ax", "bx").alias("ax"), end("ay", "by").alias("ay"), end("bx", "ax").alias("bx"), end("by", "ay").alias("by"))
    s = s.withColumn("number", F.xxhash64("shape", "ax", "ay", "bx", "by"))
    levels = s.select("group", F.explode(F.array("ay", "by")).alias("y")).unionByName(crossings(s)).distinct().groupBy("group").agg(F.array_sort(F.collect_list("y")).alias("ys"))
    ys = levels.select("group", F.posexplode("ys").alias("k", "y"))
    slabs = ys.join(ys.select("group", (F.col("k") - 1).alias("k"), F.col("y").alias("above")).hint("merge"), ["group", "k"])
    place = lambda name, k: ys.select("group", F.col("y").alias(name), F.col("k").alias(k)).hint("merge")
    s = s.join(place("ay", "k0"), ["group", "ay"]).join(place("by", "k1"), ["group", "by"])
    s = s.withColumn("k", F.explode(F.sequence(F.col("k0"), F.col("k1") - 1))).join(slabs.hint("merge"), ["group", "k"])
    t = F.struct("ax", "ay", "bx", "by")
    x0, x1 = G.side_x(t, F.col("y")), G.side_x(t, F.col("above"))
    count = shapes.groupBy("group").agg(F.countDistinct("shape").alias("n"))
    cut = s.groupBy("group", "k", "y", "above").agg(F.array_sort(F.collect_list(F.struct((x0 + x1).alias("m"), x0.alias("x0"), x1.alias("x1"), F.col("shape").cast("int").alias("shape")))).alias("cuts"))
    cut = cut.join(count.hint("merge"), "group")
    n, piece = F.col("n"), "array<struct<l0: double, l1: double, r0: double, r1: double>>"
    start = F.struct(F.array().cast("array<int>").alias("held"), F.lit(0.0).alias("l0"), F.lit(0.0).alias("l1"), F.array().cast(piece).alias("out"))

    def step(a: Column, c: Column) -> Column:
        held = F.when(F.array_contains(a["held"], c["shape"]), F.array_remove(a["held"], c["shape"])).otherwise(F.array_append(a["held"], c["shape"]))
        was, now = rule(a["held"], n), rule(held, n)
        begins = ~was & now
        left = lambda i: F.when(begins, c[f"x{i}"]).otherwise(a[f"l{i}"])
        grown = F.array_append(a["out"], F.struct(a["l0"].alias("l0"), a["l1"].alias("l1"), c["x0"].alias("r0"), c["x1"].alias("r1")))
        return F.struct(held.alias("held"), left(0).alias("l0"), left(1).alias("l1"), F.when(was & ~now, grown).otherwise(a["out"]).alias("out"))

    parts = cut.select("group", F.col("y").alias("y0"), F.col("above").alias("y1"), F.explode(F.aggregate("cuts", start, step, lambda a: a["out"])).alias("p"))
    return parts.select("group", "y0", "y1", "p.l0", "p.l1", "p.r0", "p.r1").where("r0 > l0 OR r1 > l1")


def areas(trapezoids: DataFrame) -> DataFrame:
    """(group, area)."""
    return trapezoids.groupBy("group").agg(F.sum((F.col("y1") - F.col("y0")) * (F.col("r0") - F.col("l0") + F.col("r1") - F.col("l1")) / 2).alias("area"))


def traced(trapezoids: list[tuple[float, ...]]) -> list[list[tuple[float, float]]]:
    """The rings round some trapezoids (y0, y1, l0, l1, r0, r1): slab sides as they are, floors and ceilings where only one of them is."""
    follow: dict[tuple[float, float], list[tuple[float, float]]] = {}
    level: dict[float, dict[float, int]] = {}
    for y0, y1, l0, l1, r0, r1 in trapezoids:
        follow.setdefault((r0, y0), []).append((r1, y1))
        follow.setdefault((l1, y1), []).append((l0, y0))
        for y, a, b, sign in ((y0, l0, r0, 1), (y1, l1, r1, -1)):
            ends = level.setdefault(y, {})
            ends[a] = ends.get(a, 0) + sign
            ends[b] = ends.get(b, 0) - sign
    for y, ends in level.items():
        xs, covered = sorted(ends), 0
        for a, b in zip(xs, xs[1:], strict=False):
            covered += ends[a]
            for _ in range(abs(covered)):
                p, q = ((a, y), (b, y)) if covered > 0 else ((b, y), (a, y))
                follow.setdefault(p, []).append(q)
    rings = []
    while follow:
        here = first = next(iter(follow))
        ring = []
        while True:
            ring.append(here)
            after = follow[here].pop()
            if not follow[here]:
                del follow[here]
            here = after
            if here == first:
                break
        turns = lambda p, q, r: (q[0] - p[0]) * (r[1] - q[1]) != (q[1] - p[1]) * (r[0] - q[0])
        ring = [q for p, q, r in zip([ring[-1], *ring], ring, [*ring[1:], ring[0]], strict=False) if turns(p, q, r)]
        if len(ring) > 2:
            rings.append(ring)
    return rings


def outlines(trapezoids: DataFrame) -> DataFrame:
    """(group, rings) of what overlay gives; a task holds one result at a time."""
    kind = trapezoids.schema["group"].dataType.simpleString()

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rings = [[[{"x": float(x), "y": float(y)} for x, y in r] for r in traced([tuple(p) for p in parts])] for parts in f["parts"]]
            yield pd.DataFrame({"group": f["group"], "rings": rings})

    parts = F.collect_list(F.array("y0", "y1", "l0", "l1", "r0", "r1")).alias("parts")
    return trapezoids.groupBy("group").agg(parts).mapInPandas(run, f"group {kind}, rings {RINGS}")


def buffered(polygons: DataFrame, key: str, radius: float | Column, corners: int = 16) -> DataFrame:
    """Trapezoids (group = key) of each polygon grown by a radius, which may be a column of its own: itself, a box along each side and a regular polygon at each vertex, united."""
    ring = lambda *ps: F.array(F.array(*[F.struct(px.alias("x"), py.alias("y")) for px, py in ps]))
    wide = radius if isinstance(radius, Column) else F.lit(radius)
    sides = polygons.select(F.col(key).alias("group"), wide.cast("double").alias("radius"), F.posexplode(G.sides(F.col("rings"))).alias("k", "t")).where("t.ax <> t.bx OR t.ay <> t.by")
    ax, ay, bx, by = (F.col(f"t.{c}") for c in ("ax", "ay", "bx", "by"))
    long = F.sqrt((bx - ax) ** 2 + (by - ay) ** 2) / F.col("radius")
    nx, ny = (ay - by) / long, (bx - ax) / long
    boxes = sides.select("group", (2 * F.col("k") + 1).alias("shape"), ring((ax + nx, ay + ny), (bx + nx, by + ny), (bx - nx, by - ny), (ax - nx, ay - ny)).alias("rings"))
    # Corners lie on the axes, where a box's sides are tangent: exact values there.
    turn = [(round(math.cos(2 * math.pi * c / corners), 15), round(math.sin(2 * math.pi * c / corners), 15)) for c in range(corners)]
    discs = sides.select("group", (2 * F.col("k") + 2).alias("shape"), ring(*[(ax + F.col("radius") * dx, ay + F.col("radius") * dy) for dx, dy in turn]).alias("rings"))
    own = polygons.select(F.col(key).alias("group"), F.lit(0).alias("shape"), "rings")
    return overlay(own.unionByName(boxes).unionByName(discs), UNION)


# --- rings ----------------------------------------------------------------------


def thinned(points: np.ndarray, tolerance: float) -> np.ndarray:
    """A ring without the vertices that lie within a tolerance of the line that stays (Douglas-Peucker from its first vertex and the one farthest from it); as it is, if fewer than three would stay."""
    n = len(points)
    if n < 4:
        return points
    loop = np.vstack([points, points[:1]])
    half = int(np.hypot(*(points - points[0]).T).argmax())
    keep = np.zeros(n + 1, bool)
    keep[[0, half, n]] = True
    todo = [(0, half), (half, n)]
    while todo:
        a, b = todo.pop()
        if b - a > 1:
            p, q, r = loop[a], loop[b], loop[a + 1 : b]
            along = q - p
            t = np.clip((r - p) @ along / max(along @ along, 1e-300), 0, 1)
            far = np.hypot(*(r - p - t[:, None] * along).T)
            k = int(far.argmax())
            if far[k] > tolerance:
                keep[a + 1 + k] = True
                todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return points[keep[:n]] if keep[:n].sum() > 2 else points


def simplified(polygons: DataFrame, tolerance: float) -> DataFrame:
    """The same rows with thinned rings."""
    place = polygons.columns.index("rings")

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for rings in f.iloc[:, place]:
                new = [thinned(np.array([(p["x"], p["y"]) for p in r], float).reshape(-1, 2), tolerance) for r in (rings if rings is not None else ())]
                rows.append(None if rings is None else [[{"x": float(x), "y": float(y)} for x, y in r] for r in new])
            f.isetitem(place, pd.Series(rows, index=f.index, dtype=object))
            yield f

    return polygons.mapInPandas(run, polygons.schema)


def hull(points: np.ndarray) -> np.ndarray:
    """The corners of the convex hull, against the clock (a monotone chain each way)."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p
    chains = []
    for order in (p, p[::-1]):
        chain: list[np.ndarray] = []
        for q in order:
            while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (q[1] - chain[-2][1]) <= (chain[-1][1] - chain[-2][1]) * (q[0] - chain[-2][0]):
                chain.pop()
            chain.append(q)
        chains += chain[:-1]
    return np.array(chains)


def hulls(points: DataFrame, key: str, x: str = "x", y: str = "y") -> DataFrame:
    """(key, rings): the convex hull of each key's points. Batches give their own hulls first, so few points meet in the end."""
    kind = points.schema[key].dataType.simpleString()

    def partial(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for k, own in f.groupby("key", dropna=False):
                corners = hull(own[["x", "y"]].to_numpy())
                yield pd.DataFrame({"key": [k] * len(corners), "x": corners[:, 0], "y": corners[:, 1]})

    def whole(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rings = [[[{"x": float(a), "y": float(b)} for a, b in hull(np.array([tuple(p) for p in ps]))]] for ps in f["ps"]]
            yield pd.DataFrame({"key": f["key"], "rings": rings})

    p = points.select(F.col(key).alias("key"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("key IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL")
    corners = p.mapInPandas(partial, f"key {kind}, x double, y double")
    return corners.groupBy("key").agg(F.collect_set(F.array("x", "y")).alias("ps")).mapInPandas(whole, f"key {kind}, rings {RINGS}").withColumnRenamed("key", key)
