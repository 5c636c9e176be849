"""Distances, cells and polygon predicates as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = 6371.0) -> Column:
    """Great-circle distance in the unit of the radius."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def flat_metres(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Equirectangular metres at the first point's latitude."""
    return F.sqrt(F.pow((lon2 - lon1) * 111320 * F.cos(F.radians(lat1)), 2) + F.pow((lat2 - lat1) * 110574, 2))


def cell(value: Column, size: float) -> Column:
    return F.floor(value / size).cast("long")


def in_bbox(lon: Column, lat: Column, box: tuple[float, float, float, float]) -> Column:
    return lon.between(box[0], box[2]) & lat.between(box[1], box[3])


def in_ring(lon: Column, lat: Column, ring: list[tuple[float, float]]) -> Column:
    """Ray casting over a literal ring: an odd number of edges to the right. The caller tests the bounding box first."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        if y1 != y2:
            crosses = ((F.lit(y1) > lat) != (F.lit(y2) > lat)) & (lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1)
            crossings = crossings + crosses.cast("int")
    return crossings % 2 == 1


def ring_area(ring: Column) -> Column:
    """Shoelace area of array<struct<x,y>>."""
    nxt = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    cross = F.zip_with(ring, nxt, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda a, x: a + x)) / 2


def ring_centroid(ring: Column) -> Column:
    """Area-weighted centroid, struct(x, y); null for a ring without area."""
    nxt = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def add(s: Column, p: Column) -> Column:
        return F.struct((s["a"] + p["a"]).alias("a"), (s["x"] + p["x"]).alias("x"), (s["y"] + p["y"]).alias("y"))

    def edge(p: Column, q: Column) -> Column:
        c = p["x"] * q["y"] - q["x"] * p["y"]
        return F.struct(c.alias("a"), ((p["x"] + q["x"]) * c).alias("x"), ((p["y"] + q["y"]) * c).alias("y"))

    t = F.aggregate(F.zip_with(ring, nxt, edge), zero, add)
    return F.when(t["a"] != 0, F.struct((t["x"] / (3 * t["a"])).alias("x"), (t["y"] / (3 * t["a"])).alias("y")))


def segment_metres(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance from a point to a segment in one metric plane."""
    dx, dy = bx - ax, by - ay
    n = dx * dx + dy * dy
    t = F.when(n > 0, F.least(F.greatest(((px - ax) * dx + (py - ay) * dy) / n, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))
    return F.sqrt(F.pow(px - ax - t * dx, 2) + F.pow(py - ay - t * dy, 2))


def mercator(lon: Column, lat: Column, zoom: int) -> Column:
    """Web-Mercator pixel, struct(x, y)."""
    world = 256 * 2**zoom
    y = (1 - F.ln(F.tan(F.radians(lat)) + 1 / F.cos(F.radians(lat))) / F.pi()) / 2 * world
    return F.struct(((lon + 180) / 360 * world).alias("x"), y.alias("y"))


def flat_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column, mean_lat: Column) -> Column:
    """Equirectangular kilometres with one scale for a whole city, that of its mean latitude."""
    return F.sqrt(F.pow((lon2 - lon1) * 111.32 * F.cos(F.radians(mean_lat)), 2) + F.pow((lat2 - lat1) * 110.574, 2))


def projected(lon: Column, lat: Column, reference_lat: Column, radius: float = 6371008.8) -> Column:
    """struct(x, y) metres from the origin of longitude and latitude, at the scale of a reference latitude."""
    return F.struct((radius * F.radians(lon) * F.cos(F.radians(reference_lat))).alias("x"), (radius * F.radians(lat)).alias("y"))


def geodesic(lon1: Column, lat1: Column, lon2: Column, lat2: Column, rounds: int = 20) -> Column:
    """Metres on the WGS84 ellipsoid by Vincenty's inverse formula, a fixed number of rounds; not for nearly antipodal points."""
    # The ellipsoid's half axis and flattening.
    a, f = 6378137.0, 1 / 298.257223563
    b = a * (1 - f)
    u1, u2 = F.atan((1 - f) * F.tan(F.radians(lat1))), F.atan((1 - f) * F.tan(F.radians(lat2)))
    ends = F.struct(F.sin(u1).alias("s1"), F.cos(u1).alias("c1"), F.sin(u2).alias("s2"), F.cos(u2).alias("c2"), F.radians(lon2 - lon1).alias("l"))

    def parts(e: Column, lam: Column) -> tuple[Column, ...]:
        cross = e["c1"] * e["s2"] - e["s1"] * e["c2"] * F.cos(lam)
        sin = F.sqrt(F.pow(e["c2"] * F.sin(lam), 2) + cross * cross)
        cos = e["s1"] * e["s2"] + e["c1"] * e["c2"] * F.cos(lam)
        alpha = F.when(sin > 0, e["c1"] * e["c2"] * F.sin(lam) / sin).otherwise(0.0)
        square = 1 - alpha * alpha
        middle = F.when(square > 1e-15, cos - 2 * e["s1"] * e["s2"] / square).otherwise(0.0)
        return sin, cos, F.atan2(sin, cos), alpha, square, middle

    def step(s: Column, _: Column) -> Column:
        sin, cos, sigma, alpha, square, middle = parts(s["e"], s["lam"])
        c = f / 16 * square * (4 + f * (4 - 3 * square))
        lam = s["e"]["l"] + (1 - c) * f * alpha * (sigma + c * sin * (middle + c * cos * (2 * middle * middle - 1)))
        return F.struct(s["e"].alias("e"), lam.alias("lam"))

    start = F.struct(ends.alias("e"), F.radians(lon2 - lon1).alias("lam"))

    def length(s: Column) -> Column:
        sin, cos, sigma, _, square, middle = parts(s["e"], s["lam"])
        u = square * (a * a - b * b) / (b * b)
        big_a = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
        big_b = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
        shift = big_b * sin * (middle + big_b / 4 * (cos * (2 * middle * middle - 1) - big_b / 6 * middle * (4 * sin * sin - 3) * (4 * middle * middle - 3)))
        return b * big_a * (sigma - shift)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step, length)


def edges_of(ring: Column) -> Column:
    """The sides of a ring (array<struct<x,y>>, not closed) as array<struct<a, b>>."""
    return F.transform(ring, lambda p, i: F.struct(p.alias("a"), F.get(ring, F.when(i + 1 < F.size(ring), i + 1).otherwise(0)).alias("b")))


def ring_contains(ring: Column, x: Column, y: Column, border: float = 0.001) -> Column:
    """Whether a ring in metres holds a point, its border (1 mm) included: an odd number of sides to the right."""
    sides = edges_of(ring)
    on = F.exists(sides, lambda s: segment_metres(x, y, s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"]) <= border)

    def crosses(s: Column) -> Column:
        a, b = s["a"], s["b"]
        return ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"])

    return on | (F.size(F.filter(sides, lambda s: F.coalesce(crosses(s), F.lit(False)))) % 2 == 1)


def ring_problem(ring: Column) -> Column:
    """Why a ring encloses no simple area (few vertices, repeated, crossing, flat), null if it does."""
    sides = F.transform(edges_of(ring), lambda s, i: F.struct(s["a"].alias("a"), s["b"].alias("b"), i.alias("i")))
    n = F.size(ring)
    turn = lambda p, q, r: (q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"])
    near = lambda p, s: segment_metres(p["x"], p["y"], s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"]) < 0.001

    def meet(s: Column, t: Column) -> Column:
        apart = (t["i"] > s["i"] + 1) & ~((s["i"] == 0) & (t["i"] == n - 1))
        cross = (turn(s["a"], s["b"], t["a"]) * turn(s["a"], s["b"], t["b"]) < 0) & (turn(t["a"], t["b"], s["a"]) * turn(t["a"], t["b"], s["b"]) < 0)
        return apart & (cross | near(s["a"], t) | near(s["b"], t) | near(t["a"], s))

    crossing = F.exists(sides, lambda s: F.exists(sides, lambda t: meet(s, t)))
    distinct = F.size(F.array_distinct(ring))
    return F.when(distinct < 3, "too few vertices").when(distinct < n, "repeated vertex").when(crossing, "crossing sides").when(ring_area(ring) < 1e-6, "no area")


def sides(rings: Column) -> Column:
    """All sides of a polygon's rings (array of rings, not closed) as array<struct<ax, ay, bx, by>>."""

    def of_ring(ring: Column) -> Column:
        after = lambda i: F.get(ring, F.when(i + 1 < F.size(ring), i + 1).otherwise(0))
        return F.transform(ring, lambda p, i: F.struct(p["x"].alias("ax"), p["y"].alias("ay"), after(i)["x"].alias("bx"), after(i)["y"].alias("by")))

    return F.flatten(F.transform(rings, of_ring))


def side_x(side: Column, y: Column) -> Column:
    """Where a side stands at a height; its ends exactly."""
    between = side["ax"] + (y - side["ay"]) * (side["bx"] - side["ax"]) / F.nullif(side["by"] - side["ay"], F.lit(0.0))
    return F.when(y == side["ay"], side["ax"]).when(y == side["by"], side["bx"]).otherwise(between)


def sides_cover(sides: Column, x: Column, y: Column, border: float = 0.0) -> Column:
    """Whether an odd number of sides lies to the right of a point, or one of them within `border` of it."""
    on = F.exists(sides, lambda s: segment_metres(x, y, s["ax"], s["ay"], s["bx"], s["by"]) <= border)
    right = F.filter(sides, lambda s: ((s["ay"] > y) != (s["by"] > y)) & (x < side_x(s, y)))
    return on | (F.size(right) % 2 == 1)


def rings_area(rings: Column) -> Column:
    """Of the rings that overlay traces (outer ones against the clock, holes with it)."""
    return F.abs(F.aggregate(sides(rings), F.lit(0.0), lambda a, s: a + s["ax"] * s["by"] - s["bx"] * s["ay"])) / 2


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value found once: inside array functions Spark finds an expression anew wherever, and for every element for which, it is named."""
    return F.get(F.transform(F.array(value), use), 0)


def interior_point(rings: Column) -> Column:
    """struct(x, y) inside a polygon, never in a hole: the middle of its widest stretch (the first of several) on a line half way up, between two vertices' heights; null without area."""

    def widest(cuts: Column, y: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(0), F.size(cuts) - 2, F.lit(2)), lambda k: F.struct(F.round(F.get(cuts, k + 1) - F.get(cuts, k), 9).alias("w"), (-F.get(cuts, k)).alias("first"), ((F.get(cuts, k) + F.get(cuts, k + 1)) / 2).alias("x")))
        return F.when(F.size(cuts) > 1, bound(F.array_max(pairs), lambda best: F.when(best["w"] > 0, F.struct(best["x"].alias("x"), y.alias("y")))))

    def on_line(s: Column, y: Column) -> Column:
        cuts = F.array_sort(F.transform(F.filter(s, lambda t: (t["ay"] > y) != (t["by"] > y)), lambda t: side_x(t, y)))
        return bound(cuts, lambda cuts: widest(cuts, y))

    def at_height(s: Column, heights: Column) -> Column:
        y = bound((F.array_min(heights) + F.array_max(heights)) / 2, lambda centre: (F.array_max(F.filter(heights, lambda h: h <= centre)) + F.array_min(F.filter(heights, lambda h: h > centre))) / 2)
        return F.when(F.size(heights) > 1, bound(y, lambda y: on_line(s, y)))

    heights = lambda s: F.array_sort(F.array_distinct(F.transform(s, lambda t: t["ay"])))
    return bound(F.filter(sides(rings), lambda t: t["ay"] != t["by"]), lambda s: bound(heights(s), lambda h: at_height(s, h)))
