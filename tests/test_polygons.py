"""Polygon joins and overlays against plain ray casting and counted cells."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from terrane.functions import geo as G
from terrane.operators import polygons as P

SCHEMA = "id long, rings array<array<struct<x: double, y: double>>>"


def covers(rings, x, y):
    """Exact, borders included."""
    odd = False
    for r in rings:
        for (ax, ay), (bx, by) in zip(r, r[1:] + r[:1], strict=True):
            turn = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
            if turn == 0 and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
                return True
            if (ay > y) != (by > y) and x < Fraction(bx - ax) * (y - ay) / (by - ay) + ax:
                odd = not odd
    return odd


def wild(rng, size):
    return [[(rng.randint(-size, size), rng.randint(-size, size)) for _ in range(rng.randint(3, 7))] for _ in range(rng.randint(1, 3))]


def frame(spark, shapes):
    return spark.createDataFrame([(k, [[(float(x), float(y)) for x, y in r] for r in rings]) for k, rings in enumerate(shapes)], SCHEMA)


def test_points_in_polygons_of_all_sizes(spark):
    """Self-crossing rings, holes, parts, far smaller and larger ones; points on borders and corners."""
    rng = random.Random(6)
    shapes = [wild(rng, size) for size in (1, 2, 5, 12, 40) for _ in range(8)] + [[[(0, 0), (9, 0), (9, 9), (0, 9)], [(3, 3), (6, 3), (6, 6), (3, 6)]], [], [[(2, 2)]]]
    points = sorted({(rng.randint(-14, 14), rng.randint(-14, 14)) for _ in range(250)})
    df = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(points)] + [(999, None, 1.0)], "p long, x double, y double")
    got = {(r["p"], r["id"]) for r in P.join_points(df, frame(spark, shapes), "id", border=1e-9).collect()}
    assert got == {(k, i) for k, (x, y) in enumerate(points) for i, rings in enumerate(shapes) if covers(rings, x, y)}
    assert P.join_points(df, frame(spark, [[]]), "id").collect() == []
    labels = {r["p"]: r["id"] for r in P.label_points(df, frame(spark, shapes), "p", "id", border=1e-9).collect()}
    assert labels == {k: max((i for q, i in got if q == k), default=None) for k in [*range(len(points)), 999]}
    assert {r["p"] for r in P.outside(df, frame(spark, shapes), "p", "id", border=1e-9).collect()} == {k for k, v in labels.items() if v is None}


def test_the_plan_has_no_nested_loop(spark):
    df = spark.range(10).select(F.col("id").alias("p"), F.col("id").cast("double").alias("x"), F.col("id").cast("double").alias("y"))
    plan = P.join_points(df, frame(spark, [[[(0, 0), (4, 0), (4, 4)]]]), "id")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def staircase(rng):
    """A union of whole cells as even-odd boxes side by side: any set of cells of a 6 x 6 board."""
    return {(i, j) for i in range(6) for j in range(6) if rng.random() < 0.5}


@pytest.mark.parametrize("seed", range(3))
def test_overlay_of_cells(spark, seed):
    """Three shapes made of cells, touching and overlapping along whole sides, in each of four groups."""
    rng = random.Random(seed)
    cells = {(g, s): staircase(rng) for g in range(4) for s in range(3)}
    boxes = [(g, s, [[(float(i), float(j)), (i + 1.0, float(j)), (i + 1.0, j + 1.0), (float(i), j + 1.0)] for i, j in c]) for (g, s), c in cells.items()]
    df = spark.createDataFrame(boxes, "group long, shape int, rings array<array<struct<x: double, y: double>>>")
    rules = {"UNION": lambda h: len(h) > 0, "INTERSECTION": lambda h: len(h) == 3, "DIFFERENCE": lambda h: h == {0}, "EITHER": lambda h: len(h) % 2 == 1}
    for name, rule in rules.items():
        parts = P.overlay(df, getattr(P, name))
        want = {g: sum(rule({s for s in range(3) if (i, j) in cells[g, s]}) for i in range(6) for j in range(6)) for g in range(4)}
        assert {r["group"]: round(r["area"], 9) for r in P.areas(parts).collect()} == {g: n for g, n in want.items() if n}
        traced = P.outlines(parts).select("group", G.rings_area(F.col("rings")).alias("area")).collect()
        assert {r["group"]: round(r["area"], 9) for r in traced} == {g: n for g, n in want.items() if n}


def test_overlay_of_wild_rings(spark):
    """Slanted, self-crossing shapes: shares add up, and places agree with ray casting."""
    rng = random.Random(4)
    shapes = [(g, s, [[(float(x), float(y)) for x, y in r] for r in wild(rng, 9)]) for g in range(6) for s in range(2)]
    df = spark.createDataFrame(shapes, "group long, shape int, rings array<array<struct<x: double, y: double>>>")
    area = {name: {r["group"]: r["area"] for r in P.areas(P.overlay(df, getattr(P, name))).collect()} for name in ("UNION", "INTERSECTION", "DIFFERENCE", "EITHER")}
    own = {s: {r["group"]: r["area"] for r in P.areas(P.overlay(df.where(F.col("shape") == s).withColumn("shape", F.lit(0)), P.UNION)).collect()} for s in (0, 1)}
    get = lambda n, g: area[n].get(g, 0.0)
    for g in range(6):
        assert get("UNION", g) + get("INTERSECTION", g) == pytest.approx(own[0].get(g, 0.0) + own[1].get(g, 0.0))
        assert get("DIFFERENCE", g) + get("INTERSECTION", g) == pytest.approx(own[0].get(g, 0.0))
        assert get("EITHER", g) == pytest.approx(get("UNION", g) - get("INTERSECTION", g))
    common = P.outlines(P.overlay(df, P.INTERSECTION)).withColumnRenamed("group", "id")
    spots = [(k, rng.uniform(-9, 9), rng.uniform(-9, 9)) for k in range(300)]
    found = {(r["p"], r["id"]) for r in P.join_points(spark.createDataFrame(spots, "p long, x double, y double"), common, "id").collect()}
    by = {(g, s): r for g, s, r in shapes}
    assert found == {(k, g) for k, x, y in spots for g in range(6) if covers(by[g, 0], x, y) and covers(by[g, 1], x, y)}


def test_interior_points(spark):
    rng = random.Random(2)
    shapes = [wild(rng, 8) for _ in range(60)] + [[[(0, 0), (8, 0), (8, 8), (0, 8)], [(1, 1), (7, 1), (7, 7), (1, 7)]], [[(0, 0), (4, 0), (9, 0)]], []]
    rows = frame(spark, shapes).select("id", G.interior_point(F.col("rings")).alias("p")).collect()
    assert all(r["p"] is None or covers(shapes[r["id"]], Fraction(r["p"]["x"]), Fraction(r["p"]["y"])) for r in rows)
    points = {r["id"]: r["p"] for r in rows}
    assert points[61] is None and points[62] is None and not (1 < points[60]["x"] < 7 and 1 < points[60]["y"] < 7)
    assert sum(p is None for p in points.values()) <= 8  # flat ones alone


def test_hulls_and_thinning(spark):
    df = spark.createDataFrame([(1, x, y) for x in range(5) for y in range(5)] + [(2, 0, 0), (2, 3, 3), (3, 1, 1), (None, 1, 1), (3, None, 1)], "k long, x long, y long").repartition(4)
    got = {r["k"]: sorted((p["x"], p["y"]) for p in r["rings"][0]) for r in P.hulls(df, "k").collect()}
    assert got == {1: [(0, 0), (0, 4), (4, 0), (4, 4)], 2: [(0, 0), (3, 3)], 3: [(1, 1)]}
    rings = spark.createDataFrame([(1, None), (2, []), (3, [[(0.0, 0.0), (1.0, 0.0), (1.0, 1e-9)]])], SCHEMA)
    assert {r["id"]: r["rings"] and len(r["rings"][0]) for r in P.simplified(rings, 0.1).collect()} == {1: None, 2: [], 3: 3}
