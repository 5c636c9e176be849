"""What failed at size or by an error, on small tables."""

import math
import random

from pyspark.sql import functions as F

from terrane.functions import geo as G
from terrane.functions import scalars as S
from terrane.operators import allocation, friction, sites
from terrane.operators import polygons as P
from terrane.operators import relational as R
from terrane.operators import toponymy as T
from terrane.plans import files, flows, polygons, spatial
from terrane.sources import vectors
from test_rules import loop_dedup

SF = "/root/testdata/sf0.001"


def rings_of(*rings):
    return [[(float(x), float(y)) for x, y in r] for r in rings]


def test_integer_transport_keeps_rows_and_columns(spark):
    got = flows.integer_transport(spark, SF)
    zone = spark.read.parquet(f"{SF}/nation.parquet").select("n_nationkey", "n_regionkey")
    t = flows.pairs(spark, SF).join(zone.toDF("o", "zone"), "o").join(zone.toDF("d", "zone"), ["d", "zone"])
    for end in ("o", "d"):
        want = {tuple(r) for r in t.groupBy("zone", end).agg(F.sum("size")).collect()}
        assert {tuple(r) for r in got.groupBy("zone", end).agg(F.sum("flow")).collect()} == want
    assert got.join(t, ["zone", "o", "d"], "left_anti").isEmpty()


def test_a_place_is_looked_up_once(spark, monkeypatch):
    """However many points it has; null places and points outside keep their rows."""
    seen, join = [], P.join_points
    monkeypatch.setattr(P, "join_points", lambda points, *a, **k: (seen.append(points.count()), join(points, *a, **k))[1])
    points = spark.range(900).select("id", (F.col("id") % 3 * 2).cast("double").alias("x"), F.when(F.col("id") != 7, F.lit(1.0)).alias("y"), F.lit(2).alias("n"))
    boxes = [(k, [[(0.0, 0.0), (w, 0.0), (w, 2.0), (0.0, 2.0)]]) for k, w in ((1, 1.0), (2, 3.0))]
    zones = spark.createDataFrame(boxes, "zone long, rings array<array<struct<x: double, y: double>>>")
    labels = {r["id"]: r["zone"] for r in P.label_points(points, zones, "id", "zone").collect()}
    assert labels == {k: None if k == 7 or k % 3 == 2 else 2 for k in range(900)}
    assert {r["id"] for r in P.outside(points, zones, "id", "zone").collect()} == {k for k in range(900) if labels[k] is None}
    assert {tuple(r) for r in P.sums_in(points, zones, "zone", ["n"]).collect()} == {(1, 300, 600), (2, 599, 1198)}
    assert max(seen) <= 4


def test_draws_hash_once(spark):
    """A replicate's number is a column of its own in the plan: one MD5, however many comparisons."""
    records = spark.range(20).select(F.lit("guard").alias("side"), "id", F.lit(1).alias("o"), F.lit(2).alias("d"), F.lit(1.0).alias("weight"))
    p = spark.createDataFrame([(b, 1, 2, 0.1 + b) for b in (0.1, 0.2)], "beta double, o int, d int, p double")
    sums = friction.compared(records, p, 5)
    assert sums._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 1
    rows = {(r["rep"], r["beta"]): (r["mass"], round(r["lost"], 9)) for r in sums.collect()}
    assert len(rows) == 12 and all(rows[0, b] == (20, round(-20 * math.log(0.1 + b), 9)) for b in (0.1, 0.2))


def test_blocks_of_equal_keys_can_all_stay(spark):
    box = [[(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0)]]
    rows = [("a", k, 5, box, "0900200010010001") for k in range(3)]
    layer = spark.createDataFrame(rows, f"file string, record long, shape int, rings {P.RINGS}, CVEGEO string")
    assert vectors.area_points(layer)[0].count() == 1 and vectors.area_points(layer, every=True)[0].count() == 3


def test_shapefile_blocks_of_long_numbers(spark, tmp_path):
    """Keys cut to four places are equal for suppliers 1600 and 16000; SQL keeps both."""
    spark.createDataFrame([(k, "x", 1, 0.0) for k in (5, 1600, 16000)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    assert files.shapefile_blocks(spark, str(tmp_path)).count() == 3


def test_points_of_one_place_are_compared_once(spark):
    """Pairs, nearest targets and segments of crowded places against the plain loop."""
    at = [(k, float(k % 7), float(k % 3)) for k in range(60)] + [(60, None, 1.0), (61, 2.5, float("nan"))]
    points = spark.createDataFrame(at, "id long, x double, y double")
    finite = at[:60]
    far = lambda p, q: math.hypot(p[1] - q[1], p[2] - q[2])
    want = {(p[0], q[0], round(far(p, q), 3)) for p in finite for q in finite if p[0] < q[0] and far(p, q) <= 1.5}
    pairs = R.pairs_within(points, 1.5, digits=3)
    assert {tuple(r) for r in pairs.collect()} == want and pairs.count() == len(want)
    targets = points.where("id < 40").select(F.col("id").alias("target"), (F.col("x") * 2).alias("tx"), F.col("y").alias("ty"))
    near = {r["id"]: r["target"] for r in R.nearest_within(points, targets, 0.9).collect()}
    ends = [(k, 2 * x, y) for k, x, y in finite[:40]]
    assert near == {p[0]: min(((far(p, q), q[0]) for q in ends if p[0] < 60 and far(p, q) <= 0.9), default=(0, None))[1] for p in at}
    line = spark.createDataFrame([(1, 0.0, 0.0, 3.0, 0.0)], "segment int, ax double, ay double, bx double, by double")
    assert {(r["id"], r["y"]) for r in R.nearest_line(points, line, 1.0).collect()} == {(p[0], 0.0) for p in finite if p[2] <= 1 and p[1] <= 4 and (p[1] <= 3 or p[2] == 0)}
    assert {tuple(r) for r in R.places_of(points).select("id", "place").collect()} == {(k, min(i for i, *q in finite if q == [x, y]) if k < 60 else k) for k, x, y in at}
    joins = R.pairs_within(points, 1.5)._jdf.queryExecution().optimizedPlan().toString()
    assert "cx" not in joins.split("Join")[1]  # members join by place, not by cell


def test_anchors_of_crowded_places(spark, tmp_path):
    """The greedy choice in order of score, by the plain loop, with many suppliers at each place."""
    rows = [(k * 500, "x", 1, float(k * 7919 % 101)) for k in range(90)] + [(k * 500 + 1, "x", 1, float(k * 31 % 17)) for k in range(40)]
    spark.createDataFrame(rows, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    place = lambda k: (k * 37 % 1000 / 10.0, k * 53 % 1000 / 10.0)
    chosen: list = []
    for k, *_ in sorted(rows, key=lambda r: (-r[3], r[0])):
        if all(math.dist(place(k), place(c)) > 6 for c in chosen):
            chosen.append(k)
    got = spatial.anchor_thinning(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and {r["id"] for r in got if r["anchor"]} == set(chosen)


def test_open_points_by_distance_and_id():
    """Points at equal distance in order of id, used ones skipped and taken off their place; a group that is full ends the walk."""
    rows = [{"id": k} for k in range(6)]
    left = [0, 5, 5, 5, 5, 5]
    spots = {"a": [2, 0], "b": [3, 1], "c": [5, 4]}
    got = []
    for i in sites.open_points([(0.0, ["a", "b"]), (1.0, ["c"])], spots, left, rows):
        got.append(i)
        left[i] -= 5 if i != 4 else 3
    assert got == [1, 2, 3, 4] and spots == {"a": [], "b": [], "c": [5, 4]}


def test_districts_of_one_outline_are_cut_once(spark, tmp_path, monkeypatch):
    rows = [(k, "x", 1, 0.0) for n in range(20) for k in (n * 660, n * 660 + 1, n * 660 + 3)]
    spark.createDataFrame(rows, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    seen, overlay = [], P.overlay
    monkeypatch.setattr(P, "overlay", lambda shapes, rule: (seen.append(shapes.count()), overlay(shapes, rule))[1])
    got = polygons.campus_wins(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and seen[0] <= 5


def test_a_box_within_reach():
    """The quick answer of clusters agrees with looking at every place."""
    rng = random.Random(3)
    said = 0
    for _ in range(500):
        places = [(-99 + rng.random() / 300, 19 + rng.random() / 300) for _ in range(4)]
        (west, east), (south, north) = ((min(c), max(c)) for c in zip(*places, strict=True))
        at = (-99 + rng.random() / 300, 19 + rng.random() / 300)
        if sites.surely_within((west, south, east, north), at, 250.0):
            said += 1
            assert all(sites.metres(p, at, p[1]) <= 250.0 for p in places)
    assert 0 < said < 500


def test_overlay_passes_nothing_through_the_driver(spark):
    """However small the polygons look on disk, what comes of them is never broadcast; a radius may be a column."""
    square = rings_of([(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (0.0, 2.0)])
    boxes = spark.createDataFrame([(1, square, 0.5), (2, square, 1.5)], f"zone long, rings {P.RINGS}, r double")
    grown = P.areas(P.buffered(boxes, "zone", F.col("r")))
    assert "Broadcast" not in grown._jdf.queryExecution().executedPlan().toString()
    assert {r["group"]: round(r["area"], 6) for r in grown.collect()} == {k: round(8 + 12 * r + 8 * r * r * math.sin(math.pi / 8), 6) for k, r in ((1, 0.5), (2, 1.5))}


def copies(spark, n=240):
    """Places of few kinds, each many times over."""
    rng = random.Random(5)
    rows = []
    for k in rng.sample(range(10 * n), n):
        x, kind = rng.choice((0.0, 0.002, 0.004)), rng.choice((None, None, "locality"))
        rows.append((k, None, None, kind, "suburb", rng.choice(("La Toscana", "toscana real", "Colonia Toscana Real")), rng.choice((None, "1")), None, None, rng.choice(("OSM_NODE", "YAML_CURATED")), -99 + x, 19.0, float(rng.randrange(4))))
    columns = "seq long, id string, official_code string, feature_kind string, type string, name string, cve_ent string, cve_mun string, cve_loc string, source string, lon double, lat double, score double"
    return spark.createDataFrame(rows, columns).withColumn("key", S.place_key(F.col("name"))).withColumn("old_key", F.lit(""))


def test_copies_of_places_are_compared_once(spark, monkeypatch):
    """Pairs, reviews, groups and merges of many copies against the plain loops; what is paired are kinds."""
    p, seen, near = copies(spark), [], T.near_pairs
    rows = sorted(p.collect(), key=lambda r: r["seq"])
    plain = {(r["a"], r["b"]) for r in near(p, 300.0).where(T.same_place(300.0)).select(F.col("l.seq").alias("a"), F.col("r.seq").alias("b")).collect()}
    monkeypatch.setattr(T, "near_pairs", lambda places, *a, **k: (seen.append(places.count()), near(places, *a, **k))[1])
    pairs = T.same_place_pairs(p, 300.0)
    assert {tuple(r) for r in pairs.collect()} == plain and pairs.count() == len(plain)
    assert {r["seq"]: r["dropped_for"] for r in T.spatial_dedup(p, 300.0).collect()} == loop_dedup(rows, 300.0)
    odd = p.where("seq % 2 = 1").withColumn("seq", F.col("seq") + 10000)
    kept = {r["seq"] for r in T.curated_over_native(p.where("seq % 2 = 0 AND cve_ent = '1'"), odd, spark.createDataFrame([("toscana REAL",)], "name string")).where("origin = 'native'").collect()}
    known = [r for r in rows if r["seq"] % 2 == 0 and r["cve_ent"] == "1" and r["name"] != "toscana real"]
    other = {r["seq"] + 10000 for r in rows if r["seq"] % 2 == 1 and r["name"] != "toscana real" and not any(k["key"] == r["key"] and abs(k["lon"] - r["lon"]) < 0.003 for k in known)}
    assert kept == other
    taken, groups = set(), set()
    known = lambda r: [r[f] for f in ("feature_kind", "official_code", *T.TERRITORY)]
    agree = lambda a, b: all(x is None or y is None or x == y for x, y in zip(known(a), known(b), strict=True))
    match = lambda a, b: abs(a["lon"] - b["lon"]) < 0.003 and (a["name"] == b["name"] or "toscana real" in a["name"].lower() and "toscana real" in b["name"].lower())
    for i, a in enumerate(rows):
        members = [a]
        for b in rows[i + 1 :]:
            if a["seq"] not in taken and b["seq"] not in taken and match(a, b) and all(agree(m, b) for m in members):
                members.append(b)
        if len(members) > 1:
            taken |= {m["seq"] for m in members}
            best = min(members, key=lambda m: (-m["score"], m["seq"]))["seq"]
            kind = "EXACT" if len({m["name"].lower() for m in members}) == 1 else "FUZZY"
            groups |= {(m["seq"], a["seq"], kind, best) for m in members}
    assert {tuple(r) for r in T.duplicate_groups(p, 300.0).collect()} == groups
    assert len(seen) == 4 and max(seen) <= 72


def test_an_interior_point_reads_its_rings_once(spark):
    """However often a point's height and stretch name them: a text is parsed once for each form it may have."""
    texts = [("Polygon", "[[[0,0],[4,0],[4,2],[0,2]],[[1,0.5],[2,0.5],[2,1.5],[1,1.5]]]"), ("Polygon", "[[[0,0],[1,0]]]"), ("Polygon", None)]
    df = spark.createDataFrame(texts, "type string, c string")
    vertices = F.transform(F.from_json("c", "array<array<array<double>>>"), lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    got = df.select(G.interior_point(vertices).alias("p"))
    assert [r["p"] and tuple(r["p"]) for r in got.collect()] == [(3.0, 1.0), None, None]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("from_json") + got._jdf.queryExecution().optimizedPlan().toString().count("JsonToStructs") == 1


def test_permitted_pairs_of_crowded_places(spark):
    """Against the plain loop, with null components; only destinations on the list are looked up in it."""
    rows = [(k, float(k % 4), float(k % 3), k % 2, None if k % 5 == 0 else k % 3) for k in range(60)]
    p = spark.createDataFrame(rows, "o int, x double, y double, zone int, component int")
    no = {(a, b) for a in range(0, 60, 2) for b in (2, 4, 58)}
    got = allocation.permitted(p, p.toDF("d", "dx", "dy", "zone", "component"), spark.createDataFrame(sorted(no), "o int, d int"), reach=2.0)
    far = lambda a, b: math.hypot(a[1] - b[1], a[2] - b[2])
    want = {(a[0], b[0], round(far(a, b), 6)) for a in rows for b in rows if a[3] == b[3] and (a[4] is None or a[4] == b[4]) and 0 < far(a, b) <= 2 and (a[0], b[0]) not in no}
    assert {(r["o"], r["d"], round(r["distance"], 6)) for r in got.collect()} == want and got.count() == len(want)
    assert "LeftSemi" in got._jdf.queryExecution().optimizedPlan().toString()
