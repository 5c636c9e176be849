"""Rules of the reference operators on literal fixtures, and greedy operators against the plain loop."""

import random
import zipfile

import pytest
from pyspark.sql import functions as F

from terrane.functions import geo as G
from terrane.functions import scalars as S
from terrane.operators import allocation, audit, calibrate, graph, relational, sites, toponymy
from terrane.plans import toponymy as plans
from terrane.sources import official, readers, writers
from terrane.streaming import events

CELLS = "zone int, o string, d string, proposal long, distance double"


def transported(spark, cells, supply, targets):
    c = spark.createDataFrame([(1, *x) for x in cells], CELLS)
    s = spark.createDataFrame([(1, *x) for x in supply], "zone int, o string, out long")
    t = spark.createDataFrame([(1, *x) for x in targets], "zone int, d string, target double")
    return {(r["o"], r["d"]): r["flow"] for r in allocation.integer_transport(c, s, t).collect()}


def test_transport_follows_a_tight_cut(spark):
    cells = [("o0", "d0", 0, 1.0), ("o1", "d1", 0, 1.0), ("o1", "d2", 0, 1.0)]
    got = transported(spark, cells, [("o0", 1), ("o1", 1)], [("d0", 0.4), ("d1", 0.8), ("d2", 0.8)])
    assert got["o0", "d0"] == 1 and sum(got.values()) == 2


def test_transport_keeps_a_feasible_proposal(spark):
    cells = [("a", "c", 8, 1.0), ("a", "d", 0, 2.0), ("b", "c", 0, 2.0), ("b", "d", 2, 1.0)]
    assert transported(spark, cells, [("a", 8), ("b", 2)], [("c", 5.0), ("d", 5.0)]) == {("a", "c"): 5, ("a", "d"): 3, ("b", "d"): 2}


@pytest.mark.parametrize("cells, supply, targets", [([("a", "c", 0, 1.0)], [("a", 2)], [("c", 1.0), ("d", 1.0)]), ([("a", "c", 0, 1.0), ("b", "c", 0, 1.0), ("b", "d", 0, 1.0)], [("a", 3), ("b", 1)], [("c", 1.0), ("d", 3.0)])])
def test_transport_names_a_cut(spark, cells, supply, targets):
    with pytest.raises(Exception, match="complete support cannot realise"):
        transported(spark, cells, supply, targets)


def test_transport_widens_its_support(spark):
    cells = [("o", f"d{k:03}", 0, float(k)) for k in range(60)] + [(f"p{k}", f"d{k:03}", 0, 0.5) for k in range(40)]
    targets = [(f"d{k:03}", 1.0) for k in range(60)]
    c = spark.createDataFrame([(1, *x) for x in cells], CELLS)
    s = spark.createDataFrame([(1, "o", 20), *((1, f"p{k}", 1) for k in range(40))], "zone int, o string, out long")
    t = spark.createDataFrame([(1, *x) for x in targets], "zone int, d string, target double")
    rows = allocation.integer_transport(c, s, t, widths=(4, 16)).collect()
    assert sum(r["flow"] for r in rows) == 60 and {r["d"] for r in rows if r["o"] == "o"} == {f"d{k:03}" for k in range(40, 60)}


@pytest.mark.parametrize("data, text, encoding, repairs", [
    ("añó".encode(), "añó", "utf-8", []),
    (b"\xef\xbb\xbfa", "a", "utf-8", []),
    ("añó€".encode("cp1252"), "añó€", "cp1252", []),
    ("ñ ".encode("cp1252") + "Á Í".encode(), "ñ Á Í", "cp1252+utf8", [3, 6]),
])
def test_strict_decode(data, text, encoding, repairs):
    assert official.decode_strict(data) == (text, encoding, repairs)


@pytest.mark.parametrize("data", [b"a\x81b\xf1", b"\xf1\xc2\x81", b"\xe2\x81 \xf1"])
def test_strict_decode_refuses(data):
    with pytest.raises(ValueError, match="byte"):
        official.decode_strict(data)


def test_preamble(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('title\nx,y\n"Año",Valor\n1,"a\nb"\nx,y\ntitle,2\n')
    got = readers.read_with_preamble(spark, str(path), "VALOR")
    assert sorted(map(tuple, got.select("ano", "valor").collect())) == [("1", "a\nb"), ("title", "2"), ("x", "y")]
    (tmp_path / "b.csv").write_text("no header\n1\n")
    assert readers.read_with_preamble(spark, str(tmp_path / "b.csv"), "VALOR").count() == 0


def test_sniff():
    assert readers.sniff("Latitud;Longitud;id\n1;2;3\n".encode("cp1252"), {"latitud", "longitud", "id"}) == ("UTF-8", ";")
    assert readers.sniff("Año,b\n".encode("cp1252"), {"b"}) == ("windows-1252", ",")


def test_zip_in_zip(spark, tmp_path):
    doc = '{"points": [{"id": "a", "location": [1.0, 2.0], "jobs": 1, "residents": 2}], "pops": [{"id": "p", "size": 3, "residenceId": "a", "jobId": "b"}]}'
    with zipfile.ZipFile(tmp_path / "in.zip", "w") as z:
        z.writestr("demand_data.json", doc)
    with zipfile.ZipFile(tmp_path / "map.zip", "w") as z:
        z.write(tmp_path / "in.zip", "in.zip")
    points, pops = readers.read_demand_package(spark, str(tmp_path / "map.zip"))
    bad = {r["rule"]: r["violations"] for r in readers.demand_violations(points, pops).collect()}
    assert points.count() == 1 and bad["unknown job"] == 1 and sum(bad.values()) == 1


def test_package_bytes_are_stable(spark, tmp_path):
    rows = [("m", "b.json", "{}"), ("m", "a.json", "[]")]
    a = writers.packaged(spark.createDataFrame(rows, "package string, name string, value string")).first()
    b = writers.packaged(spark.createDataFrame(rows[::-1], "package string, name string, value string")).first()
    (tmp_path / "m.zip").write_bytes(bytes(a["content"]))
    assert a["sha256"] == b["sha256"] and zipfile.ZipFile(tmp_path / "m.zip").namelist() == ["a.json", "b.json"]


def test_ledger(spark):
    rows = [(1, "a", "x", 5), (2, "a", None, 5), (3, None, "x", 5), (4, None, None, 5), (5, "b", "y", 6), (6, "c", "y", 7)]
    df = spark.createDataFrame(rows, "n int, clee string, id string, v int")
    assert sorted(r["n"] for r in relational.ledger(df, ["clee", "id"], "n").collect()) == [1, 4, 5]
    bad = relational.ledger_conflicts(df, [F.col("clee"), F.col("id")], ["v"]).collect()
    assert [(r["k"], r["values"]) for r in bad] == [(1, 2)]


def test_many_to_one_refuses(spark):
    left, right = spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(1, 2), (1, 3)], "k int, v int")
    with pytest.raises(Exception, match="not unique"):
        relational.many_to_one(left, right, ["k"]).collect()


def test_long_chain_settles(spark):
    nodes = spark.range(70)
    edges = spark.range(69).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert graph.components(nodes, edges).select("component").distinct().count() == 1


def test_calibration_statuses(spark):
    units = [("none", 900, True), ("none", 100, False), ("few", 100, True), ("mid", 400, True), ("mid", 400, False), ("low", 400, True), ("low", 400, False), ("top", 400, True), ("top", 400, False), ("full", 100, True), ("full", 900, False), ("zero", 400, True), ("zero", 400, False)]
    control = spark.createDataFrame([("few", 500.0), ("mid", 900.0), ("low", 700.0), ("top", 5000.0), ("full", 800.0), ("zero", 0.0)], "g string, control double")
    got = {r["g"]: (r["status"], round(r["factor"], 4)) for r in calibrate.asymmetric_employment(spark.createDataFrame(units, "g string, jobs int, is_micro boolean"), control, group="g", informal=0.45).collect()}
    assert got == {"none": ("fallback", 1.45), "few": ("fallback", 1.45), "mid": ("calibrated", 1.25), "low": ("floor", 1.0), "top": ("ceiling", 1.8182), "full": ("formal excess", 1.0), "zero": ("global", 1.45)}


@pytest.mark.parametrize("name, key", [("Super Manzana 23", "supermanzana23"), ("S.M. 23", "supermanzana23"), ("sm23", "supermanzana23"), ("23B", "supermanzana23b"), ("Región 94", "region94"), ("Reg. 94", "region94"), ("Col. Peña", "peña"), ("Colonia Pena", "pena"), ("Smith", "smith"), ("Regional", "regional"), ("Fracc. Los Álamos", "losalamos")])
def test_place_key(spark, name, key):
    assert spark.createDataFrame([(name,)], "n string").select(S.place_key(F.col("n"))).first()[0] == key


def test_title_of_a_very_long_word(spark):
    word = "ab" * 1000
    row = spark.createDataFrame([(word,)], "n string").select(S.title_case(F.col("n")), toponymy.spanish_title(F.col("n"))).first()
    assert row[0] == row[1] == "A" + word[1:]


def test_geodesic(spark):
    # Flinders Peak to Buninyon, the usual check of the formula (on WGS84).
    row = spark.range(1).select(G.geodesic(F.lit(144.42486788888888), F.lit(-37.95103341666667), F.lit(143.92649552777777), F.lit(-37.65282113888889))).first()
    assert row[0] == pytest.approx(54972.271, abs=0.02)


def loop_dedup(rows, metres=500.0):
    rows = sorted(rows, key=lambda r: r["seq"])
    gone = {}

    def same(a, b):
        for k in toponymy.TERRITORY:
            if a[k] and b[k] and a[k] != b[k]:
                return False
        for k in ("feature_kind", "official_code"):
            if a[k] and b[k] and a[k] != b[k]:
                return False
        close = sites.great_circle((a["lon"], a["lat"]), (b["lon"], b["lat"])) * 6371000 / 6371008.8 <= metres
        strong = (a["id"] and a["id"] == b["id"]) or (a["official_code"] and a["official_code"] == b["official_code"])
        return close and bool(strong or a["key"] == b["key"])

    for i, a in enumerate(rows):
        if a["seq"] in gone:
            continue
        for b in rows[i + 1 :]:
            if b["seq"] in gone or not same(a, b):
                continue
            if toponymy.SOURCE_RANKS.get(b["source"], 0) > toponymy.SOURCE_RANKS.get(a["source"], 0):
                gone[a["seq"]] = b["seq"]
                break
            gone[b["seq"]] = a["seq"]
    return {r["seq"]: gone.get(r["seq"]) for r in rows}


def test_spatial_dedup(spark):
    p = plans.places(spark, "/root/testdata/sf0.01")
    assert {r["seq"]: r["dropped_for"] for r in toponymy.spatial_dedup(p).collect()} == loop_dedup(p.collect())


def test_duplicate_groups(spark):
    rows = [(1, "La Toscana", -86.85, 21.16, 10.0), (2, "Supermanzana 15", -86.83, 21.15, 5.0), (3, "La Toscana", -86.851, 21.1605, 20.0), (4, "Colonia Toscana Real", -86.8505, 21.1602, 1.0), (5, "toscana real", -86.8506, 21.1603, 2.0), (6, "Supermanzana 16", -86.8301, 21.1501, 5.0), (7, "La Toscana", -80.0, 21.0, 99.0)]
    p = spark.createDataFrame(rows, "seq long, name string, lon double, lat double, score double")
    p = p.withColumns({c: F.lit(None).cast("string") for c in ("feature_kind", "official_code", *toponymy.TERRITORY)})
    got = {(r["seq"], r["grp"], r["kind"], r["winner"]) for r in toponymy.duplicate_groups(p, 2000.0).collect()}
    assert got == {(1, 1, "EXACT", 3), (3, 1, "EXACT", 3), (4, 4, "FUZZY", 5), (5, 4, "FUZZY", 5)}


def test_clusters_and_groups(spark):
    points = [(1, 0, 0.0, 0.0, 100.0, False), (2, 0, 0.0005, 0.0, 50.0, False), (3, 0, 0.0006, 0.0, 10.0, False), (4, 0, 0.0, 0.0, 5.0, True), (5, 0, 1.0, 0.0, 5.0, False)]
    p = spark.createDataFrame(points, "id long, zone int, lon double, lat double, size double, special boolean")
    commutes = spark.createDataFrame([(1, 3)], "a long, b long")
    got = {r["id"]: r["site"] for r in sites.cluster_points(p, commutes).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}  # 3 commutes to 1
    rows = spark.createDataFrame([(1, 0, None, 1, 0.0, 0.0, 30), (2, 0, None, 1, 0.001, 0.0, 7), (3, 0, None, 1, 0.002, 0.0, 5), (4, 0, None, 1, 1.0, 0.0, 4)], "id long, zone int, component int, municipality int, lon double, lat double, travellers long")
    groups = {}
    for r in sites.fixed_groups(rows, 20).collect():
        groups.setdefault(r["grp"], {})[r["id"]] = r["taken"]
    assert sorted(map(str, groups.values())) == sorted(map(str, [{1: 20}, {1: 10, 2: 7, 3: 3}, {3: 2}, {4: 4}]))


def test_near_pairs_miss_nothing(spark):
    rng = random.Random(3)
    rows = [(k, rng.uniform(-0.05, 0.05) + 20, rng.uniform(59.95, 60.05)) for k in range(150)]
    df = spark.createDataFrame(rows, "seq long, lon double, lat double")
    got = {(r["a"], r["b"]) for r in toponymy.near_pairs(df, 1500.0).select(F.col("l.seq").alias("a"), F.col("r.seq").alias("b")).collect()}
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and sites.great_circle(a[1:], b[1:]) * 6371000 / 6371008.8 <= 1500}
    assert got == want


def test_income_band_conflict(spark):
    df = spark.createDataFrame([(500, 6)], "i int, b int")
    with pytest.raises(Exception, match="positive income"):
        df.select(audit.income_status(F.col("i"), F.col("b"))).collect()


def test_streams(spark, tmp_path):
    rows = [(k, f"2024-01-01 {k % 24:02}:00:00", "ab"[k % 2], float(k)) for k in range(48)]
    df = spark.createDataFrame(rows, "event_id long, t string, event_type string, value double").withColumn("ts", F.to_timestamp("t"))
    df.unionByName(df.where("event_id < 5")).select("event_id", "ts", "event_type", "value").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id long, ts timestamp, event_type string, value double").parquet(str(tmp_path / "in"))
    for name, out, mode in (("counts", events.windowed_counts(stream), "complete"), ("first", events.first_seen(stream, "event_id"), "append")):
        out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination(120)
    assert spark.table("counts").agg(F.sum("n")).first()[0] == 53 and spark.table("counts").count() == 8
    assert spark.table("first").count() == 48
