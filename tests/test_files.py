"""Shapefiles and workbooks: what other programs write, odd records, several partitions."""

import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from terrane.sources import official, vectors, workbooks


@pytest.fixture
def polygons(spark):
    ring = lambda x: [(x, 0.0), (x + 2, 0.0), (x + 2, 2.0), (x, 2.0)]
    rows = [(str(k), "ñ" * (k % 4), None if k == 3 else [] if k == 5 else [ring(float(k)), [(k + 0.5, 0.5), (k + 0.5, 1.5), (k + 1.5, 1.5), (k + 1.5, 0.5)]]) for k in range(40)]
    return spark.createDataFrame(rows, "id string, `long attribute name` string, rings array<array<struct<x: double, y: double>>>")


def test_shapefile_round_trip(spark, polygons, tmp_path):
    vectors.write_shapefile(polygons.repartition(2), str(tmp_path))
    back = vectors.read_shapefile(spark, f"file://{tmp_path}", rows=6)
    assert back.rdd.getNumPartitions() >= 7 and back.columns == ["file", "record", "shape", "rings", "ID", "LONG ATTRI"]
    want = {r["id"]: ([tuple(tuple(p) for p in x) for x in r["rings"]] if r["rings"] else None, r["long attribute name"] or None) for r in polygons.collect()}
    got = {r["ID"]: ([tuple(tuple(p) for p in x) for x in r["rings"]] if r["rings"] else None, r["LONG ATTRI"]) for r in back.collect()}
    assert got == want and back.where("shape = 0").count() == 2
    assert {(r["file"], r["record"]) for r in back.collect()} == {(r["file"], k) for r in back.select("file").distinct().collect() for k in range(back.where(F.col("file") == r["file"]).count())}


def test_empty_shapefiles(spark, polygons, tmp_path):
    vectors.write_shapefile(polygons.limit(0), str(tmp_path))
    assert vectors.read_shapefile(spark, str(tmp_path)).collect() == []


def test_other_shapes(spark, tmp_path):
    """A point, a point with height, a line of two parts, points, a null shape, without attributes."""
    box = struct.pack("<4d", 0, 0, 1, 1)
    line = struct.pack("<i", 3) + box + struct.pack("<2i2i", 2, 4, 0, 2) + struct.pack("<8d", *range(8))
    records = [struct.pack("<i2d", 1, 3, 4), struct.pack("<i4d", 11, 5, 6, 7, 8), line, struct.pack("<i", 8) + box + struct.pack("<i4d", 2, 1, 2, 3, 4), struct.pack("<i", 0)]
    shp, shx, at = b"\0" * 100, b"\0" * 100, 100
    for k, r in enumerate(records):
        shp += struct.pack(">2i", k + 1, len(r) // 2) + r
        shx += struct.pack(">2i", at // 2, len(r) // 2)
        at += 8 + len(r)
    (tmp_path / "x.shp").write_bytes(shp)
    (tmp_path / "x.shx").write_bytes(shx)
    got = [(r["record"], r["shape"], r["rings"] and [[tuple(p) for p in x] for x in r["rings"]]) for r in vectors.read_shapefile(spark, str(tmp_path / "x.shp"), rows=2).orderBy("record").collect()]
    assert got == [(0, 1, [[(3, 4)]]), (1, 1, [[(5, 6)]]), (2, 3, [[(0, 1), (2, 3)], [(4, 5), (6, 7)]]), (3, 8, [[(1, 2)], [(3, 4)]]), (4, 0, None)]


def test_area_layers(spark):
    cup = [[(-86.86, 21.14), (-86.82, 21.14), (-86.82, 21.18), (-86.83, 21.18), (-86.83, 21.15), (-86.85, 21.15), (-86.85, 21.18), (-86.86, 21.18)]]
    schema = "file string, record long, shape int, rings array<array<struct<x: double, y: double>>>, CVEGEO string, ENTIDAD string, MUN string, LOC string"
    rows = [("f", 0, 5, cup, "2300500010001", None, None, None), ("f", 1, 5, cup, "bad", "23", "5", "1"), ("f", 2, 0, None, "2300500010002", None, None, None), ("f", 3, 5, cup, "2300500010001", None, None, None)]
    points, outcome = vectors.area_points(spark.createDataFrame(rows, schema))
    (p,) = points.collect()
    assert (p["municipality"], p["loc"], p["ageb"]) == ("23005", "0001", "0001") and p["lon"] in (pytest.approx(-86.855), pytest.approx(-86.825)) and 21.15 < p["lat"] < 21.18
    assert tuple(outcome.first()) == ("ageb", 2, 1, 1)


def test_workbooks_as_others_write_them(spark, tmp_path):
    """Two sheets in an order of their own, gaps, inline and rich text, numbers with and without a point, booleans, errors."""
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{rel}"><sheets><sheet name="Zwei" r:id="b"/><sheet name="Eins" r:id="a"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="a" Target="worksheets/s1.xml"/><Relationship Id="b" Target="/xl/worksheets/s2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>one &amp; only</t></si><si><r><t>ri</t></r><r><t>ch</t></r><rPh><t>aid</t></rPh></si></sst>")
        z.writestr("xl/worksheets/s1.xml", f'<worksheet {main}><sheetData><row r="2"><c r="A2" t="s"><v>0</v></c><c r="AB2" t="s"><v>1</v></c></row><row r="5"><c r="B5"><v>1.0</v></c><c r="C5"><v>2.50</v></c><c r="D5" t="b"><v>1</v></c><c r="E5" t="inlineStr"><is><t>in</t></is></c><c r="F5" t="str"><v>007</v></c><c r="G5"><v>1E-3</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/s2.xml", f"<worksheet {main}><sheetData><row><c><v>3</v></c></row><row/></sheetData></worksheet>")
    df = workbooks.read_workbooks(spark, str(tmp_path / "b.xlsx"))
    got = {(r["sheet"], r["n"]): r["fields"] for r in df.collect()}
    assert got == {("Zwei", 0): ["3"], ("Zwei", 1): [], ("Eins", 1): ["one & only", *[""] * 26, "rich"], ("Eins", 4): ["", "1", "2.5", "TRUE", "in", "007", "0.001"]}
    assert df.rdd.getNumPartitions() == 2 and workbooks.read_workbooks(spark, str(tmp_path), "Zwei").count() == 2
    assert official.file_rows(spark, str(tmp_path / "b.xlsx")).count() == 4
