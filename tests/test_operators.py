"""Literal fixtures with known results."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from terrane.functions import scalars as S
from terrane.operators import aggregates, allocation, calibrate, flows, graph
from terrane.sources import scratch


def test_municipality_codes(spark):
    rows = spark.createDataFrame([("1001", "01"), ("5", "1"), ("23005.0", None), ("invalid", "23")], "m string, e string")
    assert [r[0] for r in rows.select(S.municipality_code(F.col("m"), F.col("e"))).collect()] == ["01001", "01005", "23005", "-1"]


def test_calibration_factor(spark):
    units = spark.createDataFrame([("a", 100, True), ("a", 200, False), ("b", 50, True), ("b", 500, False)], "g string, jobs int, is_micro boolean")
    control = spark.createDataFrame([("a", 350), ("b", 400)], "g string, control int")
    got = {r["g"]: (r["factor"], r["status"]) for r in calibrate.asymmetric(units, control, group="g", informal=0.45, least=1).collect()}
    assert got == {"a": (1.5, "calibrated"), "b": (1.0, "formal excess")}


def test_bounded_fit_meets_target(spark):
    rows = [("g", 2.24, 0.0, 5.0), ("g", 71.41, 51.0, 100.0), ("g", 450.0, 251.0, float("inf"))]
    df = spark.createDataFrame(rows, "g string, prior double, lo double, hi double")
    r = calibrate.bounded_fit(df, spark.createDataFrame([("g", 310.0)], "g string, target double"), group="g").first()
    assert r["factor"] < 1
    assert sum(min(max(p * r["factor"], lo), hi) for _, p, lo, hi in rows) == pytest.approx(310)


def test_weighted_quantiles(spark):
    df = spark.createDataFrame([(4, 100), (8, 200), (12, 300), (20, 400)], "v int, w int")
    assert aggregates.weighted_quantiles(df, [], "v", "w", (0.25, 0.5, 0.75)).first().asDict() == {"p25": 8, "p50": 12, "p75": 20}


def test_transport(spark):
    cells = spark.createDataFrame([(1, "a", "c", 8, 1.0), (1, "a", "d", 0, 1.0), (1, "b", "d", 2, 1.0)], "zone int, o string, d string, proposal long, distance double")
    out = spark.createDataFrame([(1, "a", 8), (1, "b", 2)], "zone int, o string, out long")
    into = spark.createDataFrame([(1, "c", 5.0), (1, "d", 5.0)], "zone int, d string, target double")
    got = {(r["o"], r["d"]): r["flow"] for r in allocation.integer_transport(cells, out, into).collect()}
    assert got == {("a", "c"): 5, ("a", "d"): 3, ("b", "d"): 2}


def test_ipf_to_a_tolerance(spark):
    edges = spark.createDataFrame([(o, d, 1.0 + (o * 7 + d * 3) % 5) for o in range(8) for d in range(6)] + [(0, 99, 1.0)], "o int, d int, w double")
    out = spark.createDataFrame([(o, 10.0 + o) for o in range(8)], "o int, out double")
    into = spark.createDataFrame([(d, sum(10.0 + o for o in range(8)) * (d + 1) / 21) for d in range(6)] + [(98, 5.0)], "d int, `in` double")
    got = flows.ipf(edges, out, into, rounds=200, tolerance=1e-10).collect()
    rows, columns = {}, {}
    for r in got:
        rows[r["o"]] = rows.get(r["o"], 0) + r["flow"]
        columns[r["d"]] = columns.get(r["d"], 0) + r["flow"]
    assert rows == {r["o"]: pytest.approx(r["out"]) for r in out.collect()}
    assert columns == {r["d"]: pytest.approx(r["in"], rel=1e-9) for r in into.where("d < 98").collect()}


def test_loops_leave_one_table_of_each_name(spark):
    nodes = spark.range(40).select("id")
    edges = spark.range(39).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    with scratch.released():
        assert {r["component"] for r in graph.components(nodes, edges).collect()} == {0}
        (work,) = scratch.Rounds.made[-1:]
        assert work.n > 2 and len(list(Path(work.root.removeprefix("file:")).iterdir())) == 1
    assert not Path(work.root.removeprefix("file:")).exists()
