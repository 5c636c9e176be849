"""Controlled rounding against enumeration, and its bounds on larger tables."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from terrane.operators import rounding

SCHEMA = "g string, i int, j string, value double"


def tables(rng, groups, most):
    """Tables whose rows add up to whole numbers; some cells whole, some rows empty."""
    out = []
    for g in range(groups):
        columns = rng.randint(1, most)
        for i in range(rng.randint(1, most)):
            w = [rng.choice([0, 1, 2, 3, 5]) for _ in range(columns)]
            total, n = sum(w), rng.randint(0, 6)
            out += [(f"g{g}", i, f"c{j}", n * x / total if total else float(n if j == 0 else 0)) for j, x in enumerate(w)]
    return out


def check(rows, got):
    value = {(g, i, j): v for g, i, j, v in rows}
    units = {(r["g"], r["i"], r["j"]): r["units"] for r in got}
    assert units.keys() == value.keys()
    for sums in (lambda k: k, lambda k: k[:2], lambda k: (k[0], k[2])):
        a, b = {}, {}
        for k, v in value.items():
            a[sums(k)] = a.get(sums(k), 0) + v
            b[sums(k)] = b.get(sums(k), 0) + units[k]
        assert all(math.floor(v + 1e-9) <= b[k] <= math.ceil(v - 1e-9) for k, v in a.items())
    return value, units


def test_bounds_and_margins(spark):
    rows = tables(random.Random(5), 25, 7)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    value, units = check(rows, rounding.controlled(df).collect())
    most = {r["g"]: r["bound"] for r in rounding.bound(df).collect()}
    for g in most:
        assert sum(abs(units[k] - v) for k, v in value.items() if k[0] == g) <= most[g] + 1e-9


def test_against_enumeration(spark):
    """All roundings of small tables within the bounds: the cost of the one chosen is at most the bound, which the best one meets too."""
    rows = tables(random.Random(2), 12, 3)
    value, units = check(rows, rounding.controlled(spark.createDataFrame(rows, SCHEMA)).collect())
    for g in {k[0] for k in value}:
        own = {k: v for k, v in value.items() if k[0] == g}
        keys = sorted(own)
        costs = []
        for choice in itertools.product(*[sorted({math.floor(own[k] + 1e-9), math.ceil(own[k] - 1e-9)}) for k in keys]):
            u = dict(zip(keys, choice, strict=True))
            rows_ok = all(sum(u[k] for k in keys if k[1] == i) == round(sum(own[k] for k in keys if k[1] == i)) for i in {k[1] for k in keys})
            columns_ok = all(math.floor(s + 1e-9) <= sum(u[k] for k in keys if k[2] == j) <= math.ceil(s - 1e-9) for j in {k[2] for k in keys} for s in [sum(own[k] for k in keys if k[2] == j)])
            if rows_ok and columns_ok:
                costs.append(sum(abs(u[k] - own[k]) for k in keys))
        mine = sum(abs(units[k] - own[k]) for k in keys)
        fractions = [v - math.floor(v + 1e-9) for v in own.values()] + [s - math.floor(s + 1e-9) for j in {k[2] for k in keys} for s in [sum(own[k] for k in keys if k[2] == j)]]
        assert min(costs) - 1e-9 <= mine <= sum(2 * max(f, 0) * (1 - f) for f in fractions) + 1e-9


def test_whole_and_empty_tables(spark):
    whole = spark.createDataFrame([("g", 1, "a", 2.0), ("g", 1, "b", 0.0)], SCHEMA)
    assert {(r["j"], r["units"]) for r in rounding.controlled(whole).collect()} == {("a", 2), ("b", 0)}
    assert rounding.controlled(whole.where(F.lit(False))).collect() == []


@pytest.mark.parametrize("value", [0.25, 0.5])
def test_one_cell_of_a_row_rises(spark, value):
    n = round(1 / value)
    df = spark.createDataFrame([("g", i, f"c{j}", value) for i in range(n) for j in range(n)], SCHEMA)
    got = rounding.controlled(df).where("units = 1").collect()
    assert len(got) == n == len({r["i"] for r in got}) == len({r["j"] for r in got})
