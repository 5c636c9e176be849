"""Controlled rounding: every cell, row and column at the floor or ceiling of its value at once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.operators.graph import components

NEAR = 1e-9


def cancelled(parts: dict[tuple, float]) -> set[tuple]:
    """The cells (row, column) that go up, of fractions in (0, 1) whose rows and columns add up to whole numbers.

    Cells whose fraction is open form a graph in which no node has just one, so it
    holds a cycle; along it fractions move up and down in turn, in the direction that
    costs less (a cell's rise costs 1 - 2 fraction), until one is whole.
    """
    parts, up = dict(parts), set()
    cost = {c: 1 - 2 * f for c, f in parts.items()}
    near: dict[tuple, list] = {}
    for r, c in sorted(parts, key=repr):
        near.setdefault((0, r), []).append((1, c))
        near.setdefault((1, c), []).append((0, r))
    for start in list(near):
        path, place = [start], {start: 0}
        while True:
            here, before = path[-1], path[-2] if len(path) > 1 else None
            while near[here] and not is_open(parts, here, near[here][-1]):
                near[here].pop()
            after = next((x for x in reversed(near[here]) if x != before and is_open(parts, here, x)), None)
            if after is None:
                break  # nothing is open here: only at a start that is done
            if after not in place:
                place[after] = len(path)
                path.append(after)
                continue
            cycle = [*path[place[after] :], after]
            cells = [cell(a, b) for a, b in zip(cycle, cycle[1:], strict=False)]
            sign = 1 if sum(cost[c] * (-1) ** k for k, c in enumerate(cells)) <= 0 else -1
            room = [(1 - parts[c] if sign * (-1) ** k > 0 else parts[c]) for k, c in enumerate(cells)]
            step = min(room)
            for k, c in enumerate(cells):
                parts[c] += sign * (-1) ** k * step
                if room[k] - step <= NEAR:
                    if sign * (-1) ** k > 0:
                        up.add(c)
                    parts[c] = -1.0  # closed
            path, place = [start], {start: 0}
    return up


def cell(a: tuple, b: tuple) -> tuple:
    return (a[1], b[1]) if a[0] == 0 else (b[1], a[1])


def is_open(parts: dict, a: tuple, b: tuple) -> bool:
    return parts[cell(a, b)] >= 0


def controlled(cells: DataFrame) -> DataFrame:
    """(g, i, j, units) from (g, i, j, value >= 0), one row for a cell; rows i of a group g add up to whole numbers.

    A cell's units are the floor or ceiling of its value, a row's add up to its value, a
    column's to the floor or ceiling of its value. The rises cost no more than the
    fractions do, so the sum of |units - value| is at most that of 2 f (1 - f) over the
    cells' and columns' fractions f. Groups fall into components of cells with open
    fractions, which are rounded apart; columns with a fraction of their own hang together
    through one more row that fills them up. Cells near a whole number are whole.
    """
    base = F.floor(F.col("value") + NEAR).cast("long")
    rows = cells.select("g", "i", "j", base.alias("base"), F.greatest(F.col("value") - base, F.lit(0.0)).alias("f"))
    rows = rows.withColumn("f", F.when(F.col("f") > NEAR, F.col("f")).otherwise(0.0))
    column = rows.where("f > 0").groupBy("g", "j").agg(F.sum("f").alias("s"))
    gap = F.ceil(F.col("s") - NEAR) - F.col("s")
    kind = {c: rows.schema[c].dataType.simpleString() for c in "gij"}
    filler = column.where(gap > NEAR).select("g", F.lit(None).cast(kind["i"]).alias("i"), "j", gap.alias("f"))
    open_ = rows.where("f > 0").select("g", "i", "j", "f").unionByName(filler)
    end = lambda side: F.concat_ws("\x1f", F.lit(side), F.col("g").cast("string"), F.coalesce(F.col("i" if side == "r" else "j").cast("string"), F.lit("")))
    links = open_.select("g", "i", "j", "f", end("r").alias("a"), end("c").alias("b"))
    nodes = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).distinct()
    part = components(nodes, links.select("a", "b"))

    def solve(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for own in f["cells"]:
                parts = {((c["i"],), c["j"]): float(c["f"]) for c in own}
                g = own[0]["g"]
                out += [(g, i[0], j) for i, j in cancelled(parts) if i[0] is not None]
            yield pd.DataFrame(out, columns=["g", "i", "j"]).astype(object)

    grouped = links.join(part, links["a"] == part["id"]).groupBy("component").agg(F.array_sort(F.collect_list(F.struct("g", "i", "j", "f"))).alias("cells"))
    risen = grouped.select("cells").mapInPandas(solve, f"g {kind['g']}, i {kind['i']}, j {kind['j']}")
    return rows.join(risen.withColumn("_up", F.lit(1)), ["g", "i", "j"], "left").select("g", "i", "j", (F.col("base") + F.coalesce("_up", F.lit(0))).alias("units"))


def bound(cells: DataFrame) -> DataFrame:
    """(g, bound): what the sum of |units - value| of controlled() can't pass."""
    f = F.col("value") - F.floor(F.col("value") + NEAR)
    column = cells.groupBy("g", "j").agg(F.sum("value").alias("value"))
    return cells.select("g", "value").unionByName(column.select("g", "value")).groupBy("g").agg(F.sum(2 * F.greatest(f, F.lit(0.0)) * (1 - F.greatest(f, F.lit(0.0)))).alias("bound"))
