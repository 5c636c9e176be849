"""Entropy allocation at its optimum: prices of destinations and groups from the convex dual.

Flows of an origin are its budget shared by exp(score - price of the destination -
price of the group). The dual's loss, summed over origins, is
    budget * ln sum exp(...)  +  target * v  +  reliability * goal * exp(w / reliability)
with prices v within 15 of zero and w within 15 times the reliability. Its gradient is
what a destination lacks of its target, and a group of its softened goal. Prices are a
table of nodes and groups, written once a round; only that table and sums of it move.
Limited-memory BFGS directions come from the scalar products of the last steps, all of
them in one aggregation, so no vector of prices is held on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.sources.scratch import Rounds

MEMORY, MOST_PRICE, LEAST_STEP = 6, 15.0, 1e-10


class Problem(Protocol):
    """Where flows come from: both ways give the same sums."""

    work: Rounds

    def sums(self, prices: DataFrame, curvature: bool = False) -> tuple[DataFrame, float]:
        """(kind, id, total, curvature) of destinations (d) and groups (g) at some prices (kind, id, x), and the origins' part of the loss."""

    def flows(self, prices: DataFrame) -> DataFrame:
        """(o, d, flow)."""


@dataclass
class Edges:
    """Permitted pairs as a table: (o, d, g, score, budget). A round is two joins with prices and two aggregations."""

    pairs: DataFrame
    work: Rounds = field(init=False)

    def __post_init__(self):
        self.work = Rounds(self.pairs.sparkSession, "dual")
        top = self.pairs.groupBy("o").agg(F.max("score").alias("_m"))
        shifted = self.pairs.join(top, "o").select("o", F.col("d").cast("string").alias("d"), F.col("g").cast("string").alias("g"), (F.col("score") - F.col("_m")).alias("s"), F.col("_m").alias("m"), "budget")
        self.edges = self.work.keep("edges", shifted)

    def _weights(self, prices: DataFrame) -> tuple[DataFrame, DataFrame]:
        v, w = (prices.where(F.col("kind") == k).select(F.col("id").alias(k), F.col("x").alias(f"p{k}")) for k in ("d", "g"))
        e = self.edges.join(v, "d").join(w, "g").withColumn("e", F.exp(F.col("s") - F.col("pd") - F.col("pg")))
        total = e.groupBy("o").agg(F.sum("e").alias("t"), F.first("budget").alias("budget"), F.first("m").alias("m"))
        return e, self.work.keep("totals", total)

    def sums(self, prices: DataFrame, curvature: bool = False) -> tuple[DataFrame, float]:
        e, total = self._weights(prices)
        loss = total.agg(F.sum(F.col("budget") * (F.ln("t") + F.col("m")))).first()[0] or 0.0
        f = e.join(total.select("o", "t"), "o").select("o", "d", "g", "budget", (F.col("e") / F.col("t") * F.col("budget")).alias("f"))
        both = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("id")) for k in ("d", "g")])).alias("n")
        rows = f.select("o", "budget", "f", both).select("o", "budget", "f", "n.*")
        if curvature:
            rows = rows.groupBy("o", "kind", "id").agg(F.sum("f").alias("f"), F.first("budget").alias("budget"))
        bent = F.col("f") * (1 - F.col("f") / F.col("budget")) if curvature else F.lit(0.0)
        return rows.groupBy("kind", "id").agg(F.sum("f").alias("total"), F.sum(bent).alias("curvature")), loss

    def flows(self, prices: DataFrame) -> DataFrame:
        e, total = self._weights(prices)
        return e.join(total.select("o", "t"), "o").select("o", "d", (F.col("e") / F.col("t") * F.col("budget")).alias("flow"))


#: Destinations that are broadcast at most: a few dozen MB of numbers.
MOST_DESTINATIONS = 1_000_000


@dataclass
class Blocks:
    """Every origin with every destination of its zone but itself, without a table of pairs.

    origins: (o, x, y, zone, place, budget); destinations: (d, x, y, zone, place, pull);
    place is a municipality, groups are `place of o>place of d`; score is
    ln(pull) - beta * distance. Batches of origins meet blocks of destinations in
    memory; what leaves a task are sums by destination and group. Destinations are
    broadcast, so there is a limit to them, beyond which Edges over a reach is the way.
    """

    origins: DataFrame
    destinations: DataFrame
    beta: float
    cells: int = 1 << 20  # pairs in memory at once
    work: Rounds = field(init=False)

    def __post_init__(self):
        n = self.destinations.where("pull > 0").count()
        if n > MOST_DESTINATIONS:
            raise ValueError(f"{n} destinations are too many for blocks: give pairs within a reach to Edges")
        self.work = Rounds(self.origins.sparkSession, "blocks")
        self.table = self.destinations.where("pull > 0").select(F.col("d").cast("string").alias("d"), *[F.col(c).cast("double").alias(c) for c in ("x", "y")], F.col("zone").cast("string").alias("zone"), F.col("place").cast("string").alias("place"), F.log("pull").alias("pull")).orderBy("d").toArrow()
        rows = self.origins.where("budget > 0").select("o", F.col("o").cast("string").alias("own"), *[F.col(c).cast("double").alias(c) for c in ("x", "y")], F.col("zone").cast("string").alias("zone"), F.col("place").cast("string").alias("place"), F.col("budget").cast("double").alias("budget"))
        self.rows = self.work.keep("origins", rows)

    def _held(self, prices: DataFrame | None):
        """What every task needs, broadcast: the destinations with their prices; groups by place of origin."""
        t = self.table
        names, zones, places = (np.array(t.column(c).to_pylist(), dtype=object) for c in ("d", "zone", "place"))
        price, groups = np.zeros(len(names)), {}
        if prices is not None:
            p = prices.select("kind", "id", "x").toArrow()
            kind, ident, x = p.column("kind").to_pylist(), p.column("id").to_pylist(), p.column("x").to_pylist()
            by = {(k, i): v for k, i, v in zip(kind, ident, x, strict=True)}
            price = np.array([by.get(("d", n), 0.0) for n in names])
            groups = {i: v for (k, i), v in by.items() if k == "g"}
        place_names, place_of = np.unique(places.astype(str), return_inverse=True) if len(places) else (np.zeros(0, str), np.zeros(0, int))
        return self.origins.sparkSession.sparkContext.broadcast((names, zones, place_names, place_of, t.column("x").to_numpy(), t.column("y").to_numpy(), t.column("pull").to_numpy() - price, groups))

    def _run(self, prices: DataFrame | None, visit, schema: str) -> DataFrame:
        """visit(origins' columns, shares (origin x destination, adding up to one), ln of the origins' sums, held, state) for some origins at a time, and once at the end with None."""
        held, beta, cells = self._held(prices), self.beta, self.cells

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, zones, place_names, place_of, x, y, pull, groups = held.value
            step, state = max(1, cells // max(1, len(names))), {}
            for b in batches:
                for lo in range(0, b.num_rows, step):
                    o = {c: b.slice(lo, step).column(c) for c in b.schema.names}
                    place = o["place"].to_pylist()
                    w = np.array([[groups.get(f"{a}>{c}", 0.0) for c in place_names] for a in place]).reshape(len(place), -1)
                    s = pull - beta * np.hypot(o["x"].to_numpy()[:, None] - x, o["y"].to_numpy()[:, None] - y) - w[:, place_of]
                    own, zone = (np.array(o[c].to_pylist(), dtype=object)[:, None] for c in ("own", "zone"))
                    s[(zone != zones) | (own == names)] = -np.inf
                    top = s.max(1, initial=-np.inf)
                    if np.isneginf(top).any():
                        raise ValueError(f"origin {o['own'][int(np.isneginf(top).argmax())]} has no permitted destination")
                    e = np.exp(s - top[:, None])
                    total = e.sum(1)
                    yield from visit(o, e / total[:, None], np.log(total) + top, held.value, state)
            yield from visit(None, None, None, held.value, state)

        return self.rows.mapInArrow(run, schema)

    def sums(self, prices: DataFrame | None, curvature: bool = False) -> tuple[DataFrame, float]:
        def visit(o, share, log_sum, held, state):
            names, _, place_names, place_of = held[:4]
            if o is not None:
                budget = o["budget"].to_numpy()
                f = share * budget[:, None]
                if not state:
                    state |= {"loss": 0.0, "d": np.zeros((2, len(names))), "g": {}}
                state["loss"] += float(budget @ log_sum)
                state["d"] += f.sum(0), (f * (1 - share)).sum(0)
                by_place = np.stack([np.bincount(place_of, row, len(place_names)) for row in f])
                for k, a in enumerate(o["place"].to_pylist()):
                    own = state["g"].setdefault(a, np.zeros((2, len(place_names))))
                    own += by_place[k], by_place[k] * (1 - by_place[k] / budget[k])
            elif state:
                rows = [("loss", "", state["loss"], 0.0), *(("d", n, a, c) for n, a, c in zip(names, *state["d"], strict=True))]
                rows += [("g", f"{a}>{c}", s, t) for a, both in state["g"].items() for c, s, t in zip(place_names, *both, strict=True) if s > 0]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["kind", "id", "total", "curvature"])

        part = self._run(prices, visit, "kind string, id string, total double, curvature double")
        out = self.work.keep("sums", part.groupBy("kind", "id").agg(F.sum("total").alias("total"), F.sum("curvature").alias("curvature")))
        loss = out.where("kind = 'loss'").first()
        return out.where("kind <> 'loss'"), loss["total"] if loss else 0.0

    def flows(self, prices: DataFrame | None) -> DataFrame:
        kind = self.rows.schema["o"].dataType.simpleString()

        def visit(o, share, log_sum, held, state):
            if o is not None:
                f = share * o["budget"].to_numpy()[:, None]
                i, j = np.nonzero(f)
                yield pa.RecordBatch.from_arrays([o["o"].take(pa.array(i)), pa.array(held[0][j].tolist(), pa.string()), pa.array(f[i, j])], ["o", "d", "flow"])

        return self._run(prices, visit, f"o {kind}, d string, flow double")


@dataclass
class Fit:
    prices: DataFrame  # kind, id, x
    loss: float
    gradient: float  # largest entry over all travellers, what bounds hold back left out
    rounds: int


def fit(problem: Problem, targets: DataFrame, groups: DataFrame, *, tolerance: float = 1e-7, rounds: int = 200) -> Fit:
    """Prices at the optimum. targets: (d, target > 0); groups: (g, goal, reliability).

    Ends when no gradient entry passes the tolerance (of all travellers); raises if it
    does not get there.
    """
    work = problem.work
    kind = lambda df, k, a, b: df.select(F.lit(k).alias("kind"), F.col(k).cast("string").alias("id"), a.cast("double").alias("target"), b.cast("double").alias("r"))
    nodes = kind(targets, "d", F.col("target"), F.lit(1.0)).unionByName(kind(groups, "g", F.col("goal"), F.col("reliability")))
    limit = MOST_PRICE * F.col("r")
    soft = F.col("kind") == "g"
    mass = targets.agg(F.sum("target")).first()[0] or 1.0

    def evaluated(name: str, at: DataFrame, curvature: bool = False) -> tuple[DataFrame, float]:
        """The table with g (and c) at its prices x, and the loss."""
        sums, loss = problem.sums(at.select("kind", "id", "x"), curvature)
        grown = F.col("target") * F.exp(F.col("x") / F.col("r"))
        own = F.when(soft, F.col("r") * grown).otherwise(F.col("target") * F.col("x"))
        new = at.drop("g", "own").join(sums, ["kind", "id"], "left").withColumn("total", F.coalesce("total", F.lit(0.0)))
        new = new.withColumn("g", (F.when(soft, grown).otherwise(F.col("target")) - F.col("total")) / mass).withColumn("own", own)
        if curvature:
            bent = F.coalesce("curvature", F.lit(0.0)) + F.when(soft, grown / F.col("r")).otherwise(0.0)
            new = new.withColumn("scale", F.sqrt(F.greatest(bent / mass, F.lit(1e-12))))
        new = work.keep(name, new.drop("total", "curvature"))
        return new, (loss + (new.agg(F.sum("own")).first()[0] or 0.0)) / mass

    # One step of scaling starts the prices near their places: half a step for destinations.
    start, _ = problem.sums(nodes.withColumn("x", F.lit(0.0)).select("kind", "id", "x"))
    start = work.keep("start", start)
    off = F.ln(F.greatest("total", F.lit(1e-12)) / F.greatest("target", F.lit(1e-12)))
    first = F.when(soft, F.col("r") / (1 + F.col("r")) * off).otherwise(0.5 * off)
    at = nodes.join(start, ["kind", "id"], "left").fillna(0.0, ["total"]).withColumn("x", F.least(F.greatest(first, -limit), limit)).select("kind", "id", "target", "r", "x")
    state, loss = evaluated("state", at, curvature=True)
    steps, n = 0, 0
    names: list[str] = []  # pairs of columns of the last steps, oldest first
    while True:
        held = ((F.col("x") <= -limit) & (F.col("g") > 0)) | ((F.col("x") >= limit) & (F.col("g") < 0))
        state = state.withColumn("gz", F.when(held, 0.0).otherwise(F.col("g") / F.col("scale")))
        columns = [f"{c}{k}" for k in names for c in ("s", "y")] + ["gz"]
        products = [F.sum(F.col(a) * F.col(b)).alias(f"{a}*{b}") for i, a in enumerate(columns) for b in columns[i:]]
        row = state.agg(F.max(F.abs(F.col("gz") * F.col("scale"))).alias("top"), *products).first()
        if row["top"] is None or row["top"] <= tolerance:
            return Fit(state.select("kind", "id", "x"), loss, row["top"] or 0.0, n)
        if n >= rounds:
            raise ValueError(f"no optimum after {n} rounds: gradient {row['top']:.2e}, tolerance {tolerance:.0e}")
        dot = lambda a, b, row=row, columns=columns: row[f"{a}*{b}"] if columns.index(a) <= columns.index(b) else row[f"{b}*{a}"]
        direction = two_loops(names, columns, dot)
        move = sum((F.lit(direction[c]) * F.col(c) for c in columns), F.lit(0.0))
        state = state.withColumn("p", F.when(held, 0.0).otherwise(move / F.col("scale")))
        slope, step = sum(direction[c] * dot(c, "gz") for c in columns), 1.0
        if slope >= 0:  # no way down in what is remembered
            names, state = [], state.drop(*[c for c in columns if c != "gz"])
            continue
        while True:
            x = F.least(F.greatest(F.col("x") + step * F.col("p"), -limit), limit)
            moved, after = evaluated("moved", state.select("kind", "id", "target", "r", "scale", x.alias("x")))
            n += 1
            if after <= loss + 1e-4 * step * slope or step * abs(slope) < LEAST_STEP * max(1.0, abs(loss)):
                break
            step /= 4
        steps += 1
        new = str(steps)
        old = state.select("kind", "id", F.col("x").alias("_x"), F.col("g").alias("_g"), *[c for k in names[-(MEMORY - 1) :] for c in (f"s{k}", f"y{k}")])
        grown = moved.join(old, ["kind", "id"]).withColumn(f"s{new}", (F.col("x") - F.col("_x")) * F.col("scale")).withColumn(f"y{new}", (F.col("g") - F.col("_g")) / F.col("scale")).drop("_x", "_g")
        state, loss, names = work.keep("state", grown), after, [*names[-(MEMORY - 1) :], new]


def two_loops(names: list[str], columns: list[str], dot) -> dict[str, float]:
    """The L-BFGS direction as weights of the columns (steps s, changes y, gradient gz), from their scalar products alone."""
    q = dict.fromkeys(columns, 0.0)
    q["gz"] = 1.0
    with_q = lambda c: sum(w * dot(a, c) for a, w in q.items() if w)
    used, alpha = [k for k in names if dot(f"s{k}", f"y{k}") > 1e-300], {}
    for k in reversed(used):
        alpha[k] = with_q(f"s{k}") / dot(f"s{k}", f"y{k}")
        q[f"y{k}"] -= alpha[k]
    if used:
        k = used[-1]
        size = dot(f"s{k}", f"y{k}") / dot(f"y{k}", f"y{k}")
        q = {a: w * size for a, w in q.items()}
    for k in used:
        q[f"s{k}"] += alpha[k] - with_q(f"y{k}") / dot(f"s{k}", f"y{k}")
    return {a: -w for a, w in q.items()}
