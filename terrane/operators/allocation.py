"""Allocation of travellers to workplaces: soft targets, entropy balance, margins, reservations, integer transport.

Everything is an edge list (o, d, ...) with origin and destination tables; dense
matrices never exist. Iterations keep factors of nodes, not of edges.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.sources.scratch import Rounds, settled

RELIABILITY = (0.1, 10.0)


def permitted(origins: DataFrame, destinations: DataFrame, forbidden: DataFrame, *, reach: float | None = None) -> DataFrame:
    """(o, d, distance): pairs of one zone and road component, at different places, within reach, not forbidden.

    origins: (o, x, y, zone, component), destinations: (d, dx, dy, zone, component); a
    null component of the origin matches any. Places are compared (with zone and
    component), whoever is there joins them; only destinations that the list of
    forbidden pairs names are looked up in it.
    """
    listed = Rounds(forbidden.sparkSession, "forbidden").keep("forbidden", forbidden.select("o", "d"))
    here, there = origins.select("x", "y", "zone", "component").distinct(), destinations.select("dx", "dy", "zone", "component").distinct()
    if reach is None:
        l, r, keys = here, there, ["zone"]
    else:  # what is within reach lies in the same cell or one beside it
        at = lambda x, y: {"_i": F.floor(F.col(x) / reach), "_j": F.floor(F.col(y) / reach)}
        around = F.explode(F.array(*[F.struct((F.col("_i") + i).alias("i"), (F.col("_j") + j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
        l = here.withColumns(at("x", "y")).withColumn("_c", around).withColumns({"_i": F.col("_c.i"), "_j": F.col("_c.j")})
        r, keys = there.withColumns(at("dx", "dy")), ["zone", "_i", "_j"]
    near = l.withColumnRenamed("component", "_own").join(r, keys).where(F.col("_own").isNull() | (F.col("_own") == F.col("component")))
    near = near.withColumn("distance", F.sqrt(F.pow(F.col("dx") - F.col("x"), 2) + F.pow(F.col("dy") - F.col("y"), 2))).where("distance > 0")
    near = near.where(F.col("distance") <= reach) if reach is not None else near
    near = near.repartition(int(near.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # few rows that become many
    starts = near.select("x", "y", "zone", "_own", "dx", "dy", "component", "distance").alias("n").join(origins.alias("p"), F.expr("n.x = p.x AND n.y = p.y AND n.zone = p.zone AND n._own <=> p.component")).select("n.*", "p.o")

    def reached(some: DataFrame) -> DataFrame:
        there = F.expr("n.dx = q.dx AND n.dy = q.dy AND n.zone = q.zone AND n.component <=> q.component AND n.o <> q.d")
        return starts.alias("n").join(some.alias("q"), there).select("n.o", "q.d", "n.distance")

    named = listed.select("d").distinct()
    free = reached(destinations.join(named, "d", "left_anti"))
    return free.unionByName(reached(destinations.join(named, "d", "left_semi")).join(listed, ["o", "d"], "left_anti"))


def soft_targets(prior: DataFrame, observed: DataFrame, masses: DataFrame) -> DataFrame:
    """(a, b, target, reliability) for pairs of municipalities.

    prior: (a, b, flow) of the gravity prior; observed: (a, b, weight, ess) of a
    survey; masses: (a, mass). The observed share of an origin is its target, what
    the survey saw outside follows the prior, nothing falls below a millionth of the
    prior, and each origin's targets add up to its mass.
    """
    totals = observed.groupBy("a").agg(F.sum("weight").alias("_t"))
    inside = prior.join(observed, ["a", "b"], "left").join(totals, "a", "left").join(masses, "a")
    seen = F.coalesce("weight", F.lit(0.0))
    reach = inside.groupBy("a").agg(F.sum(seen).alias("_in"))
    j = inside.join(reach, "a")
    has = F.coalesce("_t", F.lit(0.0)) > 0
    target = F.when(has, seen / F.col("_t")).otherwise(0.0) * F.col("mass") + F.when(has, 1 - F.col("_in") / F.col("_t")).otherwise(1.0) * F.col("flow")
    j = j.withColumn("target", F.greatest(target, F.col("flow") * 1e-6))
    scale = j.groupBy("a").agg(F.sum("target").alias("_s"))
    reliable = F.when(has, F.least(F.greatest(F.coalesce("ess", F.lit(0.0)) / 100, F.lit(RELIABILITY[0])), F.lit(RELIABILITY[1]))).otherwise(RELIABILITY[0])
    return j.join(scale, "a").select("a", "b", (F.col("target") * F.col("mass") / F.col("_s")).alias("target"), reliable.alias("reliability"))


def normalised(edges: DataFrame, score: Column, budget: str) -> DataFrame:
    """`flow`: each origin's budget in proportion to exp(score), shifted by the origin's largest score."""
    e = edges.withColumn("_s", score)
    top = e.groupBy("o").agg(F.max("_s").alias("_m"))
    e = e.join(top, "o").withColumn("_e", F.exp(F.col("_s") - F.col("_m")))
    total = e.groupBy("o").agg(F.sum("_e").alias("_t"))
    return e.join(total, "o").withColumn("flow", F.col("_e") / F.col("_t") * F.col(budget)).drop("_s", "_m", "_e", "_t")


def entropy_balance(edges: DataFrame, targets: DataFrame, groups: DataFrame, *, rounds: int) -> DataFrame:
    """(o, d, flow) after some rounds of scaling towards destination targets and, softly, group targets; origins are exact.

    edges: (o, d, g, score, budget); targets: (d, target); groups: (g, goal,
    reliability r). A destination's price rises by ln(now / target); a group's by
    r / (1 + r) (ln(now / goal) - price / r); steps stay within 15 (15 r). These are
    descent steps of the convex dual, so the rounds may go on until nothing moves.
    Prices are tables of nodes and groups, written after each step.
    """
    v, w = targets.select("d", "target", F.lit(0.0).alias("v")), groups.select("g", "goal", "reliability", F.lit(0.0).alias("w"))
    # Scores are shifted once by each origin's largest: prices are bounded, so nothing overflows later.
    top = edges.groupBy("o").agg(F.max("score").alias("_m"))
    work = Rounds(edges.sparkSession, "balance")
    edges = work.keep("edges", edges.join(top, "o").select("o", "d", "g", (F.col("score") - F.col("_m")).alias("_s"), "budget"))

    def flows() -> DataFrame:
        e = edges.join(v, "d").join(w, "g").withColumn("_e", F.exp(F.col("_s") - F.col("v") - F.col("w")))
        total = work.keep("totals", e.groupBy("o").agg(F.sum("_e").alias("_t")))
        return e.join(total, "o").select("o", "d", "g", (F.col("_e") / F.col("_t") * F.col("budget")).alias("flow"))

    for _ in range(rounds):
        now = flows().groupBy("d").agg(F.sum("flow").alias("n"))
        step = F.col("v") + F.ln(F.col("n") / F.col("target"))
        v = work.keep("v", v.join(now, "d", "left").select("d", "target", F.when((F.col("target") > 0) & (F.col("n") > 0), F.least(F.greatest(step, F.lit(-15.0)), F.lit(15.0))).otherwise(F.col("v")).alias("v")))
        now = flows().groupBy("g").agg(F.sum("flow").alias("n"))
        r = F.col("reliability")
        step = F.col("w") + r / (1 + r) * (F.ln(F.col("n") / F.col("goal")) - F.col("w") / r)
        w = work.keep("w", w.join(now, "g", "left").select("g", "goal", "reliability", F.when((F.col("goal") > 0) & (F.col("n") > 0), F.least(F.greatest(step, -15 * r), 15 * r)).otherwise(F.col("w")).alias("w")))
    return flows().select("o", "d", "flow")


def dual_statistics(edges: DataFrame) -> DataFrame:
    """(kind, id, total, curvature) of destinations and groups: sums of flow, and of flow (1 - flow / budget) within each origin.

    edges: (o, d, g, flow, budget).
    """
    def part(name: str) -> DataFrame:
        rows = edges.groupBy("o", name).agg(F.sum("flow").alias("f"), F.max("budget").alias("b"))
        s = rows.groupBy(F.col(name).cast("string").alias("id")).agg(F.sum("f").alias("total"), F.sum(F.col("f") * (1 - F.col("f") / F.col("b"))).alias("curvature"))
        return s.select(F.lit(name).alias("kind"), "id", "total", "curvature")

    return part("d").unionByName(part("g"))


def reserve(edges: DataFrame, remaining: DataFrame, places: list[tuple[str, int]], *, cohort: int, beta: float = 0.04) -> DataFrame:
    """(o, d, reserved): quotas of special places in whole cohorts, place by place, airports (AIR_) first, then by id.

    edges: (o, d, distance); remaining: (o, travellers); places: (id, quota), a short
    configured list, so each is one weighted largest remainder over its origins:
    travellers exp(-beta distance), capped by whole cohorts; what is left of the quota
    goes to the heaviest origins.
    """
    out, used = None, None
    for place, quota in sorted(places, key=lambda p: (not p[0].startswith("AIR_"), p[0])):
        left = remaining if used is None else remaining.join(used, "o", "left").select("o", (F.col("travellers") - F.coalesce("_u", F.lit(0))).alias("travellers"))
        e = edges.where(F.col("d") == place).join(left, "o").withColumn("_w", F.greatest(F.col("travellers") * F.exp(-beta * F.col("distance")), F.lit(1e-12)))
        e = e.withColumn("_cap", F.floor(F.col("travellers") / cohort))
        s = e.agg(F.sum("_w"), F.sum("_cap"), F.sum("travellers")).first()  # one row for each configured place
        if s[0] is None:
            continue
        target = min(quota, int(s[2]))
        full = min(target // cohort, int(s[1]))
        fitted = e.where("_cap > 0").select(F.lit(1).alias("g"), "o", F.col("_w").alias("prior"), F.lit(0.0).alias("lo"), F.col("_cap").cast("double").alias("hi"))
        from terrane.operators.calibrate import bounded_fit

        spark = edges.sparkSession
        fit = bounded_fit(fitted.select("g", "prior", "lo", "hi"), spark.createDataFrame([(1, float(full))], "g int, target double"), group="g").first()
        factor = fit["factor"] if fit and fit["factor"] is not None else 0.0
        e = e.withColumn("_x", F.least(F.col("_w") * factor, F.col("_cap").cast("double"))).withColumn("_n", F.floor(F.col("_x") + 1e-9).cast("long"))
        every = Window.partitionBy("d")
        more = F.row_number().over(every.orderBy(F.desc(F.col("_n") < F.col("_cap")), F.desc(F.col("_x") - F.col("_n")), "o"))
        e = e.withColumn("_k", more).withColumn("_n", F.col("_n") + ((F.col("_n") < F.col("_cap")) & (F.col("_k") <= full - F.sum("_n").over(every))).cast("long"))
        e = e.withColumn("_t", F.col("_n") * cohort)
        room = F.col("travellers") - F.col("_t")
        before = F.coalesce(F.sum(room).over(every.orderBy(F.desc("_w"), "o").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        extra = F.greatest(F.lit(0), F.least(room, F.lit(target - full * cohort) - before))
        taken = e.withColumn("reserved", (F.col("_t") + extra).cast("long")).where("reserved > 0").select("o", "d", "reserved")
        out = taken if out is None else out.unionByName(taken)
        used = out.groupBy("o").agg(F.sum("reserved").alias("_u"))
    return out if out is not None else edges.select("o", "d", F.lit(0).cast("long").alias("reserved")).limit(0)


def feedback_goals(expected: DataFrame, *, size: int) -> DataFrame:
    """(d, goal): this bucket's fractional counts, moved by what earlier buckets owe each destination, rescaled to the bucket's total.

    expected: (d, count, owed), owed in travellers (positive: too few so far).
    """
    goal = F.when(F.col("count") > 0, F.greatest(F.lit(0.0), F.col("count") + F.col("owed") / size)).otherwise(0.0)
    g = expected.withColumn("goal", goal)
    total = g.agg(F.sum("count").alias("_c"), F.sum("goal").alias("_g"))
    return g.join(F.broadcast(total)).select("d", F.when(F.col("_g") > 0, F.col("goal") * F.col("_c") / F.col("_g")).otherwise(F.col("count")).alias("goal"))


def round_with_feedback(flows: DataFrame, sizes: list[int]) -> DataFrame:
    """(d, size, cohorts): cohort counts of each destination, bucket by bucket from the largest size, each bucket paying the debt of those before.

    flows: (d, size, count), fractional cohorts of a size; a bucket's counts are
    rounded by largest remainder, so its total stays.
    """
    from terrane.operators.calibrate import largest_remainder

    debt, out = None, None
    for size in sorted(sizes, reverse=True):
        some = flows.where(F.col("size") == size).select("d", "count")
        owed = some.join(debt, "d", "left").select("d", "count", F.coalesce("owed", F.lit(0.0)).alias("owed")) if debt is not None else some.withColumn("owed", F.lit(0.0))
        goals = feedback_goals(owed, size=size).withColumn("_g", F.lit(0))
        whole = largest_remainder(goals, group="_g", key="d", value="goal").select("d", F.lit(size).alias("size"), F.col("units").alias("cohorts"))
        out = whole if out is None else out.unionByName(whole)
        now = some.join(whole, "d").select("d", (size * (F.col("count") - F.col("cohorts"))).alias("owed"))
        debt = now if debt is None else debt.unionByName(now).groupBy("d").agg(F.sum("owed").alias("owed"))
    return out


def solve_transport(cells: pd.DataFrame, supply: dict, targets: dict) -> tuple[dict, int, list, list]:
    """Flows of one zone with exact rows and columns between floor and ceiling of their targets: (flow, deficit, origins, destinations).

    cells: o, d, proposal, distance. The proposal is kept where it fits. Then units
    move along shortest alternating paths of permitted cells, nearer ones first: open
    supply to columns below their floor, then to any column below its ceiling, then
    from columns above their floor to those below it. With a deficit, the lists name
    the ends that the last search could not leave, a cut of the permitted support.
    """
    import math

    low = {d: math.floor(t + 1e-9) for d, t in targets.items()}
    high = {d: math.ceil(t - 1e-9) for d, t in targets.items()}
    flow, of, to = {}, {o: [] for o in supply}, {d: [] for d in targets}
    for r in cells.sort_values(["o", "distance", "d"]).itertuples(index=False):
        of[r.o].append(r.d)
        to[r.d].append(r.o)
        flow[r.o, r.d] = int(r.proposal)
    open_, full = dict(supply), dict.fromkeys(targets, 0)
    for (o, d), n in sorted(flow.items()):
        keep = min(n, open_[o], high[d] - full[d])
        flow[o, d] = keep
        open_[o] -= keep
        full[d] += keep

    def search(starts: list, goal) -> tuple[list | None, set, set]:
        """A path of (o, d) steps, forward ones first: units enter at the first d and leave at the last."""
        rows, columns, queue = {o: None for o in starts}, {}, list(starts)
        while queue:
            o = queue.pop(0)
            for d in of[o]:
                if d in columns:
                    continue
                columns[d] = o
                if goal(d):
                    path = []
                    while True:
                        path.append((columns[d], d))
                        if rows[columns[d]] is None:
                            return path[::-1], set(rows), set(columns)
                        d = rows[columns[d]]
                for other in to[d]:
                    if other not in rows and flow[other, d] > 0:
                        rows[other] = d
                        queue.append(other)
        return None, set(rows), set(columns)

    def push(path: list, n: int) -> None:
        for k, (o, d) in enumerate(path):
            flow[o, d] += n
            if k + 1 < len(path):
                flow[path[k + 1][0], d] -= n

    def most(path: list) -> int:
        return min([10**12, *(flow[path[k + 1][0], d] for k, (_, d) in enumerate(path[:-1]))])

    def fill(goal, room) -> tuple[set, set]:
        while True:
            starts = sorted(o for o, n in open_.items() if n > 0)
            path, rows, columns = search(starts, goal)
            if path is None:
                return rows, columns
            n = min(most(path), open_[path[0][0]], room(path[-1][1]))
            push(path, n)
            open_[path[0][0]] -= n
            full[path[-1][1]] += n

    fill(lambda d: full[d] < low[d], lambda d: low[d] - full[d])
    rows, columns = fill(lambda d: full[d] < high[d], lambda d: high[d] - full[d])
    unsent, lacking = sum(open_.values()), 0
    for short in sorted(targets):
        while full[short] < low[short]:
            spare = [d for d in sorted(targets) if full[d] > low[d]]
            start = {o: d for d in reversed(spare) for o in reversed(to[d]) if flow[o, d] > 0}
            path, found, seen = search(sorted(start), lambda d, short=short: d == short)
            if path is None:
                rows, columns = rows | found, columns | seen
                lacking += low[short] - full[short]
                break
            giver = start[path[0][0]]
            n = min(most(path), flow[path[0][0], giver], full[giver] - low[giver], low[short] - full[short])
            push(path, n)
            flow[path[0][0], giver] -= n
            full[giver] -= n
            full[short] += n
    return {k: n for k, n in flow.items() if n}, max(unsent, lacking), sorted(rows), sorted(d for d in targets if d not in columns or full[d] < low[d])


def integer_transport(cells: DataFrame, supply: DataFrame, targets: DataFrame, *, widths: tuple[int, ...] = (8, 32, 128)) -> DataFrame:
    """(zone, o, d, flow, width): integer flows with exact origin totals and destination totals at the floor or ceiling of their targets.

    cells: (zone, o, d, proposal, distance) of permitted pairs, supply: (zone, o, out),
    targets: (zone, d, target) that add up to the supply. A zone is one independent
    problem in one task. It is tried on the nearest `widths` partners of each origin
    and destination with the proposal's pairs, then on all; `width` tells which
    (null: all). An infeasible zone fails and names a cut that shows it.
    """
    def solve(key: tuple, c: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
        s, t = ends[ends["side"] == 0], ends[ends["side"] == 1]
        out, into = {o: int(n) for o, n in zip(s["id"], s["n"], strict=True)}, dict(zip(t["id"], t["n"], strict=True))
        total = sum(out.values())
        if abs(sum(into.values()) - total) > 1e-6 * max(1, total):
            raise ValueError(f"zone {key[0]}: targets of {sum(into.values())} for a supply of {total}")
        if not (set(c["o"]) <= set(out) and set(c["d"]) <= set(into)):
            raise ValueError(f"zone {key[0]}: a permitted pair has an unknown end")
        c = c.assign(_o=c.sort_values(["distance", "d"]).groupby("o").cumcount(), _d=c.sort_values(["distance", "o"]).groupby("d").cumcount())
        for width in (*widths, None):
            some = c if width is None else c[(c["_o"] < width) | (c["_d"] < width) | (c["proposal"] > 0)]
            flow, deficit, rows, columns = solve_transport(some[["o", "d", "proposal", "distance"]], out, into)
            if not deficit:
                break
            if len(some) == len(c):
                raise ValueError(f"zone {key[0]}: complete support cannot realise the targets: total={total}, deficit={deficit}, origins={rows[:20]}, destinations={columns[:20]}")
        rows = [(key[0], o, d, n, width) for (o, d), n in sorted(flow.items())]
        return pd.DataFrame(rows, columns=["zone", "o", "d", "flow", "width"]).astype({"width": "Int32", "flow": "int64"})

    cells = cells.select("zone", "o", "d", "proposal", "distance")
    ends = supply.select("zone", F.lit(0).alias("side"), F.col("o").alias("id"), F.col("out").cast("double").alias("n")).unionByName(targets.select("zone", F.lit(1).alias("side"), F.col("d").alias("id"), F.col("target").cast("double").alias("n"))).toDF("zone", "side", "id", "n")  # names of its own: cells may come from the same table
    kinds = {f.name: f.dataType.simpleString() for f in cells.schema.fields}
    return cells.groupBy("zone").cogroup(ends.groupBy("zone")).applyInPandas(solve, f"zone {kinds['zone']}, o {kinds['o']}, d {kinds['d']}, flow long, width int")


def feasibility(cells: DataFrame, supply: DataFrame, targets: DataFrame, *, scale: int = 1000) -> DataFrame:
    """(zone, supply, deficit): travellers that the permitted pairs cannot bring to the targets, at a resolution of 1 / scale, by maximum flow in each zone."""
    def solve(key: tuple, c: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
        s, t = ends[ends["side"] == 0], ends[ends["side"] == 1]
        out = {o: round(n * scale) for o, n in zip(s["id"], s["n"], strict=True)}
        wish = {d: n * scale for d, n in zip(t["id"], t["n"], strict=True)}
        into = {d: int(n) for d, n in wish.items()}
        rest = sum(out.values()) - sum(into.values())
        for d in sorted(wish, key=lambda d: (into[d] - wish[d], str(d)))[: max(0, rest)]:
            into[d] += 1
        _, deficit, _, _ = solve_transport(c.assign(proposal=0)[["o", "d", "proposal", "distance"]], out, into)
        return pd.DataFrame({"zone": [key[0]], "supply": [sum(out.values()) / scale], "deficit": [deficit / scale]})

    cells = cells.select("zone", "o", "d", "distance")
    ends = supply.select("zone", F.lit(0).alias("side"), F.col("o").alias("id"), F.col("out").cast("double").alias("n")).unionByName(targets.select("zone", F.lit(1).alias("side"), F.col("d").alias("id"), F.col("target").cast("double").alias("n"))).toDF("zone", "side", "id", "n")  # names of its own: cells may come from the same table
    kind = cells.schema["zone"].dataType.simpleString()
    return cells.groupBy("zone").cogroup(ends.groupBy("zone")).applyInPandas(solve, f"zone {kind}, supply double, deficit double")


def reconcile(points: DataFrame, evidence: DataFrame) -> DataFrame:
    """Points with road components joined where routes were accepted in both directions: (id, component).

    points: (id, component); evidence: (a, b, accepted) of point pairs, each direction a row.
    """
    from terrane.operators.graph import components

    there = evidence.where("accepted").select("a", "b")
    both = there.join(there.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"])
    part = points.where("component is not null").select("id", "component")
    links = both.join(part.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a").join(part.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b")
    links = links.select(F.col("ca").alias("a"), F.col("cb").alias("b")).where("a <> b").distinct()
    names = components(points.where("component is not null").select(F.col("component").alias("id")).distinct(), links)
    return points.join(names.select(F.col("id").alias("component"), F.col("component").alias("_to")), "component", "left").select("id", F.col("_to").alias("component"))


def refine_support(pairs: DataFrame, solve, route, *, rounds: int = 8) -> tuple[DataFrame, int]:
    """Solve, ask for routes of the pairs used, drop those without one, until none is lacking: (flows, rounds used).

    solve(pairs) gives flows (o, d, flow); route(flows) the used pairs (o, d) without a
    route. After `rounds` the support is given up as unroutable.
    """
    work = Rounds(pairs.sparkSession, "refined")
    for n in range(1, rounds + 1):
        flows = work.keep("flows", solve(pairs))
        missing = work.keep(f"missing-{n}", route(flows))
        if missing.isEmpty():
            return flows, n
        pairs = work.keep("pairs", pairs.join(missing, ["o", "d"], "left_anti"))
    raise ValueError(f"pairs without a route remain after {rounds} rounds")


def choose_beta(losses: DataFrame, *, base: float, guard_gain: float, margin: float) -> float:
    """The decay nearest to `base` whose loss is within one standard error of the best, if the guard set gains more than the margin; else `base`.

    losses: (beta, loss, error), a row for each of a few candidates.
    """
    rows = sorted((r["beta"], r["loss"], r["error"] or 0.0) for r in losses.collect())
    best = min(loss for _, loss, _ in rows)
    near = [b for b, loss, error in rows if loss - best <= error + 1e-12]
    chosen = min(near, key=lambda b: (abs(b - base), b))
    return chosen if chosen == base or guard_gain > margin else base


def routed(pairs: DataFrame, routes: DataFrame) -> DataFrame:
    """Pairs (o, d, beeline) with distance, seconds and where they come from: a routes table (o, d, metres, seconds), else the beeline rule.

    A route shorter than the beeline is refused, and the rule stands in for it.
    """
    from terrane.functions.scalars import driving_fallback

    j = pairs.join(routes, ["o", "d"], "left").withColumn("_r", driving_fallback(F.col("beeline")))
    good = F.col("metres").isNotNull() & (F.col("metres") >= F.col("beeline"))
    source = F.when(good, "route").when(F.col("metres").isNull(), "no route").otherwise("refused")
    return j.select("o", "d", F.when(good, F.col("metres")).otherwise(F.col("_r.distance")).alias("distance"), F.when(good, F.col("seconds")).otherwise(F.col("_r.seconds")).alias("seconds"), source.alias("source"))


def two_layers(edges: DataFrame, origins: DataFrame, destinations: DataFrame, places: list[tuple[str, int]], reach: DataFrame, *, cohort: int, rounds: int) -> DataFrame:
    """(o, d, size, layer) cohorts: exact quotas of special places first, then a balance of what is left, in whole travellers.

    edges: (o, d, w); origins: (o, travellers); destinations: (d, jobs); reach: (o, d,
    distance) of the special places. Each origin's flows are rounded by largest
    remainder, so its travellers are all placed, and cut into cohorts of at most `cohort`.
    """
    from terrane.operators.calibrate import largest_remainder, split_cohorts
    from terrane.operators.flows import ipf

    special = reserve(reach, origins, places, cohort=cohort)
    used = special.groupBy("o").agg(F.sum("reserved").alias("_u"))
    left = settled(origins.join(used, "o", "left").select("o", (F.col("travellers") - F.coalesce("_u", F.lit(0))).alias("left")).where("left > 0"))
    total = left.agg(F.sum("left").alias("_t"))
    pull = destinations.agg(F.sum("jobs").alias("_j"))
    wanted = destinations.join(F.broadcast(total)).join(F.broadcast(pull)).select("d", (F.col("jobs") * F.col("_t") / F.col("_j")).alias("in"))
    flows = ipf(edges, left.withColumnRenamed("left", "out"), wanted, rounds)
    whole = largest_remainder(flows, group="o", key="d", value="flow").where("units > 0")
    both = special.select("o", F.col("d").cast("string").alias("d"), F.col("reserved").alias("size"), F.lit("special").alias("layer")).unionByName(whole.select("o", F.col("d").cast("string").alias("d"), F.col("units").alias("size"), F.lit("ordinary").alias("layer")))
    return split_cohorts(both, "size", cohort).select("o", "d", F.col("cohort_size").alias("size"), "layer")
