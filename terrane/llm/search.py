"""Nearest neighbours by a hierarchical k-means tree with best-bin-first traversal.

The tree is fitted on a bounded sample (`sample_rows`) and broadcast; it has
about as many leaves as the root of the number of rows, `max_leaves` at most.
Every row is put in the leaf its greedy descent ends in. A query walks the tree
with a priority queue over the branches, ordered by the product with the
centre plus what the branch's spread can add, and lists leaves until it has
seen as many as calibration says (and enough rows for k). Calibration compares
with brute force over all rows: for some queries, the true neighbours' leaves
tell how many leaves a walk must visit to reach the wanted recall.

Leaves lie on a line in tree order, each as long as it has rows; the line is cut
into buckets of at most `bucket_rows`, so a hot leaf has several. A query is sent
once to each bucket it visits, with the list of its leaves there, and a task
holds one bucket while the queries stream past in blocks. Equal vectors are one
row with their smallest ids: as ties go to the smaller id, no further one can
be among the k nearest.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrane.llm.common import Scratch, partitions

CELLS = 4_000_000  # scores held at once by a task
DEVIATIONS = 3.0


@dataclass
class Tree:
    """Nodes in arrays: centre, reach (deviations along one direction), children (empty for a leaf), leaf number."""

    centre: list[np.ndarray] = field(default_factory=list)
    reach: list[float] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)
    leaves: int = 0

    def add(self, rows: np.ndarray, centre: np.ndarray) -> int:
        self.centre.append(centre)
        self.reach.append(DEVIATIONS * float(np.sqrt(((rows - centre) ** 2).mean())) if rows.size else 0.0)
        self.children.append([])
        return len(self.centre) - 1

    def below(self, node: int) -> tuple[np.ndarray, np.ndarray]:
        """Centres and reaches of a node's children."""
        cache = self.__dict__.setdefault("_m", {})
        if node not in cache:
            cache[node] = np.array([self.centre[c] for c in self.children[node]]), np.array([self.reach[c] for c in self.children[node]])
        return cache[node]

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row: nearest centre at every level."""
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not self.children[node]:
                out[rows] = self.leaf[node]
                continue
            m = self.below(node)[0]
            near = (x[rows] @ m.T - (m * m).sum(1) / 2).argmax(1)
            todo += [(c, rows[near == i]) for i, c in enumerate(self.children[node]) if (near == i).any()]
        return out

    def walk(self, q: np.ndarray) -> Iterator[int]:
        """Leaves, best bin first: the branch that can hold the largest product with the query."""
        queue, size = [(0.0, 0)], float(np.sqrt(q @ q))
        while queue:
            _, node = heapq.heappop(queue)
            if not self.children[node]:
                yield self.leaf[node]
                continue
            m, reach = self.below(node)
            for s, c in zip((m @ q + reach * size).tolist(), self.children[node], strict=True):
                heapq.heappush(queue, (-s, c))


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    centre = x[rng.choice(len(x), k, replace=False)]
    own = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        own = (x @ centre.T - (centre * centre).sum(1) / 2).argmax(1)
        n = np.bincount(own, minlength=k)
        total = np.zeros_like(centre)
        np.add.at(total, own, x)
        centre = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centre)
    return centre, own


def grow(sample: np.ndarray, *, branch: int, leaf_rows: int, max_leaves: int, seed: int = 3) -> Tree:
    """The largest group is split next, until all are small or the leaves are enough."""
    tree, rng = Tree(), np.random.default_rng(seed)
    tree.add(sample, sample.mean(0) if len(sample) else np.zeros(sample.shape[1]))
    heap, ends = [(-len(sample), 0, np.arange(len(sample)))], 1
    while heap and -heap[0][0] > leaf_rows and ends + branch - 1 <= max_leaves:
        _, node, rows = heapq.heappop(heap)
        if len(np.unique(sample[rows], axis=0)) < branch:
            continue
        centre, own = kmeans(sample[rows], branch, rng)
        for i in range(branch):
            if (own == i).any():
                mine = rows[own == i]
                child = tree.add(sample[mine], centre[i])
                tree.children[node].append(child)
                heapq.heappush(heap, (-len(mine), child, mine))
        ends += len(tree.children[node]) - 1
    tree.leaf, todo = [-1] * len(tree.centre), [0]
    while todo:  # numbers follow the tree, so that neighbouring leaves are alike
        node = todo.pop()
        todo += tree.children[node]
        if not tree.children[node]:
            tree.leaf[node] = tree.leaves
            tree.leaves += 1
    return tree


def stacked(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


class Rows:
    """Stored vectors of one bucket in order of their leaves, each with its ids."""

    def __init__(self, x: np.ndarray, leaf: np.ndarray, ids: np.ndarray, counts: np.ndarray):
        order = np.argsort(leaf, kind="stable")
        ends = np.cumsum(counts)[order]
        self.x, self.leaf, self.counts = x[order], leaf[order], counts[order]
        n = self.counts
        self.ids = ids[np.repeat(ends - np.cumsum(n), n) + np.arange(n.sum())]
        self.first = np.cumsum(n) - n
        self.longest = float(np.sqrt((x * x).sum(1).max(initial=0)))

    def nearest(self, q: np.ndarray, own: np.ndarray, leaves: list[np.ndarray] | None, k: int) -> tuple[np.ndarray, ...]:
        """The k best of each query among the leaves it visits (None: all): query, vec_id, score, leaf, sorted by query and rank.

        A matrix product finds the candidates; those that reach the k-th score, but for
        rounding, are scored again one by one, so a score never depends on its neighbours.
        """
        scores = np.full((len(q), len(self.x)), -np.inf)
        if leaves is None:
            scores[:] = q @ self.x.T
        else:
            visitor = np.repeat(np.arange(len(q)), [len(x) for x in leaves])
            visited = np.concatenate(leaves) if leaves else np.zeros(0, np.int64)
            order = np.argsort(visited, kind="stable")
            visitor, visited = visitor[order], visited[order]
            cut = np.flatnonzero(np.r_[True, visited[1:] != visited[:-1]]) if len(visited) else np.zeros(0, np.int64)
            for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(visited)], strict=True):
                lo, hi = np.searchsorted(self.leaf, [visited[a], visited[a] + 1])
                if hi > lo:
                    who = visitor[a:b]
                    scores[who, lo:hi] = q[who] @ self.x[lo:hi].T
        most = min(k + 1, scores.shape[1])  # one more: a query's own row goes
        least = np.partition(scores, scores.shape[1] - most, axis=1)[:, scores.shape[1] - most]
        slack = 1e-11 * self.longest * np.sqrt((q * q).sum(1)) + 1e-300
        at, row = np.nonzero((scores >= (least - slack)[:, None]) & (scores > -np.inf))
        exact = np.einsum("ij,ij->i", q[at], self.x[row])
        n = self.counts[row]
        pick = np.repeat(self.first[row] - np.cumsum(n) + n, n) + np.arange(n.sum())
        at, exact, leaf, vec = np.repeat(at, n), np.repeat(exact, n), np.repeat(self.leaf[row], n), self.ids[pick]
        other = vec != own[at]
        at, exact, leaf, vec = at[other], exact[other], leaf[other], vec[other]
        order = np.lexsort((vec, -exact, at))
        at, exact, leaf, vec = at[order], exact[order], leaf[order], vec[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        on = rank < k
        return at[on], vec[on], exact[on], leaf[on]


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (doubles) of the rows that take part, lengths apart."""
    e = F.col("embedding")
    bad = F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    good = e.isNotNull() & F.col("vec_id").isNotNull() & F.exists(e, lambda v: v != 0) & ~F.coalesce(bad, F.lit(False))
    return vectors.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), e.cast("array<double>").alias("embedding"))


def distinct(x: DataFrame, most: int) -> DataFrame:
    """h, embedding, ids: a row for each vector with the `most` smallest of its ids (a window limit prunes before the shuffle)."""
    own = Window.partitionBy("h", "embedding").orderBy("vec_id")
    ranked = x.withColumn("h", F.xxhash64("embedding")).withColumn("r", F.row_number().over(own)).where(F.col("r") <= most)
    return ranked.groupBy("h", "embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def search(
    vectors: DataFrame,
    queries: DataFrame,
    *,
    k: int = 20,
    recall: float = 0.94,
    sample_rows: int = 32_768,
    branch: int = 8,
    max_leaves: int = 8192,
    calibration: int = 64,
    bucket_rows: int = 32_768,
    query_rows: int = 1_000_000,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows found nearest to each query by inner product, never the query's own id.

    vectors and queries: (vec_id long, embedding array); other columns are not
    read. Vectors that are null, zero, hold a null or non-finite component or are
    not of the table's most frequent length (of equally frequent ones the longest)
    take no part on either side. Rows of equal score rank by vec_id; a repeated
    vec_id is a candidate of its own each time. Queries alike in id and vector are
    one; those alike in id alone are answered apart. Without usable vectors or
    queries the result is empty.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "search")
    empty = "query_id long, rank int, vec_id long, score double"
    x = usable(vectors)
    lengths = x.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if lengths is None:
        return spark.createDataFrame([], empty)
    x = x.where(F.size("embedding") == lengths["d"])
    q = usable(queries).where(F.size("embedding") == lengths["d"]).select(F.col("vec_id").alias("query_id"), "embedding")
    q = scratch.keep(q.withColumn("qh", F.xxhash64("embedding")).dropDuplicates(["query_id", "qh", "embedding"]), "queries")
    asked = q.count()
    if not asked:
        return spark.createDataFrame([], empty)
    share = min(1_000_000, 1_000_000 * sample_rows // lengths["n"] + 1)
    sample = x.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < share).select("embedding").limit(2 * sample_rows).toArrow()["embedding"].combine_chunks()
    if not len(sample):
        sample = x.select("embedding").limit(1).toArrow()["embedding"].combine_chunks()
    sample = stacked(sample)
    wanted = min(max_leaves, int(np.ceil(np.sqrt(lengths["n"]))))
    tree = grow(sample, branch=branch, leaf_rows=max(4, len(sample) // wanted), max_leaves=max_leaves)
    held = spark.sparkContext.broadcast(tree)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(held.value.assign(stacked(b.column(1))))], ["h", "embedding", "ids", "leaf"])

    placed = scratch.keep(distinct(x, k + 1).mapInArrow(place, "h long, embedding array<double>, ids array<long>, leaf long"), "placed")
    sizes = {r["leaf"]: r["n"] for r in placed.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # <= max_leaves
    count = np.array([sizes.get(i, 0) for i in range(tree.leaves)])
    visits = calibrate(placed, q, tree, k, recall, calibration)
    start = np.cumsum(count) - count
    width = min(bucket_rows, max(256, -(-int(count.sum()) // partitions(spark))))
    groups = -(-asked // query_rows)
    shape = "bucket long, part long, kind int, query_id long, qh long, ids array<long>, embedding array<double>, leaves array<long>"
    names = [c.split()[0] for c in shape.split(", ")]

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf, h = b.column(3).to_numpy(), b.column(0).to_numpy().view(np.uint64)
            at = start[leaf] + (h % count[leaf].astype(np.uint64)).astype(np.int64)
            none, lists = pa.nulls(len(leaf), pa.int64()), pa.ListArray.from_arrays(np.arange(len(leaf) + 1, dtype=np.int32), leaf)
            for part in range(groups):
                yield pa.RecordBatch.from_arrays([pa.array(at // width), pa.array(np.full(len(leaf), part)), pa.array(np.zeros(len(leaf), np.int32)), none, none, b.column(2), b.column(1), lists], names)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = held.value
        for b in batches:
            rows, buckets, lists = [], [], []
            for i, v in enumerate(stacked(b.column(1)) if b.num_rows else ()):
                seen, found, own = 0, 0, {}
                for leaf in t.walk(v):
                    if seen >= visits and found > k:
                        break
                    seen, n = seen + 1, int(count[leaf])
                    found += n
                    for bucket in range(int(start[leaf]) // width, (int(start[leaf]) + n - 1) // width + 1) if n else ():
                        own.setdefault(bucket, []).append(leaf)
                rows += [i] * len(own)
                buckets += own
                lists += own.values()
            at, h = pa.array(rows, pa.int64()), b.column(2).to_numpy().view(np.uint64)
            part = (h % np.uint64(groups)).astype(np.int64)[np.array(rows, np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), pa.array(part), pa.array(np.ones(len(rows), np.int32)), b.column(0).take(at), b.column(2).take(at), pa.nulls(len(rows), pa.list_(pa.int64())), b.column(1).take(at), pa.array(lists, pa.list_(pa.int64()))], names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, rows = None, [], None
        for b in batches:
            bucket, part, kind = (b.column(i).to_numpy() for i in range(3))
            change = (bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1]) | (kind[1:] != kind[:-1])
            cuts = np.flatnonzero(np.r_[True, change, True]) if len(kind) else np.zeros(1, np.int64)
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                some = b.slice(lo, hi - lo)
                if (bucket[lo], part[lo]) != key:
                    key, parts, rows = (bucket[lo], part[lo]), [], None
                if kind[lo] == 0:
                    parts.append((stacked(some.column(6)), some.column(7).flatten().to_numpy(), some.column(5).flatten().to_numpy(), some.column(5).value_lengths().to_numpy().astype(np.int64)))
                    continue
                if rows is None:
                    if not parts:
                        continue
                    rows, parts = Rows(*(np.concatenate(p) for p in zip(*parts, strict=True))), [None]
                step = max(1, CELLS // len(rows.x))
                for a in range(0, some.num_rows, step):
                    block = some.slice(a, step)
                    leaves = [np.asarray(v) for v in block.column(7).to_numpy(zero_copy_only=False)]
                    at, vec, score, _ = rows.nearest(stacked(block.column(6)), block.column(3).to_numpy(), leaves, k)
                    ends = np.searchsorted(at, np.arange(block.num_rows + 1)).astype(np.int32)
                    pairs = pa.StructArray.from_arrays([pa.array(-score), pa.array(vec)], ["below", "vec_id"])
                    yield pa.RecordBatch.from_arrays([block.column(3), block.column(4), pa.ListArray.from_arrays(pa.array(ends), pairs)], ["query_id", "qh", "found"])

    both = placed.mapInArrow(store, shape).union(q.select("query_id", "embedding", "qh").mapInArrow(route, shape))
    buckets = -(-int(count.sum()) // width)
    dealt = both.repartition(max(partitions(spark), buckets * groups), "bucket", "part").sortWithinPartitions("bucket", "part", "kind")
    met = dealt.mapInArrow(meet, "query_id long, qh long, found array<struct<below: double, vec_id: long>>")
    best = met.groupBy("query_id", "qh").agg(F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k).alias("found"))  # k from each bucket
    out = best.select("query_id", F.posexplode("found").alias("at", "f"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("f.vec_id").alias("vec_id"), (-F.col("f.below")).alias("score"))


def calibrate(placed: DataFrame, q: DataFrame, tree: Tree, k: int, recall: float, some: int) -> int:
    """Leaves a walk must visit so that the true neighbours of a bounded sample of queries are found at the wanted rate."""
    chosen = q.orderBy(F.xxhash64("query_id"), "query_id", "qh").limit(some).toArrow()
    v, ids = stacked(chosen["embedding"].combine_chunks()), chosen["query_id"].to_numpy()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                rows = Rows(stacked(b.column(0)), b.column(2).to_numpy(), b.column(1).flatten().to_numpy(), b.column(1).value_lengths().to_numpy().astype(np.int64))
                found = rows.nearest(v, ids, None, k)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["i", "vec_id", "score", "leaf"])

    order = Window.partitionBy("i").orderBy(F.desc("score"), "vec_id")
    true = placed.select("embedding", "ids", "leaf").mapInArrow(scan, "i long, vec_id long, score double, leaf long")
    needed = []
    for r in true.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).groupBy("i").agg(F.collect_list("leaf").alias("leaves")).collect():
        turn = {leaf: n for n, leaf in enumerate(tree.walk(v[r["i"]]), 1)}
        needed += [turn[leaf] for leaf in r["leaves"]]
    needed = np.sort(needed) if needed else np.array([1])
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)])
