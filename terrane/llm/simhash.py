"""SimHash near-dedup over a Gray-order hierarchical index.

Distinct fingerprints are routed by every choice of whole bit blocks that two
close fingerprints must share (with b blocks and distance k, some b - k blocks
are equal). Within a task, the fingerprints of all its routes are sorted by
route and then by Gray rank; runs of neighbours form leaves, and upper nodes
hold the bits that all below them share, as a mask and a pattern. The index is
joined with itself from the top: a pair of nodes is dropped when the bits that
both fix differ in more than k places, and taken whole when no pair below can
differ in more. What is left at the leaves is compared bit for bit.

A task returns a spanning star of what it linked, not the pairs: links between
fingerprints that are already connected are never written out. It reads its
routes in order and links some whole ones at a time. A route with more rows than
`hot_rows` is routed again by further blocks of the bits not yet fixed, under
the same rule, so that no link is lost: each such step fixes a third of the bits
that are left, after three only 2 ** 19 distinct fingerprints can share a route.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import Scratch, one_of_each
from terrane.llm.components import components

BLANK = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
FAN = 16


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """64 majority bits of XXH64 (seed 42) over word shingles, repeats included; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).translate(BLANK).split(b" ")
    words = [w for w in words if w] if b"" in words else words
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(itertools.accumulate(map(len, words), lambda a, n: a + n + 1))
    k = min(shingle, len(words))
    starts = [0, *[e + 1 for e in ends[: len(words) - k]]]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[k - 1 :], strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(h), 65_536):
        bits = np.unpackbits(h[lo : lo + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * ones > len(h)).tolist()))


def text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, t (a hash of the text), f (the 64 bits as a signed long)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = np.array([fingerprint(t.as_py(), shingle) for t in b.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(f)], ["doc_id", "t", "f"])

    return docs.select("doc_id", text_hash().alias("t"), "text").mapInArrow(run, f"doc_id {kind}, t long, f long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Rank of a bit pattern in Gray order: the prefix parity of its bits."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


def pack_level(group: np.ndarray, mask: np.ndarray, pattern: np.ndarray) -> tuple[np.ndarray, ...]:
    """Parents of up to FAN neighbours of one group: first child, children, group, shared mask, pattern."""
    at = np.arange(len(group))
    begins = np.r_[True, group[1:] != group[:-1]]
    place = at - np.maximum.accumulate(np.where(begins, at, 0))
    first = np.flatnonzero(place % FAN == 0)
    count = np.diff(np.r_[first, len(group)])
    ones = np.bitwise_and.reduceat(pattern & mask, first)
    zeros = np.bitwise_and.reduceat(~pattern & mask, first)
    return first, count, group[first], ones | zeros, ones


class Forest:
    """Union-find over rows, with whole-array finds."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            top = self.up[self.up]
            if np.array_equal(top, self.up):
                return top
            self.up = top

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            r = self.roots()
            x, y = r[a], r[b]
            open_ = x != y
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(self.up, np.maximum(x, y), np.minimum(x, y))


def expand(first: np.ndarray, count: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of children of the node pairs (a, b); a node with itself gives each pair once."""
    n = count[a] * count[b]
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    a, b = np.repeat(a, n), np.repeat(b, n)
    i, j = k // count[b], k % count[b]
    on = (a != b) | (i <= j)
    return (first[a] + i)[on], (first[b] + j)[on]


def link(group: np.ndarray, prints: np.ndarray, far: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, representative) that connect all prints of one group within `far` bits of each other."""
    rank = gray_rank(prints)
    order = np.lexsort((rank, group))
    group, prints = group[order], prints[order]
    levels = [(None, None, group, np.full(len(prints), 2**64 - 1, np.uint64), prints)]
    while len(levels[-1][2]) > 1 and (levels[-1][2][1:] == levels[-1][2][:-1]).any():
        levels.append(pack_level(*levels[-1][2:]))
    forest = Forest(len(prints))
    top = len(levels) - 1
    whole = np.arange(len(levels[top][2]))
    todo = [(top, whole[i : i + 4096], whole[i : i + 4096]) for i in range(0, len(whole), 4096)]
    low = [np.arange(len(prints))]
    for lv in levels[1:]:
        low.append(low[-1][lv[0]])
    while todo:
        depth, a, b = todo.pop()
        mask, pattern = levels[depth][3:]
        both = mask[a] & mask[b]
        apart = np.bitwise_count((pattern[a] ^ pattern[b]) & both)
        on = apart <= far
        if depth == 0:
            on &= a != b
            forest.join(a[on], b[on])
            continue
        a, b, most = a[on], b[on], apart[on] + np.bitwise_count(~both[on])
        sure = most <= far  # every pair below is within reach: a star over both nodes will do
        for x, y in zip(a[sure].tolist(), b[sure].tolist(), strict=True):
            for z in (x, y):
                end = low[depth][z + 1] if z + 1 < len(low[depth]) else len(prints)
                rows = np.arange(low[depth][z], end)
                forest.join(rows, np.full(len(rows), low[depth][x]))
        a, b = a[~sure], b[~sure]
        if depth == 1 and len(a):
            same = joined_whole(forest, levels[1], len(prints))
            r = forest.roots()[levels[1][0]]
            need = ~(same[a] & same[b] & (r[a] == r[b]))
            a, b = a[need], b[need]
        first, count = levels[depth][:2]
        step = max(1, 200_000 // (FAN * FAN))
        for lo in range(0, len(a), step):
            todo.append((depth - 1, *expand(first, count, a[lo : lo + step], b[lo : lo + step])))
    root = forest.roots()
    on = root != np.arange(len(root))
    return prints[on], prints[root[on]]


def joined_whole(forest: Forest, level: tuple, n: int) -> np.ndarray:
    """For each leaf node, whether all its rows are in one component already."""
    r, first = forest.roots(), level[0]
    return np.minimum.reduceat(r, first) == np.maximum.reduceat(r, first)


def routes(free: int, blocks: int, far: int) -> list[int]:
    """Masks of the choices of blocks - far blocks of the bits in `free`, as unsigned integers."""
    bits = [i for i in range(64) if free >> i & 1]
    edges = [i * len(bits) // blocks for i in range(blocks + 1)]
    parts = [sum(1 << i for i in bits[a:b]) for a, b in itertools.pairwise(edges)]
    return [sum(c) for c in itertools.combinations(parts, blocks - far)]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def near(prints: DataFrame, scratch: Scratch, *, far: int = 4, blocks: int = 6, hot_rows: int = 1_000_000, held_rows: int = 2_000_000) -> DataFrame:
    """(u, v): links that connect all distinct prints `f` within `far` bits, directly or through others."""
    whole, level, parts = (1 << 64) - 1, [(0, 0)], []
    open_ = prints.select("f", F.lit(0).cast("long").alias("g"), F.lit(0).alias("t"))
    while True:
        known, below = dict(level), []
        for t, fixed in level:
            below += [(t, fixed | m) for m in routes(whole & ~fixed, blocks, far)]
        masks = {t: [(n, F.lit(signed(m))) for n, (own, m) in enumerate(below) if own == t] for t in known}
        choice = F.lit(None)
        for t, own in masks.items():
            list_ = F.array(*[F.struct(F.lit(n).alias("n"), m.alias("m")) for n, m in own])
            choice = F.when(F.col("t") == t, list_).otherwise(choice) if len(masks) > 1 else list_
        routed = open_.select("f", F.explode(choice).alias("c")).select("f", F.col("c.n").alias("t"), F.xxhash64("c.n", F.col("f").bitwiseAND(F.col("c.m"))).alias("g"))
        hot = routed.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > hot_rows).select("g")
        last = len(parts) == 3 or min(64 - m.bit_count() for _, m in below) < blocks
        if last or hot.isEmpty():
            parts.append(routed.select("f", "g"))
            break
        hot = scratch.keep(hot, f"hot-{len(parts)}")
        parts.append(routed.join(hot, "g", "left_anti").select("f", "g"))
        open_ = scratch.keep(routed.join(hot, "g", "left_semi").select("f", "g", "t"), f"routed-{len(parts)}")
        level = [(r["t"], below[r["t"]][1]) for r in open_.select("t").distinct().collect()]  # masks, not rows: 15 at most a level above
    routed = parts[0]
    for p in parts[1:]:
        routed = routed.union(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answer(f: np.ndarray, g: np.ndarray) -> Iterator[pa.RecordBatch]:
            shared = np.r_[False, g[1:] == g[:-1]]
            shared[:-1] |= shared[1:].copy()
            u, v = link(g[shared], f[shared].view(np.uint64), far)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        held, size = [], 0
        for b in batches:
            if b.num_rows:
                held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
                size += b.num_rows
            if size > held_rows:
                f, g = (np.concatenate(x) for x in zip(*held, strict=True))
                end = int(np.searchsorted(g, g[-1]))  # the last route may go on
                if end:
                    yield from answer(f[:end], g[:end])
                held, size = [(f[end:], g[end:])], len(g) - end
        if size:
            yield from answer(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return routed.repartition("g").sortWithinPartitions("g").mapInArrow(run, "u long, v long")


def grouped(docs: DataFrame, far: int, shingle: int, **how) -> DataFrame:
    """doc_id, t, f, root (of the component), component_id (its smallest doc_id) of every row."""
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.keep(fingerprints(docs, shingle), "prints")
    distinct = scratch.keep(prints.groupBy("f").agg(F.min("doc_id").alias("low")), "distinct")
    edges = scratch.keep(near(distinct.select("f"), scratch, far=far, **how), "edges")
    tree = scratch.keep(components(edges, scratch), "tree")
    rooted = distinct.join(tree, distinct["f"] == tree["node"], "left").select("f", "low", F.coalesce("root", "f").alias("root"))
    named = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return prints.join(rooted.join(named, "root").select("f", "root", "component_id"), "f")


def near_dedup(docs: DataFrame, *, far: int = 4, shingle: int = 4, **how) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable over links of at most `far` bits).

    Null and wordless texts have fingerprint zero and link like any other. A null
    doc_id is carried, and its component is named by the smallest id that is not
    null. Every row of the input gives one row, repeated rows alike; texts of any
    length are read whole, an empty table gives an empty result.
    """
    return grouped(docs, far, shingle, **how).select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, *, far: int = 4, shingle: int = 4, **how) -> DataFrame:
    """One document of each component stays: that with its smallest id (a null one, if there is no other).

    Of several rows with that id in one component, the one whose text has the least
    hash stays, of rows alike in text either. All columns are carried, whatever
    their names; an empty table stays empty.
    """
    rows = grouped(docs, far, shingle, **how).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    best = rows.groupBy("root").agg(F.first("doc_id").alias("doc_id"), F.min("t").alias("t"))
    twins = rows.groupBy("root", "t").agg(F.count("*").alias("n"))
    return one_of_each(docs, best.join(twins, ["root", "t"]).select("doc_id", "t", "n"), "doc_id", text_hash())
