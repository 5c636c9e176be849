"""Merging Burrows-Wheeler transforms of shards by iterative interleave refinement.

Symbols are words of `width` bytes (1: the bytes themselves; 8 at most, so a word
is a number), so that few rounds reach the wanted depth: a string is read as
`width` chains, one for each offset modulo the width, each with an end mark of its
own. A shard's suffixes are sorted once, by itself; its transform is kept as the
map from each suffix to the next of its chain, the permutation that sorts the
transform stably, with the common prefix of every two neighbours.

To merge shards, an interleave says which suffix stands at each place of the
merged order. It starts with the suffixes of all shards sorted by one symbol,
which merges sorted runs, and each round sorts every block of suffixes that share
what was read so far by the places of their next suffixes, which reads one symbol
more; the order within a shard never has to be worked out again. A block with
suffixes of one shard alone is settled: its order and common prefixes are the
shard's. So only blocks that shards share are refined, and after depth / width
rounds the intervals of suffixes that repeat their first `depth` bytes are known.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SHIFT, LOW, SHARD = np.uint64(32), np.uint64(0xFFFFFFFF), 1 << 16


@dataclass
class Shard:
    """Sorted suffixes. Suffixes are places in the padded concatenation of the shard's strings; ends come first."""

    order: np.ndarray  # suffixes in sorted order
    first: np.ndarray  # first symbol of each, in that order
    after: np.ndarray  # where in the order the next suffix of its chain stands
    common: np.ndarray  # symbols shared with the suffix before, at most the wanted rounds
    ends: int


def dense(high: np.ndarray, low: np.ndarray | None = None) -> np.ndarray:
    """Ranks of keys (of pairs, with `low`), equal keys alike.

    Key and place are sorted as one number where they fit in 64 bits: that is one plain sort.
    """
    n = len(high)
    if not n:
        return np.zeros(0, np.int64)
    bits, low_bits = n.bit_length(), int(low.max()).bit_length() if low is not None else 0
    key = high.astype(np.uint64)
    if int(key.max()).bit_length() + low_bits > 64 - bits:
        order = np.argsort(high) if low is None else np.lexsort((low, high))
        new = high[order][1:] != high[order][:-1]
        if low is not None:
            new |= low[order][1:] != low[order][:-1]
    else:
        if low is not None:
            key = (key << np.uint64(low_bits)) | low.astype(np.uint64)
        key = (key << np.uint64(bits)) | np.arange(n, dtype=np.uint64)
        key.sort()
        order = (key & np.uint64((1 << bits) - 1)).astype(np.int64)
        key >>= np.uint64(bits)
        new = key[1:] != key[:-1]
    ranks = np.empty(n, np.int64)
    ranks[order] = np.cumsum(np.r_[False, new])
    return ranks


def words(data: np.ndarray, width: int) -> np.ndarray:
    """The `width` bytes at every place as one number (zeros after the end)."""
    padded = np.concatenate([data, np.zeros(width, np.uint8)])
    key = np.zeros(len(data), np.uint64)
    for i in range(width):
        key = (key << np.uint64(8)) | padded[i : i + len(data)]
    return key


def layout(strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Concatenation with `width` end places after each string: data, is an end, starts."""
    sizes = np.array([len(s) for s in strings], np.int64)
    starts = np.cumsum(sizes + width) - sizes - width
    data = np.frombuffer(b"".join(s + bytes(width) for s in strings), np.uint8)
    owner = np.repeat(np.arange(len(strings)), sizes + width)
    return data, np.arange(len(data)) - starts[owner] >= sizes[owner], starts


def build(symbols: np.ndarray, end: np.ndarray, width: int, rounds: int) -> Shard:
    """One shard's suffix order, by prefix doubling over its symbols; the ranks of every level give the common prefixes."""
    n, ends = len(symbols), int(end.sum())
    rank = np.empty(n, np.int64)
    rank[end] = np.arange(ends)
    rank[~end] = dense(symbols[~end]) + ends
    levels, jump = [rank.astype(np.int32)], width
    while int(rank.max(initial=0)) < n - 1:
        after = np.zeros(n, np.int64)
        after[: max(0, n - jump)] = rank[jump:]
        rank, jump = dense(rank, np.where(rank < ends, 0, after)), 2 * jump
        levels.append(rank.astype(np.int32))
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    a, b, common = order[:-1], order[1:], np.zeros(max(0, n - 1), np.int64)
    for k in range(len(levels) - 2, -1, -1):  # at the last level all differ
        step = np.minimum(np.maximum(a, b) + common * width, n - 1)
        ahead = step - np.maximum(a, b)
        common += (levels[k][a + ahead] == levels[k][b + ahead]) << k
    return Shard(order, symbols[order], rank[np.minimum(order + width, n - 1)], np.r_[0, np.minimum(common, rounds)] if n else common, ends)


def merge(shards: list[Shard], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix of each place of the merged order (numbered through the shards' orders), and its common prefix with the place before.

    The prefix is in symbols: `rounds` stands for that many or more.
    """
    sizes = np.array([len(s.order) for s in shards])
    base = np.cumsum(sizes) - sizes
    n, ends = int(sizes.sum()), sum(s.ends for s in shards)
    first = np.concatenate([s.first for s in shards])
    after = np.concatenate([s.after + a for s, a in zip(shards, base, strict=True)])
    owner = np.repeat(np.arange(len(shards), dtype=np.int16), sizes)
    own_common = np.concatenate([s.common for s in shards])
    is_end = np.concatenate([np.arange(len(s.order)) < s.ends for s in shards])
    inner = np.flatnonzero(~is_end)
    inner = inner[np.argsort(first[inner], kind="stable")]
    item = np.concatenate([np.flatnonzero(is_end), inner])
    place = np.empty(n, np.int64)
    place[item] = np.arange(n)
    before = np.full(n, -1, np.int64)  # of each suffix, the one before in its chain
    before[after[inner]] = inner
    new = np.zeros(n, bool)
    new[ends + 1 :] = first[inner[1:]] != first[inner[:-1]]
    if n:
        new[0] = True
        new[min(ends, n - 1)] |= ends < n
    common = np.where(new, 0, rounds)
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    shared = shared_blocks(owner[item], new)
    shared[:ends] = False  # end marks count as one symbol: nothing is known beyond them
    active = np.flatnonzero(shared)
    for h in range(2, rounds + 1):
        if not len(active):
            break
        key = (start[active].astype(np.uint64) << SHIFT) | place[after[item[active]]].astype(np.uint64)
        key.sort()
        beyond = (key & LOW).astype(np.int64)
        block, following = key >> SHIFT, start[beyond]
        cut = np.r_[True, (block[1:] != block[:-1]) | (following[1:] != following[:-1])]
        moved = before[item[beyond]]
        fresh = cut & (active != start[active])
        common[active[fresh]] = h - 1
        item[active] = moved
        place[moved] = active
        start[active] = active[np.maximum.accumulate(np.where(cut, np.arange(len(cut)), 0))]
        active = active[shared_blocks(owner[moved], cut)]
    # What was never parted further: neighbours of one shard share what they share there.
    alone = (common == rounds) & np.r_[False, owner[item[1:]] == owner[item[:-1]]] if n else np.zeros(0, bool)
    alone[:ends] = False
    alone[active] = False
    return item, np.where(alone, own_common[item], common)


def shared_blocks(owner: np.ndarray, new: np.ndarray) -> np.ndarray:
    """For each place, whether its block (from one `new` to the next) has suffixes of several shards."""
    if not len(owner):
        return np.zeros(0, bool)
    at = np.flatnonzero(new)
    mixed = np.minimum.reduceat(owner, at) != np.maximum.reduceat(owner, at)
    return np.repeat(mixed, np.diff(np.r_[at, len(owner)]))


def marked(strings: list[bytes], weights: np.ndarray, starts: np.ndarray, depth: int, width: int, shard_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """For the places of all strings, one after another with `width` end places after each: does a repeat begin there; and where each string begins."""
    if depth % width or not 1 <= width <= 8:
        raise ValueError("depth must be a multiple of width, and width at most 8")
    data, end, first = layout(strings, width)
    symbols, rounds = words(data, width), depth // width
    sizes = np.array([len(s) + width for s in strings])
    shard_of = (np.cumsum(sizes) - sizes) // max(shard_bytes, 1)
    cuts = np.r_[first[np.flatnonzero(np.r_[True, shard_of[1:] != shard_of[:-1]])], len(data)]
    shards = [build(symbols[a:b], end[a:b], width, rounds) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    item, common = merge(shards, rounds)
    order = np.concatenate([s.order + a for s, a in zip(shards, cuts[:-1], strict=True)])[item]
    owner = np.repeat(np.arange(len(strings)), sizes)
    counts = np.where(np.arange(len(data)) - first[owner] < starts[owner], weights[owner], 0)
    interval = np.flatnonzero(common < rounds)
    total = np.add.reduceat(counts[order], interval)
    flag = np.zeros(len(data), bool)
    flag[order] = np.repeat(total >= 2, np.diff(np.r_[interval, len(data)]))
    flag &= counts > 0
    return flag, first


def repeated(strings: list[bytes], weights: np.ndarray, starts: np.ndarray, depth: int, width: int = 8, shard_bytes: int = SHARD) -> list[np.ndarray]:
    """For each string, which of its first `starts` places begin a `depth`-byte string of total weight 2 or more in all of them.

    A string stands for `weights` equal copies. depth must be a multiple of width.
    """
    if not strings:
        return []
    flag, first = marked(strings, weights, starts, depth, width, shard_bytes)
    return [flag[a : a + n] for a, n in zip(first.tolist(), starts.tolist(), strict=True)]


def repeated_runs(strings: list[bytes], weights: np.ndarray, starts: np.ndarray, depth: int, width: int = 8, shard_bytes: int = SHARD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places of repeated() as runs: string, first place and end of each, in order."""
    if not strings:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    flag, first = marked(strings, weights, starts, depth, width, shard_bytes)
    edges = np.flatnonzero(np.diff(flag, prepend=False, append=False))  # end places part the runs of two strings
    string = np.searchsorted(first, edges[::2], "right") - 1
    return string, edges[::2] - first[string], edges[1::2] - first[string]
