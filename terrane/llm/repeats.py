"""Suffix-array dedup: bytes covered by long strings that occur elsewhere too.

A lossless split comes first. Every `length`-byte window is named by its
minimal hash of GRAM bytes (with the window, `length` bytes determine it), so
equal windows have equal names wherever they stand. Runs of neighbouring
windows with one minimum are fragments. A fragment whose name occurs nowhere
else cannot hold a repeat and goes no further. The fragments of one name meet
in one task, equal ones as one with a count, and there the Burrows-Wheeler
transforms of shards of fragments are merged (bwt.py); intervals of the merged
order whose suffixes share `length` bytes are the repeats.

What meets in one task is bounded: where the distinct fragments of a name hold more
than HOT bytes, they are parted. Equal windows hold the gram of their name at the same
place, so the windows of a fragment are cut into blocks by that place, WIDTHS[0] to a
block, and a block goes under the hash of the bytes that all its windows share. Blocks
whose name occurs once go no further, equal ones are one again, and what is still hot
is parted into narrower blocks; those of one window are never hot. Each fragment gets
the repeats of its blocks in one row before its uses are joined to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm.bwt import repeated_runs
from terrane.llm.common import Scratch, claim, fresh

GRAM, BLOCK, GROUP, BATCH, HELD, USES, WORD = 32, 1 << 19, 1 << 16, 1 << 17, 16 << 20, 1 << 15, 8
HOT, FEW_NAMES, FEW_WINDOWS, FEW_ROWS, WIDTHS = 1 << 17, 1 << 18, 1 << 20, 1 << 9, (28, 5, 1)
BASE = 0x9E3779B97F4A7C15
PLACES = np.uint64(0xFFFFF)
_powers: dict = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["up"], _powers["down"]


def gram_hashes(part: np.ndarray, up: np.ndarray, down: np.ndarray) -> np.ndarray:
    """A hash for each gram, 44 bits; the low bits tell places apart, and among equal hashes the last place is least."""
    sums = np.zeros(len(part) + 1, np.uint64)
    np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=sums[1:])
    h = (sums[GRAM:] - sums[:-GRAM]) * down[: len(part) - GRAM + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return (h & ~PLACES) | (PLACES - np.arange(len(h), dtype=np.uint64))  # BLOCK + length <= 2 ** 20


def fragments(texts: Iterable[np.ndarray], length: int) -> list[np.ndarray]:
    """Text (its number), name, first window and number of windows of each fragment of some texts.

    Texts are cut every BLOCK windows and taken together in groups of about GROUP bytes.
    """
    found, group, size = [[np.zeros(0, np.int64)] * 4], [], 0
    for k, data in enumerate(texts):
        for lo in range(0, len(data) - length + 1, BLOCK):
            part = data[lo : lo + BLOCK + length - 1]
            if group and size + len(part) > GROUP:
                found.append(fragments_of(group, length))
                group, size = [], 0
            group.append((k, lo, part))
            size += len(part)
    if group:
        found.append(fragments_of(group, length))
    return [np.concatenate(x) for x in zip(*found, strict=True)]


def fragments_of(group: list[tuple[int, int, np.ndarray]], length: int) -> list[np.ndarray]:
    """The fragments of (text, first byte, bytes) laid end to end; windows that cross from one to the next are left out."""
    w = length - GRAM + 1
    text, lo, parts = zip(*group, strict=True)
    sizes = np.array([len(x) for x in parts])
    starts = np.cumsum(sizes) - sizes
    h = gram_hashes(np.concatenate(parts), *powers(BLOCK + length))
    n = len(h) - w + 1
    rows = np.concatenate([h, np.full(-len(h) % w, 2**64 - 1, np.uint64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(rows, 1).ravel()[w - 1 : w - 1 + n]
    least = np.minimum(np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()[:n], ahead)
    new = np.r_[True, least[1:] != least[:-1]]
    new[starts] = True
    owner = np.repeat(np.arange(len(parts)), sizes)
    first = np.flatnonzero(new)
    ends = (starts + sizes - length + 1)[owner[first]]
    inside = first < ends
    first, ends, own = first[inside], np.minimum(np.r_[first[1:], n], ends)[inside], owner[first[inside]]
    return [np.array(text)[own], (least[first] >> np.uint64(20)).astype(np.int64), first - starts[own] + np.array(lo)[own], ends - first]


def raw(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def keys(docs: DataFrame) -> tuple[Column, Column]:
    """A row's key is its id (a hash, if that is no integer; null: the least long) and a hash of its text: rows alike in both are alike in their repeats."""
    whole = docs.schema["doc_id"].dataType.typeName() in ("byte", "short", "integer", "long")
    own = F.col("doc_id").cast("long") if whole else F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id"))
    return F.coalesce(own, F.lit(-(2**63))), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def name_fragments(docs: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, FEW_ROWS):
                some = b.slice(lo, FEW_ROWS)
                at, name, first, n = map(pa.array, fragments((raw(t.as_py()) for t in some.column(2)), length))
                yield pa.RecordBatch.from_arrays([name, some.column(0).take(at), some.column(1).take(at), first.cast("int32"), n.cast("int32")], ["name", "_d", "_t", "first", "n"])

    return docs.select("_d", "_t", "text").mapInArrow(run, "name long, _d long, _t long, first int, n int")


def cut_fragments(docs: DataFrame, length: int) -> DataFrame:
    """From (_d, _t, text, list of name, first, n): a row for each fragment, and for each distinct one of a task its bytes and count."""
    schema = "name long, digest binary, _d long, _t long, first int, n int, count long, bytes binary"

    def rows(uses: list, some: dict) -> pa.RecordBatch:
        whole = [(k[0], k[1], None, None, None, v[0], v[1], v[2]) for k, v in some.items()]
        columns = list(zip(*[(*u, None, None) for u in uses], *whole, strict=True))
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["name", "digest", "_d", "_t", "first", "n", "count", "bytes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("repeats")
        some, held, uses = {}, 0, []
        for b in batches:
            ends, found = b.column(3).offsets.to_numpy(), b.column(3).values
            parts = [found.field(c).to_numpy() for c in ("name", "first", "n")]
            for row, (d, t, text) in enumerate(zip(*(b.column(i) for i in range(3)), strict=True)):
                d, t, data = d.as_py(), t.as_py(), raw(text.as_py()).tobytes()
                for name, first, n in zip(*(x[ends[row] : ends[row + 1]].tolist() for x in parts), strict=True):
                    piece = data[first : first + n + length - 1]
                    digest = hashlib.blake2b(piece, digest_size=16).digest()
                    uses.append((name, digest, d, t, first, n))
                    own = some.get((name, digest))
                    if own is None:
                        some[name, digest] = [n, 1, piece]
                        held += len(piece) + 200
                    else:
                        own[1] += 1
                    if len(uses) >= USES:
                        yield rows(uses, {})
                        uses = []
                if held > HELD:
                    yield from (rows([], dict(x)) for x in batched(some.items(), USES // 8))
                    some, held = {}, 0
        if uses:
            yield rows(uses, {})
        yield from (rows([], dict(x)) for x in batched(some.items(), USES // 8))

    return docs.mapInArrow(run, schema)


def over_hot(pieces: DataFrame, digest: str) -> DataFrame:
    """The names whose distinct fragments hold more than HOT bytes."""
    each = pieces.groupBy("name", digest).agg(F.max(F.length("bytes")).alias("b"))
    return each.groupBy("name").agg(F.sum("b").alias("b")).where(F.col("b") > HOT).select("name")


def blocks_of(piece: bytes, n: int, place: int | None, length: int, width: int) -> Iterator[tuple[int, int, int, int, bytes]]:
    """The blocks of a fragment's windows: first window, number of windows, place of the gram, name, bytes.

    A window that starts k before the gram belongs to block k // width. All windows of a
    block hold the same length - width + 1 bytes, which name it: equal windows have equal names.
    """
    if place is None:
        place = int(np.argmin(gram_hashes(np.frombuffer(piece[:length], np.uint8), *powers(length))))
    hi = place
    while hi > place - n:
        lo = max(hi // width * width, place - n + 1)
        first, k = place - hi, hi // width * width
        shared = piece[place - k : place - k + length - width + 1]
        name = hashlib.blake2b(shared, digest_size=8, salt=f"{width}:{k}".encode()).digest()
        yield first, hi - lo + 1, hi, int.from_bytes(name, "little", signed=True), piece[first : first + hi - lo + length]
        hi = lo - 1


def parted(pieces: DataFrame, length: int, width: int) -> DataFrame:
    """The blocks of (name, digest, n, place, count, bytes), with shift, the block's first window."""
    schema = "name long, digest binary, part_name long, part_digest binary, shift int, n int, place int, count long, bytes binary"
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
    names = ["name", "digest", "part_name", "part_digest", "shift", "n", "place", "count", "bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, USES // 8):
                rows = []
                for name, digest, n, place, count, piece in zip(*(c.to_pylist() for c in b.slice(lo, USES // 8).columns), strict=True):
                    for first, m, at, part_name, part in blocks_of(piece, n, place, length, width):
                        rows.append((name, digest, part_name, hashlib.blake2b(part, digest_size=16, person=b"part").digest(), first, m, at, count, part))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return pieces.select("name", "digest", "n", "place", "count", "bytes").mapInArrow(run, schema)


def split_hot(pieces: DataFrame, scratch: Scratch, length: int) -> tuple[DataFrame, list[DataFrame]]:
    """From (name, digest, n, count, bytes): the same with the fragments of hot names in parts, and where the parts lie.

    The second has a table for each width that was needed: name, digest, and part_name,
    part_digest, shift of each of their parts whose name occurs more than once.
    """
    some = lambda df, most: F.broadcast(df) if df.count() <= most else df
    out, places = [], []
    pieces = pieces.withColumn("place", F.lit(None).cast("int"))
    for width in WIDTHS:
        hot = scratch.keep(over_hot(pieces, "digest"), f"hot-{width}")
        if hot.isEmpty():
            break
        hot = some(hot, FEW_NAMES)
        out.append(pieces.join(hot, "name", "left_anti"))
        warm = pieces.join(hot, "name", "left_semi").groupBy("name", "digest").agg(F.first("n").alias("n"), F.first("place").alias("place"), F.sum("count").alias("count"), F.first("bytes").alias("bytes"))
        parts = scratch.keep(parted(warm, length, width), f"parts-{width}")
        shared = scratch.keep(parts.groupBy("part_name").agg(F.sum("count").alias("c")).where("c > 1").select("part_name"), f"shared-{width}")
        parts = parts.join(some(shared, FEW_WINDOWS), "part_name", "left_semi")
        places.append(scratch.keep(parts.select("name", "digest", "part_name", "part_digest", "shift"), f"places-{width}"))
        pieces = parts.groupBy(F.col("part_name").alias("name"), F.col("part_digest").alias("digest")).agg(F.first("n").alias("n"), F.sum("count").alias("count"), F.first("bytes").alias("bytes"), F.first("place").alias("place"))
        pieces = scratch.keep(pieces, f"pieces-{width}")
        for name in ("parts", "shared"):
            scratch.free(f"{name}-{width}")
    out.append(pieces)
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole.drop("place"), places


def put_together(repeats: DataFrame, places: list[DataFrame], scratch: Scratch) -> DataFrame:
    """The repeats (name, digest, runs) with those of fragments that were parted, in one row for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for parts in b.column(2).to_pylist():
                ends: list[int] = []
                for x, y in sorted((r[i], r[i + 1]) for r in parts for i in range(0, len(r), 2)):
                    if ends and x <= ends[-1]:
                        ends[-1] = max(ends[-1], y)
                    else:
                        ends += [x, y]
                out.append(ends)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.int32()))], ["name", "digest", "runs"])

    for k, parts in reversed([*enumerate(places)]):
        met = parts.join(repeats.toDF("part_name", "part_digest", "runs"), ["part_name", "part_digest"])
        lists = met.groupBy("name", "digest").agg(F.collect_list(F.transform("runs", lambda x: x + F.col("shift"))).alias("parts"))
        repeats = repeats.unionByName(scratch.keep(lists.mapInArrow(run, "name long, digest binary, runs array<int>"), f"whole-{k}"))
    return repeats


def find_repeats(pieces: DataFrame, length: int, width: int) -> DataFrame:
    """From (name, digest, n, count, bytes), the fragments that hold repeats: name, digest, runs of places (first, end, first, end ...)."""

    def solve(batch: dict) -> pa.RecordBatch | None:
        n, count, piece = zip(*batch.values(), strict=True)
        string, first, end = repeated_runs(list(piece), np.array(count), np.array(n), length, width)
        if not len(string):
            return None
        at = np.flatnonzero(np.r_[True, string[1:] != string[:-1]])
        held = list(batch)
        names, digests = zip(*[held[k] for k in string[at].tolist()], strict=True)
        runs = pa.ListArray.from_arrays(pa.array(np.r_[2 * at, 2 * len(string)].astype(np.int32)), pa.array(np.stack([first, end], 1).ravel().astype(np.int32)))
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(digests, pa.binary()), runs], ["name", "digest", "runs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("repeats")
        held: dict = {}
        size, last = 0, None

        def answer() -> Iterator[pa.RecordBatch]:
            got = solve(held) if held else None
            if got:
                yield got

        for b in batches:
            for name, digest, n, count, piece in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if size > BATCH and name != last:
                    yield from answer()
                    held, size = {}, 0
                last = name
                own = held.get((name, digest))
                if own is None:
                    held[name, digest] = [n, count, piece]
                    size += len(piece)
                else:
                    own[1] += count
        yield from answer()

    ordered = pieces.select("name", "digest", "n", "count", "bytes").repartition("name").sortWithinPartitions("name")
    return ordered.mapInArrow(run, "name long, digest binary, runs array<int>")


def repeat_spans(docs: DataFrame, scratch: Scratch, *, length: int = 200, width: int = WORD) -> DataFrame:
    """From (_d, _t, text): _d, _t and the sorted byte spans (a, b) to remove, for those that have any.

    Rows of one key have the same fragments; sets list them once, so that the work
    grows with the rows, not with their square.
    """
    names = scratch.keep(name_fragments(docs, length), "names")
    shared = scratch.keep(names.groupBy("name").agg(F.count("*").alias("c")).where("c > 1").select("name"), "shared")  # a table, so that a hot name's join can be split
    listed = names.join(shared, "name").groupBy("_d", "_t").agg(F.collect_set(F.struct("name", "first", "n")).alias("names"))
    held = docs.select("_d", "_t", "text").join(listed, ["_d", "_t"])
    cut = scratch.keep(cut_fragments(held, length), "cut")
    scratch.free("names")
    pieces, parts = split_hot(cut.where(F.col("bytes").isNotNull()).select("name", "digest", "n", "count", "bytes"), scratch, length)
    repeats = scratch.keep(find_repeats(pieces, length, width), "found")
    repeats = put_together(repeats, parts, scratch)
    uses = cut.where(F.col("bytes").isNull()).select("name", "digest", "_d", "_t", "first")
    runs = uses.join(repeats, ["name", "digest"])
    spans = F.transform(F.sequence(F.lit(0), F.size("runs") - 1, F.lit(2)), lambda i: F.struct((F.col("first") + F.get("runs", i)).alias("a"), (F.col("first") + F.get("runs", i + 1) + length - 1).alias("b")))
    spans = scratch.keep(runs.select("_d", "_t", spans.alias("s")).groupBy("_d", "_t").agg(F.array_sort(F.flatten(F.collect_set("s"))).alias("spans")), "spans")
    for name in ("cut", "found", "shared", *(f"{x}-{width}" for x in ("hot", "places", "pieces") for width in WIDTHS), *(f"whole-{k}" for k in range(len(parts)))):
        scratch.free(name)
    return spans


def merged(spans: list | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s in spans or ():
        if out and s["a"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s["b"])
        else:
            out.append([s["a"], s["b"]])
    return [tuple(x) for x in out]


def whole_characters(data: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans shrunk so that no character is cut."""
    out = []
    for a, b in spans:
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        if b > a:
            out.append((a, b))
    return out


def with_spans(docs: DataFrame, length: int, width: int) -> tuple[DataFrame, str]:
    """The documents with one more column of spans, and its name."""
    own, text = keys(docs)
    keyed = docs.select(own.alias("_d"), text.alias("_t"), "text")
    spans = repeat_spans(keyed, Scratch(docs.sparkSession, "repeats"), length=length, width=width)
    d, t, s = fresh(docs, "row_id", "row_text", "row_spans")
    joined = docs.withColumns({d: own, t: text}).join(spans.toDF(d, t, s), [d, t], "left")
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], s), s


def remove_repeats(docs: DataFrame, *, length: int = 200, width: int = WORD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row, in bytes of UTF-8.

    A byte goes when a `length`-byte string that covers it starts anywhere else in
    the table, the same text included. Null is empty; texts under `length` bytes
    lose nothing. Rows of one id and text are separate documents that repeat each
    other. An empty table gives an empty result.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, spans in zip(b.column(1), b.column(2), strict=True):
                data, at, kept = raw(text.as_py()).tobytes(), 0, hashlib.sha256()
                runs = merged(spans.as_py())
                for x, y in runs:
                    kept.update(data[at:x])
                    at = y
                kept.update(data[at:])
                rows.append((len(data), sum(y - x for x, y in runs), len(runs), kept.hexdigest()))
            columns = [pa.array(c) for c in zip(*rows, strict=True)] if rows else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.string())]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    found, _ = with_spans(docs.select("doc_id", "text"), length, width)
    return found.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, *, length: int = 200, width: int = WORD) -> DataFrame:
    """The documents with their repeated passages cut out of `text` (never through a character); other columns stay, whatever their names."""
    schema, place = docs.schema, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for text, spans in zip(b.column(place), b.column(len(schema)), strict=True):
                data, at, kept = raw(text.as_py()).tobytes(), 0, []
                for x, y in whole_characters(data, merged(spans.as_py())):
                    kept.append(data[at:x])
                    at = y
                texts.append(b"".join([*kept, data[at:]]).decode("utf-8", "surrogatepass") if text.is_valid else None)
            columns = [pa.array(texts, pa.string()) if i == place else c for i, c in enumerate(b.columns[: len(schema)])]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return with_spans(docs, length, width)[0].mapInArrow(run, schema)
