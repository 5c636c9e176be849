"""Content-addressed store of token ids.

A document's ids are cut into chunks where a rolling hash of the last WINDOW
ids hits a mark, so equal passages cut alike wherever they stand. Each distinct
chunk is stored once, under its BLAKE2b digest. A document's recipe lists its
chunks; recipes are written in ascending order of doc_id with the place of the
document's first id in the whole stream. Manifests are Merkle trees: a document
has the root of its chunk digests, a part file the root of its documents, and
the store the root of its parts. Readers recompute all of them from the files.

Layout: data/kind=chunk/ (digest, payload: see whole()), data/kind=recipe/
(doc_id, digests, sizes), recipes/ (part, place, doc_id, start, n_tokens,
digests, root), manifest/ (part, first, documents, tokens, root).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm.common import Scratch, claim
from terrane.llm.words import library_encoder, with_end

WINDOW, MASK, LEAST, MOST, HELD = 16, np.uint64(0x1FF << 40), 64, 4096, 16 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
BLOCK = 1 << 17
UP, DOWN = np.full(BLOCK + WINDOW, BASE), np.full(BLOCK + WINDOW, INVERSE)  # BASE ** i and BASE ** (1 - i), modulo 2 ** 64
UP[0], DOWN[0] = 1, BASE
UP, DOWN = np.multiply.accumulate(UP), np.multiply.accumulate(DOWN)


def marks(ids: np.ndarray) -> np.ndarray:
    """Ends of the windows whose hash, the sum of (id + 1) * BASE ** (place from 1), has MASK clear once mixed."""
    found, sums = [np.zeros(0, np.int64)], np.zeros(BLOCK + WINDOW, np.uint64)
    for at in range(0, len(ids) - WINDOW + 1, BLOCK):
        some = ids[at : at + BLOCK + WINDOW - 1].astype(np.uint64)
        some += np.uint64(1)
        some *= UP[: len(some)]
        np.cumsum(some, out=sums[1 : len(some) + 1])
        n = len(some) - WINDOW + 1
        h = (sums[WINDOW : WINDOW + n] - sums[:n]) * DOWN[:n]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        found.append(np.flatnonzero(h & MASK == 0) + (at + WINDOW))
    return np.concatenate(found)


def cuts(ids: np.ndarray, bounds: np.ndarray) -> Iterator[list[int]]:
    """For each document between bounds: ends of its chunks, at marks of windows inside it, at least LEAST and at most MOST ids apart."""
    at = marks(ids)
    first, end = np.searchsorted(at, bounds[:-1] + WINDOW).tolist(), np.searchsorted(at, bounds[1:], "right").tolist()
    at = at.tolist()
    for last, stop, i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), first, end, strict=True):
        ends = []
        for e in at[i:j]:
            while e - last > MOST:
                last += MOST
                ends.append(last)
            if e - last >= LEAST:
                ends.append(e)
                last = e
        while stop - last > MOST:
            last += MOST
            ends.append(last)
        yield [*ends, stop] if last < stop or not ends else ends


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; leaves and nodes are told apart by their first byte."""
    level = [digest(b"\0" + x) for x in leaves] or [digest(b"")]
    while len(level) > 1:
        level = [digest(b"\1" + b"".join(level[i : i + 2])) for i in range(0, len(level), 2)]
    return level[0]


def multiply(a: int, b: int) -> int:
    """Product of two polynomials modulo that of CRC-32, bits reversed."""
    out, m = 0, 1 << 31
    while True:
        if a & m:
            out ^= b
            if not a & (m - 1):
                return out
        m >>= 1
        b = (b >> 1) ^ 0xEDB88320 if b & 1 else b >> 1


def multiply_all(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """multiply() of whole arrays (uint32)."""
    out, b = np.zeros_like(b), b.copy()
    for bit in range(31, -1, -1):
        out ^= b * (a >> np.uint32(bit) & np.uint32(1))
        b = b >> np.uint32(1) ^ (b & np.uint32(1)) * np.uint32(0xEDB88320)
    return out


def shifts(n: int, step: int) -> np.ndarray:
    """x ** (32 step i) modulo the polynomial, for the first n i: what `step` ids of 4 bytes move a checksum by, i times."""
    unit = 1 << 31
    for _ in range(32):
        unit = (unit >> 1) ^ 0xEDB88320 if unit & 1 else unit >> 1
    times = 1 << 31
    while step:
        times = multiply(times, unit) if step & 1 else times
        unit, step = multiply(unit, unit), step >> 1
    out = [1 << 31]
    while len(out) < n:
        out.append(multiply(out[-1], times))
    return np.array(out[:n], np.uint32)


def joined_crcs(sizes: np.ndarray, crcs: np.ndarray, bounds: np.ndarray, low: np.ndarray) -> np.ndarray:
    """CRC-32 of each document from those of its chunks: each moved past the ids behind it, then added."""
    ends = np.append(0, np.cumsum(sizes))
    behind = np.repeat(ends[bounds[1:]], np.diff(bounds)) - ends[1:]
    high = shifts(int(behind.max()) // len(low) + 1, len(low)) if len(behind) else low
    moved = multiply_all(crcs.astype(np.uint32), multiply_all(low[behind % len(low)], high[behind // len(low)]))
    return np.bitwise_xor.reduceat(moved, bounds[:-1]) if len(moved) else moved


#: Rows of the data files; {} is the type of doc_id.
MIXED = "doc_id {}, digests binary, sizes array<int>, digest binary, payload binary"


def data(spark: SparkSession, path: str, kind: str, id_type: str = "long") -> DataFrame:
    """The data rows of one kind; none where no file was written."""
    return spark.read.schema(f"{MIXED.format(id_type)}, kind string").parquet(f"{path}/data").where(F.col("kind") == kind)


def encode(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Rows of two kinds: recipes (doc_id, digests, sizes) and chunks (digest, payload), a chunk once in a task."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = library_encoder(tokenizer), set()
        claim(tokenizer, encoder.reset)
        for b in batches:
            row = 0
            for ids, bounds in encoder.groups(b.column(1)):
                ids, bounds = with_end(ids, bounds, end_id)
                data, half = ids.astype("<u4").tobytes(), ids.astype("<u2").tobytes() if ids.max() < 65_536 else None
                digests, every, found, payloads = [], [], [], []
                for at, ends in zip(bounds[:-1].tolist(), cuts(ids, bounds), strict=True):
                    names, sizes = [], []
                    for e in ends:
                        part = data[4 * at : 4 * e]
                        name = digest(part)
                        names.append(name)
                        sizes.append(e - at)
                        if name not in seen:
                            seen.add(name)
                            found.append(name)
                            payloads.append(b"\2" + half[2 * at : 2 * e] if half else b"\4" + part)
                        at = e
                    digests.append(b"".join(names))
                    every.append(sizes)
                if len(seen) > HELD // 16:
                    seen.clear()
                n, m = len(digests), len(found)
                columns = [
                    pa.concat_arrays([b.column(0).slice(row, n), pa.nulls(m, b.column(0).type)]),
                    pa.array(digests + [None] * m, pa.binary()),
                    pa.array(every + [None] * m, pa.list_(pa.int32())),
                    pa.array([None] * n + found, pa.binary()),
                    pa.array([None] * n + payloads, pa.binary()),
                ]
                row += n
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digests", "sizes", "digest", "payload"])

    return docs.select("doc_id", "text").mapInArrow(run, MIXED.format(kind))


def whole(payload: bytes) -> bytes:
    """A chunk's little-endian unsigned 32-bit ids: stored as low halves alone (after a 2) where all ids near it are under 65,536, else so (after a 4)."""
    return np.frombuffer(payload, "<u2", offset=1).astype("<u4").tobytes() if payload[:1] == b"\2" else payload[1:]


def write(docs: DataFrame, path: str, tokenizer: str, *, end_id: int) -> None:
    """Write the store. Null texts are empty (the end id alone); rows that share a doc_id stay apart, in order of their chunks' hash.

    Null ids come first. An empty table makes a store without documents.
    """
    mixed = encode(docs, tokenizer, end_id).withColumn("place", F.monotonically_increasing_id())
    key = F.coalesce(F.col("digest"), F.col("place").cast("string").cast("binary"))
    dealt = mixed.withColumn("key", key).repartition("key").sortWithinPartitions("digest").drop("key", "place")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Equal digests are neighbours here: the first of each run is stored."""
        last = None
        for b in batches:
            name = b.column(3)
            if len(name):
                other = pc.fill_null(pc.not_equal(name, pa.concat_arrays([pa.array([last], name.type), name.slice(0, len(name) - 1)])), True)
                last = name[-1].as_py()
                yield b.filter(other)

    stored = dealt.mapInArrow(once, MIXED.format(kind))
    is_chunk = F.col("digest").isNotNull()
    stored.withColumn("kind", F.when(is_chunk, "chunk").otherwise("recipe")).write.option("compression", "zstd").partitionBy("kind").parquet(f"{path}/data")
    spark = docs.sparkSession
    recipes = data(spark, path, "recipe", kind).select("doc_id", "digests", "sizes")
    order = (F.col("doc_id").asc_nulls_first(), F.xxhash64("digests"))  # range splitters stay small, and an id of many rows can be split
    ordered = recipes.repartitionByRange(*order).sortWithinPartitions(*order, "digests")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, place = 0, 0
        for b in batches:
            n = np.array([sum(s) for s in b.column(2).to_pylist()], np.int64)
            ends = at + np.cumsum(n)
            roots = [merkle([d[i : i + 16] for i in range(0, len(d), 16)]) for d in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n), pa.array(ends - n), pa.array(place + np.arange(len(n))), pa.array(roots, pa.binary())], ["doc_id", "digests", "sizes", "n_tokens", "inner", "place", "root"])
            at, place = int(ends[-1]) if len(ends) else at, place + len(n)

    numbered = ordered.mapInArrow(number, f"doc_id {kind}, digests binary, sizes array<int>, n_tokens long, inner long, place long, root binary")
    numbered = numbered.withColumn("part", F.spark_partition_id())
    if recipes.isEmpty():  # a file without rows keeps the columns
        numbered.coalesce(1).write.parquet(f"{path}/recipes")
    else:
        numbered.write.option("compression", "zstd").partitionBy("part").parquet(f"{path}/recipes")
    made = part_roots(spark, path)
    first, rows = 0, []
    for part, documents, tokens, root in made:
        rows.append((part, first, documents, tokens, bytes(root)))
        first += tokens
    rows.append((-1, 0, sum(r[2] for r in rows), first, merkle([r[4] for r in rows])))
    spark.createDataFrame(rows, "part int, first long, documents long, tokens long, root binary").coalesce(1).write.parquet(f"{path}/manifest")


def part_roots(spark: SparkSession, path: str) -> list:
    """part, documents, tokens, root of each recipe file, from its rows in order of place."""
    parts = spark.read.parquet(f"{path}/recipes").select("part", "place", "inner", "n_tokens", "root")

    def roots(key: tuple, some):
        import pandas as pd

        some = some.sort_values("place")
        if (some["n_tokens"].cumsum() - some["n_tokens"] != some["inner"]).any():
            raise ValueError(f"the recipes of part {key[0]} do not follow each other")
        return pd.DataFrame({"part": [key[0]], "documents": [len(some)], "tokens": [int(some["n_tokens"].sum())], "root": [merkle([bytes(r) for r in some["root"]])]})

    return sorted(parts.groupBy("part").applyInPandas(roots, "part int, documents long, tokens long, root binary").collect())  # a row for each file


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """digest, n, crc of every stored chunk, checked against its content."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, crc = [], []
            for name, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data = whole(payload)
                if digest(data) != name:
                    raise ValueError(f"chunk {name.hex()} does not hold what its digest says")
                n.append(len(data) // 4)
                crc.append(zlib.crc32(data))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32()), pa.array(crc, pa.int64())], ["digest", "size", "crc"])

    return data(spark, path, "chunk").select("digest", "payload").mapInArrow(check, "digest binary, size int, crc long")


def recipes(spark: SparkSession, path: str) -> DataFrame:
    """Recipes with their start in the whole stream, roots checked; one row per document and chunk: part, place, doc_id, start, n_tokens, i, digest."""
    manifest = {r["part"]: (r["first"], r["documents"], r["tokens"], bytes(r["root"])) for r in spark.read.parquet(f"{path}/manifest").collect()}
    if merkle([manifest[p][3] for p in sorted(manifest) if p >= 0]) != manifest[-1][3]:
        raise ValueError("the manifest's parts do not give its root")
    first, found = 0, {}
    for part, documents, tokens, root in part_roots(spark, path):
        found[part] = (first, documents, tokens, bytes(root))
        first += tokens
    found[-1] = (0, sum(x[1] for x in found.values()), first, manifest[-1][3])
    if wrong := sorted(p for p in manifest.keys() | found.keys() if manifest.get(p) != found.get(p)):
        raise ValueError(f"the recipes of parts {wrong} are not those of the manifest (-1: the whole store)")
    rows = spark.read.parquet(f"{path}/recipes")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, names = [], []
            for k, (part, data, root) in enumerate(zip(b.column(0).to_pylist(), b.column(5).to_pylist(), b.column(6).to_pylist(), strict=True)):
                leaves = [data[i : i + 16] for i in range(0, len(data), 16)]
                if merkle(leaves) != root:
                    raise ValueError(f"a recipe of part {part} does not give its root")
                own += [k] * len(leaves)
                names += leaves
            at = pa.array(own, pa.int64())
            first = np.array([manifest[p][0] for p in b.column(0).to_pylist()], np.int64)
            start = pa.array(first + b.column(3).to_numpy())
            i = np.arange(len(own)) - np.searchsorted(own, own)
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), b.column(2).take(at), start.take(at), b.column(4).take(at), pa.array(i, pa.int64()), pa.array(names, pa.binary())], ["part", "place", "doc_id", "start", "n_tokens", "i", "digest"])

    return rows.select("part", "place", "doc_id", "inner", "n_tokens", "digests", "root").mapInArrow(check, f"part int, place long, doc_id {kind}, start long, n_tokens long, i long, digest binary")


def summary(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files.

    Each chunk is read and checked once where it lies; a document's CRC-32 is
    joined from its chunks', so no ids move.
    """
    low = shifts(MOST, 1)
    joined = recipes(spark, path).join(chunks(spark, path), "digest", "left")
    parts = joined.groupBy("part", "place").agg(F.first("doc_id").alias("doc_id"), F.first("start").alias("start"), F.first("n_tokens").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("i", "size", "crc"))).alias("c"), F.count("*").alias("k"), F.count("crc").alias("found"))
    kind = parts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c, tokens = b.column(3), b.column(2).to_numpy()
            bounds = np.append(0, np.cumsum(c.value_lengths().to_numpy()))
            chunk = c.flatten()
            if not b.column(4).equals(b.column(5)) or chunk.field("size").null_count:
                raise ValueError("a document's chunks are missing")
            sizes = chunk.field("size").to_numpy().astype(np.int64)
            if len(c) and (np.add.reduceat(sizes, bounds[:-1]) != tokens).any():
                raise ValueError("a document's chunks are of other sizes")
            out = joined_crcs(sizes, chunk.field("crc").to_numpy(), bounds, low).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return parts.select("doc_id", "start", "n_tokens", "c", "k", "found").mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, ids of every document, rebuilt from its recipe."""
    payloads = data(spark, path, "chunk").select("digest", "payload")
    joined = recipes(spark, path).join(payloads, "digest", "left")
    gathered = joined.groupBy("part", "place").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("i", "digest", "payload"))).alias("c"))
    kind = gathered.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = []
            for c in b.column(1).to_pylist():
                parts = [whole(x["payload"]) for x in c]
                if any(digest(p) != x["digest"] for p, x in zip(parts, c, strict=True)):
                    raise ValueError("a chunk does not hold what its digest says")
                ids.append(np.frombuffer(b"".join(parts), "<u4").astype(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "ids"])

    return gathered.select("doc_id", "c").mapInArrow(run, f"doc_id {kind}, ids array<long>")


def store_and_check(docs: DataFrame, tokenizer: str, *, end_id: int) -> DataFrame:
    """Write a store of the documents in the shared folder and return summary() of its files."""
    spark = docs.sparkSession
    path = Scratch(spark, "store").path
    write(docs, path, tokenizer, end_id=end_id)
    return summary(spark, path)
