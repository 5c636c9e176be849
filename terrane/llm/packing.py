"""Vector bin packing of training pieces by the dot-product heuristic.

A bin (sequence) has limits on tokens, segments and loss-bearing tokens at the
same time. Bins are filled one after another: of the pieces that still fit, the
one whose demand vector has the largest weighted dot product with the bin's
remaining room goes in, until none fits. Pieces of equal demand are one type
with a count, so a choice is one pass over the types.

Pieces are dealt by a hash of their id and place into blocks of bounded expected
size, each packed by itself, so nothing is ever gathered in one place; only ids
and sizes move. The blocks follow from the number of pieces, counted in a table
of ids and sizes that is written first.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import Scratch, claim, fresh
from terrane.llm.words import library_encoder, with_end

BLOCK_ROWS = 20_000


def fill(demand: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bin and place within the bin of each row of `demand`; every row must fit an empty bin."""
    types, kind, left = np.unique(demand, axis=0, return_inverse=True, return_counts=True)
    kind = kind.ravel()
    members = np.split(np.argsort(kind, kind="stable"), np.cumsum(left)[:-1])
    share = types / limits
    weight = (share * left[:, None]).sum(0) / max(1, left.sum())
    worth = share * weight / limits
    bins, places = np.zeros(len(demand), np.int64), np.zeros(len(demand), np.int64)
    number, todo, taken = 0, len(demand), np.zeros(len(types), np.int64)
    size = np.ascontiguousarray(types.T)
    while todo:
        room, place, fit = limits.astype(float), 0, np.flatnonzero(taken >= 0)
        rest, value = size[:, fit], worth[fit]
        while len(fit):
            k = int(np.argmax(value @ room))
            t = int(fit[k])
            row = members[t][taken[t]]
            bins[row], places[row] = number, place
            room, place, todo = room - rest[:, k], place + 1, todo - 1
            taken[t] += 1
            on = rest[0] <= room[0]
            for own, most in zip(rest[1:], room[1:], strict=True):
                on &= own <= most
            if taken[t] == len(members[t]):
                on[k], taken[t] = False, -1
            if not on.all():
                fit, rest, value = fit[on], rest[:, on], value[on]
        number += 1
    return bins, places


def pack(pieces: DataFrame, *, tokens: int = 2048, segments: int = 512, loss: int = 2048, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds sequence_id and offset to pieces that have doc_id, start, `length` and `loss_tokens`.

    Every piece must respect the limits alone. Which pieces share a block is decided
    by a hash of id and start, not by the layout of files; only a block that equal or
    null ids make too large is dealt on by the place in the written table. Of equally
    good pieces the one with the least demand goes first. An empty table packs to an
    empty table; null ids and repeated rows are pieces like any other.
    """
    pieces = Scratch(pieces.sparkSession, "packing").keep(pieces, "pieces")
    blocks = max(1, -(-pieces.count() // block_rows))
    limits = np.array([tokens, segments, loss])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)

    def run(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        block = block.drop(columns=block_col).sort_values(["length", "loss_tokens"], kind="stable").reset_index(drop=True)
        size = block["length"].to_numpy(np.int64)
        bins, places = fill(np.stack([size, np.ones_like(size), block["loss_tokens"].to_numpy(np.int64)], 1), limits)
        order = np.lexsort((places, bins))
        ends = np.cumsum(size[order])
        first = np.r_[True, bins[order][1:] != bins[order][:-1]] if len(order) else np.zeros(0, bool)
        base = np.maximum.accumulate(np.where(first, ends - size[order], 0)) if len(order) else ends
        offset = np.empty(len(size), np.int64)
        offset[order] = ends - size[order] - base
        return block.assign(sequence_id=(int(key[0]) << 32) + bins, offset=offset)

    (block_col,) = fresh(pieces, "block")
    block = F.pmod(F.xxhash64("doc_id", "start"), F.lit(blocks))
    sizes = pieces.groupBy(block.alias("b")).agg(F.count("*").alias("n")).where(F.col("n") > 4 * block_rows)
    over = {r["b"]: -(-r["n"] // block_rows) for r in sizes.collect()}  # fewer than pieces / (4 block_rows)
    if over:
        parts = F.coalesce(F.create_map(*[F.lit(x) for kv in over.items() for x in kv])[block], F.lit(1))
        block = block + blocks * F.pmod(F.monotonically_increasing_id(), parts)
    return pieces.withColumn(block_col, block).groupBy(block_col).applyInPandas(run, f"{fields}, sequence_id long, offset long")


def pieces_of(docs: DataFrame, tokenizer: str, *, end_id: int, most: int = 2048) -> DataFrame:
    """Documents as token pieces of at most `most` ids: doc_id, start, length, loss_tokens, ids_crc32, doc_tokens.

    A null text is empty, and so one end id. The first id of a document has
    nothing before it to be predicted from, so it bears no loss.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(tokenizer)
        claim(tokenizer, encoder.reset)
        for b in batches:
            rows, start, length, crc, total = [], [], [], [], []
            k = 0
            for ids, bounds in encoder.groups(b.column(1)):
                ids, bounds = with_end(ids, bounds, end_id)
                data = memoryview(ids.astype("<u4").tobytes())
                for lo, hi in itertools.pairwise(bounds.tolist()):
                    for at in range(lo, hi, most):
                        size = min(most, hi - at)
                        rows.append(k)
                        start.append(at - lo)
                        length.append(size)
                        crc.append(zlib.crc32(data[4 * at : 4 * (at + size)]))
                        total.append(hi - lo)
                    k += 1
            start, length = np.array(start, np.int64), np.array(length, np.int64)
            columns = [b.column(0).take(pa.array(rows, pa.int64())), pa.array(start), pa.array(length), pa.array(length - (start == 0)), pa.array(crc, pa.int64()), pa.array(total, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "loss_tokens", "ids_crc32", "doc_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start long, length long, loss_tokens long, ids_crc32 long, doc_tokens long")


def pack_documents(docs: DataFrame, tokenizer: str, *, end_id: int = 1, tokens: int = 2048, **limits) -> DataFrame:
    """The documents' pieces with their sequence and offset: each id of each row lies in exactly one piece.

    Null texts are empty. Texts of any length are cut every `tokens` ids.
    """
    return pack(pieces_of(docs, tokenizer, end_id=end_id, most=tokens), tokens=tokens, **limits)


def turns_of(conversations: DataFrame, tokenizer: str, *, end_id: int, most: int = 2048, answers: str = "assistant") -> DataFrame:
    """Instruction data: each turn is a piece; only the answers' tokens bear loss."""
    named = conversations.select(F.struct("conv_id", "turn", "role").alias("doc_id"), "text")
    pieces = pieces_of(named, tokenizer, end_id=end_id, most=most)
    return pieces.withColumn("loss_tokens", F.when(F.col("doc_id.role") == answers, F.col("length")).otherwise(F.lit(0)).cast("long"))
