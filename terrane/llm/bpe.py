"""Byte-level BPE from a rank file, in padded numpy matrices.

Distinct pieces of the pre-tokenizer are bucketed by length into matrices of
token ids. Each round finds, by a hashed pair lookup, the leftmost pair of
minimum rank of every row, merges it, closes the gap and drops the rows that
are done. Where the next rounds would only merge that pair's other places in
turn, these go in the same round, so that long pieces take few rounds.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from terrane.llm.common import claim
from terrane.llm.words import Encoder

CELLS = 1_000_000
NONE = np.int32(2**31 - 1)
_open: dict = {}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, map(bytes.strip, f)))}


class Bpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pieces = ranks, regex.compile(pattern).findall
        self.tokens = {i: t for t, i in ranks.items()}
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        left, right, rank = np.array(pairs, np.int64).reshape(-1, 3).T
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        size = 1 << max(4, (4 * len(keys)).bit_length())
        self.mask, self.keys, self.values = np.uint64(size - 1), np.zeros(size, np.uint64), np.full(size, NONE, np.int32)
        todo, slot = np.arange(len(keys)), self.slot(keys)
        self.probes = 0
        while len(todo):  # all of a round try their slots; the first of each free slot gets it
            self.probes += 1
            free = np.flatnonzero(self.values[slot[todo]] == NONE)
            won = free[np.unique(slot[todo[free]], return_index=True)[1]]
            k = todo[won]
            self.keys[slot[k]], self.values[slot[k]] = keys[k], rank[k]
            todo = np.delete(todo, won)
            slot[todo] = (slot[todo] + np.uint64(1)) & self.mask

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) & self.mask

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; NONE where there is none or a side is padding (negative)."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | (right.astype(np.uint64) & np.uint64(0xFFFFFFFF))
        out = np.full(keys.shape, NONE, np.int32)
        at = np.flatnonzero((left >= 0) & (right >= 0))
        keys = keys.ravel()[at]
        slot, flat = self.slot(keys), out.ravel()
        for _ in range(self.probes):
            value = self.values[slot]
            hit = self.keys[slot] == keys
            taken = value != NONE
            flat[at[hit & taken]] = value[hit & taken]
            on = taken & ~hit
            if not on.any():
                break
            at, keys, slot = at[on], keys[on], (slot[on] + np.uint64(1)) & self.mask
        return out

    def together(self, ids: np.ndarray, low: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
        """Which of the places of the rows' minimum rank go in one round: those that single merges would take one after another.

        Places side by side share a token, so every second one of a run goes. A merge
        after which a pair of a lower rank stands beside it is the last of its row.
        """
        first = np.r_[True, row[1:] != row[:-1]]
        at, run = np.arange(len(row)), first | np.r_[True, col[1:] != col[:-1] + 1]
        even = np.flatnonzero((at - np.maximum.accumulate(np.where(run, at, 0))) % 2 == 0)
        row, col = row[even], col[even]
        first, new = np.r_[True, row[1:] != row[:-1]], low[row]
        left = np.where(col > 0, ids[row, np.maximum(col - 1, 0)], np.int32(-1))
        left[~first & np.r_[False, col[1:] == col[:-1] + 2]] = -2  # the token before is that of the last merge
        left = np.where(left == -2, new, left)
        right = np.where(col + 2 < ids.shape[1], ids[row, np.minimum(col + 2, ids.shape[1] - 1)], np.int32(-1))
        ends = (self.rank_of(left, new) < new) | (self.rank_of(new, right) < new)
        before = np.cumsum(ends) - ends
        return even[before == np.maximum.accumulate(np.where(first, before, 0))]

    def merge_rows(self, rows: list[bytes]) -> list[np.ndarray]:
        """Ids of byte strings of about one length."""
        width = max(map(len, rows))
        sizes = np.array([len(r) for r in rows])
        raw = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), np.uint8).reshape(-1, width)
        ids = np.where(np.arange(width) < sizes[:, None], self.byte[raw], np.int32(-1))
        done: list = [None] * len(rows)
        alive = np.arange(len(rows))
        rank = np.full(ids.shape, NONE, np.int32)  # of each token with the next
        rank[:, :-1] = self.rank_of(ids[:, :-1], ids[:, 1:])
        while True:
            low = rank.min(1)
            over = low == NONE
            if over.any():
                for k, row, n in zip(alive[over].tolist(), ids[over].tolist(), sizes[over].tolist(), strict=True):
                    done[k] = row[:n]
                alive, ids, rank, low, sizes = alive[~over], ids[~over], rank[~over], low[~over], sizes[~over]
                if not len(alive):
                    return done
            row, col = np.nonzero(rank == low[:, None])
            if len(row) > len(ids):
                take = self.together(ids, low, row, col)
                row, col = row[take], col[take]
            ids[row, col] = low[row]
            keep = ids >= 0
            keep[row, col + 1] = False
            sizes = sizes - np.bincount(row, minlength=len(ids))
            width, gone = int(sizes.max()), np.arange(len(row)) - np.searchsorted(row, row)
            own, old_ids, old_rank = np.nonzero(np.arange(width) < sizes[:, None]), ids[keep], rank[keep]
            ids, rank = np.full((len(ids), width), np.int32(-1)), np.full((len(ids), width), NONE, np.int32)
            ids[own], rank[own] = old_ids, old_rank
            col = col - gone
            rank[row, col] = NONE
            right = col + 1 < width
            rank[row[right], col[right]] = self.rank_of(ids[row[right], col[right]], ids[row[right], col[right] + 1])
            left = col > 0
            rank[row[left], col[left] - 1] = self.rank_of(ids[row[left], col[left] - 1], ids[row[left], col[left]])

    def encode_pieces(self, pieces: list[bytes]) -> list:
        out = [None if (r := self.ranks.get(p)) is None else [r] for p in pieces]
        todo = sorted((k for k, x in enumerate(out) if x is None), key=lambda k: len(pieces[k]))
        lo = 0
        while lo < len(todo):
            hi, least = lo + 1, len(pieces[todo[lo]])
            while hi < len(todo) and (hi - lo + 1) * (n := len(pieces[todo[hi]])) <= CELLS and n <= max(8, least * 5 // 4):
                hi += 1
            for k, ids in zip(todo[lo:hi], self.merge_rows([pieces[k] for k in todo[lo:hi]]), strict=True):
                out[k] = ids
            lo = hi
        return out

    def encode_chunks(self, chunks: list[str]) -> list:
        split = [[c.encode()] if alone(c) else [p.encode("utf-8", "surrogatepass") for p in self.pieces(c)] for c in chunks]
        distinct = list({p for s in split for p in s})
        coded = dict(zip(distinct, self.encode_pieces(distinct), strict=True))
        return [coded[s[0]] if len(s) == 1 else [i for p in s for i in coded[p]] for s in split]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


def alone(chunk: str) -> bool:
    """Whether a chunk surely is one piece: letters, after one blank at most."""
    return (chunk[1:] if chunk[:1] == " " else chunk).isalpha()


def opened(path: str, pattern: str) -> tuple[Bpe, Encoder]:
    """The rank file's tables, read once by each worker."""
    if (path, pattern) not in _open:
        bpe = Bpe(read_ranks(path), pattern)
        _open[path, pattern] = bpe, Encoder(bpe.encode_chunks)
    return _open[path, pattern]


def encode(texts: pa.Array | list[str | None], path: str, pattern: str) -> Iterator[np.ndarray]:
    return opened(path, pattern)[1].encode(texts)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (little-endian unsigned 32-bit ids), decoded_sha256 (bytes decoded from the ids).

    A null text is empty: no ids, and the digests of nothing. Every row gives one
    row, repeated ones alike; an empty table gives an empty result. The cuts that
    the memo makes (words.py) are exact for the pattern and vocabularies of the
    public files it was tested with, not for any pattern.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, encoder = opened(path, pattern)
        claim(path, encoder.reset)
        for b in batches:
            n, coded, decoded = [], [], []
            for ids in encode(b.column(1), path, pattern):
                n.append(len(ids))
                coded.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            columns = [b.column(0), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
