"""Toxicity: averaged subword-bag embeddings under a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its character n-grams and of itself, so a
misspelling never seen in training shares most of its vectors with the word it
hides. A text is read in consecutive windows of words, each the average of its
words; a softmax over two classes scores a window, and the text takes its worst
window, so one insult in a long text is not averaged away. Nothing but the text
is ever a feature.

Training reads a bounded sample of labelled rows (`per_class` documents of
the two labels, the smallest hashes of their ids); scoring reads every text whole.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from terrane.llm.common import claim

MEMO_WORDS, GROUP_CHARS = 600_000, 2_000_000
_memo: dict = {}


def features(word: str, buckets: int, low: int, high: int) -> list[int]:
    """Buckets of a word and of its character n-grams, with marks at both ends."""
    core = word.strip("\"'.,;:!?()[]{}<>«»¡¿-_*#") or word
    marked = f"<{core}>"
    crc = zlib.crc32
    if marked.isascii():
        raw = marked.encode()
        return [crc(raw[i : i + n]) % buckets for n in range(low, high + 1) for i in range(len(raw) - n + 1)] + [crc(raw) % buckets]
    grams = [marked[i : i + n] for n in range(low, high + 1) for i in range(len(marked) - n + 1)]
    return [crc(g.encode("utf-8", "surrogatepass")) % buckets for g in (*grams, marked)]


@dataclass(frozen=True)
class Model:
    """scalars: for each bucket, its vector's product with the softmax rows' difference."""

    key: str
    scalars: np.ndarray
    bias: float
    window: int
    low: int
    high: int

    def words(self, words: list[str]) -> list[float]:
        """Mean scalar of each word's buckets."""
        bags, sizes = array("i"), []
        for w in words:
            some = features(w, len(self.scalars), self.low, self.high)
            sizes.append(len(some))
            bags.extend(some)
        if not words:
            return []
        ends = np.cumsum(sizes)
        return (np.add.reduceat(self.scalars[np.frombuffer(bags, np.int32)], ends - sizes) / sizes).tolist()

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if _memo.get("key") != self.key:
            _memo.clear()
            _memo.update(key=self.key, words={})
        memo, out, group, size = _memo["words"], np.empty(len(texts)), [], 0
        for k, text in enumerate(texts):
            group.append(k)
            size += len(text or "")
            if size < GROUP_CHARS and k + 1 < len(texts):
                continue
            cut = [(texts[i] or "").lower().split() for i in group]
            new = list({w for ws in cut for w in ws if w not in memo})
            if len(memo) + len(new) > MEMO_WORDS:
                memo.clear()
                new = list({w for ws in cut for w in ws})
            memo.update(zip(new, self.words(new), strict=True))
            for i, ws in zip(group, cut, strict=True):
                z = self.bias
                if ws:
                    x = np.array(list(map(memo.__getitem__, ws)))
                    starts = window_starts(len(x), self.window)
                    z += (np.add.reduceat(x, starts) / np.diff(starts, append=len(x))).max()
                out[i] = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            group, size = [], 0
        return out


def window_starts(n: int, window: int) -> np.ndarray:
    """Starts of even windows of at most `window` words."""
    pieces = max(1, -(-n // window))
    return np.arange(pieces) * n // pieces


def document_counts(tok: np.ndarray, places: np.ndarray, bags: np.ndarray, bag_starts: np.ndarray, sizes: np.ndarray, buckets: int) -> np.ndarray:
    """Number of texts that each bucket occurs in."""
    seen = np.zeros(buckets, np.int64)
    for some in np.split(tok, places[1:]):
        words = np.unique(some)
        n = sizes[words]
        at = np.repeat(bag_starts[words] - np.cumsum(n) + n, n) + np.arange(n.sum())
        seen[np.unique(bags[at])] += 1
    return seen


def train(texts: list[str], labels: list[int], *, dim: int = 4, buckets: int = 1 << 17, low: int = 3, high: int = 5, window: int = 4, steps: int = 80, rate: float = 0.08, seed: int = 5, least: int = 15, decay: float = 1e-4) -> Model:
    """Embeddings and softmax rows by Adam on whole passes; a text's loss is that of its windows, the worst ones most.

    An n-gram in fewer than `least` texts (a twentieth of the rarer class, if that is fewer) gets no vector.
    """
    vocabulary: dict[str, int] = {}
    tokens, starts, first, y, n = [], [], [0], [], 0
    for text, label in zip(texts, labels, strict=True):
        words = (text or "").lower().split()
        if words:
            starts.append(n + window_starts(len(words), window))
            tokens.append(np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in words), np.int32, len(words)))
            n += len(words)
            first.append(first[-1] + len(starts[-1]))
            y.append(float(label))
    y = np.array(y)
    if len(set(y.tolist())) < 2:
        share = float(np.mean(labels)) if len(labels) else 0.0
        p = min(max(share, 1e-3), 1 - 1e-3)
        return Model(f"constant-{p}", np.zeros(1, np.float32), float(np.log(p / (1 - p))), window, low, high)
    places = np.cumsum([0, *map(len, tokens)])[:-1]
    tok, starts, first = np.concatenate(tokens), np.concatenate(starts), np.array(first[:-1])
    del tokens
    lengths = np.diff([*starts, n])
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    docs_of = np.repeat(np.arange(len(first)), np.diff([*first, len(starts)]))
    bags, sizes = array("i"), np.zeros(len(vocabulary), np.int32)
    for k, w in enumerate(vocabulary):
        some = features(w, buckets, low, high)
        sizes[k] = len(some)
        bags.extend(some)
    del vocabulary
    bags = np.frombuffer(bags, np.int32)
    bag_starts = np.cumsum(sizes, dtype=np.int64) - sizes
    seen = document_counts(tok, places, bags, bag_starts, sizes, buckets)
    rare = seen < max(2, min(least, int(min(y.sum(), (1 - y).sum())) // 20))
    flat, used = np.unique(bags, return_inverse=True)
    used = used.astype(np.int32)
    rng = np.random.default_rng(seed)
    e, w, b = rng.normal(0, 0.1, (len(flat), dim)), rng.normal(0, 0.3, (dim, 2)), np.zeros(2)
    learnt = ~rare[flat][:, None]
    e *= learnt
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (e, w, b)]
    for step in range(1, steps + 1):
        direction = w[:, 1] - w[:, 0]
        scalar = (e @ direction)[used]
        word = np.add.reduceat(scalar, bag_starts) / sizes
        z = np.add.reduceat(word[tok], starts) / lengths + b[1] - b[0]
        sharp = 1.0 + 4.0 * step / steps
        top = np.maximum.reduceat(z, first)
        part = np.exp(sharp * (z - top[docs_of]))
        part /= np.add.reduceat(part, first)[docs_of]
        pooled = np.add.reduceat(part * z, first)
        g_doc = weight * (1 / (1 + np.exp(-np.clip(pooled, -40, 40))) - y)
        g_z = g_doc[docs_of] * part
        g_word = np.bincount(tok, np.repeat(g_z / lengths, lengths), len(sizes))
        g_scalar = np.bincount(used, np.repeat(g_word / sizes, sizes), len(flat))
        g_direction = e.T @ g_scalar
        grads = (learnt * np.outer(g_scalar, direction) + decay * e, np.stack([-g_direction, g_direction], 1), np.array([-g_doc.sum(), g_doc.sum()]))
        for p, g, (m, v) in zip((e, w, b), grads, state, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    scalars = np.zeros(buckets, np.float32)
    scalars[flat] = e @ (w[:, 1] - w[:, 0])
    bias = float(b[1] - b[0])
    return Model(f"{zlib.crc32(scalars.tobytes())}-{bias}", scalars, bias, window, low, high)


def fit(docs: DataFrame, labels: DataFrame, allowed, *, per_class: tuple[int, int] = (2000, 1000), characters: int = 60_000_000, **how) -> Model:
    """Train on about `per_class` documents at most of labels 0 and 1, among those that `allowed` (on doc_id) admits.

    If these would have more than about `characters` characters, fewer of both are
    taken. A document labelled both 0 and 1 counts as 1. With labels of one kind or
    none, all texts score alike.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & allowed).groupBy("doc_id").agg(F.max("toxic").alias("_y"))
    counts = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    share = F.lit(0)
    for y, n in counts.items():
        share = F.when(F.col("_y") == y, min(1_000_000, int(1_000_000 * per_class[y] / max(n, 1)) + 1)).otherwise(share)
    sample = known.where(part < share)
    # About sum(per_class) ids, whatever the input: small enough to broadcast, so no text is shuffled.
    rows = docs.select("doc_id", "text").where(allowed).join(F.broadcast(sample), "doc_id").select("doc_id", "text", "_y")
    size = rows.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    if size > characters:
        rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1_000_000)) < 1_000_000 * characters // size)
    rows = sorted(rows.collect(), key=lambda r: (r["doc_id"], r["text"] or ""))
    return train([r["text"] or "" for r in rows], [r["_y"] for r in rows], **how)


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """Every row with one more column `name` (which must be new); a null or empty text gets the score of an empty window.

    Other columns are carried, whatever their names; repeated rows score alike,
    texts of any length are read whole, an empty table gives an empty result.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        claim("toxicity", _memo.clear)
        for b in batches:
            s = m.scores(b.column(b.schema.get_field_index("text")).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s)], [*b.schema.names, name])

    return docs.mapInArrow(run, schema)
