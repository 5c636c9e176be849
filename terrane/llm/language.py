"""Language id by segmentation-marginalised unigrams.

Each language has a probability for every ordinary piece of one fixed public
vocabulary. A word's probability is the sum over all its segmentations into
pieces, by a forward algorithm; a text's is the product over its words. Piece
probabilities come from expectation-maximisation over the word counts of a
bounded sample (`per_language` documents and `characters` of text of each
language, by hash of the id, without words over `longest_word` characters);
prediction reads every text and every word whole, in scaled sums that do not
underflow. A character that the vocabulary lacks is a piece of its own with a
floor probability. Words are runs without (Unicode) white space.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.llm.common import claim

SHORT, LONG_CELLS = 32, 60_000
MEMO_CELLS, CELLS, WINDOW, SCALE_EVERY, GROUP_CHARS = 1_600_000, 400_000, 2048, 16, 2_000_000
FLOOR = 1e-9
MARK = "▁"
#: Fixed: what Python's str.split() takes for white space.
BLANKS = "\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_memo: dict = {}


def load_pieces(path: str) -> list[str]:
    """All pieces of a sentencepiece model but control and byte pieces; the mark is a word's start."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(sp.get_piece_size())
    return [sp.id_to_piece(i) for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]


class Pieces:
    """Piece ids by a hash of their characters, for whole matrices of words at once."""

    def __init__(self, pieces: list[str]):
        size = 1 << max(4, (8 * len(pieces)).bit_length())
        self.count, self.mask = len(pieces), np.uint64(size - 1)
        self.longest = max(map(len, pieces), default=1)
        self.key, self.value = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        for i, p in enumerate(pieces):
            h = np.zeros(1, np.uint64)
            for c in p:
                h = self.step(h, np.array([ord(c)], np.uint64))
            slot = int(h[0] & self.mask)
            while self.value[slot] >= 0:
                slot = (slot + 1) & (size - 1)
            self.key[slot], self.value[slot] = h[0], i
        self.probes = max((n for n in np.diff(np.flatnonzero(np.r_[True, self.value < 0, True]))), default=1)

    @staticmethod
    def step(h: np.ndarray, code: np.ndarray) -> np.ndarray:
        h = (h ^ (code + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
        return h ^ (h >> np.uint64(29))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Ids, or count + 1 where there is no such piece."""
        slot = h & self.mask
        out = np.full(h.shape, self.count + 1, np.int32)
        open_ = np.ones(h.shape, bool)
        for _ in range(self.probes):
            hit = open_ & (self.key[slot] == h) & (self.value[slot] >= 0)
            out[hit] = self.value[slot[hit]]
            open_ &= (self.value[slot] >= 0) & ~hit
            if not open_.any():
                break
            slot = (slot + np.uint64(1)) & self.mask
        return out

    def codes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Characters of the marked words, a row each, and their lengths."""
        marked = [MARK + w for w in words]
        lengths = np.array([len(w) for w in marked])
        width = int(lengths.max(initial=1))
        raw = "".join(w.ljust(width, "\0") for w in marked).encode("utf-32-le", "surrogatepass")
        return np.frombuffer(raw, np.uint32).reshape(-1, width), lengths

    def arcs(self, codes: np.ndarray, lengths: np.ndarray, lo: int = 0, hi: int | None = None) -> list[np.ndarray]:
        """For n from 1, at [word, start - lo] the piece of n characters that starts there (count + 1: none; count: a lone unknown character)."""
        width = codes.shape[1]
        hi = width if hi is None else min(hi, width)
        part = codes[:, lo : min(width, hi + self.longest - 1)].astype(np.uint64)
        h, out = np.zeros((len(codes), hi - lo), np.uint64), []
        left = lengths[:, None] - lo - np.arange(hi - lo)[None, :]
        for n in range(1, min(self.longest, part.shape[1]) + 1):
            w = min(hi - lo, part.shape[1] - n + 1)
            h = self.step(h[:, :w], part[:, n - 1 : n - 1 + w])
            fits = left[:, :w] >= n
            found = np.full(h.shape, self.count + 1, np.int32)
            found[fits] = self.find(h[fits])
            if n == 1:
                found[fits & (found > self.count)] = self.count
            out.append(found)
        return out


def forward(arcs: list[np.ndarray], prob: np.ndarray, logs: bool = False) -> np.ndarray:
    """alpha[position, word, language]: sums over all segmentations, as they are or (prob is logarithms too) as logarithms."""
    words, width = arcs[0].shape
    alpha = np.full((width + 1, words, prob.shape[1]), -np.inf if logs else 0.0)
    alpha[0] = 0 if logs else 1
    for j in range(1, width + 1):
        for n in range(1, min(len(arcs), j) + 1):
            p = prob[arcs[n - 1][:, j - n]]
            alpha[j] = np.logaddexp(alpha[j], alpha[j - n] + p) if logs else alpha[j] + alpha[j - n] * p
    return alpha


def backward(arcs: list[np.ndarray], lengths: np.ndarray, prob: np.ndarray, logs: bool = False) -> np.ndarray:
    words, width = arcs[0].shape
    beta = np.full((width + 1, words, prob.shape[1]), -np.inf if logs else 0.0)
    beta[lengths, np.arange(words)] = 0 if logs else 1
    for i in range(width - 1, -1, -1):
        for n in range(1, min(len(arcs), width - i) + 1):
            p = prob[arcs[n - 1][:, i]]
            beta[i] = np.logaddexp(beta[i], beta[i + n] + p) if logs else beta[i] + beta[i + n] * p
    return beta


def lots(texts: list[str]) -> Iterator[list[str]]:
    """Words by length, short ones 2,048 at once, longer ones in lots of bounded cells."""
    lo = 0
    while lo < len(texts):
        hi = lo + 1
        while hi < len(texts) and (hi - lo < 2048 if len(texts[hi]) <= SHORT else len(texts[lo]) > SHORT and (hi - lo + 1) * len(texts[hi]) <= LONG_CELLS):
            hi += 1
        yield texts[lo:hi]
        lo = hi


@dataclass(frozen=True)
class Model:
    key: str
    languages: tuple[str, ...]
    pieces: Pieces
    prob: np.ndarray  # piece x language; then unknown characters, then no piece (zero)
    prior: np.ndarray

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log probability of each word in each language."""
        out = np.zeros((len(words), len(self.languages)))
        by_size, lo = sorted(range(len(words)), key=lambda i: len(words[i])), 0
        cells = max(WINDOW, CELLS // max(1, len(self.languages)))
        while lo < len(by_size):
            hi, least = lo + 1, len(words[by_size[lo]])
            while hi < len(by_size) and len(words[by_size[hi]]) <= least * 5 // 4 + 2 and (hi - lo + 1) * min(WINDOW, len(words[by_size[hi]]) + 1) <= cells:
                hi += 1
            some = by_size[lo:hi]
            out[some] = self.forward_scores([words[i] for i in some])
            lo = hi
        return out

    def forward_scores(self, words: list[str]) -> np.ndarray:
        """The forward sums' logarithms for words of about one length, any length.

        Start places are taken in windows; each pushes its sum along its arcs. Every
        SCALE_EVERY places the open sums of a word and language are divided by their largest.
        """
        codes, lengths = self.pieces.codes(words)
        width, reach, none = codes.shape[1], self.pieces.longest, self.pieces.count + 1
        shape = (len(words), len(self.languages))
        out, scale = np.zeros(shape), np.zeros(shape)
        open_ = np.zeros((reach, *shape))
        open_[0] = 1
        for lo in range(0, width + 1, WINDOW):
            hi = min(width, lo + WINDOW)
            arcs = self.pieces.arcs(codes, lengths, lo, hi) if hi > lo else []
            some = [(a != none).sum(0).tolist() for a in arcs]
            alpha = np.concatenate([open_, np.zeros((hi - lo + 1, *shape))])
            for i in range(lo, min(width + 1, lo + WINDOW)):
                at = i - lo
                if i and i % SCALE_EVERY == 0:
                    top = alpha[at : at + reach].max(0)
                    top[top <= 0] = 1
                    alpha[at : at + reach] /= top
                    scale += np.log(top)
                ended = np.flatnonzero(lengths == i)
                if len(ended):
                    out[ended] = np.log(alpha[at, ended]) + scale[ended]
                for n, (found, found_some) in enumerate(zip(arcs, some, strict=True), 1):
                    if at >= found.shape[1] or not found_some[at]:
                        continue
                    if 4 * found_some[at] < len(words):
                        rows = np.flatnonzero(found[:, at] != none)
                        alpha[at + n, rows] += alpha[at, rows] * self.prob[found[rows, at]]
                    else:
                        alpha[at + n] += alpha[at] * self.prob[found[:, at]]
            open_ = alpha[hi - lo : hi - lo + reach]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        n = len(self.languages)
        if _memo.get("key") != self.key:
            _memo.clear()
            _memo.update(key=self.key, rows={}, values=np.zeros((1024, n)))
        rows, values, most = _memo["rows"], _memo["values"], MEMO_CELLS // max(1, n)
        langs, scores = ["und"] * len(texts), np.zeros(len(texts))
        for group in grouped(texts, GROUP_CHARS):
            words = {k: texts[k].split() for k in group if texts[k] and any(map(str.isalpha, texts[k]))} if n else {}
            new = list({w for ws in words.values() for w in ws if w not in rows})
            if len(rows) + len(new) > most:
                rows.clear()
                new = list({w for ws in words.values() for w in ws})
            if len(rows) + len(new) > len(values):
                values = _memo["values"] = np.resize(values, (max(2 * len(values), len(rows) + len(new)), n))
            values[len(rows) : len(rows) + len(new)] = self.word_scores(new)
            rows.update(zip(new, range(len(rows), len(rows) + len(new)), strict=True))
            for k, ws in words.items():
                z = self.prior + values[list(map(rows.__getitem__, ws))].sum(0)
                best = int(np.argmax(z))
                langs[k] = self.languages[best]
                scores[k] = 1 / np.exp(np.clip((z - z[best]) / (1 + 0.02 * len(ws)), -700, 0)).sum()
        return langs, scores


def grouped(texts: list[str | None], chars: int) -> Iterator[list[int]]:
    """Indexes of neighbouring texts, so many that they have about `chars` characters."""
    group, size = [], 0
    for k, t in enumerate(texts):
        group.append(k)
        size += len(t or "")
        if size >= chars:
            yield group
            group, size = [], 0
    if group:
        yield group


def train(counts: list[tuple[str, str, int]], pieces: list[str], documents: dict[str, int], *, rounds: int = 4, smooth: float = 0.05) -> Model:
    """counts: (language, word, times). Expected piece counts by forward-backward over all segmentations."""
    languages = tuple(sorted(documents))
    index = Pieces(pieces)
    at = {lang: i for i, lang in enumerate(languages)}
    words: dict[str, np.ndarray] = {}
    for lang, word, n in counts:
        words.setdefault(word, np.zeros(len(languages)))[at[lang]] += n
    texts = sorted(words, key=lambda w: (len(w), w))
    blocks = list(lots(texts))
    prob = np.full((len(pieces) + 2, len(languages)), 1 / (len(pieces) + 1))
    prob[-1] = 0
    coded = [index.codes(b) for b in blocks]
    lattices = [(index.arcs(*c), c[1]) for c in coded]
    for _ in range(rounds):
        expected = np.full_like(prob, smooth)
        for b, (arcs, lengths) in zip(blocks, lattices, strict=True):
            times, long = np.array([words[w] for w in b]), len(b[-1]) > SHORT  # products of long words leave the range of doubles
            with np.errstate(divide="ignore"):
                p = np.log(prob) if long else prob
            alpha, beta = forward(arcs, p, long), backward(arcs, lengths, p, long)
            whole = beta[0] if long else np.maximum(beta[0], 1e-300)
            for n, found in enumerate(arcs, 1):
                for i in range(found.shape[1]):
                    q = p[found[:, i]]
                    flow = times * (np.exp(alpha[i] + q + beta[i + n] - whole) if long else alpha[i] * q * beta[i + n] / whole)
                    for k in range(len(languages)):
                        expected[:, k] += np.bincount(found[:, i], flow[:, k], len(prob))
        expected[-1] = 0
        prob = np.maximum(expected / expected.sum(0, keepdims=True), FLOOR)
        prob[-1] = 0
    total = max(1, sum(documents.values()))
    prior = np.log(np.array([documents[lang] / total for lang in languages])) if languages else np.zeros(0)
    return Model(f"{zlib.crc32(prob.tobytes())}-{languages}", languages, index, prob, prior)


def fit(docs: DataFrame, allowed: Column, pieces: list[str], *, per_language: int = 500, characters: int = 4_000_000, **how) -> Model:
    """Learn from about per_language documents of each language, `characters` of text at most, among the rows that `allowed` admits.

    Rows are drawn by a hash of their id, in whose order they count until their text
    would pass `characters`; words of any length are learnt from.
    """
    known = docs.where(allowed & F.col("lang").isNotNull())
    sums = known.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("size")).collect()
    part, share = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)), F.lit(0)
    for r in sums:
        most = min(1.0, per_language / r["n"], characters / max(1, r["size"] or 0))
        share = F.when(F.col("lang") == r["lang"], min(1_000_000, int(1_000_000 * most) + 1)).otherwise(share)
    drawn = known.where(part < share).select("lang", "text", part.alias("part"), F.sum(F.length("text")).over(Window.partitionBy("lang").orderBy(part, "doc_id", F.xxhash64("text"))).alias("so_far"))
    words = drawn.where(F.col("so_far") <= characters).select("lang", F.explode(F.split("text", f"[{BLANKS}]+")).alias("word"))
    rows = words.where(F.col("word") != "").groupBy("lang", "word").agg(F.count("*").alias("n")).collect()
    return train([tuple(r) for r in rows], pieces, {r["lang"]: r["n"] for r in sums}, **how)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score for every row, repeated rows alike; an empty table gives an empty result.

    Null text, or one without letters (str.isalpha), is `und` with score 0, and so is
    all text if nothing could be learnt. Of equally probable languages the first by
    name is taken. Texts and words of any length are scored whole.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        claim("language", _memo.clear)
        for b in batches:
            langs, scores = m.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, lang_pred string, score double")
