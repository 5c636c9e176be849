"""Encoding by memoised words: exact, because tokens never cross the cuts made here.

Text is cut wherever a character other than white space is followed by ASCII
white space. In the pre-tokenizer patterns of the public vocabularies used here
every match ends at such a place, and none looks behind it, so the ids of a text
are the ids of its chunks in turn. The same holds between a Latin letter or digit
and stops that end a word. Any subset of these cuts is exact too.

Cuts are found on the UTF-8 bytes of many texts at once; of the chunks of such a
group only the distinct ones are looked up, and each distinct one is encoded once
per Python worker while it stays in a bounded memo.
"""

from __future__ import annotations

import itertools
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
BARE = re.compile(f"[^{SPACE}]+")
WIDE_SPACE = np.array(sorted(int.from_bytes(chr(c).encode(), "big") for c in range(0x80, 0x3001) if BARE.fullmatch(chr(c)) is None))
IS_SPACE = np.isin(np.arange(256), np.frombuffer(b"\t\n\v\f\r ", np.uint8))
IS_STOP = np.isin(np.arange(256), np.frombuffer(b".,;:!?", np.uint8))
IS_PLAIN = np.array([chr(b).isascii() and chr(b).isalnum() for b in range(256)])  # no normaliser gives these a mark at the end
IS_LATIN = np.array([0x80 <= b < 0xC0 and b not in (0x97, 0xB7) for b in range(256)])  # after 0xC3: letters as plain
MOST_STOPS, MEMO, GROUP_BYTES = 8, 1_200_000, 8_000_000
_encoders: dict = {}


def cut_marks(data: np.ndarray, bounds: np.ndarray, stops: bool) -> np.ndarray:
    """True at the first byte of each chunk; bounds: the texts' starts in `data`, and its end."""
    blank = IS_SPACE[data]
    marks = np.zeros(len(data) + 1, bool)
    marks[1:-1] = blank[1:] & ~blank[:-1]
    at = np.flatnonzero(marks)
    at = at[data[at - 1] >= 0x80]
    two = data[np.maximum(at - 2, 0)].astype(np.int64) << 8 | data[at - 1]
    three = data[np.maximum(at - 3, 0)].astype(np.int64) << 16 | two
    marks[at[np.isin(two, WIDE_SPACE) | np.isin(three, WIDE_SPACE)]] = False
    marks[bounds] = True
    if stops and len(data):
        at = np.flatnonzero(marks)
        at = at[at > 0] - 1
        at = at[IS_STOP[data[at]]]
        for _ in range(MOST_STOPS):
            at = at[at > 0]
            more = IS_STOP[data[at - 1]]
            first = at[~more]
            before = data[first - 1]
            marks[first[IS_PLAIN[before] | IS_LATIN[before] & (data[np.maximum(first - 2, 0)] == 0xC3)]] = True
            at = at[more] - 1
    return marks[:-1]


class Encoder:
    """texts -> id arrays, through `encode_new` for chunks not seen lately.

    stops: cut stops off too. blanks: keep ASCII white space in the chunks.
    """

    def __init__(self, encode_new: Callable[[list[str]], list], *, stops: bool = True, blanks: bool = True, memo: int = MEMO):
        self.encode_new, self.stops, self.blanks, self.memo = encode_new, stops, blanks, memo
        self.reset()

    def reset(self) -> None:
        self.rows: dict[bytes, int] = {}
        self.start, self.size = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.flat, self.used = np.zeros(4096, np.int32), 0

    def learn(self, chunks: list[bytes]) -> None:
        coded = self.encode_new([c.decode() for c in chunks])
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        n, total = len(self.rows), int(sizes.sum())
        while n + len(chunks) > len(self.start):
            self.start, self.size = np.resize(self.start, 2 * len(self.start)), np.resize(self.size, 2 * len(self.size))
        while self.used + total > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        if total:
            self.flat[self.used : self.used + total] = np.fromiter(itertools.chain.from_iterable(coded), np.int32, total)
        self.size[n : n + len(chunks)] = sizes
        self.start[n : n + len(chunks)] = self.used + np.cumsum(sizes) - sizes
        self.rows.update(zip(chunks, range(n, n + len(chunks)), strict=True))
        self.used += total

    def encode(self, texts: pa.Array | list[str | None]) -> Iterator[np.ndarray]:
        for ids, bounds in self.groups(texts):
            for a, b in itertools.pairwise(bounds.tolist()):
                yield ids[a:b]

    def groups(self, texts: pa.Array | list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The ids of some texts in turn, and where each text's begin and end among them."""
        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        texts = texts.fill_null("") if texts.null_count else texts
        ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset) if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        lo = 0
        while lo < len(texts):
            hi = min(len(texts), int(np.searchsorted(ends, ends[lo] + GROUP_BYTES)) + 1)
            yield self._group(data[ends[lo] : ends[hi]], ends[lo : hi + 1] - ends[lo])
            lo = hi

    def _group(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = np.flatnonzero(cut_marks(data, bounds, self.stops))
        own = np.searchsorted(starts, bounds)
        places = np.append(starts, len(data))
        if not self.blanks:
            keep = ~IS_SPACE[data]
            places = np.append(np.int32(0), np.cumsum(keep, dtype=np.int32))[places]
            data = data[keep]
        chunks = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(places.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        distinct = chunks.dictionary.to_numpy(zero_copy_only=False).tolist()
        at = list(map(self.rows.get, distinct))
        if None in at:
            new = [c for c, i in zip(distinct, at, strict=True) if i is None]
            if len(self.rows) + len(new) > self.memo:
                self.reset()
                new = distinct
            self.learn(new)
            at = list(map(self.rows.__getitem__, distinct))
        row = np.array(at, np.int64)[chunks.indices.to_numpy()]
        n = self.size[row]
        ends = np.append(0, np.cumsum(n))
        at = np.repeat((self.start[row] - ends[:-1]).astype(np.int32), n)
        at += np.arange(ends[-1], dtype=np.int32)
        return self.flat[at], ends[own]


def with_end(ids: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same texts, each followed by end_id."""
    moved = bounds + np.arange(len(bounds))
    out = np.full(int(moved[-1]), end_id, np.uint32)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))] = ids
    return out, moved


def byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in byte-level vocabularies: printable Latin-1 as it is, the others from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = [b for b in range(256) if b not in printable]
    return {b: chr(256 + i) for i, b in enumerate(other)}


def library_encoder(path: str) -> Encoder:
    """An encoder of the tokenizers library, one for each file and worker.

    New chunks go straight through the library's normaliser, pre-tokenizer and
    model, without the offsets that a whole encoding keeps. Words of letters are
    their own pre-token. Chunks that spell a special token go through encode().
    """
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        special = re.compile("|".join(re.escape(a.content) for a in t.get_added_tokens_decoder().values()) or "(?!)").search
        tokenize, split = t.model.tokenize, t.pre_tokenizer.pre_tokenize_str
        normalise = t.normalizer.normalize_str if t.normalizer else str
        lower = normalise("A") == "a"
        keep_space = split(" a")[0][0][1:] == "a"
        shown, latin = byte_letters(), re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch  # composed letters with simple lower case

        def ids(chunk: str) -> list[int]:
            blank = chunk[:1] == " "
            word = chunk[1:] if blank else chunk
            if latin(word):
                word = word.lower() if lower else word
            elif word.isalpha():
                word = normalise(word)
            if word.isalpha():  # still so: lower case may add marks
                word = word if word.isascii() else word.encode().decode("latin-1").translate(shown)
                return [x.id for x in tokenize("Ġ" + word if keep_space and blank else word)]
            if special(chunk):
                return t.encode(chunk, add_special_tokens=False).ids
            return [x.id for piece, _ in split(normalise(chunk)) for x in tokenize(piece)]

        _encoders[path] = Encoder(lambda chunks: [ids(c) for c in chunks], blanks=keep_space)
    return _encoders[path]
