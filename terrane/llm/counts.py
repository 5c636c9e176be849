"""Token counts by a Viterbi search that keeps only score and piece count.

An Aho-Corasick automaton enumerates every match of the unigram vocabulary in a
word; for each end, dynamic programming keeps the best score and the number of
pieces on the way. The tie rule is the tokenizer's: of equal scores the match
that starts first stays. A character without a match is unknown, with a
penalty below the lowest score; neighbouring unknowns are one piece. White
space, and the mark itself where a text holds it, parts words, and a word starts
with the mark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from terrane.llm.words import SPACE, Encoder

MARK = "▁"
PENALTY = 10.0
WORD = re.compile(f"[^{SPACE}{MARK}]+")
_open: dict = {}


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model, without control and byte pieces and those that run over words."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    return [(p, sp.get_score(i)) for i in ids if not re.search(f".{MARK}", p := sp.id_to_piece(i))]


class Counter:
    def __init__(self, pieces: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for p, s in pieces:
            self.automaton.add_word(p, (len(p), s))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in pieces) - PENALTY

    def count(self, word: str) -> int:
        text = MARK + word
        ends: list[list] = [[] for _ in text]
        for e, match in self.automaton.iter(text):
            ends[e].append(match)
        score, pieces, last_unknown = [0.0] + [None] * len(text), [0] * (len(text) + 1), [False] * (len(text) + 1)
        for e, matches in enumerate(ends, 1):
            single = False
            for n, s in sorted(matches, reverse=True):  # the earliest start first
                single |= n == 1
                total = score[e - n] + s
                if score[e] is None or total > score[e]:
                    score[e], pieces[e], last_unknown[e] = total, pieces[e - n] + 1, False
            if not single:
                total = score[e - 1] + self.unknown
                if score[e] is None or total > score[e]:
                    score[e], pieces[e], last_unknown[e] = total, pieces[e - 1] + (not last_unknown[e - 1]), True
        return pieces[-1]


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and n_tokens of every whole text, words of any length included; null and blank texts have none.

    Every row gives one row, repeated ones alike; an empty table gives an empty result.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _open:
            counter = Counter(vocabulary(path))
            _open[path] = Encoder(lambda chunks: [[sum(map(counter.count, WORD.findall(c)))] for c in chunks], stops=False, blanks=False)
        for b in batches:
            n = [int(x.sum()) for x in _open[path].encode(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(n, np.int64))], ["doc_id", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long")
