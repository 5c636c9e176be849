"""Periodic run detection: stretches of words that repeat themselves at once.

A run has a smallest period q, at least three periods and `least` words, and no
neighbouring word extends it. Lags are counted before any is looked at. Words that
are frequent in their text count by an exact FFT autocorrelation (all power spectra
summed, one inverse), the others by the differences of their places. A run of period
q holds at least max(least - q, 2 q) neighbouring matches at lag q; only lags with so
many matches get an island scan. Multiples of a known period are spared exactly: two
distinct runs share no matching pair of places at a lag that both their periods
divide (Fine and Wilf), so the pairs that known runs explain are subtracted first.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST, POWERS = 24, 3
SPECTRUM = 1 << 21  # doubles of indicator rows that are transformed at once
RUN = "struct<start:long,length:long,period:long>"


def lag_matches(ids: np.ndarray, most: int) -> np.ndarray:
    """For each lag up to `most`, the number of places whose word stands again that lag further on."""
    n, out = len(ids), np.zeros(most + 1, np.int64)
    counts = np.bincount(ids)
    heavy = np.flatnonzero(counts > max(8, math.isqrt(n) // 2))
    if len(heavy):
        size = 1 << (n + most - 1).bit_length()  # lags up to `most` don't wrap round
        power = np.zeros(size // 2 + 1)
        step = max(1, SPECTRUM // size)
        for lo in range(0, len(heavy), step):
            some = np.fft.rfft((ids == heavy[lo : lo + step, None]).astype(np.float64), size)
            power += (some.real**2 + some.imag**2).sum(0)
        out += np.rint(np.fft.irfft(power, size)[: most + 1]).astype(np.int64)
        counts[heavy] = 0
    place = np.argsort(ids, kind="stable")
    place = place[counts[ids[place]] > 1]
    word, at, k = ids[place], np.arange(len(place)), 0
    while len(at):
        k += 1
        at = at[at + k < len(place)]
        far = place[at + k] - place[at]
        at, far = (x[(word[at + k] == word[at]) & (far <= most)] for x in (at, far))
        out += np.bincount(far, minlength=most + 1)
    return out


def find_runs(ids: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    most = len(ids) // POWERS
    if len(ids) < least or not most:
        return []
    matches, lags = lag_matches(ids, most), np.arange(most + 1)
    need = np.maximum(least - lags, (POWERS - 1) * lags)
    need[0] = matches[0] + 1
    found: dict[int, list[tuple[int, int]]] = {}
    for q in np.flatnonzero(matches >= need).tolist():
        known = {run for p in found if q % p == 0 for run in found[p]}
        if matches[q] - sum(length - q for _, length in known if length > q) < need[q]:
            continue
        edges = np.flatnonzero(np.diff(np.r_[False, ids[:-q] == ids[q:], False]))
        start, length = edges[::2], edges[1::2] - edges[::2]
        long = length >= need[q]
        new = [x for x in zip(start[long].tolist(), (length[long] + q).tolist(), strict=True) if x not in known]
        if new:
            found[q] = new
    return sorted((s, n, q) for q, some in found.items() for s, n in some)


def best_run(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The greatest exact length / period; ties: smallest start, then period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def collapse_runs(docs: DataFrame, rearranged: Callable[[object, int], np.ndarray | None] = lambda _, n: None, least: int = LEAST) -> DataFrame:
    """doc_id, runs (by start, then period), best (null without runs), collapsed: the text without what repeats in its runs.

    Words are separated by ASCII white space; `collapsed` joins by one space those
    that lie in no run beyond its first period. rearranged(doc_id, n): the order in
    which a text's n words are read (None: as they stand). Null and empty texts have
    no words; texts of any length are read whole; repeated rows are answered one by
    one; other columns are not read. Nothing is shuffled.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def one(doc_id: object, text: str | None) -> tuple[list[tuple], tuple | None, str]:
        words = (text or "").encode("utf-8", "surrogatepass").split()
        order = rearranged(doc_id, len(words))
        if order is not None:
            words = [words[i] for i in order.tolist()]
        number: dict[bytes, int] = {}
        runs = find_runs(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)), least) if len(words) >= least else []
        if runs:
            change = np.zeros(len(words) + 1, np.int64)
            for start, length, period in runs:
                change[start + period] += 1
                change[start + length] -= 1
            words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
        return runs, best_run(runs), b" ".join(words).decode("utf-8", "surrogatepass")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shown = lambda r: dict(zip(("start", "length", "period"), r, strict=True))
        for b in batches:
            got = [one(d.as_py(), t.as_py()) for d, t in zip(b.column(0), b.column(1), strict=True)]
            runs = pa.array([[shown(r) for r in x] for x, _, _ in got], pa.list_(run_type))
            best = pa.array([None if x is None else shown(x) for _, x, _ in got], run_type)
            yield pa.RecordBatch.from_arrays([b.column(0), runs, best, pa.array([x for _, _, x in got], pa.string())], ["doc_id", "runs", "best", "collapsed"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, runs array<{RUN}>, best {RUN}, collapsed string")


def digests() -> list[Column]:
    """Of collapse_runs: n_runs, the best run's figures, and SHA-256 of all runs as lines and of the collapsed text."""
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))))
    best = [F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")]
    exponent = F.expr("best.length * 1000 div best.period").alias("exponent_milli")
    return [F.size("runs").cast("long").alias("n_runs"), *best, exponent, F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")]
