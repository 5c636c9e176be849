"""Suffix tree, run detection and whitening against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("terrane.llm")
from terrane.llm import queries, runs, suffix_tree, whitening

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def write(spark, path, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


# --- op11 -------------------------------------------------------------------


def corpus():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    out = []
    for k in range(160):
        text, last = [], "w0"
        for _ in range(rng.randint(0, 60)):
            last = f"w{(int(last[1:]) * 7 + 3) % 40}" if rng.random() < 0.6 else rng.choice(words)
            text.append(last if rng.random() < 0.95 else f"rare{rng.randint(0, 300)}")
        out.append((k, " ".join(text)))
    odd = [None, "", " \t\n", "ÀÉ W1\x0bw2 w3\x85", "the end " * 400, "x" * 3000]
    return [*out, *((200 + i, t) for i, t in enumerate(odd)), (None, "w1 w2 w3"), (None, None), (5, out[5][1]), (5, "other text")]


def plain_tree(texts, depth, least, entry, bits):
    """The module's definition, with dictionaries of tuples: (log10 P of a text, of its root)."""
    counts = Counter(w for t in texts for w in [*t, "</s>"])
    total, distinct = sum(counts.values()), len(counts)
    mass, floor = total + 0.1 * (distinct + 1), lambda share: max(2, math.ceil(share * total))
    common = {w for w, c in counts.items() if c >= floor(least) and w != "</s>"}
    root = lambda w: (counts[w] + 0.1) / mass
    other = sum(counts[w] for w in counts if w not in common and w != "</s>") + 0.1 * (distinct + 1 - len(common) - ("</s>" in counts))
    symbol = lambda w: w if w in common or w in ("</s>", "<s>") else "<other>"
    p0 = lambda s: other / mass if s == "<other>" else root(s)
    follow, seen = defaultdict(Counter), Counter()
    for t in texts:
        line = ["<s>", *map(symbol, t), "</s>"]
        for i in range(1, len(line)):
            for d in range(1, depth + 1):
                if i - d >= 0:
                    seen[tuple(line[i - d : i])] += 1
                    follow[tuple(line[i - d : i])][line[i]] += 1
    candidates = {s for s in follow if "<other>" not in s and (len(s) == 1 and (s[0] == "<s>" or s[0] in common) or len(s) > 1 and seen[s] >= floor(least))}
    listed = {s: {w: c for w, c in follow[s].items() if c >= floor(entry)} for s in candidates}

    def p(s, w):
        if not s:
            return p0(w)
        u, inside = len(listed[s]), sum(listed[s].values())
        return (listed[s].get(w, 0) + (seen[s] - inside + u) * p(s[1:], w)) / (seen[s] + u) if u else p(s[1:], w)

    def gain(s):
        u, inside = len(listed[s]), sum(listed[s].values())
        g = sum(c * math.log2(p(s, w) / p(s[1:], w)) for w, c in listed[s].items())
        return u and g + (seen[s] - inside) * math.log2((seen[s] - inside + u) / (seen[s] + u)) > bits * u

    states = {s for s in candidates if gain(s)}
    states |= {s[i:] for s in states for i in range(1, len(s))}

    def score(t):
        line, out = ["<s>", *map(symbol, t), "</s>"], 0.0
        for i in range(1, len(line)):
            s = next((h for d in range(min(depth, i), 0, -1) if (h := tuple(line[i - d : i])) in states), ())
            out += math.log10(p(s, line[i]))
            if line[i] == "<other>":
                out += math.log10(root(t[i - 1])) - math.log10(p0("<other>"))
        return out

    return total, counts, root, score, states, candidates, p, [*common, "</s>", "<other>"]


@pytest.mark.parametrize("options", [{}, {"depth": 2, "least": 0.004, "entry": 0.002, "bits": 1.0}, {"depth": 3, "least": 0.001, "entry": 0.0005, "bits": 0.5}])
def test_suffix_tree(spark, options):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = suffix_tree.score_texts(docs, F.coalesce(F.col("doc_id") % 5 != 0, F.lit(True)), **options).collect()
    cut = lambda t: WORD.findall((t or "").translate(PLAIN))
    train = [cut(t) for d, t in rows if d is None or d % 5]
    full = {"depth": suffix_tree.DEPTH, "least": suffix_tree.LEAST, "entry": suffix_tree.ENTRY, "bits": suffix_tree.BITS} | options
    total, counts, root, score, states, candidates, p, symbols = plain_tree(train, **full)
    assert states and len(states) < len(candidates)
    assert all(abs(sum(p(s, w) for w in symbols) - 1) < 1e-9 for s in states)
    want = Counter()
    for d, t in rows:
        w = cut(t)
        base = sum(math.log10(root(x)) for x in [*w, "</s>"])
        want[d, d is None or d % 5 != 0, len(w) + 1, sum(counts[x] > 0 for x in [*w, "</s>"]), total, round(base, 6), round(score(w), 6)] += 1
    assert Counter((r["doc_id"], r["trained"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in got) == want


def test_suffix_tree_keeps_columns_and_learns_nothing_from_nothing(spark):
    docs = spark.createDataFrame([(1, "a b a", "x", 3.0, "y")], "doc_id long, text string, row string, score double, h string").withColumn("trained", F.lit(False))
    tree, counted, coded = suffix_tree.fit(docs, "trained")
    (r,) = suffix_tree.score(coded, tree, counted).collect()
    assert (r["row"], r["score"], r["h"], r["n_tokens"], r["n_known"]) == ("x", 3.0, "y", 4, 0) and r["base_score"] == r["score_"] == 0


def test_scoring_query(spark, tmp_path):
    rows = [(d, t, "extra", "extra") for d, t in corpus()]
    sf = write(spark, tmp_path, documents=(rows, "doc_id long, text string, score string, held_out string"))
    got = queries.op11_scoring(spark, sf).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 10 == 0
    assert {r["held_out"] for r in got} == {True, False}
    train = [[*WORD.findall((t or "").translate(PLAIN)), None] for d, t, *_ in rows if d is None or zlib.crc32(str(d).encode()) % 10]
    assert all(r["held_out"] == (held(r["doc_id"]) or r["doc_id"] is None) for r in got)
    assert {r["train_tokens"] for r in got} == {sum(len(t) for t, (d, *_) in zip(train, [x for x in rows if x[0] is None or zlib.crc32(str(x[0]).encode()) % 10], strict=True) if d is not None)}
    assert sum(r["score"] - r["base_score"] for r in got if r["held_out"]) > 0  # the tree predicts what it has not seen better than words alone


# --- op12 -------------------------------------------------------------------


def smallest_period(w, most):
    return next((q for q in range(1, most + 1) if all(w[i] == w[i + q] for i in range(len(w) - q))), None)


def plain_runs(w, least=24):
    n, out = len(w), set()
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 3 * q) and smallest_period(w[i : j + q], q) == q:
                out.add((i, j + q - i, q))
            i = j + 1
    return sorted(out)


def periodic_texts():
    rng = random.Random(9)
    out = [[rng.choice("ab") for _ in range(rng.randint(0, 150))] for _ in range(60)]
    for _ in range(60):
        w = []
        for _ in range(rng.randint(1, 4)):
            block = [rng.choice("abcd") for _ in range(rng.randint(1, 14))]
            w += [rng.choice("abcdefgh") for _ in range(rng.randint(0, 20))] + (block * 30)[: rng.randint(len(block), 90)]
        out.append(w)
    return [*out, ["a"] * 24, ["a"] * 23, ["a"] * 300, ["a", "b"] * 12, list("abcdefgh") * 3, list("abcdefghi") * 3, [*["a"] * 40, "b", *["a"] * 40] * 4]


def test_runs_match_a_plain_search():
    for w in periodic_texts():
        number = {x: i for i, x in enumerate(sorted(set(w)))}
        ids = np.array([number[x] for x in w], np.int64)
        assert runs.find_runs(ids) == plain_runs(w)
        if len(w) > 3:
            most = len(w) // 3
            assert runs.lag_matches(ids, most).tolist()[1:] == [sum(w[i] == w[i + q] for i in range(len(w) - q)) for q in range(1, most + 1)]


def test_long_runs():
    ids = np.r_[np.arange(50), np.tile(np.arange(50, 57), 40_000), np.arange(60, 90)]
    assert runs.find_runs(ids) == [(50, 280_000, 7)]
    rng = np.random.default_rng(1)
    noise = rng.integers(0, 3000, 200_000)
    noise[90_000:120_000] = np.resize(noise[90_000:99_000], 30_000)
    ((start, length, period),) = runs.find_runs(noise)
    assert period == 9000 and start <= 90_000 and start + length >= 120_000


def test_runs_query(spark, tmp_path):
    texts = [" \t".join(w) for w in periodic_texts()]
    rows = [(k, t, "x", "x") for k, t in enumerate(texts)] + [(500, None, "x", "x"), (501, "", "x", "x"), (502, " \n ", "x", "x"), (None, "é " * 40, "x", "x"), (None, None, "x", "x"), (1, texts[1], "x", "x"), (2, "ü b c " * 3000, None, None)]
    sf = write(spark, tmp_path, documents=(rows, "doc_id long, text string, runs string, best string"))
    got = Counter(tuple(r) for r in queries.op12_runs(spark, sf).collect())
    want, planted = Counter(), 0
    for d, t, *_ in rows:
        w = WORD.findall(t or "")
        n, h = len(w), 1 if d is None else zlib.crc32(str(d).encode())
        if h % 10 == 0 and n:
            g, planted = h // 10, planted + 1
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
        found = plain_runs(w) if n < 2000 else [(0, n, 2)]
        gone = {i for s, length, q in found for i in range(s + q, s + length)}
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        figures = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        want[d, len(found), *figures, sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))] += 1
    assert planted > 5 and got == want


# --- op13 -------------------------------------------------------------------


def plain_whitening(rows, k=4):
    usable = [(d, [math.floor(256 * float(c)) for c in v]) for d, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in usable}), np.int64)
    n, s = len(fit), fit.sum(0)
    y = fit - s / n
    e, c = np.linalg.eigh(y.T @ y / n)
    e, c = e[::-1][:k], c[:, ::-1][:, :k]
    keep = e > 1e-11 * (y**2).sum() / n
    return usable, n, s, e[keep], c[:, keep], (y**2).sum() / n


def vectors(dims, many, seed, scales=None):
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((many, dims)) * (np.linspace(3, 0.2, dims) if scales is None else scales)
    return [(i, [float(np.float32(c)) for c in row]) for i, row in enumerate(v)]


@pytest.mark.parametrize(("dims", "many", "scales"), [(64, 300, None), (64, 300, 1.0), (3, 50, None), (1, 20, None), (40, 6, None), (5, 100, [1, 1, 0, 0, 0])])
def test_whitening(spark, tmp_path, dims, many, scales):
    rows = vectors(dims, many, dims, scales)
    bad = [(900, None), (901, [None, *rows[0][1][1:]]), (902, [float("nan"), *rows[0][1][1:]]), (903, [*rows[0][1][:-1], float("-inf")]), (904, [])]
    rows += [*bad, (None, rows[0][1]), (3, rows[3][1]), (905, rows[1][1])]
    sf = write(spark, tmp_path, embeddings=([(d, v, 1, "x", "y") for d, v in rows], "vec_id long, embedding array<float>, label int, x string, n string"))
    got = queries.op13_whitening(spark, sf).collect()
    usable, n, s, e, c, trace = plain_whitening(rows)
    assert len(e) == min(4, dims, 2 if scales is not None and not np.isscalar(scales) else 4)
    want = Counter((d, j + 1, n, sum((n * a - b) ** 2 for a, b in zip(x, s.tolist(), strict=True))) for d, x in usable for j in range(len(e)))
    assert Counter((r["vec_id"], r["component"], r["n"], r["deviation"]) for r in got) == want
    by = {d: x for d, x in usable if d is not None}
    for j in range(len(e)):
        mine = {r["vec_id"]: r["whitened"] for r in got if r["component"] == j + 1 and r["vec_id"] is not None}
        theirs = {d: float((np.array(x) - s / n) @ c[:, j] / math.sqrt(e[j])) for d, x in by.items()}
        sign = math.copysign(1, sum(mine[d] * theirs[d] for d in mine))
        assert max(abs(mine[d] - sign * theirs[d]) for d in mine) < 1e-6
    assert all(r["identity_error"] < 1e-9 and abs(r["explained"] - e[r["component"] - 1] / trace) < 1e-9 for r in got)


def test_whitening_without_spread(spark, tmp_path):
    sf = write(spark, tmp_path, embeddings=([(1, [0.5, 0.25], 1), (2, [0.5, 0.25], 1), (3, None, 1), (4, [1.0], 1)], "vec_id long, embedding array<float>, label int"))
    assert queries.op13_whitening(spark, sf).collect() == []


def test_eigenvectors_of_a_wide_space():
    rng = np.random.default_rng(2)
    q = np.linalg.qr(rng.standard_normal((300, 300)))[0]
    e = np.r_[5.0, 4.999, 3.0, 2.5, np.linspace(2.4, 0, 296)]
    v = q * e @ q.T
    products = []
    values, vecs, residual = whitening.lobpcg(lambda b: products.append(b.shape[1]) or v @ b, 300, 4)
    assert residual < 1e-11 and np.allclose(values, e[:4], rtol=1e-12) and max(products) <= 3 * 12
    assert np.abs(np.abs((vecs * q[:, :4]).sum(0)) - 1).max() < 1e-12


def test_deviations_beyond_a_long():
    x, s = np.array([[2**40, 0], [3, 1]]), np.array([2**40 + 3, 1])
    assert whitening.deviations(x, 10, s) == [None, None] and whitening.deviations(x[1:], 2, np.array([3, 1])) == [10]
