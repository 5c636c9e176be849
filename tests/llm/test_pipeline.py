"""The pipeline's stages and run() against brute force on an odd little table."""

import random

import pytest
import xxhash

pytest.importorskip("terrane.llm")
import public_tokenizers as P

import corpus_pipeline as C

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def said(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "Ünder", "x9", "rho", "tau"]) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    base, shared = said(rng, 90), said(rng, 60)
    texts = [base, base, base + " end.", None, "", "one two", "ab" * 400, *(f"{said(rng, 150)} {shared} {said(rng, 150)}" for _ in range(3)), *(said(rng, 30) for _ in range(4))]
    rows = [(i, t, None, "s", len(t or "")) for i, t in enumerate(texts)] + [(None, said(rng, 50), None, None, None), (1, base, None, "s", len(base))]
    return spark.createDataFrame(rows, SCHEMA)


def pairs(df):
    return sorted(((r["doc_id"], r["text"] or "") for r in df.collect()), key=str)


def exact(rows):
    best = {}
    for d, t in rows:
        best[t] = max(best.get(t, -1), -1 if d is None else d)
    return sorted(((None if d < 0 else d, t) for t, d in best.items()), key=str)


def near(rows):
    def plain(t):
        w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in t).replace("\n", " ").split(" ") if x]
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints, part = [plain(t) for _, t in rows], list(range(len(rows)))
    for _ in rows:
        part = [min(part[j] for j in range(len(rows)) if (prints[i] ^ prints[j]).bit_count() <= 4) for i in range(len(rows))]
    least = {p: min((d for (d, _), q in zip(rows, part, strict=True) if q == p and d is not None), default=None) for p in part}
    return [(d, t) for (d, t), p in zip(rows, part, strict=True) if d == least[p]]


def passages(rows):
    seen, out = {}, []
    for _, t in rows:
        b = t.encode()
        for i in range(len(b) - 199):
            seen[b[i : i + 200]] = seen.get(b[i : i + 200], 0) + 1
    for d, t in rows:
        b = t.encode()
        gone = {j for i in range(len(b) - 199) if seen[b[i : i + 200]] > 1 for j in range(i, i + 200)}
        at, kept = 0, []
        for c in t:  # a character goes only whole
            n = len(c.encode())
            kept += [] if all(j in gone for j in range(at, at + n)) else [c]
            at += n
        out.append((d, "".join(kept)))
    return sorted(out, key=str)


def tokens(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return sorted(((d, len(t.encode(x, add_special_tokens=False).ids) + 1) for d, x in rows), key=str)


def sizes(df):
    out = {}
    for r in df.collect():
        out[r["doc_id"]] = out.get(r["doc_id"], 0) + r["length"]
    return sorted(out.items(), key=str)


def test_stages(spark, docs):
    rows = pairs(docs)
    assert pairs(C.exact(spark, docs, "")) == exact(rows)
    once = C.exact(spark, docs, "").persist()
    assert pairs(C.near(spark, once, "")) == sorted(near(exact(rows)), key=str)
    assert pairs(C.passages(spark, once, "")) == passages(exact(rows))
    assert sizes(C.packed(spark, once, "")) == tokens(exact(rows))


def test_stages_of_an_empty_table(spark, docs):
    for stage in (C.exact, C.near, C.passages, C.packed):
        assert stage(spark, docs.limit(0), "").count() == 0


def test_run(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i == 13)) for i in range(14)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    clean = pairs(C.clean(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)))
    assert sizes(C.run(spark, str(tmp_path))) == tokens(passages(near(exact(clean))))
