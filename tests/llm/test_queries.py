"""Each opN_ query on small tables against brute force: nulls, empty tables, ties, repeated rows, long texts, clashing columns."""

import hashlib
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("terrane.llm")
import corpus_pipeline as C
import public_tokenizers as P

from terrane.llm import bpe, bwt, common, components, content_sort, counts, language, packing, queries, repeats, search, simhash, toxicity

CLASH = "_t spans names _id _sha _own _score score _kept block own_sha kept_id kept_sha own_text kept_text row_id row_text row_spans _d t f g h salt u v".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)
WORDS = {"en": "the house of things and this water with some people".split(), "es": "la casa de las cosas que agua con los niños".split()}


def texts():
    rng = random.Random(11)
    say = lambda lang, n: " ".join(rng.choice(WORDS[lang]) for _ in range(n))
    base, shared = say("en", 120), say("es", 80)
    out = [(base, "en"), (base, "en"), (base + " end", None), (None, "en"), ("", None), (" \n\t ", None), ("½ ² ① Ⅷ 12", "es"), ("q" * 60, "en"), ("ab" * 3000, None), (say("es", 30), "es")]
    out += [(f"{say('en', 90)} {shared} {say('en', 90)}", "en") for _ in range(3)]
    out += [(say(lang, rng.randint(3, 60)), lang) for lang in ("en", "es") * 20]
    return out


@pytest.fixture(scope="module")
def rows():
    t = texts()
    out = [(k, x, lang, "s", len(x or "")) for k, (x, lang) in enumerate(t)]
    return [*out, (None, t[0][0], "en", None, None), (1, t[0][0], "en", "s", 3), (2, t[9][0], "es", "s", 3), (None, None, None, None, None), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, *["clash"] * len(CLASH)) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def sf(docs, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    docs.write.parquet(f"{path}/documents.parquet")
    labels = [(k, 1, k % 2) for k in range(9, 40)]
    docs.sparkSession.createDataFrame([*labels, (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.fixture(scope="module")
def empty(docs, tmp_path_factory):
    path = tmp_path_factory.mktemp("none")
    docs.limit(0).write.parquet(f"{path}/documents.parquet")
    docs.sparkSession.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    docs.sparkSession.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return str(path)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).collect() == []


def remainder(d, n):
    return zlib.crc32(str(d).encode()) % n if d is not None else 0


def test_language_query(spark, sf, rows, docs, tmp_path):
    got = queries.op1_language(spark, sf).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert all(r["held_out"] == (remainder(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1 for r in got)
    assert all(by[d]["lang_pred"] == "und" for d in (3, 4, 5, 6)) and by[9]["lang_pred"] == "es" and by[0]["lang_pred"] == "en"
    assert sum(by[k]["lang_pred"] == rows[k][2] for k in range(13, 53)) >= 38
    # Nothing is learnt from held-out rows, and a prediction sees the text alone.
    held = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2) & F.col("doc_id").isNotNull()
    docs.withColumns({"lang": F.when(held, "xx").otherwise(F.col("lang")), "source": F.lit("other")}).write.parquet(f"{tmp_path}/documents.parquet")
    key = lambda rs: Counter((r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in rs)
    assert key(queries.op1_language(spark, str(tmp_path)).collect()) == key(got)


def test_language_sums_all_segmentations():
    pieces = ["▁", "a", "b", "ab", "▁a", "ba", "aba", "bab"]
    m = language.train([("x", "ab", 3), ("x", "aba", 2), ("y", "ba", 4), ("y", "bab", 2)], pieces, {"x": 1, "y": 2})
    at = {p: i for i, p in enumerate(pieces)}

    def brute(word, k):
        t, total = "▁" + word, 0.0
        for cut in itertools.product([0, 1], repeat=len(t) - 1):
            ends = [0, *[i for i, c in enumerate(cut, 1) if c], len(t)]
            p = 1.0
            for a, b in itertools.pairwise(ends):
                p *= m.prob[at[t[a:b]], k] if t[a:b] in at else m.prob[len(pieces), k] if b - a == 1 else 0
            total += p
        return np.log(total)

    words = ["ab", "abba", "babab", "c", "acb", "bbbbbbbbbb"]
    got = m.word_scores(words)
    assert np.allclose(got, [[brute(w, k) for k in (0, 1)] for w in words])
    assert np.isfinite(m.word_scores(["q" * 60, "ab" * 20_000])).all()  # long words neither underflow nor are cut
    assert m.word_scores(["ab" * 24 + "b"])[0, 0] != m.word_scores(["ab" * 24])[0, 0]
    assert max(map(len, language.load_pieces(P.path("piece_bpe_32k.model")))) == language.Pieces(language.load_pieces(P.path("piece_bpe_32k.model"))).longest > 8


def test_language_learns_from_long_words(spark, monkeypatch):
    pieces = ["▁", "a", "b", "ab", "▁a", "ba", "aba", "bab"]
    counts = [("x", "ab", 3), ("x", "aba", 2), ("y", "ba", 4), ("y", "bab" * 30, 2), ("x", "ab" * 3000, 1)]
    long = language.train(counts, pieces, {"x": 1, "y": 2})
    assert np.isfinite(long.prob).all() and abs(long.prob[:-1].sum(0) - 1).max() < 1e-6
    assert abs(long.prob - language.train(counts[:-1], pieces, {"x": 1, "y": 2}).prob).max() > 0.01
    plain = language.train(counts[:-1], pieces, {"x": 1, "y": 2})
    monkeypatch.setattr(language, "SHORT", 0)  # all words by logarithms
    assert np.allclose(language.train(counts[:-1], pieces, {"x": 1, "y": 2}).prob, plain.prob)
    rows = [(k, "ab " * 50, "x") for k in range(30)] + [(99, "ab" * 100_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert language.fit(df, F.lit(True), pieces, characters=3_000).languages == ("x",)


def test_packing_query(spark, sf, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = {}
    for d, text, *_ in rows:
        ids.setdefault(d, []).append([*t.encode(text or "", add_special_tokens=False).ids, 1])
    got = queries.op2_packing(spark, sf).collect()
    want = Counter()
    for d, lists in ids.items():
        for x in lists:
            for a in range(0, len(x), 2048):
                part = x[a : a + 2048]
                want[d, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(x)] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        parts.sort()
        assert [o for o, _ in parts] == [0, *itertools.accumulate(n for _, n in parts)][:-1] and sum(n for _, n in parts) <= 2048


def test_packing_blocks_stay_bounded(spark):
    pieces = spark.range(300).select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("start"), F.lit(5).cast("long").alias("length"), F.lit(5).cast("long").alias("loss_tokens"))
    got = packing.pack(pieces, tokens=50, block_rows=10)
    assert got.count() == 300 and got.select(F.shiftright("sequence_id", 32)).distinct().count() >= 20


def test_store_query(spark, sf, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = Counter()
    for d, text, *_ in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        want[d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    got = queries.op5_store(spark, sf).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    order = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in order] == [0, *itertools.accumulate(r["n_tokens"] for r in order)][:-1]
    seen = [r["doc_id"] if r["doc_id"] is not None else -1 for r in order]
    assert seen == sorted(seen)


def brute_nearest(vectors, k):
    out = set()
    for qid, q in {(i, v) for i, v in vectors if i is not None and i % 20 == 0}:
        scored = sorted((-float(np.dot(q, v)), i) for i, v in vectors if i != qid)[:k]
        out |= {(qid, n, i, round(-s, 9)) for n, (s, i) in enumerate(scored, 1)}
    return out


def test_search_is_exact_when_all_leaves_are_visited(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(-2, 3, size=(90, 4)).astype(float)  # many ties and equal vectors
    vectors = [(k % 70, tuple(v.tolist())) for k, v in enumerate(x) if v.any()]  # some ids twice
    bad = [(500, None), (520, (0.0,) * 4), (540, (float("nan"),) * 4), (560, (1.0, 2.0)), (None, (1.0,) * 4), (580, (1.0,) * 5)]
    df = spark.createDataFrame([(i, list(v) if v else None) for i, v in vectors + bad], "vec_id long, embedding array<double>").withColumn("leaf", F.lit("clash"))
    got = search.search(df, df.where("vec_id % 20 = 0"), k=5, recall=1.0, calibration=100)
    assert {(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in got.collect()} == brute_nearest(vectors, 5)


def test_search_of_a_common_vector(spark):
    rows = [(k, [1.0, 0.0]) for k in range(300)] + [(k, [0.5, k / 1000]) for k in range(300, 340)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = search.search(df, df.where("vec_id in (0, 300)"), k=4, bucket_rows=16).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == [(0, 1, 1), (0, 2, 2), (0, 3, 3), (0, 4, 4), (300, 1, 0), (300, 2, 1), (300, 3, 2), (300, 4, 3)]


def test_search_recall_beyond_calibration(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 16))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = search.search(df, df.where("vec_id % 20 = 0"), k=20, calibration=40).toPandas()
    hits = 0
    for q, g in got.groupby("query_id"):
        s = x @ x[q]
        s[q] = -9e9
        hits += len(set(np.argsort(-s)[:20]) & set(g["vec_id"]))
    assert hits >= 0.9 * len(got)


def test_bpe_query(spark, sf, rows):
    import tiktoken

    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = Counter()
    for d, text, *_ in rows:
        ids = e.encode_ordinary(text or "")
        want[d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in queries.op7_bpe(spark, sf).collect()) == want


def test_bpe_of_long_pieces():
    import tiktoken

    path, rng = P.path("byte_bpe_multi_50k.tiktoken"), random.Random(5)
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    odd = ["a" * 5000, "ab" * 3000, "the" * 800, " " * 2000, "=" * 999, "中文" * 400, "aaab" * 300 + "aab" * 77, "".join(rng.choice("abcdefghijklmnop") for _ in range(5000))]
    odd += ["".join(rng.choice("abcdetéö") for _ in range(rng.randint(100, 300))) for _ in range(60)]
    assert [x.tolist() for x in bpe.encode(odd, path, P.PATTERN)] == [e.encode_ordinary(o) for o in odd]


def test_counts_query(spark, sf, rows):
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.Unigram([("<unk>", 0.0), *counts.vocabulary(P.path("piece_bpe_32k.model"))], unk_id=0, byte_fallback=False))
    t.pre_tokenizer = pre_tokenizers.Metaspace()
    want = Counter((d, sum(len(t.encode(w).ids) for w in (text or "").split())) for d, text, *_ in rows)
    assert Counter(tuple(r) for r in queries.op8_counts(spark, sf).collect()) == want
    odd = spark.createDataFrame([(1, "▁x y"), (2, "a▁b"), (3, None), (4, " ")], "doc_id long, text string")
    assert dict(map(tuple, counts.count_tokens(odd, P.path("piece_bpe_32k.model")).collect())) == {1: 2, 2: 2, 3: 0, 4: 0}


def test_merge_against_counts():
    rng = random.Random(1)
    for _ in range(60):
        letters, (depth, width) = rng.choice([b"ab\0", b"a", b"abcdefgh"]), rng.choice([(12, 3), (12, 1), (16, 8), (12, 4)])
        s = [bytes(rng.choice(letters) for _ in range(rng.randint(depth, 50))) for _ in range(rng.randint(1, 9))]
        s = [x for x in [*s, *(x[rng.randint(0, 3) :] + bytes(9) for x in s)] if len(x) >= depth]
        n, w, seen = np.array([len(x) - depth + 1 for x in s]), np.array([rng.randint(1, 2) for _ in s]), Counter()
        for x, k in zip(s, w, strict=True):
            for i in range(len(x) - depth + 1):
                seen[x[i : i + depth]] += k
        for shard in (1, 50, 10**6):
            got = bwt.repeated(s, w, n, depth, width, shard_bytes=shard)
            assert all([seen[x[i : i + depth]] >= 2 for i in range(len(x) - depth + 1)] == g.tolist() for x, g in zip(s, got, strict=True))


@pytest.mark.parametrize("width", [1, 4, 8])
def test_repeats_of_equal_rows(spark, width):
    line = "".join(random.Random(2).choice("abcdef") for _ in range(260))
    df = spark.createDataFrame([("x", line)] * 40 + [(None, line)] * 40 + [("y", "short")], "doc_id string, text string")
    got = Counter(tuple(r) for r in repeats.remove_repeats(df, width=width).collect())
    nothing = hashlib.sha256(b"").hexdigest()
    assert got == Counter({("x", 260, 260, 1, nothing): 40, (None, 260, 260, 1, nothing): 40, ("y", 5, 0, 0, hashlib.sha256(b"short").hexdigest()): 1})


def test_toxicity_query(spark, sf, rows, docs, tmp_path):
    got = queries.op10_toxicity(spark, sf).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    assert all(r["held_out"] == (remainder(r["doc_id"], 5) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    docs.withColumns({"lang": F.lit("zz"), "source": F.lit("q")}).write.parquet(f"{tmp_path}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    spark.read.parquet(f"{sf}/labels.parquet").withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic"))).write.parquet(f"{tmp_path}/labels.parquet")
    key = lambda rs: Counter((r["doc_id"], round(r["score"], 9)) for r in rs)
    assert key(queries.op10_toxicity(spark, str(tmp_path)).collect()) == key(got)  # neither other columns nor held-out labels matter


def test_toxicity_of_one_label(spark, docs):
    labels = spark.createDataFrame([(9, 0), (10, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.lit(True))
    assert toxicity.score(docs, model, "fresh").where("fresh >= 0.5").count() == 0


def test_near_copies_of_repeated_ids(spark):
    a, b = "one two three four five six", "the quick brown fox jumps over"
    df = spark.createDataFrame([(5, a), (5, b), (3, b), (7, a), (5, a)], "doc_id long, text string")
    assert sorted(map(tuple, simhash.drop_near_copies(df).collect())) == [(3, b), (5, a)]


def test_hot_routes_lose_no_link(spark):
    rng = random.Random(6)
    base = rng.getrandbits(64)
    prints = {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 9))) for _ in range(300)}
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in prints], "f long")
    want = {x: x for x in prints}
    for _ in prints:
        for x in prints:
            want[x] = min(want[y] for y in prints if (x ^ y).bit_count() <= 4)
        if all(want[want[x]] == want[x] for x in prints):
            break
    for hot in (10**6, 20):
        scratch = common.Scratch(spark, "test")
        tree = components.components(simhash.near(df, scratch, hot_rows=hot, held_rows=50), scratch).collect()
        root = {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in tree}
        groups, real = {}, {}
        for x in prints:
            groups.setdefault(root.get(x, x), set()).add(x)
            real.setdefault(want[x], set()).add(x)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, merged(real, prints)))


def merged(groups, prints):
    """Components by repeated union of all links."""
    parent = {x: x for x in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in prints:
        for y in prints:
            if (x ^ y).bit_count() <= 4:
                parent[find(x)] = find(y)
    out = {}
    for x in prints:
        out.setdefault(find(x), set()).add(x)
    return list(out.values())


def test_long_chain_of_links_settles(spark):
    edges = spark.range(90).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    tree = components.components(edges, common.Scratch(spark, "test"))
    assert {r["root"] for r in tree.collect()} == {0} and tree.count() == 91


@pytest.mark.parametrize("keep, best", [("largest", max), ("smallest", min)])
def test_hot_texts_with_text_ids(spark, keep, best):
    df = spark.createDataFrame([(f"k{n:03}", "same") for n in range(40)] + [("a", "other"), (None, "same"), ("b", None), ("b", "")], "doc_id string, text string")
    got = content_sort.content_sort(df, keep=keep, hot_rows=3).collect()
    same = [r for r in got if r["text_sha256"] == hashlib.sha256(b"same").hexdigest()]
    names = [f"k{n:03}" for n in range(40)]
    assert {(r["keep_id"], r["group_size"]) for r in same} == {(best(names), 41)} and [r["doc_id"] for r in same if r["kept"]] == [best(names)]
    assert sum(r["kept"] for r in got) == 3
    assert content_sort.drop_copies(df, keep=keep, hot_rows=3).count() == 3


def test_stages_with_clashing_columns(spark, docs, sf):
    slim = docs.select("doc_id", "text", "lang", "source", "n_chars")
    key = lambda df: Counter((r["doc_id"], r["text"] or "") for r in df.collect())
    for name, stage in C.STAGES[:-1]:
        got = stage(spark, docs, sf)
        assert got.columns == docs.columns, name
        assert key(got) == key(stage(spark, slim, sf)), name
        assert got.where(" or ".join(f"`{c}` <> 'clash'" for c in CLASH)).count() == 0, name
    assert C.packed(spark, docs, sf).count() == C.packed(spark, slim, sf).count()


def test_scratch_is_released(spark, tmp_path):
    import os

    with common.released():
        s = common.Scratch(spark, "gone")
        s.keep(spark.range(3), "rows")
        assert os.path.isdir(s.path)
    assert not os.path.exists(s.path) and s not in common.Scratch.made
