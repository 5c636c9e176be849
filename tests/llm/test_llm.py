"""The training-data operators against brute force on odd little tables."""

import hashlib
import random
import shutil
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

pytest.importorskip("terrane.llm")
import public_tokenizers as P

from terrane.llm import bpe, bwt, content_sort, counts, language, packing, repeats, search, simhash, store, toxicity, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _t string, names string"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    base = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "Ünder", "d'eau", "x9"]) for _ in range(90))
    texts = [base, base, base + " end.", "start " + base, None, "", "  \n ", "one two", "ab" * 400, base[:250] + " tail", "é" * 300, base * 40]
    rows = [(i, t, None, "s", 0, "clash", None) for i, t in enumerate(texts)] + [(None, base, None, None, None, None, None), (1, base, None, "s", 0, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def rows_of(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


@pytest.mark.parametrize("hot", [None, 2])
def test_content_sort(docs, hot):
    groups = {}
    for d, t in rows_of(docs):
        groups.setdefault(t, []).append(d)
    got = content_sort.content_sort(docs, keep="largest", hot_rows=hot).collect()
    assert len(got) == docs.count()
    for r in got:
        own = next(g for t, g in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"])
        assert (r["group_size"], r["keep_id"]) == (len(own), max(x for x in own if x is not None))
    assert sum(r["kept"] for r in got) == len(groups)


def test_simhash(docs):
    def plain(t):
        w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in t).replace("\n", " ").split(" ") if x]
        s = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    rows = rows_of(docs)
    prints = [plain(t) for _, t in rows]
    part = list(range(len(rows)))
    for _ in rows:
        part = [min(part[j] for j in range(len(rows)) if (prints[i] ^ prints[j]).bit_count() <= 4) for i in range(len(rows))]
    want = Counter((rows[i][0], f"{prints[i]:016x}", min(rows[j][0] for j in range(len(rows)) if part[j] == part[i] and rows[j][0] is not None)) for i in range(len(rows)))
    for hot in (1_000_000, 2):
        assert Counter(tuple(r) for r in simhash.near_dedup(docs, hot_rows=hot).collect()) == want


@pytest.mark.parametrize("hot", [1 << 17, 2000, 0])
def test_repeats(docs, hot, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", hot)
    rows = [(d, t.encode()) for d, t in rows_of(docs)]
    seen = Counter(t[i : i + 200] for _, t in rows for i in range(len(t) - 199))
    want = Counter()
    for d, t in rows:
        gone = bytearray(len(t))
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        runs = sum(1 for i in range(len(t)) if gone[i] and not (i and gone[i - 1]))
        want[d, len(t), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(t, gone) if not g)).hexdigest()] += 1
    assert Counter(tuple(r) for r in repeats.remove_repeats(docs).collect()) == want
    assert repeats.without_repeats(docs).columns == docs.columns


@pytest.mark.parametrize(("hot", "few"), [(1 << 17, 1 << 20), (3000, 1 << 20), (3000, 0), (0, 1 << 20), (0, 0)])
def test_repeats_with_many_continuations(spark, hot, few, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "FEW_WINDOWS", few)
    rng = random.Random(8)
    passage, other = rng.randbytes(150).hex(), rng.randbytes(120).hex()
    texts = [rng.randbytes(rng.randint(0, 60)).hex() + passage + rng.randbytes(rng.randint(0, 150)).hex() for _ in range(60)]
    texts += [rng.randbytes(40).hex() + other + passage for _ in range(20)] + [passage] * 15
    rows = [(k, t) for k, t in enumerate(texts)]
    seen = Counter(t[i : i + 200] for _, t in rows for i in range(len(t) - 199))
    want = Counter()
    for d, t in rows:
        gone = {j for i in range(len(t) - 199) if seen[t[i : i + 200]] > 1 for j in range(i, i + 200)}
        kept = "".join(c for j, c in enumerate(t) if j not in gone)
        want[d, len(t), len(gone), sum(j - 1 not in gone for j in gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert Counter(tuple(r) for r in got.collect()) == want


def test_repeats_of_near_copies_make_few_rows(spark, monkeypatch):
    """Hot fragments are parted into blocks: no table has a row for each window, and a fragment's uses meet one row."""
    made, keep = {}, repeats.Scratch.keep

    def counted(self, df, name):
        out = keep(self, df, name)
        made[name] = out.count()
        return out

    monkeypatch.setattr(repeats, "HOT", 3000)
    monkeypatch.setattr(repeats.Scratch, "keep", counted)
    rng = random.Random(23)
    base = rng.randbytes(600).hex()
    texts = []
    for _ in range(120):
        at = rng.randrange(1200)
        texts.append(base[:at] + rng.randbytes(2).hex() + base[at:])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    seen = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    gone = [len({j for i in range(len(t) - 199) if seen[t[i : i + 200]] > 1 for j in range(i, i + 200)}) for t in texts]
    assert [r.n_removed for r in repeats.remove_repeats(docs).orderBy("doc_id").collect()] == gone
    assert max(made.values()) <= 2 * made["names"], made


def test_repeats_of_parts_are_one_row(spark):
    """The uses of a fragment are joined to one row, however many of its parts hold repeats."""
    found = spark.createDataFrame([(1, b"a", [0, 2]), (2, b"b", [0, 3]), (3, b"c", [0, 1, 2, 5]), (7, b"z", [4, 6])], "name long, digest binary, runs array<int>")
    places = spark.createDataFrame([(9, b"w", k, d, at) for k, d, at in ((1, b"a", 0), (2, b"b", 2), (3, b"c", 10))], "name long, digest binary, part_name long, part_digest binary, shift int")
    got = repeats.put_together(found, [places], repeats.Scratch(spark, "test")).where("name > 6").orderBy("name").collect()
    assert [(r.name, r.runs) for r in got] == [(7, [4, 6]), (9, [0, 5, 10, 11, 12, 15])]


def test_repeats_of_a_batch_take_little_memory():
    rng = random.Random(5)
    strings = [rng.randbytes(300) for _ in range(repeats.BATCH // 300)]
    tracemalloc.start()
    flags = bwt.repeated(strings, np.ones(len(strings), np.int64), np.full(len(strings), 101), 200)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert not any(f.any() for f in flags)
    assert peak < 40 << 20, peak


def test_runs_of_repeats_are_the_flags():
    rng = random.Random(6)
    base = rng.randbytes(400)
    strings = [base[a : a + rng.randint(200, 260)] for a in (rng.randrange(140) for _ in range(30))] + [bytes(300), rng.randbytes(200)]
    weights, starts = np.array([rng.choice([1, 1, 2]) for _ in strings]), np.array([len(s) - 199 for s in strings])
    for shard in (1, 500, 1 << 16):
        flags = bwt.repeated(strings, weights, starts, 200, 8, shard)
        own = [(k, int(p)) for k, f in enumerate(flags) for p in np.flatnonzero(f)]
        runs = [x.tolist() for x in bwt.repeated_runs(strings, weights, starts, 200, 8, shard)]
        assert [(k, p) for k, a, b in zip(*runs, strict=True) for p in range(a, b)] == own
        assert all(k != j or b < c for (k, b), (j, c) in zip(zip(runs[0], runs[2], strict=True), list(zip(*runs[:2], strict=True))[1:], strict=False))


def test_fragments_of_grouped_texts_are_those_of_single_ones(monkeypatch):
    rng = random.Random(7)
    texts = [np.frombuffer(x, np.uint8) for x in (b"", b"a" * 199, b"a" * 200, b"ab" * 400, *(rng.randbytes(rng.randint(150, 900)) for _ in range(40)), b"z" * 2000)]
    together = [x.tolist() for x in repeats.fragments(texts, 200)]
    apart = [[k, *x] for k, t in enumerate(texts) for _, *x in zip(*[y.tolist() for y in repeats.fragments([t], 200)], strict=True)]
    assert [list(x) for x in zip(*together, strict=True)] == apart
    assert [sum(n for k, n in zip(together[0], together[3], strict=True) if k == i) for i in range(len(texts))] == [max(0, len(t) - 199) for t in texts]


@pytest.mark.parametrize("seed", [61, 86, 95])
def test_repeats_across_byte_65536(spark, seed):
    rng = random.Random(seed)
    line, head, tail = (rng.randbytes(n).hex() for n in (50, 32_700, 200))
    text = head + 3 * line + tail  # the line's windows at 65,400 and 65,500 are equal, all others differ
    got = repeats.remove_repeats(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert tuple(got) == (1, len(text), 300, 1, hashlib.sha256((head + tail).encode()).hexdigest())


def test_bwt_against_counts():
    rng = random.Random(1)
    for _ in range(30):
        s = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(12, 40))) for _ in range(rng.randint(1, 9))]
        n, w = np.array([len(x) - 11 for x in s]), np.array([rng.randint(1, 2) for _ in s])
        c = Counter()
        for x, k in zip(s, w):
            for i in range(len(x) - 11):
                c[x[i : i + 12]] += k
        got = bwt.repeated(s, w, n, 12, 3, shard_bytes=50)
        assert all([c[x[i : i + 12]] >= 2 for i in range(len(x) - 11)] == g.tolist() for x, g in zip(s, got))


ODD = ["don't we'll", "x<|endoftext|>y", "  a  b\n\n c ", "İı.", "q. w, (e). r!?", "中文 テスト", "a" * 700, "ß\x85\xa0.", "", "a\xa0 b", "é. è\u3000 .x", "..", "no...... y!?!?!?!?!?!?!", " ", "\n"]
ODD += ["".join(random.Random(k).choices("aé\u0301ñ×1. ,\n'sZİ中\xa0\u2003!?<|", k=40)) for k in range(300)]


def test_encoders():
    import tiktoken
    from tokenizers import Tokenizer

    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        t = Tokenizer.from_file(P.path(name))
        assert [x.tolist() for x in words.library_encoder(P.path(name)).encode(ODD)] == [t.encode(o, add_special_tokens=False).ids for o in ODD]
    path = P.path("byte_bpe_multi_50k.tiktoken")
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    got = list(bpe.encode(ODD, path, P.PATTERN))
    assert [x.tolist() for x in got] == [e.encode_ordinary(o) for o in ODD]
    assert [bpe.opened(path, P.PATTERN)[0].decode(x).decode() for x in got] == ODD


def test_packing(docs):
    got = packing.pack_documents(docs, P.path("byte_bpe_50k.json")).toPandas()
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]] and g["length"].sum() <= 2048
    limits = np.array([10, 3, 4])
    demand = np.array([[t, 1, min(t, 4)] for t in range(1, 11)] * 3)
    bins, _ = packing.fill(demand, limits)
    assert all((demand[bins == b].sum(0) <= limits).all() for b in set(bins.tolist()))
    assert packing.pack_documents(docs.limit(0), P.path("byte_bpe_50k.json")).count() == 0


def test_store(docs, spark, tmp_path):
    from tokenizers import Tokenizer

    t, some = Tokenizer.from_file(P.path("word_bpe_49k.json")), docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    path = str(tmp_path / "store")
    store.write(some, path, P.path("word_bpe_49k.json"), end_id=2)
    at, want = 0, {}
    for d, text in sorted(rows_of(some)):
        ids = [*t.encode(text, add_special_tokens=False).ids, 2]
        want[d] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids)
        at += len(ids)
    assert {r[0]: tuple(r)[1:] for r in store.summary(spark, path).collect()} == {d: v[:3] for d, v in want.items()}
    assert {r[0]: r[1] for r in store.read(spark, path).collect()} == {d: v[3] for d, v in want.items()}


def test_packing_of_turns(spark):
    rng = random.Random(3)
    rows = [(c, t, ("user", "assistant")[t % 2], " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randint(0, 40)))) for c in range(12) for t in range(4)]
    turns = packing.turns_of(spark.createDataFrame([*rows, (12, 0, "assistant", None)], "conv_id long, turn int, role string, text string"), P.path("byte_bpe_50k.json"), end_id=1, most=32)
    want = Counter((tuple(r["doc_id"]), r["start"], r["length"], r["length"] * (r["doc_id"]["role"] == "assistant")) for r in turns.collect())
    most = {}
    for loss in (40, 2048):
        got = packing.pack(turns, loss=loss).collect()
        assert Counter((tuple(r["doc_id"]), r["start"], r["length"], r["loss_tokens"]) for r in got) == want
        borne = Counter()
        for r in got:
            borne[r["sequence_id"]] += r["loss_tokens"]
        most[loss] = max(borne.values())
    assert most[40] <= 40 < most[2048]


@pytest.mark.parametrize("harm", ["lost file", "lost row", "exchanged rows", "wrong counts"])
def test_store_misses_nothing(docs, spark, tmp_path, harm):
    path, bad = str(tmp_path / "store"), str(tmp_path / "new")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several parts
    try:
        store.write(docs, path, P.path("word_bpe_49k.json"), end_id=2)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert store.summary(spark, path).count() == docs.count()
    rows, manifest = spark.read.parquet(f"{path}/recipes"), spark.read.parquet(f"{path}/manifest")
    part = rows.groupBy("part").agg(F.countDistinct("root").alias("n")).orderBy(F.desc("n")).first()["part"]
    own = F.col("part") == part
    places = [r["place"] for r in rows.where(own).orderBy("place").collect()]
    other = F.when(own & (F.col("place") == places[0]), places[-1]).when(own & (F.col("place") == places[-1]), places[0]).otherwise(F.col("place"))
    if harm == "wrong counts":
        manifest.withColumn("documents", F.col("documents") + 1).write.parquet(bad)
        part_of = "manifest"
    else:
        kept = {"lost file": rows.where(~own), "lost row": rows.where(~own | (F.col("place") != places[-1])), "exchanged rows": rows.withColumn("place", other)}[harm]
        kept.write.partitionBy("part").parquet(bad)
        part_of = "recipes"
    shutil.rmtree(f"{path}/{part_of}")
    shutil.move(bad, f"{path}/{part_of}")
    with pytest.raises(Exception, match="not those of the manifest|do not follow each other"):
        store.summary(spark, path).collect()
    with pytest.raises(Exception, match="not those of the manifest|do not follow each other"):
        store.read(spark, path).collect()


def test_counts():
    from tokenizers import Tokenizer, models, pre_tokenizers

    v = counts.vocabulary(P.path("piece_bpe_32k.model"))
    t = Tokenizer(models.Unigram([("<unk>", 0.0), *v], unk_id=0, byte_fallback=False))
    t.pre_tokenizer = pre_tokenizers.Metaspace()
    c = counts.Counter(v)
    for w in ("hello", "thenonan", "naïve", "中文☃☃x", "aaaaaaaa", "x9."):
        assert c.count(w) == len(t.encode(w).ids)


def test_search(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 8)).round(3)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1020, [0.0] * 8), (1040, [float("nan")] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = search.search(df, df.where("vec_id % 20 = 0"), k=5, calibration=20).toPandas()
    assert set(got["query_id"]) == set(range(0, 400, 20)) and (got.groupby("query_id").size() == 5).all()
    hits = sum(len(set(np.argsort(-np.where(np.arange(400) == q, -9e9, x @ x[q]))[:5]) & set(g["vec_id"])) for q, g in got.groupby("query_id"))
    assert hits >= 0.9 * 100


def test_language_and_toxicity():
    pieces = language.load_pieces(P.path("piece_bpe_32k.model"))
    m = language.train([("en", w, 5) for w in "the and of thing house".split()] + [("es", w, 5) for w in "el los que casa niña".split()], pieces, {"en": 5, "es": 5})
    assert m.predict(["the house of things", "la casa que los", None, "12 34", ""])[0] == ["en", "es", "und", "und", "und"]
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("aeioumnrst") for _ in range(5))
    texts = [" ".join(word() for _ in range(20)) + (" you moron " if i % 2 else " ") + word() for i in range(200)]
    model = toxicity.train(texts, [i % 2 for i in range(200)])
    assert (model.scores([texts[1] + " and on", texts[0], "", None]) >= 0.5).tolist()[:2] == [True, False]
    assert model.scores(["xx morons yy"])[0] > model.scores(["xx salad yy"])[0]
