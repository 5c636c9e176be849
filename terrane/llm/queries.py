"""The queries of the training-data operators and the SQL that some of them can be checked against."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm.common import split_of, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrane.llm import language

    docs = table(spark, sf_dir, "documents")
    held = split_of(F.col("doc_id"), 4) == 2
    model = language.fit(docs, ~held, language.load_pieces(tokenizer_path("piece_bpe_32k.model")))
    return language.identify(docs, model).withColumn("held_out", held).select("doc_id", "held_out", "lang_pred", "score")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrane.llm.packing import pack_documents

    packed = pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=1, tokens=2048)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrane.llm.simhash import near_dedup

    return near_dedup(table(spark, sf_dir, "documents"), far=4, shingle=4)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrane.llm.content_sort import content_sort

    return content_sort(table(spark, sf_dir, "documents"), keep="largest")


OP4_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""


def op5_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrane.llm.store import store_and_check

    return store_and_check(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2)


def op6_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrane.llm.search import search

    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from terrane.llm.bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrane.llm.counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrane.llm.repeats import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), length=200)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrane.llm import toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = split_of(F.col("doc_id"), 5) == 0
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrane.llm.suffix_tree import score_texts

    scored = score_texts(table(spark, sf_dir, "documents"), split_of(F.col("doc_id"), 10) != 0)
    return scored.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def planted_order(doc_id: int | None, n: int) -> np.ndarray | None:
    """The order of words in a text of n: one text in ten, by its id, repeats some of its words from a place on (null ids: as they stand)."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrane.llm.runs import collapse_runs, digests

    return collapse_runs(table(spark, sf_dir, "documents"), planted_order).select("doc_id", *digests())


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrane.llm.whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"), k=4)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language": op1_language,
    "op2_packing": op2_packing,
    "op3_simhash": op3_simhash,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_store": op5_store,
    "op6_search": op6_search,
    "op7_bpe": op7_bpe,
    "op8_counts": op8_counts,
    "op9_repeats": op9_repeats,
    "op10_toxicity": op10_toxicity,
    "op11_scoring": op11_scoring,
    "op12_runs": op12_runs,
    "op13_whitening": op13_whitening,
}
ORACLES: dict[str, str] = {"op4_exact_dedup": OP4_SQL}
