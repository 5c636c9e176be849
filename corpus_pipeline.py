"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns a DataFrame, which run() writes as Parquet and reads again. All but
the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm import content_sort, packing, repeats, simhash, toxicity
from terrane.llm.common import Scratch, fresh, released, table
from terrane.llm.queries import tokenizer_path


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go; training reads a bounded sample of the labelled ones."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), F.lit(True))
    (score,) = fresh(docs, "score")
    return toxicity.score(docs, model, score).where(F.col(score) < 0.5).drop(score)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return content_sort.drop_copies(docs, keep="largest")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group the smallest doc_id stays, of rows that share it one; links are op3's (README: what they miss)."""
    return simhash.drop_near_copies(docs, far=4, shingle=4)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat across documents are cut out of the texts."""
    cut = repeats.without_repeats(docs, length=200)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and offset."""
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), end_id=1, tokens=2048)


STAGES = [("toxicity", clean), ("exact dedup", exact), ("SimHash near-dedup", near), ("suffix-array dedup", passages), ("packing", packed)]
#: Trained scores, fingerprints and tokens are outside SQL; tests/llm/test_pipeline.py compares all stages but the toxicity scores, and run(), with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        with released():  # what the stage kept for itself
            docs = scratch.keep(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            scratch.free(f"stage-{k - 1}")
    return docs
