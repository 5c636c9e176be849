"""Exact dedup by content sort, with DataFrame operations only.

Sampled splitters range-partition the texts by a short key (a prefix of the
normalised text and its 64-bit hash, so that splitters stay small however long
texts are), an external sort places equal texts next to each other, and the
window operator compares whole neighbouring texts to find the runs.

A text so frequent that its run would fill more than a share of a partition is
dealt over several ranges by a salt; the runs of one hot text are then joined
by SHA-256, from one row for each salt.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.llm.common import Scratch, one_of_each, partitions


def content_sort(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    normalise: Callable[[Column], Column] | None = None,
    hot_rows: int | None = None,
    prefix_chars: int = 48,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    keep: "smallest" or "largest" id of a group stays; of rows that share that
    id and the text, exactly one is kept. A null text counts as empty; a null id
    loses against any other. An empty table gives an empty result. Other columns
    of the input are not read, whatever their names.
    """
    spark = docs.sparkSession
    shares = 4 * partitions(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (normalise(text) if normalise else text).alias("t"))
    rows = rows.withColumn("h", F.xxhash64("t"))
    total = rows.agg(F.count("*").alias("total"))
    bound = F.lit(hot_rows) if hot_rows else F.greatest(F.lit(64), F.col("total") / shares)
    # At most `shares` hashes can each hold more than 1/shares of the rows; a given hot_rows loses that bound,
    # so the hint is only there without it.
    hot = rows.groupBy("h").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).where(F.col("n") > bound)
    hot = hot.select("h", F.ceil(F.col("n") / bound).cast("long").alias("salts"))
    hot = hot if hot_rows else F.broadcast(hot)
    dealt = (
        rows.join(hot, "h", "left")
        .withColumn("salts", F.coalesce("salts", F.lit(1)))
        .withColumn("salt", F.pmod(F.monotonically_increasing_id(), "salts"))
        .withColumn("p", F.substring("t", 1, prefix_chars))
        .withColumn("text_sha256", F.sha2("t", 256))
    )
    best, order = (F.max, F.desc_nulls_last) if keep == "largest" else (F.min, F.asc_nulls_last)
    run = Window.partitionBy("p", "h", "salt", "t")
    runs = dealt.repartitionByRange("p", "h", "salt").select(
        "doc_id",
        "text_sha256",
        "salts",
        "salt",
        F.row_number().over(run.orderBy(order("doc_id"))).alias("rank"),
        best("doc_id").over(run).alias("run_best"),
        F.count("*").over(run).alias("run_rows"),
    )
    runs = Scratch(spark, "content-sort").keep(runs, "runs")
    heads = runs.where("salts > 1 and rank = 1").groupBy("text_sha256")
    winner = F.max_by("salt", F.struct("run_best", -F.col("salt"))) if keep == "largest" else F.min_by("salt", F.struct(F.col("run_best").isNull(), F.col("run_best"), F.col("salt")))
    heads = heads.agg(
        best("run_best").alias("best"),
        F.sum("run_rows").alias("rows"),
        winner.alias("winner"),
    )
    heads = heads if hot_rows else F.broadcast(heads)
    out = runs.join(heads, "text_sha256", "left")
    return out.select(
        "doc_id",
        F.coalesce("best", "run_best").alias("keep_id"),
        F.coalesce("rows", "run_rows").alias("group_size"),
        ((F.col("rank") == 1) & (F.coalesce("winner", "salt") == F.col("salt"))).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, **how) -> DataFrame:
    """The documents without the rows that content_sort drops; every column of the input stays.

    Of rows that share id and text one stays, of a null and an empty text with one
    id either. Columns of any names are carried; an empty table stays empty.
    """
    id_col, text_col = how.get("id_col", "doc_id"), how.get("text_col", "text")
    best = content_sort(docs, **how).groupBy("doc_id", "text_sha256").agg(F.count("*").alias("n"), F.max("kept").alias("kept")).where("kept")
    normalise = how.get("normalise") or (lambda c: c)
    sha = F.sha2(normalise(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), 256)
    return one_of_each(docs, best.select("doc_id", F.col("text_sha256").alias("t"), "n"), id_col, sha)
