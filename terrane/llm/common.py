"""Shared plumbing of the training-data operators: tables, scratch space, split keys."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a folder of our own only where none is set (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="terrane-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", root)
    return root


class Scratch:
    """Tables written to the shared checkpoint folder: they cut lineage and survive lost executors.

    Results read them lazily, so they stay until their owner is done: released()
    deletes all that were made inside it.
    """

    made: list[Scratch] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
        Scratch.made.append(self)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}"
        df.write.option("compression", "zstd").mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def free(self, name: str) -> None:
        """Delete a table that later steps no longer read, and let Spark drop finished shuffles (a saving of disk, nothing depends on it)."""
        self._delete(f"{self.path}/{name}")
        self.spark.sparkContext._jvm.System.gc()

    def _delete(self, path: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def released() -> Iterator[None]:
    """Delete the scratch tables made inside, once what was computed from them has been written."""
    before = len(Scratch.made)
    try:
        yield
    finally:
        for s in Scratch.made[before:]:
            s._delete(s.path)
        del Scratch.made[before:]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores as it takes to clash with no column of df (case aside)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


_memos: dict[str, Callable[[], object]] = {}


def claim(name: str, clear: Callable[[], object] = lambda: None) -> None:
    """Called in a Python worker by the operator that runs there: what other operators remembered in it is forgotten."""
    for other, forget in list(_memos.items()):
        if other != name:
            forget()
            del _memos[other]
    _memos[name] = clear


def one_of_each(docs: DataFrame, kept: DataFrame, id_col: str, text: Column) -> DataFrame:
    """The rows of docs whose id and digest of their text are in kept (doc_id, t, n), one for each, in all their columns.

    n says how many rows of docs share that pair: only where some pair has several are
    rows compared with each other; else nothing but the join moves the documents.
    """
    own, kept_id, kept_text, many = fresh(docs, "own_text", "kept_id", "kept_text", "kept_rows")
    kept = Scratch(docs.sparkSession, "kept").keep(kept.toDF(kept_id, kept_text, many), "pairs")
    match = F.col(id_col).eqNullSafe(F.col(kept_id)) & (F.col(own) == F.col(kept_text))
    found = lambda pairs: docs.withColumn(own, text).join(pairs, match, "left_semi")
    twins = kept.where(F.col(many) > 1)
    if twins.isEmpty():
        return found(kept).drop(own)
    return found(kept.where(F.col(many) == 1)).unionByName(found(twins).dropDuplicates([id_col, own])).drop(own)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def split_of(doc_id: Column, buckets: int) -> Column:
    """crc32 of the id as text, modulo buckets; 0 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % buckets, F.lit(0))
