"""A shared folder for files that a job writes and reads again."""

from __future__ import annotations

import atexit
import contextlib
import functools
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def own_root() -> str:
    """A folder of this process, removed at its end; for a local master without a shared folder (tests)."""
    root = tempfile.mkdtemp(prefix="terrane-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    return root


def folder(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir; a temporary folder only on a local master where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = own_root()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def settled(df: DataFrame) -> DataFrame:
    """The same rows written to the shared folder and read back: cuts the lineage of a loop, survives lost executors."""
    path = folder(df.sparkSession, "settled")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Rounds:
    """Tables of a loop under the shared folder: each name has one, the one before goes when its successor is written.

    What a result still reads lazily stays: the last table of each name, until
    drop() or, for tables made inside it, the end of released().
    """

    made: list[Rounds] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.paths, self.n = spark, folder(spark, name), {}, 0
        Rounds.made.append(self)

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{name}-{self.n}"
        df.write.parquet(path)
        before = self.paths.get(name)
        self.paths[name] = path
        if before:
            delete(self.spark, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        delete(self.spark, self.root)


def delete(spark: SparkSession, path: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def released() -> Iterator[None]:
    """Delete the tables of loops that ran inside, once their results have been written."""
    before = len(Rounds.made)
    try:
        yield
    finally:
        for r in Rounds.made[before:]:
            r.drop()
        del Rounds.made[before:]
