"""Tables in their roles: nations are zones, customers origins, suppliers destinations, line items flows, parts establishments."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def registry() -> tuple[dict, dict, Callable]:
    queries: dict = {}
    oracles: dict = {}

    def query(sql: str | None = None, name: str | None = None):
        def add(f):
            key = name or f.__name__
            queries[key] = f
            if sql:
                oracles[key] = sql
            return f

        return add

    return queries, oracles, query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows between nations: o, d, size, year."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", F.col("l_quantity").cast("long").alias("size"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("o"))
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("d"))
    return (
        line.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .select("o", "d", "size", "year")
    )


EDGES = """e AS (
  SELECT c_nationkey AS o, s_nationkey AS d, CAST(l_quantity AS BIGINT) AS size, CAST(year(o_orderdate) AS INTEGER) AS year
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
)"""


def place(key: Column, scale: float = 1.0) -> tuple[Column, Column]:
    """Proxy coordinates of a key in a square of 100 x 100 times the scale."""
    return (key * 37 % 1000) / 10.0 * scale, (key * 53 % 1000) / 10.0 * scale


def place_sql(key: str) -> tuple[str, str]:
    return f"(({key} * 37 % 1000) / 10.0::DOUBLE)", f"(({key} * 53 % 1000) / 10.0::DOUBLE)"


def nation_place(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    px, py = place(F.col(key))
    return df.withColumns({x: px, y: py})


CX, CY = place_sql("c_custkey")
SX, SY = place_sql("s_suppkey")

TABLES = "region nation customer supplier part orders lineitem events documents labels".split()


def shared(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A DataFrame from SQL that both engines read alike; table names stand for the tables of sf_dir."""
    used = [t for t in TABLES if re.search(rf"\b{t}\b", sql)]
    text = re.sub(rf"\b({'|'.join(TABLES)})\b", r"{\1}", sql)
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in used})
