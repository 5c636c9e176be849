"""Place names: classification, changes, duplicate groups, scores, labels."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions.scalars import fold_accents


def classify(name: Column) -> Column:
    """struct(category, number) by ordered rules."""
    plain = fold_accents(name)
    low = F.lower(plain)
    category = (
        F.when(low.rlike("^(sm|smz|supermanzana)[ .]*[0-9]+"), "supermanzana")
        .when(plain.rlike("^[0-9]+$"), "number")
        .when(low.rlike("^(colonia|col[.]) "), "colonia")
        .when(low.rlike("^(fraccionamiento|fracc[.]?) "), "fraccionamiento")
        .when(low.rlike("[0-9]"), "mixed")
        .otherwise("other")
    )
    number = F.regexp_extract(plain, "([0-9]+)", 1)
    return F.struct(category.alias("category"), F.when(number != "", number).alias("number"))


def regex_changes(df: DataFrame, column: str, pattern: str, replacement: str) -> DataFrame:
    """Rows that a replacement changes, with the text before and after."""
    out = df.withColumn("after", F.regexp_replace(column, pattern, replacement)).withColumnRenamed(column, "before")
    return out.where("before <> after")


def exact_groups(df: DataFrame, keys: list[str], key: str, score: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.min(key).alias("winner"), F.max(score).alias("size")).where("n >= 2")


def block_pairs(df: DataFrame, keys: list[str], key: str, residual: Column) -> DataFrame:
    """Pairs of distinct representatives that share a block and pass the residual test (on aliases l and r)."""
    same = F.lit(True)
    for k in keys:
        same &= F.col(f"l.{k}") == F.col(f"r.{k}")
    j = df.alias("l").join(df.alias("r"), same & (F.col(f"l.{key}") < F.col(f"r.{key}")))
    return j.where(residual).select(F.col(f"l.{key}").alias("a"), F.col(f"r.{key}").alias("b"))


def consensus(df: DataFrame, group: str, label: str) -> DataFrame:
    """One label where a group agrees, else review."""
    one = F.when(F.countDistinct(label) == 1, F.min(label).cast("string")).otherwise("review")
    return df.groupBy(group).agg(one.alias("label"), F.count("*").alias("n"))


def scores(df: DataFrame) -> DataFrame:
    """Additive score of size, source and form of the name, and its tier."""
    source = F.when(F.col("p_brand").endswith("1"), 200).when(F.col("p_brand").endswith("2"), 350).otherwise(0)
    s = (F.col("p_size") * 10 + source + F.when(F.col("key").rlike("[0-9]"), -50).otherwise(100)).cast("int")
    return df.withColumn("score", s).withColumn("tier", F.when(F.col("score") >= 600, "large").when(F.col("score") >= 300, "medium").otherwise("small"))


def plan_labels(df: DataFrame, zooms: range, *, width: float = 7.0, height: float = 14.0) -> DataFrame:
    """(zone, id, zoom): the zoom at which each label first shows, null if it never does.

    Within a zone, zoom by zoom and in order of priority (then id), a label shows
    where its box meets none that shows already. The order is sequential, so a zone
    is one group of applyInPandas; zones bound what a task holds.
    """

    def plan(key: tuple, zone: pd.DataFrame) -> pd.DataFrame:
        zone = zone.sort_values(["priority", "id"], ascending=[False, True])
        shown: dict = {}
        for zoom in zooms:
            world, boxes = 256 * 2**zoom, []

            def box(r, world=world):
                x = (r.lon + 180) / 360 * world
                y = (1 - math.asinh(math.tan(math.radians(r.lat))) / math.pi) / 2 * world
                w = r.chars * width / 2
                return x - w, y - height / 2, x + w, y + height / 2

            rows = list(zone.itertuples())
            for r in sorted(rows, key=lambda r: r.id not in shown):
                b = box(r)
                if r.id in shown or all(b[2] <= o[0] or o[2] <= b[0] or b[3] <= o[1] or o[3] <= b[1] for o in boxes):
                    shown.setdefault(r.id, zoom)
                    boxes.append(b)
        return pd.DataFrame({"zone": key[0], "id": zone["id"], "zoom": [shown.get(i) for i in zone["id"]]})

    return df.groupBy("zone").applyInPandas(plan, "zone int, id long, zoom int")
