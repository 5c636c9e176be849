"""Sinks: tables, demand documents, packages, feature files, indexes and digests."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def feature(df: DataFrame, lon: str, lat: str) -> Column:
    """A GeoJSON point feature of a row, as JSON text."""
    props = F.struct(*[F.col(c) for c in df.columns if c not in (lon, lat)])
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")).alias("geometry"), props.alias("properties")))


def write_features(df: DataFrame, path: str, lon: str, lat: str) -> None:
    """One GeoJSON point feature per line, in parallel part files."""
    df.select(feature(df, lon, lat).alias("value")).write.mode("overwrite").text(path)


def write_feature_collection(df: DataFrame, path: str, lon: str, lat: str, order: str) -> None:
    """One FeatureCollection document in one file, feature by feature in order: for map layers, which are small."""
    rows = df.select(F.col(order).cast("long").alias("_at"), feature(df, lon, lat).alias("value"))
    last = df.agg(F.max(F.col(order).cast("long")).alias("m"))
    lines = rows.join(F.broadcast(last)).select("_at", F.concat("value", F.when(F.col("_at") == F.col("m"), "").otherwise(",")).alias("value"))
    spark = df.sparkSession
    ends = spark.createDataFrame([(-(2**62), '{"type": "FeatureCollection", "features": ['), (2**62, "]}")], "_at long, value string")
    lines.unionByName(ends).repartition(1).sortWithinPartitions("_at").select("value").write.mode("overwrite").text(path)


def write_demand(points: DataFrame, pops: DataFrame, path: str) -> None:
    """Points and cohorts as compact JSON lines side by side."""
    points.write.mode("overwrite").json(f"{path}/points")
    pops.write.mode("overwrite").json(f"{path}/pops")


def demand_document(points: DataFrame, pops: DataFrame) -> DataFrame:
    """One row `value`: the demand document of a map, points and cohorts in order of id. A map is a document; it is made in one task."""
    p = points.agg(F.array_sort(F.collect_list(F.struct("id", *[c for c in points.columns if c != "id"]))).alias("points"))
    q = pops.agg(F.array_sort(F.collect_list(F.struct("id", *[c for c in pops.columns if c != "id"]))).alias("pops"))
    return p.join(q).select(F.to_json(F.struct("points", "pops")).alias("value"))


def packaged(members: DataFrame) -> DataFrame:
    """(content, sha256) of one ZIP per package: members (package, name, value) in order of name, with fixed times, so that equal members give equal bytes."""
    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for r in g.sort_values("name").itertuples(index=False):
                z.writestr(zipfile.ZipInfo(r.name, (1980, 1, 1, 0, 0, 0)), r.value)
        return pd.DataFrame({"package": [key[0]], "content": [out.getvalue()]})

    zips = members.groupBy("package").applyInPandas(run, "package string, content binary")
    return zips.withColumn("sha256", F.sha2("content", 256))


def write_packages(zips: DataFrame, path: str) -> None:
    """ZIP files, one for each row (package, content), written by the executors through Hadoop's file system."""
    zips.select("package", "content").write.mode("overwrite").format("parquet").save(path)


def write_table(df: DataFrame, path: str, rows_per_group: int = 25_000) -> None:
    """Parquet that appears as a whole when the job commits, in files of about so many rows."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_group).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def cell_index(boxes: DataFrame, size: float) -> DataFrame:
    """(cx, cy, ids): the ids of boxes (id, x1, y1, x2, y2) that touch each cell of a grid, in order; a large box is in many cells."""
    cells = boxes.withColumn("cx", F.explode(F.sequence(F.floor(F.col("x1") / size), F.floor(F.col("x2") / size)))).withColumn("cy", F.explode(F.sequence(F.floor(F.col("y1") / size), F.floor(F.col("y2") / size))))
    return cells.groupBy("cx", "cy").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def osm_patch(df: DataFrame) -> DataFrame:
    """One XML node a row of (id, name, place, lon, lat), as text."""
    node = F.struct(F.col("id").alias("_id"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), F.array(F.struct(F.lit("name").alias("_k"), F.col("name").alias("_v")), F.struct(F.lit("place").alias("_k"), F.col("place").alias("_v"))).alias("tag"))
    return df.select("id", F.to_xml(node, {"rowTag": "node", "attributePrefix": "_"}).alias("value"))


def manifest(df: DataFrame) -> DataFrame:
    """Row count and an order-free digest of a table: the sum of its row hashes."""
    row = F.xxhash64(*df.columns).cast("decimal(38,0)")
    return df.select(row.alias("h")).agg(F.count("*").alias("rows"), F.sum("h").cast("string").alias("digest"))


def cached_table(df: DataFrame, inputs: dict[str, str], root: str) -> DataFrame:
    """The table kept under the digest of what it depends on, or made, written and kept; a kept one is checked against its manifest before use.

    inputs: names and digests of sources and settings; any change gives another path.
    """
    import hashlib
    import json

    spark = df.sparkSession
    path = f"{root.rstrip('/')}/{hashlib.sha256(json.dumps(inputs, sort_keys=True).encode()).hexdigest()}"
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/_SUCCESS")
    known = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs_path)
    if not known:
        df.write.mode("overwrite").parquet(f"{path}/rows")
        manifest(spark.read.parquet(f"{path}/rows")).write.mode("overwrite").parquet(f"{path}/manifest")
    rows = spark.read.parquet(f"{path}/rows")
    if known and manifest(rows).first() != spark.read.parquet(f"{path}/manifest").first():
        raise ValueError(f"the kept table at {path} is not what was written")
    return rows
