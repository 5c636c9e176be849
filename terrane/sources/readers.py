"""Dirty tabular, JSON and GeoJSON sources as string-typed DataFrames."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.functions.geo import interior_point

# Place types of native features that are administration or streets, names that name nothing.
ADMINISTRATIVE = ("state", "county", "municipality", "country", "region", "province")
STREET_WORDS = ("calle", "avenida", "av.", "boulevard", "blvd", "carretera", "autopista", "camino")


def read_csv(spark: SparkSession, paths: list[str], *, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """All columns as text, headers trimmed and lower-cased; files with other columns are united by name."""
    out = None
    for p in paths:
        df = spark.read.option("header", True).option("sep", sep).option("encoding", encoding).csv(p)
        df = df.toDF(*[c.strip().lower() for c in df.columns])
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def with_aliases(df: DataFrame, fields: dict[str, list[str]]) -> DataFrame:
    """One column for each logical field: the first non-blank of its aliases that exist; null if none does."""
    columns = []
    for field, aliases in fields.items():
        found = [F.when(F.trim(F.col(a).cast("string")) != "", F.trim(F.col(a).cast("string"))) for a in aliases if a in df.columns]
        columns.append((F.coalesce(*found) if found else F.lit(None).cast("string")).alias(field))
    return df.select(*columns)


def status_number(column: str) -> list[Column]:
    """A count that may be suppressed: the number or null, and the token that stood there instead."""
    number = F.col(column).try_cast("double")
    return [number.alias(column), F.when(number.isNull(), F.coalesce(F.trim(F.col(column)), F.lit(""))).alias(f"{column}_status")]


def sniff(head: bytes, known: set[str]) -> tuple[str, str]:
    """(encoding, delimiter) of a file's first bytes: UTF-8 if they are valid, and the delimiter that shows most known headers."""
    try:
        text, encoding = head.decode("utf-8-sig"), "UTF-8"
    except UnicodeDecodeError as e:
        if e.start > len(head) - 4:  # a character cut at the end
            text, encoding = head[: e.start].decode("utf-8-sig"), "UTF-8"
        else:
            text, encoding = head.decode("cp1252", "replace"), "windows-1252"  # a guess from the head; official.decode_strict decides
    line = text.lstrip().splitlines()[0] if text.strip() else ""
    hits = {d: sum(h.strip().strip('"').lower() in known for h in line.split(d)) for d in (",", ";", "\t", "|")}
    return encoding, max(hits, key=lambda d: (hits[d], d == ","))


def read_with_preamble(spark: SparkSession, path: str, marker: str, *, sep: str = ",", within: int = 12) -> DataFrame:
    """A small CSV whose header, the first row that holds `marker` among the first ones, follows a preamble; no rows without a header.

    Columns are named by the header. Rows before it are dropped by their number, so
    a data row that looks like one of them stays; quoted line breaks are kept.
    """
    from terrane.sources.official import file_rows, headed

    rows = headed(file_rows(spark, path, sep=sep), [marker.upper()], within=within)
    first = rows.select(F.array_sort(F.map_keys("r")).alias("k")).limit(1).collect()  # one row: the names
    names = [n for n in first[0]["k"] if not n.startswith("\x1f")] if first else []
    return rows.select(*[F.col("r")[n].alias(n.lower()) for n in names])


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Features of collections: properties as a map of text, geometry type and coordinates as JSON text; one file is one record of a task."""
    schema = "features array<struct<properties: map<string,string>, geometry: struct<type: string, coordinates: string>>>"
    features = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    return features.select(F.col("f.properties").alias("properties"), F.col("f.geometry.type").alias("type"), F.col("f.geometry.coordinates").alias("coordinates"))


def read_feature_lines(spark: SparkSession, path: str) -> DataFrame:
    """As read_geojson, from files of one feature a line, which Spark splits: feature by feature, however large they are."""
    schema = "properties map<string,string>, geometry struct<type: string, coordinates: string>"
    rows = spark.read.schema(schema).json(path)
    return rows.where("geometry is not null").select("properties", F.col("geometry.type").alias("type"), F.col("geometry.coordinates").alias("coordinates"))


def native_places(features: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """(id, name, type, lon, lat) of named place features inside the box: streets, administrative areas and nameless ones go, one row for an id.

    Points give their place, polygons and multipolygons a point inside them and in no hole
    (those of cities and towns are areas, not places, and go), lines their middle vertex.
    """
    name = F.trim(F.coalesce(F.col("properties")["name"], F.lit("")))
    kind = F.lower(F.coalesce(F.col("properties")["place"], F.lit("suburb")))
    point = F.from_json("coordinates", "array<double>")
    line = F.from_json("coordinates", "array<array<double>>")
    rings = F.from_json("coordinates", "array<array<array<double>>>")
    parts = F.flatten(F.from_json("coordinates", "array<array<array<array<double>>>>"))
    vertices = lambda rs: F.transform(rs, lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    area = F.col("type").isin("Polygon", "MultiPolygon")
    inner = interior_point(vertices(F.when(F.col("type") == "Polygon", rings).when(F.col("type") == "MultiPolygon", parts)))
    middle = F.get(line, F.floor((F.size(line) - 1) / 2).cast("int"))
    at = lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat"))
    place = F.when(F.col("type") == "Point", at(point)).when(area, F.struct(inner["x"].alias("lon"), inner["y"].alias("lat"))).when(F.col("type") == "LineString", at(middle))
    street = F.lit(False)
    for w in STREET_WORDS:
        street |= F.lower(name).startswith(w + " ")
    rows = features.where((name != "") & ~(area & kind.isin("city", "town")) & ~kind.isin(*ADMINISTRATIVE) & ~street & ~name.rlike("^[0-9.,-]+$"))
    rows = rows.withColumns({"_id": F.col("properties")["id"], "_name": name, "_kind": kind, "_places": F.array(place)})
    rows = rows.select(F.col("_id").alias("id"), F.col("_name").alias("name"), F.col("_kind").alias("type"), F.explode("_places").alias("p"))  # found once, before the box is looked at
    rows = rows.select("id", "name", "type", "p.lon", "p.lat").where(F.col("lon").between(box[0], box[2]) & F.col("lat").between(box[1], box[3]))
    return rows.groupBy("id").agg(F.min(F.struct("name", "type", "lon", "lat")).alias("p")).select("id", "p.*")


def read_zipped(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """(file, member, content) of the members of ZIP files with a suffix, archives inside archives too; one archive per task."""

    def members(data: bytes, prefix: str) -> Iterator[tuple[str, bytes]]:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for m in z.namelist():
                if m.endswith(".zip"):
                    yield from members(z.read(m), f"{prefix}{m}/")
                elif m.endswith(suffix):
                    yield prefix + m, z.read(m)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                for m, content in members(bytes(data), ""):
                    yield pd.DataFrame({"file": [name], "member": [m], "content": [content]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, member string, content binary")


POINT = "struct<id: string, location: array<double>, jobs: bigint, residents: bigint>"
POP = "struct<id: string, size: bigint, residenceId: string, jobId: string, drivingSeconds: bigint, drivingDistance: bigint>"


def read_demand(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Points and cohorts of a demand document (see demand_violations)."""
    doc = spark.read.schema(f"points array<{POINT}>, pops array<{POP}>").option("multiLine", True).json(path)
    return doc.select(F.explode("points").alias("p")).select("p.*"), doc.select(F.explode("pops").alias("p")).select("p.*")


def read_demand_package(spark: SparkSession, path: str, member: str = "demand_data.json") -> tuple[DataFrame, DataFrame]:
    """As read_demand, from ZIP packages."""
    doc = read_zipped(spark, path, member).select(F.from_json(F.decode("content", "UTF-8"), f"points array<{POINT}>, pops array<{POP}>").alias("d")).select("d.*")
    return doc.select(F.explode("points").alias("p")).select("p.*"), doc.select(F.explode("pops").alias("p")).select("p.*")


def demand_violations(points: DataFrame, pops: DataFrame) -> DataFrame:
    """(rule, violations) an import must refuse: ids missing or repeated, places out of range, counts negative or missing, sizes not positive, ends unknown."""
    ids = points.groupBy("id").agg(F.count("*").alias("n"))
    place = F.col("location")
    bad_place = place.isNull() | (F.size(place) != 2) | ~F.coalesce(place[0].between(-180, 180) & place[1].between(-85, 85), F.lit(False))
    count = lambda c: F.col(c).isNull() | (F.col(c) < 0)
    known = ids.where("id is not null").select("id")
    lost = lambda end: pops.join(known.withColumnRenamed("id", end), end, "left_anti")
    rules = (
        ("missing id", points.where("id is null or id = ''")),
        ("repeated id", ids.where("n > 1")),
        ("place out of range", points.where(bad_place)),
        ("count missing or negative", points.where(count("residents") | count("jobs"))),
        ("size not positive", pops.where(F.col("size").isNull() | (F.col("size") <= 0))),
        ("unknown residence", lost("residenceId")),
        ("unknown job", lost("jobId")),
    )
    out = None
    for name, rows in rules:
        one = rows.agg(F.lit(name).alias("rule"), F.count("*").alias("violations"))
        out = one if out is None else out.unionByName(one)
    return out


def select_sources(own: list[str], shared: list[str], excluded: list[str]) -> list[str]:
    """Paths in order, a project's own before the shared ones, each once, without the excluded names."""
    gone = set(excluded)
    return [p for p in dict.fromkeys([*sorted(own), *sorted(shared)]) if p.rsplit("/", 1)[-1] not in gone and p not in gone]


def config_violations(config: dict) -> list[str]:
    """What is wrong with a city's configuration: box, code, zones and special places."""
    out, city = [], config.get("city") or {}
    box = city.get("bbox")
    whole = isinstance(box, (list, tuple)) and len(box) == 4 and all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in box)
    if not whole:
        out.append("city.bbox must have four numbers")
    elif not (-180 <= box[0] < box[2] <= 180 and -90 <= box[1] < box[3] <= 90):
        out.append("city.bbox must run from west to east and south to north")
    code = city.get("code")
    if not (isinstance(code, str) and 2 <= len(code) <= 4 and code.isalnum()):
        out.append("city.code must have two to four letters or digits")
    for z in config.get("zones") or []:
        ring = z.get("coordinates")
        if not (z.get("bbox") or (isinstance(ring, list) and len(ring) >= 3)):
            out.append(f"zone {z.get('id')} has neither a box nor a ring")
    seen: set = set()
    for p in config.get("pois") or []:
        if p.get("id") in seen:
            out.append(f"special place {p.get('id')} is given twice")
        seen.add(p.get("id"))
        loc = p.get("loc")
        inside = isinstance(loc, (list, tuple)) and len(loc) == 2 and (not whole or (box[0] <= loc[0] <= box[2] and box[1] <= loc[1] <= box[3]))
        if not inside:
            out.append(f"special place {p.get('id')} lies outside the box")
        if "jobs" in p and p["jobs"] is None:
            out.append(f"special place {p.get('id')} has undecided demand")
    return out


def config_problems(configs: DataFrame, key: str, value: str) -> DataFrame:
    """(key, problems) of configurations given as JSON text, one a row; text that is no JSON object has that one problem."""
    import json

    kind = configs.schema[key].dataType.simpleString()

    def problems(text: str | None) -> list[str]:
        try:
            config = json.loads(text or "")
        except ValueError:
            config = None
        return config_violations(config) if isinstance(config, dict) else ["the configuration is no JSON object"]

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({key: f.iloc[:, 0], "problems": [problems(t) for t in f.iloc[:, 1]]})

    return configs.select(key, value).mapInPandas(run, f"{key} {kind}, problems array<string>")


def discovered(spark: SparkSession, root: str, suffix: str = ".csv", excluded: list[str] | None = None) -> DataFrame:
    """(source, files, bytes) of the folders under a root that hold files with a suffix, none of whose parts is excluded; names and sizes are listed, nothing is read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(root).select("path", "length")
    own = F.substring_index(F.regexp_replace("path", "/[^/]*$", ""), root.rstrip("/").rsplit("/", 1)[-1] + "/", -1)
    found = listed.groupBy(own.alias("source")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
    return found.where(~F.arrays_overlap(F.split("source", "/"), F.array(*[F.lit(x) for x in excluded]))) if excluded else found


def read_config(spark: SparkSession, path: str) -> dict:
    """One small configuration file: JSON, or YAML where a YAML library is installed."""
    import json

    data = bytes(spark.read.format("binaryFile").load(path).select("content").first()["content"]).decode()
    if path.endswith(".json") or path.endswith(".txt"):
        return json.loads(data)
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("YAML configurations need a YAML library; use JSON") from e
    return yaml.safe_load(data)
