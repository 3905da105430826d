"""Feature layers as GeoJSON text: read, write, page and clip."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURE = "type string, properties map<string,string>, geometry struct<type:string,coordinates:string>"


def read_features(spark: SparkSession, path: str, where: str | None = None) -> DataFrame:
    """Features of the collections below ``path``: properties (a map of texts), kind, coordinates (JSON text), filtered by ``where``."""
    whole = spark.read.option("wholetext", True).text(path)
    schema = f"type string, features array<struct<{_fields(FEATURE)}>>"
    rows = whole.select(F.explode(F.from_json("value", schema)["features"]).alias("f"))
    out = rows.select(F.col("f.properties").alias("properties"), F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"))
    return out.filter(where) if where else out


def _fields(ddl: str) -> str:
    """Top-level fields of a DDL as a struct's."""
    out, depth = [], 0
    for part in ddl.split(", "):
        name, kind = part.split(" ", 1) if not depth else (None, part)
        out.append(f"{name}:{kind}" if name else part)
        depth += part.count("<") - part.count(">")
    return ",".join(out)


def optional_features(spark: SparkSession, path: str) -> DataFrame:
    """read_features(), or no rows where there is nothing at ``path``."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return read_features(spark, path)
    return spark.createDataFrame([], "properties map<string,string>, kind string, coordinates string")


def cached_features(spark: SparkSession, path: str, build) -> DataFrame:
    """The layer at ``path``; where there is none yet, ``build()`` (properties, kind, coordinates as an array) is written there first."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        write_lines(build(), path)
    return read_lines(spark, path)


def read_lines(spark: SparkSession, path: str, where: str | None = None) -> DataFrame:
    """Features of line-delimited GeoJSON, one to a line: files of any size are split among tasks."""
    rows = spark.read.text(path).select(F.from_json("value", FEATURE).alias("f"))
    out = rows.select(F.col("f.properties").alias("properties"), F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"))
    return out.filter(where) if where else out


def write_lines(rows: DataFrame, path: str) -> None:
    """Write (properties, kind, coordinates as an array) as line-delimited GeoJSON."""
    rows.select(_feature().alias("value")).write.text(path)


def _feature() -> F.Column:
    return F.to_json(F.struct(F.lit("Feature").alias("type"), "properties", F.struct(F.col("kind").alias("type"), "coordinates").alias("geometry")))


def read_pages(spark: SparkSession, paths: Iterable[str], where: str | None = None) -> DataFrame:
    """A layer fetched page by page, as one."""
    return read_features(spark, ",".join(paths) if isinstance(paths, str) else list(paths), where)


def page_size(most: F.Column) -> F.Column:
    """Rows to ask for at a time: what the server allows, 1000 if it does not say, 2000 at most."""
    return F.least(F.coalesce(most, F.lit(1000)), F.lit(2000))


def line_parts(features: DataFrame) -> DataFrame:
    """One row per line of line and multi-line features, with ``points``; other kinds go."""
    one = F.array(F.from_json("coordinates", "array<array<double>>"))
    many = F.from_json("coordinates", "array<array<array<double>>>")
    parts = F.when(F.col("kind") == "LineString", one).when(F.col("kind") == "MultiLineString", many)
    line = lambda part: F.transform(part, lambda p: F.struct(F.get(p, 0).alias("lon"), F.get(p, 1).alias("lat")))
    return features.filter(F.col("kind").isin("LineString", "MultiLineString")).select("properties", F.explode(parts).alias("part")).select("properties", line(F.col("part")).alias("points"))


def points_of(features: DataFrame) -> DataFrame:
    """One row per point of point and multi-point features, with lon and lat."""
    one = F.array(F.from_json("coordinates", "array<double>"))
    many = F.from_json("coordinates", "array<array<double>>")
    parts = F.when(F.col("kind") == "Point", one).when(F.col("kind") == "MultiPoint", many)
    return features.filter(F.col("kind").isin("Point", "MultiPoint")).select("properties", F.explode(parts).alias("p")).select("properties", F.get("p", 0).alias("lon"), F.get("p", 1).alias("lat"))


def write_features(rows: DataFrame, path: str) -> None:
    """Write (properties, kind, coordinates as an array) as GeoJSON, one collection per file and partition.

    Files are bounded by their partition; no row passes through the driver.
    """
    dealt = rows.select(_feature().alias("f")).withColumn("_part", F.spark_partition_id()).withColumn("_chunk", F.floor(F.monotonically_increasing_id() / 5000))
    packed = dealt.groupBy("_part", "_chunk").agg(F.array_join(F.collect_list("f"), ",").alias("fs"))
    packed.select(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.col("fs"), F.lit("]}")).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
