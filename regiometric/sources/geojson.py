"""GeoJSON polygons as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_RING = "array<array<array<double>>>"


def _feature(key: str, coordinates: str) -> str:
    return f"struct<properties: struct<`{key}`: string>, geometry: struct<type: string, coordinates: {coordinates}>>"


def _rows(df: DataFrame, key: str, flat: Column, nested: Column) -> DataFrame:
    """A polygon is a list of rings and a multi-polygon a list of polygons; both leave as a list of polygons."""
    kind = F.coalesce(nested["geometry"]["type"], flat["geometry"]["type"])
    many = nested["geometry"]["coordinates"]
    one = flat["geometry"]["coordinates"]
    geometry = F.when(kind == "MultiPolygon", many).when(kind == "Polygon", F.array(one))
    name = F.coalesce(nested["properties"][key], flat["properties"][key])
    return df.select(name.alias(key), kind.alias("geometry_type"), geometry.alias("polygons"))


def parse_features(lines: DataFrame, text: str = "value", key: str = "reg_id") -> DataFrame:
    """Rows ``key``, ``geometry_type``, ``polygons`` from a text column with one GeoJSON feature per row.

    Coordinates are read as DOUBLE even where written as whole numbers.
    """
    parsed = lines.select(
        F.from_json(text, _feature(key, _RING)).alias("_flat"),
        F.from_json(text, _feature(key, f"array<{_RING}>")).alias("_nested"),
    )
    return _rows(parsed, key, F.col("_flat"), F.col("_nested"))


def read_geojson(spark: SparkSession, path: str, key: str = "reg_id", layout: str = "lines") -> DataFrame:
    """Polygons from GeoJSON files.

    ``layout="lines"``: one feature per line, which Spark splits like any text file. ``layout="collection"``: whole
    FeatureCollection documents; a JSON document cannot be split, so each file is parsed by one task, and a large layer
    belongs into many files or lines.
    """
    if layout == "lines":
        return parse_features(spark.read.text(path), "value", key)
    if layout != "collection":
        raise ValueError("layout must be 'lines' or 'collection'")
    # features are kept as text first, so that both geometry types can be read from the same field
    documents = spark.read.schema("features array<string>").option("multiLine", True).json(path)
    return parse_features(documents.select(F.explode("features").alias("value")), "value", key)
