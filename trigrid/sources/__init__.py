"""Readers of points and polygons, and the writer of cell features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.address import level_of, to_compact, to_path, unsigned

LON, LAT = ("lon", "lng", "long", "longitude", "x"), ("lat", "latitude", "y")


def points_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header -> its columns with lon, lat (null if not numbers in range). Columns go by their usual
    names, failing that the first two; longitudes wrap into [-180, 180)."""
    t = spark.read.option("header", True).csv(path)
    pick = lambda names, k: next((c for c in t.columns if c.strip().lower() in names), t.columns[k])
    x = F.expr(f"try_cast(trim(`{pick(LON, 0)}`) AS double)")
    y = F.expr(f"try_cast(trim(`{pick(LAT, 1)}`) AS double)")
    ok = (F.abs(y) <= 90) & (F.abs(x) < float("inf"))
    rest = [c for c in t.columns if c.lower() not in ("lon", "lat")]
    return t.select(*[F.col(f"`{c}`") for c in rest], F.when(ok, wrapped(x)).alias("lon"), F.when(ok, y).alias("lat"))


def wrapped(lon):
    """Longitudes in [-180, 180)."""
    return F.pmod(lon + 180, F.lit(360.0)) - 180


GEOMETRY = "struct<type:string,coordinates:string>"


def _features(spark: SparkSession, path: str) -> DataFrame:
    """(feature, kind, c, properties) of FeatureCollections, single Features and bare geometries, coordinates as text.
    Files are read whole, one a task; a table of many features is better kept as a feature a line."""
    t = spark.read.text(path, wholetext=True)
    f = F.from_json("value", f"struct<type:string,coordinates:string,geometry:{GEOMETRY},properties:string,features:array<struct<geometry:{GEOMETRY},properties:string>>>")
    t = t.select(f.alias("f"))
    one = F.when(F.col("f.geometry").isNotNull(), F.struct(F.col("f.geometry").alias("geometry"), F.col("f.properties").alias("properties"))).otherwise(F.struct(F.struct(F.col("f.type").alias("type"), F.col("f.coordinates").alias("coordinates")).alias("geometry"), F.lit(None).cast("string").alias("properties")))
    t = t.select(F.posexplode(F.coalesce("f.features", F.array(one))).alias("feature", "x"))
    return t.select("feature", F.col("x.geometry.type").alias("kind"), F.col("x.geometry.coordinates").alias("c"), F.col("x.properties").alias("properties"))


def points_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Point and MultiPoint features -> (feature, lon, lat); other geometries give no rows. Longitudes wrap into
    [-180, 180); places out of range or without numbers are null."""
    t = _features(spark, path)
    many = F.when(F.col("kind") == "Point", F.array(F.from_json("c", "array<double>"))).when(F.col("kind") == "MultiPoint", F.from_json("c", "array<array<double>>"))
    t = t.select("feature", F.explode(many).alias("p")).select("feature", F.get("p", F.lit(0)).alias("x"), F.get("p", F.lit(1)).alias("y"))
    ok = (F.abs("y") <= 90) & (F.abs("x") < float("inf"))
    return t.select("feature", F.when(ok, wrapped(F.col("x"))).alias("lon"), F.when(ok, F.col("y")).alias("lat"))


def polygons_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Polygons and MultiPolygons of a file -> (feature, part, properties as text, rings), as covers and layers take
    them. Any other geometry raises, as do rings of fewer than four positions."""
    t = _features(spark, path)
    kind = F.col("kind")
    parts = F.when(kind == "Polygon", F.array(F.from_json("c", "array<array<array<double>>>"))).when(kind == "MultiPolygon", F.from_json("c", "array<array<array<array<double>>>>"))
    wrong = F.raise_error(F.concat(F.lit("not a polygon: "), F.coalesce(kind, F.lit("nothing")))).cast("array<array<array<array<double>>>>")
    t = t.select("feature", "properties", F.posexplode(F.coalesce(parts, wrong)).alias("part", "rings"))
    sound = (F.size("rings") > 0) & F.forall("rings", lambda r: F.size(r) >= 4)
    return t.select("feature", "part", "properties", F.when(sound, F.col("rings")).otherwise(F.raise_error(F.lit("a ring has four positions at least")).cast("array<array<array<double>>>")).alias("rings"))


def invalid_points(points: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """One row: how many points there are, and how many have no place."""
    return points.agg(F.count("*").alias("n"), F.count_if(F.col(lon).isNull() | F.col(lat).isNull()).alias("n_invalid"))


def cell_features(cells: DataFrame, cell: str = "cell", ring: str = "ring", more: list[str] | None = None) -> DataFrame:
    """Cells with a closed ring (array of [lon, lat]) -> one GeoJSON feature a row, as text; addresses as strings. The
    columns named in more become properties too (operators.layers.export_rows has the usual ones)."""
    c = F.col(cell)
    props = F.struct(to_compact(c).alias("id"), to_path(c).alias("path"), unsigned(c).alias("addr64"), level_of(c).alias("level"), *(more or []))
    return cells.select(F.to_json(F.struct(F.lit("Feature").alias("type"), props.alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"))).alias("value"))
