"""Classes of a raster carried over to cells: by the area that each class has of a cell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shapes
from .zones import NO_DATA

#: Less of a cell than this is nothing.
TINY = 1e-10
WATER = 10


def pixel_shapes(pixels: DataFrame, size: float) -> DataFrame:
    """Pixels (row, col, code) of a raster of `size` degrees from (-180, 90) down -> (code, rings). Null codes are no data."""
    west, north = F.col("col") * F.lit(size) - 180, F.lit(90.0) - F.col("row") * F.lit(size)
    return pixels.select(F.coalesce("code", F.lit(NO_DATA)).cast("int").alias("code"), shapes.box_rings(west, north - size, west + size, north).alias("rings"))


def merged_rows(pixels: DataFrame) -> DataFrame:
    """Pixels (row, col, code) -> runs (row, col, width, code) of equal codes along rows, so that fewer shapes are cut."""
    from pyspark.sql import Window

    p = pixels.select("row", "col", F.coalesce("code", F.lit(NO_DATA)).cast("int").alias("code"))
    place = F.col("col") - F.row_number().over(Window.partitionBy("row", "code").orderBy("col"))
    return p.withColumn("_run", place).groupBy("row", "code", "_run").agg(F.min("col").alias("col"), F.count("*").alias("width")).select("row", "col", "width", "code")


def class_shares(classes: DataFrame, level: int) -> DataFrame:
    """Shapes (code, rings) -> (cell, code, share) of the cells of a level that they meet."""
    keyed = classes.withColumn("_of", F.xxhash64(F.to_json("rings")))
    cells = shapes.cover(keyed, level, ("code", "_of"))
    return shapes.shares(cells, keyed, ("code", "_of")).groupBy("cell", "code").agg(F.sum("share").alias("share")).where(F.col("share") > TINY)


def transferred(shares: DataFrame) -> DataFrame:
    """(cell, code, share) -> (cell, code, share, mixed, water_mix, nodata_mix), one row a cell.

    The class with the largest share wins; of equal ones, any before no data, then the higher code. mixed: more than one
    class; water_mix: water and land; nodata_mix: no data and something else. Null codes are no data, null shares none.
    """
    s = shares.select("cell", F.coalesce("code", F.lit(NO_DATA)).alias("code"), "share").where(F.col("share") > TINY)
    s = s.groupBy("cell", "code").agg(F.sum("share").alias("share"))
    water, none = F.col("code") == WATER, F.col("code") == NO_DATA
    g = s.groupBy("cell").agg(
        F.max(F.struct("share", (~none).alias("known"), "code")).alias("top"),
        F.count("*").alias("n"),
        F.bool_or(water).alias("w"),
        F.bool_or(none).alias("z"),
        F.bool_or(~water & ~none).alias("l"),
    )
    return g.select("cell", F.col("top.code").alias("code"), F.least(F.lit(1.0), "top.share").alias("share"), (F.col("n") > 1).alias("mixed"), (F.col("w") & F.col("l")).alias("water_mix"), (F.col("z") & (F.col("w") | F.col("l"))).alias("nodata_mix"))
