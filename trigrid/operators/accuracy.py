"""How well covers fit their shapes, the level that fits well enough, and what a cover will cost before it is made."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import shape_of
from ..solid import EARTH_KM, MAX_LEVEL
from .outlines import areas_km2
from .shapes import cover


def mean_cell_km2(level: int) -> float:
    return 4 * math.pi * EARTH_KM**2 / (20 * 4**level)


def cover_accuracy(shapes: DataFrame, level: int, keys: tuple[str, ...], mode: str = "intersects") -> DataFrame:
    """(keys, n_cells, shape_km2, cover_km2, accuracy): a shape's area over its cover's. Polygons of one key add up."""
    own = areas_km2(shapes).groupBy(*keys).agg(F.sum("area_km2").alias("shape_km2"))
    cells = cover(shapes, level, keys, mode).withColumn("_km2", shape_of("cell")["area_km2"])
    made = cells.groupBy(*keys).agg(F.count("*").alias("n_cells"), F.sum("_km2").alias("cover_km2"))
    return own.join(made, list(keys), "left").select(*keys, F.coalesce("n_cells", F.lit(0)).alias("n_cells"), "shape_km2", "cover_km2", (F.col("shape_km2") / F.col("cover_km2")).alias("accuracy"))


def choose_level(shapes: DataFrame, keys: tuple[str, ...], least: float = 0.95, first: int = 0, last: int = 16) -> DataFrame:
    """(keys, level, n_cells, accuracy): the coarsest level from `first` on whose cover is that accurate, `last` for
    shapes that never are. Each round covers only the shapes that are not done yet."""
    left, done = shapes, None
    for level in range(first, last + 1):
        t = cover_accuracy(left, level, keys).withColumn("level", F.lit(level))
        ok = t if level == last else t.where(F.col("accuracy") >= least)
        ok = ok.select(*keys, "level", "n_cells", "accuracy").persist()
        done = ok if done is None else done.unionByName(ok)
        if level < last:
            left = left.join(ok.select(*keys), list(keys), "left_anti")
            if left.isEmpty():
                break
    return done


def estimate_cells(shapes: DataFrame, level: int) -> DataFrame:
    """Shapes with about how many cells of the level they will take: their area, and half a cell for each edge's length
    along the boundary, from the outline alone."""
    if not 0 <= level <= MAX_LEVEL:
        raise ValueError("a level lies in 0..27")
    one = mean_cell_km2(level)
    return areas_km2(shapes, name="_km2").withColumn("estimated_cells", F.ceil(F.col("_km2") / F.lit(one)) + F.ceil(4 * F.sqrt(F.col("_km2") / F.lit(one)))).drop("_km2")


def guarded(shapes: DataFrame, level: int, most: int) -> DataFrame:
    """The shapes, if a cover at the level will take about `most` cells at most; else an error that says so."""
    n = estimate_cells(shapes, level).agg(F.sum("estimated_cells")).first()[0] or 0
    if n > most:
        raise ValueError(f"the cover would take about {n} cells, more than {most}: choose a coarser level")
    return shapes
