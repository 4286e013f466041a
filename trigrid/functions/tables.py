"""Table functions: a cell's facts, the cells of a level, its children. register(spark) names them for SQL."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import address as A
from .geometry import area_km2, centre, edge_km, triangles


def cell_info(cells: DataFrame, cell: str = "cell") -> DataFrame:
    """One row a cell: identifiers, place in the hierarchy, centre and measures."""
    from .geometry import shape_of

    c = F.col(cell)
    t = cells.select(c.alias("cell"), shape_of(c).alias("s"))
    up = F.when(A.level_of("cell") > 0, A.unsigned(A.up("cell", A.level_of("cell") - 1)))
    return t.select(A.to_compact("cell").alias("id"), A.to_path("cell").alias("path"), A.unsigned("cell").alias("addr64"), A.face_of("cell").alias("face"), A.level_of("cell").alias("level"), up.alias("parent"), "s.*")


class CellInfo:
    """cell_info(address) as a table function of one row."""

    def eval(self, address: int) -> Iterator[tuple]:
        t = triangles(np.array([address], np.int64))
        lon, lat = centre(t)
        u = address % (1 << 64)
        yield u >> 59, u & 31, float(lon[0]), float(lat[0]), float(area_km2(t)[0]), float(edge_km(t)[0])


class CellsAt:
    """cells_at(level, face): the cells of a level on one face, or on all for a null."""

    def eval(self, level: int, face: int) -> Iterator[tuple]:
        if not 0 <= level <= 10:
            raise ValueError("a level lies in 0..10 here; operators.cover.grid scans any")
        for f in range(20) if face is None else (face,):
            for i in range(4**level):
                u = f << 59 | i << (59 - 2 * level) | level
                yield (u - (1 << 64) if u >> 63 else u,)


def register(spark: SparkSession) -> list[str]:
    spark.udtf.register("cell_info", F.udtf(CellInfo, returnType="face int, level int, lon double, lat double, area_km2 double, edge_km double"))
    spark.udtf.register("cells_at", F.udtf(CellsAt, returnType="cell bigint"))
    return ["cell_info", "cells_at"]
