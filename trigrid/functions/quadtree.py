"""A quadtree of longitude and latitude.

Its cells are addresses of face 0 whose digits are the bits of y and x in turn, so the hierarchy algebra, intervals,
joins and compaction of the triangular grid work on them as they are.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import address as A


def _spread(c: Column) -> Column:
    """Bits 0..26 to the even places."""
    for s, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        c = c.bitwiseOR(F.shiftleft(c, s)).bitwiseAND(F.lit(mask))
    return c


def quad_of(lon, lat, level: int) -> Column:
    """(x, y, cell) of a point; the eastern and northern edges belong to the last cells; null out of range."""
    lon, lat = (F.col(c) if isinstance(c, str) else c for c in (lon, lat))
    n = 1 << level
    x = F.least(F.floor((lon + 180) / F.lit(360) * F.lit(n)), F.lit(n - 1)).cast("long")
    y = F.least(F.floor((lat + 90) / F.lit(180) * F.lit(n)), F.lit(n - 1)).cast("long")
    cell = A.from_index(_spread(x).bitwiseOR(F.shiftleft(_spread(y), 1)), level)
    return F.when((F.abs(lon) <= 180) & (F.abs(lat) <= 90), F.struct(x.alias("x"), y.alias("y"), cell.alias("cell")))


def quad_box(x: Column, y: Column, level: Column) -> Column:
    """(west, south, east, north) of a quadtree cell."""
    w, h = F.lit(360.0) / F.pow(F.lit(2.0), level), F.lit(180.0) / F.pow(F.lit(2.0), level)
    return F.struct((x * w - 180).alias("west"), (y * h - 90).alias("south"), ((x + 1) * w - 180).alias("east"), ((y + 1) * h - 90).alias("north"))
