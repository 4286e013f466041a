"""The same cells on an octahedron: eight faces, poles at its corners, numbered N0 to N3 and S0 to S3.

Addresses have the same bits as those of the twenty faces, with faces 0 to 7, so the hierarchy algebra holds for them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import address as A
from .geometry import _locate, LOT, area_km2, centre, edge_km, triangles, unit

# Corners by quarter of the equator, the pole last; southern faces run the other way round.
NAMES = ("N0", "N1", "N2", "N3", "S0", "S1", "S2", "S3")


def faces() -> np.ndarray:
    """Faces x corners x coordinates."""
    round_ = np.array([[1, 0, 0], [0, 1, 0], [-1, 0, 0], [0, -1, 0]], float)
    north, south = np.array([0, 0, 1.0]), np.array([0, 0, -1.0])
    on = np.roll(round_, -1, 0)
    return np.concatenate([np.stack([round_, on, np.tile(north, (4, 1))], 1), np.stack([on, round_, np.tile(south, (4, 1))], 1)])


def locate_octa(lon: np.ndarray, lat: np.ndarray, level: int) -> np.ndarray:
    p, solid = unit(np.asarray(lon, float), np.asarray(lat, float)), faces()
    return np.concatenate([np.zeros(0, np.int64), *(_locate(p[k : k + LOT], level, solid) for k in range(0, len(p), LOT))])


def octa_cell_of(lon, lat, level: int) -> Column:
    """Column of cells of points at a level; null for null, non-finite or out-of-range points."""

    @F.pandas_udf("bigint")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        a, b = x.to_numpy(float, na_value=np.nan), y.to_numpy(float, na_value=np.nan)
        ok = (np.abs(a) <= 180) & (np.abs(b) <= 90)
        out = pd.Series(locate_octa(np.where(ok, a, 0), np.where(ok, b, 0), level), dtype="Int64")
        out[~ok] = pd.NA
        return out

    return run(lon, lat)


def octa_name(cell) -> Column:
    """'N2-0123'."""
    cell = F.col(cell) if isinstance(cell, str) else cell
    return F.concat(F.element_at(F.array(*map(F.lit, NAMES)), A.face_of(cell) + 1), F.substring(A.to_path(cell), 4, 28))


def octa_shape(cell) -> Column:
    """Column (lon, lat, area_km2, edge_km) of cells."""

    @F.pandas_udf("struct<lon:double,lat:double,area_km2:double,edge_km:double>")
    def run(a: pd.Series) -> pd.DataFrame:
        t = triangles(a.to_numpy(np.int64), faces())
        lon, lat = centre(t)
        return pd.DataFrame({"lon": lon, "lat": lat, "area_km2": area_km2(t), "edge_km": edge_km(t)})

    return run(cell)
