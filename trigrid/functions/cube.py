"""Quad cells on the six faces of a cube, numbered along a Hilbert curve as the published S2 scheme does.

An identifier is a BIGINT with the bits of face (3), the place on the curve (2 a level), a one, and zeros: so ancestors,
levels and the interval of all descendants are bit operations, and plain unsigned order follows the curve.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import lonlat, unit

LEAF = 30
# The order in which the curve visits quarters (i, j) by orientation, and how each turns it.
VISIT = np.array([[0, 1, 3, 2], [0, 3, 1, 2], [2, 3, 1, 0], [2, 1, 3, 0]])
TURN = np.array([1, 0, 0, 3])
QUARTER = np.argsort(VISIT, 1)


def _flat(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Points -> (face, u, v), u and v in [-1, 1]."""
    axis = np.abs(p).argmax(1)
    main = np.take_along_axis(p, axis[:, None], 1)[:, 0]
    face = axis + 3 * (main < 0)
    x, y, z = p.T
    with np.errstate(divide="ignore", invalid="ignore"):
        u = np.choose(face, [y / x, -x / y, -x / z, z / x, z / y, -y / z])
        v = np.choose(face, [z / x, z / y, -y / z, y / x, -x / y, -x / z])
    return face, u, v


def _solid(face: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    one = np.ones_like(u)
    sides = [(one, u, v), (-u, one, v), (-u, -v, one), (-one, -v, -u), (v, -one, -u), (v, u, -one)]
    p = np.stack([np.choose(face, [s[k] for s in sides]) for k in range(3)], 1)
    return p / np.linalg.norm(p, axis=1, keepdims=True)


def _even(u: np.ndarray) -> np.ndarray:
    """[-1, 1] -> [0, 1], so that cells are of more alike areas."""
    r = np.sqrt(1 + 3 * np.abs(u)) / 2
    return np.where(u >= 0, r, 1 - r)


def _uneven(s: np.ndarray) -> np.ndarray:
    return np.where(s >= 0.5, (4 * s * s - 1) / 3, (1 - 4 * (1 - s) ** 2) / 3)


def locate_quad(lon: np.ndarray, lat: np.ndarray, level: int) -> np.ndarray:
    """Identifiers, as signed numbers, of the cells of a level."""
    face, u, v = _flat(unit(np.asarray(lon, float), np.asarray(lat, float)))
    n = 1 << LEAF
    i, j = (np.clip(np.floor(_even(c) * n), 0, n - 1).astype(np.int64) for c in (u, v))
    way, place = face & 1, np.zeros(len(face), np.int64)
    for bit in range(LEAF - 1, LEAF - 1 - level, -1):
        d = VISIT[way, (i >> bit & 1) << 1 | j >> bit & 1]
        place = place << 2 | d
        way = way ^ TURN[d]
    low = np.uint64(2 * (LEAF - level))
    return (face.astype(np.uint64) << np.uint64(61) | (place.astype(np.uint64) << np.uint64(1) | np.uint64(1)) << low).view(np.int64)


def middle(cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lon, lat) of the middles of cells."""
    c = np.asarray(cell, np.int64).view(np.uint64)
    face = (c >> np.uint64(61)).astype(np.int64)
    lsb = c & (~c + np.uint64(1))
    level = LEAF - (np.log2(lsb.astype(float)) / 2).astype(np.int64)
    way, i, j = face & 1, np.zeros(len(c), np.int64), np.zeros(len(c), np.int64)
    for k in range(int(level.max()) if len(level) else 0):
        go = k < level
        d = (c >> np.uint64(59 - 2 * k) & np.uint64(3)).astype(np.int64)
        q = QUARTER[way, d]
        i, j = np.where(go, i << 1 | q >> 1, i), np.where(go, j << 1 | q & 1, j)
        way = np.where(go, way ^ TURN[d], way)
    size = np.exp2(level)
    return lonlat(_solid(face, _uneven((i + 0.5) / size), _uneven((j + 0.5) / size)))


def quad_cell_of(lon, lat, level: int) -> Column:
    """Column of identifiers of points at a level in 0..30; null for null, non-finite or out-of-range points."""
    if not 0 <= level <= LEAF:
        raise ValueError("a level lies in 0..30")

    @F.pandas_udf("bigint")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        a, b = x.to_numpy(float, na_value=np.nan), y.to_numpy(float, na_value=np.nan)
        ok = (np.abs(a) <= 180) & (np.abs(b) <= 90)
        out = pd.Series(locate_quad(np.where(ok, a, 0), np.where(ok, b, 0), level), dtype="Int64")
        out[~ok] = pd.NA
        return out

    return run(lon, lat)


def _lowest(cell: Column) -> Column:
    return cell.bitwiseAND(-cell)


def quad_level(cell) -> Column:
    """0 for a face to 30 for a leaf."""
    cell = F.col(cell) if isinstance(cell, str) else cell
    return (F.lit(LEAF) - F.bit_count(_lowest(cell) - 1) / 2).cast("int")


def quad_up(cell, level: int) -> Column:
    """The ancestor at a level; null if the cell is coarser than that."""
    cell = F.col(cell) if isinstance(cell, str) else cell
    low = F.lit(1 << 2 * (LEAF - level)).cast("long")
    return F.when(quad_level(cell) >= level, cell.bitwiseAND(-low).bitwiseOR(low))


def quad_span(cell) -> Column:
    """struct(lo, hi), inclusive, of the identifiers of a cell's descendants."""
    cell = F.col(cell) if isinstance(cell, str) else cell
    return F.struct((cell - (_lowest(cell) - 1)).alias("lo"), (cell + (_lowest(cell) - 1)).alias("hi"))
