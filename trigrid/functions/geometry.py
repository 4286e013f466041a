"""Geometry kernels over numpy batches, and the Arrow functions that run them."""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..solid import DIAMONDS, EARTH_KM, EPS, FACES, MAX_LEVEL, face_triangles


def unit(lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    a, b = np.radians(lon), np.radians(lat)
    return np.stack([np.cos(b) * np.cos(a), np.cos(b) * np.sin(a), np.sin(b)], 1)


def lonlat(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.degrees(np.arctan2(p[..., 1], p[..., 0])), np.degrees(np.arcsin(np.clip(p[..., 2], -1, 1)))


def _side(a: np.ndarray, b: np.ndarray, p: np.ndarray) -> np.ndarray:
    """How far p lies to the left of the edge a -> b: its part along the edge's normal."""
    return np.einsum("ij,ij->i", np.cross(a, b), p)


def _middle(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    m = a + b
    return m / np.sqrt((m * m).sum(-1, keepdims=True))


def _margins(corners: list[tuple[np.ndarray, ...]], p: np.ndarray) -> np.ndarray:
    """Points x triangles: how far inside the nearest edge each point is."""
    return np.stack([np.minimum(np.minimum(_side(a, b, p), _side(b, c, p)), _side(c, a, p)) for a, b, c in corners], 1)


def _choose(margin: np.ndarray) -> np.ndarray:
    """The first triangle that holds the point within the tolerance; failing that, the one it is least outside of."""
    inside = margin >= -EPS
    return np.where(inside.any(1), inside.argmax(1), margin.argmax(1))


#: Points that are located together: as many as stay in a processor's cache.
LOT = 4096


def locate(lon: np.ndarray, lat: np.ndarray, level: int, by_sign: bool = False) -> np.ndarray:
    """Signed 64-bit addresses. Shared edges go to the first cell in order; deterministic. With by_sign, points within
    the tolerance of a cell's inner edge go to the side that their place computes to, as in the SQL twins."""
    p = unit(np.asarray(lon, float), np.asarray(lat, float))
    out = [_locate(p[k : k + LOT], level, by_sign=by_sign) for k in range(0, len(p), LOT)]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _locate(p: np.ndarray, level: int, solid: np.ndarray | None = None, by_sign: bool = False) -> np.ndarray:
    """Points on the sphere -> addresses on the faces of a solid, by default the usual one."""
    tri = face_triangles() if solid is None else solid
    normal = np.stack([np.cross(tri[:, i], tri[:, (i + 1) % 3]) for i in range(3)], 1)
    depth = (p @ normal.reshape(-1, 3).T).reshape(len(p), len(tri), 3).min(2)
    inside = depth >= -EPS
    face = np.where(inside.any(1), inside.argmax(1), (p @ tri.mean(1).T).argmax(1))
    close = np.abs(depth).min(1) < 1e-12
    q = np.ascontiguousarray(p.T)
    corner = np.ascontiguousarray(tri[face].transpose(1, 2, 0))  # corners x coordinates x points
    path = np.zeros(len(p), np.int64)
    nxt = np.array([1, 2, 0])
    for _ in range(level):
        mid = corner + corner[nxt]  # ab, bc, ca
        mid /= np.sqrt((mid * mid).sum(1))[:, None]
        # a point well inside its cell is told apart by the three inner edges alone: child k keeps corner k, and its
        # inner edge runs from the middle after that corner to the one before it
        to = mid[[2, 0, 1]]
        cut = (mid[:, 1] * to[:, 2] - mid[:, 2] * to[:, 1]) * q[0]
        cut += (mid[:, 2] * to[:, 0] - mid[:, 0] * to[:, 2]) * q[1]
        cut += (mid[:, 0] * to[:, 1] - mid[:, 1] * to[:, 0]) * q[2]
        out = cut > 0
        d = np.where(out[0], 0, np.where(out[1], 1, np.where(out[2], 2, 3)))
        near = (np.abs(cut) < 1e-12).any(0)
        close |= near
        if close.any() and not by_sign:  # near an edge, the tolerance and the order of the children decide
            i = np.flatnonzero(close)
            (x, y, z), (xy, yz, zx) = corner[:, :, i].transpose(0, 2, 1), mid[:, :, i].transpose(0, 2, 1)
            d[i] = _choose(_margins([(x, xy, zx), (xy, y, yz), (zx, yz, z), (xy, yz, zx)], p[i]))
        path = path << 2 | d
        # corner k of child d: its own if k = d, else the middle between them; of the inner child the middle after k
        new = np.empty_like(corner)
        for k, (one, two) in enumerate(((0, 2), (1, 0), (2, 1))):  # middles at corner k: towards the next, the last
            new[k] = np.where(d == k, corner[k], np.where(d == (k + 2) % 3, mid[two], mid[one]))
        corner = new
    return (face.astype(np.uint64) << np.uint64(59) | path.astype(np.uint64) << np.uint64(59 - 2 * level) | np.uint64(level)).view(np.int64)


def parts(address: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(face, level, path) of signed addresses."""
    u = np.asarray(address, np.int64).view(np.uint64)
    level = (u & np.uint64(31)).astype(np.int64)
    path = (u >> np.uint64(5)) & np.uint64((1 << 54) - 1)
    return (u >> np.uint64(59)).astype(np.int64), level, (path >> (np.uint64(54) - 2 * level.astype(np.uint64))).astype(np.int64)


#: The level from which many finer cells are drawn: its cells' triangles are kept (1.5 MB).
DRAWN = 5


@cache
def _drawn() -> np.ndarray:
    return triangles((np.arange(20 * 4**DRAWN, dtype=np.uint64) << np.uint64(59 - 2 * DRAWN) | np.uint64(DRAWN)).view(np.int64))


def triangles(address: np.ndarray, solid: np.ndarray | None = None) -> np.ndarray:
    """Cells x corners x coordinates."""
    face, level, path = parts(address)
    begin = DRAWN if solid is None and len(level) >= LOT and level.min() > DRAWN else 0
    if begin:
        t = _drawn()[face << 2 * DRAWN | path >> 2 * (level - DRAWN)]
    else:
        t = (face_triangles() if solid is None else solid)[face]
    a, b, c = t[:, 0], t[:, 1], t[:, 2]
    for k in range(begin, int(level.max()) if len(level) else 0):
        go = (k < level)[:, None]
        d = ((path >> np.maximum(0, 2 * (level - 1 - k))) & 3)[:, None]
        ab, bc, ca = _middle(a, b), _middle(b, c), _middle(c, a)
        x, y, z = np.where(d == 0, a, np.where(d == 2, ca, ab)), np.where(d == 1, b, np.where(d == 0, ab, bc)), np.where(d == 2, c, np.where(d == 1, bc, ca))
        a, b, c = np.where(go, x, a), np.where(go, y, b), np.where(go, z, c)
    return np.stack([a, b, c], 1)


def area_km2(t: np.ndarray) -> np.ndarray:
    """By the tangent of half the spherical excess, which keeps its digits for small cells."""
    a, b, c = (t[:, i] for i in range(3))
    dot = lambda x, y: (x * y).sum(1)
    return 2 * np.arctan2(dot(np.cross(a, b), c), 1 + dot(a, b) + dot(b, c) + dot(c, a)) * EARTH_KM**2


def edge_km(t: np.ndarray) -> np.ndarray:
    arc = lambda x, y: np.arccos(np.clip((x * y).sum(1), -1, 1))
    a, b, c = t[:, 0], t[:, 1], t[:, 2]
    return (arc(a, b) + arc(b, c) + arc(c, a)) / 3 * EARTH_KM


def centre(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    m = t.sum(1)
    return lonlat(m / np.linalg.norm(m, axis=1, keepdims=True))


def lattice(address: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(face, level, cells x corners x barycentric whole numbers that add up to 2**level)."""
    face, level, path = parts(address)
    v = np.broadcast_to(np.eye(3, dtype=np.int64), (len(face), 3, 3)).copy()
    for k in range(int(level.max()) if len(level) else 0):
        go = (k < level)[:, None, None]
        d = ((path >> np.maximum(0, 2 * (level - 1 - k))) & 3)[:, None]
        a, b, c = v[:, 0], v[:, 1], v[:, 2]
        ab, bc, ca = a + b, b + c, c + a
        w = np.stack([np.where(d == 0, 2 * a, np.where(d == 2, ca, ab)), np.where(d == 1, 2 * b, np.where(d == 0, ab, bc)), np.where(d == 2, 2 * c, np.where(d == 1, bc, ca))], 1)
        v = np.where(go, w, v)
    return face, level, v


def hilbert(level: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x, y, out = x.copy(), y.copy(), np.zeros(len(x), np.int64)
    for bit in range(int(level.max()) - 1 if len(level) else -1, -1, -1):
        on = bit < level
        s = np.int64(1) << bit
        rx, ry = (x >> bit) & 1, (y >> bit) & 1
        out = np.where(on, out + s * s * ((3 * rx) ^ ry), out)
        flip = on & (ry == 0) & (rx == 1)
        x, y = np.where(flip, s - 1 - x, x), np.where(flip, s - 1 - y, y)
        swap = on & (ry == 0)
        x, y = np.where(swap, y, x), np.where(swap, x, y)
    return out


_OF_FACE = {f: (d, half, edge) for d, (one, two, edge) in enumerate(DIAMONDS) for half, f in ((0, one), (1, two))}


def rhombus(address: np.ndarray) -> dict[str, np.ndarray]:
    """diamond, level, x, y, orientation and the Hilbert key that two triangles share."""
    face, level, v = lattice(address)
    diamond = np.array([_OF_FACE[f][0] for f in range(20)])[face]
    half = np.array([_OF_FACE[f][1] for f in range(20)])[face]
    corner = np.array([[FACES[f].index(e) for e in _OF_FACE[f][2]] for f in range(20)])[face]
    px, py = (np.take_along_axis(v, corner[:, None, i : i + 1], 2)[:, :, 0] for i in (0, 1))
    size = (np.int64(1) << level)[:, None]
    h = half[:, None] == 1
    px, py = np.where(h, size - py, px), np.where(h, size - px, py)
    x, y = px.min(1), py.min(1)
    at_corner = ((px == x[:, None]) & (py == y[:, None])).any(1)
    key = diamond << 59 | hilbert(level, x, y) << (2 * (MAX_LEVEL - level) + 5) | level
    return {"diamond": diamond, "level": level, "x": x, "y": y, "orientation": (~at_corner).astype(np.int64), "key": key}


def hex_parts(address: np.ndarray) -> dict[str, np.ndarray]:
    """Of each triangle the corner of colour 0, which its group goes by: how many barycentric numbers of it are not 0
    (`on`), the vertices of the solid that these belong to in ascending order, and the numbers themselves."""
    face, level, v = lattice(address)
    at = ((v[:, :, 1] + 2 * v[:, :, 2]) % 3 == 0).argmax(1)
    b = v[np.arange(len(v)), at]
    vertex = np.where(b > 0, np.array(FACES)[face], 99)
    order = np.argsort(vertex, axis=1)
    low, high = (np.take_along_axis(vertex, order[:, k : k + 1], 1)[:, 0] for k in (0, 1))
    part = np.take_along_axis(b, order[:, 1:2], 1)[:, 0]
    return {"on": (b > 0).sum(1), "face": face, "level": level, "low": low, "high": high, "part": part, "b0": b[:, 0], "b1": b[:, 1], "b2": b[:, 2]}


def cell_of(lon, lat, level: int, by_sign: bool = False):
    """Column of addresses of points at a level, as `locate`; null for null, non-finite or out-of-range points."""

    @F.pandas_udf("bigint")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        a, b = x.to_numpy(float, na_value=np.nan), y.to_numpy(float, na_value=np.nan)
        ok = (np.abs(a) <= 180) & (np.abs(b) <= 90)
        out = pd.array(np.zeros(len(a), np.int64), dtype="Int64")
        out[:] = locate(np.where(ok, a, 0), np.where(ok, b, 0), level, by_sign)
        out[~ok] = pd.NA
        return pd.Series(out)

    return run(lon, lat)


def _arrow(kind: str, f):
    """A Column function over addresses; the Arrow function is made when it is used, as that takes a session."""

    def use(a):
        return F.pandas_udf(f, kind)(a)

    return use


def _rhombus(a: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(rhombus(a.to_numpy(np.int64)))


def _hex(a: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(hex_parts(a.to_numpy(np.int64)))


def _shape(a: pd.Series) -> pd.DataFrame:
    t = triangles(a.to_numpy(np.int64))
    lon, lat = centre(t)
    return pd.DataFrame({"lon": lon, "lat": lat, "area_km2": area_km2(t), "edge_km": edge_km(t)})


rhombus_of = _arrow("struct<diamond:int,level:int,x:bigint,y:bigint,orientation:int,key:bigint>", _rhombus)
_hex_of = _arrow("struct<on:int,face:int,level:int,low:int,high:int,part:bigint,b0:bigint,b1:bigint,b2:bigint>", _hex)


def hex_of(a):
    """The name of a triangle's hexagonal group: by the vertex of the solid, the edge or the face that its centre is
    on, so that all faces that meet there say the same."""
    h = _hex_of(a)
    on = lambda n, f, *c: F.when(h["on"] == n, F.format_string(f, *[h[k] for k in c]))
    return F.coalesce(on(1, "HV%02d-%02d", "low", "level"), on(2, "HE%02d%02d-%02d-%d", "low", "high", "level", "part"), on(3, "HF%02d-%02d-%d-%d-%d", "face", "level", "b0", "b1", "b2"))
shape_of = _arrow("struct<lon:double,lat:double,area_km2:double,edge_km:double>", _shape)
