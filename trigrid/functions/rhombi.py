"""From rhombus keys back to coordinates and to the two triangles of each."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..solid import DIAMONDS, FACES, MAX_LEVEL
from .geometry import _arrow

WRONG = "not a rhombus key"


def curve_place(level: np.ndarray, along: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(x, y) of places along the Hilbert curve of 4**level cells."""
    x, y, rest = np.zeros_like(along), np.zeros_like(along), along.copy()
    for bit in range(int(level.max()) if len(level) else 0):
        on = bit < level
        s = np.int64(1) << bit
        rx = (rest >> 1) & 1
        ry = (rest ^ rx) & 1
        flip = on & (ry == 0) & (rx == 1)
        x, y = np.where(flip, s - 1 - x, x), np.where(flip, s - 1 - y, y)
        swap = on & (ry == 0)
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        x, y = np.where(on, x + s * rx, x), np.where(on, y + s * ry, y)
        rest = rest >> 2
    return x, y


def decode(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys -> (diamond, level, x, y). A diamond or level out of range, or bits below the level, raise."""
    key = np.asarray(key, np.int64)
    level, diamond = key & 31, key >> 59
    if ((level > MAX_LEVEL) | (diamond < 0) | (diamond >= len(DIAMONDS))).any():
        raise ValueError(WRONG)
    path = (key >> 5) & ((np.int64(1) << 54) - 1)
    free = 2 * (MAX_LEVEL - level)
    if (path & ((np.int64(1) << free) - 1)).any():
        raise ValueError(WRONG)
    return diamond, level, *curve_place(level, path >> free)


def cell_at(face: np.ndarray, level: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Addresses of the cells that hold points of a face; at: barycentric whole numbers that add up to 3 * 2**level,
    on no edge of a cell."""
    whole = 3 * (np.int64(1) << level)
    u, v, w = at.T
    path = np.zeros(len(face), np.int64)
    for k in range(int(level.max()) if len(level) else 0):
        go = k < level
        d = np.select([2 * u > whole, 2 * v > whole, 2 * w > whole], [0, 1, 2], 3)
        inner = d == 3
        nu, nv, nw = (np.where(inner, whole - 2 * o, 2 * c - np.where(d == i, whole, 0)) for i, (c, o) in enumerate(((u, w), (v, u), (w, v))))
        u, v, w = np.where(go, nu, u), np.where(go, nv, v), np.where(go, nw, w)
        path = np.where(go, path << 2 | d, path)
    up = np.uint64
    return (face.astype(up) << up(59) | path.astype(up) << (59 - 2 * level).astype(up) | level.astype(up)).view(np.int64)


def pair(key: np.ndarray) -> np.ndarray:
    """Keys -> rhombi x the two cells of each, the one at the corner (x, y) first."""
    diamond, level, x, y = decode(key)
    size = np.int64(3) << level
    edge = np.array([[[FACES[f].index(e) for e in edge] for f in (one, two)] for one, two, edge in DIAMONDS])
    faces = np.array([(one, two) for one, two, _ in DIAMONDS])
    out = []
    for more in (1, 2):  # three times the middle of each triangle
        px, py = 3 * x + more, 3 * y + more
        far = (px + py > size).astype(np.int64)
        px, py = np.where(far, size - py, px), np.where(far, size - px, py)
        at = np.zeros((len(x), 3), np.int64)
        corner = edge[diamond, far]
        rows = np.arange(len(x))
        at[rows, corner[:, 0]], at[rows, corner[:, 1]] = px, py
        at[rows, 3 - corner.sum(1)] = size - px - py
        out.append(cell_at(faces[diamond, far], level, at))
    return np.stack(out, 1)


def _decoded(key: pd.Series) -> pd.DataFrame:
    a = key.to_numpy(np.int64)
    return pd.DataFrame({**dict(zip(("diamond", "level", "x", "y"), decode(a), strict=True)), "cells": list(pair(a))})


_decode = _arrow("struct<diamond:int,level:int,x:bigint,y:bigint,cells:array<bigint>>", _decoded)


def rhombus_parts(key):
    """Column of (diamond, level, x, y, cells) of rhombus keys; what is no key raises, null gives null."""
    key = F.col(key) if isinstance(key, str) else key
    return F.when(key.isNotNull(), _decode(F.coalesce(key, F.lit(0).cast("long"))))
