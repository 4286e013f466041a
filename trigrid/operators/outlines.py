"""Outlines cleaned, simplified, nested, measured and written."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rings import unwrapped
from ..solid import EARTH_KM
from .refine import STEPS, boxes
from .shapes import area

# The sharpest corner that stays, in degrees, rounds at most, and the least area over squared diagonal.
SHARPEST, ROUNDS, THINNEST = 30.0, 60, 1e-3
RINGS = "array<array<array<double>>>"


def despiked(ring: np.ndarray, sharpest: float = SHARPEST) -> np.ndarray | None:
    """An open ring without corners sharper than that, all of a round at once; None if next to nothing is left."""
    p = ring
    for _ in range(ROUNDS):
        if len(p) < 4:
            break
        shrink = np.stack([np.cos(np.radians(p[:, 1])), np.ones(len(p))], 1)
        back, on = (np.roll(p, 1, 0) - p) * shrink, (np.roll(p, -1, 0) - p) * shrink
        long = np.linalg.norm(back, axis=1) * np.linalg.norm(on, axis=1)
        angle = np.degrees(np.arccos(np.clip((back * on).sum(1) / np.where(long > 0, long, 1), -1, 1)))
        sharp = np.where(long > 0, angle, 0) < sharpest
        if not sharp.any():
            break
        p = p[~sharp]
    if len(p):
        p = p[np.concatenate([[True], (p[1:] != p[:-1]).any(1)])]
    across = float((np.ptp(p, axis=0) ** 2).sum()) if len(p) >= 3 else 0.0
    return p if across > 0 and area(p) / across >= THINNEST else None


def simplified(line: np.ndarray, tolerance: float) -> np.ndarray:
    """The fewest corners of a line that stay within the tolerance of it, by the farthest corner of each stretch."""
    keep = np.zeros(len(line), bool)
    keep[[0, -1]] = True
    stack = [(0, len(line) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        d, q = line[b] - line[a], line[a + 1 : b] - line[a]
        long = np.hypot(*d)
        off = np.abs(d[0] * q[:, 1] - d[1] * q[:, 0]) / long if long > 0 else np.hypot(*q.T)
        k = int(off.argmax())
        if off[k] > tolerance:
            keep[a + 1 + k] = True
            stack += [(a, a + 1 + k), (a + 1 + k, b)]
    return line[keep]


def _each_ring(shapes: DataFrame, f, rings: str) -> DataFrame:
    """Shapes with f applied to the open rings; holes for which it gives None go, as do shapes whose exterior does."""

    @F.pandas_udf(RINGS)
    def run(col: pd.Series) -> pd.Series:
        out = []
        for polygon in col:
            done = [f(np.array([list(q) for q in ring], float)[:-1]) for ring in polygon] if polygon is not None and len(polygon) else [None]
            out.append(None if done[0] is None else [np.concatenate([p, p[:1]]).tolist() for p in done if p is not None])
        return pd.Series(out)

    return shapes.withColumn(rings, run(rings)).where(F.col(rings).isNotNull())


def despike(shapes: DataFrame, rings: str = "rings") -> DataFrame:
    """Shapes without spikes and slivers."""
    return _each_ring(shapes, despiked, rings)


def simplify(shapes: DataFrame, tolerance: float, rings: str = "rings") -> DataFrame:
    """Shapes with fewer corners, none of the old ones more than the tolerance (degrees) away; slivers go."""

    def f(p: np.ndarray) -> np.ndarray | None:
        far = int(np.hypot(*(p - p[0]).T).argmax())  # two halves, so that both ends of each stay
        q = np.concatenate([simplified(p[: far + 1], tolerance)[:-1], simplified(np.concatenate([p[far:], p[:1]]), tolerance)[:-1]])
        return q if len(q) >= 3 and area(q) > 0 else None

    return _each_ring(shapes, f, rings)


def geodesic_area(ring: np.ndarray) -> float:
    """km² inside a ring on the sphere, its edges taken as straight in longitude and sine of latitude."""
    x, s = np.radians(unwrapped(ring[:, 0])), np.sin(np.radians(ring[:, 1]))
    turn = np.roll(x, -1) - x
    turn -= 2 * np.pi * np.round(turn / (2 * np.pi))
    return abs(float((turn * (s + np.roll(s, -1))).sum())) / 2 * EARTH_KM**2


def areas_km2(shapes: DataFrame, rings: str = "rings", name: str = "area_km2") -> DataFrame:
    """Shapes with their area on the sphere: the exterior's less the holes'."""

    @F.pandas_udf("double")
    def run(col: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else float(sum((1 if k == 0 else -1) * geodesic_area(np.array([list(q) for q in r], float)) for k, r in enumerate(p))) for p in col])

    return shapes.withColumn(name, run(rings))


def _inside(p: np.ndarray, ring: np.ndarray) -> bool:
    a, b = ring, np.roll(ring, -1, 0)
    up = (a[:, 1] > p[1]) != (b[:, 1] > p[1])
    at = a[up, 0] + (p[1] - a[up, 1]) / (b[up, 1] - a[up, 1]) * (b[up, 0] - a[up, 0])
    return bool((p[0] < at).sum() % 2)


def nested(rings: list[np.ndarray]) -> list[list[np.ndarray]]:
    """Open rings by even and odd nesting -> polygons: an exterior with the holes right inside it."""
    order = sorted(rings, key=area, reverse=True)
    polygons: list[list[np.ndarray]] = []
    owner: list[tuple[int, np.ndarray, int | None]] = []  # depth, ring, its polygon
    for r in order:
        middle = (r[0] + r[1]) / 2
        around = [o for o in owner if _inside(middle, o[1])]
        depth = len(around)
        if depth % 2 == 0:
            polygons.append([r])
            owner.append((depth, r, len(polygons) - 1))
        else:
            parent = max(around, key=lambda o: o[0])
            polygons[parent[2]].append(r)
            owner.append((depth, r, None))
    return polygons


def refined_features(zones: DataFrame, key: str, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """A refinement (cell, key, share, parts) -> GeoJSON features (cell, key, value): each zone of a cell in degrees
    again, rings nested into polygons; with a box (west, south, east, north), those of cells that meet it."""
    schema = T.StructType([zones.schema["cell"], zones.schema[key], T.StructField("value", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            where, out, kept = boxes(b["cell"].to_numpy(np.int64)), [], []
            for k, (west, south, east, north) in enumerate(where):
                if box and not (south <= box[3] and north >= box[1] and any(west + t <= box[2] and east + t >= box[0] for t in (-360, 0, 360))):
                    continue
                whole = [[[0, 0], [STEPS, 0], [STEPS, STEPS], [0, STEPS]]]
                grid = json.loads(b["parts"].iloc[k]) if b["parts"].iloc[k] else whole
                rings = [np.array(r, float) / STEPS * (east - west, north - south) + (west, south) for r in grid]
                polygons = [[np.concatenate([r, r[:1]]).round(7).tolist() for r in p] for p in nested(rings)]
                out.append(json.dumps({"type": "Feature", "properties": {key: _plain(b[key].iloc[k]), "share": float(b["share"].iloc[k])}, "geometry": {"type": "MultiPolygon", "coordinates": polygons}}))
                kept.append(k)
            yield b.iloc[kept][["cell", key]].assign(value=out)

    return zones.select("cell", key, "share", F.to_json("parts").alias("parts")).mapInPandas(run, schema)


def _plain(x):
    return x.item() if hasattr(x, "item") else x

