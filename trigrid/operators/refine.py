"""Refinement: border cells carry the parts of shapes inside them, as rings on a grid of 65,536 steps over the cell's box,
and decide points exactly that a share can only guess."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import parts, triangles
from ..functions.rings import rings
from .shapes import Shape, clipped, share

STEPS = 65535
#: The corners of a part that is the whole box.
WHOLE = [[0, 0], [0, STEPS], [STEPS, 0], [STEPS, STEPS]]


def boxes(cells: np.ndarray) -> np.ndarray:
    """Cells -> (west, south, east, north) around each, a hundredth wider than its ring; longitudes may run across 180."""
    out = np.zeros((len(cells), 4))
    level = parts(cells)[1]
    for n in np.unique(level):
        i = np.flatnonzero(level == n)
        for k, (x, y, _) in zip(i, rings(triangles(cells[i]), int(n)), strict=True):
            w, h = (x.max() - x.min()) / 100, (y.max() - y.min()) / 100
            out[k] = x.min() - w, y.min() - h, x.max() + w, y.max() + h
    return out


def parts_in(shape: Shape, box: np.ndarray) -> list[list[list[int]]]:
    """A polygon's rings inside a box, on the box's grid; next to nothing gives none."""
    west, south, east, north = box
    low, size = np.array([west, south]), np.array([east - west, north - south])
    corners = np.array([[west, south], [east, south], [east, north], [west, north]])
    out = []
    for turn in (-360.0, 0.0, 360.0):
        u = corners + (turn, 0)
        if (u[0] > shape.box[2:]).any() or (u[2] < shape.box[:2]).any():
            continue
        for ring in shape.rings:
            p = clipped(ring, u)
            q = np.rint((p - (turn, 0) - low) / size * STEPS).astype(int) if len(p) else np.zeros((0, 2), int)
            q = q[(q != np.roll(q, 1, 0)).any(1)] if len(q) else q
            if len(q) >= 3:
                out.append(q.tolist())
    return out


def refinement(cells: DataFrame, shapes: DataFrame, key: str, exact: bool = False) -> DataFrame:
    """(cell, key) pairs with the shapes (key, rings) -> (cell, key, share, parts), a row for each polygon that comes into
    the cell's box; share: the planar share of the cell; parts null: all of it. Pairs without a shape give no rows. With
    exact, the polygon's own rings come along, which decide the points that the grid's steps cannot."""
    t = cells.select("cell", key).distinct().join(shapes.select(key, "rings"), key)
    schema = T.StructType([t.schema["cell"], t.schema[key], T.StructField("share", T.DoubleType()), T.StructField("parts", T.ArrayType(T.ArrayType(T.ArrayType(T.IntegerType())))), *([t.schema["rings"]] if exact else [])])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cells = b["cell"].to_numpy(np.int64)
            own = [Shape(r) for r in b["rings"]]
            shared = [share(s, t) for s, t in zip(own, triangles(cells), strict=True)]
            inner = [parts_in(s, x) for s, x in zip(own, boxes(cells), strict=True)]
            t = pd.DataFrame({"cell": cells, key: b[key].to_numpy(), "share": shared, "parts": inner})
            t["parts"] = [None if len(p) == 1 and sorted(p[0]) == WHOLE else p for p in inner]
            if exact:
                t["rings"] = b["rings"].to_numpy()
            yield t[[bool(p) for p in inner]]

    return t.mapInPandas(run, schema)


def _even_odd(x: float, y: float, rings) -> bool:
    inside = False
    for ring in rings:
        p = np.array([list(q) for q in ring], float)
        q = np.roll(p, -1, 0)
        up = (p[:, 1] > y) != (q[:, 1] > y)
        a, b = p[up], q[up]
        inside ^= bool((x < a[:, 0] + (y - a[:, 1]) / (b[:, 1] - a[:, 1]) * (b[:, 0] - a[:, 0])).sum() % 2)
    return inside


def _close(x: float, y: float, rings) -> bool:
    """Whether a point is within a step and a half of an edge, which rounding to the grid can move past it."""
    for ring in rings:
        p = np.array([list(q) for q in ring], float)
        d, to = np.roll(p, -1, 0) - p, np.array([x, y]) - p
        along = np.clip((to * d).sum(1) / np.maximum((d * d).sum(1), 1), 0, 1)
        if (((to - along[:, None] * d) ** 2).sum(1) <= 1.5**2).any():
            return True
    return False


def refined(points: DataFrame, zones: DataFrame, key: str, lon: str = "lon", lat: str = "lat", cell: str = "cell") -> DataFrame:
    """points (lon, lat, cell) with covered (the cell is refined) and the key of its smallest zone that holds the
    point, null where none does. Ties of area go to the smaller key. Each row of points comes back once; its columns
    named like the new ones give way. Null places or cells are in no zone. Where zones have rings, these decide points
    next to an edge of a part."""
    exact = "rings" in zones.columns
    z = zones.groupBy(F.col("cell").alias("_z")).agg(F.array_sort(F.collect_list(F.struct("share", F.col(key).alias("key"), "parts", *(["rings"] if exact else [])))).alias("_zones"))

    @F.pandas_udf("int")
    def first(x: pd.Series, y: pd.Series, c: pd.Series, inner: pd.Series, own: pd.Series) -> pd.Series:
        on = inner.notna().to_numpy()
        box = np.zeros((len(c), 4))
        box[on] = boxes(c[on].to_numpy(np.int64))
        at = []
        for lon, lat, (west, south, east, north), zs, polygons in zip(x, y, box, inner, own, strict=True):
            hit = None
            if zs is not None:
                real = lon
                lon += 360 * np.round(((west + east) / 2 - lon) / 360)
                gx, gy = (lon - west) / (east - west) * STEPS, (lat - south) / (north - south) * STEPS
                for k, rings in enumerate(json.loads(zs)):
                    if rings is not None and polygons is not None and _close(gx, gy, rings):
                        held = Shape(json.loads(polygons)[k]).has_turned(np.array([real]), np.array([lat]))[0]
                    else:
                        held = rings is None or _even_odd(gx, gy, rings)
                    if held:
                        hit = k
                        break
            at.append(hit)
        return pd.Series(pd.array(at, "Int32"))

    own = [c for c in points.columns if c.lower() not in ("covered", key.lower())]
    t = points.select(*[F.col(f"`{c}`") for c in own]).join(z, F.col(cell) == F.col("_z"), "left")
    t = t.withColumn("_at", first(F.col(lon).cast("double"), F.col(lat).cast("double"), F.col(cell), F.to_json(F.col("_zones")["parts"]), F.to_json(F.col("_zones")["rings"]) if exact else F.lit(None).cast("string")))  # as text: workers crash on batches of nested nulls
    return t.select(*[F.col(f"`{c}`") for c in own], F.col("_z").isNotNull().alias("covered"), F.get("_zones", F.col("_at"))["key"].alias(key))
