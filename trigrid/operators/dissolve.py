"""Cells merged into rhombi or hexagonal groups: counts, sums and one outline a group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import _arrow, hex_of, lonlat, rhombus_of, triangles
from ..functions.rings import unwrapped


def outlines(cells: np.ndarray) -> list[list[tuple[float, float]]]:
    """Closed outlines of a few cells of one level that meet along whole edges, longitudes running across 180.

    An edge that two cells share goes; the others are chained by their corners, which cells name alike if they lie
    within a hundredth of an edge of each other.
    """
    p = triangles(np.unique(np.asarray(cells, np.int64))).reshape(-1, 3)
    edge = np.linalg.norm(p[0] - p[1])
    name = (np.linalg.norm(p[:, None] - p[None], axis=2) < edge / 100).argmax(1).reshape(-1, 3)
    edges = {(int(t[k]), int(t[(k + 1) % 3])) for t in name for k in range(3)}
    after: dict[int, list[int]] = {}
    for a, b in sorted(edges):
        if (b, a) not in edges:
            after.setdefault(a, []).append(b)
    out = []
    while after:
        first = at = min(after)
        ring = [first]
        while True:
            go = after[at].pop(0)
            if not after[at]:
                del after[at]
            ring.append(go)
            at = go
            if at == first:
                break
        lon, lat = lonlat(p[ring])
        out.append(list(zip(unwrapped(lon).tolist(), lat.tolist(), strict=True)))
    return out


def _outline(cells: pd.Series) -> pd.Series:
    return pd.Series([[[list(q) for q in ring] for ring in outlines(c)] for c in cells])


outlines_of = _arrow("array<array<array<double>>>", _outline)


def dissolve(cells: DataFrame, by: Column, cell: str = "cell", interior: str | None = None, area: str | None = None, pole: str | None = None) -> DataFrame:
    """Groups of cells of one level -> (key, n_cells, interior, area, pole, rings).

    interior: whether all of the group are; area: the sum; pole: the first non-empty one by cell; rings: the outlines of
    the union. A cell that comes more than once counts once in n_cells and rings, each time in area. Columns not named
    give nulls. Rows with a null cell are left out. A rhombus has two cells and a hexagonal group six at most, which
    bounds what is collected a group.
    """
    c = F.col(cell)
    some = F.when(F.col(pole) != "", F.struct(c.alias("c"), F.col(pole).alias("p"))) if pole else None
    return (
        cells.where(c.isNotNull())
        .withColumn("_key", by)
        .groupBy(F.col("_key").alias("key"))
        .agg(
            F.array_sort(F.collect_set(c)).alias("_cells"),
            (F.every(interior) if interior else F.lit(None).cast("boolean")).alias("interior"),
            (F.sum(area) if area else F.lit(None).cast("double")).alias("area"),
            (F.min(some)["p"] if pole else F.lit(None).cast("string")).alias("pole"),
        )
        .select("key", F.size("_cells").alias("n_cells"), "interior", "area", "pole", outlines_of("_cells").alias("rings"))
    )


def by_rhombus(cells: DataFrame, cell: str = "cell", **named: str) -> DataFrame:
    """Pairs of triangles; the key is the rhombus key."""
    return dissolve(cells, rhombus_of(F.col(cell))["key"], cell, **named)


def by_hex(cells: DataFrame, cell: str = "cell", **named: str) -> DataFrame:
    """Groups around one corner: six cells, three or six at an edge of the solid, one or five at its vertices."""
    return dissolve(cells, hex_of(F.col(cell)), cell, **named)
