"""The nearest of a table of places to each point, by rings of cells that widen only for points that need it."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import address as A
from ..functions.geometry import cell_of, centre, triangles, unit
from ..solid import EARTH_KM
from .lines import _xyz


def _radius(level: int) -> float:
    """A bound, in radians, on how far a cell of a level reaches from its centre."""
    return 0.653 * 2.0 ** -level * 1.45


def nearest(points: DataFrame, places: DataFrame, key: str, k: int = 1, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Each point with the `k` nearest places, their key and km; ties go to the smaller key.

    Points and places are counted by cell. For each cell with points, the coarsest first, places are sought in all
    cells of the level within reach of it: whoever has k of them nearer than the reach is done, the others go on one
    level up, where the reach, that of a cell, is twice as wide. At level 0 all places are in reach. No point meets all places unless
    places are so few that they are its neighbours. Points without a position give no row.
    """
    n = places.count()
    # the level whose reach holds about three times k places if they are spread evenly
    top = max(0, min(14, int(math.log2(_radius(0) / math.sqrt(12 * k / max(n, 1)))))) if n > 12 * k else 0
    p = points.where(F.col(lon).isNotNull() & F.col(lat).isNotNull()).withColumn("_row", F.monotonically_increasing_id())
    s = places.select(F.col(key).alias("_key"), F.col(lon).cast("double").alias("_x"), F.col(lat).cast("double").alias("_y")).where("_x IS NOT NULL AND _y IS NOT NULL")
    s = s.withColumns(dict(zip(("_u", "_v", "_w"), _xyz("_x", "_y"), strict=True)))
    names = [c for c in points.columns if c not in (key, "km")]
    done = None
    left = p.withColumn("_cell", cell_of(F.col(lon), F.col(lat), top)).where("_cell IS NOT NULL").withColumns(dict(zip(("_pu", "_pv", "_pw"), _xyz(lon, lat), strict=True)))
    for level in range(top, -1, -1):
        reach = math.pi if level == 0 else _radius(level)
        at = s.withColumn("_c", cell_of("_x", "_y", level))
        # which cells with points look into which cells with places: both few, by their centres
        mine = left.select(A.up("_cell", level).alias("_mine")).distinct()
        theirs = at.select("_c").distinct()
        pairs = _within(mine, theirs, level, reach + 2 * _radius(level) if level else math.pi)
        t = left.withColumn("_mine", A.up("_cell", level)).join(pairs, "_mine").join(at, "_c")
        dot = F.col("_pu") * F.col("_u") + F.col("_pv") * F.col("_v") + F.col("_pw") * F.col("_w")
        t = t.withColumn("_far", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))))
        if k == 1:
            t = t.groupBy("_row", *names, "_cell").agg(F.min(F.struct("_far", "_key")).alias("_best")).select("_row", *names, "_cell", "_best.*", F.lit(1).alias("nth"))
        else:
            t = t.withColumn("nth", F.row_number().over(Window.partitionBy("_row").orderBy("_far", "_key"))).where(f"nth <= {k}")
        sure = t.where(F.col("_far") <= reach) if level else t
        sure = sure.persist()  # read twice, and by every level above; lost blocks are made again
        full = sure.groupBy("_row").agg(F.count("*").alias("_n")).where(f"_n >= {k}").select(F.col("_row").alias("_r"))
        found = sure.join(full, F.col("_row") == F.col("_r"), "left_semi") if level else sure
        found = found.select(*names, F.col("_key").alias(key), (F.col("_far") * EARTH_KM).alias("km"), *(["nth"] if k > 1 else []))
        done = found if done is None else done.unionByName(found)
        if level:
            left = left.join(full, F.col("_row") == F.col("_r"), "left_anti").persist()
            if left.isEmpty():
                break
    return done


def _within(mine: DataFrame, theirs: DataFrame, level: int, reach: float) -> DataFrame:
    """Pairs of cells of one level whose centres are at most `reach` apart: a descent from the faces, so that each
    cell only meets the branches that come near it."""
    schema = "_mine bigint, _c bigint"

    def step(n: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                u = np.stack(unit_of(b["_mine"].to_numpy(np.int64)), 1) if len(b) else np.zeros((0, 3))
                v = np.stack(unit_of(b["_c"].to_numpy(np.int64)), 1) if len(b) else np.zeros((0, 3))
                far = np.arccos(np.clip((u * v).sum(1), -1, 1))
                yield b[far <= reach + _radius(n)]

        return run

    # branches that hold places, at each level
    t = mine.withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(19)))).select("_mine", A.from_index("_c", 0).alias("_c"))
    t = t.join(theirs.select(A.up("_c", 0).alias("_c")).distinct(), "_c", "left_semi").select("_mine", "_c").mapInPandas(step(0), schema)
    for n in range(1, level + 1):
        t = t.select("_mine", F.explode(A.children("_c")).alias("_c")).join(theirs.select(A.up("_c", n).alias("_c")).distinct(), "_c", "left_semi")
        t = t.select("_mine", "_c").mapInPandas(step(n), schema)
    return t


def unit_of(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors of the centres of cells."""
    lon, lat = centre(triangles(cells))
    return tuple(unit(lon, lat).T)
