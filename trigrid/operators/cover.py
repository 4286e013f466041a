"""Covers: which cells of a level meet a box, for many boxes in one job, and compaction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import address as A
from ..functions.geometry import centre, triangles


def grid(spark, level: int, face: int | None = None) -> DataFrame:
    """All cells of a level as a scan without data."""
    n = 4**level
    lo, hi = (0, 20 * n) if face is None else (face * n, (face + 1) * n)
    return spark.range(lo, hi).select(A.from_index("id", level).alias("cell"), F.shiftright("id", 2 * level).cast("int").alias("face"))


#: The level at which the cells of a cover are dealt.
DEALT_AT = 3


def centroid_cover(boxes: DataFrame, level: int, keys: tuple[str, ...]) -> DataFrame:
    """boxes (keys, west, south, east, north; west > east crosses 180) -> (keys, cell) whose centres lie in the box.

    The tree is descended a level a round, for all boxes at once; a cell is dropped when the box is further away than
    the cell's radius reaches. After a few levels the cells are dealt over the cluster, so one box is many tasks.
    """
    t = boxes.withColumn("cell", F.explode(F.array(*[A.from_index(F.lit(f), 0) for f in range(20)])))
    deal = int(boxes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [*keys, "west", "south", "east", "north"]
    schema = t.select(*names, "cell").schema

    def step(last: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                tri = triangles(b["cell"].to_numpy(np.int64))
                lon, lat = centre(tri)
                w, s, e, n = (b[c].to_numpy(float) for c in ("west", "south", "east", "north"))
                wide = np.where(w <= e, e - w, e - w + 360)
                if last:
                    keep = ((lon - w) % 360 <= wide) & (lat >= s) & (lat <= n)
                else:
                    m = tri.sum(1)
                    m /= np.linalg.norm(m, axis=1, keepdims=True)
                    reach = np.degrees(np.arccos(np.clip((tri * m[:, None, :]).sum(2).min(1), -1, 1))) + 1e-9
                    top = np.minimum(90, np.maximum(np.abs(lat - reach), np.abs(lat + reach)))
                    side = np.where(top >= 90 - 1e-9, 180.0, np.degrees(np.arcsin(np.minimum(1, np.sin(np.radians(reach)) / np.maximum(1e-12, np.cos(np.radians(lat)))))))
                    off = (lon - w) % 360
                    keep = (lat + reach >= s) & (lat - reach <= n) & ((off <= wide) | (off - wide <= side) | (360 - off <= side))
                yield b[keep]

        return run

    for k in range(level + 1):
        t = t.select(*names, "cell").mapInPandas(step(k == level), schema)
        if k == min(DEALT_AT, level - 1):
            t = t.repartition(deal, *keys, "cell")  # a number, so that few bytes don't make few tasks
        if k < level:
            t = t.select(*names, F.explode(A.children("cell")).alias("cell"))
    return t.select(*keys, "cell")


def compact(cells: DataFrame, cell: str = "cell", keys: tuple[str, ...] = (), top: int = 0, bottom: int | None = None) -> DataFrame:
    """Four complete siblings become their parent, level by level from the finest up; level 0 cells stay."""
    t = cells.select(*keys, F.col(cell).alias("cell")).distinct()
    bottom = bottom if bottom is not None else (t.agg(F.max(A.level_of("cell"))).first()[0] or 0)
    done = None
    for n in range(bottom, top, -1):
        at = t.where(A.level_of("cell") == n)
        rest = t.where(A.level_of("cell") < n)
        sib = at.groupBy(*keys, A.up("cell", n - 1).alias("up")).agg(F.count("*").alias("n"), F.collect_list("cell").alias("four"))
        stay = sib.where("n < 4").select(*keys, F.explode("four").alias("cell"))
        done = stay if done is None else done.unionByName(stay)
        t = rest.unionByName(sib.where("n = 4").select(*keys, F.col("up").alias("cell")))
    return t if done is None else done.unionByName(t)
