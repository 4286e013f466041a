"""Streaming forms: addresses are stateless, so they work on a stream as they are; here is what keeps state, and lookups
of live points in a layer. All of it takes tables too."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.address import up
from ..functions.geometry import cell_of
from ..operators.lines import EARTH_KM
from ..operators.zones import lookup


def _late(points: DataFrame, ts: str, late: str) -> DataFrame:
    return points.withWatermark(ts, late) if points.isStreaming else points


def cell_counts(points: DataFrame, ts: str = "ts", lon: str = "lon", lat: str = "lat", value: str | None = None, level: int = 9, roll: int = 6, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes", by_sign: bool = False) -> DataFrame:
    """Counts (and sums) by window and cell, for streams (with a watermark) and tables alike."""
    t = _late(points, ts, late).withColumn("cell", up(cell_of(F.col(lon), F.col(lat), level, by_sign), roll))
    g = t.groupBy(F.window(ts, width, slide) if slide else F.window(ts, width), "cell")
    return g.agg(F.count("*").alias("n"), *([F.sum(value).alias("total")] if value else []))


def zone_lookup(points: DataFrame, layer: DataFrame, key: Column, mixed: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """Live points with the zone of their cell: each batch is joined with the layer as it is, without state."""
    return lookup(points, layer, key, mixed, threshold)


def sessions(points: DataFrame, by: str, ts: str = "ts", gap: str = "30 minutes", level: int = 9, lon: str = "lon", lat: str = "lat", late: str = "10 minutes") -> DataFrame:
    """Visits: what each key does without a pause of `gap`, with its length, points and about how many cells."""
    t = _late(points, ts, late).withColumn("cell", cell_of(F.col(lon), F.col(lat), level))
    g = t.groupBy(F.session_window(ts, gap).alias("session"), by).agg(F.count("*").alias("n"), F.approx_count_distinct("cell", 0.01).alias("cells"))
    return g.select(by, "session.start", "session.end", "n", "cells")


def once(points: DataFrame, keys: list[str], ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Points without repeats of the keys; on a stream, repeats within the watermark."""
    return points.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys) if points.isStreaming else points.dropDuplicates(keys)


def cell_sketches(points: DataFrame, what: str, level: int = 9, roll: int = 4, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """(cell, sketch): about how many different values each cell saw, as a sketch that merges up the hierarchy."""
    t = points.select(up(cell_of(F.col(lon), F.col(lat), level), roll).alias("cell"), F.col(what).alias("_w"))
    return t.groupBy("cell").agg(F.hll_sketch_agg("_w").alias("sketch"))


def merged_sketches(sketches: DataFrame, level: int) -> DataFrame:
    """(cell, n): sketches of cells merged into their ancestors at a level."""
    g = sketches.groupBy(up("cell", level).alias("cell")).agg(F.hll_union_agg("sketch").alias("sketch"))
    return g.select("cell", F.hll_sketch_estimate("sketch").alias("n"))


def live_segments(points: DataFrame, by: str, ts: str = "ts", lon: str = "lon", lat: str = "lat", late: str = "10 minutes") -> DataFrame:
    """Each key's path as it grows: (key, from_ts, to_ts, lon, lat, lon2, lat2, km) between consecutive points. The state
    is a key's last point; points of a batch go by time, those before the last one seen are too late. Streams only."""
    kind = points.schema[by].dataType.simpleString()
    out = f"`{by}` {kind}, from_ts timestamp, to_ts timestamp, lon double, lat double, lon2 double, lat2 double, km double"

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        b = pd.concat(list(batches)).sort_values("_ts", kind="stable")
        if state.exists:
            at, x, y = state.get
            last = pd.Timestamp(at, unit="us")
            b = pd.concat([pd.DataFrame({"_ts": [last], "_x": [x], "_y": [y]}), b[b["_ts"] >= last]])
        if not len(b):
            return
        state.update((int(b["_ts"].iloc[-1].value // 1000), float(b["_x"].iloc[-1]), float(b["_y"].iloc[-1])))
        p, q = b.iloc[:-1], b.iloc[1:]
        u, v = (np.stack([np.cos(y) * np.cos(x), np.cos(y) * np.sin(x), np.sin(y)], 1) for x, y in ((np.radians(t["_x"].to_numpy(float)), np.radians(t["_y"].to_numpy(float))) for t in (p, q)))
        km = np.arccos(np.clip((u * v).sum(1), -1, 1)) * EARTH_KM
        yield pd.DataFrame({by: [key[0]] * len(p), "from_ts": p["_ts"].to_numpy(), "to_ts": q["_ts"].to_numpy(), "lon": p["_x"].to_numpy(), "lat": p["_y"].to_numpy(), "lon2": q["_x"].to_numpy(), "lat2": q["_y"].to_numpy(), "km": km})

    t = points.withWatermark(ts, late).select(by, F.col(ts).alias("_ts"), F.col(lon).cast("double").alias("_x"), F.col(lat).cast("double").alias("_y")).where("_x IS NOT NULL AND _y IS NOT NULL")
    return t.groupBy(by).applyInPandasWithState(run, out, "at bigint, x double, y double", "append", "NoTimeout")
