"""Points and shapes made from keys, the same on every run and machine."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..solid import EARTH_KM


def chance(*keys) -> Column:
    """A number in (0, 1) from a hash of the keys."""
    h = F.substring(F.md5(F.concat_ws(":", *[F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("~")) for k in keys])), 1, 13)
    return (F.conv(h, 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def sphere_points(keys: DataFrame, key: str, seed: int = 1) -> DataFrame:
    """keys with lon, lat spread evenly over the sphere's area."""
    z = 2 * chance(F.col(key), F.lit(seed), F.lit("lat")) - 1
    return keys.withColumns({"lon": 360 * chance(F.col(key), F.lit(seed), F.lit("lon")) - 180, "lat": F.degrees(F.asin(z))})


def _around(lon: np.ndarray, lat: np.ndarray, km: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places at a distance and bearing (radians) from others; longitudes stay near the first one's."""
    a, b, d = np.radians(lon), np.radians(lat), km / EARTH_KM
    y = np.arcsin(np.clip(np.sin(b) * np.cos(d) + np.cos(b) * np.sin(d) * np.cos(turn), -1, 1))
    x = a + np.arctan2(np.sin(turn) * np.sin(d) * np.cos(b), np.cos(d) - np.sin(b) * np.sin(y))
    return np.degrees(x), np.degrees(y)


def circles(centres: DataFrame, keys: list[str], lon: str = "lon", lat: str = "lat", km: str = "km", corners: int = 96, rough: float = 0.0) -> DataFrame:
    """(keys, rings): circles of that many corners; with rough, stars whose corners lie nearer by up to that share, by
    a hash of key and corner. Places at which a pole lies inside are best taken apart by hand."""

    @F.pandas_udf("array<array<array<double>>>")
    def ring(x: pd.Series, y: pd.Series, r: pd.Series, u: pd.Series) -> pd.Series:
        turn = 2 * np.pi * np.arange(corners) / corners
        out = []
        for a, b, d, c in zip(x, y, r, u, strict=True):
            p = np.stack(_around(np.full(corners, a), np.full(corners, b), d * (1 - rough * np.asarray(c)), -turn), 1)
            out.append([np.concatenate([p, p[:1]]).tolist()])
        return pd.Series(out)

    u = F.array(*[chance(*keys, F.lit(i)) for i in range(corners)]) if rough else F.array_repeat(F.lit(0.0), corners)
    return centres.select(*keys, ring(F.col(lon).cast("double"), F.col(lat).cast("double"), F.col(km).cast("double"), u).alias("rings"))
