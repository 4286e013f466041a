"""The Mollweide projection, in which settlement rasters come."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

# The radius in metres, and when the forward iteration ends.
RADIUS_M = 6378137.0
ROUNDS, CLOSE = 50, 1e-13
_ROOT = 2 * np.sqrt(2) * RADIUS_M


def mollweide(lon: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Degrees -> metres."""
    want = np.pi * np.sin(np.radians(np.asarray(lat, float)))
    t = np.radians(np.asarray(lat, float)) * 2  # twice the auxiliary angle
    for _ in range(ROUNDS):
        slope = 1 + np.cos(t)
        flat = slope < 1e-12  # at the poles the angle is known
        step = np.where(flat, 0, (t + np.sin(t) - want) / np.where(flat, 1, slope))
        t = np.clip(t - step, -np.pi, np.pi)
        if not len(t) or np.abs(step).max() < CLOSE:
            break
    return _ROOT / np.pi * np.radians(np.asarray(lon, float)) * np.cos(t / 2), _ROOT / 2 * np.sin(t / 2)


def from_mollweide(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Metres -> degrees; NaN outside the ellipse."""
    with np.errstate(invalid="ignore", divide="ignore"):
        a = np.arcsin(np.asarray(y, float) * 2 / _ROOT)
        lat = np.degrees(np.arcsin((2 * a + np.sin(2 * a)) / np.pi))
        lon = np.degrees(np.pi * np.asarray(x, float) / (_ROOT * np.cos(a)))
    ok = np.isfinite(lon) & (np.abs(lon) <= 180 + 1e-9)
    return np.where(ok, np.clip(lon, -180, 180), np.nan), np.where(ok, lat, np.nan)


def _column(f, names: tuple[str, str]):
    kind = f"struct<{names[0]}:double,{names[1]}:double>"

    def use(a, b):
        def run(p: pd.Series, q: pd.Series) -> pd.DataFrame:
            return pd.DataFrame(dict(zip(names, f(p.to_numpy(float, na_value=np.nan), q.to_numpy(float, na_value=np.nan)), strict=True)))

        return F.pandas_udf(run, kind)(a, b)

    return use


#: Columns (x, y) of (lon, lat) and back; null or out-of-range input gives null or NaN in both.
mollweide_of = _column(mollweide, ("x", "y"))
lonlat_of = _column(from_mollweide, ("lon", "lat"))
