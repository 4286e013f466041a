"""The Mollweide projection, and classes of a raster carried over to cells."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trigrid.functions.projection import RADIUS_M, from_mollweide, lonlat_of, mollweide, mollweide_of
from trigrid.operators import raster


def test_mollweide(spark):
    rng = np.random.default_rng(2)
    lon, lat = rng.uniform(-180, 180, 1000), rng.uniform(-89.9, 89.9, 1000)
    x, y = mollweide(lon, lat)
    back = from_mollweide(x, y)
    assert np.abs(back[0] - lon).max() < 1e-6 and np.abs(back[1] - lat).max() < 1e-6
    assert mollweide(np.array([180.0]), np.array([0.0]))[0][0] == pytest.approx(2 * 2**0.5 * RADIUS_M)
    assert mollweide(np.array([7.0]), np.array([90.0]))[1][0] == pytest.approx(2**0.5 * RADIUS_M)
    assert np.isnan(from_mollweide(np.array([1.9e7]), np.array([0.0]))[0][0])
    # equal areas: a small box anywhere keeps its area
    for at in (0.0, 30.0, 60.0):
        a, b = mollweide(np.array([10.0, 10.01, 10.0]), np.array([at, at, at + 0.01]))
        got = abs((a[1] - a[0]) * (b[2] - b[0]) - (a[2] - a[0]) * (b[1] - b[0]))
        want = np.radians(0.01) * (np.sin(np.radians(at + 0.01)) - np.sin(np.radians(at))) * RADIUS_M**2
        assert got == pytest.approx(want, rel=1e-3)
    t = spark.createDataFrame([(10.0, 50.0), (None, 1.0)], "lon double, lat double").select(mollweide_of("lon", "lat").alias("m")).select(lonlat_of("m.x", "m.y").alias("p"))
    r = [x["p"] for x in t.collect()]
    assert r[0]["lon"] == pytest.approx(10) and r[0]["lat"] == pytest.approx(50)


def test_transferred(spark):
    rows = [(1, 11, 0.5), (1, 255, 0.5), (2, 12, 0.4), (2, 13, 0.4), (2, 10, 0.2), (3, 30, 1.0), (4, None, 1.0), (4, 11, 1e-12), (5, 10, 0.3), (5, 10, 0.3), (5, 11, 0.4), (6, 11, None)]
    t = spark.createDataFrame(rows, "cell long, code int, share double")
    got = {r["cell"]: tuple(r)[1:] for r in raster.transferred(t).collect()}
    assert got == {1: (11, 0.5, True, False, True), 2: (13, 0.4, True, True, False), 3: (30, 1.0, False, False, False), 4: (255, 1.0, False, False, False), 5: (10, 0.6, True, True, False)}
    assert raster.transferred(t.where("cell > 9")).count() == 0


def test_pixels(spark):
    size, codes = 10.0, {}
    for r in range(6, 10):
        for c in range(16, 24):
            codes[r, c] = 11 if (r + c) % 3 else 30
    t = spark.createDataFrame([(r, c, k) for (r, c), k in codes.items()], "row int, col int, code int")
    runs = raster.merged_rows(t)
    assert runs.agg(F.sum("width")).first()[0] == len(codes) and runs.count() < len(codes)
    shares = raster.class_shares(raster.pixel_shapes(t, size), 3)
    total = {r["cell"]: r["s"] for r in shares.groupBy("cell").agg(F.sum("share").alias("s")).collect()}
    assert max(total.values()) < 1 + 1e-6 and sum(abs(v - 1) < 1e-6 for v in total.values()) > 10
    assert raster.transferred(shares).count() == len(total)
