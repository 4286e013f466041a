"""Rhombi and their triangles, dissolved groups, cells of the cube, refinement, the command line."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from trigrid.__main__ import answer, parsed
from trigrid.functions import cube
from trigrid.functions import geometry as G
from trigrid.functions.rhombi import decode, pair, rhombus_parts
from trigrid.operators import dissolve, refine, shapes


def every(level):
    i = np.arange(20 * 4**level, dtype=np.uint64)
    return (i << np.uint64(59 - 2 * level) | np.uint64(level)).view(np.int64)


def test_rhombi():
    rng = np.random.default_rng(3)
    for level in (0, 1, 2, 4, 9, 27):
        a = every(level) if level < 5 else G.locate(rng.uniform(-180, 180, 500), rng.uniform(-90, 90, 500), level)
        r = G.rhombus(a)
        diamond, n, x, y = decode(r["key"])
        assert (diamond == r["diamond"]).all() and (n == level).all() and (x == r["x"]).all() and (y == r["y"]).all()
        both = pair(r["key"])
        assert (both[np.arange(len(a)), r["orientation"]] == a).all()
    for wrong in (10 << 59, 28, 1 << 5, -1):
        with pytest.raises(ValueError):
            decode(np.array([wrong]))


def test_rhombus_column(spark):
    key = int(G.rhombus(every(2)[5:6])["key"][0])
    t = spark.createDataFrame([(key,), (None,)], "k long").select(rhombus_parts("k").alias("r")).collect()
    assert int(every(2)[5]) in t[0]["r"]["cells"] and t[1]["r"] is None


def test_dissolve(spark):
    a = every(3)
    tri = G.triangles(a)
    rows = [(int(c), float(k), "" if i % 3 else "vertex", bool(i % 2)) for i, (c, k) in enumerate(zip(a, G.area_km2(tri)))]
    t = spark.createDataFrame([*rows, (None, 1.0, "", True)], "cell long, area double, pole string, interior boolean")
    r = dissolve.by_rhombus(t, interior="interior", area="area", pole="pole").collect()
    assert len(r) == len(a) // 2 and all(x["n_cells"] == 2 and len(x["rings"]) == 1 and len(x["rings"][0]) == 5 for x in r)
    assert abs(sum(x["area"] for x in r) - G.area_km2(tri).sum()) < 1e-3
    h = dissolve.by_hex(t).collect()
    assert sum(x["n_cells"] for x in h) == len(a)
    for x in h:
        assert len(x["rings"]) == 1 and x["rings"][0][0][1] == pytest.approx(x["rings"][0][-1][1])
        assert x["interior"] is None and x["area"] is None and x["pole"] is None
        # a whole group has as many edges as cells, but for the open fan at a vertex of one face
        assert x["n_cells"] in (1, 3, 5, 6) and len(x["rings"][0]) - 1 in (x["n_cells"], x["n_cells"] + 2)
    assert dissolve.by_hex(t.where("cell IS NULL")).count() == 0


def test_cube(spark):
    assert int(cube.locate_quad(np.array([0.0]), np.array([0.0]), 30)[0]) == 0x1000000000000001
    rng = np.random.default_rng(5)
    lon, lat = rng.uniform(-180, 180, 3000), np.degrees(np.arcsin(rng.uniform(-1, 1, 3000)))
    for level in (0, 1, 5, 13, 30):
        c = cube.locate_quad(lon, lat, level)
        assert (cube.locate_quad(*cube.middle(c), level) == c).all()
    # neighbours along the curve lie next to each other
    i = np.arange(6 * 4**4, dtype=np.uint64)
    c = ((i << np.uint64(1) | np.uint64(1)) << np.uint64(2 * 26)).view(np.int64)
    p = G.unit(*cube.middle(c))
    assert np.linalg.norm(np.diff(p, axis=0), axis=1).max() < 4 * np.pi / 2 / 2**4
    assert len(np.unique(cube.locate_quad(*cube.middle(c), 4))) == len(c)
    t = spark.createDataFrame([(float(x), float(y)) for x, y in zip(lon, lat)], "lon double, lat double")
    q = t.select(cube.quad_cell_of("lon", "lat", 17).alias("c"), cube.quad_cell_of("lon", "lat", 4).alias("p"))
    q = q.select(cube.quad_level("c").alias("n"), (cube.quad_up("c", 4) == F.col("p")).alias("up"), F.col("c").between(cube.quad_span("p")["lo"], cube.quad_span("p")["hi"]).alias("span"), cube.quad_up("p", 9).isNull().alias("none"))
    assert [tuple(r) for r in q.distinct().collect()] == [(17, True, True, True)]
    assert spark.createDataFrame([(None, 0.0), (181.0, 0.0)], "lon double, lat double").select(cube.quad_cell_of("lon", "lat", 3).alias("c")).where("c IS NOT NULL").count() == 0


def test_refinement(spark):
    own = {
        1: [[[-5.0, 50.0], [5.0, 50.0], [5.0, 55.0], [-5.0, 55.0], [-5.0, 50.0]], [[-1.0, 52.0], [1.0, 52.0], [1.0, 53.0], [-1.0, 53.0], [-1.0, 52.0]]],
        2: [[[178.0, -20.0], [-178.0, -20.0], [-178.0, -16.0], [178.0, -16.0], [178.0, -20.0]]],
        3: [[[-180.0, 86.0], [-90.0, 86.0], [0.0, 86.0], [90.0, 86.0], [180.0, 86.0], [180.0, 90.0], [90.0, 90.0], [0.0, 90.0], [-90.0, 90.0], [-180.0, 90.0], [-180.0, 86.0]]],
    }
    s = spark.createDataFrame(list(own.items()), "k int, rings array<array<array<double>>>")
    rng = np.random.default_rng(7)
    xy = np.concatenate([np.stack([rng.uniform(a, b, 300), rng.uniform(c, d, 300)], 1) for a, b, c, d in ((-7, 7, 48, 57), (176, 180, -22, -14), (-180, -176, -22, -14), (-180, 180, 84, 90))])
    p = spark.createDataFrame([(float(x), float(y)) for x, y in xy], "lon double, lat double").withColumn("cell", G.cell_of("lon", "lat", 5))
    z = refine.refinement(shapes.cover(s, 5, ("k",)), s, "k")
    got = {(r["lon"], r["lat"]): r["k"] for r in refine.refined(p, z, "k").collect()}
    assert len(got) == len(xy)
    want = np.zeros(len(xy), int)
    for k, rings in own.items():
        want[shapes.Shape(rings).has_turned(*xy.T)] = k
    off = [tuple(q) for q, w in zip(xy.tolist(), want) if (got[tuple(q)] or 0) != w]
    assert len(off) <= 2, off  # a step of the cell's grid may decide a point on the boundary otherwise
    empty = refine.refined(p, z.limit(0), "k")
    assert empty.where("covered OR k IS NOT NULL").count() == 0 and empty.count() == len(xy)


def test_command_line(spark, tmp_path):
    run = lambda *a: [json.loads(x) for x in answer(spark, parsed(list(a)))]
    cell = run("locate", "13.4", "52.5", "9")[0]
    assert cell["level"] == 9 and run("show", cell["id"]) == [cell] == run("show", cell["path"]) == run("show", cell["addr64"])
    up = run("parent", cell["path"])[0]
    assert cell in run("children", up["id"])
    assert run("geom", cell["id"])[0]["geometry"]["type"] == "Polygon"
    for bad in (["locate", "200", "0", "3"], ["show", "nonsense"]):
        with pytest.raises(Exception, match="longitudes|not an address"):
            run(*bad)
    (tmp_path / "p.csv").write_text("lon,lat\n13.4,52.5\nx,1\n")
    run("file", str(tmp_path / "p.csv"), str(tmp_path / "out"), "9")
    assert sorted((r["cell"] for r in spark.read.parquet(str(tmp_path / "out")).collect()), key=str)[-1] is None


def test_refinement_next_to_edges(spark):
    """Points nearer to an edge than a step of a part's grid are decided by the polygon itself."""
    ring = [[[-10.0, 40.0], [0.0, 40.017], [10.0, 40.0], [10.0, 50.0], [-10.0, 50.0], [-10.0, 40.0]]]
    t = spark.createDataFrame([(1, ring)], "k int, rings array<array<array<double>>>")
    x = np.linspace(-9.9, 9.9, 150)
    y = 40.017 - 0.0017 * np.abs(x) + np.tile([-3e-6, -1e-7, 1e-7], 50)
    p = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "lon double, lat double").withColumn("cell", G.cell_of("lon", "lat", 5))
    zones = refine.refinement(shapes.cover(t, 5, ("k",)), t, "k", exact=True)
    got = {(r["lon"], r["lat"]) for r in refine.refined(p, zones, "k").where("k = 1").collect()}
    want = {(float(a), float(b)) for a, b, v in zip(x, y, shapes.Shape(ring).has_turned(x, y), strict=True) if v}
    assert got == want and len(want) == 50
