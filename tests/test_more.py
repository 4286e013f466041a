"""Services, shapes, nearest places, layers on disk, live forms and plans."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trigrid.functions import address as A
from trigrid.functions import geometry as G
from trigrid.functions import octa, rings, sql, tables
from trigrid.functions.geometry import cell_of
from trigrid.operators import accuracy, generate, layers, lines, nearest, outlines, ranges, refine, services, shapes
from trigrid.plans.queries import QUERIES
from trigrid.sources import cell_features, invalid_points, points_geojson, polygons_geojson
from trigrid.streaming import live_segments, once, sessions, zone_lookup

SQUARE = [[0.0, 0.0], [10.0, 0.0], [10.0, 10.0], [0.0, 10.0], [0.0, 0.0]]
HOLE = [[4.0, 4.0], [4.0, 6.0], [6.0, 6.0], [6.0, 4.0], [4.0, 4.0]]


def test_equal_points_stay(spark):
    """Equal points each come back, once a key, however many polygons of the key hold them; far ones do not."""
    s = spark.createDataFrame([(1, [SQUARE, HOLE]), (1, [SQUARE, HOLE]), (2, [[[2.0, 2.0], [9.0, 2.0], [9.0, 9.0], [2.0, 9.0], [2.0, 2.0]]])], "key int, rings array<array<array<double>>>")
    points = [(3.0, 3.0)] * 5 + [(5.0, 5.0)] * 2 + [(1.0, 1.0), (50.0, 50.0), (None, 1.0)]
    p = spark.createDataFrame(points, "lon double, lat double")
    for level in (3, 8):
        got = sorted(tuple(r) for r in shapes.near_layer(p, s, level, ("key",)).select("lon", "lat", "key").collect())
        assert got == sorted([(3.0, 3.0, 1), (3.0, 3.0, 2)] * 5 + [(5.0, 5.0, 2)] * 2 + [(1.0, 1.0, 1)]), level


def _km(a, b, c, d):
    p, q = G.unit(np.array([a]), np.array([b]))[0], G.unit(np.array([c]), np.array([d]))[0]
    return math.acos(max(-1, min(1, float(p @ q)))) * 6371.0088


def test_nearest(spark):
    rng = np.random.default_rng(4)
    for level in range(7):
        a = G.locate(rng.uniform(-180, 180, 400), np.degrees(np.arcsin(rng.uniform(-1, 1, 400))), level)
        t = G.triangles(a)
        m = t.sum(1) / np.linalg.norm(t.sum(1), axis=1, keepdims=True)
        assert np.arccos((t * m[:, None]).sum(2)).max() <= nearest._radius(level), level
    xy = lambda n: list(zip(range(n), rng.uniform(-180, 180, n).tolist(), np.degrees(np.arcsin(rng.uniform(-1, 1, n))).tolist()))
    places = xy(3000)
    places = [(i, x / 8, y / 8) if i % 2 else (i, x, y) for i, x, y in places]  # half of them crowded
    points = xy(60) + [(100, 0.0, 90.0), (101, 179.99, 0.0), (102, None, 0.0)]
    p, s = spark.createDataFrame(points, "id int, lon double, lat double"), spark.createDataFrame(places, "site int, lon double, lat double")
    got = {r["id"]: r for r in nearest.nearest(p, s, "site").collect()}
    assert len(got) == 62
    far = lambda x, y: sorted((_km(x, y, a, b), i) for i, a, b in places)
    for i, x, y in points[:-1]:
        km, site = far(x, y)[0]
        assert got[i]["site"] == site and abs(got[i]["km"] - km) < 1e-3
    got = nearest.nearest(p.where("id < 5"), s, "site", k=3).collect()
    for i, x, y in points[:5]:
        assert [r["site"] for r in sorted((r for r in got if r["id"] == i), key=lambda r: r["nth"])] == [k for _, k in far(x, y)[:3]]


def test_services(spark):
    layer = spark.createDataFrame([(100, 200, 3), (300, 310, 8)], "start long, stop long, state int")
    p = spark.createDataFrame([(1, 150, None, None), (2, 250, None, None), (3, 160, None, None), (4, 161, None, None), (5, 160, True, False), (6, 305, None, None), (7, None, None, None), (8, 250, True, True)], "id int, i long, over boolean, own boolean")
    p = p.withColumns({"share": F.lit("clash"), "state": F.lit("clash")})
    mixed = spark.createDataFrame([(160, 0.25), (161, None)], "cell long, share double")
    got = {r["id"]: (r["land"], r["kind"], r["confidence"], r["land_fraction"], r["cell"] is None) for r in services.land_check(p, layer, mixed, F.col("i"), 6, "over", "own").collect()}
    assert got[1] == (True, "land", 1.0, 1.0, False) and got[2] == (False, "sea", 1.0, 0.0, True) and got[3] == (False, "coast", 0.75, 0.25, False)
    assert got[4] == (True, "coast", 0.5, None, False) and got[5] == (False, "coast", 0.99, 0.25, False) and got[8] == (True, "coast", 0.99, 0.0, False) and got[7] == (None, None, None, None, True)
    dim = spark.createDataFrame([(3, "ABC", "AB", "Abc"), (8, "XYZ", "", "Xyz")], "id int, code string, iso2 string, name string")
    calls = spark.createDataFrame([(160, 8, 0.6), (161, None, None)], "cell long, call int, share double")
    got = {r["id"]: (r["country"], r["iso2"], r["kind"], r["confidence"], r["share"]) for r in services.country_check(p, layer, calls, dim, F.col("i"), 6).collect()}
    assert got[1] == ("ABC", "AB", "country", 1.0, 1.0) and got[3] == ("XYZ", None, "border", 0.6, 0.6) and got[4] == (None, None, "border", 0.5, None) and got[2] == (None, None, "none", 1.0, 0.0) and got[6][:2] == ("XYZ", None)
    details = spark.createDataFrame([(160, 51, True, False), (161, 255, False, True)], "cell long, share int, water boolean, nodata boolean")
    got = {r["id"]: r for r in services.settlement_check(p, layer, F.col("i"), 6, details, {"source": "s"}).collect()}
    assert (got[3]["code"], got[3]["surface"], got[3]["share"], got[3]["mixed"], got[3]["nodata_mix"], got[3]["source"]) == (13, "mixed", 0.2, True, False, "s")
    assert (got[4]["surface"], got[4]["nodata_mix"], got[1]["share"], got[1]["mixed"]) == ("land", True, 1.0, False)
    assert (got[6]["code"], got[6]["surface"], got[6]["status"], got[6]["share"]) == (None, "unknown", "no_data", None) and got[2]["status"] is None
    got = {r["id"]: r for r in services.settlement_check(p, layer, F.col("i"), 6).collect()}
    assert got[3]["surface"] is None and got[3]["mixed"] is None and not got[3]["has_details"] and got[3]["code"] == 13


def test_layers_on_disk(spark, tmp_path):
    r = spark.createDataFrame([(0, 5, 1), (5, 9, 1), (5000, 5010, 2)], "start long, stop long, state int")
    core, details = layers.split(r, spark.createDataFrame([(3, 0.5), (5001, 0.9)], "cell long, share double"), 4)
    layers.save(f"{tmp_path}/x", core, details, 4, "made")
    back, some, about = layers.load(spark, f"{tmp_path}/x", [0])
    assert sorted(map(tuple, back.collect())) == [(0, 9, 1), (5000, 5010, 2)] and about["level"] == 4 and [(r["cell"], r["share"]) for r in some.collect()] == [(3, 128)]
    back.limit(1).write.mode("overwrite").parquet(f"{tmp_path}/y/core")
    layers.save(f"{tmp_path}/z", spark.createDataFrame([(0, 9, 1), (8, 10, 2), (1 << 21, 1 << 22, 1), ((1 << 21) + 5, (1 << 21) + 6, 1)], "start long, stop long, state int"), details, 4)
    with pytest.raises(ValueError, match="overlap"):
        layers.load(spark, f"{tmp_path}/z")
    a = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")
    assert layers.digest(a, ["a", "b"]).first() == layers.digest(a.orderBy(F.desc("a")), ["a", "b"]).first() != layers.digest(a.limit(1), ["a", "b"]).first()


def test_stretches(spark):
    """Merging in stretches is merging at once."""
    rng = np.random.default_rng(2)
    rows = [(int(a), int(a + n), int(k)) for a, n, k in zip(rng.integers(0, 5000, 400), rng.integers(0, 60, 400), rng.integers(0, 2, 400))] + [(10, 4000, 1)]
    df = spark.createDataFrame(rows, "lo long, hi long, k int")
    for stretch in (1, 7, 100, 1 << 30):
        got = sorted(map(tuple, ranges.merge(df, "lo", "hi", ("k",), stretch=stretch).select("k", "lo", "hi").collect()))
        want = []
        for k in (0, 1):
            for a, b, _ in sorted(r for r in rows if r[2] == k):
                if want and want[-1][0] == k and a <= want[-1][2] + 1:
                    want[-1] = (k, want[-1][1], max(b, want[-1][2]))
                else:
                    want.append((k, a, b))
        assert got == want, stretch
        spans = spark.createDataFrame([(i, i + 1, (i // 3) % 2) for i in range(100) if i % 10], "start long, stop long, s int")
        one = sorted(map(tuple, ranges.runs(spans, "start", "stop", ["s"], stretch=1 << 30).collect()))
        assert sorted(map(tuple, ranges.runs(spans, "start", "stop", ["s"], stretch=stretch).collect())) == one


def test_polygon_geojson(spark, tmp_path):
    feature = lambda kind, c, **p: {"type": "Feature", "properties": p, "geometry": {"type": kind, "coordinates": c}}
    write = lambda name, x: (tmp_path / name).write_text(json.dumps(x)) and str(tmp_path / name)
    many = write("a.json", {"type": "FeatureCollection", "features": [feature("Polygon", [SQUARE, HOLE], name="a"), feature("MultiPolygon", [[SQUARE], [HOLE]], name="b")]})
    got = polygons_geojson(spark, many).orderBy("feature", "part").collect()
    assert [(r["feature"], r["part"], len(r["rings"]), json.loads(r["properties"])["name"]) for r in got] == [(0, 0, 2, "a"), (1, 0, 1, "b"), (1, 1, 1, "b")]
    assert shapes.cover(polygons_geojson(spark, many).where("feature = 0"), 5, ("feature",)).count() > 10
    for bare in (feature("Polygon", [SQUARE]), {"type": "Polygon", "coordinates": [SQUARE]}):
        assert polygons_geojson(spark, write("b.json", bare)).first()["rings"] == [SQUARE]
    for bad in (feature("LineString", SQUARE), feature("Polygon", [SQUARE[:3]]), {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": None}]}):
        with pytest.raises(Exception):
            polygons_geojson(spark, write("c.json", bad)).collect()
    p = points_geojson(spark, write("p.json", {"type": "FeatureCollection", "features": [feature("Point", [190, 5]), feature("MultiPoint", [[180, 0], [0, 95], [1]])]}))
    assert sorted(((r["lon"], r["lat"]) for r in p.collect()), key=str) == sorted([(-170.0, 5.0), (-180.0, 0.0), (None, None), (None, None)], key=str)
    assert tuple(invalid_points(p).first()) == (4, 2)


def test_outlines(spark):
    spiky = np.array([[0, 0], [10, 0], [10, 10], [5, 10], [5.01, 40], [4.99, 10], [0, 10]], float)
    p = outlines.despiked(spiky)
    assert len(p) < len(spiky) and p[:, 1].max() == 10 and outlines.despiked(np.array([[0, 0], [10, 0], [5, 1e-4]])) is None
    line = np.stack([np.arange(50.0), 0.001 * np.sin(np.arange(50.0))], 1)
    assert len(outlines.simplified(line, 0.01)) == 2 and len(outlines.simplified(line, 0)) > 40
    square = np.array(SQUARE[:-1])
    rings_ = [square, np.array(HOLE[:-1]), square * 0.02 + 4.9, square + 30]
    got = outlines.nested(rings_)
    assert sorted(len(x) for x in got) == [1, 1, 2]
    s = spark.createDataFrame([(1, [SQUARE, HOLE]), (2, [[[0.0, 0.0], [10.0, 0.0], [5.0, 1e-5], [0.0, 0.0]]])], "key int, rings array<array<array<double>>>")
    assert [r["key"] for r in outlines.despike(s).collect()] == [1]
    assert outlines.simplify(s.where("key = 1"), 0.1).first()["rings"][0] == SQUARE
    world = [[[-180.0, -90.0], [-60.0, -90.0], [60.0, -90.0], [180.0, -90.0], [180.0, 90.0], [60.0, 90.0], [-60.0, 90.0], [-180.0, 90.0], [-180.0, -90.0]]]
    a = outlines.areas_km2(spark.createDataFrame([(1, world)], "key int, rings array<array<array<double>>>")).first()["area_km2"]
    assert abs(a / (4 * math.pi * 6371.0088**2) - 1) < 1e-9


def test_refined_features(spark):
    s = spark.createDataFrame([(7, [SQUARE, HOLE])], "key int, rings array<array<array<double>>>")
    cells = shapes.cover(s, 4, ("key",))
    z = refine.refinement(cells, s, "key")
    got = outlines.refined_features(z, "key").collect()
    assert len(got) == z.count() > 3
    # in cells' boxes, which overlap: each piece lies in the square and no hole's middle in a piece
    for r in got:
        f = json.loads(r["value"])
        assert f["properties"]["key"] == 7 and f["geometry"]["type"] == "MultiPolygon"
        for polygon in f["geometry"]["coordinates"]:
            x = np.array(polygon[0])
            assert x.min() > -0.01 and x.max() < 10.01
    assert 0 < len(outlines.refined_features(z, "key", (0, 0, 1, 1)).collect()) < len(got)


def test_accuracy(spark):
    centres = spark.createDataFrame([(1, 10.0, 50.0, 300.0), (2, 179.9, -10.0, 500.0)], "id int, lon double, lat double, km double")
    s = generate.circles(centres, ["id"])
    area = {r["id"]: r["area_km2"] for r in outlines.areas_km2(s).collect()}
    assert abs(area[1] / (math.pi * 300**2) - 1) < 0.01 and abs(area[2] / (math.pi * 500**2) - 1) < 0.01
    rough = outlines.areas_km2(generate.circles(centres, ["id"], rough=0.5)).collect()
    assert all(0.3 * area[r["id"]] < r["area_km2"] < area[r["id"]] for r in rough)
    a = {n: {r["id"]: r for r in accuracy.cover_accuracy(s, n, ("id",)).collect()} for n in (4, 7)}
    assert all(0 < a[4][i]["accuracy"] < a[7][i]["accuracy"] <= 1.0001 and abs(a[7][i]["shape_km2"] / area[i] - 1) < 1e-9 for i in (1, 2))
    chosen = {r["id"]: r for r in accuracy.choose_level(s, ("id",), 0.8, 2, 9).collect()}
    assert all(r["accuracy"] >= 0.8 and 3 < r["level"] < 9 for r in chosen.values()) and len(chosen) == 2
    n = {r["id"]: r["estimated_cells"] for r in accuracy.estimate_cells(s, 7).collect()}
    assert all(0.5 < n[i] / a[7][i]["n_cells"] < 2 for i in (1, 2))
    accuracy.guarded(s, 7, 100_000)
    with pytest.raises(ValueError, match="coarser"):
        accuracy.guarded(s, 20, 1000)
    p = generate.sphere_points(spark.range(4000), "id").collect()
    assert abs(np.mean([math.sin(math.radians(r["lat"])) for r in p])) < 0.03 and abs(np.mean([r["lon"] for r in p])) < 6


def test_octahedron(spark):
    for level in (0, 2):
        a = np.array([f << 59 | i << (59 - 2 * level) | level for f in range(8) for i in range(4**level)], np.int64)
        t = G.triangles(a, octa.faces())
        lon, lat = G.centre(t)
        assert (octa.locate_octa(lon, lat, level) == a).all()
        assert abs(G.area_km2(t).sum() / (4 * math.pi * 6371.0088**2) - 1) < 1e-12
    r = spark.range(1).select(octa.octa_cell_of(F.lit(45.0), F.lit(-80.0), 3).alias("c")).select("c", octa.octa_name("c").alias("n"), octa.octa_shape("c").alias("s")).first()
    assert r["n"].startswith("S0-") and r["s"]["lat"] < -60


def test_functions(spark):
    sql.register(spark)
    with pytest.raises(Exception, match="out of range"):
        spark.sql("SELECT cell_encode(20, '0')").collect()
    with pytest.raises(Exception, match="no parent"):
        spark.sql("SELECT cell_parent(cell_encode(3, ''))").collect()
    with pytest.raises(Exception, match="not a compact"):
        spark.sql("SELECT cell_from_compact('T9')").collect()
    assert spark.sql("SELECT cell_level(NULL) IS NULL AND cell_path(cell_encode(19, '')) = 'F19-' AND cell_parent_at(cell_encode(3, '01'), 5) IS NULL").first()[0]
    plan = spark.sql("SELECT cell_compact(cell_parent(id)) FROM range(100) WHERE cell_level(id) = 3")._jdf.queryExecution().toString()
    assert "Python" not in plan
    tables.register(spark)
    assert spark.sql("SELECT * FROM cell_info(5)").count() == 1 and spark.sql("SELECT * FROM cells_at(1, 3)").count() == 4
    with pytest.raises(Exception, match="asked for"):
        spark.range(1).select(A.located_or_raise(cell_of(F.lit(200.0), F.lit(0.0), 3))).collect()
    tri = G.triangles(np.array([0], np.int64))[0]
    ring = rings.evenly(tri, 0.75)
    step = np.degrees(np.arccos(np.clip((ring * np.roll(ring, -1, 0)).sum(1), -1, 1)))
    assert step.max() <= 0.75 + 1e-9 and np.abs(np.linalg.norm(ring, axis=1) - 1).max() < 1e-12
    f = json.loads(cell_features(layers.export_rows(spark.createDataFrame([(5, "interior")], "cell long, kind string")).withColumn("cell", F.lit(5).cast("long")), more=["rhombus_id", "hex_id", "area_km2", "interior"]).first()["value"])
    assert {"id", "path", "addr64", "level", "rhombus_id", "hex_id", "area_km2", "interior"} <= f["properties"].keys()


def test_lines(spark):
    rows = [(1, 0, 0.0, 0.0), (1, 1, 10.0, 0.0), (1, 2, 10.0, 0.0), (1, 3, 10.0, 5.0), (2, 0, 5.0, 5.0), (2, 1, 5.0, 6.0)]
    p = spark.createDataFrame(rows, "line int, seq int, lon double, lat double")
    v = lines.samples(p, "line", ["seq"], mode="vertex").orderBy("line", "segment", "step").collect()
    assert [(r["lon"], r["lat"]) for r in v] == [r[2:] for r in rows] and abs(v[3]["along_km"] - 15 * 111.195) < 0.1
    u = lines.samples(p, "line", ["seq"], 100).where("line = 1").orderBy("segment", "step").collect()
    assert len(u) == 1 + 12 + 6 and abs(u[-1]["along_km"] - v[3]["along_km"]) < 1e-6
    check = lambda t: t.withColumns({"land": F.col("lon") < 5, "kind": F.when(F.col("lon") < 2, "land").otherwise("coast"), "confidence": F.lit(0.5), "land_fraction": F.col("lon") / 10})
    s = lines.land_polyline(p, "line", ["seq"], check, 100).where("line = 1").orderBy("from_km").collect()
    assert [(r["land"], r["kind"]) for r in s] == [(True, "coast"), (False, "coast")] and abs(sum(r["fraction"] for r in s) - 1) < 1e-9 and s[0]["to_km"] == s[1]["from_km"]
    t = lines.line_totals(lines.land_polyline(p, "line", ["seq"], check, 100), "line", "land").where("line = 1").first()
    assert abs(t["with_km"] - s[0]["to_km"]) < 1e-9 and t["n_stretches"] == 2
    with pytest.raises(ValueError):
        lines.samples(p, "line", ["seq"], mode="x")


def _stream(spark, tmp_path, rows, schema):
    """The rows as a stream of one file a batch, in order."""
    for k, batch in enumerate(rows):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for f in (tmp_path / "in").glob("*.parquet"):
            import os

            if not f.name.startswith("done"):
                os.utime(f, (1_000_000 + k, 1_000_000 + k))
                f.rename(tmp_path / "in" / f"done-{k}.parquet")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def _drain(df, name, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


SCHEMA = "user string, id int, at string, lon double, lat double"


def test_live(spark, tmp_path):
    rows = [
        [("a", 1, "2024-01-01 00:00:00", 0.0, 0.0), ("a", 2, "2024-01-01 00:10:00", 1.0, 0.0), ("b", 3, "2024-01-01 00:00:00", 5.0, 5.0)],
        [("a", 2, "2024-01-01 00:10:00", 1.0, 0.0), ("a", 4, "2024-01-01 02:00:00", 2.0, 0.0)],
        [("a", 5, "2024-01-01 06:00:00", 3.0, 0.0), ("b", 6, "2024-01-01 06:00:00", 6.0, 5.0)],
        [("a", 7, "2024-01-01 00:05:00", 9.0, 9.0)],  # far too late
        [("b", 8, "2024-01-01 09:00:00", 6.0, 5.0)],
    ]
    s = _stream(spark, tmp_path, rows, SCHEMA).withColumn("ts", F.col("at").cast("timestamp"))
    got = _drain(once(s, ["id"]).select("id"), "once_", tmp_path)
    assert sorted(r["id"] for r in got) == [1, 2, 3, 4, 5, 6, 8]
    got = {(r["user"], r["start"].hour, r["n"]) for r in _drain(sessions(s, "user"), "sessions_", tmp_path)}
    assert ("a", 0, 3) in got and ("a", 2, 1) in got and ("b", 0, 1) in got  # the late row opened no visit
    got = _drain(live_segments(s, "user"), "paths_", tmp_path)
    a = sorted((r["from_ts"], r["lon"], r["lon2"]) for r in got if r["user"] == "a" and r["km"] > 0)
    assert [x[1:] for x in a] == [(0.0, 1.0), (1.0, 2.0), (2.0, 3.0)] and abs(sum(r["km"] for r in got if r["user"] == "a") - 3 * 111.195) < 0.1
    layer = spark.createDataFrame([(0, 20 * 4**3, 1)], "start long, stop long, state int")
    live = zone_lookup(s.withColumn("cell", cell_of("lon", "lat", 3)), layer, A.index_at("cell", 3)).select("id", "state")
    assert sorted(r["state"] for r in _drain(live, "zones_", tmp_path)) == [1] * 9


@pytest.mark.parametrize("name", ["zone_runs_build", "zone_diff", "index_ranges", "cover_ranges", "subtree_range_scan", "bbox_cover_cells", "points_in_shapes", "zone_lookup"])
def test_plans(spark, name):
    """No nested loop, and no order over a whole table in one task: a row a stretch at most."""
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    if name == "subtree_range_scan":
        assert "Join" not in plan
