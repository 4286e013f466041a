"""Addresses, location, lattice keys, covers and layers: golden values, brute force and invariants."""

import datetime
import random

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from trigrid.functions import address as A
from trigrid.functions import geometry as G
from trigrid.operators import cover, lines, ranges, zones
from trigrid.solid import FACES, face_triangles, vertices


def cells(n, seed=42):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        level = rng.randint(0, 27)
        out.append((rng.randint(0, 19), [rng.randint(0, 3) for _ in range(level)]))
    return out


def packed(face, digits):
    path = int("".join(map(str, digits)) or "0", 4)
    u = face << 59 | path << (59 - 2 * len(digits)) | len(digits)
    return u - (1 << 64) if u >= 1 << 63 else u


def test_codecs(spark):
    rows = cells(600)
    df = spark.createDataFrame([(f, d, packed(f, d)) for f, d in rows], "f int, d array<int>, a long")
    df = df.select("*", A.to_compact("a").alias("c"), A.to_path("a").alias("p"), A.unsigned("a").alias("u"))
    got = df.select("*", A.pack("f", "d").alias("k"), A.parse("c").alias("pc"), A.parse("p").alias("pp"), A.parse("u").alias("pu"), A.digits_of("a").alias("dd"), A.face_of("a").alias("ff"), A.level_of("a").alias("l")).collect()
    for r in got:
        assert r["k"] == r["a"] == r["pc"] == r["pp"] == r["pu"]
        assert r["dd"] == r["d"] and r["ff"] == r["f"] and r["l"] == len(r["d"])
        assert r["p"] == f"F{r['f']:02d}-" + "".join(map(str, r["d"]))
        assert int(r["u"]) == r["a"] % (1 << 64)
        assert len(r["c"]) == 3 + -(-2 * len(r["d"]) // 5)


def test_forgiving_and_strict(spark):
    t = spark.createDataFrame([("f7-0123",), (" T7 ",), ("nonsense",), ("18446744073709551616",), ("18446744073709551615",), (None,), ("F20-1",), ("TLO",), ("t10",)], "s string")
    got = [r[0] for r in t.select(A.try_parse("s")).collect()]
    assert got[0] == packed(7, [0, 1, 2, 3]) and got[1:4] == [None, None, None] and got[4] == -1 and got[5:7] == [None, None]
    assert got[7] == got[8] == packed(1, [])
    with pytest.raises(Exception, match="not an address"):
        t.select(A.parse("s")).collect()


def test_hierarchy(spark):
    rows = [(f, d) for f, d in cells(300) if 0 < len(d) < 27]
    df = spark.createDataFrame([(packed(f, d), packed(f, d[:-1]), packed(f, d[: len(d) // 2])) for f, d in rows], "a long, p long, h long")
    s = A.subtree("h")
    got = df.select("*", A.parent("a").alias("up"), A.children("p").alias("ch"), A.is_ancestor("h", "a").alias("anc"), A.is_ancestor("a", "h").alias("not"), (F.col("a").between(s["lo"], s["hi"])).alias("inside"), A.up("h", 27).alias("none")).collect()
    for (f, d), r in zip(rows, got):
        assert r["up"] == r["p"] and r["ch"][d[-1]] == r["a"] and r["anc"] and r["inside"] and not r["not"]
        assert r["none"] is None
    with pytest.raises(Exception, match="level 0"):
        spark.range(1).select(A.parent(F.lit(0).cast("long"))).collect()


def one_by_one(lon, lat, level):
    """Descent by the definition, for one point."""
    p = G.unit(np.array([lon]), np.array([lat]))[0]
    inside = lambda t: all(np.dot(np.cross(t[i], t[(i + 1) % 3]), p) >= -1e-14 for i in range(3))
    v = vertices()
    face = next(f for f, t in enumerate(FACES) if inside([v[i] for i in t]))
    t, digits = [v[i] for i in FACES[face]], []
    mid = lambda a, b: (a + b) / np.linalg.norm(a + b)
    for _ in range(level):
        a, b, c = t
        ab, bc, ca = mid(a, b), mid(b, c), mid(c, a)
        four = [(a, ab, ca), (ab, b, bc), (ca, bc, c), (ab, bc, ca)]
        d = next((i for i, x in enumerate(four) if inside(x)), None)
        if d is None:
            d = int(np.argmax([min(np.dot(np.cross(x[i], x[(i + 1) % 3]), p) for i in range(3)) for x in four]))
        digits.append(d)
        t = four[d]
    return packed(face, digits)


def test_locate(spark):
    rng = np.random.default_rng(1)
    pts = [(float(x), float(np.degrees(np.arcsin(z)))) for x, z in zip(rng.uniform(-180, 180, 150), rng.uniform(-1, 1, 150))]
    pts += [(0, 90), (0, -90), (-179.9, 0), (179.9, 0), (180, 0), (-180, 0), (-0.1278, 51.5074), (24.7536, 59.4370), (139.6917, 35.6895), (-74.006, 40.7128), (151.2093, -33.8688), (0, 0)]
    pts = [(float(a), float(b)) for a, b in pts]
    tri = face_triangles()
    pts += [tuple(float(x) for x in G.lonlat(tri[3, 0])), tuple(float(x) for x in G.lonlat((tri[5, 0] + tri[5, 1]) / np.linalg.norm(tri[5, 0] + tri[5, 1])))]
    for level in (0, 1, 6, 12, 27):
        got = G.locate(np.array([p[0] for p in pts]), np.array([p[1] for p in pts]), level)
        for p, g in zip(pts, got):
            assert g == one_by_one(*p, level), (p, level)
    df = spark.createDataFrame([*pts, (None, 1.0), (1.0, None), (181.0, 0.0), (0.0, float("nan"))], "lon double, lat double")
    got = [r[0] for r in df.select(G.cell_of(F.col("lon"), F.col("lat"), 6)).collect()]
    assert got[: len(pts)] == G.locate(np.array([p[0] for p in pts]), np.array([p[1] for p in pts]), 6).tolist() and got[len(pts) :] == [None] * 4


def test_shapes(spark):
    for level in (0, 1, 3):
        a = np.array([packed(i // 4**level, [int(c) for c in np.base_repr(i % 4**level, 4).rjust(level, "0")] if level else []) for i in range(20 * 4**level)])
        t = G.triangles(a)
        assert abs(G.area_km2(t).sum() / (4 * np.pi * 6371.0088**2) - 1) < 1e-9
        lon, lat = G.centre(t)
        assert (G.locate(lon, lat, level) == a).all()
        r = G.rhombus(a)
        keys, n = np.unique(r["key"], return_counts=True)
        assert (n == 2).all() and len(keys) == 10 * 4**level
        if level:
            assert set(zip(r["x"].tolist(), r["y"].tolist())) == {(x, y) for x in range(2**level) for y in range(2**level)}
            parts = G.hex_parts(a)
            name = lambda k: ("HV" if parts["on"][k] == 1 else "HE" if parts["on"][k] == 2 else "HF") + str([parts[c][k] for c in (["low", "level"], ["low", "high", "level", "part"], ["face", "level", "b0", "b1", "b2"])[parts["on"][k] - 1]])
            ids, m = np.unique([name(k) for k in range(len(a))], return_counts=True)
            for k, c in zip(ids, m):
                assert c in {"HF": (6,), "HE": (3, 6), "HV": (1, 5)}[k[:2]], (k, c)


def test_ranges(spark):
    rng = random.Random(5)
    chosen = sorted({packed(rng.choice([2, 18]), [rng.randint(0, 1) for _ in range(rng.randint(3, 6))]) for _ in range(200)})
    got = ranges.cover_ranges(spark.createDataFrame([(c,) for c in chosen], "c long"), "c").collect()
    whole = {(g["face"], g["lo"], g["hi"]) for g in got}
    spans = sorted((c >> 59 & 31, c, (c & ~31 & -(1 << 5)) | ((1 << (59 - 2 * (c & 31))) - 1) & ~31 | 27) for c in chosen)
    for f, lo, hi in spans:
        assert sum(a <= lo and hi <= b for g, a, b in whole if g == f) == 1
    ordered = sorted(whole)
    assert all(x[0] != y[0] or y[1] > x[2] + 1 for x, y in zip(ordered, ordered[1:]))


def test_interval_join(spark):
    rng = random.Random(6)
    at, runs_ = 0, []
    for k in range(300):
        at += rng.choice([0, 0, 3, 50])
        n = rng.choice([1, 2, 7, 400])
        runs_.append((at, at + n, k % 5))
        at += n
    pts = [(i, rng.randint(-5, at + 5)) for i in range(500)] + [(9999, None)]
    p, r = spark.createDataFrame(pts, "i long, x long"), spark.createDataFrame(runs_, "start long, stop long, state int")
    j = ranges.interval_join(p, r, F.col("x"))
    got = {x["i"]: x["state"] for x in j.collect()}
    assert got == {i: next((s for a, b, s in runs_ if x is not None and a <= x < b), None) for i, x in pts}
    assert "NestedLoop" not in j._jdf.queryExecution().executedPlan().toString()
    merged = ranges.runs(r, "start", "stop", ["state"]).collect()
    assert sum(m["stop"] - m["start"] for m in merged) == sum(b - a for a, b, _ in runs_)
    other = r.withColumn("state", (F.col("state") + (F.col("start") % 2).cast("int")) % 5)
    d = {(x["old_state"], x["new_state"]): x["n_cells"] for x in zones.changes(r, other).collect()}
    want = {}
    for a, b, s in runs_:
        k = (s, (s + a % 2) % 5)
        want[k] = want.get(k, 0) + b - a
    assert d == want


def test_compaction_and_covers(spark):
    all3 = cover.grid(spark, 3)
    got = sorted(r[0] for r in cover.compact(all3).collect())
    assert got == sorted(packed(f, []) for f in range(20))
    hole = all3.where(F.col("cell") != packed(4, [0, 1, 2]))
    got = [r[0] for r in cover.compact(hole).collect()]
    assert len(got) == 19 + 9 and packed(4, [0, 1, 2]) not in got
    boxes = [(1, -0.3, 51.4, 0.1, 51.6), (2, 179.0, -1.0, -179.0, 1.0), (3, -180.0, 86.0, 180.0, 90.0), (4, -5.0, 50.0, 5.0, 55.0)]
    t = cover.centroid_cover(spark.createDataFrame(boxes, "b int, west double, south double, east double, north double"), 6, ("b",))
    got = {(r["b"], r["cell"]) for r in t.collect()}
    every = np.array([r[0] for r in cover.grid(spark, 6).select("cell").collect()])
    lon, lat = G.centre(G.triangles(every))
    want = set()
    for b, w, s, e, n in boxes:
        wide = e - w if w <= e else e - w + 360
        hit = ((lon - w) % 360 <= wide) & (lat >= s) & (lat <= n)
        want |= {(b, int(c)) for c in every[hit]}
    assert got == want


def test_lines(spark):
    pts = [(1, 0, 13.4, 52.5), (1, 1, 21.0, 52.2), (1, 2, 25.3, 54.7), (2, 0, -30.0, 40.0), (2, 1, -30.0, 40.0), (2, 2, 0.0, 40.0)]
    df = spark.createDataFrame(pts, "line int, seq int, lon double, lat double")
    seg = lines.segments(df, "line", ["seq"]).collect()
    km = {(r["line"], r["segment"]): r["km"] for r in seg}
    s = lines.samples(df, "line", ["seq"], 3.5).collect()
    for k, v in km.items():
        n = sum((r["line"], r["segment"]) == k for r in s)
        assert n == (0 if v < 1e-9 else int(np.ceil(v / 3.5)) + (k in ((1, 0), (2, 1))))
    t = spark.createDataFrame([(1, i, float(i), "ab"[i // 5 % 2], 0.5) for i in range(20)], "line int, i int, km double, a string, c double")
    got = sorted(lines.answers(t, "line", ["i"], "km", "a", "c").collect(), key=lambda r: r["stretch"])
    assert [(r["a"], r["from_km"], r["to_km"], r["n_samples"]) for r in got] == [("a", 0.0, 4.5, 5), ("b", 4.5, 9.5, 5), ("a", 9.5, 14.5, 5), ("b", 14.5, 19.0, 5)]
    assert abs(sum(r["fraction"] for r in got) - 1) < 1e-12


def test_streaming_is_batch(spark, tmp_path):
    from trigrid.streaming import cell_counts

    src = spark.range(500).select((F.col("id") % 360 - 180).cast("double").alias("lon"), (F.col("id") % 170 - 85).cast("double").alias("lat"), F.timestamp_seconds(F.col("id") * 60).alias("ts"))
    src.write.parquet(str(tmp_path / "in"))
    live = cell_counts(spark.readStream.schema(src.schema).parquet(str(tmp_path / "in")))
    q = live.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    f = lambda t: sorted(tuple(r) for r in t.select("window.start", "cell", "n").collect())
    assert f(spark.table("counts")) == f(cell_counts(src))


def test_sources(spark, tmp_path):
    from trigrid import sources

    (tmp_path / "p.csv").write_text("name,Latitude,Longitude\na,10,190\n\"b, c\",95,1\nd,x,1\ne,-5,-180\n")
    got = {r["name"]: (r["lon"], r["lat"]) for r in sources.points_csv(spark, str(tmp_path / "p.csv")).collect()}
    assert got == {"a": (-170.0, 10.0), "b, c": (None, None), "d": (None, None), "e": (-180.0, -5.0)}
    (tmp_path / "p.json").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"Point","coordinates":[1.5,2]}},{"geometry":{"type":"MultiPoint","coordinates":[[3,4],[5,6]]}},{"geometry":{"type":"LineString","coordinates":[[3,4],[5,6]]}}]}')
    got = sorted(tuple(r) for r in sources.points_geojson(spark, str(tmp_path / "p.json")).collect())
    assert got == [(0, 1.5, 2.0), (1, 3.0, 4.0), (1, 5.0, 6.0)]
    ring = spark.createDataFrame([(packed(3, [1]), [[0.0, 1.0], [2.0, 3.0], [0.0, 1.0]])], "cell long, ring array<array<double>>")
    assert '"path":"F03-1"' in sources.cell_features(ring).first()[0]


def test_hilbert_ranges_whole(spark):
    """The intervals hold all rhombi of the table's cells."""
    from trigrid.plans.queries import hilbert_ranges, rhombus_keys

    d, step = "/root/testdata/sf0.001", 1 << (2 * (27 - 9) + 5)
    want = {int(r[0]) for r in rhombus_keys(spark, d).select("rhombus").distinct().collect()}
    got = {k for r in hilbert_ranges(spark, d).collect() for k in range(r["lo"], r["hi"] + 1, step)}
    assert {k % (1 << 64) for k in got} == {k % (1 << 64) for k in want}


@pytest.mark.parametrize("name", ["locate_points", "flagship_cell_totals", "windowed_cell_counts"])
def test_poles_as_in_the_sql(spark, tmp_path, name):
    """Events at the poles, within the tolerance of cells' edges, go where the query's SQL has them."""
    from trigrid.plans import queries as Q

    day = datetime.datetime(2024, 1, 1)
    rows = [(k, day, 1, "a", float(i)) for i, k in enumerate((5, 12088, 24176, 3612090, 5410580, 7210581, 21612100, 23412101))]
    t = pa.table([list(c) for c in zip(*rows, strict=True)], names=["event_id", "ts", "user_id", "event_type", "value"])
    pq.write_table(t, str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    df = Q.QUERIES[name](spark, str(tmp_path))
    want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({Q.SQL[name]})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)
