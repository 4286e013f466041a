"""Registered queries over generated points and shapes, other solids, table functions and live forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import address as A
from ..functions import octa, tables
from ..functions.geometry import cell_of
from ..operators import generate, layers, zones
from ..streaming import merged_sketches, once, cell_sketches, sessions
from . import twins
from .queries import COMPACT, M, PATH, POINTS, UP, _read, _runs, _runs_sql, event_points, measures, query

HASHED = lambda what: f"((CAST('0x' || substr(md5(concat_ws(':', event_id::VARCHAR, '1', '{what}')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE)"


@query(f"SELECT event_id, round(360 * {HASHED('lon')} - 180, 9) AS lon, round(degrees(asin(2 * {HASHED('lat')} - 1)), 9) AS lat FROM events")
def sphere_points(spark, d) -> DataFrame:
    """A place for each event, spread evenly over the sphere."""
    t = generate.sphere_points(_read(spark, d, "events").select("event_id"), "event_id")
    return t.select("event_id", F.round("lon", 9).alias("lon"), F.round("lat", 9).alias("lat"))


@query(f"WITH RECURSIVE {twins.located(POINTS, 'event_id', 8, solid='octa')} SELECT event_id, ['N0', 'N1', 'N2', 'N3', 'S0', 'S1', 'S2', 'S3'][(cell >> 59)::INT + 1] || substr({PATH('cell')}, 4) AS name FROM located")
def octa_cells(spark, d) -> DataFrame:
    """Each event's cell of level 8 on the octahedron."""
    return event_points(spark, d).select("event_id", octa.octa_name(octa.octa_cell_of("lon", "lat", 8)).alias("name"))


@query(f"""WITH RECURSIVE {M}, {twins.cornered(f'SELECT DISTINCT {UP(5)} AS cell FROM m')}, t AS (SELECT *, {twins.EDGES}, {twins.CENTRE} FROM cornered)
SELECT {COMPACT('cell')} AS id, {PATH('cell')} AS path, cell::VARCHAR AS addr64, (cell >> 59)::INT AS face, 5 AS level, {UP(4)}::VARCHAR AS parent, round(lon, 6) AS lon, round(lat, 6) AS lat, round({twins.AREA}, 6) AS area_km2, round({twins.EDGE}, 6) AS edge_km FROM t""")
def cell_facts(spark, d) -> DataFrame:
    t = tables.cell_info(measures(spark, d).select(A.up("cell", 5).alias("cell")).distinct())
    return t.select("id", "path", "addr64", "face", "level", "parent", *[F.round(c, 6).alias(c) for c in ("lon", "lat", "area_km2", "edge_km")])


@query("SELECT face::INT AS face, count(*) AS n, 2 AS level FROM range(20) f(face), range(16) i(i) GROUP BY 1")
def cells_at_function(spark, d) -> DataFrame:
    """A level's cells by the table function, from SQL."""
    tables.register(spark)
    t = spark.sql("SELECT cell FROM cells_at(2, CAST(NULL AS INT))")
    return t.groupBy(A.face_of("cell").alias("face"), A.level_of("cell").alias("level")).agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE {M}, {twins.rhombi(f'SELECT DISTINCT {UP(6)} AS cell FROM m')}, {twins.hexes(f'SELECT DISTINCT {UP(6)} AS cell FROM m')}, {twins.cornered(f'SELECT DISTINCT {UP(6)} AS cell FROM m')}, e AS (SELECT *, {twins.EDGES} FROM cornered)
SELECT {COMPACT('e.cell')} AS id, {PATH('e.cell')} AS path, e.cell::VARCHAR AS addr64, printf('R%02d-%02d-%d-%d', diamond, r.level, x, y) AS rhombus_id, key AS rhombus_hilbert, hex AS hex_id, 6 AS level, ((e.cell >> 47) & 3) = 3 AS interior, round({twins.EDGE}, 5) AS edge_km, round({twins.AREA}, 3) AS area_km2
FROM e JOIN rhombi r ON e.cell = r.cell JOIN hexes h ON e.cell = h.cell""")
def grid_export(spark, d) -> DataFrame:
    """Level-6 cells as rows of a grid product, with the keys that enrich a feature."""
    t = measures(spark, d).select(A.up("cell", 6).alias("cell")).distinct().withColumn("kind", F.when(A.digit_at("cell", 6) == 3, "interior").otherwise("mixed"))
    return layers.export_rows(t).select("id", "path", "addr64", "rhombus_id", "rhombus_hilbert", "hex_id", "level", "interior", F.round("edge_km", 5).alias("edge_km"), F.round("area_km2", 3).alias("area_km2"))


@query(f"""WITH {M}, z AS ({_runs_sql()}), j AS (SELECT o, k, state FROM m LEFT JOIN z ON (cell >> 47)::BIGINT >= start AND (cell >> 47)::BIGINT < stop),
b AS (SELECT o // 64 AS part, sha256(string_agg(coalesce(state::VARCHAR, ''), chr(10) ORDER BY o, k, coalesce(state::VARCHAR, ''))) AS digest, count(*) AS n FROM j GROUP BY 1)
SELECT sum(n)::BIGINT AS n, sha256(string_agg(digest, chr(10) ORDER BY part)) AS signature FROM b""")
def ordered_signature(spark, d) -> DataFrame:
    """One digest of all answers in the order of their keys: digests of stretches of keys, then one of these."""
    t = zones.lookup(measures(spark, d), _runs(spark, d), A.index_at("cell", 6))
    return zones.ordered_signature(t, "o", ["o", "k"], "state", 64)


@query(f"WITH z AS ({_runs_sql()}), s AS (SELECT *, lag(stop) OVER (ORDER BY start) AS before FROM z) SELECT count(*) AS n_runs, count_if(before > start OR start >= stop) AS n_wrong FROM s")
def layer_soundness(spark, d) -> DataFrame:
    """Runs of the layer, and those that overlap another or are empty."""
    r = _runs(spark, d)
    wrong = layers.overlapping(r).agg(F.count("*").alias("n_wrong")).withColumn("_one", F.lit(1))
    return r.agg(F.count("*").alias("n_runs")).withColumn("_one", F.lit(1)).join(wrong, "_one").drop("_one")


@query("""WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 6 * 3600000000 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS nth FROM g)
SELECT user_id, epoch_us(min(ts)) AS from_us, epoch_us(max(ts)) + 6 * 3600000000 AS to_us, count(*) AS n FROM s GROUP BY user_id, nth""")
def user_sessions(spark, d) -> DataFrame:
    t = sessions(event_points(spark, d), "user_id", gap="6 hours")
    since = lambda c: F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{c}`)")
    return t.select("user_id", since("start").alias("from_us"), since("end").alias("to_us"), "n")


@query("SELECT count(DISTINCT (user_id, event_type)) AS n FROM events")
def repeats_dropped(spark, d) -> DataFrame:
    return once(event_points(spark, d), ["user_id", "event_type"]).agg(F.count("*").alias("n"))


@query()
def distinct_users_by_cell(spark, d) -> DataFrame:
    """About how many users each face saw, from sketches by level-4 cell."""
    return merged_sketches(cell_sketches(event_points(spark, d), "user_id"), 0).select(A.face_of("cell").alias("face"), "n")


@query(f"""WITH RECURSIVE {twins.located(POINTS, 'event_id', 6)} SELECT (cell >> 59)::INT AS face, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM located JOIN events USING (event_id) GROUP BY 1, 2""")
def users_by_face(spark, d) -> DataFrame:
    """Events and different users of each kind on each face: a spatial join with distinct counts."""
    t = event_points(spark, d).withColumn("face", A.face_of(cell_of("lon", "lat", 6)))
    return t.groupBy("face", "event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))
