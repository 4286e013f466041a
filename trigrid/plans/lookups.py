"""Registered queries over the lookup services and the lines that use them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import address as A
from ..functions.geometry import cell_of
from ..operators import lines, services
from . import twins
from .queries import COMPACT, M, _layer, _layer_sql, _mixed, _read, _runs, _runs_sql, measures, order_points, query

LEVEL = 6
#: The layer's runs and mixed cells, and each line item's index, run and mixed cell.
HIT = f"""{M}, z AS ({_runs_sql()}), x AS (SELECT start AS cell, start % 16 AS q, start AS s FROM ({_layer_sql()}) WHERE state % 2 = 1),
h AS (SELECT o, k, (m.cell >> 47)::BIGINT AS place, state, state IS NOT NULL AS hit, x.cell IS NOT NULL AND state IS NOT NULL AS mixed, x.s AS s FROM m LEFT JOIN z ON (m.cell >> 47)::BIGINT >= start AND (m.cell >> 47)::BIGINT < stop LEFT JOIN x ON (m.cell >> 47)::BIGINT = x.cell)"""
ID = COMPACT(f"((place::UBIGINT << 47) | {LEVEL}::UBIGINT)")


def _index():
    return A.index_at("cell", LEVEL)


@query(f"""WITH {HIT}, f AS (SELECT *, CASE WHEN NOT hit THEN 0.0 WHEN mixed THEN CASE WHEN s % 11 = 0 THEN NULL ELSE (s % 16 + 0.5::DOUBLE) / 16 END ELSE 1.0 END::DOUBLE AS fr FROM h)
SELECT o, k, CASE WHEN NOT hit THEN false WHEN mixed THEN coalesce(fr >= 0.5, true) ELSE true END AS land, CASE WHEN NOT hit THEN 'sea' WHEN mixed THEN 'coast' ELSE 'land' END AS kind,
CASE WHEN mixed THEN CASE WHEN fr IS NULL THEN 0.5 ELSE greatest(fr, 1 - fr) END ELSE 1.0 END::DOUBLE AS confidence, fr AS land_fraction, CASE WHEN hit THEN {ID} END AS id FROM f""")
def land_service(spark, d) -> DataFrame:
    """Land and sea at each line item's cell: some coastal cells have no share."""
    mixed = _mixed(spark, d).withColumn("share", F.when(F.col("cell") % 11 != 0, F.col("share")))
    t = services.land_check(measures(spark, d), _runs(spark, d), mixed, _index(), LEVEL)
    return t.select("o", "k", "land", "kind", "confidence", "land_fraction", F.col("cell").alias("id"))


@query(f"""WITH {HIT}, c AS (SELECT *, CASE WHEN NOT hit THEN NULL WHEN mixed THEN CASE WHEN s % 5 = 0 THEN NULL ELSE s % 25 END ELSE state END AS n, CASE WHEN NOT hit THEN 0.0 WHEN mixed THEN CASE WHEN s % 11 = 0 THEN NULL ELSE (s % 16 + 0.5::DOUBLE) / 16 END ELSE 1.0 END::DOUBLE AS sh FROM h)
SELECT o, k, n_name AS country, nullif(CASE WHEN n_nationkey % 4 = 3 THEN '' ELSE substr(n_name, 1, 2) END, '') AS iso2, CASE WHEN NOT hit THEN 'none' WHEN mixed THEN 'border' ELSE 'country' END AS kind,
CASE WHEN mixed THEN coalesce(sh, 0.5) ELSE 1.0 END::DOUBLE AS confidence, sh AS share, CASE WHEN hit THEN {ID} END AS id FROM c LEFT JOIN nation ON n = n_nationkey""")
def country_service(spark, d) -> DataFrame:
    """The country at each line item's cell: in border cells the one with most of it, or none."""
    mixed = _mixed(spark, d).select("cell", F.when(F.col("cell") % 5 != 0, F.col("cell") % 25).alias("call"), F.when(F.col("cell") % 11 != 0, F.col("share")).alias("share"))
    n = _read(spark, d, "nation")
    countries = n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("code"), F.when(F.col("n_nationkey") % 4 == 3, "").otherwise(F.substring("n_name", 1, 2)).alias("iso2"), F.col("n_name").alias("name"))
    t = services.country_check(measures(spark, d), _runs(spark, d), mixed, countries, _index(), LEVEL)
    return t.select("o", "k", "country", "iso2", "kind", "confidence", "share", F.col("cell").alias("id"))


@query(f"""WITH {HIT}, c AS (SELECT *, [10, 11, 12, 13, 21, 22, 23, 30, 255][state + 1] AS raw FROM h), e AS (SELECT *, nullif(raw, 255)::INT AS code FROM c)
SELECT o, k, code, code IN (21, 22, 23, 30) AS urban, CASE WHEN hit THEN CASE WHEN code IS NULL THEN 'no_data' ELSE 'classified' END END AS status, CASE WHEN hit THEN {ID} END AS id,
CASE WHEN NOT hit THEN NULL WHEN code IS NULL THEN 'unknown' WHEN mixed AND s % 3 = 0 THEN 'mixed' WHEN code = 10 THEN 'water' ELSE 'land' END AS surface,
CASE WHEN NOT hit OR code IS NULL THEN NULL WHEN mixed THEN (s % 256) / 255.0::DOUBLE ELSE 1.0 END::DOUBLE AS share, CASE WHEN hit THEN mixed END AS mixed, CASE WHEN hit THEN mixed AND s % 7 = 0 END AS nodata_mix FROM e""")
def settlement_service(spark, d) -> DataFrame:
    """The settlement class at each line item's cell, with what is known of boundaries."""
    details = _layer(spark, d).where("state % 2 = 1").select(F.col("start").alias("cell"), (F.col("start") % 256).cast("int").alias("share"), (F.col("start") % 3 == 0).alias("water"), (F.col("start") % 7 == 0).alias("nodata"))
    t = services.settlement_check(measures(spark, d), _runs(spark, d), _index(), LEVEL, details)
    return t.select("o", "k", "code", "urban", "status", F.col("cell").alias("id"), "surface", "share", "mixed", "nodata_mix")


@query(f"""SELECT 6 AS level, (SELECT count(*) FROM ({_runs_sql()})) AS runs, c AS cells, c - m AS interior_cells, m AS mixed_cells, true AS has_shares FROM (SELECT sum(stop - start)::BIGINT AS c FROM ({_runs_sql()})), (SELECT count(*) AS m FROM ({_layer_sql()}) WHERE state % 2 = 1)""")
def layer_summary(spark, d) -> DataFrame:
    return services.layer_stats(_runs(spark, d), _mixed(spark, d), LEVEL)


VERTICES = "SELECT o_orderkey, o_custkey, o_orderdate, ((o_orderkey * 2654435761) % 3600001) / CAST(10000 AS DOUBLE) - 180 AS lon, ((o_orderkey * 40503 + 7) % 1800001) / CAST(10000 AS DOUBLE) - 90 AS lat FROM orders"
LINE = f"""WITH RECURSIVE {twins.located(VERTICES, 'o_orderkey', LEVEL)}, {M}, z AS ({_runs_sql()}), x AS (SELECT start AS cell, (start % 16 + 0.5::DOUBLE) / 16 AS share FROM ({_layer_sql()}) WHERE state % 2 = 1),
v AS (SELECT o_custkey AS line, o_orderkey AS key, o_orderdate AS at_, lon, lat, (cell >> 47)::BIGINT AS i, lag(lon) OVER w AS plon, lag(lat) OVER w AS plat, row_number() OVER w AS nth, count(*) OVER (PARTITION BY o_custkey) AS many FROM ({VERTICES}) JOIN located USING (o_orderkey) WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
g AS (SELECT *, CASE WHEN plon IS NULL OR (lon = plon AND lat = plat) THEN 0.0 ELSE 6371.0088 * acos(greatest(-1, least(1, cos(radians(plat)) * cos(radians(plon)) * cos(radians(lat)) * cos(radians(lon)) + cos(radians(plat)) * sin(radians(plon)) * cos(radians(lat)) * sin(radians(lon)) + sin(radians(plat)) * sin(radians(lat))))) END AS own FROM v WHERE many > 1),
c AS (SELECT *, sum(own) OVER (PARTITION BY line ORDER BY nth ROWS UNBOUNDED PRECEDING) AS km FROM g),
a AS (SELECT c.*, z.state IS NOT NULL AND coalesce(x.share >= 0.5, true) AS land, CASE WHEN z.state IS NULL THEN 'sea' WHEN x.cell IS NOT NULL THEN 'coast' ELSE 'land' END AS kind, CASE WHEN z.state IS NOT NULL AND x.cell IS NOT NULL THEN greatest(x.share, 1 - x.share) ELSE 1.0 END AS confidence,
CASE WHEN z.state IS NULL THEN 0.0 WHEN x.cell IS NOT NULL THEN x.share ELSE 1.0 END AS fr FROM c LEFT JOIN z ON i >= start AND i < stop LEFT JOIN x ON i = x.cell),
s AS (SELECT *, CASE WHEN lag(land) OVER w = land THEN 0 ELSE 1 END AS fresh, lag(km) OVER w AS p, lead(km) OVER w AS q FROM a WINDOW w AS (PARTITION BY line ORDER BY nth)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY line ORDER BY nth ROWS UNBOUNDED PRECEDING) AS stretch FROM s),
t AS (SELECT line, stretch, land, min(CASE WHEN p IS NULL THEN 0 ELSE (p + km) / 2 END) AS from_km, max(CASE WHEN q IS NULL THEN km ELSE (q + km) / 2 END) AS to_km, count(*) AS n_samples, avg(confidence) AS confidence, avg(fr) AS mean_fraction, CASE WHEN min(kind) = max(kind) THEN min(kind) ELSE 'coast' END AS kind FROM r GROUP BY line, stretch, land)"""


def _land_lines(spark, d) -> DataFrame:
    def check(t: DataFrame) -> DataFrame:
        t = t.withColumn("cell", cell_of(F.col("lon"), F.col("lat"), LEVEL))
        return services.land_check(t, _runs(spark, d), _mixed(spark, d), A.index_at("cell", LEVEL), LEVEL)

    return lines.land_polyline(order_points(spark, d), "line", ["at", "key"], check, mode="vertex")


@query(f"{LINE} SELECT line, stretch::BIGINT AS stretch, land, round(from_km, 3) AS from_km, round(to_km, 3) AS to_km, n_samples, round(confidence, 6) AS confidence, round(mean_fraction, 6) AS mean_fraction, kind FROM t")
def land_lines(spark, d) -> DataFrame:
    """Stretches of land and sea along each customer's line, at its vertices."""
    t = _land_lines(spark, d)
    return t.select("line", "stretch", "land", *[F.round(c, n).alias(c) for c, n in (("from_km", 3), ("to_km", 3))], "n_samples", *[F.round(c, 6).alias(c) for c in ("confidence", "mean_fraction")], "kind")


@query(f"{LINE} SELECT line, round(max(to_km), 3) AS total_km, round(coalesce(sum(to_km - from_km) FILTER (WHERE land), 0), 3) AS land_km, count(*) AS n_stretches FROM t GROUP BY line")
def land_line_totals(spark, d) -> DataFrame:
    t = lines.line_totals(_land_lines(spark, d), "line", "land")
    return t.select("line", F.round("total_km", 3).alias("total_km"), F.round("with_km", 3).alias("land_km"), "n_stretches")
