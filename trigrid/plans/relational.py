"""Registered queries in Spark SQL: the address functions, and the relational shapes of reconciliation reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sql as functions
from .queries import B32, COMPACT, M, PATH, POINTS, UP, _read, event_points, measures, query


@query(f"""WITH {M}, c AS (SELECT DISTINCT cell FROM m) SELECT cell::VARCHAR AS cell, (cell >> 59)::INT AS face, (cell & 31)::INT AS level, {COMPACT('cell')} AS id, {PATH('cell')} AS path, true AS same,
{UP(8)}::VARCHAR AS parent, {UP(5)}::VARCHAR AS p5, ((cell | (2::UBIGINT << 39)) + 1)::VARCHAR AS child2, 4 AS n_children, (((cell >> 5) << 5) | (((1::UBIGINT << 41) - 1) & ~31::UBIGINT) | 27)::VARCHAR AS hi, true AS nested,
substr({B32}, (cell & 31)::INT + 1, 1) AS letter FROM c""")
def sql_functions(spark, d) -> DataFrame:
    """Each cell through every SQL function, from SQL."""
    functions.register(spark)
    measures(spark, d).select("cell").distinct().createOrReplaceTempView("_measured_cells")
    return spark.sql("""SELECT cell_unsigned(cell) AS cell, cell_face(cell) AS face, cell_level(cell) AS level, cell_compact(cell) AS id, cell_path(cell) AS path,
        cell_from_compact(lower(cell_compact(cell))) = cell AND cell_encode(cell_face(cell), substring(cell_path(cell), 5)) = cell AS same,
        cell_unsigned(cell_parent(cell)) AS parent, cell_unsigned(cell_parent_at(cell, 5)) AS p5, cell_unsigned(cell_child(cell, 2)) AS child2,
        size(filter(cell_children(cell), c -> c IS NOT NULL)) AS n_children, cell_unsigned(cell_descendant_hi(cell)) AS hi,
        cell_is_ancestor(cell_parent_at(cell, 3), cell) AND NOT cell_is_ancestor(cell, cell_parent(cell)) AS nested, cell_base32(cell_level(cell)) AS letter FROM _measured_cells""")


@query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_type, '^(PROMO|STANDARD|ECONOMY)') AND NOT regexp_matches(p_name, '[0-9]{3}$')")
def regex_filter(spark, d) -> DataFrame:
    return _read(spark, d, "part").where(F.col("p_type").rlike("^(PROMO|STANDARD|ECONOMY)") & ~F.col("p_name").rlike("[0-9]{3}$")).select("p_partkey", "p_name")


@query("""WITH e AS (SELECT o_orderkey, unnest(string_split(o_orderpriority || '-' || o_orderstatus || '-' || o_custkey, '-')) AS part, generate_subscripts(string_split(o_orderpriority || '-' || o_orderstatus || '-' || o_custkey, '-'), 1) AS k FROM orders)
SELECT o_orderkey, k::INT AS k, part, row_number() OVER (PARTITION BY part ORDER BY o_orderkey, k)::INT AS nth FROM e""")
def lateral_dump(spark, d) -> DataFrame:
    """Parts of a composite taken apart in a lateral view, each numbered among its like."""
    _read(spark, d, "orders").createOrReplaceTempView("_orders")
    return spark.sql("""SELECT o_orderkey, k + 1 AS k, part, row_number() OVER (PARTITION BY part ORDER BY o_orderkey, k) AS nth
        FROM _orders LATERAL VIEW posexplode(split(concat_ws('-', o_orderpriority, o_orderstatus, o_custkey), '-')) e AS k, part""")


@query("""SELECT c_nationkey AS nation, list_sort(list(DISTINCT c_mktsegment)) AS segments, count(DISTINCT c_mktsegment) AS n, string_agg(DISTINCT c_mktsegment, '/' ORDER BY c_mktsegment) AS joined FROM customer GROUP BY 1""")
def sorted_distinct_arrays(spark, d) -> DataFrame:
    g = _read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.sort_array(F.collect_set("c_mktsegment")).alias("segments"))
    return g.select("nation", "segments", F.size("segments").cast("long").alias("n"), F.array_join("segments", "/").alias("joined"))


@query("""WITH spend AS (SELECT o_custkey, sum(o_totalprice) AS total, count(*) AS n FROM orders GROUP BY 1),
classed AS (SELECT c_custkey, c_nationkey, CASE WHEN n IS NULL THEN 'none' WHEN n >= 15 THEN 'many' WHEN n >= 8 THEN 'some' ELSE 'few' END AS kind, coalesce(n, 0) AS n FROM customer LEFT JOIN spend ON c_custkey = o_custkey),
placed AS (SELECT n_name, r_name, kind, n FROM classed JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT r_name, kind, count(*) AS customers, sum(n)::BIGINT AS orders, count(DISTINCT n_name) AS nations, bool_or(n = 0) AS idle FROM placed GROUP BY 1, 2 HAVING count(*) > 1""")
def report_chain(spark, d) -> DataFrame:
    """A chain of common table expressions: aggregate, left join, CASE, joins of dimensions, HAVING."""
    for t in ("orders", "customer", "nation", "region"):
        _read(spark, d, t).createOrReplaceTempView(f"_{t}")
    return spark.sql("""WITH spend AS (SELECT o_custkey, count(*) AS n FROM _orders GROUP BY 1),
        classed AS (SELECT c_custkey, c_nationkey, CASE WHEN n IS NULL THEN 'none' WHEN n >= 15 THEN 'many' WHEN n >= 8 THEN 'some' ELSE 'few' END AS kind, coalesce(n, 0) AS n FROM _customer LEFT JOIN spend ON c_custkey = o_custkey),
        placed AS (SELECT n_name, r_name, kind, n FROM classed JOIN _nation ON c_nationkey = n_nationkey JOIN _region ON n_regionkey = r_regionkey)
        SELECT r_name, kind, count(*) AS customers, sum(n) AS orders, count(DISTINCT n_name) AS nations, bool_or(n = 0) AS idle FROM placed GROUP BY 1, 2 HAVING count(*) > 1""")


_CHECKS = [
    ("orders_key_unique", "orders", "SELECT count(*) - count(DISTINCT o_orderkey) AS bad FROM {orders}"),
    ("orders_customer_known", "orders", "SELECT count(*) AS bad FROM {orders} o LEFT JOIN {customer} c ON o_custkey = c_custkey WHERE c_custkey IS NULL"),
    ("line_quantity_positive", "lineitem", "SELECT count(*) AS bad FROM {lineitem} WHERE l_quantity IS NULL OR l_quantity <= 0"),
    ("line_discount_range", "lineitem", "SELECT count(*) AS bad FROM {lineitem} WHERE NOT (l_discount BETWEEN 0 AND 1)"),
    ("nation_region_known", "nation", "SELECT count(*) AS bad FROM {nation} LEFT JOIN {region} ON n_regionkey = r_regionkey WHERE r_regionkey IS NULL"),
]
_TABLES = ("orders", "customer", "lineitem", "nation", "region")


@query(" UNION ALL ".join(f"SELECT '{name}' AS rule, '{t}' AS of_table, bad::BIGINT AS bad, bad = 0 AS holds FROM ({q.format(**{x: x for x in _TABLES})})" for name, t, q in _CHECKS))
def constraint_checks(spark, d) -> DataFrame:
    """Rules that tables must keep, with the number of rows that break each."""
    for t in _TABLES:
        _read(spark, d, t).createOrReplaceTempView(f"_{t}")
    return spark.sql(" UNION ALL ".join(f"SELECT '{name}' AS rule, '{t}' AS of_table, bad, bad = 0 AS holds FROM ({q.format(**{x: f'_{x}' for x in _TABLES})})" for name, t, q in _CHECKS))


SITES = "SELECT s_suppkey AS site, ((s_suppkey * 2654435761 + 12345) % 3600001) / CAST(10000 AS DOUBLE) - 180 AS slon, ((s_suppkey * 40503 + 99991) % 1800001) / CAST(10000 AS DOUBLE) - 90 AS slat FROM supplier"


def sites(spark, d) -> DataFrame:
    return _read(spark, d, "supplier").select(F.col("s_suppkey").alias("site"), F.expr("((s_suppkey * 2654435761L + 12345L) % 3600001L) / CAST(10000 AS DOUBLE) - 180").alias("lon"), F.expr("((s_suppkey * 40503L + 99991L) % 1800001L) / CAST(10000 AS DOUBLE) - 90").alias("lat"))


@query(f"""WITH p AS ({POINTS}), s AS ({SITES}), x AS (SELECT event_id, site, cos(radians(lat)) * cos(radians(lon)) * cos(radians(slat)) * cos(radians(slon)) + cos(radians(lat)) * sin(radians(lon)) * cos(radians(slat)) * sin(radians(slon)) + sin(radians(lat)) * sin(radians(slat)) AS c FROM p, s)
SELECT event_id, arg_max(site, c) AS site, round(6371.0088 * acos(least(1, max(c))), 3) AS km FROM x GROUP BY event_id""")
def nearest_site(spark, d) -> DataFrame:
    """The nearest of the suppliers' places to each event."""
    from ..operators.nearest import nearest

    t = nearest(event_points(spark, d).select("event_id", "lon", "lat"), sites(spark, d), "site")
    return t.select("event_id", "site", F.round("km", 3).alias("km"))
