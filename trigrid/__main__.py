"""Command line: python -m trigrid locate LON LAT LEVEL | show, parent, children or geom ADDRESS | file IN.csv OUT LEVEL.

An address is a path, a compact address or a decimal number. Answers are JSON, a line each; `file` locates the points
of a CSV file or folder and writes Parquet.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .functions import address as A
from .functions.geometry import cell_of, hex_of, rhombus_of, shape_of
from .functions.rings import ring_of
from .sources import cell_features, points_csv


def described(c: Column) -> list[Column]:
    r, s = rhombus_of(c), shape_of(c)
    return [
        A.to_compact(c).alias("id"), A.to_path(c).alias("path"), A.unsigned(c).alias("addr64"), A.face_of(c).alias("face"), A.level_of(c).alias("level"),
        F.format_string("R%02d-%02d-%d-%d", r["diamond"], r["level"], r["x"], r["y"]).alias("rhombus_id"), r["key"].cast("string").alias("rhombus_key"), hex_of(c).alias("hex_id"),
        s["lon"].alias("lon"), s["lat"].alias("lat"), s["edge_km"].alias("edge_km"), s["area_km2"].alias("area_km2"),
    ]


def answer(spark: SparkSession, args: argparse.Namespace) -> list[str]:
    one = spark.range(1)
    if args.what == "file":
        t = points_csv(spark, args.source)
        t.withColumn("cell", cell_of(F.col("lon"), F.col("lat"), args.level)).write.parquet(args.target)
        return []
    if args.what == "locate":
        cell = one.select(cell_of(F.lit(args.lon), F.lit(args.lat), args.level).alias("c"))
        if cell.first()["c"] is None:
            raise ValueError("longitudes lie in [-180, 180], latitudes in [-90, 90]")
    else:
        cell = one.select(A.parse(F.lit(args.address)).alias("c"))
    if args.what == "parent":
        cell = cell.select(A.parent("c").alias("c"))
    if args.what == "children":
        cell = cell.select(F.explode(A.children("c")).alias("c"))
    if args.what == "geom":
        return [r["value"] for r in cell_features(cell.select(F.col("c").alias("cell"), ring_of("c", precision=6)["ring"].alias("ring"))).collect()]
    return [r[0] for r in cell.select(F.to_json(F.struct(*described(F.col("c"))))).collect()]


def parsed(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="trigrid", description=__doc__)
    sub = p.add_subparsers(dest="what", required=True)
    q = sub.add_parser("locate")
    q.add_argument("lon", type=float)
    q.add_argument("lat", type=float)
    q.add_argument("level", type=int, choices=range(28), metavar="LEVEL")
    for name in ("show", "parent", "children", "geom"):
        sub.add_parser(name).add_argument("address")
    q = sub.add_parser("file")
    q.add_argument("source")
    q.add_argument("target")
    q.add_argument("level", type=int, choices=range(28), metavar="LEVEL")
    return p.parse_args(argv)


def main(argv: list[str]) -> int:
    args = parsed(argv)
    spark = SparkSession.builder.appName("trigrid").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    try:
        print("\n".join(answer(spark, args)))
    except Exception as x:  # the message, not Spark's trace
        print(str(x).strip().splitlines()[0], file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
