"""Layers on disk: writing, reading with checks, the split into a core and details by face, and digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import address as A
from ..functions.rings import ring_of


def overlapping(layer: DataFrame, keys: tuple[str, ...] = (), width: int = 1 << 20) -> DataFrame:
    """Runs that overlap the one before them, or are empty: none in a sound layer. Runs are dealt by stretches of the
    index, each stretch with the runs that reach into it, so no task holds more than a stretch."""
    part = F.floor(F.col("start") / width)
    last = F.floor((F.greatest(F.col("stop") - 1, "start")) / width)
    t = layer.withColumn("_part", F.explode(F.sequence(part, last)))
    w = Window.partitionBy(*keys, "_part").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("_far", F.max("stop").over(w)).where((F.col("start") < F.col("_far")) | (F.col("start") >= F.col("stop")))
    return t.drop("_part", "_far").distinct()


def digest(table: DataFrame, columns: list[str]) -> DataFrame:
    """One row: rows, and a digest that does not depend on their order: sums of two halves of a hash of each row."""
    h = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    half = lambda k: F.sum(F.conv(F.substring(h, k, 12), 16, 10).cast("decimal(38,0)"))
    t = table.agg(F.count("*").alias("rows"), half(1).alias("a"), half(13).alias("b"))
    return t.select("rows", F.sha2(F.concat_ws(":", F.col("rows").cast("string"), *[F.coalesce(F.col(c).cast("string"), F.lit("0")) for c in "ab"]), 256).alias("digest"))


def split(runs: DataFrame, mixed: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
    """(core, details): the core is the runs of one class whether their cells are mixed or not; details are the mixed
    cells by face, with shares in 255ths."""
    from .ranges import runs as merged

    core = merged(runs.select("start", "stop", "state"), "start", "stop", ["state"])
    details = mixed.withColumn("face", F.shiftright("cell", 2 * level).cast("int")).withColumn("share", F.round(F.col("share") * 255).cast("int"))
    return core, details


def save(path: str, core: DataFrame, details: DataFrame, level: int, source: str = "") -> None:
    """Write core, details (partitioned by face) and what identifies the two as one dataset."""
    core.write.mode("errorifexists").parquet(f"{path}/core")
    details.write.mode("errorifexists").partitionBy("face").parquet(f"{path}/details")
    spark = core.sparkSession
    own = spark.read.parquet(f"{path}/core")
    about = digest(own, ["start", "stop", "state"]).withColumns({"level": F.lit(level), "source": F.lit(source)})
    about.coalesce(1).write.mode("errorifexists").parquet(f"{path}/about")


def load(spark: SparkSession, path: str, faces: list[int] | None = None) -> tuple[DataFrame, DataFrame, dict]:
    """(core, details of those faces, about): a core that is not what was saved, or whose runs overlap, raises."""
    core = spark.read.parquet(f"{path}/core")
    about = spark.read.parquet(f"{path}/about").first().asDict()
    if digest(core, ["start", "stop", "state"]).first()["digest"] != about["digest"]:
        raise ValueError("the core is not the one that the details belong to")
    if not overlapping(core).isEmpty():
        raise ValueError("runs overlap")
    details = spark.read.parquet(f"{path}/details")
    return core, details if faces is None else details.where(F.col("face").isin(faces)), about


def export_rows(cells: DataFrame, cell: str = "cell", kind: str = "kind") -> DataFrame:
    """Classified cells as rows of a grid product: identifiers, place in the hierarchy, measures and a closed ring."""
    from ..functions.geometry import hex_of, rhombus_of, shape_of

    c = F.col(cell)
    t = cells.select(c.alias("_a"), F.col(kind).alias("_kind"), shape_of(c).alias("s"), rhombus_of(c).alias("r"), hex_of(c).alias("hex_id"), ring_of(c).alias("g"))
    return t.select(
        A.to_compact("_a").alias("id"), A.to_path("_a").alias("path"), A.unsigned("_a").alias("addr64"),
        F.format_string("R%02d-%02d-%d-%d", "r.diamond", "r.level", "r.x", "r.y").alias("rhombus_id"), F.col("r.key").alias("rhombus_hilbert"), "hex_id",
        A.level_of("_a").alias("level"), (F.col("_kind") == "interior").alias("interior"), "s.edge_km", "s.area_km2", F.col("g.pole").alias("pole"), F.col("g.ring").alias("ring"),
    )
