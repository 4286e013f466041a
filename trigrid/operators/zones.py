"""Run-length layers over the index of a level: lookup with confidence, statistics, comparison, agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranges import STRETCH, interval_join

# Settlement codes with their name, label, and class and name on the first level.
SETTLEMENT = (
    (30, "urban_centre", "Urban centre", 3, "urban_centre"),
    (23, "dense_urban_cluster", "Dense urban cluster", 2, "urban_cluster"),
    (22, "semi_dense_urban_cluster", "Semi-dense urban cluster", 2, "urban_cluster"),
    (21, "suburban_or_peri_urban", "Suburban or peri-urban", 2, "urban_cluster"),
    (13, "rural_cluster", "Rural cluster", 1, "rural_grid_cell"),
    (12, "low_density_rural", "Low-density rural", 1, "rural_grid_cell"),
    (11, "very_low_density_rural", "Very-low-density rural", 1, "rural_grid_cell"),
    (10, "water", "Water", 1, "rural_grid_cell"),
)
SLOTS = (10, 11, 12, 13, 21, 22, 23, 30, 255)
URBAN = (21, 22, 23, 30)
NO_DATA = 255


def settlement(t: DataFrame, slot: str) -> DataFrame:
    """t with code, name, label, level1, level1_name and urban of a slot 0..8; null without data or slot."""
    code = F.nullif(F.get(F.array(*[F.lit(c) for c in SLOTS]), F.col(slot).cast("int")), F.lit(NO_DATA))
    dim = t.sparkSession.createDataFrame(list(SETTLEMENT), "_code int, name string, label string, level1 int, level1_name string")
    t = t.withColumn("code", code).withColumn("urban", F.col("code").isin(*URBAN))
    return t.join(F.broadcast(dim), F.col("code") == F.col("_code"), "left").drop("_code")  # eight rows, always


def lookup(points: DataFrame, layer: DataFrame, key, mixed: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """points with state, kind, share and confidence.

    Outside all runs: state null, kind 'none', confidence 1. In a plain run: kind 'interior', confidence 1. In a cell
    listed in mixed (cell, share): kind 'border', the confidence is the larger of share and its rest, and `inside`
    says whether the share reaches the threshold; without a share, 0.5.
    """
    t = interval_join(points.withColumn("_cell", key), layer, F.col("_cell"))
    if mixed is not None:
        t = t.join(mixed.select(F.col("cell").alias("_m"), "share"), (F.col("_cell") == F.col("_m")) & F.col("state").isNotNull(), "left")
        border = F.col("_m").isNotNull()
        t = t.withColumns({
            "kind": F.when(F.col("state").isNull(), "none").when(border, "border").otherwise("interior"),
            "confidence": F.when(border, F.coalesce(F.greatest("share", 1 - F.col("share")), F.lit(0.5))).otherwise(F.lit(1.0)),
            "inside": F.when(F.col("state").isNull(), F.lit(False)).when(border, F.coalesce(F.col("share") >= threshold, F.lit(True))).otherwise(F.lit(True)),
        })
    return t.drop("_cell", "_m")


def quantised(share):
    """A share in sixteenths: stored as 0..15, read back as the middle of its step."""
    return (F.least(F.lit(15), F.floor(share * 16)) + 0.5) / F.lit(16.0)


def stats(layer: DataFrame) -> DataFrame:
    return layer.groupBy("state").agg(F.count("*").alias("n_runs"), F.sum(F.col("stop") - F.col("start")).alias("n_cells"))


def changes(old: DataFrame, new: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """Cells by (old state, new state), null where a layer has none: from the breakpoints of both, never cell by cell."""
    both = old.select("start", "stop", F.lit(0).alias("which"), "state").unionByName(new.select("start", "stop", F.lit(1).alias("which"), "state"))
    # a point where either layer changes: what begins, and what ends without a successor
    at = both.select(F.col("start").alias("at"), "which", F.struct(F.lit(1).alias("on"), F.col("state").alias("state")).alias("now")).unionByName(both.select(F.col("stop").alias("at"), "which", F.struct(F.lit(0).alias("on"), F.lit(None).cast("int").alias("state")).alias("now")))
    side = lambda k: F.max(F.when(F.col("which") == k, F.col("now")))  # noqa: E731  a beginning wins over an end at one point
    at = at.groupBy("at").agg(side(0).alias("o"), side(1).alias("n"))
    # in stretches of the index; what held before one, and where the next one begins, comes from a row of each
    at = at.withColumn("_part", F.floor(F.col("at") / F.lit(stretch)))
    ends = at.groupBy("_part").agg(F.min("at").alias("first"), F.max_by("o", F.when(F.col("o").isNotNull(), F.col("at"))).alias("o"), F.max_by("n", F.when(F.col("n").isNotNull(), F.col("at"))).alias("n"))
    over = Window.orderBy("_part")
    past = over.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(F.col("_part").alias("_p"), F.lead("first").over(over).alias("_next"), F.last("o", True).over(past).alias("_o"), F.last("n", True).over(past).alias("_n"))
    order = Window.partitionBy("_part").orderBy("at")
    past = order.rowsBetween(Window.unboundedPreceding, 0)
    at = at.select("_part", "at", F.lead("at").over(order).alias("upto"), F.last("o", True).over(past).alias("o"), F.last("n", True).over(past).alias("n"))
    at = at.join(ends, F.col("_part") == F.col("_p")).select("at", F.coalesce("upto", "_next").alias("upto"), F.coalesce("o", "_o").alias("o"), F.coalesce("n", "_n").alias("n")).where("upto IS NOT NULL")
    t = at.select(F.when(F.col("o.on") == 1, F.col("o.state")).alias("old_state"), F.when(F.col("n.on") == 1, F.col("n.state")).alias("new_state"), (F.col("upto") - F.col("at")).alias("n"))
    return t.where("old_state IS NOT NULL OR new_state IS NOT NULL").groupBy("old_state", "new_state").agg(F.sum("n").alias("n_cells"))


def ordered_signature(t: DataFrame, key: str, order: list[str], answer: str, width: int = 1 << 16) -> DataFrame:
    """One row (n, signature) that depends on the answers' order: the SHA-256 of each stretch of `width` whole-number
    keys, then of these in order. A stretch is one task's; what meets at the end is a digest a stretch."""
    part = F.floor(F.col(key) / width)
    row = F.struct(*order, F.coalesce(F.col(answer).cast("string"), F.lit("")).alias("_a"))
    one = F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["_a"]), "\n")
    g = t.groupBy(part.alias("part")).agg(F.sha2(one, 256).alias("digest"), F.count("*").alias("n"))
    all_ = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "digest"))), lambda r: r["digest"]), "\n")
    return g.agg(F.sum("n").alias("n"), F.sha2(all_, 256).alias("signature"))


def confusion(t: DataFrame, truth: str, answer: str) -> DataFrame:
    return t.groupBy(F.col(truth).alias("truth"), F.col(answer).alias("answer")).agg(F.count("*").alias("n"))


def precision_recall(t: DataFrame, truth: str, answer: str) -> DataFrame:
    """Of each class that occurs on either side: support, hits, precision and recall (null where undefined)."""
    m = confusion(t, truth, answer)
    rows = m.groupBy("truth").agg(F.sum("n").alias("support"), F.sum(F.when(F.col("truth").eqNullSafe(F.col("answer")), F.col("n")).otherwise(0)).alias("hits"))
    cols = m.groupBy("answer").agg(F.sum("n").alias("answered"))
    j = rows.join(cols, rows["truth"].eqNullSafe(cols["answer"]), "full")
    return j.select(F.coalesce("truth", "answer").alias("class"), F.coalesce("support", F.lit(0)).alias("support"), F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("answered", F.lit(0)).alias("answered"), F.try_divide("hits", "answered").alias("precision"), F.try_divide("hits", "support").alias("recall"))
