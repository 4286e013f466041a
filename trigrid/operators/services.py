"""Full answers for points from run-length layers: land, country and settlement class, each with how sure it is.

Points carry the index of their cell at the layer's level. Runs are joined on buckets of the index, what mixed cells
hold by equality on the cell, names by a small dimension; a refinement's answer (operators/refine.py) comes as columns
of the points and wins where its cell is covered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import address as A
from .ranges import interval_join
from .zones import NO_DATA, SLOTS, URBAN

#: How sure an answer from the refinement is, and one from a mixed cell whose share is not known.
REFINED, UNKNOWN = 0.99, 0.5


def _cell(index: Column, level: int) -> Column:
    return A.to_compact(A.from_index(index, level))


def _base(points: DataFrame, layer: DataFrame, mixed: DataFrame, index: Column, columns: list[str]) -> DataFrame:
    """points with _i, state, _hit, _mixed and the columns of the mixed cell; columns named like them give way."""
    own = points.drop("state", *columns).withColumn("_i", index)
    t = interval_join(own, layer.select("start", "stop", "state", F.lit(True).alias("_run")), F.col("_i"))
    m = mixed.select(F.col("cell").alias("_m"), *columns)
    t = t.join(m, (F.col("_i") == F.col("_m")) & F.col("_run"), "left")
    return t.withColumns({"_hit": F.coalesce("_run", F.lit(False)), "_mixed": F.col("_m").isNotNull()}).drop("start", "stop", "_run", "_m")


def land_check(points: DataFrame, layer: DataFrame, mixed: DataFrame, index: Column, level: int, covered: str | None = None, refined: str | None = None) -> DataFrame:
    """points with land, kind, confidence, land_fraction, cell and refined.

    Outside all runs: sea, fraction 0, no cell. Inside, away from the coast: land, fraction 1. In a cell of mixed (cell,
    share): land from a share of one half, as sure as the larger part; without a share land, and half sure. Where
    `covered` holds, `refined` (a boolean) decides, with the fraction of the cells below it. Points without a cell give
    nulls.
    """
    t = _base(points, layer, mixed, index, ["share"])
    there = F.col("_i").isNotNull()
    fraction = F.when(~F.col("_hit"), F.lit(0.0)).when(F.col("_mixed"), F.col("share")).otherwise(F.lit(1.0))
    land = F.when(~F.col("_hit"), F.lit(False)).when(F.col("_mixed"), F.coalesce(F.col("share") >= 0.5, F.lit(True))).otherwise(F.lit(True))
    kind = F.when(~F.col("_hit"), "sea").when(F.col("_mixed"), "coast").otherwise("land")
    sure = F.when(F.col("_mixed"), F.coalesce(F.greatest("share", 1 - F.col("share")), F.lit(UNKNOWN))).otherwise(F.lit(1.0))
    cell = F.when(F.col("_hit"), _cell(F.col("_i"), level))
    over = F.coalesce(F.col(covered), F.lit(False)) if covered else F.lit(False)
    return t.select(
        *[F.col(f"`{c}`") for c in points.columns if c not in ("land", "kind", "confidence", "land_fraction", "cell", "state", "share")],
        F.when(there, F.when(over, F.col(refined)).otherwise(land) if refined else land).alias("land"),
        F.when(there, F.when(over, "coast").otherwise(kind)).alias("kind"),
        F.when(there, F.when(over, F.lit(REFINED)).otherwise(sure)).alias("confidence"),
        F.when(there, fraction).alias("land_fraction"),
        F.when(there, F.when(over, _cell(F.col("_i"), level)).otherwise(cell)).alias("cell"),
        F.when(there, over).alias("is_refined"),
    )


def country_check(points: DataFrame, layer: DataFrame, mixed: DataFrame, countries: DataFrame, index: Column, level: int, covered: str | None = None, refined: str | None = None) -> DataFrame:
    """points with country, iso2, country_name, kind, confidence, share, cell and is_refined.

    layer's state is a country's number; mixed (cell, call, share) names the country with most of a border cell, null
    for none; countries is (id, code, iso2, name), a row a country. An empty iso2 is null. Border answers are as sure as
    their share, half without one. Where `covered` holds, the number in `refined` decides (null: none).
    """
    t = _base(points, layer, mixed, index, ["call", "share"])
    there = F.col("_i").isNotNull()
    over = F.coalesce(F.col(covered), F.lit(False)) if covered else F.lit(False)
    number = F.when(~F.col("_hit"), F.lit(None)).when(F.col("_mixed"), F.col("call")).otherwise(F.col("state"))
    number = F.when(over, F.col(refined)).otherwise(number) if refined else number
    t = t.withColumn("_id", number.cast("long"))
    dim = countries.select(F.col("id").cast("long").alias("_cid"), F.col("code").alias("_code"), F.nullif(F.col("iso2"), F.lit("")).alias("_iso2"), F.col("name").alias("_name"))
    t = t.join(dim, F.col("_id") == F.col("_cid"), "left")
    share = F.when(~F.col("_hit"), F.lit(0.0)).when(F.col("_mixed"), F.col("share")).otherwise(F.lit(1.0))
    sure = F.when(F.col("_mixed") & F.col("_hit"), F.coalesce("share", F.lit(UNKNOWN))).otherwise(F.lit(1.0))
    kind = F.when(~F.col("_hit"), "none").when(F.col("_mixed"), "border").otherwise("country")
    gone = ("country", "iso2", "country_name", "kind", "confidence", "share", "cell", "state", "call", "is_refined")
    return t.select(
        *[F.col(f"`{c}`") for c in points.columns if c not in gone],
        F.col("_code").alias("country"), F.col("_iso2").alias("iso2"), F.col("_name").alias("country_name"),
        F.when(there, F.when(over, "border").otherwise(kind)).alias("kind"),
        F.when(there, F.when(over, F.lit(REFINED)).otherwise(sure)).alias("confidence"),
        F.when(there, share).alias("share"),
        F.when(there & (F.col("_hit") | over), _cell(F.col("_i"), level)).alias("cell"),
        F.when(there, over).alias("is_refined"),
    )


def settlement_check(points: DataFrame, layer: DataFrame, index: Column, level: int, details: DataFrame | None = None, provenance: dict[str, str] | None = None) -> DataFrame:
    """points with code, urban, status, cell, surface, share, mixed, nodata_mix, has_details and provenance columns.

    layer's state is a slot 0..8 of the fixed classes. details (cell, share in 255ths, water, nodata) lists the mixed
    cells; without it everything about boundaries is null. A cell that is not listed is of one class: share 1. The
    surface is mixed (some water), water (the water class) or land; without data it is unknown and has no share. Keep
    details partitioned by face, so that a query over few faces reads few files.
    """
    none = points.sparkSession.createDataFrame([], "cell bigint, share int, water boolean, nodata boolean")
    t = _base(points, layer, details if details is not None else none, index, ["share", "water", "nodata"])
    there = F.col("_hit")
    code = F.nullif(F.get(F.array(*[F.lit(c) for c in SLOTS]), F.col("state").cast("int")), F.lit(NO_DATA))
    t = t.withColumn("_code", F.when(there, code))
    known = F.lit(details is not None) & there
    gone = ("code", "urban", "status", "cell", "surface", "share", "mixed", "nodata_mix", "has_details", "state", "water", "nodata", *(provenance or {}))
    surface = F.when(there & F.col("_code").isNull(), "unknown").when(known, F.when(F.coalesce("water", F.lit(False)), "mixed").when(F.col("_code") == 10, "water").otherwise("land"))
    return t.select(
        *[F.col(f"`{c}`") for c in points.columns if c not in gone],
        F.col("_code").alias("code"),
        F.col("_code").isin(*URBAN).alias("urban"),
        F.when(there, F.when(F.col("_code").isNull(), "no_data").otherwise("classified")).alias("status"),
        F.when(there, _cell(F.col("_i"), level)).alias("cell"),
        surface.alias("surface"),
        F.when(known & F.col("_code").isNotNull(), F.when(F.col("_mixed"), F.col("share") / F.lit(255.0)).otherwise(F.lit(1.0))).alias("share"),
        F.when(known, F.col("_mixed")).alias("mixed"),
        F.when(known, F.coalesce("nodata", F.lit(False))).alias("nodata_mix"),
        F.when(there, F.lit(details is not None)).alias("has_details"),
        *[F.lit(v).alias(k) for k, v in (provenance or {}).items()],
    )


def layer_stats(layer: DataFrame, mixed: DataFrame, level: int) -> DataFrame:
    """One row: level, runs, cells, interior and mixed cells, and whether shares are known."""
    r = layer.agg(F.count("*").alias("runs"), F.coalesce(F.sum(F.col("stop") - F.col("start")), F.lit(0)).alias("cells"))
    m = mixed.agg(F.count("*").alias("mixed_cells"), F.coalesce(F.bool_or(F.col("share").isNotNull()), F.lit(False)).alias("has_shares"))
    both = r.withColumn("_one", F.lit(1)).join(m.withColumn("_one", F.lit(1)), "_one").drop("_one")
    return both.select(F.lit(level).alias("level"), "runs", "cells", (F.col("cells") - F.col("mixed_cells")).alias("interior_cells"), "mixed_cells", "has_shares")
