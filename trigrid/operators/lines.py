"""Polylines: great-circle lengths, samples along them, and segments of one answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..solid import EARTH_KM


def _xyz(lon: str, lat: str) -> tuple[Column, Column, Column]:
    a, b = F.radians(lon), F.radians(lat)
    return F.cos(b) * F.cos(a), F.cos(b) * F.sin(a), F.sin(b)


def angle(lon1: str, lat1: str, lon2: str, lat2: str) -> Column:
    p, q = _xyz(lon1, lat1), _xyz(lon2, lat2)
    dot = p[0] * q[0] + p[1] * q[1] + p[2] * q[2]
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot)))


def great_circle_km(lon1: str, lat1: str, lon2: str, lat2: str) -> Column:
    return angle(lon1, lat1, lon2, lat2) * EARTH_KM


def segments(points: DataFrame, line: str, seq: list[str], lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Consecutive vertices: (line, segment from 0, lon, lat, lon2, lat2, km)."""
    w = Window.partitionBy(line).orderBy(*seq)
    t = points.select(line, F.row_number().over(w).alias("segment"), F.col(lon).alias("lon"), F.col(lat).alias("lat"), F.lead(lon).over(w).alias("lon2"), F.lead(lat).over(w).alias("lat2"))
    return t.where("lon2 IS NOT NULL").withColumn("segment", F.col("segment") - 1).withColumn("km", F.when((F.col("lon") == F.col("lon2")) & (F.col("lat") == F.col("lat2")), 0.0).otherwise(great_circle_km("lon", "lat", "lon2", "lat2")))


def samples(points: DataFrame, line: str, seq: list[str], step_km: float = 3.5, mode: str = "uniform") -> DataFrame:
    """(line, segment, step from 0, lon, lat, km from the segment's start, along_km from the line's).

    uniform: each line's start, then the end of each of the even steps of at most step_km that a segment is cut into;
    segments under a millimetre give none. vertex: the vertices alone.
    """
    if mode not in ("uniform", "vertex"):
        raise ValueError("mode is uniform or vertex")
    before = F.coalesce(F.sum("km").over(Window.partitionBy(line).orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    t = segments(points, line, seq).withColumn("_before", before)
    if mode == "vertex":
        end = F.struct(F.lit(1).alias("step"), F.col("lon2").alias("lon"), F.col("lat2").alias("lat"), F.col("km").alias("km"), (F.col("_before") + F.col("km")).alias("along_km"))
        start = F.struct(F.lit(0).alias("step"), F.col("lon").alias("lon"), F.col("lat").alias("lat"), F.lit(0.0).alias("km"), F.lit(0.0).alias("along_km"))
        return t.withColumn("_v", F.explode(F.when(F.col("segment") == 0, F.array(start, end)).otherwise(F.array(end)))).select(line, "segment", "_v.*")
    t = t.where("km >= 1e-9").withColumn("n", F.greatest(F.lit(1), F.ceil(F.col("km") / F.lit(step_km))).cast("int"))
    first = F.row_number().over(Window.partitionBy(line).orderBy("segment")) == 1
    t = t.withColumn("_from", F.when(first, 0).otherwise(1)).withColumn("step", F.explode(F.sequence("_from", "n")))
    om, f = F.col("km") / EARTH_KM, F.col("step") / F.col("n")
    p, q = _xyz("lon", "lat"), _xyz("lon2", "lat2")
    tiny = om < 1e-12
    a, b = F.when(tiny, 1.0).otherwise(F.sin((1 - f) * om) / F.sin(om)), F.when(tiny, 0.0).otherwise(F.sin(f * om) / F.sin(om))
    x, y, z = (a * p[i] + b * q[i] for i in range(3))
    km = F.col("km") * f
    return t.select(line, "segment", "step", F.degrees(F.atan2(y, x)).alias("lon"), F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), z)))).alias("lat"), km.alias("km"), (F.col("_before") + km).alias("along_km"))


def answers(t: DataFrame, line: str, order: list[str], km: str, answer: str, confidence: str | None = None, fraction_of: str | None = None, kind: str | None = None, several: str = "mixed") -> DataFrame:
    """Samples with cumulative km and an answer -> stretches of one answer; a border is half-way between samples.

    confidence and fraction_of give their means; kind gives that of all samples, or `several` where they differ.
    """
    w = Window.partitionBy(line).orderBy(*order)
    new = F.when(F.lag(answer).over(w).eqNullSafe(F.col(answer)) & F.lag(line).over(w).isNotNull(), 0).otherwise(1)
    extra = [F.avg(confidence).alias("confidence")] if confidence else []
    extra += [F.avg(fraction_of).alias("mean_fraction")] if fraction_of else []
    extra += [F.when(F.min(kind) == F.max(kind), F.min(kind)).otherwise(several).alias("kind")] if kind else []
    t = t.withColumn("_new", new).withColumns({"_prev": F.lag(km).over(w), "_next": F.lead(km).over(w)})
    t = t.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    a = F.when(F.col("_prev").isNull(), F.lit(0.0)).otherwise((F.col("_prev") + F.col(km)) / 2)
    b = F.when(F.col("_next").isNull(), F.col(km)).otherwise((F.col("_next") + F.col(km)) / 2)
    t = t.groupBy(line, "_run", answer).agg(F.min(a).alias("from_km"), F.max(b).alias("to_km"), F.count("*").alias("n_samples"), *extra)
    total = F.max("to_km").over(Window.partitionBy(line))
    return t.withColumn("fraction", F.when(total > 0, (F.col("to_km") - F.col("from_km")) / total).otherwise(0.0)).withColumnRenamed("_run", "stretch")


def line_totals(stretches: DataFrame, line: str, answer: str) -> DataFrame:
    """Stretches -> by line: total_km, km with the answer (a boolean, or anything but null), its fraction, how many
    stretches and different answers."""
    yes = F.col(answer) if dict(stretches.dtypes)[answer] == "boolean" else F.col(answer).isNotNull()
    km = F.col("to_km") - F.col("from_km")
    g = stretches.groupBy(line).agg(F.max("to_km").alias("total_km"), F.coalesce(F.sum(F.when(yes, km)), F.lit(0.0)).alias("with_km"), F.count("*").alias("n_stretches"), F.count_distinct(answer).alias("n_answers"))
    return g.withColumn("fraction", F.when(F.col("total_km") > 0, F.col("with_km") / F.col("total_km")).otherwise(0.0))


def land_polyline(points: DataFrame, line: str, seq: list[str], check, step_km: float = 3.5, mode: str = "uniform") -> DataFrame:
    """Stretches of land and sea along each line: check takes samples (lon, lat) and adds land, kind, confidence and
    land_fraction, as services.land_check does."""
    t = check(samples(points, line, seq, step_km, mode).drop("km"))
    return answers(t, line, ["segment", "step"], "along_km", "land", "confidence", "land_fraction", "kind", "coast")


def country_polyline(points: DataFrame, line: str, seq: list[str], check, step_km: float = 3.5, mode: str = "uniform") -> DataFrame:
    """Stretches of one country along each line, null between countries: check adds country, kind, confidence, share."""
    t = check(samples(points, line, seq, step_km, mode).drop("km"))
    return answers(t, line, ["segment", "step"], "along_km", "country", "confidence", "share", "kind", "border")
