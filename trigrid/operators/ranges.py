"""Index intervals: merging, building from cells, and joining points to them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import address as A


#: Width of the stretches that an order over a whole index is cut into: a task has one, and a row of each meets the others.
STRETCH = 1 << 16


def _before(parts: DataFrame, keys: tuple[str, ...], what: Column, name: str) -> DataFrame:
    """Of a table of a row a stretch (`_part`): `what` over all stretches before each, by key."""
    w = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(*keys, "_part", what.over(w).alias(name))


def merge(t: DataFrame, lo: str, hi: str, keys: tuple[str, ...] = (), gap: int = 1, stretch: int = STRETCH) -> DataFrame:
    """Inclusive intervals -> the fewest that cover them, by key: gaps and islands over one sort a stretch.

    Intervals join when one begins at most `gap` past the furthest end before it. Stretches of `stretch` values of lo
    are sorted apart; how far the ones before reach, and how many islands begin in them, comes from a row of each.
    """
    t = t.select(*keys, lo, hi).withColumn("_part", F.floor(F.col(lo) / F.lit(stretch)))
    on = [*keys, "_part"]
    order = Window.partitionBy(*on).orderBy(lo, hi)
    reach = _before(t.groupBy(*on).agg(F.max(hi).alias("m")), keys, F.max("m"), "_reach")
    t = _joined(t, reach, on)
    far = F.greatest(F.max(hi).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.col("_reach"))
    t = t.withColumn("_new", F.when(far.isNull() | (F.col(lo) > far + gap), 1).otherwise(0))
    begun = _before(t.groupBy(*on).agg(F.sum("_new").alias("n")), keys, F.sum("n"), "_begun")
    t = _joined(t, begun, on).withColumn("_island", F.coalesce("_begun", F.lit(0)) + F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return t.groupBy(*keys, "_island").agg(F.min(lo).alias(lo), F.max(hi).alias(hi)).drop("_island")


def _joined(t: DataFrame, small: DataFrame, on: list[str]) -> DataFrame:
    """An equality join that takes null keys as equal."""
    s = small.select(*[F.col(f"`{c}`").alias(f"_j{k}") for k, c in enumerate(on)], *[c for c in small.columns if c not in on])
    same = F.lit(True)
    for k, c in enumerate(on):
        same = same & F.col(f"`{c}`").eqNullSafe(F.col(f"_j{k}"))
    return t.join(s, same, "left").drop(*[f"_j{k}" for k in range(len(on))])


#: The level of the cells that are a stretch of cover_ranges each.
APART = 4


def cover_ranges(cells: DataFrame, cell: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Cells of any levels in any order, some of them repeated -> merged subtree intervals (lo, hi); faces never merge.

    Subtree intervals lie one in another or apart, with numbers between them. So the merged ones are those that no other
    holds: in the order of each stretch, a cell of level 4, those that reach past all before. A coarser cell comes to
    each stretch it covers and stays in its first.
    """
    s, stretch = A.subtree(cell), lambda c: F.shiftright(c, 59 - 2 * APART)
    t = cells.select(*keys, s["lo"].alias("lo"), s["hi"].alias("hi"))
    t = t.select("*", F.explode_outer(F.sequence(stretch("lo"), stretch("hi"))).alias("_part"))
    before = Window.partitionBy(*keys, "_part").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("_far", F.max("hi").over(before)).where(F.coalesce(F.col("hi") > F.col("_far"), F.lit(True)))
    return t.where(F.col("_part").eqNullSafe(stretch("lo"))).select(*keys, A.face_of("lo").alias("face"), "lo", "hi")


def runs(t: DataFrame, start: str, stop: str, state: list[str], keys: tuple[str, ...] = (), stretch: int = STRETCH) -> DataFrame:
    """Disjoint half-open spans with a state -> the longest spans of one state.

    Stretches of the index are merged apart; only the first and the last run of each can go on in another, and those
    few are merged once more.
    """
    t = t.select(*keys, start, stop, *state).withColumn("_part", F.floor(F.col(start) / F.lit(stretch)))
    t = _runs(t, start, stop, state, (*keys, "_part"))
    w = Window.partitionBy(*keys, "_part").orderBy(start)
    t = t.withColumn("_edge", F.lag(F.lit(1)).over(w).isNull() | F.lead(F.lit(1)).over(w).isNull())
    inner = t.where("NOT _edge").select(*keys, start, stop, *state)
    return inner.unionByName(_runs(t.where("_edge").drop("_part", "_edge"), start, stop, state, keys))


def _runs(t: DataFrame, start: str, stop: str, state: list[str], keys: tuple[str, ...]) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(start)
    same = F.lit(True)
    for c in state:
        same = same & F.lag(c).over(order).eqNullSafe(F.col(c))
    new = F.when(same & (F.lag(stop).over(order) == F.col(start)), 0).otherwise(1)
    t = t.withColumn("_new", new).withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return t.groupBy(*keys, "_run", *state).agg(F.min(start).alias(start), F.max(stop).alias(stop)).select(*keys, start, stop, *state)


def bucket_shift(runs_: DataFrame, start: str = "start", stop: str = "stop") -> int:
    """A bucket width (a power of two) near the mean run, so that a run is in two or so buckets."""
    n, total = runs_.agg(F.count("*"), F.sum(F.col(stop) - F.col(start))).first()
    return max(0, math.ceil(math.log2(max(1, (total or 1) / max(1, n)))))


def interval_join(points: DataFrame, runs_: DataFrame, key: Column, how: str = "left", start: str = "start", stop: str = "stop", shift: int | None = None) -> DataFrame:
    """Each point with the half-open run that its key lies in, as an equality join on buckets of the key.

    No nested loop: runs go to the buckets they touch, points to one. A run much longer than a bucket costs a row for
    each bucket it covers; as bucket_shift takes the mean run for a width, that is at most three rows a run over all,
    however unlike runs are.
    """
    shift = bucket_shift(runs_, start, stop) if shift is None else shift
    first, last = F.shiftright(F.col(start), shift), F.shiftright(F.col(stop) - 1, shift)
    r = runs_.withColumn("_b", F.explode(F.sequence(first, last)))
    p = points.withColumn("_key", key).withColumn("_pb", F.shiftright(F.col("_key"), shift))
    on = (p["_pb"] == r["_b"]) & (p["_key"] >= r[start]) & (p["_key"] < r[stop])
    return p.join(r, on, how).drop("_b", "_pb", "_key")


def subtree_join(cells: DataFrame, roots: DataFrame, cell: str, root: str, levels: list[int], how: str = "inner") -> DataFrame:
    """Cells with the roots above them: one equality join on (level, ancestor), cells at the levels that roots have."""
    c = cells.withColumn("_at", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), A.up(cell, n).alias("up")) for n in levels])))
    return c.join(roots.withColumn("_n", A.level_of(root)), (F.col("_at.n") == F.col("_n")) & (F.col("_at.up") == F.col(root)), how).drop("_at", "_n")
