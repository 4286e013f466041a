"""Embedding near-dedup by spherical-cap filters with random product codes.

A filter is a unit direction; a vector passes those with which its inner product exceeds alpha. Directions are all
pairs from two random codes on the halves of the (randomly rotated) space, so a vector's list of filters is decoded
from two short lists of inner products, without visiting the other filters. How a vector's mass falls on the halves
decides how many filters it passes, so there are several independent rotations with codes of their own: turned at
random, each pair is as any other, and their number follows from the share of drawn pairs that each one misses.

Vectors that share a filter are compared by their components in 8 bits, with a bound on what that loses, so that no
pair at the threshold fails; what hangs together so is a candidate class. Its members then meet in doubles, which
decides the links and counts them. Eight bits, not doubles, are copied once a filter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .groups import block_pairs, dealt, forest, rows_of, units
from .scratch import drop, materialise, shuffle_partitions, without

OUT = ("n_links", "component_id", "kept")
RECALL = 0.9999
#: What settings are tried: unrelated vectors a filter holds, filters a vector passes in one rotation; rotations at
#: most, and the largest share of all vectors that a filter may hold.
OCCUPANCY, LISTS, TURNS, WIDEST = (32, 128, 512), (1, 2, 4, 8), 100, 0.25
#: Vectors that are compared in one place; pairs of blocks beyond.
BLOCK = 2048


def cap_height(share: float, dim: int) -> float:
    """The alpha for which a cap holds that share of the sphere: angles lie as sin(angle) ** (dim - 2)."""
    if dim < 2:
        return 0.0
    angle = np.linspace(0, math.pi, 200_001)
    mass = np.cumsum(np.sin(angle) ** (dim - 2))
    return math.cos(float(np.interp(share, mass / mass[-1], angle)))


def _pairs(n: int, dim: int, threshold: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of unit vectors at the threshold, in random directions."""
    u, w = np.random.default_rng([seed, dim]).normal(size=(2, n, dim))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    w -= (w * u).sum(1, keepdims=True) * u
    return u, threshold * u + math.sqrt(max(0.0, 1 - threshold**2)) * w / np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-9)


def _missed(u: np.ndarray, v: np.ndarray, alpha: float, words: int, seed: int) -> tuple[float, float]:
    """The share of the pairs (u, v) that have no common filter in a rotation, and the filters that a vector passes."""
    one, two = decode(u, alpha, words, seed), decode(v, alpha, words, seed)
    apart = sum(not np.intersect1d(a, b, assume_unique=True).size for a, b in zip(one, two, strict=True))
    return min(1.0, (apart + 1) / len(u)), float(np.mean([len(a) for a in one]))


def settled(n: int, dim: int, threshold: float, recall: float = RECALL) -> tuple[float, int, list[int]]:
    """Vectors, dimensions -> (alpha, codewords a half, seeds of the rotations), in the same way for any of them.

    Settings are judged by drawn pairs at the threshold; the one that needs the least work is taken (rows that move,
    comparisons, decoding). Rotations are then added until the product of the shares of drawn pairs that have no common
    filter in each is at most 1 - recall. A rotation that is random turns any pair into a drawn one, so the product
    holds for each pair, however lopsided. Should no setting get there in TURNS rotations, caps are widened.
    """
    u, v = _pairs(300, dim, threshold, 1)
    tried, widest = [], WIDEST
    for share in sorted({min(widest, o / max(n, 1)) for o in OCCUPANCY}):
        alpha = cap_height(share, dim)
        for lists in LISTS:
            words = max(2, math.ceil(math.sqrt(lists / share)))
            miss, passed = _missed(u, v, alpha, words, 4)
            turns = math.log(1 - recall) / math.log(min(miss, 0.999))
            tried.append((turns * (passed * (100_000 + share * n * dim) + words * (2 * dim + 60)), turns, alpha, words))
    _, turns, alpha, words = min((t for t in tried if t[1] <= 0.8 * TURNS), default=min(tried, key=lambda t: t[1]))
    u, v = _pairs(1000, dim, threshold, 2)
    while True:
        missed, seeds = 1.0, []
        while missed > 1 - recall and len(seeds) < TURNS:
            seeds.append(5 + len(seeds))
            missed *= _missed(u, v, alpha, words, seeds[-1])[0]
        if missed <= 1 - recall:
            return alpha, words, seeds
        alpha -= 0.1


@lru_cache(maxsize=128)
def codes(dim: int, words: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A rotation and the two codes; the same on every machine."""
    rng = np.random.default_rng([seed, dim, words])
    turn = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
    half = dim - dim // 2
    one, two = rng.normal(size=(words, half)), rng.normal(size=(words, max(1, dim - half)))
    return turn, one / np.linalg.norm(one, axis=1, keepdims=True), two / np.linalg.norm(two, axis=1, keepdims=True)


def passed(x: np.ndarray, alpha: float, words: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors -> (row, number) of all filters of a rotation that they pass, row by row."""
    dim = x.shape[1]
    turn, one, two = codes(dim, words, seed)
    y = x @ turn
    half = one.shape[1]
    a = y[:, :half] @ one.T
    b = y[:, half:] @ two.T if dim > 1 else np.zeros((len(x), words))
    need = alpha * math.sqrt(2)
    of, number = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    # words of the first half that the best one of the second can complete
    row, first = np.nonzero(a + b.max(1, keepdims=True) >= need)
    step = max(1, (1 << 22) // words)
    for lo in range(0, len(row), step):
        r, f = row[lo : lo + step], first[lo : lo + step]
        at, second = np.nonzero(b[r] >= need - a[r, f][:, None])
        of.append(r[at])
        number.append(f[at] * words + second)
    return np.concatenate(of), np.concatenate(number)


def decode(x: np.ndarray, alpha: float, words: int, seed: int = 5) -> list[np.ndarray]:
    """Unit vectors -> for each the numbers of all filters of a rotation that it passes."""
    of, number = passed(x, alpha, words, seed)
    return np.split(number, np.cumsum(np.bincount(of, minlength=len(x)))[:-1])


def linked_forest(links, n: int, step: int = 512) -> np.ndarray:
    """forest() where most members link with no other: those are set aside first."""
    some = np.concatenate([np.flatnonzero(links(r, np.arange(n)).sum(1) > 1) + r[0] for r in (np.arange(lo, min(n, lo + step)) for lo in range(0, n, step))] or [np.zeros(0, np.int64)])
    root = np.arange(n)
    if len(some):
        root[some] = some[forest(lambda r, c: links(some[r], some[c]), len(some))]
    return root


def rough(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors -> (their components in 8 bits, and the length of what that loses with a little over; scales as two
    32-bit floats in the last 8 bytes): x = scale * q + lost."""
    scale = (np.abs(x).max(1, keepdims=True) / 127).astype("<f4")
    q = np.rint(x / scale).clip(-127, 127).astype(np.int8)
    lost = (np.linalg.norm(x - q * scale.astype(float), axis=1, keepdims=True) * 1.0001 + 1e-6).astype("<f4")
    return q, np.concatenate([scale, lost], 1)


def perhaps(packed: np.ndarray, threshold: float):
    """Rows as packed from rough() -> a test of rows against columns that no pair at the threshold fails."""
    tail = np.ascontiguousarray(packed[:, -8:]).view("<f4")
    x = packed[:, :-8].view(np.int8).astype(np.float32) * tail[:, :1]
    lost = tail[:, 1]
    # |<x, y> - <x', y'>| <= |x - x'| + |y - y'| + |x - x'| |y - y'|, and some for 32-bit sums
    return lambda r, c: x[r] @ x[c].T >= threshold - 1e-5 - (lost[r][:, None] + lost[c][None, :] + lost[r][:, None] * lost[c][None, :])


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, recall: float = RECALL) -> DataFrame:
    """The rows of vectors with n_links, component_id, kept.

    Null vectors, zero vectors and those with null or non-finite components link with nothing: they are classes of
    their own. Vectors of different lengths never link. Equal vectors (repeated rows too) link with each other.
    component_id is the smallest identifier reachable, null only if there is none; kept says whether it is the row's
    own, so of rows with the same identifier all are kept. Counts come by class of equal vectors. An empty table gives
    an empty table; outputs replace columns named like them.
    """
    base = without(vectors, *OUT)
    v = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    good = F.col(vector_col).isNotNull() & F.coalesce(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False)) & F.coalesce(F.exists(v, lambda c: c != 0), F.lit(False))
    t = base.withColumn("_tg_v", F.when(good, v))
    same = t.where("_tg_v IS NOT NULL").groupBy(F.col("_tg_v").alias("v")).agg(F.min(id_col).alias("id"), F.count("*").alias("copies"))
    reps = materialise(same.withColumn("node", F.monotonically_increasing_id()))
    dims = [(r[0], r[1]) for r in reps.groupBy(F.size("v")).count().orderBy(F.desc("count")).collect()]
    settings = {d: settled(n, d, threshold, recall) for d, n in dims}

    def filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                sizes = np.asarray(part["v"].value_lengths())
                for dim in np.unique(sizes):
                    at = np.flatnonzero(sizes == dim)
                    x = unit_rows(part["v"].take(pa.array(at)), int(dim))
                    alpha, words, seeds = settings[int(dim)]
                    turns = [passed(x, alpha, words, seed) for seed in seeds]
                    of = np.concatenate([at[rows] for rows, _ in turns])
                    g = np.concatenate([f + k * words * words for k, (_, f) in enumerate(turns)])
                    yield pa.RecordBatch.from_arrays([part["node"].take(pa.array(of)), pa.array(np.full(len(g), dim, np.int32)), pa.array(g)], names=["node", "dim", "f"])

    def shorter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(batch["v"].value_lengths())
            for dim in np.unique(sizes):
                at = pa.array(np.flatnonzero(sizes == dim))
                q, tail = rough(unit_rows(batch["v"].take(at), int(dim)))
                raw = np.concatenate([q.view(np.uint8), tail.view(np.uint8).reshape(len(q), 8)], 1)
                yield pa.RecordBatch.from_arrays([batch["node"].take(at), pa.array([r.tobytes() for r in raw], pa.binary())], names=["node", "x"])

    vec = reps.select("node", "v")
    listed = materialise(vec.mapInArrow(filters, "node bigint, dim int, f bigint"))
    sizes = listed.groupBy("dim", "f").agg(F.count("*").alias("n")).where("n > 1")
    # eight bits a component join in after the filters with one vector are gone
    members = listed.join(sizes, ["dim", "f"]).join(vec.mapInArrow(shorter, "node bigint, x binary"), "node")
    members = block_pairs(members.select(F.struct("dim", "f").alias("g"), "n", "node", "x"), BLOCK)
    members = members.select("g.dim", "g.f", "bi", "bj", "node", "x").repartition(shuffle_partitions(t.sparkSession), "dim", "f", "bi", "bj").sortWithinPartitions("dim", "f", "bi", "bj")

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in units(batches, ("dim", "f", "bi", "bj")):
            root = np.arange(t.num_rows)
            for a, b in zip(starts[:-1], starts[1:], strict=False):
                root[a:b] = a + linked_forest(perhaps(rows_of(t["x"].slice(a, b - a), "u1"), threshold), b - a)
            hit = np.flatnonzero(root != np.arange(len(root)))
            nodes = np.asarray(t["node"].combine_chunks())
            yield pa.RecordBatch.from_arrays([pa.array(nodes[hit]), pa.array(nodes[root[hit]])], names=["src", "dst"])

    labels = materialise(components(members.mapInArrow(edges, "src bigint, dst bigint")))
    drop(listed)
    in_class = labels.groupBy("label").agg(F.count("*").alias("n"))
    within = block_pairs(reps.select("node", "copies", "v").join(labels, "node").join(in_class, "label").withColumnRenamed("label", "g"), BLOCK)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in units(batches):
            nodes = np.asarray(t["node"].combine_chunks())
            for a, b in zip(starts[:-1], starts[1:], strict=False):
                u = t.slice(a, b - a)
                x = unit_rows(u["v"].combine_chunks(), len(u["v"][0]))
                links = lambda r, c, x=x: x[r] @ x[c].T >= threshold
                yield pa.RecordBatch.from_arrays([pa.array(nodes[a:b]), pa.array(nodes[a + linked_forest(links, b - a)]), pa.array(unit_counts(links, u))], names=["src", "dst", "n"])

    links = materialise(dealt(within.select("g", "bi", "bj", "own", "node", "copies", "v")).mapInArrow(compare, "src bigint, dst bigint, n bigint"))
    counts = links.groupBy(F.col("src").alias("node")).agg(F.sum("n").alias("_tg_n"))
    classes = materialise(components(links.select("src", "dst")))
    names = reps.join(classes, "node").groupBy("label").agg(F.min("id").alias("_tg_c"))
    facts = reps.join(classes, "node", "left").join(names, "label", "left").join(counts, "node", "left")
    # written, so that Spark can split the rows of a vector that is there very often
    facts = materialise(facts.select(F.col("v").alias("_tg_k"), F.col("copies").alias("_tg_copies"), F.coalesce("_tg_c", "id").alias("_tg_c"), F.coalesce("_tg_n", F.lit(0)).alias("_tg_n")))
    j = t.join(facts, F.col("_tg_v") == F.col("_tg_k"), "left")
    return j.select(
        *[F.col(f"`{c}`") for c in base.columns],
        F.coalesce(F.col("_tg_n") + F.col("_tg_copies") - 1, F.lit(0)).cast("long").alias("n_links"),
        F.coalesce(F.col("_tg_c"), F.col(id_col)).alias("component_id"),
        F.col(id_col).eqNullSafe(F.coalesce(F.col("_tg_c"), F.col(id_col))).alias("kept"),
    )


def unit_rows(vectors: pa.Array, dim: int) -> np.ndarray:
    """Lists of that length -> a matrix of unit rows."""
    x = np.asarray(vectors.flatten(), float).reshape(-1, dim)
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow in the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _take(x, at: np.ndarray) -> pa.Array:
    x = x.take(pa.array(at))
    return pa.concat_arrays(x.chunks) if isinstance(x, pa.ChunkedArray) else x


def unit_counts(links, u: pa.Table, step: int = 256) -> np.ndarray:
    """Links of each member of a unit, each weighing the other's copies: inside the block if the unit has one block,
    else from one block to the other."""
    n = u.num_rows
    own, weight = np.asarray(u["own"].combine_chunks()), np.asarray(u["copies"].combine_chunks())
    one = u["bi"][0].as_py() == u["bj"][0].as_py()
    total = np.zeros(n, np.int64)
    for lo in range(0, n, step):
        rows = np.arange(lo, min(n, lo + step))
        hit = links(rows, np.arange(n))
        hit = hit & (rows[:, None] != np.arange(n)[None, :]) if one else hit & (own[rows][:, None] != own[None, :])
        total[rows] = hit @ weight
    return total


def op1_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    t = near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return t.select("vec_id", "n_links", "component_id", "kept")


OP1_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), ok AS (
  SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
  WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.r AS a, b.r AS b FROM ok a JOIN ok b ON a.r <> b.r AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / a.norm / b.norm >= 0.9
), reach AS (
  SELECT r AS a, r AS b FROM v UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
), least AS (
  SELECT a, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = b GROUP BY a
), many AS (
  SELECT a, count(*) AS n FROM link GROUP BY a
)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM v JOIN least ON least.a = r LEFT JOIN many ON many.a = r
"""
