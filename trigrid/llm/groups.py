"""Groups of candidates, compared inside tasks: links leave a task as a spanning forest and as counts, never as pairs.

A group of any size is cut into blocks of at most about BLOCK members; each pair of blocks is a unit of work of its
own, so that no task holds more than two blocks of a group. Units are told apart by the columns (g, bi, bj).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import shuffle_partitions

#: Members of a block, about; a documented bound on what a task compares at once, not on a group.
BLOCK = 512


def block_pairs(members: DataFrame, block: int = BLOCK) -> DataFrame:
    """members (g, n, node, ...), n the members of group g -> rows by unit (g, bi, bj), `own` the row's block.

    A group that fits one block has the one unit (0, 0). Otherwise each member goes to every unit of its block.
    """
    nb = F.ceil(F.col("n") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(17)), nb).cast("int")
    return (
        members.withColumn("own", own)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), nb - 1)))
        .withColumn("bi", F.least("own", "_other"))
        .withColumn("bj", F.greatest("own", "_other"))
        .drop("_other", "n")
    )


def units(batches: Iterator[pa.RecordBatch], by: tuple[str, ...] = ("g", "bi", "bj")) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Batches sorted by the columns `by` -> (table of whole units, starts of the units and the table's length)."""
    held: list[pa.RecordBatch] = []

    def keys(t: pa.Table) -> np.ndarray:
        n = t.num_rows
        new = np.ones(n, bool)
        if n:
            new[1:] = False
            for c in by:
                x = t[c].combine_chunks()
                x = x.chunk(0) if isinstance(x, pa.ChunkedArray) else x
                new[1:] |= ~np.asarray(pa.compute.equal(x.slice(1), x.slice(0, n - 1)))
        return np.flatnonzero(new)

    import pyarrow.compute  # noqa: F401

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if len(held) > 1 and all(held[-1][c][0].equals(held[0][c][0]) and held[-1][c][-1].equals(held[0][c][0]) for c in by):
            continue  # still inside the first unit
        t = pa.Table.from_batches(held).combine_chunks()
        starts = keys(t)
        if len(starts) > 1:
            cut = int(starts[-1])
            yield t.slice(0, cut), starts
            held = t.slice(cut).to_batches()
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t, np.append(keys(t), t.num_rows)


def rows_of(column: pa.ChunkedArray, dtype: str) -> np.ndarray:
    """A binary column whose values are equally long, as a matrix."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    a = a.chunk(0) if isinstance(a, pa.ChunkedArray) else a
    n = len(a)
    if pa.types.is_large_binary(a.type):
        a = a.cast(pa.binary())
    offsets = np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + n + 1]
    data = np.frombuffer(a.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data.view(dtype).reshape(n, -1) if n else np.zeros((0, 0), dtype)


def forest(links: Callable[[np.ndarray, np.ndarray], np.ndarray], n: int, step: int = 64) -> np.ndarray:
    """Members 0..n-1 -> for each the smallest member reachable by links(rows, columns), a matrix of booleans."""
    root = np.arange(n)
    left = np.arange(n)
    while len(left) > 1:
        first, left = left[0], left[1:]
        frontier = np.array([first])
        while len(frontier) and len(left):
            now, frontier = frontier[:step], frontier[step:]
            hit = links(now, left).any(0)
            found, left = left[hit], left[~hit]
            root[found] = first
            frontier = np.concatenate([frontier, found])
    return root


def dealt(members: DataFrame) -> DataFrame:
    """Each unit whole and in order in one of as many partitions as the session shuffles to."""
    n = shuffle_partitions(members.sparkSession)
    return members.repartition(n, "g", "bi", "bj").sortWithinPartitions("g", "bi", "bj")
