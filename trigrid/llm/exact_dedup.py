"""Exact dedup by content sort.

Sampled splitters deal the normalised texts into ranges, an external sort in each range places equal texts next to
each other, and full comparisons of neighbours mark runs. The range key is (leading characters, 64-bit hash of the
whole text, identifier): whole texts as splitters would bring too much to the driver, and a text with a third of all
rows must be cut into many ranges. The parts of a text that lie in several ranges can only touch the ends of ranges;
they, and runs too long to be held at once, are put together by comparing one whole text of each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import lean, materialise, without

SPACE = r"[\x20\x09-\x0D]+"
OUT = ("keep_id", "group_size", "kept", "text_sha256")
#: Leading characters in the range key; the hash after them makes the key as good as the whole text.
LEAD = 64
#: Bytes of one text's rows that a task holds before it passes them on as a run of their own.
HELD = 1 << 24


def normalised(text: str):
    """The text with every run of white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE, " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs, with its columns and keep_id, group_size, kept, text_sha256.

    Texts are equal when equal after white-space normalisation. keep_id is the smallest identifier of the group and
    exactly one row of a group is kept: of rows with that identifier, any one, for repeated rows are alike. Null and
    empty texts are one group. Null identifiers come last: keep_id is null only if the whole group's are. An empty
    table gives an empty table. Columns named like an output give way to it. A task holds about HELD bytes of rows.
    """
    lean(docs.sparkSession)
    base = without(docs, *(c for c in OUT if c.lower() not in (id_col.lower(), text_col.lower())))
    carried = base.columns
    t = base.withColumns({"_tg_id": F.col(id_col), "_tg_norm": normalised(text_col)})
    t = t.withColumns({"_tg_lead": F.substring("_tg_norm", 1, LEAD), "_tg_h": F.xxhash64("_tg_norm")})
    last = F.asc_nulls_last("_tg_id")
    t = t.repartitionByRange("_tg_lead", "_tg_h", last).sortWithinPartitions("_tg_lead", "_tg_h", "_tg_norm", last)
    t = t.withColumn("_tg_sha", F.sha2(F.encode("_tg_norm", "UTF-8"), 256))
    id_type = t.schema["_tg_id"].dataType
    out = T.StructType([t.schema[c] for c in carried] + [T.StructField("_tg_sha", T.StringType()), T.StructField("_tg_keep", id_type), T.StructField("_tg_n", T.LongType()), T.StructField("_tg_first", T.BooleanType()), T.StructField("_tg_run", T.LongType()), T.StructField("_tg_text", T.StringType())])

    limit = HELD

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held, opening, broken, many = TaskContext.get().partitionId(), [], None, None, 0

        def give(x: pa.Table, tail: bool) -> pa.RecordBatch:
            """Whole runs, but those that other tables hold parts of: the first and the last of the range, broken ones."""
            nonlocal opening, many
            n = x.num_rows
            h = np.asarray(x["_tg_h"])
            norm = x["_tg_norm"].combine_chunks()
            norm = norm.chunk(0) if isinstance(norm, pa.ChunkedArray) else norm
            new = np.ones(n, bool)
            new[1:] = ~np.asarray(pc.equal(norm.slice(1), norm.slice(0, n - 1)))
            starts = np.flatnonzero(new)
            sizes = np.diff(np.append(starts, n))
            of = np.repeat(np.arange(len(starts)), sizes)
            opening = h[0] if opening is None else opening
            edge = (h == opening) | ((h == h[-1]) if tail else False) | ((h == broken) if broken is not None else False)
            keep = x["_tg_id"].take(pa.array(starts)).take(pa.array(of)).combine_chunks()
            text = pc.if_else(pa.array(edge & new), norm, pa.scalar(None, norm.type))
            cols = [x[c].combine_chunks() for c in (*carried, "_tg_sha")] + [keep, pa.array(sizes[of]), pa.array(new), pa.array((part << 32) + many + of), text.cast(pa.string())]
            many += len(starts)
            cols = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in cols]
            return pa.RecordBatch.from_arrays(cols, names=out.names)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            h = np.asarray(batch["_tg_h"])
            turn = np.flatnonzero(h != h[-1])
            if not len(turn) and (len(held) == 1 or held[-2]["_tg_h"][-1].as_py() == h[-1]):
                if sum(b.nbytes for b in held) >= limit:
                    broken = h[-1]
                    yield give(pa.Table.from_batches(held).combine_chunks(), False)
                    held = []
                continue
            x = pa.Table.from_batches(held)
            cut = x.num_rows - (len(h) - (int(turn[-1]) + 1 if len(turn) else 0))
            if cut:
                yield give(x.slice(0, cut).combine_chunks(), False)
            held = x.slice(cut).to_batches()
        if held:
            yield give(pa.Table.from_batches(held).combine_chunks(), True)

    parts = materialise(t.select(*carried, "_tg_sha", "_tg_norm", "_tg_h", "_tg_id").mapInArrow(runs, out))
    # a few rows a range and one for each HELD bytes of a broken run: equal by their whole texts
    ends = parts.where("_tg_text IS NOT NULL").groupBy("_tg_text").agg(F.min("_tg_keep").alias("_tg_k"), F.sum("_tg_n").alias("_tg_all"), F.min("_tg_run").alias("_tg_first_run"), F.collect_list("_tg_run").alias("runs"))
    ends = ends.select("_tg_k", "_tg_all", "_tg_first_run", F.explode("runs").alias("_tg_r"))
    j = parts.join(F.broadcast(ends), F.col("_tg_run") == F.col("_tg_r"), "left")
    return j.select(
        *[F.col(f"`{c}`") for c in carried],
        F.when(F.col("_tg_r").isNull(), F.col("_tg_keep")).otherwise(F.col("_tg_k")).alias("keep_id"),
        F.coalesce("_tg_all", "_tg_n").alias("group_size"),
        (F.col("_tg_first") & (F.coalesce("_tg_first_run", "_tg_run") == F.col("_tg_run"))).alias("kept"),
        F.col("_tg_sha").alias("text_sha256"),
    )


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    t = exact_dedup(docs)
    return t.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP3_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS LAST) = 1 AS kept,
       sha256(norm) AS text_sha256
FROM t
"""
