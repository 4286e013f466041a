"""Mixing sources to target weights by Pareto order sampling.

A source's expected copies of each document are its target over its size: the whole part is certain, and the rest is
a sample of fixed size in words. Documents are ranked by random odds over inclusion odds, (U/(1-U)) / (p/(1-p)), and
taken in that order until the next one would pass the target; of those left out, the one that comes nearest to what is
then missing is added. U comes from a hash of the row and of its number among equal rows, so that reruns agree and
repeated rows are ranked apart. The rank at which a source is full comes from counts in cells of rank, refined until
the cell holds few documents, so no source is ever sorted or gathered as a whole; each document is then judged by its
source's cut alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import drop, materialise, without

OUT = ("size", "source_size", "target", "taken", "copies")
WEIGHTS, SHARE, MOST, SEED = (5.0, 2.0, 1.0), 1.5, 2.0, 7
#: Bits of a rank that each round looks at, and the documents of a cell that are looked at one by one.
BITS, FEW, ALL_BITS = 12, 4096, 52


def words(text: Column) -> Column:
    """The number of runs of anything but white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def numbered(rows: DataFrame, by: str, part: str) -> DataFrame:
    """rows with _tg_n, the number from 0 in the order of `by`, whose values lie in ascending order in parts."""
    counts = rows.groupBy(F.col(part).alias("_tg_p")).agg(F.count("*").alias("n"))
    before = Window.orderBy("_tg_p").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    counts = counts.select("_tg_p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_tg_before"))
    inside = F.row_number().over(Window.partitionBy(part).orderBy(F.asc_nulls_last(by))) - 1
    return rows.withColumn("_tg_in", inside).join(F.broadcast(counts), F.col(part) == F.col("_tg_p")).withColumn("_tg_n", F.col("_tg_in") + F.col("_tg_before")).drop("_tg_in", "_tg_p", "_tg_before", part)


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sizes (source, source_size) -> with target: weight times a level, or most times the size if that is less.

    Weights repeat over the sources by code point, null last. The level is where the targets add up to share times
    all sizes: the excess of the sources above their most is reshared by weight until none is above. Two sums a round
    reach the driver.
    """
    ranged = materialise(sizes.repartitionByRange(F.asc_nulls_last("source")).withColumn("_tg_part", F.spark_partition_id()))
    t = numbered(ranged, "source", "_tg_part")
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("_tg_n"), F.lit(len(weights))) + 1).cast("int"))
    t = materialise(t.withColumn("w", w).withColumn("cap", F.lit(float(most)) * F.col("source_size")).drop("_tg_n"))
    drop(ranged)
    total = float(t.agg(F.sum("source_size")).first()[0] or 0.0) * share
    level = full = None
    while True:
        above = F.col("cap") < F.lit(level) * F.col("w") if level is not None else F.lit(False)
        r = t.agg(F.sum(F.when(above, F.col("cap"))), F.sum(F.when(~above, F.col("w"))), F.count(F.when(above, F.lit(1)))).first()
        if r[2] == full or not r[1]:
            break
        full, level = r[2], (total - float(r[0] or 0.0)) / float(r[1])
    goal = F.least(F.col("cap"), F.lit(level) * F.col("w")) if level is not None and r[1] else F.col("cap")
    return t.select("source", "source_size", goal.cast("double").alias("target"))


def apart(rows: DataFrame, equal: DataFrame) -> DataFrame:
    """rows (..., _tg_h) with _tg_k, the number of the row among those with the same _tg_h; equal (_tg_e) has the _tg_h
    that come more than once. Rows of one _tg_h are numbered where they lie, so a hot one is no single task's."""
    if equal.isEmpty():
        return rows.withColumn("_tg_k", F.lit(0).cast("long"))
    once = rows.join(equal, F.col("_tg_h") == F.col("_tg_e"), "left_anti").withColumn("_tg_k", F.lit(0).cast("long"))
    many = materialise(rows.join(equal, F.col("_tg_h") == F.col("_tg_e"), "left_semi").withColumn("_tg_row", F.monotonically_increasing_id()))
    many = many.withColumn("_tg_part", F.shiftright("_tg_row", 33))
    before = Window.partitionBy("_tg_bh").orderBy("_tg_bp").rowsBetween(Window.unboundedPreceding, -1)
    counts = many.groupBy(F.col("_tg_h").alias("_tg_bh"), F.col("_tg_part").alias("_tg_bp")).agg(F.count("*").alias("n"))
    counts = counts.select("_tg_bh", "_tg_bp", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_tg_before"))
    many = many.withColumn("_tg_k", F.row_number().over(Window.partitionBy("_tg_h", "_tg_part").orderBy("_tg_row")) - 1)
    many = many.join(counts, (F.col("_tg_h") == F.col("_tg_bh")) & (F.col("_tg_part") == F.col("_tg_bp")))
    many = many.withColumn("_tg_k", F.col("_tg_k") + F.col("_tg_before"))
    return once.unionByName(many.drop("_tg_row", "_tg_part", "_tg_bh", "_tg_bp", "_tg_before"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str | None = "text", seed: int = SEED, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The rows of docs with size, source_size, target, taken and copies: how often the mix takes the document.

    A document is taken whole, at most ceil(most) times; taken is size times copies. The last document that a source
    takes is the one place where size decides, not rank: of those left out, the one nearest to what is missing, if that
    helps (ties by rank), so a source ends within half of some document of its target. Null sources are one source;
    empty and null texts have size 0 and add nothing. Rows alike in identifier, source and text are ranked apart by
    their number among their like; which of them has which number is arbitrary. An empty table gives an empty table.
    Columns named like an output give way. With text_col None, docs already has size.
    """
    if text_col:
        t = without(docs, *OUT).withColumn("size", words(F.col(text_col)))
    else:
        t = without(docs, *[c for c in OUT if c != "size"])
    columns = t.columns
    t = t.withColumns({"_tg_src": F.col(source_col), "_tg_id": F.col(id_col).cast("string"), "_tg_h": F.xxhash64(id_col, source_col, "size", *([text_col] if text_col else []))})
    t = materialise(t)  # so that words are counted once
    light = t.select("_tg_src", "_tg_id", "size", "_tg_h")
    goals = targets(light.groupBy(F.col("_tg_src").alias("source")).agg(F.sum("size").cast("double").alias("source_size")), weights, share, most)
    r = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = goals.withColumn("_tg_whole", F.floor(r).cast("int")).withColumn("_tg_p", r - F.col("_tg_whole")).withColumn("_tg_rest", F.col("target") - F.col("_tg_whole") * F.col("source_size"))
    plan = materialise(plan.withColumnRenamed("source", "_tg_s"))
    equal = materialise(light.groupBy("_tg_h").agg(F.count("*").alias("n")).where("n > 1").select(F.col("_tg_h").alias("_tg_e")))

    def ranked(x: DataFrame, of: DataFrame) -> DataFrame:
        # a row a source: Spark broadcasts it if its measured size allows, and splits a hot source if not
        x = apart(x, equal).join(of, F.col("_tg_src").eqNullSafe(F.col("_tg_s")))
        name = F.concat_ws(",", F.coalesce("_tg_id", F.lit("~")), F.coalesce("_tg_src", F.lit("~")), F.col("size").cast("string"), F.col("_tg_k").cast("string"), F.lit(str(seed)))
        u = (F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))
        odds = (u / (1 - u)) / (F.col("_tg_p") / (1 - F.col("_tg_p")))
        x = x.withColumn("_tg_q", F.when(F.col("_tg_p") > 0, odds / (1 + odds)))
        return x.withColumn("_tg_at", F.floor(F.col("_tg_q") * F.lit(float(1 << ALL_BITS))).cast("long"))

    rows = materialise(ranked(light, plan.select("_tg_s", "_tg_p", "_tg_rest")).where("_tg_q IS NOT NULL").select("_tg_src", "size", "_tg_h", "_tg_k", "_tg_q", "_tg_at", "_tg_rest"))
    # the cell of rank in which each source fills up; sources that never do have none
    shift, inside, cut = ALL_BITS, rows.withColumn("_tg_below", F.lit(0).cast("long")), None
    while cut is None or (shift > 0 and (cut.agg(F.max("in_cell")).first()[0] or 0) > FEW):
        shift = max(0, shift - BITS)
        cell = F.shiftright("_tg_at", shift)
        cells = inside.groupBy("_tg_src", cell.alias("cell")).agg(F.sum("size").alias("words"), F.count("*").alias("in_cell"), F.first("_tg_rest").alias("rest"), F.first("_tg_below").alias("before"))
        upto = F.col("before") + F.sum("words").over(Window.partitionBy("_tg_src").orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        cells = cells.withColumn("upto", upto).where(F.col("upto") > F.col("rest"))
        cells = cells.groupBy("_tg_src").agg(F.min(F.struct("cell", (F.col("upto") - F.col("words")).alias("below"), "in_cell")).alias("c"))
        cut = materialise(cells.select(F.col("_tg_src").alias("_tg_s2"), F.col("c.cell").alias("_tg_cell"), F.col("c.below").alias("_tg_below"), F.col("c.in_cell").alias("in_cell")))
        inside = rows.join(cut, F.col("_tg_src").eqNullSafe(F.col("_tg_s2")) & (cell == F.col("_tg_cell")))
    key = F.struct("_tg_q", "_tg_h", "_tg_k")
    run = F.col("_tg_below") + F.sum("size").over(Window.partitionBy("_tg_src").orderBy("_tg_q", "_tg_h", "_tg_k").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = inside.withColumn("run", run).where(F.col("run") <= F.col("_tg_rest")).groupBy("_tg_src").agg(F.max(F.struct(key.alias("key"), "run")).alias("l"))
    last = last.select(F.col("_tg_src").alias("_tg_s3"), F.col("l.key").alias("_tg_last"), F.col("l.run").alias("_tg_run"))
    cut = materialise(cut.join(last, F.col("_tg_s2").eqNullSafe(F.col("_tg_s3")), "left").select("_tg_s2", "_tg_cell", "_tg_last", F.coalesce("_tg_run", "_tg_below").alias("_tg_got")))
    taken = (F.shiftright("_tg_at", shift) < F.col("_tg_cell")) | F.coalesce((F.shiftright("_tg_at", shift) == F.col("_tg_cell")) & (key <= F.col("_tg_last")), F.lit(False))
    # of those left out, the one nearest to what is missing
    left = rows.join(cut, F.col("_tg_src").eqNullSafe(F.col("_tg_s2"))).where(~taken & (F.col("size") > 0))
    miss = F.col("_tg_rest") - F.col("_tg_got")
    off = F.abs(miss - F.col("size"))
    more = left.where(off < miss).groupBy("_tg_src").agg(F.min(F.struct(off.alias("off"), key.alias("key"))).alias("m"))
    cut = cut.join(more.select(F.col("_tg_src").alias("_tg_s4"), F.col("m.key").alias("_tg_more")), F.col("_tg_s2").eqNullSafe(F.col("_tg_s4")), "left")
    plan = plan.join(cut.select("_tg_s2", "_tg_cell", "_tg_last", "_tg_more"), F.col("_tg_s").eqNullSafe(F.col("_tg_s2")), "left").drop("_tg_s2")
    plan = materialise(plan)
    x = ranked(t, plan)
    more = F.coalesce(key == F.col("_tg_more"), F.lit(False))
    x = x.withColumn("copies", F.col("_tg_whole") + (F.col("_tg_q").isNotNull() & (F.col("_tg_cell").isNull() | taken | more)).cast("int"))
    x = x.withColumn("taken", F.col("size") * F.col("copies"))
    return x.select(*[F.col(f"`{c}`") for c in columns], "source_size", "target", "taken", "copies")


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    light = materialise(docs.select("doc_id", "source", words(F.col("text")).alias("size")))
    return mix(light, text_col=None).select("doc_id", "size", "source_size", "target", "taken", "copies")


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::DOUBLE AS source_size,
         [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w
  FROM d GROUP BY source
), c AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
         coalesce(sum(2.0::DOUBLE * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_w,
         sum(source_size) OVER () * 1.5::DOUBLE AS total
  FROM s WINDOW o AS (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST)
), l AS (
  SELECT arg_min((total - capped) / rest_w, cap / w) AS level FROM c WHERE cap >= (total - capped) / rest_w * w
), p AS (
  SELECT source, source_size, coalesce(least(cap, level * w), cap)::DOUBLE AS target FROM c, l
), g AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END::DOUBLE AS r FROM p
), h AS (
  SELECT *, floor(r)::INT AS whole, r - floor(r) AS pr, target - floor(r) * source_size AS rest FROM g
), k AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, source, size) - 1 AS k FROM d
), u AS (
  SELECT k.*, h.source_size, h.target, h.whole, h.rest, h.pr,
         (CAST('0x' || substr(md5(concat_ws(',', coalesce(doc_id::VARCHAR, '~'), coalesce(k.source, '~'), size::VARCHAR, k::VARCHAR, '7')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM k JOIN h ON k.source IS NOT DISTINCT FROM h.source
), q AS (
  SELECT *, CASE WHEN pr > 0 THEN (u / (1 - u)) / (pr / (1 - pr)) END AS odds FROM u
), o AS (
  SELECT *, odds / (1 + odds) AS q, sum(size) OVER (PARTITION BY source, odds IS NULL ORDER BY odds / (1 + odds) ROWS UNBOUNDED PRECEDING) AS run FROM q
), b AS (
  -- taken in order of rank until the next document would pass what is wanted
  SELECT *, q IS NOT NULL AND NOT coalesce(bool_or(run > rest) OVER (PARTITION BY source, odds IS NULL ORDER BY q ROWS UNBOUNDED PRECEDING), false) AS taken_in FROM o
), m AS (
  SELECT source, max(rest) - coalesce(sum(size) FILTER (WHERE taken_in), 0) AS miss FROM b WHERE q IS NOT NULL GROUP BY source
), x AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.source, (q IS NOT NULL AND NOT taken_in AND size > 0 AND abs(miss - size) < miss) ORDER BY abs(miss - size), q) = 1
              AND q IS NOT NULL AND NOT taken_in AND size > 0 AND abs(miss - size) < miss AS more
  FROM b LEFT JOIN m ON b.source IS NOT DISTINCT FROM m.source
)
SELECT doc_id, size, source_size, target, size * (whole + (taken_in OR coalesce(more, false))::INT) AS taken,
       whole + (taken_in OR coalesce(more, false))::INT AS copies
FROM x
"""
