"""Sharding by histogram sort, in DataFrame operations only.

The key is (64-bit hash of the text, identifier): shards are shuffled ranges and copies of a text stay together but
where a splitter runs through them. Each round counts the exact bytes in the cells between evenly spaced probes
inside the intervals that still hold a splitter, and refines those intervals, until what an interval holds is within
the tolerance. The rows move once, after the splitters are known.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialise, without

OUT = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
#: Probes of the first round, and of each interval in later ones.
FIRST, PROBES = 4096, 512
TOP = 1 << 62
#: Below or at any identifier; also stands for a null one.
LEAST = -(1 << 63)


@dataclass(frozen=True)
class Splitter:
    """Rows with (h, d) >= (hash, doc) lie at or after the splitter."""

    hash: int
    doc: int


def _whole(n: int) -> Column:
    return F.lit(str(n)).cast("decimal(20,0)")


def _d(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("decimal(20,0)"), _whole(LEAST))


def find_splitters(keys: DataFrame, shards: int, tolerance: float = 0.0) -> list[Splitter]:
    """keys (_tg_h, _tg_d, size) -> shards - 1 splitters. Splitter i is the first key with at least i/shards of all
    bytes below it; with a tolerance, a key whose bytes below are within tolerance times a shard's of that.

    What reaches the driver is at most shards * PROBES counts a round. The rounds are about log(rows) / log(PROBES).
    """
    total = keys.agg(F.sum("size")).first()[0] or 0
    want = [-(-i * total // shards) for i in range(1, shards)]
    if not total:
        return [Splitter(TOP, LEAST)] * (shards - 1)
    slack = tolerance * total / shards
    found: dict[int, Splitter] = {}
    # an interval: (level, hash, low, high, bytes below low); level 0 divides hashes, level 1 identifiers of one hash
    open_: dict[tuple, list[int]] = {(0, 0, 0, TOP, 0): list(range(len(want)))}
    first = True
    while open_:
        k = FIRST if first else PROBES
        first = False
        cell, live, steps = None, [], {}
        for at, (level, h, low, high, below) in enumerate(open_):
            step = -(-(high - low) // k)
            steps[at] = step
            if level == 0:
                inside = (F.col("_tg_h") >= low) & (F.col("_tg_h") < high)
                index = F.expr(f"(_tg_h - {low}L) div {step}L")
            else:
                inside = (F.col("_tg_h") == h) & (F.col("_tg_d") >= _whole(low)) & (F.col("_tg_d") < _whole(high))
                index = F.floor((F.col("_tg_d") - _whole(low)).cast("decimal(21,0)") / _whole(step)).cast("long")
            value = index + F.lit(at * (k + 1))
            cell = F.when(inside, value) if cell is None else cell.when(inside, value)
            live.append((level, h, low, high, below))
        counts = keys.select(cell.alias("cell"), "size", "_tg_h", "_tg_d").where("cell IS NOT NULL").groupBy("cell").agg(F.sum("size"), F.min("_tg_h"), F.max("_tg_h"), F.min("_tg_d"), F.max("_tg_d")).orderBy("cell").collect()
        by: dict[int, list] = {}
        for r in counts:
            by.setdefault(r[0] // (k + 1), []).append(r)
        nxt: dict[tuple, list[int]] = {}
        for at, interval in enumerate(live):
            level, h, low, high, below = interval
            cells, targets = by.get(at, []), open_[interval]
            for i in targets:
                run = below
                for r in cells:
                    if run >= want[i]:  # the first key of this cell has enough below it
                        found[i] = Splitter(r[2], LEAST) if level == 0 else Splitter(h, int(r[4]))
                        break
                    if run + r[1] > want[i]:  # the splitter is inside this cell, or the key after it
                        lo_h, hi_h, lo_d, hi_d = r[2], r[3], int(r[4]), int(r[5])
                        if (lo_h == hi_h and lo_d == hi_d) or (level == 1 and r[1] <= slack):
                            found[i] = Splitter(hi_h, hi_d + 1)
                        elif level == 0 and r[1] <= slack:
                            found[i] = Splitter(hi_h + 1, LEAST)
                        elif level == 1 or lo_h == hi_h:
                            nxt.setdefault((1, lo_h, lo_d, hi_d + 1, run), []).append(i)
                        else:
                            nxt.setdefault((0, 0, lo_h, hi_h + 1, run), []).append(i)
                        break
                    run += r[1]
                else:
                    found[i] = Splitter(high, LEAST) if level == 0 else Splitter(h, high)
        open_ = nxt
    return [found[i] for i in range(len(want))]


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str | None = "text", tolerance: float = 0.0) -> DataFrame:
    """The rows of docs with size, text_crc32, law ('bytes'), shard, slot and grown_shard (null under this law).

    size is the text's UTF-8 bytes plus 8; a null text has no bytes and the checksum 0 of an empty one. A row's shard
    is the number of splitters at or below its key, so shards differ by no more than about a row's size; equal keys
    (repeated rows) share a shard. Slots count from 0 in each shard without gaps. A null identifier sorts first. An
    empty table gives an empty table. Columns named like an output give way. The checksum, size and hash columns can
    come precomputed: with text_col None, docs has them as size, text_crc32 and _tg_h.
    """
    if text_col is None:
        base = docs
    else:
        x = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
        base = without(docs, *OUT).withColumns({"size": F.octet_length(x).cast("long") + 8, "text_crc32": F.crc32(x), "_tg_h": F.shiftrightunsigned(F.xxhash64(x), 2)})
    keys = base.select("_tg_h", _d(id_col).alias("_tg_d"), "size")
    cuts = find_splitters(keys, shards, tolerance)
    d = _d(id_col)
    # one row in 4,096 cells of hash, dealt to 16 by identifier: a text with a third of the rows is 16 units of work
    cell = F.shiftrightunsigned("_tg_h", 50)
    salt = F.pmod(F.xxhash64(F.col(id_col)), F.lit(16))

    def shard_of():
        out = F.lit(0)
        for c in cuts:
            past = (F.col("_tg_h") > F.lit(c.hash)) | ((F.col("_tg_h") == F.lit(c.hash)) & (d >= _whole(c.doc)))
            out = out + past.cast("int")
        return out

    placed = base.withColumn("shard", shard_of()).withColumns({"_tg_c": cell, "_tg_s": salt})
    units = placed.groupBy("shard", "_tg_c", "_tg_s").agg(F.count("*").alias("n"))
    # counts of cells, 65,536 + 16 * shards rows at most, whatever the rows
    before = Window.partitionBy("shard").orderBy("_tg_c", "_tg_s").rowsBetween(Window.unboundedPreceding, -1)
    units = units.select(F.col("shard").alias("_u0"), F.col("_tg_c").alias("_u1"), F.col("_tg_s").alias("_u2"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_tg_from"))
    rank = F.row_number().over(Window.partitionBy("shard", "_tg_c", "_tg_s").orderBy("_tg_h", d))
    t = placed.withColumn("_tg_r", rank).join(F.broadcast(units), (F.col("shard") == F.col("_u0")) & (F.col("_tg_c") == F.col("_u1")) & (F.col("_tg_s") == F.col("_u2")))
    t = t.withColumns({"law": F.lit("bytes"), "slot": F.col("_tg_from") + F.col("_tg_r") - 1, "grown_shard": F.lit(None).cast("int")})
    return t.drop("_u0", "_u1", "_u2", "_tg_from", "_tg_r", "_tg_c", "_tg_s", "_tg_h")


def op4_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    x = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    light = materialise(docs.select("doc_id", (F.octet_length(x).cast("long") + 8).alias("size"), F.crc32(x).alias("text_crc32"), F.shiftrightunsigned(F.xxhash64(x), 2).alias("_tg_h")))
    t = shard_documents(light, 24, text_col=None)
    return t.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
