"""Best-fit-decreasing packing of tokenised documents.

Best fit decreasing looks at lengths alone, and a length is at most a sequence's capacity: so the plan is made for
all documents at once from one count a length, at most `capacity` numbers whatever the rows. Open bins of one
remaining capacity are alike; a segment tree over remaining capacities finds the tightest in logarithmic time for
each run of equal documents, exactly as it would for one document after another. The plan's steps are ranges of ranks
within a length, and every piece finds its place from its rank.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import lean, materialise, without

CAPACITY = 2048


class Tightest:
    """A segment tree over remaining capacities 0..capacity: which have open bins."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.tree = np.zeros(2 * self.size, np.int64)

    def add(self, remaining: int, by: int) -> None:
        at = remaining + self.size
        while at:
            self.tree[at] += by
            at //= 2

    def find(self, length: int) -> int:
        """The least remaining capacity of at least length that has an open bin; -1 if none."""
        at = length + self.size
        while not self.tree[at]:
            while at & 1:  # a right child: what lies to the right is beyond the parent
                at //= 2
            if at == 0:
                return -1
            at += 1
        while at < self.size:
            at *= 2
            if not self.tree[at]:
                at += 1
        return at - self.size


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Pieces by length -> ([(length, first rank, pieces a bin, first sequence, offset)], sequences).

    A step places pieces of one length, from its first rank to the next step's, into bins with consecutive numbers,
    so many in each, the first of them at the offset.
    """
    tree, open_, steps, bins = Tightest(capacity), {}, [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.find(length)
            if room < 0:
                room, first, n = capacity, bins, -(-left // (capacity // length))
                bins += n
            else:
                first, n = open_[room].pop()
                tree.add(room, -1)
            each = room // length
            steps.append((length, rank, each, first, capacity - room))
            whole, part = min(n, left // each), 0
            if whole < n:
                part = left - whole * each
            for start, many, taken in ((first, whole, each), (first + whole, int(part > 0), part), (first + whole + int(part > 0), n - whole - int(part > 0), 0)):
                after = room - taken * length
                if many > 0 and after:
                    open_.setdefault(after, []).append((start, many))
                    tree.add(after, 1)
            rank += whole * each + part
            left -= whole * each + part
    return steps, bins


def tokenise(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """docs -> one row per piece: the identifier, piece, start, length, ids (little-endian unsigned 32-bit).

    Null and empty texts are the end id alone. Special tokens' strings in a text are ordinary text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                of, piece, start, length, ids = [], [], [], [], []
                for i, text in enumerate(part["_t"].to_pylist()):
                    x = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4")
                    n = len(x)
                    cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        of.append(i)
                        piece.append(k)
                        start.append(a)
                        length.append(b - a)
                        ids.append(x[a:b].tobytes())
                yield pa.RecordBatch.from_arrays([part["_i"].take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())], names=[id_col, "piece", "start", "length", "ids"])

    lean(docs.sparkSession)
    t = docs.select(F.col(id_col).alias("_i"), F.col(text_col).alias("_t"))
    kind = t.schema["_i"].dataType.simpleString()
    return t.mapInArrow(run, f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids binary")


def encoder(path: str):
    """text -> ids by the byte-level BPE in a tokenizers file; special tokens' strings count as ordinary text.

    Where the file's merges are in the order of its ids, as they are when ranks and ids agree, the same vocabulary is
    run by tiktoken, which gives the same ids several times faster; else by tokenizers itself.
    """
    if path in _encoders:
        return _encoders[path]
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab = spec["model"]["vocab"]
    special = {x["content"] for x in spec.get("added_tokens", [])}
    merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"].get("merges", [])]
    ids = [vocab.get(a + b, -1) for a, b in merges]
    before = spec.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not spec.get("normalizer") and not spec.get("post_processor")
    if plain and ids == sorted(ids) and len(vocab) - len(special & vocab.keys()) == len(set(ids)) + 256:
        # byte-level vocabularies write each byte as a printable character
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        back = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
        ranks = {bytes(back[c] for c in token): i for token, i in vocab.items() if token not in special}
        split = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        import tiktoken

        fast = tiktoken.Encoding("own", pat_str=split, mergeable_ranks=ranks, special_tokens={})

        def run(text: str) -> np.ndarray:
            return np.array(fast.encode_ordinary(text), np.uint32)
    else:
        from tokenizers import Tokenizer  # only here: both at once double a worker's memory

        own = Tokenizer.from_file(path)
        own.encode_special_tokens = True

        def run(text: str) -> np.ndarray:
            return np.array(own.encode(text, add_special_tokens=False).ids, np.uint32)

    _encoders[path] = run
    return run


_encoders: dict = {}


def pack(pieces: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ()) -> DataFrame:
    """pieces with length (1..capacity) -> with sequence_id and offset: best fit decreasing over all of them.

    Offsets are gapless from 0 in each sequence. Pieces of one length are alike to the method; their ranks follow
    `order` inside 64 lots of a hash of it, so that a length with a third of all pieces is 64 units of work. Columns
    named like an output give way. An empty table gives an empty table.
    """
    spark = pieces.sparkSession
    t = without(pieces, "sequence_id", "offset")
    by = [F.col(c) for c in order] or [F.col("length")]
    t = t.withColumn("_tg_lot", F.pmod(F.xxhash64(*by), F.lit(64)).cast("int"))
    lots = materialise(t.groupBy("length", "_tg_lot").agg(F.count("*").alias("n")))
    counts = {r[0]: r[1] for r in lots.groupBy("length").agg(F.sum("n")).collect()}  # at most `capacity` rows
    steps, _ = plan(counts, capacity)
    before = Window.partitionBy("length").orderBy("_tg_lot").rowsBetween(Window.unboundedPreceding, -1)
    lots = lots.select(F.col("length").alias("_tg_l2"), F.col("_tg_lot").alias("_tg_lot2"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_tg_from"))
    rank = F.row_number().over(Window.partitionBy("length", "_tg_lot").orderBy(*by))
    t = t.withColumn("_tg_rank", rank - 1).join(lots, (F.col("length") == F.col("_tg_l2")) & (F.col("_tg_lot") == F.col("_tg_lot2")))
    t = t.withColumn("_tg_rank", F.col("_tg_rank") + F.col("_tg_from"))
    table = np.array(sorted(steps), np.int64).reshape(-1, 5)
    held = spark.sparkContext.broadcast(table)  # of a size that depends on the capacity alone

    @F.pandas_udf("struct<sequence_id:bigint,offset:bigint>")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        s = held.value
        key = s[:, 0]
        n, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        out = np.zeros(len(n), np.int64)
        first, last = np.searchsorted(key, n, "left"), np.searchsorted(key, n, "right")
        for a in np.unique(first):
            mine = first == a
            out[mine] = a + np.searchsorted(s[a : last[mine][0], 1], r[mine], "right") - 1
        step = s[out]
        k = r - step[:, 1]
        return pd.DataFrame({"sequence_id": step[:, 3] + k // step[:, 2], "offset": step[:, 4] + k % step[:, 2] * n})

    t = t.withColumn("_tg_at", place("length", "_tg_rank"))
    t = t.withColumns({"sequence_id": F.col("_tg_at.sequence_id"), "offset": F.col("_tg_at.offset")})
    return t.select(*[c for c in t.columns if not c.startswith("_tg_")])


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """Tokenise and pack docs: one row per piece with identifier, piece, start, length, ids, ids_crc32, sequence_id,
    offset. Repeated rows are packed as often as they come. Null identifiers are packed too."""
    p = tokenise(docs, id_col, text_col, tokenizer, capacity).withColumn("ids_crc32", F.crc32("ids"))
    p = materialise(p if with_ids else p.drop("ids"))
    return pack(p, capacity, (id_col, "piece", "ids_crc32"))


def op7_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    t = pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
    return t.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
