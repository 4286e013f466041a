"""N-gram Jaccard join by MinHash banding, for documents (op 9) and paragraphs (op 8).

Texts with equal n-gram sets are one class from the start. Band and row counts come from the recall wanted at the
threshold. Colliding texts are compared inside their bucket by whole signatures, generously; what hangs together so is
a candidate class, whose members' full n-gram sets then meet in one place (or in pairs of blocks, if they are many)
for the exact comparison. Signatures, not texts, are copied per band; each text with a candidate partner moves once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .caps import _take, unit_counts
from .graph import components
from .groups import BLOCK, block_pairs, dealt, forest, rows_of, units
from .scratch import lean, materialise, without

N_GRAM, THRESHOLD, RECALL = 5, 0.8, 0.9999
#: Bytes of texts that are hashed in one go, about; a worker's memory is some fifty times that.
LOT = 1 << 19
#: Bytes of texts that one block of a candidate class has, about; classes of long texts are cut into more blocks.
BLOCK_BYTES = 1 << 26
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def banding(threshold: float, recall: float, most: int = 160) -> tuple[int, int]:
    """(bands, rows): with at most so many hashes in all, the most rows a band that reach the recall."""
    best = (most, 1)
    for rows in range(1, 12):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= most:
            best = (bands, rows)
    return best


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _inverse(a: int) -> int:
    return pow(a, -1, 1 << 64)


_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        n = 1 << max(16, (n - 1).bit_length())
        for name, base in (("up", int(_BASE)), ("down", _inverse(int(_BASE)))):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["up"], _powers["down"]


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes -> (64-bit hash, start) of each run of anything but white space."""
    gap = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), start
    up, down = _power(len(data) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)])
    return _mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)), start


def shingles(texts: list[bytes], n: int = N_GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Texts -> all n-gram hashes one text after another, and where each text's begin (one more entry at the end).

    A text of fewer than n words has one n-gram, all of its words; one without words has none.
    """
    joined = np.frombuffer(b"\n".join(texts), np.uint8)
    begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    w, at = word_hashes(joined)
    first = np.searchsorted(at, begin)
    count = np.diff(first)
    if not len(w):
        return w, np.zeros(len(texts) + 1, np.int64)
    full = len(w) - n + 1
    g = np.zeros(len(w), np.uint64)
    if full > 0:
        s = np.zeros(full, np.uint64)
        for k in range(n):
            s = s * np.uint64(0xD6E8FEB86659FD93) + w[k : k + full]
        g[:full] = _mix(s)
    keep = np.ones(len(w), bool)
    for m in range(1, n):  # texts of fewer words
        at = first[:-1][count == m]
        s = np.full(len(at), m, np.uint64)
        for k in range(m):
            s = s * np.uint64(0xD6E8FEB86659FD93) + w[at + k]
            if k:
                keep[at + k] = False
        g[at] = _mix(s)
    for k in range(1, n):  # n-grams that would run into the next text
        last = first[1:] - k
        keep[last[count >= n]] = False
    sizes = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    return g[keep], np.concatenate([[0], np.cumsum(sizes)])


def signatures(g: np.ndarray, at: np.ndarray, bands: int, rows: int, seed: int = 9) -> np.ndarray:
    """N-grams of texts that all have some -> matrix of bands * rows 32-bit minima."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    b = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint64).astype(np.uint32)
    x = (g >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(at) - 1, bands * rows), np.uint32)
    for k in range(bands * rows):
        out[:, k] = np.minimum.reduceat(x * a[k] + b[k], at[:-1])
    return out


def _sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    g, at = shingles(texts, n)
    return [np.unique(g[lo:hi]) for lo, hi in zip(at[:-1], at[1:], strict=False)]


def signed(rows_df: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """rows_df (row columns..., _tg_text binary) -> row columns, node (null where there is no word), sig, keys.

    node stands for the set of n-grams; sig is the signature in 16-bit words, keys the bands' hashes.
    """
    from pyspark.sql import types as T

    names = [c for c in rows_df.columns if c != "_tg_text"]
    schema = T.StructType([rows_df.schema[c] for c in names] + [T.StructField("node", T.BinaryType()), T.StructField("sig", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            texts = [x if x is not None else b"" for x in batch["_tg_text"].to_pylist()]
            lo = 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi]) < LOT):
                    size += len(texts[hi])
                    hi += 1
                part = batch.slice(lo, hi - lo)
                g, at = shingles(texts[lo:hi], n)
                some = np.flatnonzero(np.diff(at))
                node, sig, keys = [None] * (hi - lo), [None] * (hi - lo), [None] * (hi - lo)
                if len(some):
                    s = signatures(g, at[np.append(some, some[-1] + 1)], bands, rows)
                    band = s.reshape(len(some), bands, rows).astype(np.uint64)
                    h = np.zeros((len(some), bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
                    for r in range(rows):
                        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + band[:, :, r] + np.uint64(1))
                    small = (s >> np.uint32(16)).astype("<u2")
                    for k, i in enumerate(some):
                        node[i] = xxhash.xxh3_128_digest(np.unique(g[at[i] : at[i + 1]]).tobytes())
                        sig[i] = small[k].tobytes()
                        keys[i] = h[k].view(np.int64)
                yield pa.RecordBatch.from_arrays([part[c] for c in names] + [pa.array(node, pa.binary()), pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=schema.names)
                lo = hi

    return rows_df.mapInArrow(run, schema)


def candidate_classes(reps: DataFrame, bands: int, rows: int, threshold: float) -> DataFrame:
    """reps (node, sig, keys), one row a node -> (node, label): classes linked by band collisions and signatures.

    Two texts hang together if they collide in a band and their signatures agree no more than five standard errors
    less than texts at the threshold would; labels exist only for nodes with such a partner.
    """
    hashes = bands * rows
    least = math.floor(hashes * (threshold - 5 * math.sqrt(threshold * (1 - threshold) / hashes)))
    listed = reps.select(F.explode("keys").alias("g"), "node")
    sizes = listed.groupBy("g").agg(F.count("*").alias("n")).where("n > 1")
    members = block_pairs(materialise(listed.join(sizes, "g")))
    # the signature joins in after the texts without a partner are gone
    members = members.join(reps.select("node", "sig"), "node")

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in units(batches):
            x = rows_of(t["sig"], "<u2")
            size = np.diff(starts)
            two = starts[:-1][size == 2]
            hit = two[(x[two] == x[two + 1]).sum(1) >= least]
            src, dst = [hit + 1], [hit]
            for a, n in zip(starts[:-1][size > 2], size[size > 2], strict=False):
                own = x[a : a + n]
                root = forest(lambda r, c, own=own: (own[r][:, None, :] == own[c][None, :, :]).sum(2) >= least, n, 16)
                at = np.flatnonzero(root != np.arange(n))
                src.append(at + a)
                dst.append(root[at] + a)
            nodes = t["node"].combine_chunks()
            yield pa.RecordBatch.from_arrays([_take(nodes, np.concatenate(src)), _take(nodes, np.concatenate(dst))], names=["src", "dst"])

    found = dealt(members.select("g", "bi", "bj", "node", "sig")).mapInArrow(edges, "src binary, dst binary")
    return materialise(components(found))


def overlaps(sets: list[np.ndarray], width: int = 2048) -> np.ndarray:
    """Sizes of all intersections, exactly: products of membership columns, those of one member left out."""
    n = len(sets)
    member = np.repeat(np.arange(n), [len(s) for s in sets])
    value, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1
    keep = count[column] > 1
    member, column = member[keep], shared[column[keep]]
    out = np.zeros((n, n), np.float32)
    order = np.argsort(column, kind="stable")
    member, column = member[order], column[order]
    top = int(column[-1]) + 1 if len(column) else 0
    for lo in range(0, top, width):
        a, b = np.searchsorted(column, [lo, lo + width])
        m = np.zeros((n, width), np.float32)
        m[member[a:b], column[a:b] - lo] = 1
        out += m @ m.T
    return out


def exact_links(texts: DataFrame, n: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """texts (node, copies, g, n, text binary), g the candidate class -> (links (src, dst) as forests, counts (node, n))."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in units(batches):
            for a, b in zip(starts[:-1], starts[1:], strict=False):
                u = t.slice(a, b - a)
                sets = _sets(u["text"].to_pylist(), n)
                size = np.array([len(s) for s in sets], float)
                both = overlaps(sets).astype(float)
                near = both / (size[:, None] + size[None, :] - both) >= threshold - 1e-9
                links = lambda r, c, near=near: near[np.ix_(r, c)]
                root = forest(links, b - a)
                nodes = u["node"].combine_chunks()
                yield pa.RecordBatch.from_arrays([_take(nodes, np.arange(b - a)), _take(nodes, root), pa.array(unit_counts(links, u))], names=["src", "dst", "n"])

    work = dealt(block_pairs(texts).select("g", "bi", "bj", "own", "node", "copies", "text"))
    kind = texts.schema["node"].dataType.simpleString()
    out = materialise(work.mapInArrow(compare, f"src {kind}, dst {kind}, n bigint"))
    return out.select("src", "dst"), out.groupBy(F.col("src").alias("node")).agg(F.sum("n").alias("links"))


OUT = ("class_id", "n_links", "kept")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N_GRAM, threshold: float = THRESHOLD, recall: float = RECALL, carry: list[str] | None = None) -> DataFrame:
    """The rows of docs with class_id, n_links and kept; of docs' columns those in carry, all of them by default.

    Texts link if the Jaccard similarity of their sets of word n-grams is the threshold or more; words are runs of
    anything but white space, a text of fewer than n words has one n-gram. n_links counts the other rows a row links
    with, copies included; class_id is the smallest identifier that links lead to; exactly one row of a class is kept,
    one with that identifier. Null texts and those without words link with nothing and stay; their class_id is their
    own identifier. Null identifiers count as larger than any other. Repeated rows are copies. An empty table gives an
    empty table; outputs replace columns named like them.
    """
    lean(docs.sparkSession)
    bands, rows = banding(threshold, recall)
    base = without(docs, *OUT)
    carry = [c for c in (base.columns if carry is None else carry) if c.lower() not in OUT]
    text = F.encode(F.col(text_col), "UTF-8")
    mark = F.xxhash64(F.col(text_col))
    own = {f"_tg_c{k}": base[f"`{c}`"] for k, c in enumerate(carry)}
    every = base.select(*[c.alias(k) for k, c in own.items()], F.col(id_col).alias("id"), mark.alias("mark"), F.monotonically_increasing_id().alias("row"), F.octet_length(F.col(text_col)).cast("long").alias("size"), text.alias("_tg_text"))
    every = materialise(signed(every, n, bands, rows))
    light = every.where("node IS NOT NULL").select("node", F.struct(F.col("id").isNull().alias("no"), "id", "row", "mark").alias("r"), "sig", "keys", "size")
    reps = materialise(light.groupBy("node").agg(F.min("r").alias("r"), F.count("*").alias("copies"), F.first("sig").alias("sig"), F.first("keys").alias("keys"), F.max("size").alias("size")))
    labels = candidate_classes(reps, bands, rows, threshold)
    known = labels.join(reps.select("node", "r", "copies", "size"), "node")
    # as many blocks as members and their bytes ask for
    of = known.groupBy("label").agg(F.greatest(F.count("*"), F.ceil(F.sum("size") * F.lit(BLOCK / BLOCK_BYTES))).alias("n"))
    want = known.join(of, "label").select("node", "copies", "n", F.col("label").alias("g"), F.col("r.id").alias("w_id"), F.col("r.mark").alias("w_mark"))
    source = base.select(F.col(id_col).alias("s_id"), mark.alias("s_mark"), text.alias("text"))
    # rows with the same identifier and text are alike; one of them is enough
    met = source.join(want, source["s_id"].eqNullSafe(want["w_id"]) & (source["s_mark"] == want["w_mark"])).select("node", "copies", "n", "g", "text")
    links, counts = exact_links(met.dropDuplicates(["node"]), n, threshold)
    label = materialise(components(links))
    final = reps.select("node", "copies", "r").join(label, "node", "left").join(counts, "node", "left")
    final = final.select("node", "r", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("label", "node").alias("label"))
    best = final.groupBy("label").agg(F.min("r").alias("best"))
    final = final.join(best, "label").select(F.col("node").alias("f_node"), F.col("best.id").alias("class_id"), F.col("best.row").alias("best_row"), "n_links")
    t = every.join(final, every["node"] == final["f_node"], "left")
    return t.select(
        *[F.col(k).alias(c) for k, c in zip(own, carry, strict=True)],
        F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        (F.col("node").isNull() | (F.col("row") == F.col("best_row"))).alias("kept"),
    )


def op9_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), carry=["doc_id"])


OP9_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT DISTINCT r, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS gram FROM d WHERE len(w) > 0
), n AS (
  SELECT r, count(*) AS n FROM g GROUP BY r
), meet AS (
  SELECT x.r AS a, y.r AS b, count(*) AS k FROM g x JOIN g y ON x.gram = y.gram AND x.r <> y.r GROUP BY 1, 2
), link AS (
  SELECT a, b FROM meet JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE k >= 0.8 * (x.n + y.n - k) - 1e-9
), reach AS (
  SELECT r AS a, r AS b FROM d UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
), least AS (
  SELECT a, min(d.doc_id) AS class_id FROM reach JOIN d ON d.r = b GROUP BY a
), many AS (
  SELECT a, count(*) AS n FROM link GROUP BY a
)
SELECT doc_id, class_id, coalesce(n, 0)::BIGINT AS n_links, len(w) = 0 OR doc_id IS NOT DISTINCT FROM class_id AS kept
FROM d JOIN least ON least.a = r LEFT JOIN many ON many.a = r
"""
