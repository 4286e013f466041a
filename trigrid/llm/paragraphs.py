"""Substring dedup by paragraph MinHash banding.

A paragraph is a line, or a part of one: lines are also cut at content-defined places, where a word pair's hash is the
least among those of the SIDE pairs before and after it, so that a passage inside a longer line is cut in the same
places wherever it stands, but for its ends. All that decides a cut lies in its line, and a paragraph's n-grams lie
wholly in it, so equal lines are equal paragraphs, whatever stands around them. Bands are tuned for recall and looked
at in two passes, so that half of their keys are on disk at once. Paragraphs that collide, directly or by others, meet
and are compared by their exact n-gram sets; where very many hang together only those of a bucket do. Linked ones form
a component, and all but its first occurrence are removed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import components
from .groups import block_pairs, dealt, forest, units
from .minhash import N_GRAM, THRESHOLD, _mix, banding, overlaps, shingles, word_hashes
from .scratch import drop, lean, materialise, shuffle_partitions, without
from .suffixes import least_in_windows

SIDE, RECALL, HASHES = 5, 0.9999, 20
#: Words that a run of repeated paragraphs must have to count; shorter ones are phrases, not passages.
LEAST_WORDS = 16
#: Passes over the texts, each with its share of the bands: the disk that band keys take, against CPU seconds.
PASSES = 2
CHUNK = 1 << 21
#: Paragraphs of a component, or of a bucket in a larger one, that are compared in one place; pairs of blocks beyond.
BLOCK = 2048


def _alone(threshold: float) -> int:
    """Sets of at most so many n-grams can only reach the threshold with an equal one."""
    return max(1, math.ceil(threshold / (1 - threshold) - 1e-9) - 1) if threshold < 1 else 1 << 30


def paragraphs(texts: list[bytes], n: int = N_GRAM) -> dict[str, np.ndarray]:
    """Texts -> by paragraph: its text, number, start, end and reach (the end of its last n-gram, in bytes), words and
    n-gram hashes from `first` on. A paragraph of fewer than n words has one n-gram, all of its words; texts of fewer
    than n words have no paragraphs."""
    joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    w, at = word_hashes(joined)
    full = len(w) - n + 1
    none = np.zeros(0, np.int64)
    if full <= 0:
        return {k: none for k in ("text", "number", "start", "end", "reach", "words", "first")} | {"grams": np.zeros(0, np.uint64)}
    of = np.searchsorted(begin, at, "right") - 1
    # where paragraphs begin: lines (and so texts), and least pairs whose neighbours are of the same line
    lines = np.concatenate([[0], np.flatnonzero(joined == 10) + 1])
    cut = np.zeros(len(w), bool)
    first = np.searchsorted(at, lines)
    cut[first[first < len(w)]] = True
    line = np.cumsum(cut)
    side = max(SIDE, n)
    pair = _mix(w[:-1] * np.uint64(3) + w[1:])
    key = (pair & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(pair), dtype=np.uint64)
    if len(key) > 2 * side:
        least = (least_in_windows(key, 2 * side + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        here = np.arange(side, side + len(least))
        cut[here[(least == here) & (line[here - side] == line[here + side + 1])]] = True
    p = np.flatnonzero(cut)
    stop = np.append(p[1:], len(w))
    size = stop - p
    # n-grams wholly inside a paragraph, and all words of those too short for one
    s = np.zeros(full, np.uint64)
    for k in range(n):
        s = s * np.uint64(0xD6E8FEB86659FD93) + w[k : k + full]
    grams = np.zeros(len(w), np.uint64)
    grams[:full] = _mix(s)
    own = np.cumsum(cut)
    inside = np.zeros(len(w), bool)
    inside[:full] = own[n - 1 :] == own[:full]
    for m in range(1, n):
        short = p[size == m]
        s = np.full(len(short), m, np.uint64)
        for k in range(m):
            s = s * np.uint64(0xD6E8FEB86659FD93) + w[short + k]
        grams[short] = _mix(s)
        inside[short] = True
    inside &= (np.bincount(of, minlength=len(texts)) >= n)[of]
    end = np.where(np.append(of[p[1:]] == of[p[:-1]], False), at[np.minimum(stop, len(w) - 1)], begin[of[p] + 1] - 1)
    number = np.arange(len(p)) - np.searchsorted(of[p], of[p])
    kept = np.concatenate([[0], np.cumsum(inside)])
    some = inside[p]
    p, size, end, number = p[some], size[some], end[some], number[some]
    base = begin[of[p]]
    return {"text": of[p], "number": number, "start": at[p] - base, "end": end - base, "reach": end - base, "words": size, "first": kept[p], "grams": grams[inside]}


def nodes_of(p: dict[str, np.ndarray]) -> np.ndarray:
    """An even hash for each paragraph's n-grams, whatever their order."""
    if not len(p["first"]):
        return np.zeros(0, np.int64)
    return (_mix(np.add.reduceat(_mix(p["grams"] ^ np.uint64(0x5851F42D4C957F2D)), p["first"])) << np.uint64(1)).view(np.int64)


def band_keys(p: dict[str, np.ndarray], rows: int, which: range, alone: int = 0, seed: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """The keys of the bands `which`, and the paragraph of each. Paragraphs of at most `alone` n-grams, which link with
    equal sets only, are in band 0 alone: equal sets have equal keys in any band."""
    x, first = p["grams"], p["first"]
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(x)))
    large = np.flatnonzero(size > alone)
    at = np.cumsum(np.concatenate([[0], size[large]]))[:-1]
    y = x[np.repeat(size > alone, size)]
    out, of = [], []
    for b in which:
        rng = np.random.default_rng([seed, b])
        z, start = (x, first) if b == 0 else (y, at)
        if not len(start):
            continue
        h = np.full(len(start), b + 1, np.uint64)
        for _ in range(rows):
            a, c = rng.integers(1, 1 << 63, 2, dtype=np.uint64)
            h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat((z ^ c) * (a | np.uint64(1)), start))
        out.append(h.view(np.int64))
        of.append(np.arange(len(first)) if b == 0 else large)
    return (np.concatenate(out), np.concatenate(of)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def small_forests(sets: list[np.ndarray], starts: np.ndarray, threshold: float) -> np.ndarray:
    """Sorted sets without repeats, units of few members from starts on -> for each member the smallest one of its unit
    that links lead to. All pairs of a unit are compared, those of all units in one sort."""
    n = np.diff(starts)
    size = np.array([len(x) for x in sets], np.int64)
    root = np.arange(len(sets))
    i, j = [], []
    for m in np.unique(n[n > 1]):
        a, b = np.triu_indices(m, 1)
        base = starts[:-1][n == m][:, None]
        i.append((base + a).ravel())
        j.append((base + b).ravel())
    if not i:
        return root
    i, j = np.concatenate(i), np.concatenate(j)
    ok = np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j]) - 1e-9
    i, j = i[ok], j[ok]
    flat, begin = np.concatenate([*sets, np.zeros(0, np.uint64)]), np.cumsum(np.concatenate([[0], size]))
    links = [np.zeros((2, 0), np.int64)]
    for lo in range(0, len(i), 1 << 15):
        a, b = i[lo : lo + (1 << 15)], j[lo : lo + (1 << 15)]
        both = np.concatenate([a, b])
        of = np.repeat(np.concatenate([np.arange(len(a))] * 2), size[both])
        at = np.arange(len(of)) - np.repeat(np.cumsum(size[both]) - size[both], size[both]) + np.repeat(begin[both], size[both])
        value = flat[at]
        order = np.lexsort((value, of))
        value, of = value[order], of[order]
        common = np.bincount(of[1:][(value[1:] == value[:-1]) & (of[1:] == of[:-1])], minlength=len(a))
        near = common >= threshold * (size[a] + size[b] - common) - 1e-9
        links.append(np.stack([a[near], b[near]]))
    a, b = np.concatenate(links, 1)
    while True:  # the smaller root wins until nothing changes
        low = np.minimum(root[a], root[b])
        if (low == root[a]).all() and (low == root[b]).all():
            return root
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]


def exact_forests(units_: DataFrame, n: int, threshold: float) -> DataFrame:
    """units_ (g, n, node, text binary) -> links (src, dst) as forests, by exact sets."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in units(batches):
            g, at = shingles(t["text"].to_pylist(), n)
            of = np.repeat(np.arange(len(at) - 1), np.diff(at))
            order = np.lexsort((g, of))
            g, of = g[order], of[order]
            new = np.concatenate([[True], (g[1:] != g[:-1]) | (of[1:] != of[:-1])]) if len(g) else np.zeros(0, bool)
            sets = np.split(g[new], np.cumsum(np.bincount(of[new], minlength=t.num_rows))[:-1]) if t.num_rows else []
            size = np.diff(starts)
            few = np.repeat(size <= 16, size)
            root = np.arange(t.num_rows)
            if few.any():
                mine = np.flatnonzero(few)
                root[mine] = mine[small_forests([sets[k] for k in mine], np.cumsum(np.concatenate([[0], size[size <= 16]])), threshold)]
            for a, b in zip(starts[:-1][size > 16], starts[1:][size > 16], strict=True):
                many = np.array([len(s) for s in sets[a:b]], float)
                both = overlaps(sets[a:b])
                near = lambda r, c, both=both, many=many: both[np.ix_(r, c)] >= threshold * (many[r][:, None] + many[c][None, :] - both[np.ix_(r, c)]) - 1e-9
                root[a:b] = a + forest(near, b - a)
            hit = np.flatnonzero(root != np.arange(t.num_rows))
            node = np.asarray(t["node"].combine_chunks())
            yield pa.RecordBatch.from_arrays([pa.array(node[hit]), pa.array(node[root[hit]])], names=["src", "dst"])

    work = dealt(block_pairs(units_, BLOCK).select("g", "bi", "bj", "node", "text"))
    return work.mapInArrow(compare, "src bigint, dst bigint")


def _parts(column) -> Iterator[tuple[int, list[bytes]]]:
    """A batch's texts in lots of a few MB, each at least one text, with the place of the lot."""
    texts = column.to_pylist()
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) < CHUNK):
            size += len(texts[hi])
            hi += 1
        yield lo, texts[lo:hi]
        lo = hi


OUT = ("repeats", "kept_text")
SPOT = ("number", "start", "end", "words")


def dedup_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N_GRAM, threshold: float = THRESHOLD, recall: float = RECALL, least_words: int = LEAST_WORDS, carry: list[str] | None = None, with_text: bool = True) -> DataFrame:
    """The rows of docs (columns in carry, all by default) with repeats and, with_text, kept_text.

    repeats is the paragraphs that are linked with another one and stand in a run of such of least_words words or
    more: (start, end in bytes of UTF-8, class_id, removed). The first of a class (by identifier, nulls last, then
    place) is not removed. Texts without n words have no paragraphs. Null texts are empty and stay null. Rows with the
    same identifier and text are one document, and come out alike as often as they come in. An empty table gives an
    empty table; outputs replace columns named like them.
    """
    bands, rows = banding(threshold, recall, HASHES)
    lean(docs.sparkSession)
    base = without(docs, *OUT)
    carry = [c for c in (base.columns if carry is None else carry) if c.lower() not in OUT]
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    mark = F.xxhash64(F.col(text_col))
    src = base.select(F.col(id_col).alias("id"), mark.alias("mark"), text.alias("t"))
    id_type = src.schema["id"].dataType
    n_parts, alone = shuffle_partitions(docs.sparkSession), _alone(threshold)

    def keys_of(which: range):
        def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, texts in _parts(batch["t"]):
                    p = paragraphs(texts, n)
                    k, of = band_keys(p, rows, which, alone)
                    node = nodes_of(p)[of]
                    order = np.argsort(k, kind="stable")  # equal paragraphs of a lot travel as one row, nearly always
                    k, node = k[order], node[order]
                    new = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (node[1:] != node[:-1])])) if len(k) else np.zeros(0, np.int64)
                    several = np.diff(np.append(new, len(k))) > 1  # said by the last bit, which is 0 in a node
                    yield pa.RecordBatch.from_arrays([pa.array(k[new]), pa.array(node[new] | several)], names=["g", "node"])

        return keys

    def collide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in units(batches, ("g",)):
            g, said = np.asarray(t["g"].combine_chunks()), np.asarray(t["node"].combine_chunks())
            node, size = said & ~1, np.diff(starts)
            keep = np.flatnonzero(np.repeat((size > 1) | np.bitwise_or.reduceat(said & 1, starts[:-1]).astype(bool), size))
            least = np.repeat(np.minimum.reduceat(node, starts[:-1]), size)[keep]
            g, node = g[keep], node[keep]
            order = np.lexsort((node, g))
            g, node, least = g[order], node[order], least[order]
            new = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (node[1:] != node[:-1])])) if len(g) else keep
            yield pa.RecordBatch.from_arrays([pa.array(x[new]) for x in (g, node, least)], names=["g", "node", "least"])

    met = []
    for k in range(PASSES):
        which = range(k * bands // PASSES, (k + 1) * bands // PASSES)
        keys = src.select("t").mapInArrow(keys_of(which), "g bigint, node bigint")
        met.append(materialise(keys.repartition(n_parts, "g").sortWithinPartitions("g").mapInArrow(collide, "g bigint, node bigint, least bigint")))
    every = met[0]
    for x in met[1:]:
        every = every.unionByName(x)
    labels = materialise(components(every.select(F.col("least").alias("src"), F.col("node").alias("dst"))))
    wanted = materialise(every.select(F.col("node").alias("w")).distinct())
    spot = T.StructType([T.StructField("id", id_type), T.StructField("mark", T.LongType()), *(T.StructField(c, T.IntegerType()) for c in SPOT), T.StructField("node", T.LongType())])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, texts in _parts(batch["t"]):
                p = paragraphs(texts, n)
                i = pa.array(p["text"] + lo)
                yield pa.RecordBatch.from_arrays([batch["id"].take(i), batch["mark"].take(i), *(pa.array(p[c].astype(np.int32)) for c in SPOT), pa.array(nodes_of(p))], names=spot.names)

    spots = src.mapInArrow(places, spot)
    found = materialise(spots.join(wanted, spots["node"] == wanted["w"], "left_semi").dropDuplicates(["id", "mark", "number"]))
    drop(wanted)
    # exact sets of one paragraph for each node that has a candidate partner; one place compares a whole component,
    # but the buckets of one that is too large for that
    sizes = labels.groupBy("label").agg(F.count("*").alias("n"))
    of = labels.join(sizes, "label")
    one = materialise(of.join(found.groupBy("node").agg(F.min(F.struct("id", "mark", "start", "end")).alias("w")), "node"))
    want = one.groupBy(F.col("w.id").alias("w_id"), F.col("w.mark").alias("w_mark")).agg(F.collect_list(F.struct("node", "label", "n", F.col("w.start").alias("a"), F.col("w.end").alias("b"))).alias("spots"))
    cut = src.join(want, src["id"].eqNullSafe(want["w_id"]) & (src["mark"] == want["w_mark"])).select("t", F.explode("spots").alias("s"))
    cut = cut.select("s.node", "s.n", "s.label", F.substring("t", F.col("s.a") + 1, F.col("s.b") - F.col("s.a")).alias("text"))
    cut = materialise(cut.dropDuplicates(["node"]))
    whole = cut.where(F.col("n") <= BLOCK).select(F.col("label").alias("g"), "n", "node", "text")
    hot = cut.where(F.col("n") > BLOCK).select(F.col("node").alias("b_node"), "text")
    bucket = materialise(every.select("g", "node").distinct().join(hot.select("b_node"), F.col("node") == F.col("b_node"), "left_semi"))
    in_bucket = bucket.groupBy("g").agg(F.count("*").alias("n")).where("n > 1")
    buckets = bucket.join(in_bucket, "g").join(hot, F.col("node") == F.col("b_node")).select("g", "n", "node", "text")
    links = exact_forests(whole.unionByName(buckets), n, threshold)
    classes = materialise(components(links)).select(F.col("node").alias("c_node"), "label")
    for x in (*met, bucket, cut):
        drop(x)
    found = found.join(classes, found["node"] == classes["c_node"], "left").withColumn("class_id", F.coalesce("label", "node")).drop("label", "c_node")
    found = materialise(found)
    # written, so that Spark can split what one class brings to the join
    first = materialise(found.groupBy("class_id").agg(F.count("*").alias("n"), F.min(F.struct(F.col("id").isNull().alias("no"), "id", "mark", "number")).alias("first")).where("n > 1").select(F.col("class_id").alias("f_class"), "first"))
    again = found.join(first, found["class_id"] == first["f_class"])
    own = (F.col("id").eqNullSafe(F.col("first.id"))) & (F.col("mark") == F.col("first.mark")) & (F.col("number") == F.col("first.number"))
    again = materialise(again.select(F.col("id").alias("a_id"), F.col("mark").alias("a_mark"), "number", "start", "end", "words", "class_id", (~own).alias("removed")))
    again = again.groupBy("a_id", "a_mark").agg(F.array_sort(F.collect_list(F.struct("number", "start", "end", "words", "class_id", "removed"))).alias("rows"))

    names = [f"_tg_c{k}" for k in range(len(carry))]
    full = base.select(*[base[f"`{c}`"].alias(k) for k, c in zip(names, carry, strict=True)], F.col(id_col).alias("id"), mark.alias("mark"), *([text.alias("t")] if with_text else []))
    full = full.join(again, F.col("id").eqNullSafe(F.col("a_id")) & (F.col("mark") == F.col("a_mark")), "left").select(*names, *(["t"] if with_text else []), "rows")
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("class_id", T.LongType()), T.StructField("removed", T.BooleanType())]))
    schema = T.StructType([full.schema[c] for c in names] + [T.StructField("repeats", span), T.StructField("kept_text", T.StringType())])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows_ = batch["rows"]
            n_rows = rows_.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = rows_.flatten()
            of = np.repeat(np.arange(batch.num_rows), n_rows)
            number, words = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 3))
            new = np.ones(len(of), bool)
            new[1:] = (of[1:] != of[:-1]) | (number[1:] != number[:-1] + 1)
            run = np.cumsum(new) - 1
            keep = np.bincount(run, words)[run] >= least_words if len(run) else new
            at = pa.array(np.flatnonzero(keep))
            start, end, cls, removed = (flat.field(k).take(at) for k in (1, 2, 4, 5))
            per = np.bincount(of[keep], minlength=batch.num_rows)
            spans = pa.StructArray.from_arrays([start.cast(pa.int64()), end.cast(pa.int64()), cls, removed], names=["start", "end", "class_id", "removed"])
            offsets = np.concatenate([[0], np.cumsum(per)]).astype(np.int32)
            kept = [None] * batch.num_rows
            if with_text:
                a, b, gone = start.to_pylist(), end.to_pylist(), removed.to_pylist()
                for i, t in enumerate(batch["t"]):
                    t = t.as_buffer().to_pybytes()
                    at_, rest = 0, []
                    for k in range(offsets[i], offsets[i + 1]):
                        if gone[k]:
                            rest.append(t[at_ : a[k]])
                            at_ = b[k]
                    kept[i] = (b"".join(rest) + t[at_:]).decode()
            yield pa.RecordBatch.from_arrays([batch[c] for c in names] + [pa.ListArray.from_arrays(pa.array(offsets), spans), pa.array(kept, pa.string())], names=schema.names)

    t = full.mapInArrow(runs, schema)
    return t.select(*[F.col(k).alias(c) for k, c in zip(names, carry, strict=True)], "repeats", *(["kept_text"] if with_text else []))


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    t = dedup_paragraphs(docs.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")), carry=["doc_id", "n_bytes"], with_text=False)
    gone = F.filter("repeats", lambda r: r["removed"])
    return t.select("doc_id", "n_bytes", F.size("repeats").cast("long").alias("n_repeated"), F.size(gone).cast("long").alias("n_removed"), F.aggregate(gone, F.lit(0).cast("long"), lambda x, r: x + r["end"] - r["start"]).alias("removed_bytes"), "repeats")
