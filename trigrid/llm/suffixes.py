"""Substring removal with a suffix array by two-stage sorting.

Every string of `length` bytes contains an anchor: the place of the least hash of its grams (64 bytes for 200). Equal strings have equal
anchors at equal offsets, so strings can only repeat inside the surroundings of anchors with equal hashes. Those
surroundings are brought together and equal ones collapsed with their count. The strings of different ones are dealt to
parts by where they begin; parts that share the bytes which all their strings have in common meet (very many that do
are first dealt to narrower parts, down to single strings, so the work stays linear), and their suffixes are sorted in
two stages: only suffixes smaller than their successors are sorted directly, the others are induced by
scanning the buckets of first bytes in order. Neighbours with a common prefix of `length` bytes, at the same offset
from their anchor, are repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .groups import block_pairs, dealt, units
from .scratch import drop, lean, materialise, without

LENGTH = 200
#: Bytes looked at in one go; longer texts are looked at in overlapping pieces.
CHUNK = 1 << 17
#: Never a byte of UTF-8.
END = 0xFF
_B = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def gram_of(length: int) -> int:
    """The largest power of two up to a third: long enough to be rare by chance, short enough for few anchors."""
    return 1 << max(0, (length // 3).bit_length() - 1)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """The hash of the gram from each position; the last gram - 1 positions have none."""
    h, width, base = data.astype(np.uint64) + np.uint64(1), 1, _B
    while width < gram:
        h = h[:-width] * base + h[width:]
        with np.errstate(over="ignore"):
            base = base * base
        width *= 2
    return _mix(h)


def least_in_windows(key: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive entries."""
    have = 1
    while 2 * have <= width:
        key = np.minimum(key[:-have], key[have:])
        have *= 2
    return np.minimum(key[: len(key) - (width - have)], key[width - have :]) if have < width else key


def anchors(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts -> (text's number, place, hash) of the anchors of all strings of `length` bytes in them."""
    of, at, hashes, gram = [], [], [], gram_of(length)
    pieces = [(i, w, min(len(t), w + CHUNK + length - 1)) for i, t in enumerate(texts) for w in range(0, len(t) - length + 1, CHUNK)]
    k = 0
    while k < len(pieces):
        first, size = k, 0
        while k < len(pieces) and (k == first or size + pieces[k][2] - pieces[k][1] <= CHUNK):
            size += pieces[k][2] - pieces[k][1]
            k += 1
        now = pieces[first:k]
        data = np.frombuffer(b"".join(texts[i][a:b] for i, a, b in now), np.uint8)
        h = gram_hashes(data, gram)
        key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        place = (least_in_windows(key, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        begin = np.cumsum([0] + [b - a for _, a, b in now])
        ok = np.ones(len(place), bool)
        for s in begin[1:-1]:  # strings that would run from one piece into the next
            ok[s - length + 1 : s] = False
        p = place[ok]
        p = p[np.concatenate([[True], p[1:] != p[:-1]])] if len(p) else p
        piece = np.searchsorted(begin, p, "right") - 1
        of.append(np.array([i for i, _, _ in now], np.int64)[piece])
        at.append(p - begin[piece] + np.array([a for _, a, _ in now], np.int64)[piece])
        hashes.append(h[p].view(np.int64))
    if not of:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    of, at, hashes = map(np.concatenate, (of, at, hashes))
    again = np.zeros(len(of), bool)
    again[1:] = (of[1:] == of[:-1]) & (at[1:] <= at[:-1])  # found in both of two pieces
    return of[~again], at[~again], hashes[~again]


def surroundings(text: bytes, at: int, length: int = LENGTH) -> tuple[bytes, int]:
    """What strings of `length` bytes around the anchor can reach, and how much of it lies before the anchor."""
    left = min(at, length - gram_of(length))
    return text[at - left : at + length], left


#: Parts that the strings around an anchor are dealt to by where they begin, and those of a part of a hot group again.
PARTS = 4
#: Different parts with the same shared bytes that are compared in pairs of blocks; more are dealt to narrower parts.
HOT = 2048


def parted(text: bytes, at: int, length: int = LENGTH, parts: int = PARTS) -> Iterator[tuple[int, bytes, int, bytes]]:
    """The surroundings of an anchor -> (number, what all strings of the part share, how much of the part lies before
    the anchor, the part). A part holds the strings that begin in one stretch; equal ones have equal shared bytes."""
    reach = length - gram_of(length)
    width = -(-(reach + 1) // parts)
    for k, first in enumerate(range(-reach, 1, width)):
        last = min(0, first + width - 1)
        a, b = max(0, at + first), min(len(text), at + last + length)
        if b - a >= length:
            yield k, text[at + last : at + first + length], at - a, text[a:b]


def stretch_of(k: int, length: int = LENGTH, parts: int = PARTS) -> tuple[int, int]:
    """Where the strings of part k begin, first and last, from their anchor."""
    reach = length - gram_of(length)
    width = -(-(reach + 1) // parts)
    return -reach + k * width, min(0, -reach + (k + 1) * width - 1)


def narrower(block: bytes, left: int, first: int, last: int, length: int = LENGTH, parts: int = PARTS) -> Iterator[tuple[int, int, bytes, int, bytes]]:
    """A part whose strings begin from first to last -> parts of it: (first, last, shared bytes, how much lies before
    the anchor, the part), as parted() does. In parts of one beginning, equal shared bytes are equal strings."""
    width = -(-(last - first + 1) // parts)
    for f in range(first, last + 1, width):
        e = min(last, f + width - 1)
        a, b = max(0, f + left), min(len(block), e + left + length)
        if b - a >= length:
            yield f, e, block[e + left : f + left + length], left - a, block[a:b]


def by_group(key: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The order by ascending group and, in each, key. Few groups are dealt by radix."""
    order = np.argsort(key)
    number = np.cumsum(np.concatenate([[0], group[1:] != group[:-1]])) if len(group) else group
    return order[np.argsort(number[order].astype(np.uint16 if not len(number) or number[-1] < 1 << 16 else np.int64), kind="stable")]


def unlike(x: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which of the groups that begin at start have different entries."""
    return np.minimum.reduceat(x, start) != np.maximum.reduceat(x, start)


def two_stage(data: np.ndarray, depth: int, stop: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Bytes -> (all suffixes in order of their first `depth` bytes, the number of the class of each in that order):
    suffixes in one class have `depth` equal first bytes, or end and are alone. With stop, order and classes only hold
    for suffixes without that byte among their first `depth` bytes; equal ones of these are neighbours."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    wide = np.concatenate([data, np.zeros(depth + 8, np.uint8)])
    word = np.zeros(n + depth, np.uint64)
    for k in range(8):
        word = (word << np.uint64(8)) | wide[k : k + n + depth]
    # smaller than the successor: the next different byte is larger
    turn = np.flatnonzero(np.diff(data.astype(np.int16)))
    upto = np.searchsorted(turn, np.arange(n))
    step = np.concatenate([data[turn + 1] > data[turn], [False]])
    small = step[upto]
    # whether `depth` bytes are equal is known from a rolling hash, and is checked by the bytes further down
    up = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n + depth, _B, np.uint64)]))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((wide[: n + depth].astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64)])
    inverse = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, pow(int(_B), -1, 1 << 64), np.uint64)]))
    whole = _mix((total[depth : depth + n] - total[:n]) * inverse[:n])
    ends = np.append(np.flatnonzero(data == stop), n) if stop is not None else np.array([n + depth])
    reach = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)
    # Only suffixes that reach `depth` bytes before the stop count, and those that they follow in runs of larger ones:
    # the others need a place after them, no order.
    since = np.arange(n) - np.maximum.accumulate(np.where(small, np.arange(n), -1))
    larger = np.concatenate([[0], since[:-1]])
    vain = reach + larger < depth
    # first stage
    s = np.flatnonzero(small)
    s = s[np.argsort(word[s])]
    head = np.cumsum(np.concatenate([[0], word[s][1:] != word[s][:-1]])) if len(s) else np.zeros(0, np.int64)
    order = by_group(vain[s].astype(np.uint64), head)
    s, head = s[order], head[order]
    open_ = np.flatnonzero(~vain[s])
    group = head[open_]
    for _ in range(-(-depth // 8)):  # each round looks at a later word of each group
        if not len(open_):
            break
        p = s[open_]
        start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        size = np.diff(np.append(start, len(group)))
        keep = np.repeat((size > 1) & unlike(whole[p], start), size)
        open_ = open_[keep]
        if not len(open_):
            break
        p, group = s[open_], group[keep]
        start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        size = np.diff(np.append(start, len(group)))
        # how many words all of a group have in common, by bisection
        known, least = np.ones(len(start), np.int64), total[p]
        other = np.full(len(start), (depth - 1) // 8 + 1)
        while (other - known > 1).any():
            half = np.where(other - known > 1, (known + other) // 2, known)
            differ = unlike((total[p + np.repeat(8 * half, size)] - least) * inverse[p], start)
            known, other = np.where(differ, known, half), np.where(differ & (half > known), half, other)
        keep = reach[p] >= np.repeat(8 * known, size)
        at = np.repeat(8 * known, size)[keep]
        open_, p, group = open_[keep], p[keep], group[keep]
        if not len(open_):
            break
        key = word[p + at]
        order = by_group(key, group)
        s[open_] = p[order]
        key = key[order]
        group = np.cumsum(np.concatenate([[0], (group[1:] != group[:-1]) | (key[1:] != key[:-1])]))
    # second stage
    first = data[s]
    bound = np.searchsorted(first, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[data[-1]].append(np.array([n - 1]))  # its successor is empty
    out: list[np.ndarray] = []

    def induce(e: np.ndarray, c: int) -> np.ndarray:
        """Deal the predecessors that are larger than their successors to the buckets; those of bucket c come back."""
        p = e[e > 0] - 1
        p = p[~small[p]]
        if not len(p):
            return p
        ch = data[p]
        here = p[ch == c]
        p, ch = p[ch != c], ch[ch != c]
        order = np.argsort(ch, kind="stable")
        p, ch = p[order], ch[order]
        cut = np.flatnonzero(np.concatenate([[True], ch[1:] != ch[:-1]])) if len(p) else []
        for a, b in zip(cut, [*cut[1:], len(p)], strict=True) if len(p) else ():
            waiting[ch[a]].append(p[a:b])
        return here

    for c in range(256):
        if waiting[c]:
            e = np.concatenate(waiting[c])
            waiting[c] = []
            while len(e):
                out.append(e)
                e = induce(e, c)
        e = s[bound[c] : bound[c + 1]]
        if len(e):
            out.append(e)
            induce(e, c)
    sa = np.concatenate(out)
    # adjacent common prefixes
    same = np.zeros(n, bool)
    at = np.flatnonzero(whole[sa[1:]] == whole[sa[:-1]])
    at = at[np.maximum(sa[at], sa[at + 1]) + depth <= n]
    for lo in range(0, len(at), 1 << 18):
        part = at[lo : lo + (1 << 18)]
        a, b = sa[part], sa[part + 1]
        equal = np.ones(len(part), bool)
        for k in (*range(0, depth - 7, 8), max(0, depth - 8)):
            equal &= word[a + k] == word[b + k]
        same[part[equal] + 1] = True
    return sa, np.cumsum(~same)


def repeats(blocks: list[bytes], left: list[int], unit: np.ndarray, length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """Surroundings, what lies before their anchors and their unit -> for each the spans, relative to the anchor,
    covered by strings that another one of its unit has at the same offset."""
    size = np.array([len(b) for b in blocks])
    begin = np.cumsum(np.concatenate([[0], size + 1]))
    data = np.frombuffer(bytes([END]).join(blocks) + bytes([END]), np.uint8)
    sa, cls = two_stage(data, length, END)
    of = np.repeat(np.arange(len(blocks)), size + 1)[sa]
    offset = sa - begin[of]
    ok = offset + length <= size[of]
    sa, cls, of, offset = sa[ok], cls[ok], of[ok], offset[ok]
    relative = offset - np.array(left)[of]
    again = np.flatnonzero(np.bincount(cls)[cls] > 1) if len(cls) else cls
    cls, of, relative = cls[again], of[again], relative[again]
    order = np.lexsort((relative, unit[of], cls))
    key = np.stack([cls[order], unit[of][order], relative[order]])
    new = np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(0)]) if len(order) else np.zeros(0, bool)
    start = np.flatnonzero(new)
    many = np.repeat(np.diff(np.append(start, len(order))) > 1, np.diff(np.append(start, len(order)))) if len(order) else new
    hit = order[many]
    hit = hit[np.lexsort((relative[hit], of[hit]))]
    out: list[list[tuple[int, int]]] = [[] for _ in blocks]
    if len(hit):
        o, r = of[hit], relative[hit]
        cut = np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (r[1:] > r[:-1] + length)]))
        for a, b in zip(cut, [*cut[1:], len(hit)], strict=True):
            out[o[a]].append((int(r[a]), int(r[b - 1]) + length))
    return out


def joined(runs: Column) -> Column:
    """Runs (a, b) in order -> those that overlap or touch as one."""

    def add(done: Column, r: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        longer = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], r["b"]).alias("b"))))
        return F.when((F.size(done) > 0) & (last["b"] >= r["a"]), longer).otherwise(F.concat(done, F.array(r)))

    return F.aggregate(runs, F.array().cast("array<struct<a:bigint,b:bigint>>"), add)


OUT = ("spans", "kept_bytes")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, carry: list[str] | None = None) -> DataFrame:
    """The rows of docs (columns in carry, all by default) with spans and kept_bytes.

    spans is the maximal runs (start, end in bytes from 0) covered by strings of `length` bytes that also start
    elsewhere, in this row or another; kept_bytes is the rest. Judged on the whole input, all rows alike: repeated
    rows of that length or more lose everything, in each of them. Null texts are empty; texts shorter than `length`
    stay. Null identifiers are rows like any other. An empty table gives an empty table; outputs replace columns
    named like them.
    """
    lean(docs.sparkSession)
    base = without(docs, *OUT)
    carry = [c for c in (base.columns if carry is None else carry) if c.lower() not in OUT]
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    mark = F.xxhash64(F.col(text_col))
    reach, hot = length - gram_of(length), HOT

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = part["t"].to_pylist()
                of, at, h = anchors(texts, length)
                around = np.fromiter((xxhash.xxh3_64_intdigest(texts[i][max(0, p - reach) : p + length], seed=min(p, reach)) for i, p in zip(of.tolist(), at.tolist(), strict=True)), np.uint64, len(of))
                size = np.array([len(t) for t in texts], np.int64)[of] if len(of) else of
                i = pa.array(of)
                yield pa.RecordBatch.from_arrays([part["id"].take(i), part["mark"].take(i), pa.array(h), pa.array(around.view(np.int64)), pa.array(at), pa.array(size)], names=["id", "mark", "h", "around", "at", "size"])

    src = base.select(F.col(id_col).alias("id"), mark.alias("mark"), text.alias("t"))
    id_type = src.schema["id"].dataType
    place = T.StructType([T.StructField("id", id_type), *(T.StructField(c, T.LongType()) for c in ("mark", "h", "around", "at", "size"))])
    found = materialise(src.mapInArrow(find, place))
    # written, so that Spark can split what one anchor brings to the join
    shared = materialise(found.groupBy("h").agg(F.count("*").alias("n"), (F.min("around") != F.max("around")).alias("mixed")).where("n > 1").drop("n"))
    hits = materialise(found.join(shared, "h"))
    drop(found)
    # the different surroundings of an anchor, with how often each is there and where one is
    one = materialise(hits.where("mixed").groupBy("h", "around").agg(F.count("*").alias("many"), F.min(F.struct("id", "mark", "at")).alias("w")))
    want = one.groupBy(F.col("w.id").alias("w_id"), F.col("w.mark").alias("w_mark")).agg(F.collect_list(F.struct("h", "around", F.col("w.at").alias("at"))).alias("places"))
    met = src.join(want, src["id"].eqNullSafe(want["w_id"]) & (src["mark"] == want["w_mark"])).select("t", "places")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                g, node, h, around, left, block, number = [], [], [], [], [], [], []
                for t, places in zip(part["t"].to_pylist(), part["places"].to_pylist(), strict=True):
                    for p in places:
                        for k, shared, before, piece in parted(t, p["at"], length):
                            g.append(xxhash.xxh3_64_intdigest(shared, seed=(p["h"] + k) % (1 << 64)))
                            node.append(xxhash.xxh3_64_intdigest(piece, seed=before))
                            h.append(p["h"])
                            around.append(p["around"])
                            left.append(before)
                            block.append(piece)
                            number.append(k)
                yield pa.RecordBatch.from_arrays([pa.array(np.array(g, np.uint64).view(np.int64)), pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(h, pa.int64()), pa.array(around, pa.int64()), pa.array(left, pa.int32()), pa.array(block, pa.binary()), pa.array(number, pa.int8())], names=["g", "node", "h", "around", "left", "block", "k"])

    # their parts: those that another one has as a whole repeat; different ones with the same shared bytes are sorted
    parts = materialise(met.mapInArrow(cut, "g bigint, node bigint, h bigint, around bigint, left int, block binary, k tinyint"))
    nodes = materialise(parts.groupBy("g", "node").agg(F.min("around").alias("lo"), F.max("around").alias("hi")))
    groups = materialise(nodes.groupBy("g").agg(F.count("*").alias("n")).where("n > 1"))
    first = nodes.join(groups, "g").select(F.col("g").alias("g2"), F.col("node").alias("node2"), "lo", "n")
    met_parts = parts.join(first, (F.col("g") == F.col("g2")) & (F.col("node") == F.col("node2")) & (F.col("around") == F.col("lo")))
    stretches = [stretch_of(k, length) for k in range(PARTS)]
    met_parts = met_parts.select("g", "node", "n", "left", "block", *[F.element_at(F.array(*[F.lit(x[i]) for x in stretches]), F.col("k") + 1).alias(c) for i, c in enumerate(("first", "last"))])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in units(batches):
            k = 0
            while k < len(starts) - 1:  # as many units as fit a processor's cache, at least one
                end = k + 1
                while end < len(starts) - 1 and (starts[end + 1] - starts[k]) * 2 * length <= CHUNK:
                    end += 1
                u = t.slice(starts[k], starts[end] - starts[k])
                unit = np.repeat(np.arange(end - k), np.diff(starts[k : end + 1]))
                node = np.asarray(u["node"].combine_chunks())
                # repeated rows bring their surroundings more than once
                key = np.unique(np.stack([unit, node]), axis=1, return_index=True)[1]
                u, unit = u.take(pa.array(np.sort(key))), unit[np.sort(key)]
                got = repeats(u["block"].to_pylist(), u["left"].to_pylist(), unit, length)
                of = np.repeat(np.arange(len(got)), [len(x) for x in got])
                spans = np.array([s for x in got for s in x], np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(u["g"].combine_chunks())[of]), pa.array(np.asarray(u["node"].combine_chunks())[of]), pa.array(spans[:, 0]), pa.array(spans[:, 1])], names=["g", "node", "a", "b"])
                k = end

    def cut_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                of, g, node, left, block, first, last = [], [], [], [], [], [], []
                for i, (t, before, above, k, m) in enumerate(zip(*[part[c].to_pylist() for c in ("block", "left", "g", "first", "last")], strict=True)):
                    for f, e, shared, at, piece in narrower(t, before, k, m, length):
                        of.append(i)
                        first.append(f)
                        last.append(e)
                        g.append(xxhash.xxh3_64_intdigest(shared, seed=(above + f) % (1 << 64)))
                        node.append(xxhash.xxh3_64_intdigest(piece, seed=at % (1 << 64)))
                        left.append(at)
                        block.append(piece)
                i = pa.array(of, pa.int64())
                yield pa.RecordBatch.from_arrays([part["g"].take(i), part["node"].take(i), pa.array(np.array(g, np.uint64).view(np.int64)), pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(left, pa.int32()), pa.array(block, pa.binary()), pa.array(first, pa.int32()), pa.array(last, pa.int32())], names=["up_g", "up_node", "g", "node", "left", "block", "first", "last"])

    def repeated(found: DataFrame) -> DataFrame:
        """found (g, node, n, left, block, first, last), n the different parts of g -> (g, node, a, b): what repeats, from
        the anchor."""
        found = materialise(found)
        cold = block_pairs(found.where(F.col("n") <= hot))
        out = materialise(dealt(cold.select("g", "bi", "bj", "node", "left", "block")).mapInArrow(sort, "g bigint, node bigint, a bigint, b bigint").distinct())
        many = found.where(F.col("n") > hot)
        if many.isEmpty():
            drop(found)
            return out
        again = materialise(many.dropDuplicates(["g", "node"]).select("g", "node", "left", "block", "first", "last").mapInArrow(cut_again, "up_g bigint, up_node bigint, g bigint, node bigint, left int, block binary, first int, last int"))
        drop(found)
        below = again.groupBy("g", "node").agg(F.count("*").alias("many"), *[F.first(c).alias(c) for c in ("left", "block", "first", "last")])
        below = materialise(below.withColumn("b", (F.octet_length("block") - F.col("left")).cast("long")))
        of = below.groupBy("g").agg(F.count("*").alias("n")).where("n > 1")
        inner = repeated(below.join(of, "g").select("g", "node", "n", "left", "block", "first", "last"))
        inner = inner.unionByName(below.where("many > 1").select("g", "node", (-F.col("left")).cast("long").alias("a"), "b"))
        inner = inner.select(F.col("g").alias("g2"), F.col("node").alias("node2"), "a", "b")
        inner = again.select("up_g", "up_node", "g", "node").join(inner, (F.col("g") == F.col("g2")) & (F.col("node") == F.col("node2")))
        return out.unionByName(inner.select(F.col("up_g").alias("g"), F.col("up_node").alias("node"), "a", "b"))

    partly = repeated(met_parts)
    as_whole = parts.join(nodes.where("lo <> hi").select(F.col("g").alias("g2"), F.col("node").alias("node2")), (F.col("g") == F.col("g2")) & (F.col("node") == F.col("node2")))
    as_whole = as_whole.select("h", "around", (-F.col("left")).cast("long").alias("a"), (F.octet_length("block") - F.col("left")).cast("long").alias("b"))
    in_part = parts.join(partly.select(F.col("g").alias("g3"), F.col("node").alias("node3"), "a", "b"), (F.col("g") == F.col("g3")) & (F.col("node") == F.col("node3"))).select("h", "around", "a", "b")
    # written, so that Spark can split what one surrounding brings to the join
    runs = materialise(as_whole.unionByName(in_part).groupBy("h", "around").agg(joined(F.array_sort(F.collect_set(F.struct("a", "b")))).alias("rs")))
    # surroundings that are there twice repeat as a whole; others where a part or a neighbour in the order says so
    twice = one.where("many > 1").select(F.col("h").alias("h2"), F.col("around").alias("a2"))
    whole = hits.join(twice, (F.col("h") == F.col("h2")) & (F.col("around") == F.col("a2")), "left").where("NOT mixed OR h2 IS NOT NULL")
    whole = whole.select("id", "mark", F.array(F.struct(F.greatest(F.col("at") - reach, F.lit(0)).alias("a"), F.least(F.col("at") + length, "size").alias("b"))).alias("rs"))
    some = hits.where("mixed").select("id", "mark", "h", "around", "at").join(runs.select(F.col("h").alias("h3"), F.col("around").alias("a3"), "rs"), (F.col("h") == F.col("h3")) & (F.col("around") == F.col("a3")))
    some = some.select("id", "mark", F.transform("rs", lambda r: F.struct((F.col("at") + r["a"]).alias("a"), (F.col("at") + r["b"]).alias("b"))).alias("rs"))
    spans = whole.unionByName(some).groupBy("id", "mark").agg(F.array_sort(F.flatten(F.collect_set("rs"))).alias("runs"))
    spans = materialise(spans.select(F.col("id").alias("s_id"), F.col("mark").alias("s_mark"), "runs"))
    own = {f"_tg_c{k}": base[f"`{c}`"] for k, c in enumerate(carry)}
    full = base.select(*[c.alias(k) for k, c in own.items()], F.col(id_col).alias("id"), mark.alias("mark"), text.alias("t"))
    full = full.join(spans, F.col("id").eqNullSafe(F.col("s_id")) & (F.col("mark") == F.col("s_mark")), "left").select(*own, "t", "runs")
    names = [f"_tg_c{k}" for k in range(len(carry))]
    schema = T.StructType([full.schema[c] for c in names] + [T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("kept_bytes", T.BinaryType())])

    def clip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, rest = [], []
            runs = batch["runs"]
            n = runs.value_lengths().fill_null(0).to_pylist()
            begin, end = (runs.flatten().field(k).to_pylist() for k in (0, 1))
            k = 0
            for t, many in zip(batch["t"], n, strict=True):
                t = t.as_buffer().to_pybytes()
                merged: list[list[int]] = []
                for a, b in zip(begin[k : k + many], end[k : k + many], strict=True):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                k += many
                at, kept = 0, []
                for a, b in merged:
                    kept.append(t[at:a])
                    at = b
                kept.append(t[at:])
                out.append([{"start": a, "end": b} for a, b in merged])
                rest.append(b"".join(kept) if merged else t)
            yield pa.RecordBatch.from_arrays([batch[c] for c in names] + [pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(rest, pa.binary())], names=schema.names)

    t = full.mapInArrow(clip, schema)
    return t.select(*[F.col(k).alias(c) for k, c in zip(names, carry, strict=True)], "spans", "kept_bytes")


def op2_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    t = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), carry=["doc_id"])
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda x, s: x + s["end"] - s["start"])
    return t.select("doc_id", (F.octet_length("kept_bytes") + removed).alias("n_bytes"), removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept_bytes", 256).alias("kept_sha256"))


#: Bytes as hexadecimal digits: string i of 200 bytes is the 400 digits from 2 * i on.
OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS x FROM documents
), s AS (
  SELECT r, i, md5(substr(x, 2 * i + 1, 400)) AS h FROM d, range(0, greatest(0, length(x) // 2 - 199)) AS t(i)
), hot AS (
  SELECT h FROM s GROUP BY h HAVING count(*) > 1
), hit AS (
  SELECT r, i FROM s WHERE h IN (SELECT h FROM hot)
), run AS (
  SELECT r, min(i) AS a, max(i) + 200 AS b FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY r ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM (
      SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 200 THEN 0 ELSE 1 END AS fresh FROM hit)) GROUP BY r, k
), gap AS (
  SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM run
), cut AS (
  SELECT r, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head
  FROM gap JOIN d USING (r) GROUP BY r
)
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN cut USING (r)
"""
