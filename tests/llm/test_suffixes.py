import hashlib
import random

import numpy as np

from tests.llm.helpers import EDGE, edge, none
from trigrid.llm import suffixes
from trigrid.llm.suffixes import anchors, op2_suffix_array_dedup, remove_repeats, repeats, two_stage


def brute(texts, length):
    """Spans of each text covered by strings that start more than once in all of them."""
    seen = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        runs = []
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                if runs and i <= runs[-1][1]:
                    runs[-1][1] = i + length
                else:
                    runs.append([i, i + length])
        out.append(runs)
    return out


def test_two_stage():
    rng = random.Random(1)
    for k in range(60):
        alphabet = rng.choice([b"ab", b"a", bytes(range(256)), b"abcdefgh \n"])
        data = bytes(rng.choice(alphabet) for _ in range(rng.randint(0, 400)))
        if k % 3 == 0:
            data = data[:50] * 4 + data
        depth = rng.choice([8, 16, 24, 200])
        sa, cls = two_stage(np.frombuffer(data, np.uint8), depth)
        assert sorted(sa.tolist()) == list(range(len(data)))
        order = [data[i : i + depth] for i in sa]
        # byte 0 stands for what is past the end, so compare up to that
        pad = [x.ljust(depth, b"\0") for x in order]
        assert all(a[: min(len(x), len(y))] <= b[: min(len(x), len(y))] for a, b, x, y in zip(pad, pad[1:], order, order[1:]))
        for (a, x), (b, y) in zip(zip(order, cls), zip(order[1:], cls[1:])):
            assert (x == y) == (a == b and len(a) == depth)


def test_anchors():
    rng = random.Random(2)
    common = bytes(rng.choice(b"abcd ") for _ in range(260))
    texts = [bytes(rng.choice(b"abcd ") for _ in range(rng.randint(0, 900))) for _ in range(20)]
    texts = [t[:100] + common + t[100:] if i % 3 == 0 else t for i, t in enumerate(texts)] + [b"", b"x" * 199, b"x" * 200, b"ab" * 300]
    of, at, h = anchors(texts, 200)
    by = [set() for _ in texts]
    for i, p, x in zip(of, at, h):
        by[i].add((p, x))
    for i, t in enumerate(texts):
        for w in range(len(t) - 199):
            assert any(w <= p <= w + 136 for p, _ in by[i])
    for a in range(0, 20, 3):  # equal strings have equal anchors at equal offsets
        for w in range(60):
            f = lambda i: {(p - 100 - w, x) for p, x in by[i] if 100 + w <= p <= 100 + w + 136}
            assert f(a) & f(0)


def test_pieces(monkeypatch):
    rng = random.Random(3)
    t = bytes(rng.choice(b"abcdef ") for _ in range(5000))
    whole = list(zip(*map(np.ndarray.tolist, anchors([t], 200))))
    monkeypatch.setattr(suffixes, "CHUNK", 300)
    assert list(zip(*map(np.ndarray.tolist, anchors([t], 200)))) == whole


def test_repeats():
    a = b"0123456789abcdefghijklmnopqrstuvwxyz"
    got = repeats([a, b"__" + a, a], [5, 7, 6], np.array([0, 0, 0]), 20)
    assert got == [[(-5, 31)], [(-5, 31)], []]  # the third has them at another offset
    assert repeats([a, a], [5, 5], np.array([0, 1]), 20) == [[], []]


def check(rows, got, length):
    texts = [(t or "").encode() for _, t in rows]
    want = {}
    for (i, _), t, s in zip(rows, texts, brute(texts, length)):
        kept, at = b"", 0
        for a, b in s:
            kept, at = kept + t[at:a], b
        want.setdefault(i, []).append((tuple(map(tuple, s)), kept + t[at:]))
    have = {}
    for r in got:
        have.setdefault(r["doc_id"], []).append((tuple((x["start"], x["end"]) for x in r["spans"]), bytes(r["kept_bytes"])))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}


def test_against_all_strings(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = [text(30) for _ in range(4)]
    rows = [(i, " ".join([text(rng.randint(0, 30)), rng.choice(passage)[rng.randint(0, 9) :], text(rng.randint(0, 30))])) for i in range(60)]
    rows += [(100, "Is so. " * 60), (101, "Is so. " * 8), (102, "x" * 300), (103, rows[0][1]), (103, rows[0][1]), (104, "a" + rows[1][1][:80] + "b" + rows[1][1][:80]), (None, rows[2][1]), (None, None), (105, "")]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), length=50).collect()
    check(rows, got, 50)


def test_blocks(spark, monkeypatch):
    monkeypatch.setattr("trigrid.llm.groups.block_pairs.__defaults__", (20,))
    rng = random.Random(5)
    common = "".join(rng.choice("abcdefgh ") for _ in range(120))
    rows = [(i, "".join(rng.choice("abcdefgh ") for _ in range(40)) + common[: 60 + i % 60] + "".join(rng.choice("abcdefgh ") for _ in range(40))) for i in range(150)]
    check(rows, remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=50).collect(), 50)


def test_hot_groups(spark, monkeypatch):
    """Many different parts with the same shared bytes, dealt again and again, down to single strings."""
    from trigrid.llm import suffixes

    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    core = text(140)
    rows = [(i, text(rng.randint(0, 40)) + core[rng.randint(0, 30) : 140 - rng.randint(0, 30)] + text(rng.randint(0, 40))) for i in range(150)]
    rows += [(300 + i, core[:70] + rng.choice("xyz") + core[71:]) for i in range(20)] + [(400, rows[0][1])] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for hot in (0, 3, 40):
        monkeypatch.setattr(suffixes, "HOT", hot)
        check(rows, remove_repeats(df, length=50).collect(), 50)


def test_edges(spark):
    got = remove_repeats(edge(spark)).collect()
    assert len(got) == len(EDGE) and "Size" in got[0].asDict()
    check([(r[0], r[1]) for r in EDGE if r[0] not in (6, 7)], [r for r in got if r["doc_id"] not in (6, 7)], 200)
    long = {r["doc_id"]: r for r in got if r["doc_id"] in (6, 7)}
    assert len(long[6]["kept_bytes"]) == 0 and long[7]["kept_bytes"].endswith(b"end")
    assert remove_repeats(none(spark)).count() == 0


def test_op2(spark):
    rows = [(r[0], r[1]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: r for r in op2_suffix_array_dedup(spark, "/root/testdata/sf0.001").collect()}
    texts = [(t or "").encode() for _, t in rows]
    for (i, _), t, s in zip(rows, texts, brute(texts, 200)):
        kept, at = b"", 0
        for a, b in s:
            kept, at = kept + t[at:a], b
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(t), sum(b - a for a, b in s), len(s), hashlib.sha256(kept + t[at:]).hexdigest())
    assert sum(r["n_removed"] for r in got.values()) > 0
