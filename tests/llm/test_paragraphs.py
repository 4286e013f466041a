import random
import re

import numpy as np

from tests.llm.helpers import EDGE, classes, edge, grams, none
from trigrid.llm import minhash
from trigrid.llm.minhash import THRESHOLD, banding
from trigrid.llm.paragraphs import HASHES, LEAST_WORDS, RECALL, dedup_paragraphs, nodes_of, op8_substring_dedup, paragraphs


def test_paragraphs():
    rng = random.Random(1)
    text = lambda n: " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(n))
    passage = text(60)
    texts = [text(40) + " " + passage + " " + text(30) + "\n" + text(9), b"".decode(), passage, "x " + passage + " y", "one two", text(200) + "\n\n" + passage]
    p = paragraphs([t.encode() for t in texts])
    for i, t in enumerate(texts):
        mine = np.flatnonzero(p["text"] == i)
        b = t.encode()
        at = [(int(p["start"][k]), int(p["end"][k])) for k in mine]
        assert all(x[1] == y[0] for x, y in zip(at, at[1:]) if True) or i in (1, 4)
        for k, (s, e) in zip(mine, at):
            assert len(b[s:e].split()) == p["words"][k]
            assert grams(b[s : p["reach"][k]].decode()) and len(b[s : p["reach"][k]].split()) >= 5
    # nearly all of the passage is cut alike wherever it stands
    node = nodes_of(p)
    sets = [set(node[p["text"] == i].tolist()) for i in range(len(texts))]
    for i in (0, 3, 5):
        common = sets[i] & sets[2]
        assert sum(p["words"][k] for k in np.flatnonzero(p["text"] == i) if node[k] in common) >= 20


def brute(rows, t=0.8):
    """All pairs of paragraphs, by exact sets."""
    spots = []
    for i, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        b = (text or "").encode()
        p = paragraphs([b])
        spots += [(i, text, int(p["number"][k]), int(p["start"][k]), int(p["end"][k]), int(p["words"][k]), grams(b[p["start"][k] : p["reach"][k]].decode())) for k in range(len(p["number"]))]
    by = {}
    for k, s in enumerate(spots):
        for g in s[-1]:
            by.setdefault(g, []).append(k)
    near = {(a, b) for m in by.values() for x, a in enumerate(m) for b in m[:x]}
    root = classes(len(spots), [(a, b) for a, b in near if len(spots[a][-1] & spots[b][-1]) >= t * len(spots[a][-1] | spots[b][-1]) - 1e-9])
    size = {}
    for r in root:
        size[r] = size.get(r, 0) + 1
    out = {}
    for k, s in enumerate(spots):
        if size[root[k]] > 1:
            out.setdefault((s[0], s[1]), []).append((s[2], s[3], s[4], s[5], root[k] != k))
    final = {}
    for key, m in out.items():
        keep, run = [], []
        for x in [*m, None]:
            if run and (x is None or x[0] != run[-1][0] + 1):
                keep += [(y[1], y[2], y[4]) for y in run] if sum(y[3] for y in run) >= LEAST_WORDS else []
                run = []
            run.append(x)
        final[key] = keep
    return final


def check(rows, got):
    want = brute(rows)
    lost = 0
    for r in got:
        have = [(x["start"], x["end"], x["removed"]) for x in r["repeats"]]
        lost += have != want.get((r["doc_id"], r["text"]), [])
        b, at, rest = (r["text"] or "").encode(), 0, b""
        for a, e, gone in have:
            if gone:
                rest, at = rest + b[at:a], e
        assert r["kept_text"] == (rest + b[at:]).decode()
    return lost


def test_against_all_pairs(spark):
    rng = random.Random(2)
    text = lambda n: " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(n))
    passage = [text(60) for _ in range(5)]
    rows = [(i, text(rng.randint(0, 50)) + " " + rng.choice(passage) + " " + text(rng.randint(0, 50))) for i in range(80)]
    rows += [(200 + i, text(120)) for i in range(20)] + [(300, rows[0][1]), (300, rows[0][1]), (None, rows[1][1]), (301, None), (302, "")]
    got = dedup_paragraphs(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(got) == len(rows)
    assert check(rows, got) <= 2  # banding may miss a pair at the threshold
    for r in got:
        if r["doc_id"] is not None and 200 <= r["doc_id"] < 220:
            assert not r["repeats"]
        elif r["doc_id"] is not None and 10 < r["doc_id"] < 80:
            assert sum(x["removed"] for x in r["repeats"])


def test_edges(spark):
    got = dedup_paragraphs(edge(spark)).collect()
    assert len(got) == len(EDGE) and "Size" in got[0].asDict()
    assert check([(r[0], r[1]) for r in EDGE], got) == 0
    assert dedup_paragraphs(none(spark)).count() == 0


def test_op8(spark):
    rows = [(r[0], r[1]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    got = op8_substring_dedup(spark, "/root/testdata/sf0.01").collect()
    want = brute(rows)
    text = dict(rows)
    lost = sum([(x["start"], x["end"], x["removed"]) for x in r["repeats"]] != want.get((r["doc_id"], text[r["doc_id"]]), []) for r in got)
    assert len(got) == len(rows) and lost <= 0.01 * len(rows) and sum(r["n_removed"] for r in got) > 0
    assert re


def test_planted(spark):
    """Equal lines between unlike ones are found whole, by their bytes; passages inside longer lines but for their ends."""
    rng = random.Random(4)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(4, 9))) for _ in range(n))
    shared = {k: text(k) for k in (*range(16, 60), 80, 150)}
    short = "\n".join(text(4) for _ in range(6))  # lines without an n-gram
    rows, wanted = [], {}
    for k, x in [*shared.items(), (0, short)]:
        for side in (0, 1):
            rows.append((2 * k + side, text(rng.randint(3, 40)) + "\n" + x + "\n" + text(rng.randint(3, 40))))
            wanted[2 * k + side] = {(w.start(), w.end()) for w in re.finditer(r"\S+", rows[-1][1]) if rows[-1][1].index(x) <= w.start() < rows[-1][1].index(x) + len(x)}
    passage = {k: text(k) for k in range(60, 100)}
    rows += [(1000 + 2 * k + side, text(30) + " " + x + " " + text(30)) for k, x in passage.items() for side in (0, 1)]
    got = {r["doc_id"]: r for r in dedup_paragraphs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    caught = lambda i, t: {(w.start(), w.end()) for w in re.finditer(r"\S+", t) if any(x["start"] <= w.start() < x["end"] for x in got[i]["repeats"])}
    for i, t in rows:
        if i < 1000:
            assert caught(i, t) == wanted[i], i
    inner = sum(len(caught(i, t)) for i, t in rows if i >= 1000)
    assert inner >= 0.6 * 2 * sum(passage), inner / sum(passage) / 2
    assert all(len(caught(i, t)) <= (i - 1000) // 2 + 6 for i, t in rows if i >= 1000)


def test_recall():
    """The registered bands find a pair at the threshold as surely as op9's."""
    bands, rows = banding(THRESHOLD, RECALL, HASHES)
    assert 1 - (1 - THRESHOLD**rows) ** bands >= minhash.RECALL and bands * rows <= HASHES
