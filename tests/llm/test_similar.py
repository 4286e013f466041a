"""Embedding near-dedup, the n-gram join and their parts, against all pairs."""

import numpy as np

from tests.llm.helpers import EDGE, classes, edge, grams, none
from trigrid.llm import minhash
from trigrid.llm.caps import _pairs, codes, decode, near_vectors, op1_embedding_near_dedup, perhaps, rough, settled
from trigrid.llm.graph import components
from trigrid.llm.groups import forest
from trigrid.llm.minhash import banding, jaccard_join, op9_ngram_jaccard_join, shingles


def test_components(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (170, 2))] + [(i, i + 1) for i in range(1000, 1400)] + [(5000, i) for i in range(5001, 5200)]
    pairs += [(3, 3)]
    df = spark.createDataFrame([*pairs, (None, 4)], "src long, dst long")
    got = {r["node"]: r["label"] for r in components(df).collect()}
    root = classes(5200, pairs)
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: root[x] for x in linked}
    assert components(df.where("false")).count() == 0


def test_forest():
    m = np.zeros((6, 6), bool)
    for a, b in ((0, 4), (4, 2), (1, 5)):
        m[a, b] = m[b, a] = True
    assert forest(lambda r, c: m[np.ix_(r, c)], 6).tolist() == [0, 1, 0, 3, 0, 1]


def brute_vectors(rows, t=0.9):
    ok = [(i, np.array(v, float)) for i, v in rows if v is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    ok = [(i, x / abs(x).max()) for i, x in ok]
    n = len(ok)
    links, pairs = [0] * n, []
    for a in range(n):
        for b in range(a):
            x, y = ok[a][1], ok[b][1]
            if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= t:
                links[a] += 1
                links[b] += 1
                pairs.append((a, b))
    return ok, links, classes(n, pairs)


def test_near_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(60, 8)))]
    rows += [(100 + k, (np.array(rows[k % 3][1]) * 3 + rng.normal(size=8) * 0.1).tolist()) for k in range(120)]
    odd = [(300, None), (301, [0.0] * 8), (302, [1.0, None] + [0.0] * 6), (303, [float("nan")] * 8), (304, [1.0, float("inf")] + [0.0] * 6), (305, []), (306, [1.0, 0.0]), (307, [2.0, 0.0]), (308, [5.0]), (309, rows[0][1]), (309, rows[0][1]), (310, [1e300] * 8), (311, [2e300] * 8), (None, rows[1][1])]
    ok, links, root = brute_vectors(rows + odd)
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").selectExpr("*", "1 AS node", "'x' AS kept", "2 AS n")
    got = near_vectors(df).collect()
    assert len(got) == len(rows) + len(odd)
    least = {r: min(ok[k][0] for k in range(len(ok)) if root[k] == r and ok[k][0] is not None) for r in set(root)}
    want = sorted((str(i), n, least[r], i == least[r]) for (i, _), n, r in zip(ok, links, root))
    lonely = {300, 301, 302, 303, 304, 305}
    assert sorted((str(r["vec_id"]), r["n_links"], r["component_id"], r["kept"]) for r in got if r["vec_id"] not in lonely) == want
    for r in got:
        if r["vec_id"] in (300, 301, 302, 303, 304, 305):
            assert r["n_links"] == 0 and r["component_id"] == r["vec_id"] and r["kept"]
    assert near_vectors(df.where("false")).count() == 0


def test_many_blocks(spark, monkeypatch):
    """Groups of more than a block, of copies that differ."""
    from trigrid.llm import caps

    monkeypatch.setattr(caps, "BLOCK", 256)
    rng = np.random.default_rng(3)
    rows = [(i, (np.ones(8) + rng.normal(size=8) * (0.05 + 0.4 * (i % 2))).tolist()) for i in range(1400)]
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hit = x @ x.T >= 0.9
    got = {r["vec_id"]: r for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    big = classes(1400, np.argwhere(hit).tolist())
    assert [got[i]["component_id"] for i in range(1400)] == big
    assert [got[i]["n_links"] for i in range(1400)] == (hit.sum(1) - 1).tolist()


def planted_vectors(n, dim, pairs, seed):
    """n random vectors, the first of them with partners at cosines from 0.9 to 0.96."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    w = rng.normal(size=(pairs, dim))
    w -= (w * x[:pairs]).sum(1, keepdims=True) * x[:pairs]
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    c = np.linspace(0.9 + 1e-9, 0.96, pairs)[:, None]
    return np.concatenate([x, c * x[:pairs] + np.sqrt(1 - c**2) * w])


def test_planted_pairs(spark):
    """All of 600 pairs at and above the threshold among 20,000 vectors of 64 dimensions, with the default settings."""
    import pandas as pd

    x = planted_vectors(20_000, 64, 600, 6)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": list(x)}))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_vectors(df).where("n_links > 0").collect()}
    assert got == {i: (1, i % 20_000) for k in range(600) for i in (k, 20_000 + k)}


def test_rough():
    """Eight bits never lose a pair at the threshold."""
    rng = np.random.default_rng(8)
    for dim in (1, 2, 64, 700):
        u, v = _pairs(400, dim, 0.9, 3)
        if dim == 1:
            v = u
        x = np.concatenate([u, v / np.linalg.norm(v, axis=1, keepdims=True)])
        q, tail = rough(x)
        test = perhaps(np.concatenate([q.view(np.uint8), tail.view(np.uint8).reshape(len(q), 8)], 1), 0.9)
        assert test(np.arange(400), np.arange(400, 800)).diagonal().all()
    x = rng.normal(size=(200, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q, tail = rough(x)
    far = perhaps(np.concatenate([q.view(np.uint8), tail.view(np.uint8).reshape(len(q), 8)], 1), 0.9)(np.arange(200), np.arange(200))
    assert (far == ((x @ x.T) >= 0.9)).all()


def test_op1(spark):
    rows = [(r[0], r[1]) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding").collect()]
    ok, links, root = brute_vectors(rows)
    got = {r["vec_id"]: r for r in op1_embedding_near_dedup(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(rows)
    for (i, _), n, r in zip(ok, links, root):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (n, ok[r][0], i == ok[r][0])


def test_decode():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(20, 10))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    turn, one, two = codes(10, 30)
    y = x @ turn
    every = np.array([[np.concatenate([a, b]) / 2**0.5 for b in two] for a in one]).reshape(900, 10)
    want = y @ every.T >= 0.5
    for i, got in enumerate(decode(x, 0.5, 30)):
        assert sorted(got) == np.flatnonzero(want[i]).tolist()
    for n in (3, 300, 10_000):
        alpha, words, seeds = settled(n, 64, 0.9)
        assert 0 < alpha < 0.6 and 1 < words < 1000 and len(seeds) > 1, n


def test_planted_pairs(spark):
    """Pairs at 0.90 to 0.99 among more vectors than one filter holds, by default settings."""
    rng = np.random.default_rng(11)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    u, w = unit(rng.normal(size=(1000, 64))), rng.normal(size=(1000, 64))
    u[:300, :32] *= 0.2  # lopsided in the axes as given
    u = unit(u)
    w = unit(w - (w * u).sum(1, keepdims=True) * u)
    cos = np.repeat([0.9005, 0.93, 0.96, 0.99], 250)[rng.permutation(1000)][:, None]
    x = np.concatenate([u, cos * u + np.sqrt(1 - cos**2) * w])
    hit = x @ x.T >= 0.9
    assert hit.sum() >= 4000
    got = {r["vec_id"]: r for r in near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    big = classes(2000, np.argwhere(hit).tolist())
    assert [(got[i]["component_id"], got[i]["n_links"]) for i in range(2000)] == [(big[i], hit[i].sum() - 1) for i in range(2000)]
    alpha, words, seeds = settled(50_000, 64, 0.9)
    assert min(sum(map(len, f)) for f in zip(*[decode(x, alpha, words, s) for s in seeds])) > 0


def test_shingles():
    texts = [b"", b"a b c d e f", b"  a b c d\te  ", b"a b", b" \n ", b"a b", b"b c d e f", "é é é é é é é".encode()]
    g, at = shingles(texts)
    n = np.diff(at).tolist()
    assert n == [0, 2, 1, 1, 0, 1, 1, 3]
    s = [g[a:b].tolist() for a, b in zip(at, at[1:])]
    assert s[1] == s[2] + s[6] and s[3] == s[5] and s[7][0] == s[7][1] == s[7][2] and s[3] != s[2]
    bands, rows = banding(0.8, 0.9999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999 and bands * rows <= 160


def brute_join(rows, t=0.8):
    s = [grams(x) for _, x in rows]
    by = {}
    for i, g in enumerate(s):
        for x in g:
            by.setdefault(x, []).append(i)
    near = {(a, b) for m in by.values() for i, a in enumerate(m) for b in m[:i]}
    pairs = [(a, b) for a, b in near if len(s[a] & s[b]) >= t * len(s[a] | s[b]) - 1e-9]
    links = [0] * len(rows)
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    return links, classes(len(rows), pairs)


def test_op9(spark):
    rows = sorted((r[0], r[1]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect())
    links, root = brute_join(rows)
    got = {r["doc_id"]: r for r in op9_ngram_jaccard_join(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(rows) and sum(links) > 20
    for (i, _), n, r in zip(rows, links, root):
        assert (got[i]["n_links"], got[i]["class_id"], got[i]["kept"]) == (n, rows[r][0], i == rows[r][0]), i


def test_join_edges(spark):
    df = edge(spark).drop("n_chars")
    got = jaccard_join(df).collect()
    assert len(got) == len(EDGE) and "Size" in got[0].asDict()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert [(r["class_id"], r["n_links"], r["kept"]) for r in by[0] + by[1] + by[2]] == [(0, 0, True), (1, 0, True), (2, 0, True)]
    three = [r for r in got if (r["text"] or "").split() == ["one", "two", "three"]]
    assert len(three) == 5 and {(r["class_id"], r["n_links"]) for r in three} == {(3, 4)} and sum(r["kept"] for r in three) == 1 and by[3][0]["kept"]
    assert by[7][0]["class_id"] == 6 and by[6][0]["n_links"] == 1
    lost = next(r for r in got if r["doc_id"] is None and r["text"] is None)
    assert lost["class_id"] is None and lost["kept"]
    assert jaccard_join(none(spark)).count() == 0


def test_near_group(spark, monkeypatch):
    """A large group of near copies, in several blocks, against all pairs."""
    monkeypatch.setattr("trigrid.llm.groups.BLOCK", 50)
    monkeypatch.setattr("trigrid.llm.groups.block_pairs.__defaults__", (50,))
    import random

    rnd = random.Random(6)
    words = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(260):
        w = list(words)
        for _ in range(rnd.randint(0, 4)):
            w[rnd.randrange(120)] = f"x{rnd.randrange(40)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, f"own {i} text of its own here {i}") for i in range(50)]
    links, root = brute_join(rows)
    got = {r["doc_id"]: r for r in jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all((got[i]["n_links"], got[i]["class_id"]) == (n, rows[r][0]) for (i, _), n, r in zip(rows, links, root))
    assert minhash.overlaps([np.array([1, 2, 3]), np.array([2, 3, 4]), np.array([9])]).tolist()[0][1] == 2
