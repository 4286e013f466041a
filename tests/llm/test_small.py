"""Exact dedup, sharding, mixing, packing, language ID: brute force and edge cases."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest

from tests.llm.helpers import EDGE, crc, edge, none, words
from trigrid.llm.exact_dedup import exact_dedup, op3_exact_dedup
from trigrid.llm.langid import BUCKETS, held_out, identify, learn, op10_language_id, train
from trigrid.llm.mixing import mix, op6_mixing, targets
from trigrid.llm.packing import Tightest, pack_documents, plan, op7_packing
from trigrid.llm.sharding import op4_sharding, shard_documents

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def check_exact(rows, got):
    by = defaultdict(list)
    for i, t in rows:
        by[norm(t)].append(i)
    assert len(got) == len(rows)
    kept = Counter()
    for r in got:
        g = by[norm(r["text"])]
        ids = [i for i in g if i is not None]
        assert r["keep_id"] == (min(ids) if ids else None)
        assert r["group_size"] == len(g)
        assert r["text_sha256"] == hashlib.sha256(norm(r["text"]).encode()).hexdigest()
        if r["kept"]:
            kept[norm(r["text"])] += 1
            assert r["doc_id"] == r["keep_id"]
    assert kept == Counter(dict.fromkeys(by, 1))


def test_exact_dedup(spark, docs):
    check_exact([(r[0], r[1]) for r in EDGE], exact_dedup(edge(spark)).collect())
    assert exact_dedup(none(spark)).count() == 0
    hot = [(i, "same text here" if i % 3 else f"own {i}") for i in range(3000)]
    check_exact(hot, exact_dedup(spark.createDataFrame(hot, "doc_id long, text string").repartition(5)).collect())
    got = op3_exact_dedup(spark, SF)
    assert got.columns[:5] == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    text = {d["doc_id"]: d["text"] for d in docs}
    check_exact([(d["doc_id"], d["text"]) for d in docs], [{**r.asDict(), "text": text[r["doc_id"]]} for r in got.collect()])


def test_broken_runs(spark, monkeypatch):
    """Runs that are passed on in pieces, and that lie in several ranges."""
    from trigrid.llm import exact_dedup as module

    monkeypatch.setattr(module, "HELD", 500)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, "7")
    try:
        rows = [(i * 7919 % 3001, ["one  text", "one text", "x" * 3000, "x" * 3001, f"own {i}", None][i % 6]) for i in range(3000)] + [(None, "one text")] * 40
        check_exact(rows, exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect())
    finally:
        spark.conf.unset(key)


def check_shards(rows, got, shards):
    assert len(got) == len(rows)
    size = Counter()
    slots = defaultdict(list)
    for r in got:
        assert r["size"] == len((r["text"] or "").encode()) + 8 and r["text_crc32"] == crc((r["text"] or "").encode())
        assert 0 <= r["shard"] < shards and r["law"] == "bytes" and r["grown_shard"] is None
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    return size


def test_sharding(spark, docs):
    check_shards(EDGE, shard_documents(edge(spark), 3).collect(), 3)
    assert shard_documents(none(spark), 3).count() == 0
    hot = [(i, "same text here" if i % 3 else f"own {i}") for i in range(3000)]
    got = shard_documents(spark.createDataFrame(hot, "doc_id long, text string"), 24).collect()
    size = check_shards(hot, got, 24)
    assert max(size.values()) - min(size.values()) <= 2 * (14 + 8)
    loose = shard_documents(spark.createDataFrame(hot, "doc_id long, text string"), 24, tolerance=0.2).collect()
    size = check_shards(hot, loose, 24)
    assert max(size.values()) <= 1.45 * sum(size.values()) / 24
    text = {d["doc_id"]: d["text"] for d in docs}
    got = [{**r.asDict(), "text": text[r["doc_id"]]} for r in op4_sharding(spark, SF).collect()]
    size = check_shards(docs, got, 24)
    largest = max(r["size"] for r in got)
    assert max(size.values()) - sum(size.values()) / 24 <= largest
    # shards are ranges of one order, and few groups of copies are cut
    cut = sum(len(s) > 1 for s in _by(got, "text", "shard").values())
    assert cut <= 23


def _by(rows, key, value):
    out = defaultdict(set)
    for r in rows:
        out[r[key]].add(r[value])
    return out


def level(sizes, weights=(5.0, 2.0, 1.0), share=1.5, most=2.0):
    """The contract by its words: share by weight, stop at the cap, reshare the excess until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    got, open_, left = dict.fromkeys(names, 0.0), set(names), share * sum(sizes.values())
    while open_ and left > 1e-9:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if got[s] + left * w[s] / total >= most * sizes[s]}
        if not over:
            for s in open_:
                got[s] += left * w[s] / total
            break
        give = 0.0
        for s in open_:
            x = min(left * w[s] / total, most * sizes[s] - got[s])
            got[s] += x
            give += x
        left -= give
        open_ -= over
    return got


def test_mixing(spark, docs):
    for rows, df in (([(d["doc_id"], d["text"], d["source"]) for d in docs], None), ([(r[0], r[1], r[3]) for r in EDGE], mix(edge(spark)))):
        got = (op6_mixing(spark, SF) if df is None else df).collect()
        source = {d["doc_id"]: d["source"] for d in docs}
        size, taken, target = Counter(), Counter(), {}
        for r in got:
            s = source[r["doc_id"]] if df is None else r["source"]
            size[s] += r["size"]
            taken[s] += r["taken"]
            target[s] = (r["target"], r["source_size"])
            assert r["taken"] == r["size"] * r["copies"] <= 2 * r["size"]
        assert sorted(r["size"] for r in got) == sorted(len(words(x[1])) for x in rows)
        want = level(size)
        for s in size:
            assert target[s][1] == size[s] and abs(target[s][0] - want[s]) < 1e-6 * max(1, want[s])
        if df is None:
            assert abs(sum(taken.values()) - 1.5 * sum(size.values())) < 0.05 * sum(size.values())
            again = {r["doc_id"]: r["taken"] for r in op6_mixing(spark, SF).collect()}
            assert again == {r["doc_id"]: r["taken"] for r in got}
    assert mix(none(spark)).count() == 0
    many = [(i, "w " * (1 + i * 37 % 200), f"s{i % 4}" if i % 3 else "s0") for i in range(4000)]
    got = mix(spark.createDataFrame(many, "doc_id long, text string, source string")).collect()
    for s in {r["source"] for r in got}:
        mine = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 100


def brute_mix(rows):
    """(doc_id, source, size) rows -> (row, copies) of the mix, one document after another."""
    size = Counter()
    for _, s, n in rows:
        size[s] += n
    goal, seen, out = {s: 2.0 * size[s] if abs(x - 2 * size[s]) < 1e-6 else x for s, x in level(size).items()}, Counter(), []
    ranked = {}
    for d, s, n in rows:
        k = seen[d, s, n]
        seen[d, s, n] += 1
        r = goal[s] / size[s] if size[s] else 0.0
        p = r - math.floor(r)
        name = ",".join("~" if x is None else str(x) for x in (d, s, n, k, 7))
        u = (int(hashlib.md5(name.encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        odds = (u / (1 - u)) / (p / (1 - p)) if p > 0 else None
        ranked.setdefault(s, []).append([odds / (1 + odds) if p > 0 else None, d, n, math.floor(r)])
    for s, mine in ranked.items():
        r = goal[s] / size[s] if size[s] else 0.0
        rest = goal[s] - math.floor(r) * size[s]
        order = sorted((x for x in mine if x[0] is not None), key=lambda x: x[0])
        got, full, left = 0, False, []
        for x in order:
            full = full or got + x[2] > rest
            if full:
                left.append(x)
            else:
                got += x[2]
                x[3] += 1
        near = [x for x in left if x[2] > 0 and abs(rest - got - x[2]) < rest - got]
        if near:
            min(near, key=lambda x: (abs(rest - got - x[2]), x[0]))[3] += 1
        out += [(str(x[1]), str(s), x[2], x[3]) for x in mine]
    return sorted(out)


def test_mixing_brute_force(spark, monkeypatch):
    """Rank by rank, with repeated rows, null sources and identifiers, and cells refined more than once."""
    from trigrid.llm import mixing

    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "b", "c", "é", None, "zero"]), rng.choice([0, 1, 7, 50, 300])) for i in range(900)]
    rows = [(d, s, 0 if s == "zero" else n) for d, s, n in rows]
    rows += [(5000, "b", 50)] * 400 + [(5001, "b", 50)] * 3 + [(None, None, 7)] * 20 + [(None, "a", 1)]
    rows += [(6000 + i, "big", 40 + i % 5) for i in range(200)]
    for few in (mixing.FEW, 1):
        monkeypatch.setattr(mixing, "FEW", few)
        monkeypatch.setattr(mixing, "BITS", 12 if few > 1 else 2)
        df = spark.createDataFrame(rows, "doc_id long, source string, size long").repartition(5)
        got = mix(df, text_col=None).collect()
        assert sorted((str(r["doc_id"]), str(r["source"]), r["size"], r["copies"]) for r in got) == brute_mix(rows)
    taken, goal = Counter(), {}
    for r in got:
        taken[r["source"]] += r["taken"]
        goal[r["source"]] = r["target"]
    assert all(abs(taken[s] - goal[s]) <= 25 for s in goal), (taken, goal)


def test_mixing_repeated(spark):
    """Forty equal rows: the mix comes as near to the target as one row allows."""
    rows = [(1, "w " * 50, "b")] * 40 + [(i, "w " * 60, "a") for i in range(2, 120)]
    got = mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)).where("source = 'b'").collect()
    assert len(got) == 40 and abs(sum(r["taken"] for r in got) - got[0]["target"]) <= 25


def bfd(lengths, capacity):
    """One piece after another, over a plain list."""
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = [b for b in range(len(bins)) if bins[b] >= n]
        if fit:
            bins[min(fit, key=lambda b: bins[b])] -= n
        else:
            bins.append(capacity - n)
    return len(bins)


def test_plan():
    import random

    rnd = random.Random(4)
    for _ in range(60):
        cap = rnd.choice([1, 7, 16, 64])
        lengths = [rnd.randint(1, cap) for _ in range(rnd.randint(0, 300))]
        steps, bins = plan(Counter(lengths), cap)
        assert bins == bfd(lengths, cap)
    tree = Tightest(2048)
    tree.add(5, 1)
    assert (tree.find(0), tree.find(5), tree.find(6)) == (5, 5, -1)
    tree.add(2048, 1)
    assert tree.find(6) == 2048
    tree.add(5, -1)
    assert tree.find(0) == 2048


def check_packed(rows, got, capacity):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    want = Counter()
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        head = len(ids) % capacity if len(ids) > capacity else len(ids)
        cuts = [0, *range(head or capacity, len(ids) + 1, capacity)] if len(ids) > capacity else [0, len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[(i, k, a, b - a, crc(b"".join(x.to_bytes(4, "little") for x in ids[a:b])))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in by.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= capacity
    assert len(by) == bfd([r["length"] for r in got], capacity)


def test_packing(spark, docs):
    import public_tokenizers

    check_packed([(d["doc_id"], d["text"]) for d in docs], op7_packing(spark, SF).collect(), 2048)
    p = pack_documents(edge(spark), public_tokenizers.path("byte_bpe_50k.json"), capacity=64)
    assert "ids" in p.columns
    check_packed([(r[0], r[1]) for r in EDGE], p.collect(), 64)
    assert pack_documents(none(spark), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_language_id(spark, docs):
    got = {r["doc_id"]: r for r in op10_language_id(spark, "/root/testdata/sf0.01").collect()}
    full = [r.asDict() for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    held = [d for d in full if crc(str(d["doc_id"]).encode()) % 5 == 0]
    assert len(got) == len(full) and all(got[d["doc_id"]]["held_out"] for d in held) and sum(r["held_out"] for r in got.values()) == len(held)
    right = sum(got[d["doc_id"]]["lang_pred"] == d["lang"] for d in held if d["lang"])
    assert right >= 0.97 * sum(bool(d["lang"]) for d in held)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert sum(r["rejected"] for r in got.values()) <= 0.02 * len(got)
    model = learn(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"))
    e = identify(edge(spark), model).collect()
    assert len(e) == len(EDGE)
    for r in e:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and (letters or (r["rejected"] and r["score"] == 0))
    assert identify(none(spark), model).count() == 0
    empty = learn(edge(spark).where("false"))
    assert {r["lang_pred"] for r in identify(edge(spark), empty).collect()} == {"und"}
    assert train([("xx", b"abc")]).labels == ["xx"]
    # a text longer than one look counts whole
    m = train([("a", b"aba bab " * 50), ("b", b"xyx yxy " * 50)] * 10)
    assert m.labels[int(m.logits(b"aba bab " * 10 + b"xyx yxy " * 400_000).argmax())] == "b"


def naive_scores(model, text):
    """One n-gram after another, in whole numbers."""
    fold = lambda b: ord(chr(b).lower()) if b < 128 and chr(b).isalpha() else (32 if b < 128 else b)
    x = [fold(b) for b in b" " + text.encode() + b" "] + [32] * 3
    low = (1 << 32) - 1

    def bucket(h, k):
        h = h * k & low
        return ((h ^ (h >> 15)) * 0x85EBCA6B & low) >> 17

    total, n = [0.0] * len(model.labels), 2 * (len(x) - 3)
    for i in range(len(x) - 3):
        tri = (x[i] << 16) | (x[i + 1] << 8) | x[i + 2]
        four = (tri << 8 & low) | x[i + 3]
        for f in (bucket(tri, 0x9E3779B1), bucket(four, 0xC2B2AE3D)):
            assert f < BUCKETS
            for c in range(len(total)):
                total[c] += float(model.table[f, c])
    z = [(t / n + float(b)) / model.temperature for t, b in zip(total, model.bias)]
    e = [math.exp(v - max(z)) for v in z]
    return [v / sum(e) for v in e]


def test_language_brute_force(spark, docs):
    """Predictions of a trained model, against one n-gram after another; every label is learned, however rare."""
    model = learn(spark.read.parquet(f"{SF}/documents.parquet"), where=~held_out())
    got = {r["doc_id"]: r for r in op10_language_id(spark, SF).collect()}
    assert len(got) == len(docs)
    for d in docs:
        r = got[d["doc_id"]]
        if d["text"] is None or not re.search(r"[^\W\d_]", d["text"]):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        p = naive_scores(model, d["text"])
        best = max(range(len(p)), key=p.__getitem__)
        assert r["lang_pred"] == model.labels[best] and abs(r["score"] - p[best]) < 1e-6
    rows = [(i, f"wort{i % 7} und ", f"l{i % 300}") for i in range(900)] + [(1000, "solo", "rare")]
    model = learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.labels) == 301
