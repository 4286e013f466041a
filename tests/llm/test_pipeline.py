"""Each stage against brute force over the same input."""

from collections import Counter, defaultdict

import corpus_pipeline as P
from tests.llm.helpers import edge
from tests.llm.test_similar import brute_join
from tests.llm.test_small import bfd, level, norm
from tests.llm.helpers import words
from trigrid.llm.scratch import materialise


def test_stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = [r.asDict() for r in docs.collect()]
    for name, stage in P.STAGES:
        out = stage(spark, docs, sf)
        if name != "packing":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            docs = out = materialise(out)
        after = [r.asDict() for r in out.collect()]
        ids = {r["doc_id"] for r in after}
        if name == "language":
            assert len(after) >= 0.98 * len(before)
            assert all(r in before for r in after[:50])
        elif name == "exact_dedup":
            first = {}
            for r in sorted(before, key=lambda r: r["doc_id"]):
                first.setdefault(norm(r["text"]), r["doc_id"])
            assert ids == set(first.values()) and len(after) == len(ids)
        elif name == "near_dedup":
            rows = sorted((r["doc_id"], r["text"]) for r in before)
            _, root = brute_join(rows)
            assert ids == {rows[k][0] for k in set(root)} and len(after) == len(ids)
        elif name == "mixing":
            size, taken = Counter(), Counter()
            for r in before:
                size[r["source"]] += len(words(r["text"]))
            for r in after:
                taken[r["source"]] += len(words(r["text"]))
            copies = Counter(r["doc_id"] for r in after)
            assert max(copies.values()) <= 2
            want = level(size)
            assert sum(abs(taken[s] - want[s]) for s in size) <= 0.05 * sum(want.values())
        else:
            copies = Counter(r["doc_id"] for r in before)
            assert {k: v for k, v in Counter(r["doc_id"] for r in after if r["piece"] == 0).items()} == copies
            by = defaultdict(int)
            for r in after:
                by[r["sequence_id"]] += r["length"]
                assert len(r["ids"]) == 4 * r["length"]
            assert max(by.values()) <= 2048 and len(by) == bfd([r["length"] for r in after], 2048)
        before = after
    assert P.ORACLE_SQL is None


def test_edges(spark):
    docs = edge(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for empty in (False, True):
        t = docs.where("false") if empty else docs
        for name, stage in P.STAGES:
            t = stage(spark, t, "")
            t = t if name == "packing" else materialise(t)
        assert (t.count() == 0) == empty
