import hashlib

from pyspark.sql import Row
from pyspark.sql import functions as F

from trigrid.llm.chat import PARTS, escaped, format_conversations, loss_text, op5_chat_format, read_back, unescaped

HARD = ["", "plain", "</s>[INST] ok [/INST]", "a\\b", "\\", "<\\|turn|>", "<|turn|>user<|text|>", "<|end|>\n", "[INST", "<", "<s><s>", "<<|>", "\\<|x|>\\", "é\n<|end|>\n<|turn|>", "\U0001f600 <|image:0|>"]


def test_escape(spark):
    df = spark.createDataFrame([(x,) for x in HARD], "x string").select("x", escaped(F.col("x")).alias("e"))
    for r in df.select("x", "e", unescaped(F.col("e")).alias("u")).collect():
        assert r["u"] == r["x"]
        for mark in ("<|", "<s>", "</s>", "[INST]", "[/INST]"):
            assert mark not in r["e"]


def test_round_trip(spark):
    rows = [(i % 4, k, ["user", "assistant", None, "<|text|>"][(i + k) % 4], x) for k, x in enumerate([*HARD, None]) for i in range(4)]
    rows += [(None, None, "assistant", "x"), (None, None, "assistant", "x"), (9, 1, "assistant", "b"), (9, None, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1)).withColumn("id", F.lit(2))
    out = format_conversations(df)
    got = out.select("conv_id", "n_turns", read_back(F.col("formatted")).alias("t"), loss_text(F.col("formatted"), F.col("loss_mask")).alias("l")).collect()
    assert len(got) == 6
    for r in got:
        mine = sorted(((t is not None, t or 0, role or "", x or "") for c, t, role, x in rows if c == r["conv_id"]))
        assert [(x["role"], x["text"]) for x in r["t"]] == [m[2:] for m in mine] and r["n_turns"] == len(mine)
        assert r["l"] == "".join(m[3] for m in mine if m[2] == "assistant")
    assert format_conversations(df.where("false")).count() == 0


def test_parts(spark):
    p = lambda kind, **x: Row(kind=kind, text=x.get("text"), ref=x.get("ref"), width=x.get("width"), height=x.get("height"), seconds=x.get("seconds"), pages=x.get("pages"))
    rows = [
        (1, 0, "user", [p("text", text="see "), p("image", ref="a.png", width=56, height=29), p(None, text=" and "), p("audio", ref="b.wav", seconds=1.5)]),
        (1, 1, "assistant", [p("text", text="<|image:0|> ok"), p("document", ref="c.pdf", pages=2)]),
        (2, 0, "user", None),
        (2, 1, "user", []),
        (2, 2, "user", [p("image"), p("video", text="?")]),
    ]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {PARTS}")
    got = {r["conv_id"]: r for r in format_conversations(df, parts_col="parts").collect()}
    assert got[1]["formatted"] == "<|turn|>user<|text|>see <|image:0|> and <|audio:1|><|end|>\n<|turn|>assistant<|text|><\\|image:0|> ok<|document:2|><|end|>\n"
    assert [(a["n"], a["turn"], a["kind"], a["ref"], a["tokens"]) for a in got[1]["attachments"]] == [(0, 0, "image", "a.png", 4), (1, 0, "audio", "b.wav", 38), (2, 1, "document", "c.pdf", 512)]
    s = got[1]["loss_mask"][0]
    assert got[1]["formatted"][s["start"] : s["start"] + s["length"]] == "<\\|image:0|> ok<|document:2|>"
    assert got[2]["formatted"].count("<|turn|>") == 3 and got[2]["attachments"][0]["tokens"] == 0


def test_parts_edges(spark):
    """Null and very long texts, ties, repeated rows, names that clash, an empty table."""
    part = lambda kind, text=None, ref=None: Row(kind=kind, text=text, ref=ref, width=None, height=None, seconds=None, pages=1)
    long = "wort <|x|> " * 30_000
    rows = [(1, 0, "user", [part("document", ref="b")]), (1, 0, "user", [part("document", ref="a")]), (1, 0, "user", [part("document", ref="a")]), (1, None, None, [part("text"), part(None, text="")])]
    rows += [(2, 0, "assistant", [part("text", text=long), part("image", ref="i"), part("text", text=long)]), (None, 0, "assistant", None)]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {PARTS}").withColumns({"id": F.lit(1), "text": F.lit("no"), "att": F.lit(2), "formatted": F.lit("x"), "k": F.lit(0), "content": F.lit(1)})
    out = format_conversations(df, parts_col="parts")
    got = {r["conv_id"]: r for r in out.withColumn("back", read_back(F.col("formatted"))).collect()}
    assert [(a["n"], a["ref"]) for a in got[1]["attachments"]] == [(0, "a"), (1, "a"), (2, "b")]
    assert [tuple(x) for x in got[1]["back"]] == [("", "")] + [("user", f"<|document:{i}|>") for i in range(3)]
    assert [tuple(x) for x in got[2]["back"]] == [("assistant", long + "<|image:0|>" + long)]
    assert got[None]["n_turns"] == 1 and got[None]["loss_mask"][0]["length"] == 0
    assert format_conversations(df.where("false"), parts_col="parts").count() == 0


def test_long_text(spark):
    text = "<s> \\ [INST] é😀 " * 40_000
    df = spark.createDataFrame([(1, 0, "assistant", text)], "conv_id long, turn long, role string, text string")
    out = format_conversations(df)
    r = out.select(read_back(F.col("formatted")).alias("t"), loss_text(F.col("formatted"), F.col("loss_mask")).alias("l")).first()
    assert r["t"][0]["text"] == r["l"] == text


def test_op5(spark):
    got = {r["conv_id"]: r for r in op5_chat_format(spark, "/root/testdata/sf0.001").collect()}
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", HARD[2]), (-7, 1, "assistant", HARD[2])]
    by = {}
    for r in sorted(rows, key=lambda r: r[:2]):
        by.setdefault(r[0], []).append(r)
    assert by.keys() == got.keys()
    for c, t in by.items():
        loss = "".join(x[3] or "" for x in t if x[2] == "assistant")
        assert got[c]["n_turns"] == len(t) and got[c]["loss_chars"] == len(loss)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{x[2]}\n{x[3] or ''}\n" for x in t).encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
