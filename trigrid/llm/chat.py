"""Chat formatting with typed content parts, in DataFrame operations only.

A visitor renders each part of a turn: text with its control strings escaped, an image, audio clip or document as an
ordered placeholder whose reference and expanded token count go to the list of attachments. A turn is

    <|turn|>role<|text|>content<|end|>\\n

Escaping doubles each backslash and puts a backslash after the first character of each control string in a text, so
that no text can hold one; unescaping drops the backslash of each pair. Both are exact inverses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Strings that other templates use as controls, and all of the form <|...|>, are broken up inside texts and roles.
CONTROL = r"(<)(?=\||/?s>)|(\[)(?=/?INST\])"
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
#: An attachment's expanded tokens: patches of an image, tokens a second of audio, tokens a page of a document.
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 256
PARTS = "array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"


def escaped(x: Column) -> Column:
    return F.regexp_replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), CONTROL, "$1$2\\\\")


def unescaped(x: Column) -> Column:
    return F.regexp_replace(x, r"(?s)\\(.)", "$1")


def expanded_tokens(p: Column) -> Column:
    """Tokens that stand for a part; 0 for text, and for an attachment whose measure is unknown."""
    side = lambda n: F.ceil(F.coalesce(p[n], F.lit(0)) / F.lit(PATCH))
    return (
        F.when(p["kind"] == "image", side("width") * side("height"))
        .when(p["kind"] == "audio", F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * F.lit(AUDIO_RATE)))
        .when(p["kind"] == "document", F.coalesce(p["pages"], F.lit(0)) * F.lit(PAGE_TOKENS))
        .otherwise(F.lit(0))
        .cast("long")
    )


def format_conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", parts_col: str | None = None, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: its identifier, formatted, loss_mask, attachments, n_turns.

    loss_mask is the spans (start, length in code points from 0) of formatted that hold the contents of loss_role's
    turns; attachments is (n, turn, kind, ref, tokens) in order, n counting from 0 through the conversation. Turns go
    by turn number, nulls first, ties by role and parts; repeated rows are repeated turns. Null texts, parts and
    roles are empty. Parts of an unknown kind or none count as text. A null identifier is a conversation of its own.
    An empty table gives an empty table; other columns are ignored. One conversation is one row by its nature: its
    turns meet in one task, other conversations' don't.
    """
    if parts_col is None:
        parts = F.array(F.struct(*[F.lit("text").alias("kind"), F.col(text_col).alias("text"), *[F.lit(None).alias(k) for k in ("ref", "width", "height", "seconds", "pages")]])).cast(PARTS)
    else:
        parts = F.coalesce(F.col(parts_col), F.array().cast(PARTS))
    t = turns.select(F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), parts.alias("parts"))
    attached = lambda p: F.coalesce(p["kind"], F.lit("text")).isin("image", "audio", "document")
    t = t.withColumn("att", F.transform(F.filter("parts", attached), lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), expanded_tokens(p).alias("tokens"))))
    t = t.withColumn("n_att", F.size("att"))
    # turns that tie go by what they hold
    inner = Window.partitionBy("id").orderBy("turn", "role", "parts")
    t = t.withColumn("att0", F.coalesce(F.sum("n_att").over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))
    # the visitor: a running pair of what is rendered and how many attachments came before
    seen = F.aggregate(
        "parts",
        F.struct(F.array().cast("array<string>").alias("out"), F.col("att0").alias("k")),
        lambda acc, p: F.struct(
            F.concat(acc["out"], F.array(F.when(attached(p), F.concat(F.lit("<|"), p["kind"], F.lit(":"), acc["k"].cast("string"), F.lit("|>"))).otherwise(escaped(F.coalesce(p["text"], F.lit("")))))).alias("out"),
            (acc["k"] + attached(p).cast("long")).alias("k"),
        ),
    )
    t = t.withColumn("content", F.array_join(seen["out"], ""))
    head = F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(TEXT))
    t = t.select("id", "turn", "role", "parts", "att", "att0", F.length(head).alias("lead"), F.length("content").alias("len"), F.concat(head, "content", F.lit(END)).alias("turn_text"))
    t = t.withColumns({"at": F.coalesce(F.sum(F.length("turn_text")).over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "k": F.row_number().over(inner)})
    row = F.struct("k", "turn_text", F.when(F.col("role") == loss_role, F.struct((F.col("at") + F.col("lead")).alias("start"), F.col("len").cast("long").alias("length"))).alias("span"), F.transform("att", lambda a, i: F.struct((F.col("att0") + i).alias("n"), F.col("turn").alias("turn"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))).alias("att"))
    g = t.groupBy("id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return g.select(
        F.col("id").alias(id_col),
        F.array_join(F.transform("rows", lambda r: r["turn_text"]), "").alias("formatted"),
        F.filter(F.transform("rows", lambda r: r["span"]), lambda s: s.isNotNull()).alias("loss_mask"),
        F.flatten(F.transform("rows", lambda r: r["att"])).alias("attachments"),
        F.size("rows").cast("long").alias("n_turns"),
    )


def read_back(formatted: Column) -> Column:
    """formatted -> array of (role, text), by the template's marks alone; placeholders stay in the text as they are."""
    cut_up = F.split(formatted, r"<\|turn\|>")
    segments = F.slice(cut_up, F.lit(2), F.size(cut_up) - 1)

    def one(s: Column) -> Column:
        cut = F.instr(s, TEXT)
        return F.struct(unescaped(F.substr(s, F.lit(1), cut - 1)).alias("role"), unescaped(F.substr(s, cut + len(TEXT), F.length(s) - cut - (len(TEXT) + len(END) - 1))).alias("text"))

    return F.transform(segments, one)


def loss_text(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped, nothing between the spans."""
    return F.array_join(F.transform(mask, lambda m: unescaped(F.substr(formatted, m["start"].cast("int") + 1, m["length"].cast("int")))), "")


def op5_chat_format(spark, sf_dir: str) -> DataFrame:
    own = spark.sql("SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)")
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(own)
    t = format_conversations(t).withColumns({"_turns": read_back(F.col("formatted")), "_loss": loss_text(F.col("formatted"), F.col("loss_mask"))})
    digest = lambda x: F.sha2(F.encode(x, "UTF-8"), 256)
    return t.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        digest(F.array_join(F.transform("_turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        digest(F.col("_loss")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP5_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *,
    length(regexp_replace(regexp_replace(replace(role, '\', '\\'), '<(\||/?s>)', '<_\1', 'g'), '\[(/?INST\])', '[_\1', 'g')) AS role_len,
    length(regexp_replace(regexp_replace(replace(text, '\', '\\'), '<(\||/?s>)', '<_\1', 'g'), '\[(/?INST\])', '[_\1', 'g')) AS text_len
  FROM t
)
SELECT conv_id,
       count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(role_len + text_len + 24) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
