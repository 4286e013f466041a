"""Language ID: averaged hashed subword embeddings under a linear softmax, trained by SGD in numpy.

A text's features are its byte trigrams and 4-grams with word marks, hashed into a table of embeddings; their mean goes
through a linear softmax. Confidence is calibrated by a temperature fitted on training rows that are held back from
the fit. The rejection threshold is three quarters of the confidence that reject_share of the rightly predicted ones
among these rows fall below, and at most three quarters of the midpoint between chance and certainty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import lean, materialise, without

OUT = ("lang_pred", "score", "rejected")
BUCKETS, DIM = 1 << 15, 16
#: Labelled rows that training uses, about: so many a language, by a hash of the identifier, and so many in all, dealt
#: evenly, at least one a language; texts of over MAX_BYTES aren't used to train. Predictions always read whole texts.
ROWS_PER_LANGUAGE, ROWS, MAX_BYTES = 600, 120_000, 200_000
#: Bytes that are looked at in one go, at least a text.
CHUNK = 1 << 20


def _fold() -> np.ndarray:
    """ASCII letters to lower case; other ASCII but letters to a word mark; bytes of other characters as they are."""
    table = np.arange(256, dtype=np.uint32)
    for b in range(128):
        c = chr(b)
        table[b] = ord(c.lower()) if c.isalpha() else 32
    return table


FOLD = _fold()


def features(data: np.ndarray) -> np.ndarray:
    """Bytes -> hashed trigrams and 4-grams in one array of 2 * len(data); those that reach past the end wrap."""
    x = FOLD[data]
    g = np.concatenate([x, np.full(3, 32, np.uint32)])
    tri = (g[:-3] << np.uint32(16)) | (g[1:-2] << np.uint32(8)) | g[2:-1]
    four = (tri << np.uint32(8)) | g[3:]
    mixed = lambda h, k: ((h * np.uint32(k)) ^ ((h * np.uint32(k)) >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(17)
    return np.concatenate([mixed(tri, 0x9E3779B1), mixed(four, 0xC2B2AE3D)])


@dataclass
class Model:
    labels: list[str]
    table: np.ndarray  # buckets x labels: embeddings times the softmax's weights
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, text: bytes) -> np.ndarray:
        total, n = np.zeros(len(self.labels)), 0
        data = np.frombuffer(b" " + text + b" ", np.uint8)
        for lo in range(0, len(data), CHUNK):  # whole texts, in pieces that overlap by what a 4-gram needs
            part = data[lo : lo + CHUNK + 3]
            own = min(CHUNK, len(data) - lo)
            f = features(part)
            k = len(part)
            total += self.table[f[:own]].sum(0, dtype=np.float64) + self.table[f[k : k + own]].sum(0, dtype=np.float64)
            n += 2 * own
        return total / max(n, 1) + self.bias

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z = np.exp(z - z.max(-1, keepdims=True))
        return z / z.sum(-1, keepdims=True)


def train(rows: list[tuple[str, bytes]], epochs: int = 6, rate: float = 0.5, reject_share: float = 0.001, seed: int = 3) -> Model:
    """(label, text) rows -> a model. Every fifth row only calibrates. No rows or one label give a constant model."""
    labels = sorted({r[0] for r in rows})
    if len(labels) < 2:
        return Model(labels or ["und"], np.zeros((BUCKETS, max(1, len(labels))), np.float32), np.zeros(max(1, len(labels))))
    rng = np.random.default_rng(seed)
    E = rng.normal(0, 0.1, (BUCKETS, DIM))
    W = rng.normal(0, 0.1, (DIM, len(labels)))
    b = np.zeros(len(labels))
    sparse = []
    for label, text in rows:
        h, n = np.unique(features(np.frombuffer(b" " + text + b" ", np.uint8)), return_counts=True)
        sparse.append((labels.index(label), h, n / n.sum()))
    order = rng.permutation(len(sparse))
    held, fit = order[::5], np.setdiff1d(order, order[::5])
    for epoch in range(epochs):
        lr = rate * (1 - epoch / epochs)
        for i in rng.permutation(fit):
            y, h, n = sparse[i]
            v = n @ E[h]
            z = v @ W + b
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            g = W @ p
            W -= lr * 10 * np.outer(v, p)
            b -= lr * 0.01 * p
            E[h] -= (lr * 200 * n)[:, None] * g[None, :].clip(-1, 1)
    M = Model(labels, (E @ W).astype(np.float32), b)
    z = np.array([sparse[i][2] @ M.table[sparse[i][1]] + b for i in held]) if len(held) else np.zeros((0, len(labels)))
    y = np.array([sparse[i][0] for i in held], int)
    if len(y):
        def loss(t: float) -> float:
            q = z / t
            q = q - q.max(1, keepdims=True)
            return float(-(q[np.arange(len(y)), y] - np.log(np.exp(q).sum(1))).mean())

        M.temperature = min(np.geomspace(0.05, 20, 60), key=loss)
        # rows whose given label the model shares say what confidence on clean text looks like
        p = M.probabilities(z)
        sure = p.max(1)[p.argmax(1) == y]
        chance = 1.0 / len(labels)
        if len(sure):
            M.threshold = float(min(np.quantile(sure, reject_share), chance + 0.5 * (1 - chance)) * 0.75)
    return M


BELOW = 1_000_000_007


def chance(id_col: str):
    """A number below BELOW for each identifier."""
    return F.pmod(F.xxhash64(F.col(id_col), F.lit(11)), F.lit(BELOW))


def training_rows(docs: DataFrame, id_col: str, text_col: str, label_col: str, where=None) -> list[tuple[str, bytes]]:
    """The bounded sample described above, in a fixed order."""
    ok = docs.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull() & (F.octet_length(text_col) <= MAX_BYTES))
    ok = ok.where(where) if where is not None else ok
    counts = ok.groupBy(F.col(label_col).cast("string").alias("l")).agg(F.count("*").alias("n"), F.min(F.struct(chance(id_col).alias("h"), F.xxhash64(text_col).alias("t"))).alias("first"))
    counts = materialise(counts)
    labels = counts.count()
    if not labels:
        return []
    each = max(1, min(ROWS_PER_LANGUAGE, ROWS // labels))
    here = ok.select(F.col(label_col).cast("string").alias("label"), F.encode(text_col, "UTF-8").alias("t"), F.col(id_col).cast("string").alias("i"), chance(id_col).alias("h"), F.xxhash64(text_col).alias("x"))
    wanted = (F.col("h") < F.floor(F.lit(BELOW) * F.least(F.lit(1.0), F.lit(each) / F.col("n")))) | ((F.col("h") == F.col("first.h")) & (F.col("x") == F.col("first.t")))
    got = here.join(counts, F.col("label") == F.col("l")).where(wanted).select("label", "t", "i").collect()
    return [(r[0], bytes(r[1])) for r in sorted(got, key=lambda r: (r[2] or "", r[0], bytes(r[1])))]


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs with lang_pred, score and rejected.

    lang_pred is `und` with score 0 where the text is null or has no letter; those and texts whose calibrated score is
    under the model's threshold are rejected. Whole texts are read, whatever their length. Columns named like an
    output give way; an empty table gives an empty table; repeated rows get the same answers.
    """
    lean(docs.sparkSession)
    base = without(docs, *OUT)
    names = base.columns
    schema = T.StructType([*base.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, letters = batch[text_col], np.asarray(batch["_tg_letter"])
            pred, score, no = [], [], []
            for i in range(batch.num_rows):
                if letters[i]:
                    p = model.probabilities(model.logits(texts[i].as_buffer().to_pybytes()))
                    k = int(p.argmax())
                    pred.append(model.labels[k])
                    score.append(float(min(1.0, p[k])))
                    no.append(bool(p[k] < model.threshold))
                else:
                    pred.append("und")
                    score.append(0.0)
                    no.append(True)
            yield pa.RecordBatch.from_arrays([batch[c] for c in names] + [pa.array(pred, pa.string()), pa.array(score), pa.array(no)], names=schema.names)

    t = base.withColumn("_tg_letter", F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))
    return t.mapInArrow(run, schema)


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", where=None) -> Model:
    return train(training_rows(docs, id_col, text_col, label_col, where))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs, where=~held_out())
    t = identify(docs.select("doc_id", "text"), model)
    return t.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
