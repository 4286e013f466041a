"""From documents to packed training sequences: five stages, each one operator, each over all that is left.

A stage's result is written before the next one begins, so each begins by deleting what earlier ones kept in the shared
folder for their own use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trigrid.llm.exact_dedup import exact_dedup
from trigrid.llm.langid import identify, learn
from trigrid.llm.minhash import jaccard_join
from trigrid.llm.mixing import mix
from trigrid.llm.packing import pack_documents
from trigrid.llm.scratch import materialise, release


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those the language model rejects, go."""
    release(docs)
    return identify(docs, learn(docs)).where("NOT rejected").select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays, the one with the smallest doc_id."""
    release(docs)
    return exact_dedup(docs).where("kept").select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id."""
    release(docs)
    return jaccard_join(docs).where("kept").select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: rows may come twice, or go."""
    release(docs)
    t = mix(docs).where("copies > 0")
    return t.select(*docs.columns, F.explode(F.sequence(F.lit(1), "copies")).alias("_tg_copy")).drop("_tg_copy")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their ids and their places in sequences of 2,048 tokens."""
    import public_tokenizers

    release(docs)
    return pack_documents(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", language), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixed), ("packing", packed)]
#: A trained model, banding and random order are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialise(docs)
    return docs
