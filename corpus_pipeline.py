"""From raw documents to token ids: recognise, drop copies, decontaminate, mask secrets, encode.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last return the columns of
documents; between stages the rows are written as Parquet to the shared folder and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwise.llm import bpe, contamination, credentials, language, simhash
from spanwise.llm.common import stored

#: A text needs this share of its letters in one language; texts without letters have none.
LEAST_LANGUAGE = 0.4
VOCABULARY = "byte_bpe_50k.json"


def recognise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters, or of which no language holds enough."""
    model = language.train(docs.where(~language.held_out(F.col("doc_id"), 4, 2)))
    return language.recognised(docs, model, LEAST_LANGUAGE)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group that SimHash links."""
    return simhash.without_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain an item of the benchmark."""
    return contamination.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets that are no widely copied examples; every document stays."""
    return credentials.redacted(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the texts that are left."""
    return bpe.encode_documents(docs, public_tokenizers.path(VOCABULARY), ["doc_id", "lang", "source"])


STAGES = [
    ("language", recognise),
    ("near_dedup", drop_copies),
    ("decontamination", decontaminate),
    ("secrets", mask_secrets),
    ("bpe", encode),
]

#: SQL cannot express language scores, components or merges; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
