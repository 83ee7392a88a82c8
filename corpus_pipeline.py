"""The corpus pipeline: five operators of the package one after the other, each stage written and read again.

Every stage works on all rows that its predecessor kept, and all but the last
return the columns of ``documents``. Empty tables pass through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from jobtide.llm import byte_bpe, exact_dedup, language_id, mixing, simhash
from jobtide.session import materialize

#: No SQL: language identification, SimHash groups and BPE have none; tests hold the stages against plain versions.
ORACLE_SQL = None
BYTE_RANKS = "byte_bpe_50k.tiktoken"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is null, has no letter, or lies far from every language go; labels only teach."""
    model = language_id.train(docs)
    return language_id.identify(docs, model, prefix="found_").where("not found_rejected").select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z, the row of the largest id stays."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more over five words, the smallest id stays."""
    return simhash.keep_one(docs, **simhash.NEAR_COPIES)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as often as their source's target asks, in training order."""
    return mixing.curriculum(docs)


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every row, as little-endian unsigned 32-bit integers, beside its id and source."""
    encoded = byte_bpe.encode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN)
    return encoded.selectExpr("doc_id", "lang", "source", "ids", "cast(length(ids) / 4 as bigint) as n_tokens")


STAGES = [
    ("language id", identify_language), ("exact dedup", drop_exact_copies), ("near dedup", drop_near_copies),
    ("mixing", mix_sources), ("byte bpe", encode_bytes),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
