"""Corpus pipeline: toxicity filter, exact dedup, near dedup, mixing, tokenisation.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``. All stages but
the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rentlens.llm import bpe, exact, mixing, queries, simhash, toxicity
from rentlens.llm.common import read_table
from rentlens.session import scratch_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity model rejects go, each by its own text; null and empty texts stay unless it
    rejects them."""
    return toxicity.keep_clean(docs, queries.toxicity_model(spark, sf_dir, docs))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts (up to runs of white space) the smallest doc_id stays."""
    return exact.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every component of SimHash fingerprints (3 words, 2 bits) stays."""
    return simhash.near_dedup(docs, shingle=3, max_distance=2)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture's copies say (a document with a rate above 1 may come twice)."""
    return mixing.apply_mix(docs, queries.mixture(docs, read_table(spark, sf_dir, "labels")))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded bytes, one row per row of ``docs``."""
    path, pattern = public_tokenizers.path(queries.VOCABULARY), public_tokenizers.PATTERN
    return bpe.token_digests(bpe.decode(bpe.encode(docs, path, pattern), path))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", tokenize),
]

#: The classifiers and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written to the shared checkpoint folder."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline/{uuid.uuid4().hex}-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
