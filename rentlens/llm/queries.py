"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from rentlens.llm import align, ann, bpe, chat, exact, html, license, mixing, repair, rindex, sharding, simhash, toxicity
from rentlens.llm.common import read_table

VOCABULARY = "byte_bpe_50k.tiktoken"


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash near-duplicates: 3-word shingles, at most 2 differing bits."""
    return (simhash.near_duplicates(read_table(spark, sf_dir, "documents"), shingle=3, max_distance=2)
            .select("doc_id", "fingerprint", "component_id"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.license_summary(license.license_scan(read_table(spark, sf_dir, "documents")))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode, decode the ids, and return the digests of both."""
    path, pattern = public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN
    ids = bpe.encode(read_table(spark, sf_dir, "documents"), path, pattern)
    return bpe.token_digests(bpe.decode(ids, path))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(read_table(spark, sf_dir, "documents"))


#: Target weights of language and quality domains for the mixture (parameters of op5 and the pipeline).
MIX_TARGETS = {"en/1": 0.57, "de/1": 0.14, "fr/1": 0.14, "es/1": 0.10,
               "en/0": 0.03, "de/0": 0.008, "fr/0": 0.007, "es/0": 0.005}
#: Wanted tokens as a share of the present ones.
MIX_BUDGET = 0.95


def mixture(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return mixing.mix(docs, mixing.quality_domains(docs, labels), MIX_TARGETS, MIX_BUDGET)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates and copies that bring expected domain tokens to MIX_TARGETS."""
    return mixture(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")).drop("text_key")


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every vector whose id is divisible by 20, against all."""
    entries = ann.usable(read_table(spark, sf_dir, "embeddings"))
    return ann.nearest_neighbours(entries, entries.where("vec_id % 20 = 0"), limit=20)


#: The conversation that op7 formats besides the table's.
EXTRA_TURNS = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format every conversation and read the digests back from the output."""
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame(EXTRA_TURNS, "conv_id bigint, turn bigint, role string, text string"))
    return chat.read_back(chat.format_turns(chat.canonical_turns(chat.turn_records(rows))))


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes covered by 100-byte strings that also start earlier, removed."""
    return rindex.span_digest(rindex.remove_repeats(read_table(spark, sf_dir, "documents"), length=100))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read_table(spark, sf_dir, "pages"))


def toxicity_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> toxicity.Model:
    labels = read_table(spark, sf_dir, "labels")
    return toxicity.train(docs, labels.where(~toxicity.held_out(F.col("doc_id"))).select("doc_id", "toxic"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of a model learnt from the labelled rows that are not held out."""
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity_model(spark, sf_dir, docs)).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The damaged conversations, their faults and their cheapest repair."""
    rows = read_table(spark, sf_dir, "conversations")
    return repair.repair_report(rows, repair.damage(rows))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of a byte-level and a piece vocabulary that cover the same bytes, with the corpus's counts of id pairs."""
    return align.alignment_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                  public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents shuffled uniformly into 24 shards whose row counts differ by one at most."""
    return sharding.digest(sharding.shard(read_table(spark, sf_dir, "documents"), n_shards=24))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_license_scan": op2_license_scan,
    "op3_bpe": op3_bpe,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_mixing": op5_mixing,
    "op6_ann": op6_ann,
    "op7_chat": op7_chat,
    "op8_repeats": op8_repeats,
    "op9_html": op9_html,
    "op10_toxicity": op10_toxicity,
    "op11_repair": op11_repair,
    "op12_alignment": op12_alignment,
    "op13_sharding": op13_sharding,
}

ORACLES: dict[str, str] = {
    "op4_exact_dedup": exact.GROUPS_SQL,
    "op7_chat": chat.digests_sql(EXTRA_TURNS),
    "op8_repeats": rindex.digest_sql(100),
    "op11_repair": repair.report_sql(),
}
