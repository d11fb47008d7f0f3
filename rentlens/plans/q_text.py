"""T1/T2 content hashing and D1 exact dedup over whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from rentlens.functions import text as tx
from rentlens.operators.ingest import first_per_key
from rentlens.plans.registry import query
from rentlens.sources.tables import read_table

NORM_SQL = f"trim(regexp_replace(lower(text), '{tx.WS}+', ' ', 'g'))"


@query("text_normalize_hash", f"""
SELECT doc_id, sha256({NORM_SQL}) AS content_hash, CAST(length({NORM_SQL}) AS BIGINT) AS norm_chars
FROM documents
""")
def text_normalize_hash(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    norm = tx.normalize_text(F.col("text"))
    return d.select("doc_id", F.sha2(norm, 256).alias("content_hash"),
                    F.char_length(norm).cast("bigint").alias("norm_chars"))


@query("content_dedup", f"""
SELECT min(doc_id) AS doc_id, source, content_hash
FROM (SELECT doc_id, source, sha256({NORM_SQL}) AS content_hash FROM documents) t
GROUP BY source, content_hash
""")
def content_dedup(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").select(
        "doc_id", "source", tx.content_hash(F.col("text")).alias("content_hash"))
    return first_per_key(d, ["source", "content_hash"], [F.col("doc_id")]).select("doc_id", "source", "content_hash")
