"""Exact deduplication by a tree-merge of sorted digest runs.

Every scan partition yields one run of (digest, smallest row) entries. Runs
meet in rounds: round k exchanges the runs so that ``fan_in`` neighbours land
together, sorted by digest, and merges them with one ordered aggregation that
keeps the smallest row of every verified digest and the number of rows it
stands for. Verified means that the sorting digest (64-bit) agrees *and* the
SHA-256 and byte length of the whole normalised text agree; entries that share
only the short digest stay apart at every level. A hot text shrinks to one
entry per run before anything is exchanged and to one per ``fan_in`` runs after
each round, so no task sees more than ``fan_in`` entries of it.

DataFrame functions only; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from rentlens.llm.common import materialize

#: ASCII white space: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE_RUN = "[\\x20\\x09-\\x0D]+"
KEYS = ("digest", "sha", "n_bytes")


def normalized(col):
    """Every run of ASCII white space replaced by one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(col.cast("string"), F.lit("")), SPACE_RUN, " ")


def _sha(col):
    return F.sha2(col, 256)


def entries(docs: DataFrame, digest=F.xxhash64) -> DataFrame:
    """One written row per document: its key, row number, digests and run."""
    norm = normalized(F.col("text"))
    return materialize(docs.select("doc_id", "text").select(
        "doc_id", F.monotonically_increasing_id().alias("row"), F.spark_partition_id().cast("long").alias("run"),
        digest(norm).alias("digest"), _sha(norm).alias("sha"), F.octet_length(norm).cast("long").alias("n_bytes")))


def merge_runs(rows: DataFrame, fan_in: int = 16) -> DataFrame:
    """(digest, sha, n_bytes, best, n): the verified smallest row of every text and its number of rows."""
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    runs = rows.groupBy("run", *KEYS).agg(F.min(first).alias("best"), F.count("*").alias("n"))
    left = (rows.agg(F.max("run")).first()[0] or 0) + 1
    while left > 1:
        runs = (runs.withColumn("run", F.floor(F.col("run") / fan_in))
                .repartition("run", "digest").sortWithinPartitions("run", *KEYS)
                .groupBy("run", *KEYS).agg(F.min("best").alias("best"), F.sum("n").alias("n")))
        left = -(-left // fan_in)
    return runs.drop("run")


def exact_groups(docs: DataFrame, fan_in: int = 16, digest=F.xxhash64) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after every run of ASCII white space is
    replaced by one space. Of equal texts exactly one row is kept: the one with
    the smallest doc_id (a null doc_id sorts last; among rows that repeat a
    doc_id, the first read). Null texts are empty texts and form one group.
    An empty table gives an empty result; further columns are ignored.
    """
    rows = entries(docs, digest)
    groups = merge_runs(rows, fan_in).toDF("g_digest", "g_sha", "g_bytes", "best", "n")
    on = [rows["digest"] == groups["g_digest"], rows["sha"] == groups["g_sha"], rows["n_bytes"] == groups["g_bytes"]]
    return rows.join(groups, on).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"), F.col("sha").alias("text_sha256"))


def exact_dedup(docs: DataFrame, fan_in: int = 16) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows that repeat
    both doc_id and text one stays."""
    kept = (exact_groups(docs, fan_in).where("kept")
            .select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__kept_sha")))
    sha = _sha(normalized(F.col("text")))
    rows = docs.withColumn("__sha", sha)
    rows = rows.join(kept, rows["doc_id"].eqNullSafe(kept["__id"]) & (rows["__sha"] == kept["__kept_sha"]), "left_semi")
    w = Window.partitionBy("doc_id", "__sha").orderBy("doc_id")
    return rows.withColumn("__nth", F.row_number().over(w)).where("__nth = 1").select(*docs.columns)


GROUPS_SQL = r"""
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
"""
