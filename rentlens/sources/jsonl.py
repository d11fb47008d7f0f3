"""JSON-lines readers (S5, S6) with quarantine, and the model-metadata reader.

Files are read by Spark with an explicit schema; line order is recovered from
the file position so "last line wins" stays exact without a driver loop.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from rentlens.functions import text as tx
from rentlens.session import scratch_path

LABEL_SCHEMA = T.StructType([
    T.StructField("listing_id", T.LongType()),
    T.StructField("tenant_pref", T.StringType()),
    T.StructField("veg_only", T.IntegerType()),
    T.StructField("is_owner", T.IntegerType()),
    T.StructField("negotiable", T.IntegerType()),
    T.StructField("lock_in_months", T.IntegerType()),
    T.StructField("amenities", T.ArrayType(T.StringType())),
    T.StructField("label_source", T.StringType()),
    T.StructField("raw_text", T.StringType()),
])


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines with a (file, offset-within-file) ordinal."""
    t = spark.read.text(path).withColumn("_file", F.input_file_name())
    # A file split into several partitions is read in split order, and the
    # partition index sits in the id's high bits, so (file, id) orders lines.
    t = t.withColumn("_ord", F.monotonically_increasing_id())
    return t.where(tx.strip(F.col("value")) != "")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labelled rows; a listing labelled twice keeps its last line."""
    t = _lines(spark, path)
    rec = t.select("_file", "_ord", F.from_json("value", LABEL_SCHEMA).alias("r")).select("_file", "_ord", "r.*")
    rest = [c for c in rec.columns if c not in ("listing_id", "_file", "_ord")]
    return (rec.groupBy("listing_id").agg(F.max_by(F.struct(*rest), F.struct("_file", "_ord")).alias("l"))
               .select("listing_id", "l.*"))


def read_labeled_ids(spark: SparkSession, path: str) -> DataFrame:
    """Ids already labelled; malformed lines and lines without an integer
    listing_id are ignored."""
    t = _lines(spark, path)
    j = F.from_json("value", "listing_id string, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    ids = t.select(j.alias("j")).where(F.col("j._corrupt").isNull()).select(
        F.trim(F.col("j.listing_id")).try_cast("long").alias("listing_id"))
    return ids.where(F.col("listing_id").isNotNull()).distinct()


#: Why a line is in quarantine.
NOT_JSON, NO_ID = "not a JSON object", "no integer listing_id"


class Sorted:
    """What one pass over landed lines made of them: ``kept`` rows, ``quarantine`` (file, line, value, reason), and
    ``counts`` (read, kept, quarantined and one number per reason), observed while the pass wrote both."""

    def __init__(self, kept: DataFrame, quarantine: DataFrame, counts: dict[str, int]):
        self.kept, self.quarantine, self.counts = kept, quarantine, counts


def quarantined(rows: DataFrame, reason: Column, reasons: list[str], carry: list[str]) -> Sorted:
    """Splits ``rows`` by ``reason`` (NULL: kept). Both parts are written in one pass, as one table partitioned by
    whether a row is kept; quarantine keeps the columns ``carry`` and the reason."""
    spark = rows.sparkSession
    seen = Observation(f"quarantine-{uuid.uuid4().hex}")
    marked = rows.withColumn("_reason", reason)
    named = {f"r{n}": F.count(F.when(F.col("_reason") == r, 1)) for n, r in enumerate(reasons)}
    marked = marked.observe(seen, F.count(F.lit(1)).alias("read"), F.count("_reason").alias("quarantined"),
                            *[c.alias(n) for n, c in named.items()])
    path = scratch_path(spark, f"sorted-{uuid.uuid4().hex}")
    marked.withColumn("_kept", F.col("_reason").isNull()).write.partitionBy("_kept").parquet(path)
    table = spark.read.schema(marked.schema.add("_kept", "boolean")).parquet(path)
    got = seen.get
    counts = {"read": got["read"], "kept": got["read"] - got["quarantined"], "quarantined": got["quarantined"]}
    counts |= {r: got[f"r{n}"] for n, r in enumerate(reasons)}
    return Sorted(table.where("_kept").drop("_kept", "_reason"),
                  table.where("NOT _kept").select(*carry, F.col("_reason").alias("reason")), counts)


def sort_label_lines(spark: SparkSession, path: str) -> Sorted:
    """S6 with nothing lost: label lines with an integer id are kept (file, ord, listing_id, value), all other
    non-blank lines go to quarantine with a reason."""
    t = _lines(spark, path)
    j = F.from_json("value", "listing_id string, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    rows = t.withColumn("_j", j).select(F.col("_file").alias("file"), F.col("_ord").alias("ord"), "value",
                                        F.trim(F.col("_j.listing_id")).try_cast("long").alias("listing_id"),
                                        F.col("_j._corrupt").isNotNull().alias("_bad"))
    reason = F.when(F.col("_bad"), NOT_JSON).when(F.col("listing_id").isNull(), NO_ID)
    done = quarantined(rows, reason, [NOT_JSON, NO_ID], ["file", "ord", "value"])
    done.kept = done.kept.drop("_bad")
    return done


def read_model_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Model metadata JSON -> tidy (metric, value) rows; missing -> 0,
    N features = length of the feature list."""
    m = spark.read.option("multiLine", True).schema(
        "metrics struct<mape double, mae_inr double, r2 double, mape_std double>, n_total long, "
        "feature_cols array<string>").json(path)
    z = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    return m.select(F.explode(F.array(
        F.struct(F.lit("MAPE").alias("metric"), z(F.col("metrics.mape")).alias("value")),
        F.struct(F.lit("MAE (INR)").alias("metric"), z(F.col("metrics.mae_inr")).alias("value")),
        F.struct(F.lit("R^2").alias("metric"), z(F.col("metrics.r2")).alias("value")),
        F.struct(F.lit("MAPE per-fold std").alias("metric"), z(F.col("metrics.mape_std")).alias("value")),
        F.struct(F.lit("N training rows").alias("metric"), z(F.col("n_total")).alias("value")),
        F.struct(F.lit("N features").alias("metric"), z(F.coalesce(F.size("feature_cols"), F.lit(0)))
                 .alias("value")))).alias("e")).select("e.*")
