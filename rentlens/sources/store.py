"""Table writes: replace-by-slice (K5), replace-by-key (K6, K7), CSV exports (K9),
JSON-lines rewrite (K10) and benchmark rows with a JSON accuracy map (K11).

Plain parquet has no MERGE, so updates build the new table as a DataFrame and
write it to a new versioned folder; nothing is ever overwritten while it is
being read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rentlens.session import materialize


def write_predictions(preds: DataFrame, path: str) -> None:
    """K5: rewrite only the model versions present in ``preds``; other
    versions stay (dynamic partition overwrite on model_version)."""
    (preds.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
          .partitionBy("model_version").parquet(path))


def append_observations(obs: DataFrame, path: str) -> None:
    """K3: append a run's sightings to the log, one folder per run; a run that
    is written again replaces its own folder (dynamic partition overwrite)."""
    (obs.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path))


def replace_by_key(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """K6/K7: rows of ``new`` replace rows of ``existing`` with the same key."""
    return existing.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


#: A keyed table is kept in so many hash buckets of its key.
KEY_BUCKETS = 64


def key_bucket(keys: list[str], buckets: int = KEY_BUCKETS):
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def replace_in_buckets(new: DataFrame, path: str, keys: list[str], buckets: int = KEY_BUCKETS) -> list[int]:
    """K6/K7 on a table at ``path``: rows of ``new`` replace the rows of their keys; returns the buckets rewritten.

    The table is partitioned by a hash bucket of its key. Only buckets that hold a key of ``new`` are read and
    rewritten (dynamic partition overwrite); all others keep their files. The new content of the touched buckets is
    written aside first, so nothing is overwritten while it is read, and a job that dies can be run again: the same
    rows replace themselves. Of rows of ``new`` with equal keys all are kept, as of any table.
    """
    spark = new.sparkSession
    new = materialize(new.withColumn("bucket", key_bucket(keys, buckets)))
    touched = sorted(r["bucket"] for r in new.select("bucket").distinct().collect())  # at most ``buckets``
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        schema = new.schema
        old = spark.read.schema(schema).parquet(path).where(F.col("bucket").isin(touched))
        gone = new.select(*[F.col(k).alias(f"_new_{k}") for k in keys]).distinct()
        same = [F.col(k).eqNullSafe(F.col(f"_new_{k}")) for k in keys]
        new = materialize(old.join(gone, same, "left_anti").unionByName(new))
    (new.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("bucket").parquet(path))
    return touched


def read_buckets(spark, path: str) -> DataFrame:
    """The rows of a table that ``replace_in_buckets`` keeps."""
    return spark.read.parquet(path).drop("bucket")


def export_csv(tables: dict[str, DataFrame], out_dir: str) -> None:
    """K9: one headed CSV folder per table (arrays as JSON text)."""
    for name, df in tables.items():
        cols = [F.to_json(F.col(c)).alias(c) if dict(df.dtypes)[c].startswith(("array", "map", "struct"))
                else F.col(c) for c in df.columns]
        df.select(*cols).write.mode("overwrite").option("header", True).csv(f"{out_dir.rstrip('/')}/{name}")


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines, UTF-8 text kept unescaped."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def benchmark_rows(scorecard: DataFrame, fields: list[str], notes: str | None = None) -> DataFrame:
    """Scorecard rows shaped for the benchmark_runs table, per-field
    accuracies as one JSON object, stamped with the run time."""
    acc = F.to_json(F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f"acc_{f}"))]))
    return scorecard.select(F.current_timestamp().alias("ran_at"), "extractor", "extractor_version",
                            F.col("eval_set"), "n_examples", acc.alias("field_accuracies_json"),
                            "macro_accuracy", "cost_per_1k_usd", "p50_latency_ms", "p95_latency_ms",
                            F.lit(notes).cast("string").alias("notes"))
