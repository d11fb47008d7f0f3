"""Structured Streaming twins of the incremental ingest.

R1 ``stream_upsert``      file stream -> foreachBatch(D1 -> D3 -> K3); each
                          micro-batch is a run, published as one version.
R2 ``stream_dedup``       exact duplicate suppression on a key that stays
                          unique for ever (keyed state without expiry).
R3/R4 ``weekly_sightings`` recency cutoff + 7-day tumbling event-time windows
                          aligned to Monday; every micro-batch adds its partial
                          counts, which are summed by key, so sightings count
                          however late they arrive.
R4/W7 ``stream_price_changes``  price series: the last sighting of every
                          listing is kept as keyed state; each micro-batch is
                          compared with it, late rows go to a table of their own.

Every run uses ``trigger(availableNow=True)`` so a scheduled job processes what
has landed and stops; checkpoints and outputs live under the shared
checkpoint folder, so a restarted driver resumes where it left off.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from contextlib import nullcontext

from pyspark.sql import DataFrame, SparkSession, functions as F

from rentlens.operators import ingest
from rentlens.operators.history import price_changes
from rentlens.operators.ledger import RunLedger
from rentlens.session import materialize, scratch_path

#: The listings state is kept in so many hash buckets; a run rewrites only those it touches.
STATE_BUCKETS = 64


def _run_dir(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, f"stream-{name}-{uuid.uuid4().hex[:12]}")


def file_stream(spark: SparkSession, sf_dir: str, table: str, files_per_batch: int = 1) -> DataFrame:
    """Stream over the files of one landed table, a single file or a folder of
    part files (schema taken from the footers)."""
    folder = sf_dir.rstrip("/")
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    # as a pattern the path may name a file as well as a folder
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{folder}/{table}[.]parquet")


def stream_dedup(spark: SparkSession, source: DataFrame, keys: Sequence[str] = ("user_id", "event_type"),
                 base_dir: str | None = None) -> DataFrame:
    """R2: keep the first sighting of each key. A key is unique for ever, so its
    state never expires; state is partitioned by key over the cluster."""
    base = base_dir or _run_dir(spark, "dedup")
    q = (source.dropDuplicates(list(keys)).writeStream.format("parquet").option("path", f"{base}/out")
         .option("checkpointLocation", f"{base}/_checkpoint").outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(source.schema).parquet(f"{base}/out")


def weekly_sightings(spark: SparkSession, source: DataFrame, cutoff: str, key: str = "user_id", ts: str = "ts",
                     base_dir: str | None = None) -> DataFrame:
    """R3 + R4: sightings newer than ``cutoff`` counted per Monday-aligned week
    and key. A micro-batch writes its own counts into its own folder (a replay
    replaces them); the counts of all micro-batches are summed on reading."""
    base = base_dir or _run_dir(spark, "weekly")
    s = source.withColumn(ts, F.col(ts).cast("timestamp")).where(F.col(ts) >= F.lit(cutoff).cast("timestamp"))

    def counts(batch: DataFrame) -> DataFrame:
        # epoch day 0 is a Thursday: a 4-day start offset aligns windows to Monday
        week = F.window(ts, "7 days", "7 days", "4 days")
        return (batch.groupBy(week.alias("w"), F.col(key)).agg(F.count(F.lit(1)).alias("n_sightings"))
                .select(F.col("w.start").alias("week_start"), key, "n_sightings"))

    def sink(batch: DataFrame, batch_id: int) -> None:
        counts(batch).write.mode("overwrite").parquet(f"{base}/counts/batch={batch_id}")

    q = (s.writeStream.foreachBatch(sink).option("checkpointLocation", f"{base}/_checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if not exists(spark, f"{base}/counts"):
        return spark.createDataFrame([], f"week_start timestamp, {key} {source.schema[key].dataType.simpleString()}, n_sightings long")
    log = spark.read.parquet(f"{base}/counts")
    return log.groupBy("week_start", key).agg(F.sum("n_sightings").alias("n_sightings"))


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p)


def latest_version(spark: SparkSession, path: str) -> int | None:
    """Highest complete ``v=N`` folder under ``path`` (has a _SUCCESS marker)."""
    p, fs = _fs(spark, path)
    if not fs.exists(p):
        return None
    versions = [int(n[2:]) for n in (st.getPath().getName() for st in fs.listStatus(p))
                if n.startswith("v=") and exists(spark, f"{path}/{n}/_SUCCESS")]
    return max(versions, default=None)


class Published:
    """Tables of a stream, published run by run.

    A run writes its rows of every table and the state buckets that it touched
    into folders of its own version, and last a manifest: the version of every
    state bucket. Readers (the next run included) look at the newest
    complete manifest only, so a run that died after any of its writes is
    invisible, and its replay overwrites what it left.
    """

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base

    def version(self) -> int | None:
        return latest_version(self.spark, f"{self.base}/manifest")

    def table(self, name: str, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.base}/{name}").where(F.col("v") <= version).drop("v")

    def buckets(self, version: int | None) -> dict[int, int]:
        """Version of each non-empty state bucket (at most STATE_BUCKETS)."""
        if version is None:
            return {}
        return {r["bucket"]: r["at"] for r in self.spark.read.parquet(f"{self.base}/manifest/v={version}").collect()}

    def state(self, at: dict[int, int]) -> DataFrame | None:
        paths = [f"{self.base}/state/v={v}/bucket={b}" for b, v in sorted(at.items())]
        return self.spark.read.option("basePath", f"{self.base}/state").parquet(*paths).drop("v", "bucket") if paths else None

    def publish(self, version: int, tables: dict[str, DataFrame], state: DataFrame, key: str, before: dict[int, int]) -> None:
        at = lambda name: f"{self.base}/{name}/v={version}"
        for name, rows in tables.items():
            rows.write.mode("overwrite").parquet(at(name))
        (state.withColumn("bucket", bucket_of(F.col(key))).repartition("bucket")
              .write.mode("overwrite").partitionBy("bucket").parquet(at("state")))
        folder, fs = _fs(self.spark, at("state"))
        names = [st.getPath().getName() for st in fs.listStatus(folder)]
        written = [int(n.removeprefix("bucket=")) for n in names if n.startswith("bucket=")]
        manifest = before | dict.fromkeys(written, version)
        rows = self.spark.createDataFrame(sorted(manifest.items()), "bucket int, at long")
        rows.coalesce(1).write.mode("overwrite").parquet(at("manifest"))

    def touched(self, rows: DataFrame, key: str, before: dict[int, int]) -> DataFrame | None:
        """The state of the buckets that the rows' keys lie in."""
        hit = {r["b"] for r in rows.select(bucket_of(F.col(key)).alias("b")).distinct().collect()}  # at most STATE_BUCKETS
        return self.state({b: v for b, v in before.items() if b in hit})


def bucket_of(key):
    return F.pmod(F.xxhash64(key), F.lit(STATE_BUCKETS)).cast("int")


def _run(source: DataFrame, sink, base: str, tables: Published, ledger: RunLedger | None, name: str) -> int | None:
    """Runs ``sink(batch, batch_id) -> run metrics or None`` on every micro-batch that is not published yet; returns
    the newest version. With a ledger every micro-batch is a run in it, whatever becomes of it."""

    def each(batch: DataFrame, batch_id: int) -> None:
        prev = tables.version()
        if prev is not None and prev >= batch_id:
            return  # this run was already published (replayed micro-batch)
        with ledger.run(f"{name}-{batch_id}", source=name) if ledger else nullcontext() as entry:
            metrics = sink(batch, batch_id, prev)
            if entry is not None and metrics is not None:
                entry.record(metrics)

    q = (source.writeStream.foreachBatch(each).option("checkpointLocation", f"{base}/_checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return tables.version()


def stream_upsert(spark: SparkSession, source: DataFrame, prepare, order_cols, name: str = "upsert",
                  base_dir: str | None = None, ledger: RunLedger | None = None):
    """Run the batch ingest on every micro-batch of ``source``.

    ``prepare(batch_df)`` turns landed rows into raw sightings (raw_id,
    content_hash, observed_at, listing fields). See ``Published`` for how a run
    becomes visible. Returns (state, observations, run_metrics) DataFrames; an
    empty stream gives empty ones.
    """
    base = base_dir or _run_dir(spark, name)
    tables = Published(spark, base)

    def sink(batch: DataFrame, batch_id: int, prev: int | None) -> DataFrame:
        raw = materialize(prepare(batch))
        history = tables.table("history", prev) if prev is not None else None
        inserted = materialize(ingest.insert_if_absent(history, raw, ingest.DEDUP_KEYS, order_cols()))
        before = tables.buckets(prev)
        state = tables.touched(ingest.with_dedup_key(inserted), "dedup_key", before)
        new_state, obs, met = ingest.merge_run(state, raw, inserted, batch_id, order_cols())
        met = materialize(met)
        tables.publish(batch_id, {"history": inserted.select("source", "content_hash"), "observations": obs, "runs": met},
                       new_state, "dedup_key", before)
        return met

    last = _run(source, sink, base, tables, ledger, name)
    if last is None:
        none = prepare(spark.createDataFrame([], source.schema))
        inserted = ingest.insert_if_absent(None, none, ingest.DEDUP_KEYS, order_cols())
        state, obs, met = ingest.merge_run(None, none, inserted, 0, order_cols())
        return state, obs, met.where(F.lit(False))
    state = tables.state(tables.buckets(last))
    obs = tables.table("observations", last)
    return obs.select("listing_id").where(F.lit(False)) if state is None else state, obs, tables.table("runs", last)


def stream_price_changes(spark: SparkSession, source: DataFrame, key: str = "listing_id", ts: str = "observed_at",
                         tie: str = "obs_id", value: str = "rent_monthly", base_dir: str | None = None,
                         ledger: RunLedger | None = None) -> tuple[DataFrame, DataFrame]:
    """R4 + W7: (price changes, late rows) of a stream of sightings.

    State is one row per listing, its last sighting. A micro-batch's rows and the state rows of their listings go
    through the batch operator together, so a listing with a third of all sightings is cut into slices as there, and
    the first new sighting meets the last published one. Late rows, those not after their listing's last published
    sighting by (``ts``, ``tie``) or without a time, have no place in a series that is already out: they are kept
    apart and change nothing. Over files in time order the result equals ``history.price_changes`` of all of them.
    """
    base = base_dir or _run_dir(spark, "prices")
    tables = Published(spark, base)
    cols = [key, ts, tie, value]
    place = F.struct(ts, tie)

    def sink(batch: DataFrame, batch_id: int, prev: int | None) -> None:
        rows = materialize(batch.select(*cols))
        before = tables.buckets(prev)
        state = tables.touched(rows, key, before)
        state = rows.where(F.lit(False)) if state is None else state.select(*cols)
        last = state.select(F.col(key).alias("_key"), F.struct(ts, tie).alias("_last"))
        j = rows.join(last, F.col(key).eqNullSafe(F.col("_key")), "left")
        late = F.col(ts).isNull() | F.coalesce(place <= F.col("_last"), F.lit(False))
        marked = materialize(j.select(*cols, late.alias("_late")))
        both = marked.where("NOT _late").select(*cols).unionByName(state)
        rest = F.struct(*[c for c in cols if c != key])
        new_state = both.groupBy(key).agg(F.max_by(rest, place).alias("_l")).select(key, "_l.*")
        tables.publish(batch_id, {"changes": price_changes(both, key, ts, tie, value), "late": marked.where("_late").select(*cols)},
                       new_state, key, before)

    last = _run(source, sink, base, tables, ledger, "prices")
    if last is None:
        none = spark.createDataFrame([], source.schema).select(*cols)
        return price_changes(none, key, ts, tie, value), none
    return tables.table("changes", last), tables.table("late", last)
