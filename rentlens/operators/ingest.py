"""Incremental ingest: exact dedup, insert-if-absent, upsert merge, sighting log
and repeated sightings (D1-D5, K1-K4; the run ledger is ``operators/ledger.py``).

Every per-key decision is an associative aggregate (``min_by`` / ``max_by`` on a
struct ordering key), so Spark combines map-side before the shuffle and a hot
key (one source, one dedup bucket holding a third of the rows) is reduced to
one partial row per map task before it reaches the reducer.
"""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import nullcontext
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from rentlens.functions import text as tx
from rentlens.session import materialize

DEDUP_KEYS = ("source", "content_hash")
LISTING_ATTRS = ["source", "locality", "locality_norm", "bhk", "area_sqft", "rent_monthly", "deposit",
                 "property_type", "furnishing", "floor_num", "total_floors"]


def listing_id_of(dedup_key: Column) -> Column:
    """Stable listing id derived from the business key (no global counters)."""
    return F.substring(F.sha2(dedup_key, 256), 1, 16)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row per key under ``order`` (first arrival wins).

    A row travels once, its order columns in front: the smallest of them is the first row.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    by = df.select(*order).columns
    if not set(by) <= set(rest) or any(isinstance(df.schema[c].dataType, (T.MapType, T.VariantType)) for c in rest):
        picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"))
    else:
        picked = df.groupBy(*keys).agg(F.min(F.struct(*by, *[c for c in rest if c not in by])).alias("_first"))
    return picked.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest])


def _packed(c: Column) -> Column:
    """A text as bytes, lower-case hex digits (a hash) as half as many; ``_unpacked`` gives it back. Differs wherever the texts do."""
    raw = F.unhex(c)
    return F.when(F.lower(F.hex(raw)) == c, F.concat(F.lit(b"\x01"), raw)).otherwise(F.concat(F.lit(b"\x00"), c.cast("binary")))


def _unpacked(c: Column) -> Column:
    rest = F.substring(c, 2, 2**31 - 1)
    return F.when(F.substring(c, 1, 1) == F.lit(b"\x01"), F.lower(F.hex(rest))).otherwise(rest.cast("string"))


def insert_if_absent(history: DataFrame | None, batch: DataFrame, keys: Sequence[str],
                     order: Sequence[Column]) -> DataFrame:
    """K1: rows of ``batch`` whose key is new, first arrival per key. Text keys travel packed; a history that holds a
    key twice leaves it out once, so it is not made distinct first."""
    keys = list(keys)
    text = [k for k in keys if batch.schema[k].dataType.typeName() == "string"]
    pack = {k: _packed(F.col(k)) for k in text}
    first = first_per_key(batch.withColumns(pack), keys, order)
    if history is not None:
        first = first.join(history.select(*keys).withColumns(pack), keys, "left_anti")
    return first.withColumns({k: _unpacked(F.col(k)) for k in text})


def with_dedup_key(df: DataFrame) -> DataFrame:
    """locality_norm (when only ``locality`` is given) and dedup_key."""
    if "locality_norm" not in df.columns:
        df = df.withColumn("locality_norm", tx.normalize_locality(F.col("locality")))
    return df.withColumn("dedup_key", tx.dedup_key(F.col("locality_norm"), F.col("bhk"),
                                                   F.col("rent_monthly"), F.col("area_sqft")))


def merge_listings(state: DataFrame | None, raw: DataFrame, order: Sequence[Column],
                   attrs: Sequence[str] = LISTING_ATTRS) -> DataFrame:
    """D3/K2: upsert one batch of raw sightings into the listings state.

    New key: attributes of its first arrival, first_seen_at = last_seen_at of
    the first arrival. Known key: only last_seen_at and latest_raw_id move to
    the batch's last arrival; attributes never refresh. Output keeps an
    ``is_new`` flag for the batch's run metrics.
    """
    attrs = [a for a in attrs if a in raw.columns]
    okey = F.struct(*order)
    b = (raw.groupBy("dedup_key")
            .agg(F.min_by(F.struct(*attrs, "observed_at"), okey).alias("_f"),
                 F.max_by(F.struct("raw_id", "observed_at"), okey).alias("_l"))
            .select("dedup_key", *[F.col(f"_f.{a}").alias(a) for a in attrs],
                    F.col("_f.observed_at").alias("first_seen_at"),
                    F.col("_l.observed_at").alias("last_seen_at"),
                    F.col("_l.raw_id").alias("latest_raw_id")))
    if state is None:
        return (b.withColumn("listing_id", listing_id_of(F.col("dedup_key")))
                 .withColumn("is_new", F.lit(True)))
    s = state.drop("is_new").alias("s")
    j = s.join(b.alias("b"), "dedup_key", "full_outer")
    known = F.col("s.listing_id").isNotNull()
    cols = [F.col("dedup_key")]
    for a in attrs:
        cols.append(F.when(known, F.col(f"s.{a}")).otherwise(F.col(f"b.{a}")).alias(a))
    cols += [
        F.when(known, F.col("s.first_seen_at")).otherwise(F.col("b.first_seen_at")).alias("first_seen_at"),
        F.coalesce(F.col("b.last_seen_at"), F.col("s.last_seen_at")).alias("last_seen_at"),
        F.coalesce(F.col("b.latest_raw_id"), F.col("s.latest_raw_id")).alias("latest_raw_id"),
        listing_id_of(F.col("dedup_key")).alias("listing_id"),
        (~known).alias("is_new"),
    ]
    return j.select(*cols)


def ingest_run(history: DataFrame | None, state: DataFrame | None, batch: DataFrame, run_id,
               order: Sequence[Column], dedup_keys: Sequence[str] = DEDUP_KEYS):
    """One run: D1 against history and within the batch, D3 merge, K3 log, K4 ledger.

    ``batch`` needs raw_id, content_hash, observed_at and the listing fields.
    Returns (raw_inserted, new_state, observations, run_metrics).
    """
    inserted = insert_if_absent(history, batch, dedup_keys, order)
    return inserted, *merge_run(state, batch, inserted, run_id, order)


def merge_run(state: DataFrame | None, batch: DataFrame, inserted: DataFrame, run_id, order: Sequence[Column]):
    """The run after D1: (new_state, observations, run_metrics)."""
    keyed = with_dedup_key(inserted)
    new_state = merge_listings(state, keyed, order)
    obs = keyed.select(
        "raw_id", F.lit(run_id).alias("run_id"), "dedup_key",
        listing_id_of(F.col("dedup_key")).alias("listing_id"),
        "observed_at", "rent_monthly", "deposit")
    new_keys = (keyed.select("dedup_key").distinct() if state is None else
                keyed.select("dedup_key").distinct().join(state.select("dedup_key"), "dedup_key", "left_anti"))
    tagged = (batch.select(F.lit("scraped").alias("_k"))
              .unionByName(inserted.select(F.lit("raw").alias("_k")))
              .unionByName(new_keys.select(F.lit("new").alias("_k"))))
    metrics = tagged.agg(
        F.count(F.when(F.col("_k") == "scraped", 1)).alias("n_scraped"),
        F.count(F.when(F.col("_k") == "raw", 1)).alias("n_raw"),
        F.count(F.when(F.col("_k") == "new", 1)).alias("n_new"),
    ).select(F.lit(run_id).alias("run_id"), "n_scraped", "n_raw", "n_new", F.lit("ok").alias("status"))
    return new_state, obs, metrics


def repeat_spans(batch: DataFrame, inserted: DataFrame, known: DataFrame, run_id, max_gap_days: int) -> DataFrame:
    """W6/D4, the option ``observe_repeats``: the run's repeated sightings as spans.

    A row that insert-if-absent did not insert is another sighting of the raw row it repeats. Equal sightings are
    compressed before they meet their listing: (source, content_hash, first_at, last_at, n), a new span wherever more
    than ``max_gap_days`` lie between neighbours. ``known`` is (source, content_hash, listing_id) of all raw rows,
    this run's included.
    """
    from rentlens.operators.history import sighting_spans
    repeats = batch.join(inserted.select(F.col("raw_id").alias("_in")), F.col("raw_id") == F.col("_in"), "left_anti")
    repeats = repeats.withColumn("content_hash", _packed(F.col("content_hash")))
    spans = sighting_spans(repeats, list(DEDUP_KEYS), "observed_at", "raw_id", [], max_gap_days)
    k = known.toDF("_source", "_hash", "listing_id").withColumn("_hash", _packed(F.col("_hash")))
    spans = spans.join(k, F.col("source").eqNullSafe(F.col("_source")) & F.col("content_hash").eqNullSafe(F.col("_hash")))
    return spans.select(F.lit(run_id).alias("run_id"), "listing_id", _unpacked(F.col("content_hash")).alias("content_hash"),
                        "first_at", "last_at", "n")


def ingest_runs(raw: DataFrame, runs: Sequence, run_col: str, order: Sequence[Column], ledger=None,
                observe_repeats: bool = False, max_gap_days: int = 7, source: str | None = None, git_sha: str | None = None):
    """Apply runs in order; returns (final_state, observations, metrics), and with ``observe_repeats`` also the
    spans of the sightings that were not inserted.

    The inserted rows, the state and the counts of every run are written before
    the next one reads them, so the plan of a run does not hold those of earlier
    runs. With ``ledger`` (a RunLedger) every run writes its ledger rows there.
    """
    history = state = None
    outs: list[list[DataFrame]] = []
    for r in runs:
        with ledger.run(r, source, git_sha) if ledger else nullcontext() as entry:
            batch = raw.where(F.col(run_col) == F.lit(r))
            inserted = materialize(insert_if_absent(history, batch, DEDUP_KEYS, order))
            state, obs, met = merge_run(state, batch, inserted, r, order)
            state = materialize(state)
            keyed = with_dedup_key(inserted)
            keep = keyed.select(*DEDUP_KEYS, listing_id_of(F.col("dedup_key")).alias("listing_id"))
            history = keep if history is None else history.unionByName(keep)
            outs.append([obs, met] + ([repeat_spans(batch, inserted, history, r, max_gap_days)] if observe_repeats else []))
            if entry is not None:
                met = outs[-1][1] = materialize(met)
                entry.record(met)
    return state, *[reduce(DataFrame.unionByName, frames) for frames in zip(*outs)]
