"""Sighting-log history: days on market and sighting spans (W6), price changes (W7), listing
month (W8), prediction drift between model versions (W9), expanding-window
time splits (P8), latest runs (O3) and text preview lines (O6).

Per-listing sequences are cut into sorted slices by range; a sighting finds its
predecessor inside its slice, and a slice's first sighting of a listing in a
table of the slices' last ones, so a listing with a huge sighting history is
spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from rentlens.operators.stats import _join_on_keys
from rentlens.session import materialize

# Python str.splitlines() boundaries.
LINE_BREAK = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def days_on_market(obs: DataFrame, key: str = "listing_id", ts: str = "observed_at") -> DataFrame:
    return (obs.groupBy(key).agg(F.min(ts).alias("first_seen_at"), F.max(ts).alias("last_seen_at"),
                                 F.count(F.lit(1)).alias("n_sightings"))
               .withColumn("days_on_market", F.datediff(F.to_date("last_seen_at"), F.to_date("first_seen_at"))))


def _slices(obs: DataFrame, keys: list[str], ts: str, tie: str) -> DataFrame:
    """The rows in order of key and time, written in sorted slices (``_pid``); a key with a third of all rows spans many."""
    return materialize(obs.repartitionByRange(*keys, ts, tie).sortWithinPartitions(*keys, ts, tie)
                       .withColumn("_pid", F.spark_partition_id()))


def _with_previous(s: DataFrame, keys: list[str], ts: str, tie: str, cols: list[str]) -> DataFrame:
    """Each row of ``_slices`` with ``_prev``, the struct of ``cols`` of its key's row before (NULL for the first).
    Inside a slice that is the row before; a slice's first row of a key takes the key's last row in the nearest slice
    before it."""
    own = Window.partitionBy("_pid", *keys).orderBy(ts, tie)
    inside = s.withColumn("_nth", F.row_number().over(own)).withColumn("_in", F.lag(F.struct(*cols)).over(own))
    last = s.groupBy("_pid", *keys).agg(F.max_by(F.struct(*cols), F.struct(ts, tie)).alias("_last"))
    before = Window.partitionBy(*keys).orderBy("_pid")   # at most one row per slice
    edge = last.withColumn("_edge", F.lag("_last").over(before)).where("_edge IS NOT NULL").withColumn("_nth", F.lit(1))
    # slices are sorted by key, so at most one key goes on from a slice into the next: one row per slice
    j = _join_on_keys(inside, F.broadcast(edge.select("_pid", *keys, "_nth", "_edge")), ["_pid", *keys, "_nth"], "left")
    return j.withColumn("_prev", F.coalesce("_edge", "_in")).drop("_edge", "_in", "_nth")


def price_changes(obs: DataFrame, key: str = "listing_id", ts: str = "observed_at", tie: str = "obs_id",
                  value: str = "rent_monthly") -> DataFrame:
    """Sightings whose price differs from the listing's previous sighting."""
    j = _with_previous(_slices(obs.select(key, ts, tie, value), [key], ts, tie), [key], ts, tie, [value, tie])
    prev = F.col(f"_prev.{value}")
    return (j.where(prev.isNotNull() & F.col(value).isNotNull() & (F.col(value) != prev))
             .select(tie, key, ts, prev.alias("prev_" + value), value, (F.col(value) - prev).alias("delta")))


def sighting_spans(obs: DataFrame, keys: list[str], ts: str, tie: str, values: list[str], max_gap_days: int) -> DataFrame:
    """Gaps and islands: (keys, values, first_at, last_at, n), one row for each run of sightings of a key with equal
    ``values`` and at most ``max_gap_days`` (of 24 hours) between neighbours.

    A span's number is the count of breaks up to it: breaks are counted inside each slice, and the counts of the
    slices before are added from a table of one row per slice and key.
    """
    s = _slices(obs.select(*keys, ts, tie, *values), keys, ts, tie)
    j = _with_previous(s, keys, ts, tie, [ts, *values])
    breaks = F.col("_prev").isNull() | (F.col(ts) > F.col(f"_prev.{ts}") + F.make_dt_interval(F.lit(max_gap_days)))
    for v in values:
        breaks = breaks | ~F.col(v).eqNullSafe(F.col(f"_prev.{v}"))
    j = materialize(j.withColumn("_break", F.coalesce(breaks, F.lit(False)).cast("long")).drop("_prev"))
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    seg = (j.groupBy("_pid", *keys).agg(F.sum("_break").alias("_breaks"))
           .select("_pid", *keys, F.coalesce(F.sum("_breaks").over(before), F.lit(0)).alias("_off")))
    own = Window.partitionBy("_pid", *keys).orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, 0)
    j = _join_on_keys(j.withColumn("_nth", F.sum("_break").over(own)), seg, ["_pid", *keys])
    return (j.groupBy(*keys, (F.col("_nth") + F.col("_off")).alias("_span"), *values)
             .agg(F.min(ts).alias("first_at"), F.max(ts).alias("last_at"), F.count(F.lit(1)).alias("n"))
             .drop("_span"))


def days_on_market_spans(spans: DataFrame, key: str = "listing_id") -> DataFrame:
    """W6 over spans (first_at, last_at, n) instead of single sightings."""
    return (spans.groupBy(key).agg(F.min("first_at").alias("first_seen_at"), F.max("last_at").alias("last_seen_at"),
                                   F.sum("n").alias("n_sightings"))
                 .withColumn("days_on_market", F.datediff(F.to_date("last_seen_at"), F.to_date("first_seen_at"))))


def listing_month(obs: DataFrame, key: str = "listing_id", ts: str = "observed_at") -> DataFrame:
    return obs.groupBy(key).agg(F.date_trunc("month", F.min(ts)).alias("listing_month"))


def time_splits(obs: DataFrame, week: str = "week") -> DataFrame:
    """Fold k trains on weeks before the k-th week and validates on it
    (k >= 2). Only per-week counts are shuffled; the cumulative sum runs over
    one row per week."""
    wk = obs.groupBy(week).agg(F.count(F.lit(1)).alias("n_valid"))
    w = Window.orderBy(week)
    return (wk.withColumn("fold", F.row_number().over(w) - 1)
              .withColumn("n_train", F.coalesce(F.sum("n_valid").over(w.rowsBetween(Window.unboundedPreceding, -1)),
                                                 F.lit(0)))
              .where(F.col("fold") >= 1)
              .select("fold", F.col(week).alias("valid_week"), "n_train", "n_valid"))


def prediction_drift(preds: DataFrame, old: str, new: str, key: str = "listing_id") -> DataFrame:
    """Average change in predicted rent between two model versions."""
    a = preds.where(F.col("model_version") == old).select(key, F.col("predicted_rent").alias("_old"))
    b = preds.where(F.col("model_version") == new).select(key, F.col("predicted_rent").alias("_new"))
    d = a.join(b, key).withColumn("_d", F.col("_new") - F.col("_old"))
    return d.agg(F.count(F.lit(1)).alias("n_common"), F.avg("_d").alias("avg_delta"),
                 F.avg(F.abs("_d")).alias("avg_abs_delta"),
                 F.avg(F.abs("_d") / F.col("_old")).alias("avg_rel_delta")).select(
        F.lit(old).alias("from_version"), F.lit(new).alias("to_version"), "*")


def latest(df: DataFrame, order, n: int = 10) -> DataFrame:
    """Newest n rows under a total order."""
    return df.orderBy(*order).limit(n)


def preview_lines(df: DataFrame, key: str, text: str, max_chars: int = 600) -> DataFrame:
    """First ``max_chars`` characters, one row per line (Python splitlines)."""
    head = F.substring(F.coalesce(F.col(text), F.lit("")), 1, max_chars)
    parts = F.split(head, LINE_BREAK, -1)
    n = F.size(parts)
    keep = F.when(head == "", F.array().cast("array<string>")).when(
        F.try_element_at(parts, F.lit(-1)) == "", F.slice(parts, 1, n - 1)).otherwise(parts)
    return df.select(key, F.posexplode(keep).alias("line_no", "line"))
