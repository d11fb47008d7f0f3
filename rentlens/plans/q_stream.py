"""Streaming plans: each runs an availableNow stream over the landed files
and returns the table it wrote. Their oracles are the batch twins' SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from rentlens.plans import q_history  # noqa: F401  (registers price_changes)
from rentlens.plans.q_ingest import STATE_COLS, order
from rentlens.plans.common import shape
from rentlens.plans.registry import ORACLES, query
from rentlens.sources.fixtures import FX_SQL
from rentlens.sources.tables import read_table
from rentlens.streaming import ingest_stream as st

SIGHTINGS_CUTOFF = "2024-01-03 00:00:00"


@query("stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, sf_dir):
    return st.stream_dedup(spark, st.file_stream(spark, sf_dir, "events")).select("user_id", "event_type")


@query("stream_weekly_sightings", f"""
SELECT CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR) AS week, user_id, count(*) AS n_sightings
FROM events WHERE ts >= TIMESTAMP '{SIGHTINGS_CUTOFF}' GROUP BY 1, 2
""")
def stream_weekly_sightings(spark, sf_dir):
    w = st.weekly_sightings(spark, st.file_stream(spark, sf_dir, "events"), SIGHTINGS_CUTOFF)
    return w.select(F.to_date("week_start").cast("string").alias("week"), "user_id", "n_sightings")


def _prepare(batch):
    """Landed listing rows -> raw sightings (same derivation as the batch plan)."""
    h = F.concat_ws("|", "source", "locality_norm",
                    F.floor(F.coalesce(F.col("rent_monthly"), F.lit(-1.0)) * 100).cast("bigint").cast("string"),
                    F.floor("area_sqft").cast("bigint").cast("string"))
    return (batch.withColumn("raw_id", F.col("listing_id")).withColumn("observed_at", F.col("first_seen_at"))
                 .withColumn("content_hash", F.sha2(h, 256)).drop("listing_id", "first_seen_at"))


@query("stream_upsert")
def stream_upsert(spark, sf_dir):
    """Lineitem files stream in, joined to the static part table, projected
    to listings and upserted run by run; ends in the same state as the batch
    ingest (batch-split invariance)."""
    read_table(spark, sf_dir, "part").createOrReplaceTempView("part")
    st.file_stream(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem_stream")
    src = spark.sql(FX_SQL["fx_listings"].replace("FROM lineitem JOIN part", "FROM lineitem_stream JOIN part"))
    state, _, _ = st.stream_upsert(spark, src, _prepare, order)
    return shape(state.select(*STATE_COLS), as_double=["floor_num", "total_floors"])


ORACLES["stream_upsert"] = ORACLES["listing_upsert"]


@query("stream_price_changes")
def stream_price_changes(spark, sf_dir):
    """R4 + W7: the sightings stream in; equals the batch query."""
    st.file_stream(spark, sf_dir, "events").createOrReplaceTempView("events_stream")
    src = spark.sql(FX_SQL["fx_observations"].replace("FROM events", "FROM events_stream"))
    return shape(st.stream_price_changes(spark, src)[0], ["delta"])


ORACLES["stream_price_changes"] = ORACLES["price_changes"]
