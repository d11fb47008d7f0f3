"""T3-T6 bucketing, D1-D4 / K1-K4 two-run ingest over FX-listings."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from rentlens.functions import text as tx
from rentlens.operators import history, ingest
from rentlens.operators.ledger import RunLedger
from rentlens.plans.common import shape
from rentlens.plans.registry import query
from rentlens.session import scratch_path
from rentlens.sources.fixtures import fx, fx_cte

# Runs: sightings before the cutoff form run 1, the rest run 2.
RUN_CUTOFF = "1995-06-17 00:00:00"


def _bucket_sql(x: str, width: str) -> str:
    lo = f"CAST(floor({x} / {width}) * {width} AS BIGINT)"
    return f"concat_ws('-', CAST({lo} AS VARCHAR), CAST({lo} + {width} AS VARCHAR))"


RENT_BUCKET_SQL = (f"CASE WHEN rent_monthly IS NULL THEN 'unknown' WHEN rent_monthly < 100000 "
                   f"THEN {_bucket_sql('rent_monthly', '5000')} ELSE {_bucket_sql('rent_monthly', '20000')} END")
AREA_BUCKET_SQL = f"CASE WHEN area_sqft IS NULL THEN 'unknown' ELSE {_bucket_sql('area_sqft', '200')} END"
DEDUP_KEY_SQL = (f"concat_ws('|', CASE WHEN locality_norm IS NULL OR locality_norm = '' THEN 'unknown' "
                 f"ELSE locality_norm END, coalesce(CAST(bhk AS VARCHAR), 'unk'), {RENT_BUCKET_SQL}, {AREA_BUCKET_SQL})")
HASH_INPUT_SQL = ("concat_ws('|', source, locality_norm, CAST(CAST(floor(coalesce(rent_monthly, -1) * 100) AS BIGINT) "
                  "AS VARCHAR), CAST(CAST(floor(area_sqft) AS BIGINT) AS VARCHAR))")

RAW_CTE = fx_cte("fx_listings") + f""",
raw AS (SELECT *, listing_id AS raw_id, first_seen_at AS observed_at, sha256({HASH_INPUT_SQL}) AS content_hash,
               CASE WHEN first_seen_at < TIMESTAMP '{RUN_CUTOFF}' THEN 1 ELSE 2 END AS run_id FROM fx_listings),
ins AS (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY source, content_hash ORDER BY observed_at, raw_id) = 1),
keyed AS (SELECT *, {DEDUP_KEY_SQL} AS dedup_key FROM ins)
"""


def raw_sightings(spark, sf_dir):
    d = fx(spark, sf_dir, "fx_listings")
    h = F.concat_ws("|", "source", "locality_norm",
                    F.floor(F.coalesce(F.col("rent_monthly"), F.lit(-1.0)) * 100).cast("bigint").cast("string"),
                    F.floor("area_sqft").cast("bigint").cast("string"))
    return (d.withColumn("raw_id", F.col("listing_id"))
             .withColumn("observed_at", F.col("first_seen_at"))
             .withColumn("content_hash", F.sha2(h, 256))
             .withColumn("run_id", F.when(F.col("first_seen_at") < F.lit(RUN_CUTOFF).cast("timestamp"), 1)
                         .otherwise(2))
             .drop("listing_id", "first_seen_at"))


def order():
    return [F.col("observed_at"), F.col("raw_id")]


def _ingest(spark, sf_dir):
    return ingest.ingest_runs(raw_sightings(spark, sf_dir), [1, 2], "run_id", order())


@query("dedup_key_buckets", fx_cte("fx_listings") + f"""
SELECT listing_id, {RENT_BUCKET_SQL} AS rent_bucket, {AREA_BUCKET_SQL} AS area_bucket, {DEDUP_KEY_SQL} AS dedup_key
FROM fx_listings
""")
def dedup_key_buckets(spark, sf_dir):
    d = fx(spark, sf_dir, "fx_listings")
    return d.select("listing_id", tx.rent_bucket(F.col("rent_monthly")).alias("rent_bucket"),
                    tx.area_bucket(F.col("area_sqft")).alias("area_bucket"),
                    tx.dedup_key(F.col("locality_norm"), F.col("bhk"), F.col("rent_monthly"),
                                 F.col("area_sqft")).alias("dedup_key"))


STATE_COLS = ["dedup_key", "listing_id", "source", "locality_norm", "bhk", "area_sqft", "rent_monthly", "deposit",
              "property_type", "furnishing", "floor_num", "total_floors", "first_seen_at", "last_seen_at",
              "latest_raw_id"]


@query("listing_upsert", RAW_CTE + """,
f AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY dedup_key ORDER BY observed_at, raw_id) = 1),
l AS (SELECT dedup_key, observed_at AS last_seen_at, raw_id AS latest_raw_id FROM keyed
      QUALIFY row_number() OVER (PARTITION BY dedup_key ORDER BY observed_at DESC, raw_id DESC) = 1)
SELECT f.dedup_key, substr(sha256(f.dedup_key), 1, 16) AS listing_id, source, locality_norm, bhk, area_sqft,
       rent_monthly, deposit, property_type, furnishing, CAST(floor_num AS DOUBLE) AS floor_num,
       CAST(total_floors AS DOUBLE) AS total_floors, f.observed_at AS first_seen_at,
       l.last_seen_at, l.latest_raw_id
FROM f JOIN l ON f.dedup_key = l.dedup_key
""")
def listing_upsert(spark, sf_dir):
    state, _, _ = _ingest(spark, sf_dir)
    return shape(state.select(*STATE_COLS), as_double=["floor_num", "total_floors"])


@query("run_metrics", RAW_CTE + """,
firsts AS (SELECT dedup_key, min(run_id) AS run_id FROM keyed GROUP BY dedup_key)
SELECT r.run_id, r.n_scraped, i.n_raw, coalesce(n.n_new, 0) AS n_new, 'ok' AS status
FROM (SELECT run_id, count(*) AS n_scraped FROM raw GROUP BY run_id) r
JOIN (SELECT run_id, count(*) AS n_raw FROM ins GROUP BY run_id) i ON r.run_id = i.run_id
LEFT JOIN (SELECT run_id, count(*) AS n_new FROM firsts GROUP BY run_id) n ON r.run_id = n.run_id
""")
def run_metrics(spark, sf_dir):
    _, _, met = _ingest(spark, sf_dir)
    return met


@query("observations", RAW_CTE + """
SELECT raw_id, run_id, dedup_key, substr(sha256(dedup_key), 1, 16) AS listing_id, observed_at, rent_monthly, deposit
FROM keyed
""")
def observations(spark, sf_dir):
    _, obs, _ = _ingest(spark, sf_dir)
    return obs


@query("run_ledger", RAW_CTE + """,
firsts AS (SELECT dedup_key, min(run_id) AS run_id FROM keyed GROUP BY dedup_key)
SELECT CAST(r.run_id AS VARCHAR) AS run_id, 0 AS attempt, 'cards' AS source, r.n_scraped, i.n_raw, coalesce(n.n_new, 0) AS n_new,
       'ok' AS status, CAST(NULL AS VARCHAR) AS error, 'unknown' AS git_sha, true AS ended
FROM (SELECT run_id, count(*) AS n_scraped FROM raw GROUP BY run_id) r
JOIN (SELECT run_id, count(*) AS n_raw FROM ins GROUP BY run_id) i ON r.run_id = i.run_id
LEFT JOIN (SELECT run_id, count(*) AS n_new FROM firsts GROUP BY run_id) n ON r.run_id = n.run_id
""")
def run_ledger(spark, sf_dir):
    """The ledger that the two runs write while they ingest."""
    ledger = RunLedger(spark, scratch_path(spark, f"ledger-{uuid.uuid4().hex}"))
    ingest.ingest_runs(raw_sightings(spark, sf_dir), [1, 2], "run_id", order(), ledger=ledger, source="cards", git_sha="unknown")
    rows = ledger.rows().withColumn("ended", F.col("finished_at") >= F.col("started_at"))
    return rows.drop("started_at", "finished_at")


REPEAT_GAP_DAYS = 7


@query("repeat_spans", RAW_CTE + f""",
rep AS (SELECT r.*, k.dedup_key AS kept_key FROM raw r JOIN keyed k ON k.source = r.source AND k.content_hash = r.content_hash
        WHERE r.raw_id <> k.raw_id),
lagged AS (SELECT *, lag(observed_at) OVER (PARTITION BY run_id, source, content_hash ORDER BY observed_at, raw_id) AS before FROM rep),
numbered AS (SELECT *, sum(CASE WHEN before IS NULL OR observed_at > before + INTERVAL {REPEAT_GAP_DAYS} DAY THEN 1 ELSE 0 END)
             OVER (PARTITION BY run_id, source, content_hash ORDER BY observed_at, raw_id) AS span FROM lagged)
SELECT run_id, substr(sha256(kept_key), 1, 16) AS listing_id, content_hash, min(observed_at) AS first_at, max(observed_at) AS last_at,
       count(*) AS n FROM numbered GROUP BY run_id, source, content_hash, kept_key, span
""")
def repeat_spans(spark, sf_dir):
    """W6/D4 with observe_repeats: the sightings that insert-if-absent leaves out, as spans."""
    *_, spans = ingest.ingest_runs(raw_sightings(spark, sf_dir), [1, 2], "run_id", order(), observe_repeats=True,
                                   max_gap_days=REPEAT_GAP_DAYS)
    return spans


@query("days_on_market_repeats", RAW_CTE + """,
seen AS (SELECT r.observed_at, k.dedup_key FROM raw r JOIN keyed k ON k.source = r.source AND k.content_hash = r.content_hash)
SELECT substr(sha256(dedup_key), 1, 16) AS listing_id, min(observed_at) AS first_seen_at, max(observed_at) AS last_seen_at,
       count(*) AS n_sightings,
       CAST(datediff('day', CAST(min(observed_at) AS DATE), CAST(max(observed_at) AS DATE)) AS INTEGER) AS days_on_market
FROM seen GROUP BY dedup_key
""")
def days_on_market_repeats(spark, sf_dir):
    """W6 with observe_repeats: inserted sightings and the spans of repeated ones."""
    _, obs, _, spans = ingest.ingest_runs(raw_sightings(spark, sf_dir), [1, 2], "run_id", order(), observe_repeats=True,
                                          max_gap_days=REPEAT_GAP_DAYS)
    single = obs.select("listing_id", F.col("observed_at").alias("first_at"), F.col("observed_at").alias("last_at"), F.lit(1).cast("long").alias("n"))
    return history.days_on_market_spans(single.unionByName(spans.select("listing_id", "first_at", "last_at", "n")))
