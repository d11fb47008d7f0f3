"""Deterministic projections of the test tables into the shape of the
listing-market data model (FIXTURES.md). The same SQL text runs in Spark and in
the DuckDB oracle, so both sides start from identical rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rentlens.sources.tables import register_views

FX_SQL: dict[str, str] = {}

FX_SQL["fx_listings"] = """
SELECT concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING)) AS listing_id,
       CASE WHEN l_linestatus = 'O' THEN 'nobroker'
            WHEN l_suppkey % 3 = 0 THEN concat('telegram_share:g', CAST(l_suppkey % 5 AS STRING))
            ELSE concat('telegram:g', CAST(l_suppkey % 5 AS STRING)) END AS source,
       CASE WHEN l_partkey % 97 = 0 THEN NULL ELSE lower(replace(p_brand, '#', '_')) END AS locality_norm,
       CASE WHEN l_partkey % 89 = 0 THEN NULL ELSE CAST(1 + (p_size % 7) / 2.0 AS DOUBLE) END AS bhk,
       l_quantity * 50 AS area_sqft,
       CASE WHEN l_suppkey % 41 = 0 THEN NULL ELSE l_extendedprice END AS rent_monthly,
       CASE WHEN l_linenumber = 7 THEN NULL ELSE l_extendedprice * (1 + l_linenumber) END AS deposit,
       CASE p_type WHEN 'PROMO' THEN 'villa' WHEN 'ECONOMY' THEN 'apartment' WHEN 'MEDIUM' THEN 'independent_house'
                   WHEN 'SMALL' THEN 'studio' WHEN 'LARGE' THEN 'pg' ELSE NULL END AS property_type,
       CASE l_returnflag WHEN 'A' THEN 'Fully Furnished' WHEN 'N' THEN 'semi' ELSE NULL END AS furnishing,
       CASE WHEN l_suppkey % 3 = 1 THEN NULL ELSE p_size % 13 END AS floor_num,
       CASE WHEN l_suppkey % 3 = 1 THEN NULL ELSE 13 END AS total_floors,
       CAST(l_shipdate AS TIMESTAMP) AS first_seen_at
FROM lineitem JOIN part ON l_partkey = p_partkey
"""

FX_SQL["fx_cards"] = """
SELECT concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING)) AS listing_id,
       CASE l_suppkey % 4 WHEN 0 THEN 'HSR Layout' WHEN 1 THEN 'Koramangala' WHEN 2 THEN 'Sarjapur Road' ELSE 'Hebbal' END AS locality_query,
       concat(CAST(1 + p_size % 4 AS STRING), ' BHK ',
              CASE p_size % 5 WHEN 0 THEN 'Flat' WHEN 1 THEN 'Independent House' WHEN 2 THEN 'Villa' WHEN 3 THEN 'Studio' ELSE 'House' END,
              ' for Rent In ',
              CASE l_partkey % 5 WHEN 0 THEN 'HSR Layout' WHEN 1 THEN 'Jigani' WHEN 2 THEN 'Sarjapur Road' WHEN 3 THEN 'Hebbal' ELSE 'e-city' END,
              ', Bangalore', chr(10), '₹', CAST(CAST(floor(l_extendedprice) AS BIGINT) AS STRING), chr(10), 'Rent', chr(10),
              '₹ ', CAST(CAST(floor(l_extendedprice * l_linenumber) AS BIGINT) AS STRING), chr(10), 'Deposit', chr(10),
              CAST(CAST(floor(l_quantity * 50) AS BIGINT) AS STRING), ' sqft', chr(10),
              CAST(p_size % 20 AS STRING), '/', CAST(p_size % 23 AS STRING), chr(10),
              CASE l_returnflag WHEN 'A' THEN 'Fully Furnished' WHEN 'N' THEN 'Semi-furnished' ELSE 'Unfurnished' END, chr(10),
              CASE WHEN p_size % 2 = 0 THEN '5-10 Years' ELSE 'New building' END) AS raw_text
FROM lineitem JOIN part ON l_partkey = p_partkey
"""

FX_SQL["fx_messages"] = """
SELECT doc_id AS msg_id, source AS group_name,
       concat(CASE doc_id % 10
         WHEN 0 THEN 'NO BROKERAGE!! 2 BHK for Rent in HSR. RENT: 27k, family preferred, gym and lift. '
         WHEN 1 THEN 'Female flatmate wanted, 3 BHK in BTM, Rs 12,500 per person, wifi, washing machine. '
         WHEN 2 THEN 'Expected price 10800/- per sqft 2BHK available for sale near Hoodi. '
         WHEN 3 THEN 'Owner direct 1.5 BHK 850 sq.ft rent 18,000 negotiable, lock-in: 11 months, pure veg only. '
         WHEN 4 THEN 'Rental 1.2L villa Whitefield, swimming pool, clubhouse, power backup, any food. '
         WHEN 5 THEN 'rent 15000 located near Silk Board, bachelors only - male, minimum stay 2 years. '
         WHEN 6 THEN 'Posted by broker. deposit 50000, anyone welcome, 24/7 security and cctv. '
         WHEN 7 THEN 'Preferred Tenants: All. non-negotiable. geyser, fridge, car park. '
         WHEN 8 THEN concat(chr(10), chr(10), 'hi', chr(9)) ELSE '' END, text, CASE WHEN doc_id % 4 = 1 THEN concat(chr(10), ' ', chr(10)) ELSE '' END) AS text
FROM documents
"""

FX_SQL["fx_responses"] = """
SELECT doc_id AS listing_id, 400 + doc_id % 37 AS prompt_tokens, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE 60 + doc_id % 13 END AS output_tokens,
       CASE doc_id % 10
         WHEN 6 THEN concat(chr(10), ' {"tenant_pref":"family","lock_in_months":11.0,"amenities":["ac"]} ', chr(9))
         WHEN 7 THEN '{"lock_in_months":6.5,"negotiable":true}'
         WHEN 8 THEN '{"lock_in_months":true,"amenities":{"ac":1}}'
         WHEN 9 THEN '{"lock_in_months":"6.5","veg_only":null}'
         WHEN 0 THEN '{"tenant_pref":"family","veg_only":true,"is_owner":false,"negotiable":null,"lock_in_months":11,"amenities":["lift","gym","lift"]}'
         WHEN 1 THEN 'Here you go: {"tenant_pref":"students","veg_only":"yes","is_owner":true,"lock_in_months":"6","amenities":["jacuzzi","ac"]} done'
         WHEN 2 THEN '{"tenant_pref":null,"amenities":"none"}'
         WHEN 3 THEN '{"tenant_pref":"any","lock_in_months":"soon","amenities":[]}'
         WHEN 4 THEN 'sorry' ELSE '{"broken": ' END AS response
FROM documents
"""

FX_SQL["fx_labels"] = """
SELECT doc_id AS listing_id, quality AS veg_only, CASE WHEN toxic = 1 THEN NULL ELSE 1 END AS is_owner,
       CASE doc_id % 4 WHEN 0 THEN 'family' WHEN 1 THEN 'any' WHEN 2 THEN 'bachelors' ELSE NULL END AS tenant_pref,
       CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 1 END AS negotiable,
       CASE WHEN doc_id % 6 = 0 THEN NULL ELSE CAST(doc_id % 12 AS INT) END AS lock_in_months,
       CASE doc_id % 5 WHEN 0 THEN '["gym", "lift"]' WHEN 1 THEN '["lift", "gym", "lift"]' WHEN 2 THEN '[]' WHEN 3 THEN NULL ELSE '["ac"]' END AS amenities_json,
       CASE WHEN doc_id % 3 = 0 THEN 'human' ELSE 'silver-gemini' END AS label_source
FROM labels
"""

FX_SQL["fx_extractions"] = """
SELECT l.doc_id AS listing_id, x.extractor, x.extractor_version,
       CAST(CASE WHEN x.extractor_version = '1.0' THEN '2024-02-01 00:00:00' ELSE '2024-01-01 00:00:00' END AS TIMESTAMP) AS extracted_at,
       CASE WHEN l.doc_id % x.err = 1 THEN 'any' WHEN l.doc_id % 4 = 0 THEN 'family' WHEN l.doc_id % 4 = 2 THEN 'bachelors' ELSE NULL END AS tenant_pref,
       CASE WHEN l.doc_id % x.err = 2 THEN 0 WHEN l.doc_id % 5 = 0 THEN NULL ELSE 1 END AS negotiable,
       CASE WHEN l.doc_id % x.err = 3 OR l.doc_id % 6 = 0 THEN NULL ELSE CAST(l.doc_id % 12 AS DOUBLE) END AS lock_in_months,
       CASE WHEN l.doc_id % x.err = 4 THEN '["ac"]' WHEN l.doc_id % 5 < 2 THEN '["lift", "gym"]' ELSE '[]' END AS amenities_json,
       CASE WHEN l.doc_id % x.err = 0 THEN 1 - l.quality ELSE l.quality END AS veg_only,
       CASE WHEN l.doc_id % (x.err + 2) = 0 THEN NULL ELSE 1 END AS is_owner,
       CASE WHEN l.doc_id % 17 = 0 THEN NULL ELSE CAST(l.doc_id % 101 AS DOUBLE) END AS latency_ms,
       CAST(l.doc_id % x.err AS DOUBLE) / 10000 AS cost_usd
FROM labels l CROSS JOIN (SELECT 'regex-v1' AS extractor, '1.0' AS extractor_version, 7 AS err UNION ALL SELECT 'llm', '1.0', 5
     UNION ALL SELECT 'regex-v1', '2.0', 6) x
WHERE l.doc_id % (x.err * 4) <> 1 AND (x.extractor_version = '1.0' OR l.doc_id % 3 = 0)
"""

FX_SQL["fx_observations"] = """
SELECT event_id AS obs_id, user_id AS listing_id, CAST(ts AS TIMESTAMP) AS observed_at, value AS rent_monthly,
       CAST(date_trunc('week', ts) AS DATE) AS week
FROM events
"""

FX_SQL["fx_runs"] = """
SELECT CAST(date_trunc('week', ts) AS DATE) AS run_week, event_type AS source, count(*) AS n_raw, count(DISTINCT user_id) AS n_new
FROM events GROUP BY CAST(date_trunc('week', ts) AS DATE), event_type
"""

FX_SQL["fx_points"] = """
SELECT c_custkey AS point_id, CAST(12.80 + (c_custkey % 1000) / 3000.0 AS DOUBLE) AS lat,
       CAST(77.45 + c_nationkey / 80.0 AS DOUBLE) AS lon
FROM customer
"""

_FX_TABLES = {
    "fx_listings": ("lineitem", "part"), "fx_cards": ("lineitem", "part"),
    "fx_messages": ("documents",), "fx_responses": ("documents",),
    "fx_labels": ("labels",), "fx_extractions": ("labels",),
    "fx_observations": ("events",), "fx_runs": ("events",), "fx_points": ("customer",),
}


def fx(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Return the named projection as a DataFrame over ``sf_dir``'s tables.

    The analysed plan is bound when the DataFrame is created, so re-registering
    the views for another ``sf_dir`` later does not change it.
    """
    register_views(spark, sf_dir, _FX_TABLES[name])
    return spark.sql(FX_SQL[name])


def fx_cte(*names: str) -> str:
    """``WITH`` clause defining the projections for an oracle SQL string."""
    return "WITH " + ",\n".join(f"{n} AS ({FX_SQL[n]})" for n in names) + "\n"
