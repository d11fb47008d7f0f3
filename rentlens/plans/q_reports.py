"""BI / dashboard plans over FX-listings and the baseline predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from rentlens.operators import pricing as pr, reports as rp, sketches
from rentlens.plans.common import R6, shape
from rentlens.plans.q_pricing import REG_SQL, _scored_sql, baseline, listings, regression_metrics_df
from rentlens.plans.registry import query
from rentlens.sources.fixtures import fx, fx_cte

MODEL_VERSION = "baseline-v1"


def predictions(spark, sf_dir):
    """K5-shaped predictions table of the baseline model."""
    return baseline(spark, sf_dir).select(
        "listing_id", F.lit(MODEL_VERSION).alias("model_version"), "predicted_rent",
        F.lit(None).cast("double").alias("predicted_p10"), F.lit(None).cast("double").alias("predicted_p90"),
        "value_score", "is_deal")


def export(spark, sf_dir):
    return rp.export_frame(listings(spark, sf_dir), predictions(spark, sf_dir), pr.localities_table(spark),
                           MODEL_VERSION)


def board(spark, sf_dir):
    return rp.board_filter(rp.board_frame(export(spark, sf_dir)), **rp.BOARD_DEFAULTS)


EXPORT_SQL = _scored_sql() + f""",
preds AS (SELECT listing_id, '{MODEL_VERSION}' AS model_version, predicted_rent, value_score, is_deal FROM scored),
ex0 AS (SELECT l.*, p.predicted_rent, p.value_score, p.is_deal, loc.lat, loc.lon, loc.dist_nearest_metro_km,
               loc.nearest_metro_station
        FROM fx_listings l
        LEFT JOIN preds p ON p.listing_id = l.listing_id AND p.model_version = '{MODEL_VERSION}'
        LEFT JOIN localities loc ON loc.locality_norm = l.locality_norm
        WHERE l.rent_monthly IS NOT NULL AND l.area_sqft IS NOT NULL AND l.bhk IS NOT NULL),
ex AS (SELECT *, rent_monthly / area_sqft AS rent_per_sqft, round_even(value_score * 100 * 10, 0) / 10 AS save_pct
       FROM ex0),
brd AS (SELECT * FROM ex WHERE predicted_rent IS NOT NULL AND locality_norm <> 'outside_coverage'
          AND rent_monthly BETWEEN 3000 AND 60000 AND area_sqft >= 400 AND is_deal = 1)"""


@query("locality_rollup", EXPORT_SQL + f"""
SELECT g.locality_norm, n_listings, median_rent, median_rent_per_sqft, n_deals, median_save_pct,
       loc.display_name, loc.lat, loc.lon, loc.dist_nearest_metro_km, loc.nearest_metro_station, loc.dist_orr_km,
       loc.dist_manyata_km, loc.dist_ecity_km, loc.dist_whitefield_km, loc.dist_orr_bellandur_km
FROM (SELECT locality_norm, count(*) AS n_listings, {R6('median(rent_monthly)')} AS median_rent,
             {R6('median(rent_per_sqft)')} AS median_rent_per_sqft, CAST(coalesce(sum(is_deal), 0) AS DOUBLE) AS n_deals,
             {R6('median(save_pct)')} AS median_save_pct
      FROM ex GROUP BY locality_norm) g
LEFT JOIN localities loc ON loc.locality_norm = g.locality_norm
""")
def locality_rollup(spark, sf_dir):
    r = rp.locality_rollup(export(spark, sf_dir), pr.localities_table(spark))
    cols = ["locality_norm", "n_listings", "median_rent", "median_rent_per_sqft", "n_deals", "median_save_pct",
            "display_name", "lat", "lon", "dist_nearest_metro_km", "nearest_metro_station", "dist_orr_km",
            "dist_manyata_km", "dist_ecity_km", "dist_whitefield_km", "dist_orr_bellandur_km"]
    return shape(r.select(*cols), ["median_rent", "median_rent_per_sqft", "median_save_pct"])


@query("bi_measures", EXPORT_SQL + f"""
SELECT count(*) AS total_listings, count(*) FILTER (WHERE is_deal = 1) AS total_deals,
       {R6('avg(rent_per_sqft)')} AS avg_rent_per_sqft, {R6('median(rent_monthly)')} AS median_rent,
       {R6('median(save_pct) FILTER (WHERE is_deal = 1)')} AS median_save_pct_deals,
       {R6("coalesce(CAST(count(*) FILTER (WHERE is_deal = 1) AS DOUBLE) / nullif(count(*), 0), 0) * 100")} AS deal_rate_pct
FROM ex
""")
def bi_measures(spark, sf_dir):
    m = rp.bi_measures(export(spark, sf_dir))
    return shape(m, ["avg_rent_per_sqft", "median_rent", "median_save_pct_deals", "deal_rate_pct"])


@query("rent_histogram", EXPORT_SQL + """
SELECT CASE WHEN rent_monthly < 15000 THEN '< 15k' WHEN rent_monthly < 25000 THEN '15-25k'
            WHEN rent_monthly < 40000 THEN '25-40k' WHEN rent_monthly < 60000 THEN '40-60k'
            WHEN rent_monthly < 100000 THEN '60-100k' ELSE '100k+' END AS rent_bucket, count(*) AS n_listings
FROM ex GROUP BY 1
""")
def rent_histogram(spark, sf_dir):
    return rp.rent_histogram(export(spark, sf_dir))


@query("locality_bhk_pivot", EXPORT_SQL + f"""
SELECT locality_norm, bhk, {R6('median(rent_monthly)')} AS median_rent FROM ex GROUP BY locality_norm, bhk
""")
def locality_bhk_pivot(spark, sf_dir):
    return shape(rp.locality_bhk_pivot(export(spark, sf_dir)), ["median_rent"])


@query("property_mix", EXPORT_SQL + "SELECT property_type, count(*) AS n_listings FROM ex GROUP BY property_type")
def property_mix(spark, sf_dir):
    return rp.property_mix(export(spark, sf_dir))


@query("board_kpis", EXPORT_SQL + f"""
SELECT count(*) AS n_listings, {R6('median(value_score * 100)')} AS median_saving_pct,
       {R6('median(rent_monthly)')} AS median_rent FROM brd
""")
def board_kpis(spark, sf_dir):
    return shape(rp.board_kpis(board(spark, sf_dir)), ["median_saving_pct", "median_rent"])


TITLE_SQL = ("array_to_string(list_transform(regexp_extract_all(replace(locality_norm, '_', ' '), '(\\p{L}+|\\P{L}+)', 1), "
             "lambda w: upper(left(w, 1)) || lower(substr(w, 2))), '')")


@query("deals_board", EXPORT_SQL + f"""
SELECT listing_id, {TITLE_SQL} AS locality, bhk, area_sqft,
       '₹' || format('{{:,}}', CAST(trunc(rent_monthly) AS BIGINT)) AS rent_str,
       '₹' || format('{{:,}}', CAST(trunc(predicted_rent) AS BIGINT)) AS pred_str,
       round_even(value_score * 100 * 10, 0) / 10 AS save_pct, property_type, furnishing, {R6('value_score')} AS value_score
FROM brd
""")
def deals_board(spark, sf_dir):
    return shape(rp.deals_board(board(spark, sf_dir)), ["value_score"])


@query("board_domain", EXPORT_SQL + """,
b AS (SELECT * FROM ex WHERE predicted_rent IS NOT NULL AND locality_norm <> 'outside_coverage')
SELECT DISTINCT 'locality' AS kind, locality_norm AS value_str, CAST(NULL AS DOUBLE) AS value_num FROM b WHERE locality_norm IS NOT NULL
UNION ALL SELECT DISTINCT 'bhk', NULL, bhk FROM b WHERE bhk IS NOT NULL
UNION ALL SELECT 'rent_min', NULL, min(rent_monthly) FROM b
UNION ALL SELECT 'rent_max', NULL, max(rent_monthly) FROM b
""")
def board_domain(spark, sf_dir):
    return rp.board_domain(rp.board_frame(export(spark, sf_dir)))


@query("model_metrics", _scored_sql() + "," + REG_SQL.split("SELECT fold, n,")[0] + f"""
SELECT metric, value FROM (
  SELECT 1 AS o, 'MAPE' AS metric, {R6('coalesce(mape, 0)')} AS value FROM m WHERE fold < 0
  UNION ALL SELECT 2, 'MAE (INR)', {R6('coalesce(mae, 0)')} FROM m WHERE fold < 0
  UNION ALL SELECT 3, 'R^2', {R6('coalesce(r2, 0)')} FROM m WHERE fold < 0
  UNION ALL SELECT 4, 'MAPE per-fold std', {R6('coalesce((SELECT stddev_pop(mape) FROM m WHERE fold >= 0), 0)')}
  UNION ALL SELECT 5, 'N training rows', CAST(n AS DOUBLE) FROM m WHERE fold < 0
  UNION ALL SELECT 6, 'N features', {float(len(pr.FEATURE_COLS))!r}) t
""")
def model_metrics(spark, sf_dir):
    m = regression_metrics_df(baseline(spark, sf_dir)).where(F.col("fold") < 0)
    return shape(rp.model_metrics_table(m, len(pr.FEATURE_COLS)), ["value"])


@query("source_counts", fx_cte("fx_listings") + """
SELECT split_part(source, ':', 1) AS source_bucket, count(*) AS n_listings,
       count(*) FILTER (WHERE source LIKE 'telegram_share:%') AS n_share_posts
FROM fx_listings GROUP BY 1
""")
def source_counts(spark, sf_dir):
    """Raw counts by source prefix and the share-post count."""
    from rentlens.functions import text as tx
    d = listings(spark, sf_dir)
    return d.groupBy(tx.source_bucket(F.col("source")).alias("source_bucket")).agg(
        F.count(F.lit(1)).alias("n_listings"),
        F.count(F.when(F.col("source").startswith("telegram_share:"), 1)).alias("n_share_posts"))


@query("label_source_counts", fx_cte("fx_labels") + """
SELECT coalesce(label_source, 'unspecified') AS label_source, count(*) AS n_labels FROM fx_labels GROUP BY 1
""")
def label_source_counts(spark, sf_dir):
    """Label provenance histogram."""
    lab = fx(spark, sf_dir, "fx_labels")
    return lab.groupBy(F.coalesce("label_source", F.lit("unspecified")).alias("label_source")).agg(
        F.count(F.lit(1)).alias("n_labels"))


@query("deal_counts", _scored_sql() + f"""
SELECT count(*) AS n_scored, count(*) FILTER (WHERE is_plausible = 0) AS n_suspect, count(*) FILTER (WHERE is_deal = 1) AS n_deals,
       {R6("count(*) FILTER (WHERE is_deal = 1) / CAST(count(*) AS DOUBLE) * 100")} AS deal_rate_pct,
       count(*) FILTER (WHERE source LIKE 'telegram_share:%') AS n_share_posts,
       {R6("count(*) FILTER (WHERE source LIKE 'telegram_share:%') / CAST(count(*) AS DOUBLE) * 100")} AS share_rate_pct
FROM scored
""")
def deal_counts(spark, sf_dir):
    return shape(rp.deal_counts(baseline(spark, sf_dir)), ["deal_rate_pct", "share_rate_pct"])


@query("export_deals", EXPORT_SQL + f"""
SELECT listing_id, locality_norm, bhk, area_sqft, rent_monthly, {R6('predicted_rent')} AS predicted_rent, {R6('value_score')} AS value_score,
       save_pct, split_part(source, ':', 1) AS source_bucket FROM ex WHERE is_deal = 1 ORDER BY ex.value_score DESC, listing_id
""")
def export_deals(spark, sf_dir):
    """K9: the ranked deals table."""
    e = export(spark, sf_dir)
    deals = rp.export_tables(e, e, e)["deals"]
    return shape(deals.select("listing_id", "locality_norm", "bhk", "area_sqft", "rent_monthly", "predicted_rent", "value_score",
                              "save_pct", "source_bucket"), ["predicted_rent", "value_score"])


@query("sketch_quantiles", fx_cte("fx_listings") + """
SELECT locality_norm, count(rent_monthly) AS n, true AS p50_within, true AS p95_within FROM fx_listings
WHERE rent_monthly IS NOT NULL GROUP BY locality_norm
""")
def sketch_quantiles(spark, sf_dir):
    """G2/G3, the approximate option: weekly sketches by locality, merged over all weeks, and whether the rank of each
    quantile lies within the sketch's error bound of the exact one."""
    probs = {"p50": 0.5, "p95": 0.95}
    rows = listings(spark, sf_dir).select("locality_norm", "rent_monthly", "first_seen_at")
    week = F.date_trunc("week", "first_seen_at")
    q = sketches.quantiles(sketches.period_sketches(rows, week, ["locality_norm"], "rent_monthly"), ["locality_norm"], probs)
    q = q.select(F.col("locality_norm").alias("loc"), "n", *probs)
    j = rows.where("rent_monthly IS NOT NULL").join(q, F.col("locality_norm").eqNullSafe(F.col("loc")))
    ranks = j.groupBy("locality_norm").agg(
        F.max("n").alias("n"), *[F.avg((F.col("rent_monthly") < F.col(c)).cast("double")).alias(f"{c}_below") for c in probs],
        *[F.avg((F.col("rent_monthly") <= F.col(c)).cast("double")).alias(f"{c}_upto") for c in probs])
    bound = sketches.rank_error()
    within = [((F.col(f"{c}_below") - bound <= p) & (F.col(f"{c}_upto") + bound >= p)).alias(f"{c}_within") for c, p in probs.items()]
    return ranks.select("locality_norm", "n", *within)
