"""History plans over FX-observations / FX-runs / FX-listings / documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from rentlens.operators import history as hi, pricing as pr
from rentlens.plans.common import R6, shape
from rentlens.plans.q_pricing import listings
from rentlens.plans.registry import query
from rentlens.sources.fixtures import fx, fx_cte
from rentlens.sources.tables import read_table


@query("days_on_market", fx_cte("fx_observations") + """
SELECT listing_id, min(observed_at) AS first_seen_at, max(observed_at) AS last_seen_at, count(*) AS n_sightings,
       CAST(datediff('day', CAST(min(observed_at) AS DATE), CAST(max(observed_at) AS DATE)) AS INTEGER) AS days_on_market
FROM fx_observations GROUP BY listing_id
""")
def days_on_market(spark, sf_dir):
    return hi.days_on_market(fx(spark, sf_dir, "fx_observations"))


@query("price_changes", fx_cte("fx_observations") + f"""
SELECT obs_id, listing_id, observed_at, prev_rent_monthly, rent_monthly, {R6('rent_monthly - prev_rent_monthly')} AS delta
FROM (SELECT *, lag(rent_monthly) OVER (PARTITION BY listing_id ORDER BY observed_at, obs_id) AS prev_rent_monthly
      FROM fx_observations) t
WHERE prev_rent_monthly IS NOT NULL AND rent_monthly IS NOT NULL AND rent_monthly <> prev_rent_monthly
""")
def price_changes(spark, sf_dir):
    return shape(hi.price_changes(fx(spark, sf_dir, "fx_observations")), ["delta"])


@query("listing_month", fx_cte("fx_observations") + """
SELECT listing_id, date_trunc('month', min(observed_at)) AS listing_month FROM fx_observations GROUP BY listing_id
""")
def listing_month(spark, sf_dir):
    return hi.listing_month(fx(spark, sf_dir, "fx_observations"))


@query("time_cv_splits", fx_cte("fx_observations") + """
SELECT fold, CAST(valid_week AS VARCHAR) AS valid_week, n_train, n_valid FROM (
  SELECT week AS valid_week, n_valid, row_number() OVER (ORDER BY week) - 1 AS fold,
         CAST(coalesce(sum(n_valid) OVER (ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS n_train
  FROM (SELECT week, count(*) AS n_valid FROM fx_observations GROUP BY week) w) t
WHERE fold >= 1
""")
def time_cv_splits(spark, sf_dir):
    t = hi.time_splits(fx(spark, sf_dir, "fx_observations"))
    return t.withColumn("fold", F.col("fold").cast("bigint")).withColumn("valid_week", F.col("valid_week").cast("string"))


DRIFT_SQL = """, {p},
v AS (SELECT listing_id, locality_median_rent_per_sqft * area_sqft AS p_old,
             locality_bhk_median_rent_per_sqft * area_sqft AS p_new FROM w)
SELECT 'locality-v0' AS from_version, 'baseline-v1' AS to_version, count(*) AS n_common,
       {a} AS avg_delta, {b} AS avg_abs_delta, {c} AS avg_rel_delta FROM v
"""


def _drift_sql():
    from rentlens.plans.q_pricing import priors_sql
    return fx_cte("fx_listings") + DRIFT_SQL.format(
        p=priors_sql("fx_listings"), a=R6("avg(p_new - p_old)"), b=R6("avg(abs(p_new - p_old))"),
        c=R6("avg(abs(p_new - p_old) / p_old)"))


@query("prediction_drift", _drift_sql())
def prediction_drift(spark, sf_dir):
    """W9 between a locality-only prior model and the (locality, bhk) prior model."""
    d = pr.with_priors(pr.in_domain(pr.scorable(listings(spark, sf_dir))))
    preds = d.select("listing_id", F.explode(F.array(
        F.struct(F.lit("locality-v0").alias("model_version"),
                 (F.col("locality_median_rent_per_sqft") * F.col("area_sqft")).alias("predicted_rent")),
        F.struct(F.lit("baseline-v1").alias("model_version"),
                 (F.col("locality_bhk_median_rent_per_sqft") * F.col("area_sqft")).alias("predicted_rent")))).alias("p")
    ).select("listing_id", "p.*")
    out = hi.prediction_drift(preds, "locality-v0", "baseline-v1")
    return shape(out, ["avg_delta", "avg_abs_delta", "avg_rel_delta"])


@query("latest_runs", fx_cte("fx_runs") + """
SELECT CAST(run_week AS VARCHAR) AS run_week, source, n_raw, n_new FROM fx_runs ORDER BY fx_runs.run_week DESC, source LIMIT 10
""")
def latest_runs(spark, sf_dir):
    t = hi.latest(fx(spark, sf_dir, "fx_runs"), [F.col("run_week").desc(), F.col("source")], 10)
    return t.withColumn("run_week", F.col("run_week").cast("string"))


PREVIEW_SQL = r"""
WITH d AS (SELECT doc_id, left(coalesce(text, ''), 600) AS head FROM documents),
s AS (SELECT doc_id, head, regexp_split_to_array(head, '\r\n|[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]') AS parts FROM d),
k AS (SELECT doc_id, CASE WHEN head = '' THEN []::VARCHAR[] WHEN parts[len(parts)] = '' THEN parts[1:len(parts) - 1]
                          ELSE parts END AS lines FROM s)
SELECT doc_id, CAST(unnest(range(len(lines))) AS INTEGER) AS line_no, unnest(lines) AS line FROM k
"""


@query("text_preview", PREVIEW_SQL)
def text_preview(spark, sf_dir):
    return hi.preview_lines(read_table(spark, sf_dir, "documents"), "doc_id", "text")
