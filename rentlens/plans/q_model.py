"""Model plans that have an exact SQL form: split-conformal bounds (P9) and the
time-split validation (P8) over the residuals of the deterministic baseline.

The boosted-tree operators (``operators/model.py``) are not registered: their
full schedule of 800 rounds in five folds does not finish on one machine, and
fewer rounds would be another model. Tests cover them.
"""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from rentlens.operators import model as md, pricing as pr
from rentlens.plans.common import R6, shape
from rentlens.plans.q_pricing import FOLD_SQL, _scored_sql, baseline
from rentlens.plans.registry import query

LOW, HIGH = 0.10, 0.90


@query("conformal_bounds", _scored_sql() + f""",
res AS (SELECT locality_norm, ln(rent_monthly) - ln(predicted_rent) AS r FROM scored),
per AS (SELECT locality_norm, quantile_cont(r, {LOW}) AS lo, quantile_cont(r, {HIGH}) AS hi FROM res GROUP BY locality_norm),
overall AS (SELECT quantile_cont(r, {LOW}) AS lo, quantile_cont(r, {HIGH}) AS hi FROM res),
b AS (SELECT s.listing_id, s.rent_monthly, exp(ln(s.predicted_rent) + coalesce(p.lo, g.lo)) AS p10,
             exp(ln(s.predicted_rent) + coalesce(p.hi, g.hi)) AS p90
      FROM scored s LEFT JOIN per p ON p.locality_norm IS NOT DISTINCT FROM s.locality_norm, overall g)
SELECT listing_id, {R6('p10')} AS predicted_p10, {R6('p90')} AS predicted_p90, CAST(rent_monthly < p10 AS INTEGER) AS below_p10 FROM b
""")
def conformal_bounds(spark, sf_dir):
    scored = baseline(spark, sf_dir).withColumn("pred_log", F.log("predicted_rent")).withColumn("log_rent", F.log("rent_monthly"))
    b = md.conformal_bounds(scored, scored)
    return shape(b.select("listing_id", "predicted_p10", "predicted_p90", "below_p10"), ["predicted_p10", "predicted_p90"])


@query("cv_folds", _scored_sql() + f"SELECT listing_id, {FOLD_SQL} AS fold FROM scored")
def cv_folds(spark, sf_dir):
    return baseline(spark, sf_dir).select("listing_id", md.fold_of(F.col("listing_id")).alias("fold"))


@query("time_cv_metrics", _scored_sql() + f""",
y AS (SELECT *, rent_monthly / area_sqft AS rps, CAST(date_trunc('week', first_seen_at) AS DATE) AS span FROM scored
      WHERE first_seen_at IS NOT NULL),
f AS (SELECT span, row_number() OVER (ORDER BY span) - 1 AS fold FROM (SELECT DISTINCT span FROM y)),
t AS (SELECT span, sum(rps) AS s, count(rps) AS c FROM y GROUP BY span),
m AS (SELECT f.fold, f.span, sum(t.s) / sum(t.c) AS mean_rps FROM f JOIN t ON t.span < f.span GROUP BY f.fold, f.span),
v AS (SELECT m.fold, y.rent_monthly AS a, m.mean_rps * y.area_sqft AS p FROM m JOIN y ON y.span = m.span)
SELECT fold, count(*) AS n, {R6('avg(abs(p - a))')} AS mae, {R6('avg(abs(p - a) / a)')} AS mape FROM v GROUP BY fold
""")
def time_cv_metrics(spark, sf_dir):
    """P8 with a model that SQL can state: the mean rent per square foot of the weeks before."""
    return week_metrics(baseline(spark, sf_dir))


def week_metrics(rows):
    """fold (the week's number from 1, the first week has none), n, mae, mape. One pass: totals per week, running
    totals over the weeks, each row scored with the totals before its week. Rows without a date take no part."""
    d = rows.withColumn("week", F.trunc("first_seen_at", "week")).where("week IS NOT NULL")
    rps = F.col("rent_monthly") / F.col("area_sqft")
    weeks = d.groupBy("week").agg(F.sum(rps).alias("s"), F.count(rps).alias("c"))
    before = Window.orderBy("week").rowsBetween(Window.unboundedPreceding, -1)  # one row per week
    weeks = weeks.select(F.col("week").alias("_week"), (F.row_number().over(Window.orderBy("week")) - 1).cast("long").alias("fold"),
                         (F.sum("s").over(before) / F.sum("c").over(before)).alias("_mean")).where("fold > 0")
    scored = d.join(weeks, d["week"] == weeks["_week"]).withColumn("predicted_rent", F.col("_mean") * F.col("area_sqft"))
    return shape(scored.groupBy("fold").agg(*pr.regression_aggs()[:3]), ["mae", "mape"])
