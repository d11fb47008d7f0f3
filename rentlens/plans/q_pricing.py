"""W1-W3 priors, P1 feature matrix, P10 baseline deals, O1 top deals, P7 share
deals, G5/G15 regression metrics -- over FX-listings."""

from __future__ import annotations

import uuid

from pyspark.sql import Window, functions as F

from rentlens.operators import model as md, pricing as pr, priors
from rentlens.plans.common import shape
from rentlens.session import materialize, scratch_path
from rentlens.plans.registry import query
from rentlens.plans.sqlgen import localities_ctes
from rentlens.sources.fixtures import fx, fx_cte

R = 6  # decimal places kept for doubles in query results


def listings(spark, sf_dir):
    return fx(spark, sf_dir, "fx_listings")


# predictions tables written in this session, by (application, sf_dir, input signature)
_PREDICTIONS: dict = {}


def baseline(spark, sf_dir):
    """P10 scored listings -- the predictions table the reports read.

    It is written once to the shared checkpoint folder; later report queries
    in the same application read that table, as exports read a stored
    predictions table, instead of re-running the ranking passes. A change in
    the input files (count, bytes, modification time) writes a new one.
    """
    from rentlens.sources.fixtures import _FX_TABLES
    from rentlens.sources.tables import input_signature
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"),
           input_signature(spark, sf_dir, _FX_TABLES["fx_listings"]))
    table = _PREDICTIONS.get(key)
    if table is None:
        table = materialize(pr.baseline_predictions(listings(spark, sf_dir), pr.localities_table(spark)))
        _PREDICTIONS[key] = table
    return table


def rounded(df, cols, as_double=()):
    return shape(df, cols, as_double)


# --- oracle building blocks --------------------------------------------------

DOMAIN_SQL = ("rent_monthly IS NOT NULL AND area_sqft IS NOT NULL AND bhk IS NOT NULL "
              "AND rent_monthly BETWEEN 3000 AND 500000 AND area_sqft BETWEEN 100 AND 10000 "
              "AND rent_monthly / area_sqft BETWEEN 12 AND 150")
LOO = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW"


def priors_sql(src: str) -> str:
    """CTEs p (domain rows + rps, bhk_int), g (global median), w (priors)."""
    return f"""p AS (SELECT *, rent_monthly / area_sqft AS rps, CAST(round_even(bhk, 0) AS INTEGER) AS bhk_int
       FROM {src} WHERE {DOMAIN_SQL}),
g AS (SELECT median(rps) AS gmed FROM p),
w0 AS (SELECT p.*,
   CASE WHEN locality_norm IS NOT NULL THEN median(rps) OVER (PARTITION BY locality_norm {LOO}) END AS loo_loc,
   CASE WHEN locality_norm IS NOT NULL THEN median(rps) OVER (PARTITION BY locality_norm, bhk_int {LOO}) END AS loo_lb
  FROM p),
w AS (SELECT w0.*, coalesce(loo_loc, gmed) AS locality_median_rent_per_sqft,
             coalesce(loo_lb, loo_loc, gmed) AS locality_bhk_median_rent_per_sqft FROM w0, g)"""


FURN_SQL = """CASE regexp_replace(regexp_replace(lower(coalesce(furnishing, 'unknown')), '[^a-z]+', '_', 'g'), '^_+|_+$', '', 'g')
  WHEN 'semi_furnished' THEN 'semi' WHEN 'semi' THEN 'semi' WHEN 'semifurnished' THEN 'semi'
  WHEN 'fully_furnished' THEN 'full' WHEN 'furnished' THEN 'full' WHEN 'full' THEN 'full'
  WHEN 'unfurnished' THEN 'unfurnished' WHEN 'un_furnished' THEN 'unfurnished' ELSE 'unknown' END"""


def features_sql(src: str) -> str:
    """CTE chain ending in ``feat`` with every feature column (unrounded)."""
    onehots = ",\n".join(
        [f"CAST(({FURN_SQL}) = '{c}' AS INTEGER) AS furn_{c}" for c in pr.FURNISHING_CATS]
        + [f"CAST(split_part(source, ':', 1) = '{c}' AS INTEGER) AS src_{c}" for c in pr.SOURCE_CATS]
        + [f"CAST(lower(coalesce(property_type, 'unknown')) = '{c}' AS INTEGER) AS ptype_{c}"
           for c in pr.PROPERTY_TYPES])
    return f"""{localities_ctes()},
j AS (SELECT l.*, {', '.join('loc.' + c for c in pr.GEO_COLS)} FROM {src} l
      LEFT JOIN localities loc ON loc.locality_norm = l.locality_norm),
{priors_sql('j')},
r AS (SELECT median(deposit / rent_monthly) AS mr FROM w),
feat AS (SELECT w.*, ln(1 + area_sqft) AS log_area_sqft,
   coalesce(deposit / rent_monthly, CASE WHEN mr IS NULL OR mr = 0 THEN 6.0 ELSE mr END) AS deposit_to_rent_ratio,
   CAST(coalesce(floor_num, -1) AS DOUBLE) AS floor_num_f, CAST(coalesce(total_floors, -1) AS DOUBLE) AS total_floors_f,
   CASE WHEN coalesce(total_floors, -1) > 0 THEN coalesce(floor_num, -1) / total_floors ELSE -1.0 END AS floor_ratio,
   {onehots},
   ln(rent_monthly) AS log_rent
  FROM w, r)"""


def _feat_select() -> str:
    out = []
    for c in pr.FEATURE_COLS + ["log_rent"]:
        src = {"floor_num": "floor_num_f", "total_floors": "total_floors_f"}.get(c, c)
        if c.startswith(("furn_", "src_", "ptype_")):
            out.append(c)
        else:
            out.append(f"floor(({src}) * 1000000 + 0.5) / 1000000 AS {c}")
    return ", ".join(out)


@query("loo_locality_prior", fx_cte("fx_listings") + f""", {priors_sql('fx_listings')}
SELECT listing_id, locality_norm, floor((rps) * 1000000 + 0.5) / 1000000 AS rent_per_sqft,
       floor((locality_median_rent_per_sqft) * 1000000 + 0.5) / 1000000 AS locality_median_rent_per_sqft FROM w
""")
def loo_locality_prior(spark, sf_dir):
    d = pr.with_priors(pr.in_domain(pr.scorable(listings(spark, sf_dir))))
    d = d.select("listing_id", "locality_norm", (F.col("rent_monthly") / F.col("area_sqft")).alias("rent_per_sqft"),
                 "locality_median_rent_per_sqft")
    return rounded(d, ["rent_per_sqft", "locality_median_rent_per_sqft"])


@query("loo_locality_bhk_prior", fx_cte("fx_listings") + f""", {priors_sql('fx_listings')}
SELECT listing_id, locality_norm, bhk_int, floor((locality_bhk_median_rent_per_sqft) * 1000000 + 0.5) / 1000000 AS locality_bhk_median_rent_per_sqft
FROM w
""")
def loo_locality_bhk_prior(spark, sf_dir):
    d = pr.with_priors(pr.in_domain(pr.scorable(listings(spark, sf_dir))))
    d = d.select("listing_id", "locality_norm", F.rint("bhk").cast("int").alias("bhk_int"),
                 "locality_bhk_median_rent_per_sqft")
    return rounded(d, ["locality_bhk_median_rent_per_sqft"])


@query("feature_matrix", fx_cte("fx_listings") + f""", {features_sql('fx_listings')}
SELECT listing_id, {_feat_select()} FROM feat
""")
def feature_matrix(spark, sf_dir):
    # the predictions table holds the P1 feature frame it scored (build_features
    # output plus score columns); read the features from it instead of ranking again
    d = baseline(spark, sf_dir)
    cols = pr.FEATURE_COLS + ["log_rent"]
    dbl = [c for c in cols if not c.startswith(("furn_", "src_", "ptype_"))]
    return rounded(d.select("listing_id", *[F.col(c).cast("double") if c in dbl else F.col(c) for c in cols]), dbl)


def _scored_sql(src: str = "fx_listings") -> str:
    return fx_cte("fx_listings") + f""", {features_sql(src)},
pred AS (SELECT feat.*, locality_bhk_median_rent_per_sqft * area_sqft AS predicted_rent FROM feat),
scored AS (SELECT pred.*, (predicted_rent - rent_monthly) / predicted_rent AS value_score,
       rent_monthly / area_sqft AS rent_per_sqft,
       CAST(rent_monthly / area_sqft >= 10.0 AS INTEGER) AS is_plausible,
       CAST((predicted_rent - rent_monthly) / predicted_rent >= 0.15 AND rent_monthly / area_sqft >= 10.0 AS INTEGER) AS is_deal
  FROM pred)
"""


SCORED_COLS = ["listing_id", "predicted_rent", "value_score", "rent_per_sqft", "is_plausible", "is_deal"]


@query("baseline_deals", _scored_sql() + f"""
SELECT listing_id, floor((predicted_rent) * 1000000 + 0.5) / 1000000 AS predicted_rent, floor((value_score) * 1000000 + 0.5) / 1000000 AS value_score,
       floor((rent_per_sqft) * 1000000 + 0.5) / 1000000 AS rent_per_sqft, is_plausible, is_deal FROM scored
""")
def baseline_deals(spark, sf_dir):
    return rounded(baseline(spark, sf_dir).select(*SCORED_COLS), ["predicted_rent", "value_score", "rent_per_sqft"])


@query("top_deals", _scored_sql() + f"""
SELECT listing_id, locality_norm, bhk, area_sqft, rent_monthly, floor((predicted_rent) * 1000000 + 0.5) / 1000000 AS predicted_rent,
       floor((value_score) * 1000000 + 0.5) / 1000000 AS value_score
FROM scored WHERE is_deal = 1 ORDER BY (predicted_rent - rent_monthly) / predicted_rent DESC, listing_id LIMIT 10
""")
def top_deals(spark, sf_dir):
    t = pr.top_deals(baseline(spark, sf_dir), 10)
    return rounded(t.select("listing_id", "locality_norm", "bhk", "area_sqft", "rent_monthly", "predicted_rent",
                            "value_score"), ["predicted_rent", "value_score"])


SHARE_SRC = """share AS (SELECT * REPLACE (rent_monthly * bhk_int AS rent_monthly), rent_monthly AS actual_per_person
  FROM (SELECT *, CAST(greatest(round_even(bhk, 0), 1) AS INTEGER) AS bhk_int FROM fx_listings
        WHERE source LIKE 'telegram_share:%' AND rent_monthly IS NOT NULL AND area_sqft IS NOT NULL AND bhk IS NOT NULL) s)"""


@query("share_deals", fx_cte("fx_listings") + f""", {SHARE_SRC}, {features_sql('share')},
pp AS (SELECT feat.*, locality_bhk_median_rent_per_sqft * area_sqft / bhk_int AS predicted_per_person FROM feat)
SELECT listing_id, bhk_int, floor((actual_per_person) * 1000000 + 0.5) / 1000000 AS actual_per_person,
       floor((predicted_per_person) * 1000000 + 0.5) / 1000000 AS predicted_per_person,
       floor(((predicted_per_person - actual_per_person) / predicted_per_person) * 1000000 + 0.5) / 1000000 AS value_score,
       CAST((predicted_per_person - actual_per_person) / predicted_per_person >= 0.15 AS INTEGER) AS is_deal
FROM pp
""")
def share_deals(spark, sf_dir):
    d = pr.share_deals(listings(spark, sf_dir), pr.localities_table(spark))
    return rounded(d.select("listing_id", "bhk_int", "actual_per_person", "predicted_per_person", "value_score",
                            "is_deal"), ["actual_per_person", "predicted_per_person", "value_score"])


# --- G5 / G15 ----------------------------------------------------------------

FOLDS = md.FOLDS
fold_of = md.fold_of

FOLD_SQL = f"CAST(CAST(('0x' || substr(md5(listing_id), 1, 8)) AS BIGINT) % {FOLDS} AS INTEGER)"


regression_aggs = pr.regression_aggs


def regression_metrics_df(scored, pred="predicted_rent", actual="rent_monthly", id_col="listing_id"):
    """Per-fold and pooled MAE / MAPE / R^2 in one grouping-sets aggregation,
    plus the population std of fold MAPE on the pooled row."""
    d = scored.withColumn("fold", fold_of(F.col(id_col)))
    m = d.rollup("fold").agg(*regression_aggs(pred, actual)).withColumn("fold", F.coalesce("fold", F.lit(-1)))
    std = F.stddev_pop(F.when(F.col("fold") >= 0, F.col("mape"))).over(Window.partitionBy(F.lit(1)))
    return m.withColumn("mape_std", F.when(F.col("fold") < 0, std))


REG_SQL = f"""
m AS (SELECT coalesce(fold, -1) AS fold, count(*) AS n, avg(abs(predicted_rent - rent_monthly)) AS mae,
        avg(abs(predicted_rent - rent_monthly) / abs(rent_monthly)) AS mape,
        1 - sum((predicted_rent - rent_monthly) * (predicted_rent - rent_monthly)) / (count(*) * var_pop(rent_monthly)) AS r2
      FROM (SELECT *, {FOLD_SQL} AS fold FROM scored) x GROUP BY GROUPING SETS ((fold), ()))
SELECT fold, n, floor((mae) * 1000000 + 0.5) / 1000000 AS mae, floor((mape) * 1000000 + 0.5) / 1000000 AS mape, floor((r2) * 1000000 + 0.5) / 1000000 AS r2,
       floor((CASE WHEN fold < 0 THEN (SELECT stddev_pop(mape) FROM m WHERE fold >= 0) END) * 1000000 + 0.5) / 1000000 AS mape_std
FROM m
"""


@query("regression_metrics", _scored_sql() + "," + REG_SQL)
def regression_metrics(spark, sf_dir):
    m = regression_metrics_df(baseline(spark, sf_dir))
    return rounded(m.select("fold", "n", "mae", "mape", "r2", "mape_std"), ["mae", "mape", "r2", "mape_std"])


@query("metrics_by_locality", _scored_sql() + f"""
SELECT locality_norm, count(*) AS n, floor((avg(abs(predicted_rent - rent_monthly))) * 1000000 + 0.5) / 1000000 AS mae,
       floor((avg(abs(predicted_rent - rent_monthly) / abs(rent_monthly))) * 1000000 + 0.5) / 1000000 AS mape
FROM scored GROUP BY locality_norm
""")
def metrics_by_locality(spark, sf_dir):
    m = baseline(spark, sf_dir).groupBy("locality_norm").agg(*regression_aggs()[:3])
    return rounded(m, ["mae", "mape"])


# --- priors from other folds, and priors of a stored model -------------------

FOLD_PRIORS_SQL = f"""q AS (SELECT *, {FOLD_SQL} AS fold FROM p),
ks AS (SELECT DISTINCT fold AS k FROM q),
fg AS (SELECT k, median(rps) AS m FROM ks JOIN q ON fold <> k GROUP BY k),
fl AS (SELECT k, locality_norm, median(rps) AS m FROM ks JOIN q ON fold <> k WHERE locality_norm IS NOT NULL GROUP BY k, locality_norm),
fb AS (SELECT k, locality_norm, bhk_int, median(rps) AS m FROM ks JOIN q ON fold <> k WHERE locality_norm IS NOT NULL GROUP BY k, locality_norm, bhk_int),
fw AS (SELECT q.*, coalesce(fl.m, fg.m) AS by_loc, coalesce(fb.m, fl.m, fg.m) AS by_bhk
       FROM q LEFT JOIN fg ON fg.k = q.fold LEFT JOIN fl ON fl.k = q.fold AND fl.locality_norm = q.locality_norm
       LEFT JOIN fb ON fb.k = q.fold AND fb.locality_norm = q.locality_norm AND fb.bhk_int = q.bhk_int)"""


def _fold_priors(spark, sf_dir):
    d = pr.in_domain(pr.scorable(listings(spark, sf_dir))).withColumn("fold", fold_of(F.col("listing_id")))
    return pr.with_fold_priors(d, "fold", FOLDS)


@query("fold_out_priors", fx_cte("fx_listings") + f""", {priors_sql('fx_listings')}, {FOLD_PRIORS_SQL}
SELECT listing_id, fold, floor(by_loc * 1000000 + 0.5) / 1000000 AS locality_median_rent_per_sqft,
       floor(by_bhk * 1000000 + 0.5) / 1000000 AS locality_bhk_median_rent_per_sqft FROM fw
""")
def fold_out_priors(spark, sf_dir):
    """W1-W3 for cross-validation: every row's priors leave its whole fold out."""
    cols = ["locality_median_rent_per_sqft", "locality_bhk_median_rent_per_sqft"]
    return rounded(_fold_priors(spark, sf_dir).select("listing_id", "fold", *cols), cols)


@query("fold_out_metrics", fx_cte("fx_listings") + f""", {priors_sql('fx_listings')}, {FOLD_PRIORS_SQL},
scored AS (SELECT listing_id, rent_monthly, by_bhk * area_sqft AS predicted_rent FROM fw),""" + REG_SQL)
def fold_out_metrics(spark, sf_dir):
    """G5 of the baseline without leaks: each fold priced by the other folds."""
    d = _fold_priors(spark, sf_dir).withColumn("predicted_rent", F.col("locality_bhk_median_rent_per_sqft") * F.col("area_sqft"))
    m = regression_metrics_df(d.drop("fold"))
    return rounded(m.select("fold", "n", "mae", "mape", "r2", "mape_std"), ["mae", "mape", "r2", "mape_std"])


@query("share_deals_stored", fx_cte("fx_listings") + f""", {SHARE_SRC}, {features_sql('share')},
tr AS (SELECT locality_norm AS l, CAST(round_even(bhk, 0) AS INTEGER) AS b, rent_monthly / area_sqft AS v FROM fx_listings WHERE {DOMAIN_SQL}),
tg AS (SELECT median(v) AS m FROM tr), tl AS (SELECT l, median(v) AS m FROM tr WHERE l IS NOT NULL GROUP BY l),
tb AS (SELECT l, b, median(v) AS m FROM tr WHERE l IS NOT NULL GROUP BY l, b),
pp AS (SELECT feat.*, coalesce(tb.m, tl.m, tg.m) * area_sqft / bhk_int AS predicted_per_person
       FROM tg, feat LEFT JOIN tl ON tl.l = locality_norm LEFT JOIN tb ON tb.l = locality_norm AND tb.b = CAST(round_even(bhk, 0) AS INTEGER))
SELECT listing_id, bhk_int, floor((actual_per_person) * 1000000 + 0.5) / 1000000 AS actual_per_person,
       floor((predicted_per_person) * 1000000 + 0.5) / 1000000 AS predicted_per_person,
       floor(((predicted_per_person - actual_per_person) / predicted_per_person) * 1000000 + 0.5) / 1000000 AS value_score,
       CAST((predicted_per_person - actual_per_person) / predicted_per_person >= 0.15 AS INTEGER) AS is_deal
FROM pp
""")
def share_deals_stored(spark, sf_dir):
    """Priors fitted on all scorable listings, stored, read again, and used to price the room-share posts."""
    path = scratch_path(spark, f"models/locality-priors-{uuid.uuid4().hex}")
    priors.LocalityPriors().fit(listings(spark, sf_dir)).write().save(path)
    stored = priors.LocalityPriorsModel.load(path)
    d = pr.share_deals(listings(spark, sf_dir), pr.localities_table(spark), priors=stored.priors)
    return rounded(d.select("listing_id", "bhk_int", "actual_per_person", "predicted_per_person", "value_score",
                            "is_deal"), ["actual_per_person", "predicted_per_person", "value_score"])
