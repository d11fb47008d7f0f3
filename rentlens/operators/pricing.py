"""Market-price features and the deterministic prior-based price baseline.

F3/F4 filters, leave-one-out locality priors (W1-W3), the 27-column feature
matrix (P1), the prior-times-area baseline (P10), value score and deal flag
(M6/F5), and the per-person pass for room-share posts (P7).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rentlens.functions import geo, text as tx
from rentlens.operators import stats
from rentlens.session import materialize
from rentlens.sources import dims

# FIXED VALUES: domain filter bounds, deal threshold, plausibility floor,
# category lists and feature order of the shipped model.
RENT_MIN, RENT_MAX = 3000, 500000
AREA_MIN, AREA_MAX = 100, 10000
RPS_MIN, RPS_MAX = 12, 150
DEAL_THRESHOLD = 0.15
MIN_RENT_PER_SQFT = 10.0
DEFAULT_DEPOSIT_RATIO = 6.0
FURNISHING_CATS = ["unfurnished", "semi", "full"]
SOURCE_CATS = ["nobroker", "telegram"]
PROPERTY_TYPES = ["apartment", "independent_house", "villa", "pg", "studio"]
NUMERIC_FEATURES = [
    "bhk", "area_sqft", "log_area_sqft", "lat", "lon",
    "dist_nearest_metro_km", "dist_orr_km", "dist_manyata_km", "dist_ecity_km",
    "dist_whitefield_km", "dist_orr_bellandur_km",
    "deposit_to_rent_ratio", "floor_num", "total_floors", "floor_ratio",
    "locality_median_rent_per_sqft", "locality_bhk_median_rent_per_sqft",
]
FEATURE_COLS = (NUMERIC_FEATURES + [f"furn_{c}" for c in FURNISHING_CATS]
                + [f"src_{c}" for c in SOURCE_CATS] + [f"ptype_{c}" for c in PROPERTY_TYPES])
GEO_COLS = ["lat", "lon", "dist_nearest_metro_km", "dist_orr_km", "dist_manyata_km", "dist_ecity_km",
            "dist_whitefield_km", "dist_orr_bellandur_km"]


def localities_table(spark: SparkSession) -> DataFrame:
    """The seeded localities dimension with distance features.

    First seed row wins per normalised key; distances are half-even rounded to
    3 places. Bounded by the fixed seed list, so it is safe to broadcast.
    """
    from rentlens.operators.ingest import first_per_key
    seed = dims.seed_localities_raw(spark).withColumn("locality_norm", tx.normalize_locality(F.col("display_name")))
    seed = first_per_key(seed, ["locality_norm"], [F.col("ord")])
    ns = geo.nearest_station(F.col("lat"), F.col("lon"))
    d = geo.anchor_distances(F.col("lat"), F.col("lon"))
    return seed.select(
        "locality_norm", "display_name", "lat", "lon",
        F.bround(ns["km"], 3).alias("dist_nearest_metro_km"), ns["name"].alias("nearest_metro_station"),
        F.bround(geo.nearest_orr_km(F.col("lat"), F.col("lon")), 3).alias("dist_orr_km"),
        d["dist_manyata_km"].alias("dist_manyata_km"), d["dist_ecity_km"].alias("dist_ecity_km"),
        d["dist_whitefield_km"].alias("dist_whitefield_km"),
        d["dist_orr_bellandur_km"].alias("dist_orr_bellandur_km"),
    )


def scorable(listings: DataFrame) -> DataFrame:
    """rent, area and bhk all present."""
    return listings.where(F.col("rent_monthly").isNotNull() & F.col("area_sqft").isNotNull()
                          & F.col("bhk").isNotNull())


def with_localities(listings: DataFrame, localities: DataFrame) -> DataFrame:
    """Left join on locality_norm; the dimension is a fixed small table."""
    loc = localities.select("locality_norm", *GEO_COLS)
    return listings.join(F.broadcast(loc), "locality_norm", "left")


def in_domain(df: DataFrame) -> DataFrame:
    """inclusive rent, area and rent-per-sqft bounds."""
    r, a = F.col("rent_monthly"), F.col("area_sqft")
    return df.where(r.between(RENT_MIN, RENT_MAX) & a.between(AREA_MIN, AREA_MAX)
                    & (r / a).between(RPS_MIN, RPS_MAX))


def _with_bases(df: DataFrame) -> DataFrame:
    """Rent per square foot, half-even bhk and deposit ratio: what the priors are made of."""
    return (df.withColumn("_rps", F.col("rent_monthly") / F.col("area_sqft"))
              .withColumn("_bhk_int", F.rint("bhk").cast("int"))
              .withColumn("_ratio", F.col("deposit") / F.col("rent_monthly")))


#: What ``stacked`` reads; ranking passes read it from a written table, not from the joins behind the listings.
BASES = ["locality_norm", "_bhk_int", "_rps", "_ratio"]


def stacked(d: DataFrame, *extra: str) -> DataFrame:
    """Every value that a prior needs, so that one ranking pass serves all of them.

    Rows are stacked as (grouping, locality, bhk_int, value), with the columns ``extra``:
      0 global rent/sqft, 1 per locality, 2 per (locality, bhk_int),
      3 global deposit/rent ratio.
    NULL localities join groupings 0 only; NULL ratios are skipped.
    """
    loc, bhk = F.col("locality_norm"), F.col("_bhk_int")
    nul_s, nul_i = F.lit(None).cast("string"), F.lit(None).cast("int")

    def entry(g, l, b, v):
        return F.struct(F.lit(g).alias("_g"), l.alias("_loc"), b.alias("_bhk"), v.cast("double").alias("_v"))
    entries = F.array(entry(0, nul_s, nul_i, F.col("_rps")),
                      F.when(loc.isNotNull(), entry(1, loc, nul_i, F.col("_rps"))),
                      F.when(loc.isNotNull(), entry(2, loc, bhk, F.col("_rps"))),
                      F.when(F.col("_ratio").isNotNull(), entry(3, nul_s, nul_i, F.col("_ratio"))))
    return d.select(F.explode(F.array_compact(entries)).alias("e"), *extra).select("e.*", *extra)


GROUPING = ["_g", "_loc", "_bhk"]


def _ratio_filled(ratio, median):
    """A missing deposit/rent ratio is the median one (6.0 when that is missing or zero)."""
    return F.coalesce(ratio, F.when(median.isNull() | (median == 0), F.lit(DEFAULT_DEPOSIT_RATIO)).otherwise(median))


def with_priors(df: DataFrame, with_ratio: bool = False) -> DataFrame:
    """Leave-one-out median rent/sqft by locality and by (locality,
    half-even bhk), falling back to locality prior, then the global median
    (which is not leave-one-out and includes NULL-locality rows).

    With ``with_ratio`` also fills ``deposit_to_rent_ratio`` NULLs with the
    global median ratio (6.0 when that is missing or zero).
    """
    d = _with_bases(df)
    # one row per group (written by order_stats), shared by four consumers
    st = stats.order_stats(stacked(materialize(d.select(*BASES))), GROUPING, "_v")
    glob = st.where(F.col("_g").isin(0, 3)).groupBy().agg(
        F.max(F.when(F.col("_g") == 0, stats.median_of(F.col("_a"), F.col("_b"), F.col("_n")))).alias("_gmed"),
        F.max(F.when(F.col("_g") == 3, stats.median_of(F.col("_a"), F.col("_b"), F.col("_n")))).alias("_rmed"))
    gmed = glob.select("_gmed").scalar()
    by_loc = st.where(F.col("_g") == 1).select(F.col("_loc").alias("locality_norm"), F.col("_a").alias("_la"),
                                                F.col("_b").alias("_lb"), F.col("_c").alias("_lc"),
                                                F.col("_n").alias("_ln"))
    by_lb = st.where(F.col("_g") == 2).select(F.col("_loc").alias("locality_norm"), F.col("_bhk").alias("_bhk_int"),
                                               F.col("_a").alias("_ba"), F.col("_b").alias("_bb"),
                                               F.col("_c").alias("_bc"), F.col("_n").alias("_bn"))
    j = d.join(by_loc, "locality_norm", "left").join(by_lb, ["locality_norm", "_bhk_int"], "left")
    v = F.col("_rps")
    loo_loc = stats.loo_from_stats(v, F.col("_la"), F.col("_lb"), F.col("_lc"), F.col("_ln"))
    loo_lb = stats.loo_from_stats(v, F.col("_ba"), F.col("_bb"), F.col("_bc"), F.col("_bn"))
    loc_prior = F.coalesce(loo_loc, gmed)
    out = (j.withColumn("locality_median_rent_per_sqft", loc_prior)
            .withColumn("locality_bhk_median_rent_per_sqft", F.coalesce(loo_lb, loc_prior)))
    if with_ratio:
        out = out.withColumn("deposit_to_rent_ratio", _ratio_filled(F.col("_ratio"), glob.select("_rmed").scalar()))
    return out.drop("_rps", "_bhk_int", "_ratio", "_la", "_lb", "_lc", "_ln", "_ba", "_bb", "_bc", "_bn")


def with_fold_priors(df: DataFrame, fold: str, folds: int, with_ratio: bool = False) -> DataFrame:
    """W2/W3 without leaks: a row's priors are medians over the rows outside its fold only, so neither its own rent nor
    any rent it is validated with has a part in them. All folds' medians come from one pass.

    Falls back from (locality, half-even bhk) to locality to all rows outside the fold. ``with_ratio`` fills missing
    deposit ratios in the same way. A row with a NULL fold gets no prior.
    """
    d = _with_bases(df)
    st = stats.fold_out_medians(stacked(d, fold), GROUPING, "_v", fold, folds)

    def prior(grouping: int, name: str, **keys: str) -> DataFrame:
        return st.where(F.col("_g") == grouping).select(*[F.col(c).alias(k) for k, c in keys.items()], fold, F.col("median").alias(name))

    j = (d.join(prior(0, "_all"), fold, "left").join(prior(1, "_by_loc", locality_norm="_loc"), ["locality_norm", fold], "left")
          .join(prior(2, "_by_bhk", locality_norm="_loc", _bhk_int="_bhk"), ["locality_norm", "_bhk_int", fold], "left"))
    by_loc = F.coalesce("_by_loc", "_all")
    out = (j.withColumn("locality_median_rent_per_sqft", by_loc)
            .withColumn("locality_bhk_median_rent_per_sqft", F.coalesce(F.col("_by_bhk"), by_loc)))
    if with_ratio:
        out = out.join(prior(3, "_med_ratio"), fold, "left").withColumn("deposit_to_rent_ratio", _ratio_filled(F.col("_ratio"), F.col("_med_ratio")))
    return out.drop("_rps", "_bhk_int", "_ratio", "_all", "_by_loc", "_by_bhk", "_med_ratio")


def build_features(df: DataFrame, priors=with_priors) -> DataFrame:
    """Domain filter, priors, ratios, sentinels, one-hots; adds the 27
    ordered feature columns and ``log_rent`` (the target). ``priors(frame, with_ratio=True)``
    adds the prior columns: leave-one-out ones, or for instance those of a stored model or of other folds."""
    d = in_domain(df)
    d = d.withColumn("log_area_sqft", F.log1p("area_sqft"))
    d = priors(d, with_ratio=True)
    d = (d.withColumn("floor_num", F.coalesce(F.col("floor_num").cast("double"), F.lit(-1.0)))
          .withColumn("total_floors", F.coalesce(F.col("total_floors").cast("double"), F.lit(-1.0)))
          .withColumn("floor_ratio", F.when(F.col("total_floors") > 0, F.col("floor_num") / F.col("total_floors"))
                      .otherwise(F.lit(-1.0))))
    # categories in a projection of their own: each is worked out once a row and then compared
    d = d.select("*", tx.furnishing_category(F.col("furnishing")).alias("_furn"), tx.source_bucket(F.col("source")).alias("_src"),
                 F.lower(F.coalesce(F.col("property_type"), F.lit("unknown"))).alias("_ptype"))
    onehots = ([(F.col("_furn") == c).cast("int").alias(f"furn_{c}") for c in FURNISHING_CATS]
               + [(F.col("_src") == c).cast("int").alias(f"src_{c}") for c in SOURCE_CATS]
               + [(F.col("_ptype") == c).cast("int").alias(f"ptype_{c}") for c in PROPERTY_TYPES])
    return d.select("*", *onehots, F.log("rent_monthly").alias("log_rent")).drop("_furn", "_src", "_ptype")


def score(df: DataFrame, predicted: str = "predicted_rent", actual: str = "rent_monthly") -> DataFrame:
    """Value score, plausibility and deal flag."""
    p, a = F.col(predicted), F.col(actual)
    return (df.withColumn("value_score", (p - a) / p)
              .withColumn("rent_per_sqft", a / F.col("area_sqft"))
              .withColumn("is_plausible", (F.col("rent_per_sqft") >= MIN_RENT_PER_SQFT).cast("int"))
              .withColumn("is_deal", ((F.col("value_score") >= DEAL_THRESHOLD)
                                      & (F.col("is_plausible") == 1)).cast("int")))


def baseline_predictions(listings: DataFrame, localities: DataFrame) -> DataFrame:
    """P10: predicted rent = (locality, bhk) prior x area, then M6/F5."""
    feats = build_features(with_localities(scorable(listings), localities))
    pred = feats.withColumn("predicted_rent",
                            F.col("locality_bhk_median_rent_per_sqft") * F.col("area_sqft"))
    return score(pred)


def share_deals(listings: DataFrame, localities: DataFrame, predict=None, priors=with_priors) -> DataFrame:
    """Room-share posts. Per-person rent x max(1, rint(bhk)) is priced as a
    whole flat (features recomputed on the share slice only), the prediction
    is divided back per person and compared with the asked per-person rent.
    ``predict`` maps a feature frame to one with ``predicted_rent``; default is
    the prior baseline. ``priors`` as in ``build_features``: a stored model's priors come from whole flats."""
    s = scorable(listings.where(F.col("source").startswith("telegram_share:")))
    s = (s.withColumn("bhk_int", F.greatest(F.rint("bhk"), F.lit(1.0)).cast("int"))
          .withColumn("actual_per_person", F.col("rent_monthly"))
          .withColumn("rent_monthly", F.col("rent_monthly") * F.col("bhk_int")))
    feats = build_features(with_localities(s, localities), priors)
    if predict is None:
        pred = feats.withColumn("predicted_rent", F.col("locality_bhk_median_rent_per_sqft") * F.col("area_sqft"))
    else:
        pred = predict(feats)
    pp = F.col("predicted_rent") / F.col("bhk_int")
    return (pred.withColumn("predicted_per_person", pp)
                .withColumn("value_score", (pp - F.col("actual_per_person")) / pp)
                .withColumn("is_deal", (F.col("value_score") >= DEAL_THRESHOLD).cast("int")))


def top_deals(scored: DataFrame, n: int = 10, id_col: str = "listing_id") -> DataFrame:
    """O1: top-n deals by value score (listing id breaks ties)."""
    return (scored.where(F.col("is_deal") == 1)
                  .orderBy(F.col("value_score").desc(), F.col(id_col).asc()).limit(n))


def regression_aggs(pred: str = "predicted_rent", actual: str = "rent_monthly"):
    """N, MAE, MAPE and R^2 as aggregates."""
    err = F.col(pred) - F.col(actual)
    return [F.count(F.lit(1)).alias("n"),
            F.avg(F.abs(err)).alias("mae"),
            F.avg(F.abs(err) / F.abs(F.col(actual))).alias("mape"),
            (1 - F.sum(err * err) / (F.count(F.lit(1)) * F.var_pop(actual))).alias("r2")]
