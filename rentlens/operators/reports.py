"""BI exports and dashboard feeds: export frame (J3/J11), locality rollup
(G1/J8), BI measures (G8), rent histogram (G9), locality x BHK pivot (G10),
property mix (G11), board filter / KPIs / ranked board / filter domains
(F7/G7/O2/F9), model metrics table (S7).

Medians are exact and computed with the distributed rank operator; several
median columns are stacked into (group, metric, value) rows so one ranking pass
serves all of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from rentlens.functions import text as tx
from rentlens.operators import stats
from rentlens.session import materialize

# FIXED VALUES: histogram bucket edges and labels, board defaults.
RENT_BUCKETS: list[tuple[float, str]] = [
    (15000, "< 15k"), (25000, "15-25k"), (40000, "25-40k"), (60000, "40-60k"), (100000, "60-100k"),
]
RENT_BUCKET_TOP = "100k+"
BOARD_DEFAULTS = {"localities": None, "bhk": None, "rent_range": (3000, 60000), "min_area": 400,
                  "deals_only": True}
EXPORT_GEO = ["lat", "lon", "dist_nearest_metro_km", "nearest_metro_station", "dist_orr_km", "dist_whitefield_km",
              "dist_ecity_km", "dist_manyata_km"]


def export_frame(listings: DataFrame, predictions: DataFrame, localities: DataFrame,
                 model_version: str) -> DataFrame:
    """Scorable listings left-joined to one model version's predictions
    (version filter applied before the join, as in an ON clause) and to the
    localities dimension; BI convenience columns added."""
    preds = (predictions.where(F.col("model_version") == model_version)
             .select("listing_id", "predicted_rent", "value_score", "is_deal"))
    base = listings.where(F.col("rent_monthly").isNotNull() & F.col("area_sqft").isNotNull()
                          & F.col("bhk").isNotNull())
    j = (base.join(preds, "listing_id", "left")
             .join(F.broadcast(localities.select("locality_norm", *EXPORT_GEO)), "locality_norm", "left"))
    return (j.withColumn("rent_per_sqft", F.col("rent_monthly") / F.col("area_sqft"))
             .withColumn("save_pct", F.rint(F.col("value_score") * 100 * 10) / 10)
             .withColumn("deposit_to_rent", F.rint(F.col("deposit") / F.col("rent_monthly") * 100) / 100)
             .withColumn("bhk_int", F.rint("bhk").cast("int"))
             .withColumn("floor_ratio", F.rint(F.col("floor_num") / F.col("total_floors") * 100) / 100)
             .withColumn("source_bucket", tx.source_bucket(F.col("source"))))


def medians(df: DataFrame, keys: Sequence[str], cols: dict[str, str]) -> DataFrame:
    """Exact medians of several columns per group in one ranking pass.

    ``cols`` maps output name -> input column. Groups keep NULL keys; a metric
    with no non-NULL value in a group comes back NULL. ``df`` is read twice: pass a
    written table of the columns, not the joins behind an export.
    """
    keys = list(keys)
    entries = F.array(*[F.struct(F.lit(name).alias("m"), F.col(c).cast("double").alias("v"))
                        for name, c in cols.items()])
    long = df.select(*keys, F.explode(entries).alias("e")).select(*keys, F.col("e.m").alias("_metric"),
                                                                  F.col("e.v").alias("_val"))
    q = stats.group_quantiles(long, [*keys, "_metric"], "_val", {"_med": 0.5})
    wide = q.groupBy(*keys).agg(*[F.max(F.when(F.col("_metric") == name, F.col("_med"))).alias(name)
                                  for name in cols])
    return wide


def _join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    return stats._join_on_keys(left, right, keys, how)


def locality_rollup(export: DataFrame, localities: DataFrame) -> DataFrame:
    """Per locality (NULL key kept): counts, medians, deal count; then
    the localities attributes (left merge)."""
    keys = ["locality_norm"]
    export = materialize(export.select(*keys, "rent_monthly", "rent_per_sqft", "save_pct", "is_deal"))
    counts = export.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_listings"),
        F.coalesce(F.sum("is_deal"), F.lit(0)).cast("double").alias("n_deals"))
    med = medians(export, keys, {"median_rent": "rent_monthly", "median_rent_per_sqft": "rent_per_sqft",
                                 "median_save_pct": "save_pct"})
    out = _join_null_safe(counts, med, keys)
    return out.join(localities, "locality_norm", "left")


def bi_measures(export: DataFrame) -> DataFrame:
    """Total Listings, Total Deals, Deal Rate %, Median Rent, Median Save %
    on Deals, Avg Rent per Sqft (divide-by-zero gives 0)."""
    export = materialize(export.select("rent_monthly", "rent_per_sqft", "save_pct", "is_deal"))
    base = export.agg(F.count(F.lit(1)).alias("total_listings"),
                      F.count(F.when(F.col("is_deal") == 1, 1)).alias("total_deals"),
                      F.avg("rent_per_sqft").alias("avg_rent_per_sqft")).withColumn("_k", F.lit(0))
    med = medians(export.withColumn("_k", F.lit(0))
                  .withColumn("_deal_save", F.when(F.col("is_deal") == 1, F.col("save_pct"))),
                  ["_k"], {"median_rent": "rent_monthly", "median_save_pct_deals": "_deal_save"})
    out = base.join(med, "_k", "left").drop("_k")
    rate = F.coalesce(F.try_divide(F.col("total_deals"), F.col("total_listings")), F.lit(0.0)) * 100
    return out.withColumn("deal_rate_pct", rate)


def rent_bucket_label(rent) -> F.Column:
    out = F.lit(RENT_BUCKET_TOP)
    for edge, label in reversed(RENT_BUCKETS):
        out = F.when(rent < edge, F.lit(label)).otherwise(out)
    return out


def rent_histogram(export: DataFrame) -> DataFrame:
    """Listings per fixed rent bucket."""
    return (export.groupBy(rent_bucket_label(F.col("rent_monthly")).alias("rent_bucket"))
                  .agg(F.count(F.lit(1)).alias("n_listings")))


def locality_bhk_pivot(export: DataFrame, row_key: str = "locality_norm") -> DataFrame:
    """The pivot's cells, one row per (row key, bhk) with its median rent,
    for every bhk that the data has."""
    return medians(materialize(export.select(row_key, "bhk", "rent_monthly")), [row_key, "bhk"], {"median_rent": "rent_monthly"})


def property_mix(export: DataFrame) -> DataFrame:
    """Listings per property type."""
    return export.groupBy("property_type").agg(F.count(F.lit(1)).alias("n_listings"))


def board_frame(export: DataFrame, locality_col: str = "locality_norm") -> DataFrame:
    """Board rows: scored, and not outside coverage (NULL locality drops too)."""
    return export.where(F.col("predicted_rent").isNotNull() & (F.col(locality_col) != "outside_coverage"))


def board_filter(board: DataFrame, localities=None, bhk=None, rent_range=(3000, 60000), min_area=400,
                 deals_only=True, locality_col: str = "locality_norm") -> DataFrame:
    """the board's filter panel as a predicate builder."""
    d = board
    if localities:
        d = d.where(F.col(locality_col).isin(list(localities)))
    if bhk:
        d = d.where(F.col("bhk").isin(list(bhk)))
    if rent_range is not None:
        d = d.where(F.col("rent_monthly").between(rent_range[0], rent_range[1]))
    if min_area is not None:
        d = d.where(F.col("area_sqft") >= min_area)
    if deals_only:
        d = d.where(F.col("is_deal") == 1)
    return d


def board_kpis(filtered: DataFrame) -> DataFrame:
    """Listings, median saving %, median rent of the filtered board."""
    d = materialize(filtered.select("rent_monthly", (F.col("value_score") * 100).alias("_save"))).withColumn("_k", F.lit(0))
    cnt = d.agg(F.count(F.lit(1)).alias("n_listings")).withColumn("_k", F.lit(0))  # one row, also for an empty board
    med = medians(d, ["_k"], {"median_saving_pct": "_save", "median_rent": "rent_monthly"})
    return cnt.join(med, "_k", "left").drop("_k")


def deals_board(filtered: DataFrame, locality_col: str = "locality_norm") -> DataFrame:
    """O2 + T25: ranked board rows with display formatting."""
    return (filtered.select(
        "listing_id",
        tx.title_words(F.col(locality_col)).alias("locality"),
        "bhk", "area_sqft",
        tx.rupees(F.col("rent_monthly")).alias("rent_str"),
        tx.rupees(F.col("predicted_rent")).alias("pred_str"),
        (F.rint(F.col("value_score") * 100 * 10) / 10).alias("save_pct"),
        "property_type", "furnishing", "value_score")
        .orderBy(F.col("value_score").desc(), F.col("listing_id")))


def board_domain(board: DataFrame, locality_col: str = "locality_norm") -> DataFrame:
    """filter domains: distinct localities and bhk values, rent min/max."""
    locs = board.where(F.col(locality_col).isNotNull()).select(
        F.lit("locality").alias("kind"), F.col(locality_col).alias("value_str"),
        F.lit(None).cast("double").alias("value_num")).distinct()
    bhks = board.where(F.col("bhk").isNotNull()).select(
        F.lit("bhk").alias("kind"), F.lit(None).cast("string").alias("value_str"),
        F.col("bhk").alias("value_num")).distinct()
    rng = board.agg(F.min("rent_monthly").alias("lo"), F.max("rent_monthly").alias("hi")).select(
        F.explode(F.array(F.struct(F.lit("rent_min").alias("kind"), F.lit(None).cast("string").alias("value_str"),
                                   F.col("lo").alias("value_num")),
                          F.struct(F.lit("rent_max").alias("kind"), F.lit(None).cast("string").alias("value_str"),
                                   F.col("hi").alias("value_num")))).alias("e")).select("e.*")
    return locs.unionByName(bhks).unionByName(rng)


def model_metrics_table(pooled: DataFrame, n_features: int) -> DataFrame:
    """Tidy (metric, value) rows from one row of pooled CV metrics."""
    return pooled.select(F.explode(F.array(
        F.struct(F.lit("MAPE").alias("metric"), F.coalesce(F.col("mape"), F.lit(0.0)).alias("value")),
        F.struct(F.lit("MAE (INR)").alias("metric"), F.coalesce(F.col("mae"), F.lit(0.0)).alias("value")),
        F.struct(F.lit("R^2").alias("metric"), F.coalesce(F.col("r2"), F.lit(0.0)).alias("value")),
        F.struct(F.lit("MAPE per-fold std").alias("metric"), F.coalesce(F.col("mape_std"), F.lit(0.0)).alias("value")),
        F.struct(F.lit("N training rows").alias("metric"), F.col("n").cast("double").alias("value")),
        F.struct(F.lit("N features").alias("metric"), F.lit(float(n_features)).alias("value")),
    )).alias("e")).select("e.*")


def deal_counts(scored: DataFrame) -> DataFrame:
    """Scored listings, those excluded as implausible, deals and their share,
    room-share posts and theirs (shares in %, 0 without rows)."""
    n = F.count(F.lit(1))
    deals, shares = F.count(F.when(F.col("is_deal") == 1, 1)), F.count(F.when(F.col("source").startswith("telegram_share:"), 1))
    rate = lambda part: F.coalesce(F.try_divide(part, n), F.lit(0.0)) * 100
    return scored.agg(n.alias("n_scored"), F.count(F.when(F.col("is_plausible") == 0, 1)).alias("n_suspect"), deals.alias("n_deals"),
                      rate(deals).alias("deal_rate_pct"), shares.alias("n_share_posts"), rate(shares).alias("share_rate_pct"))


def locality_feeds(rollup: DataFrame) -> DataFrame:
    """Rows of the map, bar and scatter: one per known locality, with its station as legend."""
    return rollup.where(F.col("display_name").isNotNull()).select(
        "display_name", "nearest_metro_station", "median_rent", "median_rent_per_sqft", "n_listings", "n_deals")


def station_feeds(export: DataFrame) -> DataFrame:
    """G12 by station: listings, deals and median rent per square foot of the listings nearest to it."""
    key = ["nearest_metro_station"]
    d = materialize(export.where(F.col(key[0]).isNotNull()).select(*key, "rent_per_sqft", "is_deal"))
    counts = d.groupBy(*key).agg(F.count(F.lit(1)).alias("n_listings"), F.coalesce(F.sum("is_deal"), F.lit(0)).cast("double").alias("n_deals"))
    return _join_null_safe(counts, medians(d, key, {"median_rent_per_sqft": "rent_per_sqft"}), key)


def export_tables(export: DataFrame, rollup: DataFrame, metrics: DataFrame) -> dict[str, DataFrame]:
    """K9: the four exported tables; deals are ranked by value score."""
    deals = export.where(F.col("is_deal") == 1).orderBy(F.col("value_score").desc(), "listing_id")
    return {"listings": export, "deals": deals, "localities": rollup, "model_metrics": metrics}
