"""Boosted-tree rent model on MLlib: parameter sets (P2), k-fold CV
with pooled out-of-fold metrics (P3/G5), refit and persistence (P4), feature
importance (P5/O4), whole-flat scoring (P6) and split-conformal p10/p90 bounds
(P9).

Training rows are written once; MLlib trains each tree with
distributed histogram aggregation (treeAggregate), so the data never leaves
the executors. Fold ids are a hash of the listing id, not a driver-side shuffle.
"""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from rentlens.operators import pricing as pr, stats
from rentlens.session import materialize
from rentlens.sources import store

FOLDS = 5
# FIXED VALUES: learning rate, row/column subsampling and the parameter sets.
LEARNING_RATE = 0.05
SUBSAMPLE = 0.85
COLSAMPLE = "0.85"
#: Parameter sets for training sets of under 500, under 2000 and more rows; the caller chooses.
PARAMS = {"small": dict(max_iter=200, max_depth=4, min_instances=5),
          "medium": dict(max_iter=500, max_depth=6, min_instances=3),
          "large": dict(max_iter=800, max_depth=7, min_instances=2)}


def fold_of(id_col) -> F.Column:
    return (F.conv(F.substring(F.md5(id_col.cast("string")), 1, 8), 16, 10).cast("bigint") % FOLDS).cast("int")


def model_frame(features: DataFrame) -> DataFrame:
    """Feature columns as doubles; geo features without a locality match get a
    -1 sentinel (MLlib trees, unlike the reference's library, do not route
    missing values)."""
    cols = [F.coalesce(F.col(c).cast("double"), F.lit(-1.0)).alias(c) if c in pr.GEO_COLS
            else F.col(c).cast("double").alias(c) for c in pr.FEATURE_COLS]
    return features.select("listing_id", *cols, "log_rent", "rent_monthly",
                           "locality_norm", fold_of(F.col("listing_id")).alias("fold"))


def gbt(seed: int, params: dict = PARAMS["large"]) -> Pipeline:
    p = params
    est = GBTRegressor(featuresCol="features", labelCol="log_rent", predictionCol="pred_log",
                       lossType="absolute", stepSize=LEARNING_RATE, subsamplingRate=SUBSAMPLE,
                       featureSubsetStrategy=COLSAMPLE, maxDepth=p["max_depth"],
                       minInstancesPerNode=p["min_instances"], maxIter=p["max_iter"], seed=seed)
    asm = VectorAssembler(inputCols=pr.FEATURE_COLS, outputCol="features")
    return Pipeline(stages=[asm, est])


def leak_free_frame(listings: DataFrame, localities: DataFrame) -> DataFrame:
    """The model frame for cross-validation: every row's priors leave its whole fold out (``pricing.with_fold_priors``),
    so a held-out rent has no part in any feature of the rows that it is predicted with."""
    def priors(d: DataFrame, with_ratio: bool) -> DataFrame:
        return pr.with_fold_priors(d.withColumn("fold", fold_of(F.col("listing_id"))), "fold", FOLDS, with_ratio)

    return model_frame(pr.build_features(pr.with_localities(pr.scorable(listings), localities), priors))


def cross_validate(frame: DataFrame, seed: int = 42, params: dict = PARAMS["large"], parallelism: int = FOLDS) -> DataFrame:
    """Out-of-fold predictions (union of the k held-out folds), written once.

    The folds' fits run side by side, ``parallelism`` at a time, each in a scheduler pool of its own: a boosted tree
    is a long chain of small jobs, which leave most of a cluster idle one fold at a time. Fits do not depend on each
    other, so the result is the same for any parallelism.
    """
    frame = materialize(frame)
    spark = frame.sparkSession

    def fold(k: int) -> DataFrame:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fold-{k}")
        model = gbt(seed + k, params).fit(frame.where(F.col("fold") != k))
        return materialize(model.transform(frame.where(F.col("fold") == k)).drop("features"))

    with ThreadPoolExecutor(parallelism) as pool:
        held = [pool.submit(inheritable_thread_target(spark)(fold), k) for k in range(FOLDS)]
        return reduce(DataFrame.unionByName, [h.result() for h in held]).withColumn("predicted_rent", F.exp("pred_log"))


def time_validate(frame: DataFrame, week: str = "week", seed: int = 42, params: dict = PARAMS["large"],
                  predict=None) -> DataFrame:
    """Expanding windows: for each week after the first, fit on the weeks
    before it and score it. Returns the scored rows with their ``fold``.
    ``predict(train, valid)`` replaces the boosted trees (it adds ``pred_log``)."""
    weeks = [r[0] for r in frame.select(week).distinct().orderBy(week).collect()]   # one row per week
    out = None
    for k, w in enumerate(weeks[1:], 1):
        train, valid = frame.where(F.col(week) < F.lit(w)), frame.where(F.col(week) == F.lit(w))
        held = predict(train, valid) if predict else gbt(seed + k, params).fit(train).transform(valid).drop("features")
        held = materialize(held.withColumn("fold", F.lit(k)))
        out = held if out is None else out.unionByName(held)
    return out.withColumn("predicted_rent", F.exp("pred_log"))


def cv_metrics(oof: DataFrame) -> DataFrame:
    """G5 on the original scale: per fold and pooled, plus fold-MAPE std."""
    m = oof.rollup("fold").agg(*pr.regression_aggs()).withColumn("fold", F.coalesce("fold", F.lit(-1)))
    std = F.stddev_pop(F.when(F.col("fold") >= 0, F.col("mape"))).over(Window.partitionBy(F.lit(1)))
    return m.withColumn("mape_std", F.when(F.col("fold") < 0, std))


def fit_full(frame: DataFrame, seed: int = 42, params: dict = PARAMS["large"]) -> PipelineModel:
    return gbt(seed, params).fit(frame)


def importances(model: PipelineModel, spark: SparkSession, top: int | None = 8) -> DataFrame:
    """(feature, importance) sorted by importance (top-N when given)."""
    imp = model.stages[-1].featureImportances.toArray().tolist()
    rows = sorted(zip(pr.FEATURE_COLS, imp), key=lambda kv: (-kv[1], kv[0]))
    if top:
        rows = rows[:top]
    return spark.createDataFrame([(f, float(v), i + 1) for i, (f, v) in enumerate(rows)],
                                 "feature string, importance double, rank int")


def score(model: PipelineModel, frame: DataFrame) -> DataFrame:
    """Predicted rent = exp(prediction), then value score / deal flag."""
    p = model.transform(frame).drop("features").withColumn("predicted_rent", F.exp("pred_log"))
    return pr.score(p)


def conformal_bounds(oof: DataFrame, scored: DataFrame, lo: float = 0.10, hi: float = 0.90) -> DataFrame:
    """Split-conformal bounds from out-of-fold log residuals, per locality
    with a global fallback (exact quantiles); a deal is actual < p10."""
    res = materialize(oof.select("locality_norm", (F.col("log_rent") - F.col("pred_log")).alias("_r")))
    per = stats.group_quantiles(res, ["locality_norm"], "_r", {"_qlo": lo, "_qhi": hi}, median_as_mean=False)
    glob = stats.global_quantiles(res, "_r", {"_glo": lo, "_ghi": hi})
    j = stats._join_on_keys(scored, per, ["locality_norm"], "left")
    qlo = F.coalesce(F.col("_qlo"), glob.select("_glo").scalar())
    qhi = F.coalesce(F.col("_qhi"), glob.select("_ghi").scalar())
    return (j.withColumn("predicted_p10", F.exp(F.col("pred_log") + qlo))
             .withColumn("predicted_p90", F.exp(F.col("pred_log") + qhi))
             .withColumn("below_p10", (F.col("rent_monthly") < F.col("predicted_p10")).cast("int"))
             .drop("_qlo", "_qhi"))


def save(model: PipelineModel, path: str, metadata: dict, spark: SparkSession | None = None) -> None:
    """Model plus a metadata JSON (feature order, version, n, CV metrics)."""
    model.write().overwrite().save(f"{path}/model")
    spark = spark or SparkSession.getActiveSession()
    meta = {"feature_cols": list(pr.FEATURE_COLS), **metadata}
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def load(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    """A saved model and its metadata."""
    return PipelineModel.load(f"{path}/model"), json.loads(spark.read.text(f"{path}/metadata").first()[0])


def aligned(features: DataFrame, columns: list[str]) -> DataFrame:
    """The stored feature columns in their stored order; a column that the
    frame lacks, or a missing value, is 0."""
    have = set(features.columns)
    cols = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in have else F.lit(0.0).alias(c) for c in columns]
    return features.select(*[c for c in features.columns if c not in columns], *cols)


def score_stored(spark: SparkSession, path: str, features: DataFrame, out: str | None = None) -> DataFrame:
    """Score a feature frame with a stored model; with ``out``, also write
    the predictions there under the model's version (K5)."""
    model, meta = load(spark, path)
    scored = score(model, aligned(features, meta["feature_cols"]))
    if out is not None:
        store.write_predictions(scored.select("listing_id", F.lit(meta.get("version", "unversioned")).alias("model_version"),
                                              "predicted_rent", "value_score", "is_deal"), out)
    return scored


def stored_predictor(spark: SparkSession, path: str):
    """The ``predict`` hook of ``pricing.share_deals`` for a stored model."""
    model, meta = load(spark, path)
    return lambda features: (model.transform(aligned(features, meta["feature_cols"])).drop("features")
                             .withColumn("predicted_rent", F.exp("pred_log")))
