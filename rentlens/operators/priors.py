"""Rent-per-square-foot priors as a fitted, stored model.

``LocalityPriors.fit`` takes the exact medians of the training listings by
(locality, half-even bhk), by locality and over all, in one ranking pass.
``LocalityPriorsModel.transform`` adds the prior columns to any listings, seen
in training or not: finest median there is, so no listing of a scored batch is
priced by that batch. A model is written as its metadata and a Parquet table of
medians, one row per group, and works as a stage of a Pipeline.
"""

from __future__ import annotations

from pyspark.ml import Estimator, Model
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter,
                             MLReadable, MLReader, MLWritable, MLWriter)
from pyspark.sql import DataFrame, SparkSession, functions as F

from rentlens.operators import pricing as pr, stats
from rentlens.session import materialize


class LocalityPriors(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Medians over the rows of a frame with rent_monthly, area_sqft, bhk, deposit and locality_norm that lie in the
    domain of the training filter. An empty frame gives a model whose priors are NULL."""

    def _fit(self, dataset: DataFrame) -> LocalityPriorsModel:
        rows = pr.stacked(materialize(pr._with_bases(pr.in_domain(pr.scorable(dataset))).select(*pr.BASES)))
        st = stats.order_stats(rows, pr.GROUPING, "_v")
        medians = st.select(F.col("_g").alias("grouping"), F.col("_loc").alias("locality_norm"), F.col("_bhk").alias("bhk_int"),
                            stats.median_of(F.col("_a"), F.col("_b"), F.col("_n")).alias("median"), F.col("_n").alias("n"))
        return LocalityPriorsModel(materialize(medians))


class LocalityPriorsModel(Model, MLReadable, MLWritable):
    """``medians``: (grouping, locality_norm, bhk_int, median, n), grouping as in ``pricing.stacked``."""

    def __init__(self, medians: DataFrame | None = None):
        super().__init__()
        self.medians = medians

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.priors(dataset)

    def priors(self, dataset: DataFrame, with_ratio: bool = False) -> DataFrame:
        """The rows with locality_median_rent_per_sqft and locality_bhk_median_rent_per_sqft; ``with_ratio`` fills
        deposit_to_rent_ratio with the training rows' median. The hook ``priors`` of ``pricing.build_features``."""
        m = self.medians
        by_loc = m.where("grouping = 1").select("locality_norm", F.col("median").alias("_by_loc"))
        by_bhk = m.where("grouping = 2").select("locality_norm", F.col("bhk_int").alias("_bhk_int"), F.col("median").alias("_by_bhk"))
        of_all = m.agg(F.max(F.when(F.col("grouping") == 0, F.col("median"))).alias("rps"),
                       F.max(F.when(F.col("grouping") == 3, F.col("median"))).alias("ratio"))
        d = dataset.withColumn("_bhk_int", F.rint("bhk").cast("int"))
        j = d.join(by_loc, "locality_norm", "left").join(by_bhk, ["locality_norm", "_bhk_int"], "left")
        coarse = F.coalesce(F.col("_by_loc"), of_all.select("rps").scalar())
        out = (j.withColumn("locality_median_rent_per_sqft", coarse)
                .withColumn("locality_bhk_median_rent_per_sqft", F.coalesce(F.col("_by_bhk"), coarse)))
        if with_ratio:
            ratio = F.col("deposit") / F.col("rent_monthly")
            out = out.withColumn("deposit_to_rent_ratio", pr._ratio_filled(ratio, of_all.select("ratio").scalar()))
        return out.drop("_bhk_int", "_by_loc", "_by_bhk")

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, instance: LocalityPriorsModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.medians.write.parquet(f"{path}/medians")


class _Reader(MLReader):
    def __init__(self, cls: type):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> LocalityPriorsModel:
        spark = SparkSession.getActiveSession() or self.sparkSession
        metadata = DefaultParamsReader.loadMetadata(path, spark, f"{self.cls.__module__}.{self.cls.__name__}")
        model = self.cls(spark.read.parquet(f"{path}/medians"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
