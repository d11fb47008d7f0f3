"""Approximate quantiles from stored, mergeable sketches (G2, G3): an option; exact quantiles stay the default.

A KLL sketch of a value is kept for every (period, group). Sketches of any span
of periods, or over all groups, are merged into one without reading the rows
again. Sketches are partially aggregated, so a hot group ships one sketch a
task. The rank error of a quantile is within ``rank_error(k)`` of the number of
values, at 99 % confidence, whatever was merged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: Sketch parameter: larger is more exact and larger.
K = 400


def rank_error(k: int = K) -> float:
    """Normalised rank error of a KLL sketch (single-sided, 99 % confidence), as published with the algorithm's
    reference implementation."""
    return 2.296 / k ** 0.9723


def period_sketches(df: DataFrame, period: Column, keys: Sequence[str], value: str, k: int = K) -> DataFrame:
    """(period, keys, n, sketch): one sketch of the non-NULL values of each period and group."""
    v = F.col(value).cast("double")
    return (df.where(v.isNotNull()).groupBy(period.alias("period"), *keys)
              .agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(v, F.lit(k)).alias("sketch")))


def quantiles(sketches: DataFrame, keys: Sequence[str], probs: dict[str, float], first=None, last=None) -> DataFrame:
    """(keys, n, one column per quantile) over the periods from ``first`` to ``last``, both included (None: open).
    Groups without a value in the span are absent."""
    s = sketches
    if first is not None:
        s = s.where(F.col("period") >= F.lit(first))
    if last is not None:
        s = s.where(F.col("period") <= F.lit(last))
    merged = s.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))
    at = [F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias(name) for name, p in probs.items()]
    return merged.where("n > 0").select(*keys, "n", *at)
