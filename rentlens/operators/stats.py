"""Exact order statistics that stay distributed when one group is huge.

No row is ranked: ``value_at_ranks`` first counts rows by group and step (1 %
of the value), which combines map-side to a few hundred rows per group, and
keeps the rows of the steps that hold a wanted rank, a hundredth of the data or
so. Those are counted by value, which splits any tie, and cut into sorted slices
by range (a step holding a third of the data spans many); the slice totals tell
which slices hold a wanted rank, and counts are added up inside those only.

  * ``group_quantiles``  exact interpolated quantiles (median, p50/p95 ...)
  * ``loo_median``       leave-one-out median per group in closed form: only
                         three order statistics per group are needed, then each
                         row compares its own value with them.
No group's values are ever collected into one buffer or sent to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from rentlens.session import materialize


def _join_on_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on possibly-NULL keys, keeping one copy of each key column."""
    if not keys:
        raise ValueError("keys required")
    r = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys],
                     *[c for c in right.columns if c not in keys])
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"__r_{k}"))
        cond = c if cond is None else cond & c
    return left.join(r, cond, how).drop(*[f"__r_{k}" for k in keys])


def _step(v: Column) -> Column:
    """A whole number that never falls where ``v`` rises: steps of 1 %, for values near 0 of about 1e-8; NaN last."""
    d = v.cast("double")
    return F.when(F.isnan(d), F.lit(2**63 - 1)).otherwise(F.floor(F.signum(d) * F.log1p(F.abs(d) * 1e6) * 92))


def value_at_ranks(df: DataFrame, keys: Sequence[str], value: str, wanted: dict[str, Column],
                   size_col: str = "_n") -> DataFrame:
    """Per group, its size and the value at each wanted rank (a Column of ``size_col``, from 1), written.

    NULL values are not counted. ``df`` is read twice (write it first if it is dear): once to count rows by group and
    step, once for the rows of the steps that hold a wanted rank. Of those, a group and value shared by any share of
    the rows is one counted row, and slices are cut from distinct values, however many lie in one step.
    """
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"), _step(F.col(value)).alias("_b"))

    def holding(seg: DataFrame) -> DataFrame:
        inside = F.lit(False)
        for w in wanted.values():
            inside = inside | ((w > F.col("_off")) & (w <= F.col("_off") + F.col("_cnt")))
        return seg.where(inside).drop("_cnt")

    def before(by: list[str], step: str):
        return Window.partitionBy(*by).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)

    # one row per group and step, however many rows there are
    steps = rows.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_cnt"))
    steps = (steps.withColumn("_off", F.coalesce(F.sum("_cnt").over(before(keys, "_b")), F.lit(0)))
             .withColumn(size_col, F.sum("_cnt").over(Window.partitionBy(*keys))))
    near = _join_on_keys(rows, materialize(holding(steps)), [*keys, "_b"])
    by = [*keys, "_b"]
    counted = near.groupBy(*by, "_v", "_off", size_col).agg(F.count(F.lit(1)).alias("_w"))
    s = materialize(counted.repartitionByRange(*[F.col(k) for k in by], "_v").withColumn("_pid", F.spark_partition_id()))
    # one row per slice, group and step
    seg = (s.groupBy("_pid", *by).agg(F.sum("_w").alias("_cnt"), F.max("_off").alias("_start"), F.max(size_col).alias(size_col))
           .withColumn("_off", F.col("_start") + F.coalesce(F.sum("_cnt").over(before(by, "_pid")), F.lit(0))).drop("_start"))
    near = _join_on_keys(s.drop("_off", size_col), holding(seg), ["_pid", *by])
    upto = F.sum("_w").over(Window.partitionBy("_pid", *by).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    near = near.withColumn("_hi", F.col("_off") + upto)
    at = lambda w: (w <= F.col("_hi")) & (w > F.col("_hi") - F.col("_w"))
    aggs = [F.max(F.when(at(w), F.col("_v"))).alias(name) for name, w in wanted.items()]
    return materialize(near.groupBy(*keys).agg(*aggs, F.max(size_col).alias(size_col)))


def fold_out_medians(df: DataFrame, keys: Sequence[str], value: str, fold: str, folds: int) -> DataFrame:
    """(keys, fold, median, n): per group and fold, the median of the group's rows that are not in the fold, and how
    many they are. A group without such rows is absent for that fold. NULL values are not counted; rows with a NULL
    fold are outside every fold.
    """
    keys = list(keys)
    key_cols = [F.col(k) for k in keys]
    ks = range(folds)
    outside = [F.count(F.when(~F.col(fold).eqNullSafe(F.lit(f)), 1)).alias(f"_w{f}") for f in ks]
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(*outside)
    s = materialize(counted.repartitionByRange(*key_cols, "_v").withColumn("_pid", F.spark_partition_id()))
    part = Window.partitionBy(*key_cols)
    before = part.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    seg = s.groupBy("_pid", *keys).agg(*[F.sum(f"_w{f}").alias(f"_c{f}") for f in ks])
    seg = seg.select("*", *[F.coalesce(F.sum(f"_c{f}").over(before), F.lit(0)).alias(f"_off{f}") for f in ks],
                     *[F.sum(f"_c{f}").over(part).alias(f"_n{f}") for f in ks])
    # the two middle ranks of what is left of the group without fold f
    middle = [(F.floor((F.col(f"_n{f}") + 1) / 2), F.floor(F.col(f"_n{f}") / 2) + 1) for f in ks]
    inside = F.lit(False)
    for f, ranks in zip(ks, middle):
        for r in ranks:
            inside = inside | ((r > F.col(f"_off{f}")) & (r <= F.col(f"_off{f}") + F.col(f"_c{f}")))
    near = _join_on_keys(s, seg.where(inside).drop(*[f"_c{f}" for f in ks]), ["_pid", *keys])
    upto = Window.partitionBy("_pid", *key_cols).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumns({f"_hi{f}": F.col(f"_off{f}") + F.sum(f"_w{f}").over(upto) for f in ks})
    aggs = []
    for f, ranks in zip(ks, middle):
        aggs.append(F.max(f"_n{f}").alias(f"_n{f}"))
        for name, r in zip("ab", ranks):
            at = (r <= F.col(f"_hi{f}")) & (r > F.col(f"_hi{f}") - F.col(f"_w{f}"))
            aggs.append(F.max(F.when(at, F.col("_v"))).alias(f"_{name}{f}"))
    wide = near.groupBy(*keys).agg(*aggs)
    per_fold = F.array(*[F.struct(F.lit(f).alias(fold), ((F.col(f"_a{f}") + F.col(f"_b{f}")) / 2).alias("median"),
                                  F.col(f"_n{f}").alias("n")) for f in ks])
    return materialize(wide.select(*keys, F.explode(per_fold).alias("_e")).select(*keys, "_e.*").where("n > 0"))


def group_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float],
                    median_as_mean: bool = True) -> DataFrame:
    """Exact quantiles per group, NULL values skipped; position (n-1)p with
    linear interpolation. Groups with no non-NULL value are absent.

    ``p = 0.5`` is returned as (a+b)/2 of the two middle values, like numpy.
    """
    keys = list(keys)
    n = F.col("_n")
    wanted: dict[str, Column] = {}
    for name, p in probs.items():
        pos = (n - 1) * F.lit(p)
        lo = F.floor(pos) + 1
        wanted[f"_{name}_lo"] = lo
        wanted[f"_{name}_hi"] = F.least(lo + 1, n)
    st = value_at_ranks(df, keys, value, wanted)
    outs = []
    for name, p in probs.items():
        lo_v, hi_v = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        if p == 0.5 and median_as_mean:
            q = F.when(F.col("_n") % 2 == 1, lo_v).otherwise((lo_v + hi_v) / 2)
        else:
            pos = (F.col("_n") - 1) * F.lit(p)
            frac = pos - F.floor(pos)
            q = lo_v + (hi_v - lo_v) * frac
        outs.append(q.alias(name))
    return st.select(*keys, *outs)


def global_quantiles(df: DataFrame, value: str, probs: dict[str, float]) -> DataFrame:
    """One-row DataFrame of exact quantiles over the whole column."""
    return group_quantiles(df.withColumn("_all", F.lit(0)), ["_all"], value, probs).drop("_all")


def loo_median(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Leave-one-out median of ``value`` within each key group.

    Rows whose key has a NULL part, whose value is NULL, or whose group has a
    single non-NULL value get NULL; NULL values are not group members.
    For group size n and h = n // 2 (1-based order statistics v[.]):
      n even: value <= v[h]  -> v[h+1]            else v[h]
      n odd : value <  v[h+1] -> (v[h+1]+v[h+2])/2
              value >  v[h+1] -> (v[h]+v[h+1])/2
              value == v[h+1] -> (v[h]+v[h+2])/2
    Tied values give the same answer whichever of them is removed.
    """
    keys = list(keys)
    valid = None
    for k in keys:
        c = F.col(k).isNotNull()
        valid = c if valid is None else valid & c
    st = order_stats(df.where(valid).select(*keys, F.col(value).alias("_v")), keys, "_v")
    j = _join_on_keys(df, st, keys, "left")
    v = F.col(value)
    res = F.when(v.isNotNull(), loo_from_stats(v, F.col("_a"), F.col("_b"), F.col("_c"), F.col("_n")))
    return j.withColumn(out, res).drop("_a", "_b", "_c", "_n")


def order_stats(long: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Per group: size ``_n`` and the order statistics ``_a, _b, _c`` at ranks
    h, h+1, h+2 (h = n // 2). Enough for the median (odd n: _b, even n:
    (_a+_b)/2) and for the leave-one-out median of any member."""
    h = F.floor(F.col("_n") / 2)
    return value_at_ranks(long, keys, value, {"_a": h, "_b": h + 1, "_c": h + 2})


def median_of(a: Column, b: Column, n: Column) -> Column:
    return F.when(n % 2 == 1, b).otherwise((a + b) / 2)


def loo_from_stats(v: Column, a: Column, b: Column, c: Column, n: Column) -> Column:
    """Leave-one-out median of member value ``v`` given its group's order stats."""
    even = F.when(v <= a, b).otherwise(a)
    odd = F.when(v < b, (b + c) / 2).when(v > b, (a + b) / 2).otherwise((a + c) / 2)
    return F.when(n.isNull() | (n <= 1), F.lit(None).cast("double")).when(n % 2 == 0, even).otherwise(odd)
