"""Boosted trees with a short schedule (passed by the caller): folds, persistence, scoring by a stored model."""

import math

import pytest
from pyspark.sql import functions as F

from rentlens.operators import model as md, pricing as pr, reports, stats
from rentlens.plans import q_model, registry
from rentlens.plans.q_pricing import baseline
from rentlens.sources import store

FEW = dict(max_iter=3, max_depth=3, min_instances=2)
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def frame(spark):
    registry.load_all()
    return md.model_frame(baseline(spark, SF))


def test_folds_cover_every_row_once(frame):
    oof = md.cross_validate(frame, params=FEW)
    assert oof.count() == frame.count() == oof.select("listing_id").distinct().count()
    m = md.cv_metrics(oof)
    assert {r["fold"] for r in m.collect()} == {-1, *range(md.FOLDS)}
    assert all(r["mape"] < 2 for r in m.collect())


def test_parallel_folds_equal_folds_one_by_one(spark, frame):
    rows = lambda n: {r["listing_id"]: r["predicted_rent"] for r in md.cross_validate(frame, params=FEW, parallelism=n).collect()}
    assert rows(1) == rows(md.FOLDS)


def test_leak_free_frame_ignores_the_rows_fold(spark):
    """Changing every rent of one fold changes no prior of that fold's rows."""
    from rentlens.plans.q_pricing import listings
    base, loc = listings(spark, SF), pr.localities_table(spark)
    one = md.fold_of(F.col("listing_id")) == 1
    other = base.withColumn("rent_monthly", F.when(one, F.col("area_sqft") * 20).otherwise(F.col("rent_monthly")))
    cols = ["locality_median_rent_per_sqft", "locality_bhk_median_rent_per_sqft"]
    got = [{r["listing_id"]: (r[cols[0]], r[cols[1]]) for r in md.leak_free_frame(b, loc).where("fold = 1").collect()} for b in (base, other)]
    both = got[0].keys() & got[1].keys()
    assert len(both) > 100 and all(got[0][k] == got[1][k] for k in both)


def test_importances(spark, frame):
    model = md.fit_full(frame, params=FEW)
    rows = md.importances(model, spark, top=None).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, len(pr.FEATURE_COLS) + 1)) and {r["feature"] for r in rows} == set(pr.FEATURE_COLS)
    values = [r["importance"] for r in rows]
    assert values == sorted(values, reverse=True) and abs(sum(values) - 1) < 1e-9 and values[0] > 0
    assert [r["feature"] for r in md.importances(model, spark, top=3).orderBy("rank").collect()] == [r["feature"] for r in rows[:3]]


def test_stored_model_scores_alike(spark, frame, tmp_path):
    model = md.fit_full(frame, params=FEW)
    md.save(model, str(tmp_path / "m"), {"version": "gbt-1", "n_total": frame.count()}, spark)
    loaded, meta = md.load(spark, str(tmp_path / "m"))
    assert meta["feature_cols"] == list(pr.FEATURE_COLS) and meta["version"] == "gbt-1"
    want = {r["listing_id"]: r["predicted_rent"] for r in md.score(model, frame).collect()}
    got = md.score_stored(spark, str(tmp_path / "m"), frame, out=str(tmp_path / "predictions"))
    assert {r["listing_id"]: r["predicted_rent"] for r in got.collect()} == want
    stored = spark.read.parquet(str(tmp_path / "predictions"))
    assert stored.count() == len(want) and [r[0] for r in stored.select("model_version").distinct().collect()] == ["gbt-1"]


def test_stored_columns_decide_order_and_fill(spark, frame, tmp_path):
    part = frame.drop("src_nobroker").select(*reversed([c for c in frame.columns if c != "src_nobroker"]))
    cols = md.aligned(part, list(pr.FEATURE_COLS))
    assert [c for c in cols.columns if c in pr.FEATURE_COLS] == list(pr.FEATURE_COLS)
    assert {r[0] for r in cols.select("src_nobroker").distinct().collect()} == {0.0}


def test_share_deals_by_a_stored_model(spark, frame, tmp_path):
    from rentlens.plans.q_pricing import listings
    md.save(md.fit_full(frame, params=FEW), str(tmp_path / "m"), {}, spark)
    d = pr.share_deals(listings(spark, SF), pr.localities_table(spark), predict=md.stored_predictor(spark, str(tmp_path / "m")))
    assert d.where("predicted_per_person IS NULL OR predicted_per_person <= 0").isEmpty() and not d.isEmpty()


def test_time_validation_trains_on_the_past_only(spark):
    df = spark.createDataFrame([(w, float(w * 10 + i), 1.0) for w in (1, 2, 3) for i in range(4)], "week int, rent_monthly double, area_sqft double")

    def predict(train, valid):
        m = train.agg(F.max("rent_monthly")).first()[0]
        return valid.withColumn("pred_log", F.log(F.lit(m)))

    got = md.time_validate(df, predict=predict)
    assert {(r["week"], r["fold"], round(r["predicted_rent"])) for r in got.collect()} == {(2, 1, 13), (3, 2, 23)}


def test_ties_of_most_rows_are_one_counted_row(spark):
    """Nine tenths of 20 000 rows share one value; no slice of the counted rows holds more than its share."""
    df = spark.range(20000).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 10 == 0, F.col("id").cast("double")).otherwise(5.0).alias("v"))
    counted = df.groupBy("g", "v").count()
    sizes = [r["count"] for r in counted.repartitionByRange("g", "v").groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == counted.count() < 2100 and max(sizes) <= 3 * sum(sizes) / len(sizes)
    q = {r["g"]: (r["a"], r["b"]) for r in stats.group_quantiles(df, ["g"], "v", {"a": 0.5, "b": 0.9}).collect()}
    import numpy as np
    import pandas as pd
    pdf = df.toPandas()
    for g, part in pdf.groupby("g"):
        assert q[g] == (np.median(part["v"]), pytest.approx(np.percentile(part["v"], 90)))
    assert pd.notna(q[0][0])


def test_exports_and_benchmark_rows(spark, tmp_path):
    e = spark.createDataFrame([(1, 1, 0.5, [1, 2]), (2, 0, 0.1, None), (3, 1, 0.7, [])], "listing_id int, is_deal int, value_score double, tags array<int>")
    tables = reports.export_tables(e, e.limit(1), e.limit(0))
    store.export_csv(tables, str(tmp_path))
    back = {n: spark.read.option("header", True).csv(str(tmp_path / n)) for n in tables}
    assert [r["listing_id"] for r in back["deals"].collect()] == ["3", "1"] and back["listings"].count() == 3
    store.write_jsonl(spark.createDataFrame([(1, "₹é", None)], "id int, t string, n int"), str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).first()[0] == '{"id":1,"t":"₹é","n":null}'
    card = spark.createDataFrame([("x", "1", "s", 3, 0.5, 0.25, 0.1, 1.0, 2.0)], "extractor string, extractor_version string, eval_set string, "
                                 "n_examples int, acc_a double, macro_accuracy double, cost_per_1k_usd double, p50_latency_ms double, p95_latency_ms double")
    r = store.benchmark_rows(card, ["a"], notes="n").first()
    assert r["field_accuracies_json"] == '{"a":0.5}' and r["ran_at"] is not None and r["notes"] == "n"
    assert not math.isnan(r["macro_accuracy"]) and q_model.LOW < q_model.HIGH


def test_feeds_by_locality_and_station(spark):
    e = spark.createDataFrame([("s1", 1, 10.0), ("s1", 0, 30.0), ("s2", None, 5.0), (None, 1, 1.0)],
                              "nearest_metro_station string, is_deal int, rent_per_sqft double")
    got = {r[0]: tuple(r)[1:] for r in reports.station_feeds(e).select("nearest_metro_station", "n_listings", "n_deals", "median_rent_per_sqft").collect()}
    assert got == {"s1": (2, 1.0, 20.0), "s2": (1, 0.0, 5.0)}
    roll = spark.createDataFrame([("A", "s1", 1.0, 2.0, 3, 4.0), (None, None, 1.0, 2.0, 3, 4.0)],
                                 "display_name string, nearest_metro_station string, median_rent double, median_rent_per_sqft double, n_listings int, n_deals double")
    assert reports.locality_feeds(roll).count() == 1


def test_sightings_append_by_run(spark, tmp_path):
    for run, n in ((1, 3), (2, 2), (1, 3)):
        store.append_observations(spark.range(n).withColumn("run_id", F.lit(run)), str(tmp_path / "log"))
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "log")).groupBy("run_id").count().collect()} == {(1, 3), (2, 2)}


def test_time_cv_metrics_has_weekly_folds(spark):
    import pandas as pd
    from rentlens.plans import q_model
    from rentlens.plans.q_pricing import baseline
    got = q_model.time_cv_metrics(spark, "/root/testdata/sf0.001").toPandas().set_index("fold").sort_index()
    d = baseline(spark, "/root/testdata/sf0.001").select("first_seen_at", "rent_monthly", "area_sqft").toPandas().astype(
        {"rent_monthly": float, "area_sqft": float})
    day = pd.to_datetime(d["first_seen_at"]).dt.normalize()
    d["week"] = day - pd.to_timedelta(day.dt.weekday, unit="D")
    weeks = sorted(d["week"].dropna().unique())
    assert len(weeks) > 50 and list(got.index) == list(range(1, len(weeks)))
    for k, w in list(enumerate(weeks))[1:]:
        train, valid = d[d["week"] < w], d[d["week"] == w]
        off = (valid["area_sqft"] * (train["rent_monthly"] / train["area_sqft"]).mean() - valid["rent_monthly"]).abs()
        assert got.loc[k, "n"] == len(valid) and abs(got.loc[k, "mae"] - off.mean()) < 1e-4
        assert abs(got.loc[k, "mape"] - (off / valid["rent_monthly"]).mean()) < 1e-4


def test_stored_priors_round_trip(spark, tmp_path):
    """A fitted model, written and read, alone and in a pipeline, gives the same priors; unseen localities fall back."""
    import numpy as np
    from pyspark.ml import Pipeline, PipelineModel

    from rentlens.operators.priors import LocalityPriors, LocalityPriorsModel
    train = [(f"t{i}", ["a", "b", None][i % 3], float(1 + i % 2), 1000.0, 20000.0 + 100 * i, 50000.0) for i in range(30)]
    schema = "listing_id string, locality_norm string, bhk double, area_sqft double, rent_monthly double, deposit double"
    new = [("n1", "a", 1.0, 900.0, 1.0, None), ("n2", "a", 5.0, 900.0, 1.0, None), ("n3", "zz", 1.0, 900.0, 1.0, None), ("n4", None, 1.0, 900.0, 1.0, 3.0)]
    model = LocalityPriors().fit(spark.createDataFrame(train, schema))
    model.write().save(f"{tmp_path}/m")
    Pipeline(stages=[LocalityPriors()]).fit(spark.createDataFrame(train, schema)).write().save(f"{tmp_path}/p")
    rps = lambda keep: float(np.median([r[4] / r[3] for r in train if keep(r)]))
    want = {"n1": (rps(lambda r: r[1] == "a"), rps(lambda r: r[1] == "a" and r[2] == 1)),
            "n2": (rps(lambda r: r[1] == "a"), rps(lambda r: r[1] == "a")), "n3": (rps(lambda r: True),) * 2, "n4": (rps(lambda r: True),) * 2}
    for m in (model, LocalityPriorsModel.load(f"{tmp_path}/m"), PipelineModel.load(f"{tmp_path}/p")):
        out = {r.listing_id: (r.locality_median_rent_per_sqft, r.locality_bhk_median_rent_per_sqft)
               for r in m.transform(spark.createDataFrame(new, schema)).collect()}
        assert out == want
    filled = {r.listing_id: r.deposit_to_rent_ratio for r in model.priors(spark.createDataFrame(new, schema), with_ratio=True).collect()}
    assert filled["n4"] == 3.0 and abs(filled["n1"] - float(np.median([r[5] / r[4] for r in train]))) < 1e-12
    empty = LocalityPriors().fit(spark.createDataFrame([], schema)).transform(spark.createDataFrame(new, schema))
    assert all(r.locality_median_rent_per_sqft is None for r in empty.collect())
