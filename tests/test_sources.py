"""S5/S6/S7 readers and K5/K6 writes, round-tripped through files."""

import json
import os
import tempfile

from rentlens.sources import jsonl, store


def _tmp():
    return tempfile.mkdtemp(prefix="rentlens-test-")


def test_label_jsonl_last_line_wins_and_tolerant_ids(spark):
    d = _tmp()
    p = os.path.join(d, "labels.jsonl")
    with open(p, "w", encoding="utf-8") as f:
        f.write(json.dumps({"listing_id": 1, "veg_only": 1, "label_source": "silver-gemini"}) + "\n\n")
        f.write("not json\n")
        f.write(json.dumps({"listing_id": 2, "veg_only": 0, "label_source": "human"}) + "\n")
        f.write(json.dumps({"listing_id": 1, "veg_only": 0, "label_source": "human"}) + "\n")
        f.write(json.dumps({"other": 5}) + "\n")
    lab = {r.listing_id: (r.veg_only, r.label_source) for r in jsonl.read_labels(spark, p).collect()
           if r.listing_id is not None}
    assert lab == {1: (0, "human"), 2: (0, "human")}
    ids = sorted(r.listing_id for r in jsonl.read_labeled_ids(spark, p).collect())
    assert ids == [1, 2]


def test_model_metrics_reader(spark):
    d = _tmp()
    p = os.path.join(d, "meta.json")
    with open(p, "w") as f:
        json.dump({"feature_cols": ["a", "b", "c"], "n_total": 10, "metrics": {"mape": 0.2, "r2": 0.5}}, f, indent=2)
    m = {r.metric: r.value for r in jsonl.read_model_metrics(spark, p).collect()}
    assert m == {"MAPE": 0.2, "MAE (INR)": 0.0, "R^2": 0.5, "MAPE per-fold std": 0.0, "N training rows": 10.0,
                 "N features": 3.0}


def test_replace_by_slice_and_key(spark):
    d = os.path.join(_tmp(), "preds")
    a = spark.createDataFrame([(1, "v1", 10.0), (2, "v2", 20.0)], "listing_id long, model_version string, p double")
    store.write_predictions(a, d)
    store.write_predictions(spark.createDataFrame([(3, "v1", 30.0)], "listing_id long, model_version string, p double"), d)
    got = sorted((r.listing_id, r.model_version) for r in spark.read.parquet(d).collect())
    assert got == [(2, "v2"), (3, "v1")]
    old = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string")
    new = spark.createDataFrame([(2, "z"), (3, "w")], "k long, v string")
    assert sorted(tuple(r) for r in store.replace_by_key(old, new, ["k"]).collect()) == [(1, "x"), (2, "z"), (3, "w")]


def test_quarantine_keeps_every_line(spark, tmp_path):
    """Kept and quarantined lines are all lines read; reasons and counts come from the pass itself."""
    lines = ['{"listing_id": 1}', "not json", '{"listing_id": "x"}', "", '{"other": 2}', '{"listing_id": 4, "veg_only": 1}', "[1, 2]", "   "]
    (tmp_path / "l.jsonl").write_text("\n".join(lines), encoding="utf-8")
    done = jsonl.sort_label_lines(spark, str(tmp_path / "l.jsonl"))
    kept, bad = done.kept.collect(), done.quarantine.collect()
    assert sorted(r.listing_id for r in kept) == [1, 4]
    assert sorted((r.value, r.reason) for r in bad) == sorted([
        ("not json", jsonl.NOT_JSON), ("[1, 2]", jsonl.NOT_JSON), ('{"listing_id": "x"}', jsonl.NO_ID), ('{"other": 2}', jsonl.NO_ID)])
    assert done.counts == {"read": 6, "kept": 2, "quarantined": 4, jsonl.NOT_JSON: 2, jsonl.NO_ID: 2}
    assert len(kept) + len(bad) == done.counts["read"] == len([x for x in lines if x.strip()])


def test_replace_touches_only_its_buckets(spark, tmp_path):
    """Rows of a key replace that key's rows; buckets without such a key keep their files; a NULL key is a key."""
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(i, f"v{i}") for i in range(200)] + [(None, "null")], "k long, v string")
    assert len(store.replace_in_buckets(rows, path, ["k"], 16)) == 16
    files = lambda: {f for b in range(16) for f in [os.path.join(path, f"bucket={b}", x) for x in os.listdir(f"{path}/bucket={b}")]
                     if f.endswith(".parquet")}
    before = files()
    touched = store.replace_in_buckets(spark.createDataFrame([(3, "new"), (None, "new null"), (900, "more")], "k long, v string"), path, ["k"], 16)
    after = files()
    assert 1 <= len(touched) <= 3
    assert {f for f in before if f in after} == {f for f in before if int(f.split("bucket=")[1].split("/")[0]) not in touched}
    got = {r.k: r.v for r in store.read_buckets(spark, path).collect()}
    assert got == {i: f"v{i}" for i in range(200)} | {3: "new", None: "new null", 900: "more"}


def test_catalog_check(spark):
    from rentlens.operators import sources_ops as so
    spark.range(1).createOrReplaceTempView("check_here")
    got = {r.table_name: (r.present, r.missing_columns) for r in
           so.catalog_check(spark, {"check_here": ["ID", "lost"], "check_nowhere": ["a"]}).collect()}
    assert got == {"check_here": (True, "lost"), "check_nowhere": (False, None)}
