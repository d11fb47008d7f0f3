"""G4 scorecard semantics: NULL equals NULL, a label without a prediction is
skipped, empty slices produce no row; D6 corrections; D9 pre-labels."""

from rentlens.operators import benchmark as bm


def test_scorecard_null_semantics(spark):
    labels = spark.createDataFrame(
        [(1, 1, None, "human"), (2, 0, 1, "silver-gemini"), (3, None, None, "silver-gemini")],
        "listing_id long, veg_only int, is_owner int, label_source string")
    ex = spark.createDataFrame(
        [(1, "regex-v1", "1.0", 1, None, 10.0, 0.0), (2, "regex-v1", "1.0", 1, 1, None, 0.0),
         (9, "regex-v1", "1.0", 1, 1, 5.0, 0.0)],
        "listing_id long, extractor string, extractor_version string, veg_only int, is_owner int, "
        "latency_ms double, cost_usd double")
    rows = {(r.eval_set, r.extractor): r for r in bm.scorecard(labels, ex).collect()}
    full = rows[(bm.EVAL_FULL, "regex-v1")]
    assert full.n_examples == 2                     # listing 3 has no prediction, 9 has no label
    assert full.acc_veg_only == 0.5 and full.acc_is_owner == 1.0 and full.acc_amenities == 1.0
    assert abs(full.macro_accuracy - (5.5 / 6)) < 1e-12
    assert full.p50_latency_ms == 5.0               # NULL latency counts as 0: median of (0, 10)
    human = rows[(bm.EVAL_HUMAN, "regex-v1")]
    assert human.n_examples == 1


def test_corrections_and_prelabel(spark):
    labels = spark.createDataFrame([(1, 0, "silver-gemini"), (2, 1, "silver-gemini"), (3, 1, "human")],
                                   "listing_id long, is_owner int, label_source string")
    fixes = spark.createDataFrame([(1, 1)], "listing_id long, is_owner int")
    drops = spark.createDataFrame([(3,)], "listing_id long")
    out = {r.listing_id: (r.is_owner, r.label_source) for r in bm.apply_corrections(labels, fixes, drops).collect()}
    assert out == {1: (1, "human"), 2: (1, "silver-gemini")}
    ex = spark.createDataFrame([(1, "llm", None), (1, "regex-v1", 0), (2, "llm", 1), (2, "regex-v1", 0)],
                               "listing_id long, extractor string, veg_only int")
    h = {r.listing_id: r.veg_only for r in bm.prelabel(ex, preferred="llm", fields=("veg_only",)).collect()}
    assert h == {1: 0, 2: 1}


def test_extraction_job(spark, tmp_path):
    """Pending listings only, all of them again with force; latency is the batch's time over its rows."""
    listings = spark.createDataFrame([(i, f"r{i}") for i in range(40)], "listing_id long, latest_raw_id string")
    raws = spark.createDataFrame([(f"r{i}", "by owner, gym" if i % 2 else "family only") for i in range(40)], "raw_id string, raw_text string")
    path = str(tmp_path / "extractions")
    run = lambda rows, **k: bm.run_extraction(rows, raws, path, **k)
    table = lambda: {r.listing_id: r for r in bm.store.read_buckets(spark, path).collect()}
    assert run(listings.where("listing_id < 25")) == 25
    first = table()
    assert len(first) == 25 and {r.latency_ms for r in first.values()} == {first[0].latency_ms} and first[0].latency_ms > 0
    assert run(listings) == 15 and run(listings) == 0
    after = table()
    assert len(after) == 40 and all(after[k].extracted_at == first[k].extracted_at for k in first)
    assert after[1].n_amenities == 1 and after[0].tenant_pref == "family" and after[1].is_owner == 1
    assert run(listings.where("listing_id = 3"), force=True) == 1
    again = table()
    assert len(again) == 40 and [k for k in again if again[k].extracted_at != after[k].extracted_at] == [3]
