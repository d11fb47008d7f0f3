"""Cases in which an earlier reading of the rules was wrong."""

import datetime as dt

from pyspark.sql import functions as F

from rentlens.functions import extract as ex, text as tx
from rentlens.operators import benchmark as bm, enrich, reports, sources_ops as so


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_lock_in_converts_like_int(spark):
    def lock(value):
        return one(spark, ex.normalize_llm_answer(F.lit('{"lock_in_months":%s}' % value))["lock_in_months"])
    assert [lock(v) for v in ("11", "11.0", "6.5", "true", '"6"', '" 6 "', '"6.5"', '"soon"', "null", "[]", "-2.9")] == [
        11, 11, 6, 1, 6, 6, None, None, None, None, -2]


def test_title_words(spark):
    assert [one(spark, tx.title_words(F.lit(s))) for s in ("1st_block", "hsr layout", "e-CITY", "", "o'neil_2b")] == [
        "1St Block", "Hsr Layout", "E-City", "", "O'Neil 2B"]


def test_strip_is_of_all_white_space(spark):
    post = "\n\t" + "2 BHK for rent in HSR, family preferred, gym, lift!!" + " \n" * 8
    df = spark.createDataFrame([(1, 0, post)], "conv_id int, turn int, text string")
    assert len(post) >= 60 and so.chat_listings(df, "conv_id", [F.col("turn").desc()], 4).count() == 0


def test_scorecard_counts_the_latest_extraction(spark):
    labels = spark.createDataFrame([(1, 1, "human")], "listing_id int, lock_in_months int, label_source string")
    rows = spark.createDataFrame([(1, "x", "1.0", 0.0, dt.datetime(2024, 1, 1), None, None), (1, "x", "2.0", 1.0, dt.datetime(2024, 2, 1), None, None)],
                                 "listing_id int, extractor string, extractor_version string, lock_in_months double, extracted_at timestamp, latency_ms double, cost_usd double")
    for r in bm.scorecard(labels, rows).collect():
        assert (r["n_examples"], r["acc_lock_in_months"], r["extractor_version"]) == (1, 1.0, "2.0")


def test_empty_answers_keep_every_hint(spark):
    hints = spark.createDataFrame([(1, "family", 1, 0, 1, 11.0, ["gym"])],
                                  "listing_id int, tenant_pref string, veg_only int, is_owner int, negotiable int, lock_in_months double, amenities array<string>")
    blank = spark.createDataFrame([(1, *[" "] * 6)], "listing_id int, " + ", ".join(f"a_{f} string" for f in bm.FIELDS))
    r = bm.parse_answers(blank, hints).first()
    assert (r["tenant_pref"], r["veg_only"], r["is_owner"], r["negotiable"], r["lock_in_months"], r["amenities_json"], r["label_source"]) == (
        "family", 1, 0, 1, 11, '["gym"]', "silver-gemini")


def test_prelabel_takes_the_preferred_rows_empty_amenities(spark):
    rows = spark.createDataFrame([(1, "llm", "1", [], None), (1, "regex-v1", "1", ["gym"], 3)],
                                 "listing_id int, extractor string, extractor_version string, amenities array<string>, lock_in_months int")
    r = bm.prelabel(rows, preferred="llm").first()
    assert r["amenities"] == [] and r["lock_in_months"] == 3


def test_corrections_can_unset_a_field(spark):
    labels = spark.createDataFrame([(1, 1, 1, "silver-gemini")], "listing_id int, veg_only int, is_owner int, label_source string")
    fixes = spark.createDataFrame([(1, None, 0, ["veg_only"])], "listing_id int, veg_only int, is_owner int, fields array<string>")
    none = labels.select("listing_id").where("false")
    r = bm.apply_corrections(labels, fixes, none).first()
    assert (r["veg_only"], r["is_owner"], r["label_source"]) == (None, 1, "human")
    assert tuple(bm.correction_counts(labels, fixes, none).first()) == (1, 0)


def test_enrichment_keeps_other_listings(spark):
    listings = spark.createDataFrame([(1, "nobroker", None), (2, "telegram:g", "x"), (3, "nobroker", "y")],
                                     "listing_id int, source string, locality_norm string")
    cards = spark.createDataFrame([(1, "2 BHK Flat for Rent In Hebbal, Bangalore", "Hebbal"), (2, "Villa in Jigani", "Jigani")],
                                  "listing_id int, raw_text string, locality_query string")
    got = {r["listing_id"]: (r["locality_norm"], r["property_type"]) for r in enrich.enrich_listings(listings, cards).collect()}
    assert got[1][0] == "hebbal" and got[2] == ("x", None) and got[3] == ("y", None)


def test_empty_board_has_a_row_of_kpis(spark):
    empty = spark.createDataFrame([], "value_score double, rent_monthly double")
    r = reports.board_kpis(empty).first()
    assert (r["n_listings"], r["median_saving_pct"], r["median_rent"]) == (0, None, None)


def test_null_foreign_keys_are_no_violations(spark):
    child = spark.createDataFrame([(1,), (None,), (9,)], "k int")
    parent = spark.createDataFrame([(1,)], "p int")
    assert so.fk_violations(child, parent, "k", "p", "r").first()["n_violations"] == 1


def test_pivot_keeps_every_bhk(spark):
    df = spark.createDataFrame([("a", 7.5, 10.0), ("a", 1.0, 20.0), ("a", 1.0, 30.0)], "locality_norm string, bhk double, rent_monthly double")
    assert {tuple(r) for r in reports.locality_bhk_pivot(df).collect()} == {("a", 7.5, 10.0), ("a", 1.0, 25.0)}


def test_extraction_rows_find_text_by_latest_raw_id(spark):
    listings = spark.createDataFrame([("l1", "r2"), ("l2", "r1"), ("l3", "r9"), ("l0", "r3")], "listing_id string, latest_raw_id string")
    raws = spark.createDataFrame([("r1", "pure veg only"), ("r2", "gym and lift"), ("r3", "no brokers")], "raw_id string, raw_text string")
    done = spark.createDataFrame([("l0", ex.REGEX_EXTRACTOR, ex.REGEX_EXTRACTOR_VERSION)], "listing_id string, extractor string, extractor_version string")
    got = {r["listing_id"]: r for r in bm.extraction_rows(listings, raws, done).collect()}
    assert set(got) == {"l1", "l2"} and got["l1"]["raw_id"] == "r2" and got["l2"]["veg_only"] == 1 and got["l1"]["extracted_at"] is not None
    assert [r["listing_id"] for r in bm.extraction_rows(listings, raws, done, limit=1).collect()] == ["l1"]
    assert bm.extraction_rows(listings, raws, done, force=True).count() == 3


def test_extraction_query_takes_every_pending_listing(spark):
    from rentlens.plans.q_extract import extraction_rows
    from rentlens.plans.q_ingest import listing_upsert
    from rentlens.sources.fixtures import fx
    sf = "/root/testdata/sf0.01"
    raws = {r["listing_id"] for r in fx(spark, sf, "fx_cards").select("listing_id").collect()}
    want = {r["listing_id"] for r in listing_upsert(spark, sf).collect() if r["latest_raw_id"] in raws}
    got = [r["listing_id"] for r in extraction_rows(spark, sf).select("listing_id").collect()]
    assert len(want) > 500 and len(got) == len(set(got)) and set(got) == want
