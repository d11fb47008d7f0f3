"""Registered plans against their DuckDB oracle at sf0.001 (fast subset; the
full set runs with ``python tests/oracle_check.py``)."""

import duckdb
import pytest

from rentlens.plans import registry
from rentlens.sources.tables import TABLES, table_path

SF = "/root/testdata/sf0.001"
FAST = ["text_normalize_hash", "content_dedup", "dedup_key_buckets", "listing_upsert", "run_metrics",
        "parse_card_fields", "parse_message_rent", "correct_locality", "regex_extract_record",
        "llm_response_normalize", "enrich_fill", "loo_locality_bhk_prior", "baseline_deals", "top_deals",
        "locality_rollup", "extractor_scorecard", "price_changes", "nearest_station", "search_frontier",
        "text_preview", "time_cv_splits", "set_catalog"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(SF, t)}')")
    return c


@pytest.mark.parametrize("name", FAST)
def test_against_oracle(spark, con, name):
    import oracle_check as oc
    registry.load_all()
    s = registry.QUERIES[name](spark, SF).toPandas()
    o = con.execute(registry.ORACLES[name]).df()
    sc, sr = oc.frame_rows(s)
    occ, orr = oc.frame_rows(o)
    assert sc == occ
    assert len(sr) == len(orr)
    assert oc.digest(sr) == oc.digest(orr)
