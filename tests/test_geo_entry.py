"""Golden geo rows (published locality rollup) and the driver entry contract."""

from pyspark.sql import functions as F

from rentlens.operators import pricing as pr

# Published nearest-station distances for seeded localities.
GOLDEN = {
    "banashankari": ("Banashankari", 0.0, 4.389, 15.476, 15.199, 21.64, 14.653),
    "basavanagudi": ("Jayanagar", 2.891, 3.923, 12.479, 14.284, 18.307, 11.881),
    "bellandur": ("Indiranagar", 7.429, 4.143, 14.875, 9.183, 8.973, 0.0),
    "bommanahalli": ("Jayadeva", 3.474, 2.294, 16.39, 7.172, 15.91, 7.274),
}


def test_localities_golden(spark):
    loc = {r.locality_norm: r for r in pr.localities_table(spark).collect()}
    assert len(loc) == 32
    for k, exp in GOLDEN.items():
        r = loc[k]
        got = (r.nearest_metro_station, r.dist_nearest_metro_km, r.dist_orr_km, r.dist_manyata_km,
               r.dist_ecity_km, r.dist_whitefield_km, r.dist_orr_bellandur_km)
        assert got == exp, k


def test_entry_contract(spark):
    import __spark_entry__ as e
    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 60
    df = e.entry(spark)
    rows = df.collect()
    assert len(rows) <= 10 and "value_score" in df.columns
    assert all(r.value_score >= 0.15 for r in rows)
    _ = F
