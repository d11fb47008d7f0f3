"""W7 price changes against brute force, with one listing holding a third of
all sightings (its sequence is ranked across many tasks, not one window)."""

import datetime as dt
import random

from rentlens.operators import history


def test_price_changes_hot_listing_matches_brute_force(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(2400):
        lid = "hot" if i % 3 == 0 else f"l{rnd.randint(0, 200)}"
        ts = dt.datetime(2024, 1, 1) + dt.timedelta(hours=rnd.randint(0, 400))   # ties broken by obs_id
        rent = rnd.choice([None, 20000.0, 21000.0, 22000.0])
        rows.append((i, lid, ts, rent))
    df = spark.createDataFrame(rows, "obs_id long, listing_id string, observed_at timestamp, rent_monthly double")
    got = sorted((r.obs_id, r.prev_rent_monthly, r.rent_monthly, r.delta)
                 for r in history.price_changes(df.repartition(8)).collect())
    by = {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        by.setdefault(r[1], []).append(r)
    want = []
    for seq in by.values():
        for prev, cur in zip(seq, seq[1:]):
            if prev[3] is not None and cur[3] is not None and prev[3] != cur[3]:
                want.append((cur[0], prev[3], cur[3], cur[3] - prev[3]))
    assert got == sorted(want)
    assert any(r[1] == "hot" for r in rows) and sum(r[1] == "hot" for r in rows) == 800
