"""W1 / exact quantiles against brute force, including a hot group holding a
third of all rows and NULL group keys."""

import collections
import random

import numpy as np

from rentlens.operators import stats


def _rows(seed=7, n=1500):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        g = "hot" if i % 3 == 0 else rnd.choice(["a", "b", "c", None])
        rows.append((i, g, float(rnd.randint(0, 40))))
    rows += [(10001, "one", 5.0), (10002, "two", 1.0), (10003, "two", 1.0),
             (10004, "three", 2.0), (10005, "three", 2.0), (10006, "three", 9.0),
             (10007, "four", 1.0), (10008, "four", 3.0), (10009, "four", 3.0), (10010, "four", 7.0)]
    return rows


def test_loo_median_matches_brute_force(spark):
    rows = _rows() + [(20001, "a", None), (20002, "two", None)]
    df = spark.createDataFrame(rows, "id long, g string, v double")
    got = {r.id: r.loo for r in stats.loo_median(df, ["g"], "v", "loo").collect()}
    assert got[20001] is None and got[20002] is None
    groups = collections.defaultdict(list)
    for i, g, v in rows:
        if v is not None:   # NULL values are not group members
            groups[g].append((i, v))
    for g, items in groups.items():
        for i, v in items:
            if g is None or len(items) <= 1:
                assert got[i] is None
            else:
                assert got[i] == float(np.median([x for j, x in items if j != i])), (g, i)


def test_group_quantiles_match_numpy(spark):
    rows = _rows() + [(20000, "a", None)]
    df = spark.createDataFrame(rows, "id long, g string, v double")
    q = {r.g: r for r in stats.group_quantiles(df, ["g"], "v", {"p50": 0.5, "p95": 0.95},
                                               median_as_mean=False).collect()}
    groups = collections.defaultdict(list)
    for _, g, v in rows:
        if v is not None:
            groups[g].append(v)
    for g, vals in groups.items():
        assert abs(q[g].p50 - np.percentile(vals, 50)) < 1e-9
        assert abs(q[g].p95 - np.percentile(vals, 95)) < 1e-9


def test_fold_out_medians_match_brute_force(spark):
    """Every group and fold, ties, a hot group, NULL groups, values and folds, groups that lie in one fold."""
    rows = [(i, g, v, None if i % 50 == 0 else i % 3) for i, g, v in _rows()] + [(30000, "lone", 4.0, 1), (30001, "a", None, 2)]
    df = spark.createDataFrame(rows, "id long, g string, v double, fold int")
    got = {(r.g, r.fold): (r.median, r.n) for r in stats.fold_out_medians(df, ["g"], "v", "fold", 3).collect()}
    want = {}
    for g in {r[1] for r in rows}:
        for f in range(3):
            left = [v for _, h, v, k in rows if h == g and k != f and v is not None]
            if left:
                want[g, f] = (float(np.median(left)), len(left))
    assert got == want and ("lone", 1) not in got


def test_merged_sketches_keep_the_rank_bound(spark):
    """Weekly sketches of a hot group and small ones, merged over a span, against exact ranks of the span's values."""
    from pyspark.sql import functions as F

    from rentlens.operators import sketches
    rnd = random.Random(11)
    rows = [(w, "hot" if i % 3 else f"g{i % 4}", None if i % 17 == 0 else rnd.lognormvariate(9, 1)) for w in range(8) for i in range(3000)]
    df = spark.createDataFrame(rows, "week int, g string, v double")
    stored = sketches.period_sketches(df, F.col("week"), ["g"], "v", k=200)
    probs = {"p05": 0.05, "p50": 0.5, "p95": 0.95}
    for first, last in ((None, None), (2, 5), (7, 7)):
        got = {r.g: r for r in sketches.quantiles(stored, ["g"], probs, first, last).collect()}
        groups = collections.defaultdict(list)
        for w, g, v in rows:
            if v is not None and (first is None or first <= w <= last):
                groups[g].append(v)
        assert set(got) == set(groups)
        for g, values in groups.items():
            assert got[g].n == len(values)
            for name, p in probs.items():
                below, upto = sum(v < got[g][name] for v in values) / len(values), sum(v <= got[g][name] for v in values) / len(values)
                # one-sided bound at 99 %; three sigma of the same error are about 1.3 times it
                assert below - 1.5 * sketches.rank_error(200) <= p <= upto + 1.5 * sketches.rank_error(200)
    assert sketches.quantiles(stored, ["g"], probs, 100, 200).collect() == []


def test_ranks_among_extreme_values(spark):
    """Values of one step, on both sides of 0, infinite and not a number; the rows that are counted by value are a small
    share of a spread-out group."""
    inf, nan = float("inf"), float("nan")
    groups = {"tiny": [1e-9 * i for i in range(50)], "signs": [-5.0, -1e-3, -0.0, 0.0, 1e-3, 5.0], "ends": [-inf, -1.0, 2.0, inf, nan],
              "tied": [7.0] * 40 + [7.0000001], "one": [3.5]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("none", None)], "g string, v double")
    got = {r.g: r for r in stats.order_stats(df, ["g"], "v").collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        vs = sorted(vs, key=lambda v: (v != v, v))
        at = lambda k: vs[k - 1] if 1 <= k <= len(vs) else None  # noqa: E731, B023
        h, r = len(vs) // 2, got[g]
        assert r["_n"] == len(vs)
        assert all(a == b or a != a and b != b for a, b in zip((r["_a"], r["_b"], r["_c"]), (at(h), at(h + 1), at(h + 2)))), (g, r)


def test_only_rows_near_the_ranks_are_sorted(spark, monkeypatch):
    written, write = [], stats.materialize

    def spy(df):
        written.append(write(df))
        return written[-1]
    monkeypatch.setattr(stats, "materialize", spy)
    df = spark.range(20000).selectExpr("id % 2 AS g", "CAST(12 + (id * 7919 % 20000) / 150 AS double) AS v")
    assert {r.g: r.m for r in stats.group_quantiles(df, ["g"], "v", {"m": 0.5}).collect()}.keys() == {0, 1}
    assert max(t.count() for t in written) < 1000   # was every distinct value of every group


def test_seeded_localities_shuffle_no_listing(spark):
    """The localities dimension is broadcast: the joins with it do not send the listings by locality."""
    from rentlens.operators import pricing as pr
    rows = spark.range(50).selectExpr("CAST(id AS string) AS listing_id", "'hebbal' AS locality_norm")
    plan = pr.with_localities(rows, pr.localities_table(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in plan or "strategy=broadcast" in plan
