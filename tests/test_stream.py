"""Streaming twins against batch: several files, late and repeated rows, folder tables, crash and replay."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rentlens.operators import ingest
from rentlens.streaming import ingest_stream as st

BASE = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """events as a folder of five files: January to April, late rows, a repeat after three months."""
    top = tmp_path_factory.mktemp("landed")
    days = [[(1, "a", 0), (2, "b", 3)], [(1, "a", 40), (3, "c", 41)], [(2, "b", 95), (4, "a", 1)], [(1, "a", 100), (3, "c", 2)],
            [(5, "b", 60), (5, "b", 60), (1, "b", 0)]]
    for n, rows in enumerate(days):
        (spark.createDataFrame([(u, e, BASE + dt.timedelta(days=d)) for u, e, d in rows], "user_id bigint, event_type string, ts timestamp_ntz")
         .coalesce(1).write.mode("append").parquet(str(top / "events.parquet")))
    return str(top)


def test_dedup_equals_batch(spark, events):
    got = st.stream_dedup(spark, st.file_stream(spark, events, "events"))
    want = spark.read.parquet(f"{events}/events.parquet").select("user_id", "event_type").distinct()
    rows = [tuple(r) for r in got.select("user_id", "event_type").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == {tuple(r) for r in want.collect()}


def test_weekly_counts_late_rows(spark, events):
    got = st.weekly_sightings(spark, st.file_stream(spark, events, "events"), "2024-01-03 00:00:00")
    batch = spark.read.parquet(f"{events}/events.parquet").where("ts >= timestamp '2024-01-03 00:00:00'")
    want = batch.groupBy(F.date_trunc("week", "ts").cast("timestamp").alias("w"), "user_id").count()
    assert {tuple(r) for r in got.select("week_start", "user_id", "n_sightings").collect()} == {tuple(r) for r in want.collect()}


RAW = "raw_id string, source string, content_hash string, observed_at timestamp, locality string, bhk double, rent_monthly double, area_sqft double, deposit double"


def landed(spark, top, batches):
    for rows in batches:
        (spark.createDataFrame([(f"r{i}", f"s{i % 2}", f"h{h}", BASE + dt.timedelta(hours=t), f"loc {h % 3}", 2.0, 1000.0 * (h % 5), 500.0, None)
                                for i, h, t in rows], RAW).coalesce(1).write.mode("append").parquet(f"{top}/cards.parquet"))


BATCHES = [[(i, i % 7, i) for i in range(12)], [(20 + i, i % 9, 30 + i) for i in range(12)], [(40 + i, i, 60 + i) for i in range(15)]]


def order():
    return [F.col("observed_at"), F.col("raw_id")]


def snapshot(df, *drop):
    return sorted(str(r) for r in df.drop(*drop).collect())


def test_three_batches_equal_one(spark, tmp_path):
    for name, parts in (("three", BATCHES), ("one", [sum(BATCHES, [])])):
        landed(spark, str(tmp_path / name), parts)
    state = {}
    for name in ("three", "one"):
        source = st.file_stream(spark, str(tmp_path / name), "cards")
        state[name], obs, runs = st.stream_upsert(spark, source, lambda b: b, order, base_dir=str(tmp_path / f"{name}-out"))
        assert runs.count() == (3 if name == "three" else 1)
        state[name + "_obs"] = obs
    # files arrive in their time order, so the state is the same however the run is cut
    assert snapshot(state["three"], "is_new") == snapshot(state["one"], "is_new")
    assert snapshot(state["three_obs"], "run_id") == snapshot(state["one_obs"], "run_id")


@pytest.mark.parametrize("fail_at", ["history", "observations", "runs", "state", "manifest"])
def test_crash_after_each_write_and_replay(spark, tmp_path, monkeypatch, fail_at):
    landed(spark, str(tmp_path / "in"), BATCHES[:2])
    from pyspark.sql.readwriter import DataFrameWriter
    write, crashed = DataFrameWriter.parquet, []

    def parquet(self, path, *a, **k):
        if fail_at == "manifest" and "/manifest/v=1" in path and not crashed:
            crashed.append(path)
            raise RuntimeError("crash before the manifest")
        write(self, path, *a, **k)
        if f"/{fail_at}/v=1" in path and not crashed:
            crashed.append(path)
            raise RuntimeError("crash after a write")

    def run():
        return st.stream_upsert(spark, st.file_stream(spark, str(tmp_path / "in"), "cards"), lambda b: b, order, base_dir=str(tmp_path / "out"))

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    with pytest.raises(Exception):
        run()
    assert crashed
    state, obs, runs = run()
    want, want_obs, want_runs = ingest.ingest_runs(
        spark.read.parquet(f"{tmp_path}/in/cards.parquet").withColumn("run", (F.substring("raw_id", 2, 9).cast("int") >= 20).cast("int")),
        [0, 1], "run", order())
    assert snapshot(state, "is_new") == snapshot(want.select(*state.columns), "is_new")
    assert snapshot(obs) == snapshot(want_obs.select(*obs.columns))
    assert snapshot(runs) == snapshot(want_runs.select(*runs.columns))


def test_empty_stream(spark, tmp_path):
    spark.createDataFrame([], RAW).write.parquet(str(tmp_path / "in" / "cards.parquet"))
    state, obs, runs = st.stream_upsert(spark, st.file_stream(spark, str(tmp_path / "in"), "cards").where("false"), lambda b: b, order,
                                        base_dir=str(tmp_path / "out"))
    assert state.count() == obs.count() == 0


def test_plan_of_ten_runs_does_not_grow(spark):
    raw = spark.createDataFrame([(f"r{i}", "s", f"h{i}", BASE + dt.timedelta(hours=i), f"loc {i % 3}", 2.0, 1000.0 * (i % 5), 500.0, None, i % 10)
                                 for i in range(50)], RAW + ", run int")
    state, obs, met = ingest.ingest_runs(raw, list(range(10)), "run", order())
    leaves = lambda df: df._jdf.queryExecution().analyzed().collectLeaves().size()
    assert leaves(state) == 1 and leaves(met) <= 10 * 8 and obs.count() == 50


OBS = "obs_id long, listing_id long, observed_at timestamp, rent_monthly double"


def sightings(spark, top, files):
    for rows in files:
        (spark.createDataFrame([(i, k, None if t is None else BASE + dt.timedelta(hours=t), v) for i, k, t, v in rows], OBS)
         .coalesce(1).write.mode("append").parquet(f"{top}/obs.parquet"))


#: Five files in time order: a hot listing, equal times, missing prices, listings that come back after files without them.
SERIES = [[(100 * n + i, [1, 1, 1, 2, 3, n + 4][i % 6], 40 * n + i // 2, None if i % 7 == 3 else 1000.0 + 100 * ((i * (n + 1)) % 3))
           for i in range(24)] for n in range(5)]


def test_price_series_over_five_files_equals_batch(spark, tmp_path):
    from rentlens.operators.history import price_changes
    sightings(spark, tmp_path / "in", SERIES)
    changes, late = st.stream_price_changes(spark, st.file_stream(spark, str(tmp_path / "in"), "obs"), base_dir=str(tmp_path / "out"))
    want = price_changes(spark.read.parquet(f"{tmp_path}/in/obs.parquet"))
    assert snapshot(changes) == snapshot(want.select(*changes.columns)) and want.count() > 20 and late.count() == 0
    assert spark.read.parquet(f"{tmp_path}/out/manifest").select("v").distinct().count() == 5


def test_price_series_late_rows(spark, tmp_path):
    """Rows before, at or without the time of the last published sighting are kept apart and change nothing."""
    files = [[(1, 7, 10, 100.0), (2, None, 10, 5.0)], [(3, 7, 5, 900.0), (1, 7, 10, 100.0), (4, 7, None, 1.0), (5, 7, 20, 110.0), (6, 8, 1, 3.0)],
             [(7, None, 11, 6.0), (8, 8, 2, 4.0)]]
    sightings(spark, tmp_path / "in", files)
    changes, late = st.stream_price_changes(spark, st.file_stream(spark, str(tmp_path / "in"), "obs"), base_dir=str(tmp_path / "out"))
    assert {(r.obs_id, r.prev_rent_monthly, r.rent_monthly) for r in changes.collect()} == {(5, 100.0, 110.0), (7, 5.0, 6.0), (8, 3.0, 4.0)}
    assert sorted(r.obs_id for r in late.collect()) == [1, 3, 4]


@pytest.mark.parametrize("fail_at", ["changes", "late", "state", "manifest"])
def test_price_series_crash_and_ledger(spark, tmp_path, monkeypatch, fail_at):
    """A crashed run leaves a failed ledger row; its replay gives the same series."""
    from pyspark.sql.readwriter import DataFrameWriter

    from rentlens.operators.history import price_changes
    from rentlens.operators.ledger import RunLedger
    sightings(spark, tmp_path / "in", SERIES[:3])
    ledger, write, crashed = RunLedger(spark, str(tmp_path / "ledger")), DataFrameWriter.parquet, []

    def parquet(self, path, *a, **k):
        if f"/{fail_at}/v=1" in path and not crashed:
            crashed.append(path)
            raise RuntimeError("lost")
        write(self, path, *a, **k)

    def run():
        source = st.file_stream(spark, str(tmp_path / "in"), "obs")
        return st.stream_price_changes(spark, source, base_dir=str(tmp_path / "out"), ledger=ledger)[0]

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    with pytest.raises(Exception):
        run()
    assert {(r.run_id, r.status) for r in ledger.rows().collect()} == {("prices-0", "ok"), ("prices-1", "failed")}
    changes = run()
    assert snapshot(changes) == snapshot(price_changes(spark.read.parquet(f"{tmp_path}/in/obs.parquet")).select(*changes.columns))
    assert {(r.run_id, r.attempt, r.status) for r in ledger.rows().collect()} == {("prices-0", 0, "ok"), ("prices-1", 1, "ok"), ("prices-2", 0, "ok")}
    failed = [r for r in ledger.attempts().collect() if r.status == "failed"]
    assert len(failed) == 1 and "lost" in failed[0].error and failed[0].finished_at >= failed[0].started_at


def test_ledger_of_batch_runs(spark, tmp_path, monkeypatch):
    """Counts of good runs, a failed row of a run that raises, a running row of one that never ended."""
    from rentlens.operators.ledger import RunLedger
    raw = spark.createDataFrame([(f"r{i}", "s", f"h{i % 4}", BASE + dt.timedelta(hours=i), "loc", 2.0, 1000.0, 500.0, None, i % 2)
                                 for i in range(10)], RAW + ", run int")
    ledger = RunLedger(spark, str(tmp_path / "ledger"))
    assert ledger.rows().collect() == []
    ingest.ingest_runs(raw, [0, 1], "run", order(), ledger=ledger, source="cards", git_sha="abc")
    assert {(r.run_id, r.status, r.n_scraped, r.n_raw, r.source, r.git_sha) for r in ledger.rows().collect()} == {
        ("0", "ok", 5, 2, "cards", "abc"), ("1", "ok", 5, 2, "cards", "abc")}
    with pytest.raises(Exception):
        ingest.ingest_runs(raw.drop("content_hash"), [7], "run", order(), ledger=ledger)
    ledger._write("started", {"run_id": "9", "attempt": 0, "status": "running"})
    got = {r.run_id: (r.status, r.n_raw) for r in ledger.rows().collect()}
    assert got["7"] == ("failed", None) and got["9"] == ("running", None)


def test_repeat_spans(spark):
    """Repeats beside insert-only ingest: compressed by gaps, none lost, a hot raw row over several slices."""
    rows = [(f"a{i}", "s", "hot", BASE + dt.timedelta(days=i + (30 if i >= 20 else 0)), "loc", 2.0, 1000.0, 500.0, None, int(i >= 10)) for i in range(40)]
    rows += [("b1", "s", "once", BASE, "loc 2", 1.0, 9000.0, 500.0, None, 0)]
    raw = spark.createDataFrame(rows, RAW + ", run int")
    _, obs, _, spans = ingest.ingest_runs(raw, [0, 1], "run", order(), observe_repeats=True, max_gap_days=7)
    day = lambda n: BASE + dt.timedelta(days=n)
    assert {(r.run_id, r.first_at, r.last_at, r.n) for r in spans.collect()} == {
        (0, day(1), day(9), 9), (1, day(10), day(19), 10), (1, day(50), day(69), 20)}
    assert obs.count() == 2 and spans.agg(F.sum("n")).first()[0] + obs.count() == len(rows)
