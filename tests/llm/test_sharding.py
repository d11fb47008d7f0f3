"""Sharding against the definition: a permutation, exact sizes, gapless slots and the law of the matrix."""

import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from rentlens.llm import queries, sharding

from helpers import SF


def lay(rows):
    """slots by shard"""
    out = defaultdict(list)
    for r in rows:
        out[r["shard"]].append(r["slot"])
    return out


def check(rows, n, shards):
    slots = lay(rows)
    sizes = [len(slots.get(s, [])) for s in range(shards)]
    assert sum(sizes) == n and set(slots) <= set(range(shards)) and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_query(spark):
    rows = queries.op13_sharding(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    check(rows, len(docs), 24)
    want = Counter((d.doc_id, len((d.text or "").encode()) + 8, zlib.crc32((d.text or "").encode())) for d in docs)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}


def test_edge_rows(spark):
    """Null ids and texts, a group of copies, repeated rows, clashing columns."""
    data = [(None, None, 1, 2)] * 5 + [(7, "", 3, 4)] * 40 + [(i, "copy", i, i) for i in range(60)] + [(1000, "x" * 300_000, 0, 0)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, shard int, p int").repartition(9)
    out = sharding.shard(df, 7, seed=3)
    rows = out.collect()
    check(rows, len(data), 7)
    assert out.columns == ["doc_id", "text", "p", "law", "shard", "slot", "grown_shard"]
    assert Counter((r.doc_id, r.text, r.p) for r in rows) == Counter((a, b, d) for a, b, _, d in data)
    assert len({r.shard for r in rows if r.text == "copy"}) == 7  # copies spread


def test_empty_and_fewer_rows_than_shards(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert sharding.digest(sharding.shard(df, 24)).collect() == []
    check(sharding.shard(spark.createDataFrame([(1, "a"), (2, None)], "doc_id bigint, text string"), 24).collect(), 2, 24)


def test_write(spark, tmp_path):
    df = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    sharding.write_shards(df, str(tmp_path / "s"), 5, seed=9)
    check(spark.read.parquet(str(tmp_path / "s")).collect(), 500, 5)


def test_many_chunks(spark, monkeypatch):
    """A shard of several chunks has the same exact slots."""
    monkeypatch.setattr(sharding, "CHUNK_ROWS", 7)
    df = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    check(sharding.shard(df.repartition(5), 6, seed=1).collect(), 1000, 6)


@pytest.mark.parametrize("good, bad, draws", [(3, 5, 4), (10, 10, 7), (1, 400, 30), (6, 2, 7)])
def test_draw_follows_the_law(spark, good, bad, draws):
    n = 8000
    got = Counter(r.k for r in spark.range(n).select(sharding.hypergeometric(
        *[F.lit(x).cast("long") for x in (good, bad, draws)], F.lit(11), F.col("id")).alias("k")).collect())
    chi, cells = 0.0, 0
    for k in range(min(good, draws) + 1):
        if draws - k <= bad:
            p = math.comb(good, k) * math.comb(bad, draws - k) / math.comb(good + bad, draws)
            if n * p >= 5:
                chi, cells = chi + (got[k] - n * p) ** 2 / (n * p), cells + 1
    assert all(max(0, draws - bad) <= k <= min(good, draws) for k in got)
    assert chi < cells + 5 * math.sqrt(2 * cells)


def test_matrix_sums(spark):
    """Rows and columns of the matrix add up; partitions without rows and a hot one included."""
    n = {0: 5, 3: 1, 17: 300, 40: 2, 299: 60}
    total = sum(n.values())
    sizes = [total // 10 + (s < total % 10) for s in range(10)]
    m = sharding.communication_matrix(spark.createDataFrame(list(n.items()), "p bigint, n bigint"), sizes, seed=2).collect()
    assert {r.p: sum(r.caps) for r in m} == n
    assert [sum(r.caps[s] for r in m) for s in range(10)] == sizes


def test_uniform_places(spark):
    """Over seeds, a fixed row meets every shard and both halves of the slots about equally often."""
    df = spark.range(160).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")).repartition(3)
    df.write.mode("overwrite").parquet(path := f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/uniform")
    df = spark.read.parquet(path)
    hits, low = Counter(), 0
    for seed in range(3):
        for r in sharding.shard(df, 4, seed).collect():
            hits[r.doc_id % 2, r.shard] += 1
            low += (r.slot < 20) * (r.doc_id < 80)
    assert all(abs(h - 60) < 5 * math.sqrt(60 * 0.75) for h in hits.values())
    assert abs(low - 120) < 5 * math.sqrt(240 / 4)
