"""Approximate nearest neighbours (largest inner product) by an inverted multi-index.

Vectors are cut into two halves, each quantised by its own codebook of k
centroids, which gives k * k cells. A query visits the cells in the order of
their summed centroid scores (a heap walks the two sorted centroid lists) until
the visited cells hold a given share of the index, and the entries of those
cells are reranked by the exact inner product of the original vectors.

Entries are grouped by the first half's centroid and cut into blocks of a
bounded number of rows, queries likewise, so a common vector or cell never fills
a task. Every (entry block, query block) pair gives its best entries, and the
best of all blocks are ranked. Exact scores add the products in the order of the
components, so equal vectors get equal scores in any block.
"""

from __future__ import annotations

from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from rentlens.llm.common import map_rows, materialize, ship, struct_of

#: Queries that a task walks through the cells.
WALK_ROWS = 256


def usable(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v) of the vectors that take part: neither null nor zero, without null or non-finite
    components, and of the table's commonest length (the longer one of equally common lengths)."""
    v = F.col("v")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = (embeddings.select(F.col(key).alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
            .where(v.isNotNull() & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0)))
    top = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("v") == (top["n"] if top else 0))


def codebook(sample: np.ndarray, k: int, rounds: int = 15, seed: int = 7) -> np.ndarray:
    """k-means centroids of the rows of ``sample`` (fewer if it has fewer distinct rows)."""
    rows = np.unique(sample, axis=0)
    centers = rows[np.random.default_rng(seed).permutation(len(rows))[:k]].copy()
    for _ in range(rounds):
        near = nearest(sample, centers)
        sums, n = np.zeros_like(centers), np.bincount(near, minlength=len(centers))
        np.add.at(sums, near, sample)
        centers[n > 0] = sums[n > 0] / n[n > 0, None]
    return centers


def nearest(rows: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.argmax(rows @ centers.T - 0.5 * (centers * centers).sum(1), axis=1)


def best_first(first: np.ndarray, second: np.ndarray, counts: np.ndarray, enough: int) -> list[tuple[int, int]]:
    """Cells in descending order of first[i] + second[j] until they hold ``enough`` entries."""
    a, b = np.argsort(-first, kind="stable").tolist(), np.argsort(-second, kind="stable").tolist()
    fa, sb, n = first[a].tolist(), second[b].tolist(), counts.tolist()
    heap, out, held = [(-(fa[0] + sb[0]), 0, 0)], [], 0
    while heap and held < enough:
        _, i, j = heappop(heap)
        if n[a[i]][b[j]]:
            out.append((a[i], b[j]))
            held += n[a[i]][b[j]]
        if j + 1 < len(b):
            heappush(heap, (-(fa[i] + sb[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(a):
            heappush(heap, (-(fa[i + 1] + sb[0]), i + 1, 0))
    return out


def ordered_dot(queries: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Inner products in double precision, the products added in the order of the components."""
    out = np.zeros((len(queries), len(entries)))
    for q, e in zip(queries.T, entries.T):
        out += np.multiply.outer(q, e)
    return out


def _assign(rows: DataFrame, books: tuple[np.ndarray, np.ndarray], keep_vector: bool = True) -> DataFrame:
    half = books[0].shape[1]

    def task():
        def each(batch: pa.RecordBatch):
            v = batch.column(1)
            m = np.asarray(v.flatten()).reshape(len(v), -1)
            return {"vec_id": batch.column(0), "v": v, "c1": nearest(m[:, :half], books[0]), "c2": nearest(m[:, half:], books[1])}
        return each

    return map_rows(rows.select("vec_id", "v"), task,
                    struct_of(("vec_id", rows.schema["vec_id"].dataType), ("v", "array<double>"), ("c1", "int"), ("c2", "int")))


def nearest_neighbours(entries: DataFrame, queries: DataFrame, limit: int = 20, k: int = 64, share: float = 0.55,
                       sample: int = 20_000, entry_block: int = 4096, query_block: int = 1024) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each vec_id of ``queries`` its ``limit`` nearest found
    rows of ``entries`` with another vec_id, nearest first, ties to the smaller vec_id.

    Both sides are (vec_id, v) as ``usable`` gives them. The codebooks are fitted on at most ``sample``
    entries (the first by a hash of vec_id); every entry is indexed. A query visits cells that hold at
    least ``share`` of the index and at least ``limit`` others, or everything if there are fewer, so
    small tables are searched whole. Rows that repeat a vec_id are entries of their own, but never
    neighbours of a query with that vec_id. Query rows that repeat a vec_id are one query: each entry counts
    once, by its best score with any of their vectors. An entry without a vec_id is a neighbour whose vec_id is null
    (last among equal scores); a query without one is no query. Empty tables give an empty result.
    """
    spark = entries.sparkSession
    ship(spark)
    out = struct_of(("query_id", queries.schema["vec_id"].dataType), ("vec_id", entries.schema["vec_id"].dataType), ("unnamed", "boolean"),
                    ("entry", "long"), ("score", "double"))
    final = struct_of(("query_id", out["query_id"].dataType), ("rank", "int"), ("vec_id", out["vec_id"].dataType), ("score", "double"))
    drawn = entries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toPandas()["v"]
    if not len(drawn):
        return spark.createDataFrame([], final)
    fit = np.stack(drawn.to_list())
    half = fit.shape[1] // 2
    books = (codebook(fit[:, :half], k), codebook(fit[:, half:], k))
    indexed = materialize(_assign(entries, books).withColumn("entry", F.monotonically_increasing_id()))
    queries = materialize(queries.where("vec_id IS NOT NULL").select("vec_id", "v").distinct())
    counts = np.zeros((len(books[0]), len(books[1])), np.int64)
    for r in indexed.groupBy("c1", "c2").count().collect():  # at most k * k rows
        counts[r["c1"], r["c2"]] = r["count"]
    total = int(counts.sum())
    enough = max(int(np.ceil(share * total)), limit + 1)
    blocks = [max(1, -(-int(n) // entry_block)) for n in counts.sum(1)]
    n_queries = queries.count()
    n_query_blocks = max(1, -(-n_queries // query_block))

    def walk():
        def each(batch: pa.RecordBatch):
            ids, vs = batch.column(0), np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, -1)
            rows: list[int] = []
            c1: list[int] = []
            cells: list[list[int]] = []
            for n, v in enumerate(vs):
                by: dict[int, list[int]] = {}
                for i, j in best_first(books[0] @ v[:half], books[1] @ v[half:], counts, enough):
                    by.setdefault(i, []).append(j)
                rows += [n] * len(by)
                c1 += by
                cells += by.values()
            at = pa.array(rows, pa.int64())
            return {"query_id": ids.take(at), "q": batch.column(1).take(at), "c1": c1, "cells": cells}
        return each

    of_block = lambda key, n: F.pmod(F.xxhash64(key), n).cast("int")
    n_blocks = F.element_at(F.array(*[F.lit(b) for b in blocks]), F.col("c1") + 1)
    # the walk's tasks grow with the queries
    asked = map_rows(queries.repartition(max(1, -(-n_queries // WALK_ROWS)), "vec_id").select("vec_id", "v"), walk,
                     struct_of(("query_id", out["query_id"].dataType), ("q", "array<double>"), ("c1", "int"), ("cells", "array<int>")))
    asked = materialize(asked.withColumn("qb", of_block("query_id", F.lit(n_query_blocks))))
    visited = asked.select(F.col("c1").alias("visited"), F.col("qb").alias("qb")).distinct()  # query blocks that visit a centroid of the first half
    asked = asked.withColumn("eb", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
    # an entry's block hangs on its own number, so rows that repeat a vec_id spread; pandas has no null whole numbers
    no_id = F.lit(0).cast(out["vec_id"].dataType)
    held = (indexed.withColumn("eb", of_block("entry", n_blocks)).withColumn("unnamed", F.col("vec_id").isNull())
            .withColumn("vec_id", F.coalesce("vec_id", no_id)).join(visited, F.col("c1") == F.col("visited")).drop("visited"))

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": left["query_id"][:0], "vec_id": right["vec_id"][:0], "unnamed": right["unnamed"][:0],
                                 "entry": right["entry"][:0], "score": np.zeros(0)})
        right = right.sort_values(["unnamed", "vec_id"], kind="stable")
        q, e = np.stack(left["q"].to_list()), np.stack(right["v"].to_list())
        c2, qid, eid = right["c2"].to_numpy(), left["query_id"].to_numpy(), right["vec_id"].to_numpy()
        scores = np.full((len(q), len(e)), -np.inf)
        visits: dict[int, list[int]] = {}
        for n, cells in enumerate(left["cells"]):
            for c in cells:
                visits.setdefault(c, []).append(n)
        for c in np.unique(c2):
            if int(c) in visits:
                rows, cols = np.array(visits[int(c)]), np.flatnonzero(c2 == c)
                scores[rows[:, None], cols[None, :]] = ordered_dot(q[rows], e[cols])
        unnamed = right["unnamed"].to_numpy(dtype=bool)
        scores[(qid[:, None] == eid[None, :]) & ~unnamed] = -np.inf
        if len(e) > limit:
            floor = np.partition(scores, len(e) - limit, axis=1)[:, len(e) - limit]
            good = (scores >= floor[:, None]) & (scores > -np.inf)
        else:
            good = scores > -np.inf
        at_q, at_e = np.nonzero(good)  # by query, then vec_id
        value = scores[at_q, at_e]
        order = np.lexsort((at_e, -value, at_q))
        at_q, at_e, value = at_q[order], at_e[order], value[order]
        first = np.searchsorted(at_q, at_q, side="left")
        top = np.arange(len(at_q)) - first < limit
        return pd.DataFrame({"query_id": qid[at_q[top]], "vec_id": eid[at_e[top]], "unnamed": unnamed[at_e[top]],
                             "entry": right["entry"].to_numpy()[at_e[top]], "score": value[top]})

    keys = ("c1", "eb", "qb")
    found = asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(best, out)
    found = found.withColumn("vec_id", F.when(~F.col("unnamed"), F.col("vec_id")))
    found = found.groupBy("query_id", "entry").agg(F.max("score").alias("score"), F.first("vec_id").alias("vec_id"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return (found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
            .select("query_id", "rank", "vec_id", "score"))
