"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DataType, StructField, StructType

from rentlens.session import materialize


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(col: str = "text") -> Column:
    """The whole text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")


def struct_of(*fields: tuple[str, DataType | str]) -> StructType:
    return StructType([StructField(name, DataType.fromDDL(kind) if isinstance(kind, str) else kind) for name, kind in fields])


#: Bytes of rows that go to a Python worker at a time. Whole texts are long, and both sides hold several batches.
ARROW_BYTES = 8 << 20


def ship(spark: SparkSession) -> None:
    """Prepare a session for Python tasks over whole texts: give the executors' workers this package, once per
    application (they need not find it on a path), and hold the session's Arrow batches to ARROW_BYTES."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    sc = spark.sparkContext
    if getattr(sc, "_rentlens_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="rentlens-py-"), "rentlens_package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(path)
    sc._rentlens_shipped = True


def give_back() -> None:
    """At the end of a Python task: what it held goes back to the system. Spark keeps its workers for later tasks, and
    an executor's memory would otherwise hold the largest tables of every stage that has run."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def map_rows(df: DataFrame, fn: Callable[[], Callable[[pa.RecordBatch], dict | None]], schema: StructType) -> DataFrame:
    """``mapInArrow`` with per-task state.

    ``fn()`` runs once per task and returns a function from one input batch to
    a dict of output columns (or None for no rows). Batches are bounded by
    Spark's Arrow record and byte limits, so memory does not grow with the task.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(schema)
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = fn()
        batch = cols = None
        try:
            for batch in batches:
                if batch.num_rows and (cols := each(batch)) is not None:
                    yield pa.RecordBatch.from_arrays(
                        [c if isinstance(c, (pa.Array, pa.ChunkedArray)) and c.type == f.type else pa.array(c, f.type)
                         for c, f in ((cols[f.name], f) for f in arrow)], schema=arrow)
        finally:
            del each, batch, cols
            give_back()

    return df.mapInArrow(run, schema)


def keep_rows(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose key is in ``ids`` (one column), with the columns of ``docs`` only."""
    k = ids.toDF("__keep_key")
    return docs.join(k, docs[key].eqNullSafe(k["__keep_key"]), "left_semi")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable from every node of ``edges`` (a, b).

    Alternates large-star and small-star steps until the edge set stops
    changing. Every step is a join and a partially aggregated group-by on edge
    rows; a hub's edges are never gathered in one task (the joins carry no
    other operator, so adaptive execution splits a skewed hub). Each round is
    written to the shared checkpoint folder, so lineage stays short.
    """
    e = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                    .where("u <> v").distinct())
    seen = None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low2.select("u", F.col("m").alias("v"))).distinct())
        e = materialize(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = tuple(now)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
