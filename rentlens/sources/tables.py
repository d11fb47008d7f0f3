"""Readers for the parquet test tables.

Reads never infer: parquet carries its schema and Catalyst prunes columns and
pushes filters into the scan for whatever the plan above selects.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise KeyError(name)
    return spark.read.parquet(table_path(sf_dir, name))


def input_signature(spark: SparkSession, sf_dir: str, names) -> tuple:
    """(file count, total bytes, newest modification time) per table, read
    through the Hadoop file system of each path (local, HDFS or object store).
    Used to tell whether a table derived from these inputs is still current."""
    sc = spark.sparkContext
    jvm, conf = sc._jvm, sc._jsc.hadoopConfiguration()
    sig = []
    for n in names:
        path = jvm.org.apache.hadoop.fs.Path(table_path(sf_dir, n))
        it = path.getFileSystem(conf).listFiles(path, True)
        files = size = newest = 0
        while it.hasNext():
            st = it.next()
            files += 1
            size += st.getLen()
            newest = max(newest, st.getModificationTime())
        sig.append((n, files, size, newest))
    return tuple(sig)


def register_views(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    """Register each table as a temp view of the same name (for fixture SQL)."""
    for n in names:
        read_table(spark, sf_dir, n).createOrReplaceTempView(n)
