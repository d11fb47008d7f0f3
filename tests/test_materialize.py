"""Written intermediate tables: parquet materialization in the checkpoint
folder, and the predictions table shared by report queries while its inputs
are unchanged."""

import os
import re
import shutil

from pyspark.sql import functions as F

from rentlens.plans import q_pricing
from rentlens.session import ensure_checkpoint_dir, materialize

SRC = "/root/testdata/sf0.001"


def test_materialize_writes_parquet_under_checkpoint_dir(spark):
    df = spark.range(100).withColumn("sq", F.col("id") * F.col("id"))
    m = materialize(df)
    local = lambda u: re.sub(r"^file:/+", "/", u)
    files = [local(f) for f in m.inputFiles()]
    base = local(ensure_checkpoint_dir(spark))
    assert files and all(f.startswith(base) and f.endswith(".parquet") for f in files)
    assert sorted(r.sq for r in m.collect()) == [i * i for i in range(100)]


def test_predictions_table_reused_until_inputs_change(spark, tmp_path):
    sf = str(tmp_path / "sf")
    os.makedirs(sf)
    for t in ("lineitem", "part"):
        shutil.copy(f"{SRC}/{t}.parquet", f"{sf}/{t}.parquet")
    first = q_pricing.baseline(spark, sf)
    assert q_pricing.baseline(spark, sf) is first
    n = first.count()
    # a rewritten input (new modification time) gives a freshly written table
    st = os.stat(f"{sf}/part.parquet")
    os.utime(f"{sf}/part.parquet", (st.st_atime, st.st_mtime + 60))
    second = q_pricing.baseline(spark, sf)
    assert second is not first
    assert second.count() == n
