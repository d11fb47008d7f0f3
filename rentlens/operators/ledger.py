"""Run ledger (K4, T26) written by the jobs themselves.

A run writes one row when it starts and one when it ends, each in a folder of
its own, before and after (never inside) the step that publishes its tables:

    <path>/run=<hash>/attempt=<n>/started     status running
    <path>/run=<hash>/attempt=<n>/ended       status ok with counts, or failed with the error

A run that raises leaves a ``failed`` row; one whose driver died leaves
``running``. A repeated run is another attempt. No row is ever rewritten.
"""

from __future__ import annotations

import datetime
import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

COUNTS = ("n_scraped", "n_raw", "n_new")
SCHEMA = ("run_id string, attempt int, source string, started_at timestamp, finished_at timestamp, n_scraped long, n_raw long, "
          "n_new long, status string, error string, git_sha string")
#: Characters of an error that are kept; a stack trace of the engine may be far longer.
ERROR_CHARS = 2000


class Run:
    """A run under way; ``counts`` go to its ledger row when it ends well."""

    def __init__(self):
        self.counts: dict[str, int] = {}

    def record(self, metrics: DataFrame) -> None:
        """Takes the counts from a one-row frame of run metrics."""
        row = metrics.select(*[c for c in COUNTS if c in metrics.columns]).first()
        self.counts = row.asDict() if row is not None else {}


class RunLedger:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self, run_id) -> str:
        return f"{self.path}/run={hashlib.sha256(str(run_id).encode()).hexdigest()[:16]}"

    def _attempts(self, run_id) -> int:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._folder(run_id))
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return len(fs.listStatus(p)) if fs.exists(p) else 0

    def _write(self, event: str, row: dict) -> None:
        values = [row.get(c.split()[0]) for c in SCHEMA.split(", ")]
        folder = f"{self._folder(row['run_id'])}/attempt={row['attempt']}/{event}"
        self.spark.createDataFrame([values], SCHEMA).coalesce(1).write.mode("errorifexists").json(folder)

    @contextmanager
    def run(self, run_id, source: str | None = None, git_sha: str | None = None) -> Iterator[Run]:
        """The body is one attempt of the run. What it raises is written and raised again."""
        row = {"run_id": str(run_id), "attempt": self._attempts(run_id), "source": source, "git_sha": git_sha,
               "started_at": datetime.datetime.now(datetime.timezone.utc)}
        self._write("started", row | {"status": "running"})
        run = Run()
        try:
            yield run
        except BaseException as e:
            self._write("ended", row | {"finished_at": datetime.datetime.now(datetime.timezone.utc), "status": "failed",
                                        "error": f"{type(e).__name__}: {e}"[:ERROR_CHARS]})
            raise
        self._write("ended", row | run.counts | {"finished_at": datetime.datetime.now(datetime.timezone.utc), "status": "ok"})

    def attempts(self) -> DataFrame:
        """One row per attempt: its end if it has ended, else its start."""
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").json(self.path)
        rest = [c for c in rows.columns if c not in ("run_id", "attempt")]
        last = F.max_by(F.struct(*rest), F.col("finished_at").isNotNull())
        return rows.groupBy("run_id", "attempt").agg(last.alias("r")).select("run_id", "attempt", "r.*")

    def rows(self) -> DataFrame:
        """One row per run: its last attempt."""
        a = self.attempts()
        rest = [c for c in a.columns if c != "run_id"]
        return a.groupBy("run_id").agg(F.max_by(F.struct(*rest), "attempt").alias("r")).select("run_id", "r.*")
