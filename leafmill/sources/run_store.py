"""The run store: append-only summary and payload tables with deletion marks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.runs import newest_first, run_summary
from ..schemas import CONFIG, REPORT, RESULT

RUNS = (
    f"id string, created_at string, status string, operation string, config {CONFIG}, count int, "
    "bytes long, error string"
)
RESULTS = f"id string, result {RESULT}, report {REPORT}"


class RunStore:
    """Runs below one shared folder.

    The payload is written before the summary and reading starts at the summary, so a save that
    fails half-way shows nothing. Deleting appends the ids to a table of deletion marks.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _table(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except AnalysisException:
            return self.spark.createDataFrame([], schema)

    def _live(self, name: str, schema: str) -> DataFrame:
        return self._table(name, schema).join(self._table("deleted", "id string").distinct(), ["id"], "left_anti")

    def save(self, entries: DataFrame) -> None:
        """Adds runs (id, created_at, status, operation, config, result, report, error); older ones stay."""
        entries.select("id", "result", "report").write.mode("append").parquet(f"{self.root}/results")
        run_summary(entries).write.mode("append").parquet(f"{self.root}/runs")

    def list(self) -> DataFrame:
        """Summaries, newest first."""
        return newest_first(self._live("runs", RUNS))

    def read(self, run_id: str) -> DataFrame:
        """One run with its payload; no row unless both parts exist."""
        wanted = F.col("id") == run_id
        return self._live("runs", RUNS).filter(wanted).join(self._table("results", RESULTS).filter(wanted), ["id"])

    def delete(self, ids: DataFrame | None = None) -> None:
        """Deletes the given runs, or all of them."""
        gone = self._live("runs", RUNS).select("id") if ids is None else ids.select("id")
        gone.write.mode("append").parquet(f"{self.root}/deleted")
