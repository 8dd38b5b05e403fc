"""Structured Streaming twins of the batch jobs."""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.html import extract_html, with_nodes
from ..operators.runs import TERMINAL
from ..session import work_path


def stream_table(spark: SparkSession, path: str, schema: str, glob: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the files below ``path`` that ``glob`` matches, and of those in folders that it matches.

    A table may be one file or a folder of parts; as a pattern, in braces, its name goes for both.
    """
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{path}/{{{glob}}}")


def stream_extract(pages: DataFrame, rule: dict, keys: Sequence[str], **limits) -> DataFrame:
    """Records of each page as it arrives: the same narrow plan as in batch, append mode."""
    return extract_html(with_nodes(pages), rule, keys, **limits)


def stream_distinct(df: DataFrame, keys: Sequence[str], ts: str, horizon: str) -> DataFrame:
    """First row of equal keys; the watermark bounds the state.

    ``horizon`` is how far apart equal keys may be, so a run's id among the keys makes it a run's length.
    Rows that are older than the newest one by more than that go.
    """
    return df.withWatermark(ts, horizon).dropDuplicatesWithinWatermark(list(keys))


# Counts of the events without a gap before them, how many these are, and the events behind a gap.
FOLD_STATE = "settled long, terminal string, pages long, rows long, error string, pending string"
FOLD_OUTPUT = "run_id string, status string, pages long, rows long, error string"


def _taken(now: tuple, event: list) -> tuple:
    """(terminal, pages, rows, error) with one more event; nothing counts behind a terminal one."""
    terminal, pages, rows, error = now
    kind, message, n = event
    if terminal is not None:
        return now
    if kind in TERMINAL:
        return kind, pages, rows, (message or "") if kind == "error" else ""
    return (None, pages + 1, rows + (n or 0), error) if kind == "page" else now


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    settled, *now, pending = state.get if state.exists else (0, None, 0, 0, "", "{}")
    now, pending = tuple(now), {int(pos): event for pos, event in json.loads(pending).items()}
    for frame in batches:
        if now[0] is not None:
            # what comes after the settled end counts for nothing
            continue
        columns = [frame[c].astype(object).where(frame[c].notna(), None).tolist() for c in ("pos", "type", "message", "rows_n")]
        for pos, *event in zip(*columns, strict=True):
            if pos >= settled:
                pending.setdefault(int(pos), [event[0], event[1], None if event[2] is None else int(event[2])])
        while settled in pending and now[0] is None:
            now = _taken(now, pending.pop(settled))
            settled += 1
    if now[0] is not None:
        pending = {}
    state.update((settled, *now, json.dumps(pending)))
    # the events behind a gap count as if nothing were to come
    terminal, pages, rows, error = functools.reduce(lambda x, pos: _taken(x, pending[pos]), sorted(pending), now)
    yield pd.DataFrame({"run_id": [key[0]], "status": [terminal or "running"], "pages": [pages], "rows": [rows], "error": [error]})


def stream_fold(events: DataFrame) -> DataFrame:
    """Run status after each trigger, update mode; events after the terminal one count for nothing.

    Events may come in any order and more than once; ``pos`` counts from 0 within a run. What has no gap
    before it is kept as four counters, and only events behind a gap are kept themselves, until it closes.
    """
    return events.select("run_id", "pos", "type", "message", "rows_n").groupBy("run_id").applyInPandasWithState(
        _fold, FOLD_OUTPUT, FOLD_STATE, "update", "NoTimeout"
    )


def append_to(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends to a Parquet table; what was written survives a stop or failure."""
    return (
        df.writeStream.format("parquet").outputMode("append").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def run_available(df: DataFrame, name: str) -> DataFrame:
    """Runs a stream over the data at hand and reads the written table back."""
    spark = df.sparkSession
    path = work_path(spark, name)
    append_to(df, f"{path}/table", f"{path}/checkpoint").awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/table")


def latest_fold(events: DataFrame, name: str) -> DataFrame:
    """Runs ``stream_fold`` over the data at hand: the last state of every run.

    Each trigger's updates are appended with its number, so a repeated trigger changes nothing.
    """
    spark = events.sparkSession
    path = work_path(spark, name)

    def append(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/table/batch={number}")

    stream_fold(events).writeStream.outputMode("update").foreachBatch(append).option(
        "checkpointLocation", f"{path}/checkpoint"
    ).trigger(availableNow=True).start().awaitTermination()
    columns = ["status", "pages", "rows", "error"]
    table = spark.read.schema(f"{FOLD_OUTPUT}, batch long").parquet(f"{path}/table")
    return table.groupBy("run_id").agg(F.max_by(F.struct(*columns), "batch").alias("_s")).select("run_id", "_s.*")
