"""Run-level results: event folding, summaries, warnings, retention, redaction, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..fixed import WARN_INTERRUPTED, WARN_STOPPED
from ..functions.text import let
from ..functions.urls import build_url, parse_url
from .frontier import salted_lookup

TERMINAL = ("done", "error")


def fold_results(records: DataFrame, page_stats: DataFrame) -> DataFrame:
    """Per run: pages, rows, duration and completion; records and pages stay in their tables."""
    pages = page_stats.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("pages"),
        F.min("started_ms").alias("_start"),
        F.max("finished_ms").alias("completed_ms"),
    )
    rows = records.groupBy("run_id").agg(F.count(F.lit(1)).alias("rows"))
    return pages.join(rows, ["run_id"], "left").select(
        "run_id",
        "pages",
        F.coalesce("rows", F.lit(0)).alias("rows"),
        (F.col("completed_ms") - F.col("_start")).alias("duration_ms"),
        "completed_ms",
    )


def distinct_warnings(warnings: DataFrame) -> DataFrame:
    """Keep-first distinct (run_id, message) with the position of the first."""
    return warnings.groupBy("run_id", "message").agg(F.min("pos").alias("pos"))


def effective_events(events: DataFrame) -> DataFrame:
    """Events up to and including the first terminal one of each run."""
    ends = events.filter(F.col("type").isin(*TERMINAL)).groupBy("run_id").agg(F.min("pos").alias("_end"))
    return salted_lookup(events, ends, ["run_id"], "pos").filter(
        F.col("_end").isNull() | (F.col("pos") <= F.col("_end"))
    )


def fold_events(events: DataFrame, stopped: DataFrame | None = None) -> DataFrame:
    """Per run: status, page and row counts, error text.

    ``events`` (run_id, pos, type, message, level, rows_n). A run without terminal event was
    interrupted, or stopped if its id is in ``stopped``. Only counters and one message per run
    are aggregated; rows and warnings stay in their own tables (see ``run_warnings``).
    """
    live = effective_events(events)
    folded = live.groupBy("run_id").agg(
        F.min_by("type", F.when(F.col("type").isin(*TERMINAL), F.col("pos"))).alias("_terminal"),
        F.min_by("message", F.when(F.col("type") == "error", F.col("pos"))).alias("_error"),
        F.count_if(F.col("type") == "page").alias("pages"),
        F.coalesce(F.sum(F.when(F.col("type") == "page", F.col("rows_n"))), F.lit(0)).alias("rows"),
    )
    marked = (
        folded.withColumn("_stopped", F.lit(False))
        if stopped is None
        else folded.join(stopped.select("run_id", F.lit(True).alias("_stopped")).distinct(), ["run_id"], "left")
    )
    user_stop = F.coalesce(F.col("_stopped"), F.lit(False))
    status = F.coalesce(F.col("_terminal"), F.when(user_stop, "stopped").otherwise("error"))
    error = F.coalesce(
        F.col("_error"),
        F.when(F.col("_terminal").isNull(), F.when(user_stop, WARN_STOPPED).otherwise(WARN_INTERRUPTED)),
        F.lit(""),
    )
    return marked.select("run_id", status.alias("status"), "pages", "rows", error.alias("error"))


def run_warnings(events: DataFrame) -> DataFrame:
    """Distinct warnings of each run in first-seen order; the error text comes last."""
    live = effective_events(events)
    shown = (F.col("type") == "log") & (F.col("level") == "warning") | (F.col("type") == "error")
    return distinct_warnings(live.filter(shown).select("run_id", "message", "pos"))


def event_reports(events: DataFrame, stopped: DataFrame | None = None) -> DataFrame:
    """Per run: status, pages, rows, error, fields and warnings as they stand behind its last event.

    ``events`` as in ``fold_events``, with ``fields`` (names, on probe events). Fields are those of the last
    probe before the last page. Warnings are distinct in the order in which they came first, and the error
    text, also that of a run that was stopped or broke off, comes last unless it was a warning before.
    Probes and distinct warnings are joined per run; pages and log lines are only counted.
    """
    live = effective_events(events)
    folded = fold_events(events, stopped)
    last_page = live.filter(F.col("type") == "page").groupBy("run_id").agg(F.max("pos").alias("_last"))
    probes = live.filter(F.col("type") == "probe").select("run_id", "pos", "fields").join(last_page, ["run_id"])
    fields = probes.filter(F.col("pos") < F.col("_last")).groupBy("run_id").agg(F.max_by("fields", "pos").alias("fields"))
    shown = distinct_warnings(live.filter((F.col("type") == "log") & (F.col("level") == "warning")).select("run_id", "message", "pos"))
    listed = shown.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "message"))), lambda w: w["message"]).alias("_shown"))
    none = F.array().cast("array<string>")
    warnings = F.array_distinct(F.concat(F.coalesce("_shown", none), F.when(F.col("error") != "", F.array("error")).otherwise(none)))
    return folded.join(fields, ["run_id"], "left").join(listed, ["run_id"], "left").select(
        "run_id", "status", "pages", "rows", "error", F.coalesce("fields", none).alias("fields"), warnings.alias("warnings")
    )


def result_bytes(result: Column, report: Column | None = None) -> Column:
    """Stored size of a run: UTF-8 JSON of its result and of its report ({} without one)."""
    report_json = F.lit("{}") if report is None else F.coalesce(F.to_json(report), F.lit("{}"))
    return (F.octet_length(F.to_json(result)) + F.octet_length(report_json)).cast("long")


def retain(
    runs: DataFrame, owner: list[str] | None = None, *, max_runs: int | None = None, max_bytes: int | None = None, drop: bool = True
) -> DataFrame:
    """Newest runs per owner within the count and byte limits that are asked for; adds ``rank`` and ``total_bytes``.

    A run past the byte limit still counts for the older ones. Where only the newest ``max_runs`` can stay,
    that cut is made on the map side, so the running sum sees few rows per owner. Without a limit all runs
    stay as they are. ``drop=False`` returns all runs with ``over_limit``.
    """
    if drop and max_runs is None and max_bytes is None:
        return runs
    w = W.partitionBy(*(owner or [F.lit(0)])).orderBy(F.col("created_at").desc(), F.col("id").asc())
    ranked = runs.withColumn("rank", F.row_number().over(w))
    if drop and max_runs is not None:
        ranked = ranked.filter(F.col("rank") <= max_runs)
    summed = ranked.withColumn("total_bytes", F.sum("bytes").over(w.rowsBetween(W.unboundedPreceding, 0)))
    over = F.lit(False) if max_bytes is None else F.col("total_bytes") > max_bytes
    if max_runs is not None:
        over = over | (F.col("rank") > max_runs)
    return summed.filter(~over) if drop else summed.withColumn("over_limit", over)


def newest_first(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.col("created_at").desc(), F.col("id").asc())


def public_url(url: Column) -> Column:
    """URL without query and credentials; malformed ones become empty."""
    return F.coalesce(
        let(parse_url(url), lambda p: build_url(p, query=F.lit(""), user=False)), F.lit("")
    )


def redact_config(config: Column, report_type: Column | None = None) -> Column:
    """Rule configuration without credentials, as it may be stored."""
    no_headers = F.create_map().cast("map<string,string>")
    api = F.when(
        config["api"].isNotNull(),
        config["api"].withField("headers", no_headers).withField("body", F.lit("")),
    )
    is_json = config["sourceType"] == "json"
    if report_type is not None:
        is_json = F.coalesce(is_json, F.lit(False)) | F.coalesce(report_type == "json", F.lit(False))
    url = F.when(F.coalesce(is_json, F.lit(False)), public_url(config["url"])).otherwise(config["url"])
    return config.withField("api", api).withField("url", url)


def run_summary(results: DataFrame) -> DataFrame:
    """One summary row per stored run: (id, created_at, status, operation, count, bytes)."""
    return results.select(
        "id",
        "created_at",
        "status",
        "operation",
        redact_config(F.col("config"), F.col("report.sourceType")).alias("config"),
        F.coalesce(F.size("result.rows"), F.lit(0)).alias("count"),
        result_bytes(F.col("result"), F.col("report")).alias("bytes"),
        "error",
    )


def run_metrics(records: DataFrame, page_stats: DataFrame) -> DataFrame:
    """Per run: records, finished pages and elapsed seconds to one decimal."""
    folded = fold_results(records, page_stats)
    return folded.select(
        "run_id",
        F.col("rows").alias("records"),
        F.col("pages").alias("finished_pages"),
        F.round(F.col("duration_ms") / 1000, 1).alias("elapsed_s"),
    )
