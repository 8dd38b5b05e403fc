"""Registered queries: streaming twins, run over the data at hand."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from ..operators.html import page_title, with_nodes
from ..session import tune, work_path
from ..streaming.jobs import append_to, latest_fold, run_available, stream_distinct, stream_extract, stream_table
from .common import NAV_RULE
from .html_queries import HTML_NAV_LINKS, HTML_TITLES
from .run_queries import SQL_EVENTS, as_events


def stream_links(spark, sf):
    """Navigation links of pages as the page files arrive."""
    tune(spark)
    pages = stream_table(spark, sf, "page_id long, url string, html string", "pages.parquet")
    return run_available(stream_extract(pages, NAV_RULE, ["page_id"]), "stream-links")


def stream_warnings(spark, sf):
    """First event of every user and type, de-duplicated as events arrive."""
    tune(spark)
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    events = stream_table(spark, sf, schema.simpleString()[7:-1].replace(":", " "), "events.parquet")
    keyed = events.select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    return run_available(stream_distinct(keyed, ["user_id", "event_type"], "ts", "3650 days"), "stream-warnings").select(
        "user_id", "event_type"
    )


def stream_daily_warnings(spark, sf):
    """First event of every user, type and day: state is kept for a day."""
    tune(spark)
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    events = stream_table(spark, sf, schema.simpleString()[7:-1].replace(":", " "), "events.parquet")
    keyed = events.select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return run_available(stream_distinct(keyed, ["user_id", "event_type", "day"], "ts", "1 day"), "stream-warnings").select("user_id", "event_type", "day")


def stream_shuffled_runs(spark, sf):
    """The same fold over events that come out of order, some of them twice, in several triggers."""
    tune(spark)
    path = work_path(spark, "stream-events")
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    events = turns.select(F.col("conv_id").cast("string").alias("run_id"), *as_events(turns)[1:])
    twice = events.unionByName(events.where("pos % 5 = 2"))
    part = F.pmod(F.xxhash64("run_id", "pos", F.rand(7)), F.lit(6))
    twice.withColumn("part", part).repartition(6, "part").drop("part").write.parquet(path)
    schema = "run_id string, pos long, type string, message string, level string, rows_n long"
    return latest_fold(stream_table(spark, path, schema, "*.parquet", files_per_trigger=2), "stream-runs")


def stream_restart(spark, sf):
    """Titles of pages from a stream that fails on the way and starts again from its checkpoint.

    What was written before the failure stays and can be read (the row -1 says so), and in the end no page
    is lost or doubled.
    """
    tune(spark)
    path = work_path(spark, "stream-restart")
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html")
    cuts = pages.agg(F.percentile_approx("page_id", [0.2, 0.4, 0.6, 0.8])).first()[0]
    part = sum((F.col("page_id") > cut).cast("int") for cut in cuts)
    # one after the other, as a stream takes files in the order of their times
    for n in range(5):
        pages.where(part == n).coalesce(1).write.mode("append").parquet(f"{path}/in")
    source = stream_table(spark, f"{path}/in", "page_id long, url string, html string", "*.parquet", files_per_trigger=1)
    titled = with_nodes(source).select("page_id", page_title(F.col("nodes"), F.col("url")).alias("title"))
    broken = titled.withColumn("title", F.when(F.col("page_id") == pages.agg(F.percentile_approx("page_id", 0.5)).scalar(), F.raise_error(F.lit("broken on purpose"))).otherwise(F.col("title")))
    try:
        append_to(broken, f"{path}/table", f"{path}/checkpoint").awaitTermination()
    except StreamingQueryException as error:
        if "broken on purpose" not in str(error):
            raise
    read = lambda: spark.read.schema("page_id long, title string").parquet(f"{path}/table")
    partial = read().count()
    append_to(titled, f"{path}/table", f"{path}/checkpoint").awaitTermination()
    kept = spark.range(1).select(F.lit(-1).cast("long").alias("page_id"), F.lit("partial").alias("title")).where(F.lit(0 < partial < pages.count()))
    return read().unionByName(kept)


def stream_runs(spark, sf):
    """Run status folded from conversations read as an event stream."""
    tune(spark)
    turns = stream_table(spark, sf, "conv_id long, turn long, role string, text string", "conversations.parquet")
    events = turns.select(F.col("conv_id").cast("string").alias("run_id"), *as_events(turns)[1:])
    return latest_fold(events, "stream-runs")


STREAM_RUNS = f"""
WITH {SQL_EVENTS}
SELECT CAST(run_id AS VARCHAR) AS run_id, coalesce(max(CASE WHEN pos = stop THEN type END), 'running') AS status,
       count(*) FILTER (type = 'page') AS pages, CAST(coalesce(sum(rows_n) FILTER (type = 'page'), 0) AS BIGINT) AS rows,
       coalesce(max(CASE WHEN pos = stop AND type = 'error' THEN message END), '') AS error
FROM live GROUP BY run_id
"""

QUERIES = {
    "stream_runs": (stream_runs, STREAM_RUNS),
    "stream_shuffled_runs": (stream_shuffled_runs, STREAM_RUNS),
    "stream_daily_warnings": (stream_daily_warnings, "SELECT DISTINCT user_id, event_type, strftime(ts, '%Y-%m-%d') AS day FROM events"),
    "stream_restart": (stream_restart, f"SELECT * FROM ({HTML_TITLES}) UNION ALL SELECT -1, 'partial'"),
    "stream_links": (stream_links, HTML_NAV_LINKS),
    "stream_warnings": (stream_warnings, "SELECT DISTINCT user_id, event_type FROM events"),
}
