"""Registered queries: event folding, run results, retention, the run store."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixed import WARN_INTERRUPTED, WARN_STOPPED
from ..operators.runs import (
    distinct_warnings,
    event_reports,
    fold_events,
    fold_results,
    retain,
    run_metrics,
    run_summary,
    run_warnings,
)
from ..schemas import CONFIG, REPORT, RESULT
from ..session import work_path
from ..sources.responses import read_events
from ..sources.run_store import RunStore
from ..sources.sinks import iso_time, write_events
from .common import table


def as_events(turns) -> list:
    """Conversation turns as run events: the role and the length of a turn give the event."""
    size = F.length("text")
    kind = (
        F.when(size % 7 == 0, "done").when(size % 11 == 0, "error").when(F.col("role") == "user", "page").otherwise("log")
    )
    return [
        F.col("conv_id").alias("run_id"),
        F.col("turn").alias("pos"),
        kind.alias("type"),
        F.concat(F.lit("m"), (size % 3).cast("string")).alias("message"),
        F.when(size % 2 == 0, "warning").otherwise("info").alias("level"),
        (size % 50).cast("long").alias("rows_n"),
    ]


def _events(spark, sf):
    turns = table(spark, sf, "conversations")
    return turns.select(*as_events(turns))


SQL_EVENTS = """
e AS (SELECT conv_id AS run_id, turn AS pos, CASE WHEN length(text) % 7 = 0 THEN 'done' WHEN length(text) % 11 = 0 THEN 'error'
             WHEN role = 'user' THEN 'page' ELSE 'log' END AS type,
             'm' || length(text) % 3 AS message, CASE WHEN length(text) % 2 = 0 THEN 'warning' ELSE 'info' END AS level,
             length(text) % 50 AS rows_n FROM conversations),
x AS (SELECT *, min(CASE WHEN type IN ('done', 'error') THEN pos END) OVER (PARTITION BY run_id) AS stop FROM e),
live AS (SELECT * FROM x WHERE stop IS NULL OR pos <= stop)
"""


def event_fold(spark, sf):
    events = _events(spark, sf)
    stopped = events.filter(F.col("message") == "m0").select("run_id").distinct()
    return fold_events(events, stopped)


EVENT_FOLD = f"""
WITH {SQL_EVENTS}, st AS (SELECT DISTINCT run_id FROM e WHERE message = 'm0'),
g AS (SELECT run_id, max(CASE WHEN pos = stop THEN type END) AS terminal, max(CASE WHEN pos = stop AND type = 'error' THEN message END) AS err,
             count(*) FILTER (type = 'page') AS pages, coalesce(sum(rows_n) FILTER (type = 'page'), 0) AS rows FROM live GROUP BY 1)
SELECT g.run_id, CASE WHEN terminal IS NOT NULL THEN terminal WHEN st.run_id IS NOT NULL THEN 'stopped' ELSE 'error' END AS status,
       pages, CAST(rows AS BIGINT) AS rows,
       CASE WHEN err IS NOT NULL THEN err WHEN terminal IS NOT NULL THEN '' WHEN st.run_id IS NOT NULL THEN '{WARN_STOPPED}' ELSE '{WARN_INTERRUPTED}' END AS error
FROM g LEFT JOIN st ON st.run_id = g.run_id
"""


def event_report_fold(spark, sf):
    """Runs with their fields and warnings; a line without punctuation at its end is a probe of three fields."""
    turns = table(spark, sf, "conversations")
    events = turns.select(*as_events(turns), F.length("text").alias("size"))
    probe = (F.col("type") == "log") & (F.col("size") % 3 == 0)
    fields = F.when(probe, F.array(F.lit("title"), F.concat(F.lit("f"), (F.col("size") % 5).cast("string")), F.lit("价格")))
    events = events.withColumn("fields", fields).withColumn("type", F.when(probe, "probe").otherwise(F.col("type"))).drop("size")
    stopped = events.filter(F.col("message") == "m1").select("run_id").distinct()
    found = event_reports(events, stopped)
    return found.select("run_id", "status", "pages", "rows", F.array_join("fields", ",").alias("fields"), F.array_join("warnings", "|").alias("warnings"))


EVENT_REPORT_FOLD = f"""
WITH {SQL_EVENTS},
p AS (SELECT *, type = 'log' AND length(text) % 3 = 0 AS probe FROM live JOIN (SELECT conv_id AS run_id, turn AS pos, text FROM conversations) USING (run_id, pos)),
st AS (SELECT DISTINCT run_id FROM e WHERE message = 'm1'),
lp AS (SELECT run_id, max(pos) AS last_page FROM p WHERE type = 'page' GROUP BY 1),
fl AS (SELECT run_id, max_by('title,f' || length(text) % 5 || ',价格', pos) AS fields FROM p JOIN lp USING (run_id) WHERE probe AND pos < last_page GROUP BY 1),
g AS (SELECT run_id, max(CASE WHEN pos = stop THEN type END) AS terminal, max(CASE WHEN pos = stop AND type = 'error' THEN message END) AS err,
             count(*) FILTER (WHERE type = 'page') AS pages, coalesce(sum(rows_n) FILTER (WHERE type = 'page'), 0) AS rows FROM p GROUP BY 1),
er AS (SELECT g.*, CASE WHEN terminal IS NOT NULL THEN terminal WHEN st.run_id IS NOT NULL THEN 'stopped' ELSE 'error' END AS status,
              CASE WHEN err IS NOT NULL THEN err WHEN terminal IS NOT NULL THEN NULL WHEN st.run_id IS NOT NULL THEN '{WARN_STOPPED}' ELSE '{WARN_INTERRUPTED}' END AS error
       FROM g LEFT JOIN st USING (run_id)),
w AS (SELECT run_id, message, min(pos) AS pos FROM (
        SELECT run_id, message, pos FROM p WHERE type = 'log' AND NOT probe AND level = 'warning' UNION ALL SELECT run_id, error, 1000000 FROM er WHERE error IS NOT NULL) GROUP BY ALL),
wl AS (SELECT run_id, string_agg(message, '|' ORDER BY pos) AS warnings FROM w GROUP BY 1)
SELECT er.run_id, status, pages, CAST(rows AS BIGINT) AS rows, coalesce(fields, '') AS fields, coalesce(warnings, '') AS warnings
FROM er LEFT JOIN fl USING (run_id) LEFT JOIN wl USING (run_id)
"""


def run_summaries(spark, sf):
    """Summaries of stored runs with their sizes in bytes and their completion time."""
    customers = table(spark, sf, "customer")
    rows = F.transform(F.sequence(F.lit(1), F.pmod("c_nationkey", F.lit(4)) + 1), lambda i: F.create_map(F.lit("name"), F.col("c_name"), F.lit("价"), i.cast("string")))
    ms = F.col("c_custkey").cast("long") * 86_399_777
    result = F.struct(
        rows.alias("rows"), F.array().cast("array<struct<url:string,title:string,rows:int,duration:long>>").alias("pages"), F.array(F.lit("name"), F.lit("价")).alias("fields"),
        F.array().cast("array<string>").alias("warnings"), (F.col("c_custkey") * 7).cast("long").alias("duration"), iso_time(ms).alias("completedAt"),
    )
    config = F.struct(F.concat(F.lit("https://u:p@x.example.com/"), "c_custkey", F.lit("?t=1")).alias("url"), F.lit("json").alias("sourceType"), F.lit(None).cast("struct<headers:map<string,string>,body:string>").alias("api"))
    report = F.when(F.col("c_custkey") % 2 == 0, F.struct(F.lit("json").alias("sourceType"), F.col("c_nationkey").alias("matched")))
    runs = customers.select(F.col("c_custkey").alias("id"), ms.alias("created_at"), F.lit("done").alias("status"), F.lit("crawl").alias("operation"), config.alias("config"), result.alias("result"), report.alias("report"), F.lit("").alias("error"))
    found = run_summary(runs)
    return found.select("id", "status", "count", "bytes", F.col("config.url").alias("url"), iso_time(F.col("created_at")).alias("created"))


RUN_SUMMARIES = """
WITH c AS (SELECT *, c_nationkey % 4 + 1 AS n, CAST(c_custkey AS BIGINT) * 86399777 AS ms FROM customer),
t AS (SELECT *, strftime(make_timestamp(ms * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS iso,
             array_to_string(list_transform(range(1, n + 1), lambda i: '{"name":"' || c_name || '","价":"' || i || '"}'), ',') AS rows FROM c)
SELECT c_custkey AS id, 'done' AS status, CAST(n AS INTEGER) AS count, 'https://x.example.com/' || c_custkey AS url, iso AS created,
  CAST(strlen('{"rows":[' || rows || '],"pages":[],"fields":["name","价"],"warnings":[],"duration":' || c_custkey * 7 || ',"completedAt":"' || iso || '"}')
       + CASE WHEN c_custkey % 2 = 0 THEN strlen('{"sourceType":"json","matched":' || c_nationkey || '}') ELSE 2 END AS BIGINT) AS bytes
FROM t
"""


def event_warnings(spark, sf):
    return run_warnings(_events(spark, sf))


EVENT_WARNINGS = f"""
WITH {SQL_EVENTS}
SELECT run_id, message, min(pos) AS pos FROM live WHERE (type = 'log' AND level = 'warning') OR type = 'error' GROUP BY ALL
"""


def event_log_roundtrip(spark, sf):
    """Writes events as JSON lines, reads them back with the event schema and counts them."""
    path = work_path(spark, "events")
    events = _events(spark, sf)
    page = F.when(
        F.col("type") == "page",
        F.struct(F.concat(F.lit("https://x.example.com/"), "message").alias("url"), F.col("message").alias("title"), F.col("rows_n").cast("int").alias("rows"), F.lit(5).cast("long").alias("duration")),
    )
    write_events(events.select(F.col("run_id").cast("string").alias("run_id"), "pos", "type", "message", "level", page.alias("page")), path)
    back = read_events(spark, path)
    return back.groupBy("type").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("run_id").alias("runs"), F.coalesce(F.sum("page.rows"), F.lit(0)).alias("page_rows"), F.max("page.url").alias("last_url")
    )


EVENT_LOG_ROUNDTRIP = f"""
WITH {SQL_EVENTS}
SELECT type, count(*) AS n, count(DISTINCT run_id) AS runs, CAST(coalesce(sum(rows_n) FILTER (type = 'page'), 0) AS BIGINT) AS page_rows,
       max('https://x.example.com/' || message) FILTER (type = 'page') AS last_url
FROM e GROUP BY 1
"""


def warnings_distinct(spark, sf):
    e = table(spark, sf, "events")
    return distinct_warnings(
        e.select(F.col("user_id").alias("run_id"), F.concat("event_type", F.lit(" failed")).alias("message"), F.col("event_id").alias("pos"))
    )


def _page_stats(spark, sf):
    """Orders as finished pages of their customer's run."""
    started = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("run_id"),
        started.alias("started_ms"),
        (started + F.pmod("o_orderkey", F.lit(977)) * 13).alias("finished_ms"),
    )


def _run_records(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey")
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("run_id"), "o_orderkey")
    return lines.join(orders, F.col("o_orderkey") == F.col("l_orderkey")).select("run_id")


def run_results(spark, sf):
    return fold_results(_run_records(spark, sf), _page_stats(spark, sf))


SQL_RUN_RESULTS = """
p AS (SELECT o_custkey AS run_id, o_orderkey, epoch_ms(o_orderdate) AS started, epoch_ms(o_orderdate) + (o_orderkey % 977) * 13 AS finished FROM orders),
g AS (SELECT run_id, count(*) AS pages, min(started) AS a, max(finished) AS b FROM p GROUP BY 1),
r AS (SELECT o_custkey AS run_id, count(*) AS rows FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1)
"""

RUN_RESULTS = f"""
WITH {SQL_RUN_RESULTS}
SELECT g.run_id, pages, coalesce(rows, 0) AS rows, b - a AS duration_ms, b AS completed_ms FROM g LEFT JOIN r ON r.run_id = g.run_id
"""


def run_numbers(spark, sf):
    df = run_metrics(_run_records(spark, sf), _page_stats(spark, sf))
    return df.withColumn("elapsed_s", F.col("elapsed_s").cast("decimal(18,1)").cast("string"))


RUN_NUMBERS = f"""
WITH {SQL_RUN_RESULTS}
SELECT g.run_id, coalesce(rows, 0) AS records, pages AS finished_pages,
       CAST(CAST((b - a + 50) // 100 AS DECIMAL(18,1)) / 10 AS DECIMAL(18,1))::VARCHAR AS elapsed_s
FROM g LEFT JOIN r ON r.run_id = g.run_id
"""


def retention(spark, sf):
    """Documents as stored runs of their source; the newest stay within count and size."""
    d = table(spark, sf, "documents")
    runs = d.select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("owner"),
        F.floor(F.col("doc_id") / 3).alias("created_at"),
        F.octet_length(F.col("text")).cast("long").alias("bytes"),
    )
    return retain(runs, ["owner"], max_runs=20, max_bytes=30_000).select("owner", "id", "rank", "total_bytes")


RETENTION = """
WITH r AS (SELECT doc_id AS id, source AS owner, doc_id // 3 AS created_at, strlen(text) AS bytes FROM documents),
k AS (SELECT owner, id, row_number() OVER w AS rank, sum(bytes) OVER (w ROWS UNBOUNDED PRECEDING) AS total_bytes FROM r
      WINDOW w AS (PARTITION BY owner ORDER BY created_at DESC, id))
SELECT owner, id, CAST(rank AS INTEGER) AS rank, CAST(total_bytes AS BIGINT) AS total_bytes FROM k WHERE rank <= 20 AND total_bytes <= 30000
"""


def _entries(spark, sf):
    """Customers as finished runs; a run of a JSON source carries credentials."""
    c = table(spark, sf, "customer")
    is_json = F.col("c_nationkey") % 2 == 0
    key = F.col("c_custkey").cast("string")
    config = F.struct(
        F.concat(F.lit("https://u:p@api.example.com/"), key, F.lit("?token=secret")).alias("url"),
        F.when(is_json, "json").otherwise("html").alias("sourceType"),
        F.lit(None).cast("string").alias("renderMode"),
        F.lit(None).cast("int").alias("renderWaitMs"),
        F.lit(None).cast("string").alias("waitSelector"),
        F.lit("items").alias("rowSelector"),
        F.lit("").alias("nextSelector"),
        F.lit(1).alias("maxPages"),
        F.array(F.struct(F.lit("1").alias("id"), F.lit("name").alias("name"), F.lit("name").alias("selector"), F.lit("text").alias("attribute"))).alias("fields"),
        F.when(
            is_json,
            F.struct(F.lit("POST").alias("method"), F.create_map(F.lit("authorization"), F.lit("t")).alias("headers"), F.lit("{}").alias("body"), F.lit("").alias("pageParam"), F.lit(1).alias("startPage")),
        ).alias("api"),
    ).cast(CONFIG)
    row = F.create_map(F.lit("name"), F.col("c_name"), F.lit("_source"), F.lit("https://api.example.com/"))
    result = F.struct(
        F.array_repeat(row, (F.col("c_nationkey") % 4).cast("int")).alias("rows"),
        F.array().alias("pages"),
        F.array(F.lit("name")).alias("fields"),
        F.array().alias("warnings"),
        F.lit(10).alias("duration"),
        F.lit("2024-01-01T00:00:00.000Z").alias("completedAt"),
    ).cast(RESULT)
    return c.select(
        key.alias("id"),
        F.concat(F.lit("2024-01-01T00:00:"), F.lpad((F.col("c_custkey") % 60).cast("string"), 2, "0")).alias("created_at"),
        F.lit("done").alias("status"),
        F.lit("crawl").alias("operation"),
        config.alias("config"),
        result.alias("result"),
        F.lit(None).cast(REPORT).alias("report"),
        F.lit("").alias("error"),
    )


def run_store(spark, sf):
    """Saves all runs, deletes the newest and lists the rest with their payload."""
    store = RunStore(spark, work_path(spark, "store"))
    store.save(_entries(spark, sf))
    newest = store.list().limit(1).select("id")
    store.delete(newest)
    payload = store._table("results", f"id string, result {RESULT}, report {REPORT}").select("id", F.size("result.rows").alias("stored_rows"))
    return store.list().join(payload, ["id"]).select(
        "id", "created_at", "count", "stored_rows",
        F.col("config.url").alias("url"),
        F.coalesce(F.size("config.api.headers"), F.lit(-1)).alias("headers"),
    )


RUN_STORE = """
WITH r AS (SELECT CAST(c_custkey AS VARCHAR) AS id, '2024-01-01T00:00:' || lpad(CAST(c_custkey % 60 AS VARCHAR), 2, '0') AS created_at, c_nationkey, c_custkey FROM customer),
k AS (SELECT *, row_number() OVER (ORDER BY created_at DESC, id) AS rank FROM r)
SELECT id, created_at, CAST(c_nationkey % 4 AS INTEGER) AS count, CAST(c_nationkey % 4 AS INTEGER) AS stored_rows,
  CASE WHEN c_nationkey % 2 = 0 THEN 'https://api.example.com/' || id ELSE 'https://u:p@api.example.com/' || id || '?token=secret' END AS url,
  CASE WHEN c_nationkey % 2 = 0 THEN 0 ELSE -1 END AS headers
FROM k WHERE rank >= 2
"""

QUERIES = {
    "event_report_fold": (event_report_fold, EVENT_REPORT_FOLD),
    "run_summaries": (run_summaries, RUN_SUMMARIES),
    "event_fold": (event_fold, EVENT_FOLD),
    "event_warnings": (event_warnings, EVENT_WARNINGS),
    "event_log_roundtrip": (event_log_roundtrip, EVENT_LOG_ROUNDTRIP),
    "warnings_distinct": (
        warnings_distinct,
        "SELECT user_id AS run_id, event_type || ' failed' AS message, min(event_id) AS pos FROM events GROUP BY ALL",
    ),
    "run_results": (run_results, RUN_RESULTS),
    "run_numbers": (run_numbers, RUN_NUMBERS),
    "retention": (retention, RETENTION),
    "run_store": (run_store, RUN_STORE),
}
