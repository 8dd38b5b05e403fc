"""Registered queries: the collect job over pages and API bodies under a stored catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.urls import host_of
from ..operators.catalog import read_rules
from ..operators.collect import collect
from ..schemas import CONFIG
from ..session import work_path
from .common import pages
from .html_queries import HTML_ARTICLES, HTML_NAV_LINKS
from .json_queries import JSON_API_ROUNDTRIP, ORDER_RULE, order_bodies

NAV = [("text", "a", "text"), ("href", "a[href]", "href"), ("none", "b.none, i.none", "text")]
TITLE = [("title", "h1", "text")]


def _stored_rules(spark, sf):
    """One stored rule per host of the page table, links or titles by the host's length, and one for the API."""
    hosts = pages(spark, sf).select(host_of(F.col("url")).alias("host")).where("host <> ''").distinct()

    def fields(rows):
        return F.array(*[F.struct(F.lit(n).alias("id"), F.lit(n).alias("name"), F.lit(s).alias("selector"), F.lit(a).alias("attribute")) for n, s, a in rows])

    links = F.length("host") % 2 == 0
    html = hosts.select(
        F.col("host").alias("id"),
        F.struct(
            F.concat(F.lit("https://"), "host", F.lit("/")).alias("url"), F.lit("html").alias("sourceType"),
            F.lit(None).cast("string").alias("renderMode"), F.lit(None).cast("int").alias("renderWaitMs"), F.lit(None).cast("string").alias("waitSelector"),
            F.when(links, "nav ul > li").otherwise("article").alias("rowSelector"), F.when(links, "").otherwise("nav li:nth-child(2) a").alias("nextSelector"),
            F.lit(1).alias("maxPages"), F.when(links, fields(NAV)).otherwise(fields(TITLE)).alias("fields"),
            F.lit(None).alias("api"),
        ).cast(CONFIG).alias("config"),
    )
    api = spark.range(1).select(
        F.lit("orders").alias("id"),
        F.struct(
            F.lit("https://api.example.com/orders").alias("url"), F.lit("json").alias("sourceType"),
            F.lit(None).alias("renderMode"), F.lit(None).alias("renderWaitMs"), F.lit(None).alias("waitSelector"),
            F.lit(ORDER_RULE["rowSelector"]).alias("rowSelector"), F.lit("").alias("nextSelector"), F.lit(1).alias("maxPages"),
            fields([(f["name"], f["selector"], "text") for f in ORDER_RULE["fields"]]).alias("fields"),
            F.struct(F.lit("GET"), F.create_map().cast("map<string,string>"), F.lit(""), F.lit("page"), F.lit(1)).alias("api"),
        ).cast(CONFIG).alias("config"),
    )
    rules = html.unionByName(api).select("id", F.col("id").substr(1, 50).alias("name"), "config", F.lit("2024-01-01").alias("updatedAt"))
    path = work_path(spark, "rules")
    packed = rules.groupBy(F.pmod(F.xxhash64("id"), F.lit(16)).alias("file")).agg(F.to_json(F.collect_list(F.struct("id", "name", "config", "updatedAt"))).alias("value"))
    packed.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return read_rules(spark, path)


def _responses(spark, sf):
    """Pages of all hosts and order bodies in one table; some have a bad status, type or body."""
    html = pages(spark, sf).select(
        host_of(F.col("url")).alias("run_id"), F.col("page_id").cast("long").alias("page_index"), "url",
        F.when(F.col("page_id") % 17 == 3, 404).otherwise(200).alias("status"), F.create_map().cast("map<string,string>").alias("headers"),
        F.when(F.col("page_id") % 19 == 5, "text/plain").otherwise("text/html; charset=utf-8").alias("content_type"), F.encode("html", "UTF-8").alias("body"),
    )
    bodies = order_bodies(spark, sf)
    broken = F.when(F.col("body_no") % 13 == 7, F.expr("substring(body, 1, 40)")).otherwise(F.col("body"))
    api = bodies.select(
        F.lit("orders").alias("run_id"), F.col("body_no").cast("long").alias("page_index"), "url", "status", F.create_map().cast("map<string,string>").alias("headers"),
        "content_type", broken.alias("body"),
    )
    return html.unionByName(api)


def _collected(spark, sf):
    return collect(_responses(spark, sf), _stored_rules(spark, sf), ["run_id", "page_index"])


def collect_records(spark, sf):
    return _collected(spark, sf).records().select("rule_id", "page_index", "row_pos", "field_name", "value", "_source")


_PAGE = "regexp_extract(url, '^https?://([^/?#]+)', 1)"
_GOOD = "page_id % 17 <> 3 AND page_id % 19 <> 5"

COLLECT_RECORDS = f"""
WITH hosts AS (SELECT page_id, {_PAGE} AS host FROM pages WHERE {_GOOD}),
nav AS ({HTML_NAV_LINKS}),
art AS ({HTML_ARTICLES}),
api AS ({JSON_API_ROUNDTRIP})
SELECT host AS rule_id, CAST(page_id AS BIGINT) AS page_index, row_pos, field_name, value, _source FROM (
  SELECT *, unnest(['text', 'href', 'none']) AS field_name, unnest([text, href, '']) AS value FROM nav) JOIN hosts USING (page_id) WHERE length(host) % 2 = 0
UNION ALL
SELECT host, page_id, row_pos, 'title', title, _source FROM art JOIN hosts USING (page_id) WHERE length(host) % 2 = 1
UNION ALL
SELECT 'orders', body_no, row_pos, field_name, value, _source FROM (
  SELECT *, unnest(['id', 'customer', 'status', 'total', 'priority', 'final', 'tag2', 'tags', 'n_tags', 'missing']) AS field_name,
         unnest([id, customer, status, total, priority, final, tag2, tags, n_tags, missing]) AS value FROM api) WHERE body_no % 13 <> 7
"""


def collect_sinks(spark, sf):
    """Pages, warnings and rejected responses of the same job."""
    job = _collected(spark, sf)
    none = F.lit(None).cast("string")
    rows = job.pages().select("rule_id", "page_index", F.lit("page").alias("sink"), "rows", "matched", none.alias("message"))
    for sink, found, text in (("warning", job.warnings(), "message"), ("reject", job.rejects(), "reject_reason")):
        rows = rows.unionByName(found.select("rule_id", "page_index", F.lit(sink).alias("sink"), F.lit(None).cast("int").alias("rows"), F.lit(None).cast("int").alias("matched"), F.col(text).alias("message")))
    return rows


COLLECT_SINKS = f"""
WITH hosts AS (SELECT page_id, {_PAGE} AS host, html FROM pages),
counted AS (SELECT *, CASE WHEN length(host) % 2 = 0 THEN len(regexp_extract_all(html, '<li><a href="([^"]*)">', 1)) ELSE 1 END AS n,
                   len(regexp_extract_all(html, '<li><a href="([^"]*)">', 1)) AS links FROM hosts),
bodies AS (SELECT o_orderkey // 25 AS body_no, count(*) AS n FROM orders GROUP BY 1)
SELECT host AS rule_id, CAST(page_id AS BIGINT) AS page_index, 'page' AS sink, CAST(n AS INTEGER) AS rows, CAST(n AS INTEGER) AS matched, NULL AS message FROM counted WHERE {_GOOD}
UNION ALL SELECT 'orders', body_no, 'page', n, n, NULL FROM bodies WHERE body_no % 13 <> 7
UNION ALL SELECT 'orders', body_no, 'warning', NULL, NULL, '「missing」没有提取到内容，请核对 JSON 路径。' FROM bodies WHERE body_no % 13 <> 7
UNION ALL SELECT 'orders', body_no, 'reject', NULL, NULL, 'invalid JSON' FROM bodies WHERE body_no % 13 = 7
UNION ALL SELECT host, page_id, 'warning', NULL, NULL, '「none」没有提取到内容，请检查选择器或属性。' FROM counted WHERE {_GOOD} AND length(host) % 2 = 0 AND n > 0
UNION ALL SELECT host, page_id, 'warning', NULL, NULL, '列表容器未匹配到内容，请检查 CSS 选择器。' FROM counted WHERE {_GOOD} AND n = 0
UNION ALL SELECT host, page_id, 'reject', NULL, NULL, CASE WHEN page_id % 17 = 3 THEN 'HTTP 404' ELSE 'not html' END FROM counted WHERE NOT ({_GOOD})
"""


def collect_runs(spark, sf):
    return _collected(spark, sf).runs().drop("bytes")


COLLECT_RUNS = f"""
SELECT CASE WHEN rule_id = 'orders' THEN 'orders' ELSE rule_id END AS run_id, count(*) FILTER (WHERE sink = 'page') AS pages, CAST(coalesce(sum(rows), 0) AS BIGINT) AS rows,
       count(DISTINCT message) FILTER (WHERE sink = 'warning') AS warnings, count(*) FILTER (WHERE sink = 'reject') AS rejects
FROM ({COLLECT_SINKS}) GROUP BY 1
"""

QUERIES = {
    "collect_records": (collect_records, COLLECT_RECORDS),
    "collect_sinks": (collect_sinks, COLLECT_SINKS),
    "collect_runs": (collect_runs, COLLECT_RUNS),
}
