"""Registered queries: gates, charsets, admission, addresses, resource audit, caps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.admission import admit_urls, audit_resources, classify_addresses
from ..operators.caps import byte_cap_page, byte_cap_run, page_cap, row_cap
from ..operators.gates import classify, content_type_reason, decode_body, gate_size, gate_status
from ..sources.responses import pages_as_responses
from .common import spread, table


def _responses(spark, sf):
    """Responses from documents: status, type and declared size derived from the row."""
    d = spread(table(spark, sf, "documents"))
    status = (
        F.when(F.col("lang") == "en", 200).when(F.col("lang") == "fr", 204).when(F.col("lang") == "de", 403).otherwise(500)
    )
    kind = (
        F.when(F.col("source") == "src0", "text/html; charset=utf-8")
        .when(F.col("source") == "src1", "application/ld+json")
        .when(F.col("source") == "src2", "Application/XHTML+XML")
        .when(F.col("source") == "src3", "application/json")
        .otherwise("text/plain")
    )
    return d.select(
        "doc_id", "lang", "source", status.alias("status"), kind.alias("content_type"),
        F.create_map(F.lit("content-length"), (F.col("n_chars") * 3).cast("string")).alias("headers"),
        F.encode("text", "UTF-8").alias("body"),
    )


SQL_STATUS = "CASE lang WHEN 'en' THEN 200 WHEN 'fr' THEN 204 WHEN 'de' THEN 403 ELSE 500 END"
SQL_TYPE = """CASE source WHEN 'src0' THEN 'text/html; charset=utf-8' WHEN 'src1' THEN 'application/ld+json'
  WHEN 'src2' THEN 'Application/XHTML+XML' WHEN 'src3' THEN 'application/json' ELSE 'text/plain' END"""


def status_gate(spark, sf):
    return gate_status(_responses(spark, sf)).select("doc_id", "reject_reason")


STATUS_GATE = f"""
SELECT doc_id, CASE WHEN s BETWEEN 200 AND 299 THEN NULL
  ELSE 'HTTP ' || s || CASE WHEN s = 403 THEN ' forbidden' ELSE '' END END AS reject_reason
FROM (SELECT doc_id, {SQL_STATUS} AS s FROM documents)
"""


def content_type_gate(spark, sf):
    df = _responses(spark, sf)
    return df.select(
        "doc_id",
        content_type_reason(F.col("content_type"), "json").alias("as_json"),
        content_type_reason(F.col("content_type"), "html").alias("as_html"),
    )


CONTENT_TYPE_GATE = f"""
SELECT doc_id, CASE WHEN lower(t) LIKE '%json%' THEN NULL ELSE 'not json' END AS as_json,
       CASE WHEN lower(t) LIKE '%html%' THEN NULL ELSE 'not html' END AS as_html
FROM (SELECT doc_id, {SQL_TYPE} AS t FROM documents)
"""


def size_gate(spark, sf):
    return gate_size(_responses(spark, sf), 3000).select("doc_id", "reject_reason")


SIZE_GATE = """
SELECT doc_id, CASE WHEN strlen(text) > 3000 OR n_chars * 3 > 3000 THEN 'too large' END AS reject_reason FROM documents
"""


def classify_kind(spark, sf):
    """Kind of each document, some led by a JSON or HTML opening, and of each page."""
    d = _responses(spark, sf)
    opening = (
        F.when(F.col("lang") == "es", "﻿  [").when(F.col("lang") == "fr", " \n<!DOCTYPE HTML>").otherwise("")
    )
    d = d.withColumn("body", F.encode(F.concat(opening, F.decode("body", "UTF-8")), "UTF-8"))
    p = pages_as_responses(table(spark, sf, "pages")).withColumn("content_type", F.lit("application/octet-stream"))
    one = classify(d).select(F.lit("doc").alias("origin"), F.col("doc_id").alias("id"), "kind")
    two = classify(p).select(F.lit("page").alias("origin"), F.col("response_id").alias("id"), "kind")
    return one.unionByName(two)


CLASSIFY_KIND = f"""
SELECT 'doc' AS origin, doc_id AS id,
       CASE WHEN lower(t) LIKE '%json%' OR lang = 'es' OR regexp_matches(text, '^\\s*[\\[{{]') AND lang <> 'fr' THEN 'json'
            WHEN lower(t) LIKE '%html%' OR lang = 'fr' THEN 'html' END AS kind
FROM (SELECT *, {SQL_TYPE} AS t FROM documents)
UNION ALL
SELECT 'page', page_id, CASE WHEN regexp_matches(html, '(?i)^<!doctype html') THEN 'html' END FROM pages
"""


def decode_charsets(spark, sf):
    """Texts written in one charset per language and read back from header, mark or meta tag."""
    d = spread(table(spark, sf, "documents"))
    lang = F.col("lang")
    text = F.regexp_replace("text", r"[^\x00-\x7fäöüßéèêàçñíóáú]", "?")
    body = (
        F.when(lang == "de", F.encode(text, "windows-1252"))
        .when(lang == "fr", F.concat(F.unhex(F.lit("FFFE")), F.encode(text, "UTF-16LE")))
        .when(lang == "es", F.concat(F.encode(F.lit('<meta charset="iso-8859-15">'), "UTF-8"), F.encode(text, "ISO-8859-15")))
        .otherwise(F.concat(F.unhex(F.lit("EFBBBF")), F.encode(text, "UTF-8")))
    )
    kind = F.when(lang == "de", "text/html; charset='ISO-8859-1'").when(lang == "es", "text/html").otherwise("text/html; charset=unknown-9")
    return decode_body(d.select("doc_id", kind.alias("content_type"), body.alias("body")), "text").select("doc_id", "text")


DECODE_CHARSETS = """
SELECT doc_id, CASE WHEN lang = 'es' THEN '<meta charset="iso-8859-15">' ELSE '' END ||
       regexp_replace(text, '[^\\x00-\\x7fäöüßéèêàçñíóáú]', '?', 'g') AS text FROM documents
"""


def url_admission(spark, sf):
    """Page URLs and forbidden variants of each."""
    p = spread(table(spark, sf, "pages"))
    variants = F.array(
        F.col("url"),
        F.regexp_replace("url", "^https?:", "ftp:"),
        F.regexp_replace("url", "^(https?://)", "$1user:pw@"),
        F.regexp_replace("url", "^(https?://[^/]+)", "$1:8080"),
        F.regexp_replace("url", "^(https?://)[^/]+", "$1localhost"),
        F.regexp_replace("url", "^(https?://)[^/]+", "$1db.internal"),
        F.concat(F.lit("http://10.0."), F.pmod("page_id", F.lit(256)).cast("string"), F.lit(".7/")),
        F.concat(F.lit("http://8.8."), F.pmod("page_id", F.lit(256)).cast("string"), F.lit(".7/")),
        F.regexp_replace("url", "^https?:", ""),
        F.upper(F.regexp_extract("url", "^(https?://[^/]+)", 1)),
    )
    rows = p.select("page_id", F.posexplode_outer(variants).alias("variant", "raw"))
    return admit_urls(rows, "raw")


SQL_NORM_URL = (
    "array_to_string(list_transform(string_split({u}, ''), lambda c: CASE WHEN ord(c) > 126 OR ord(c) < 33 THEN url_encode(c) ELSE c END), '')"
)

URL_ADMISSION = f"""
WITH v AS (
  SELECT page_id, unnest([0,1,2,3,4,5,6,7,8,9]) AS variant,
    unnest([url, regexp_replace(url, '^https?:', 'ftp:'), regexp_replace(url, '^(https?://)', '\\1user:pw@'),
            regexp_replace(url, '^(https?://[^/]+)', '\\1:8080'), regexp_replace(url, '^(https?://)[^/]+', '\\1localhost'),
            regexp_replace(url, '^(https?://)[^/]+', '\\1db.internal'), 'http://10.0.' || (page_id % 256) || '.7/',
            'http://8.8.' || (page_id % 256) || '.7/', regexp_replace(url, '^https?:', ''),
            upper(regexp_extract(url, '^(https?://[^/]+)', 1))]) AS raw
  FROM pages)
SELECT page_id, CAST(variant AS INTEGER) AS variant, raw,
  CASE WHEN variant = 0 THEN {SQL_NORM_URL.format(u="regexp_replace(raw, '#.*$', '')")}
       WHEN variant = 7 THEN raw WHEN variant = 9 THEN lower(raw) || '/' END AS url_norm,
  CASE variant WHEN 1 THEN 'scheme' WHEN 2 THEN 'credentials' WHEN 3 THEN 'port' WHEN 4 THEN 'not a public host name'
       WHEN 5 THEN 'local host name' WHEN 6 THEN 'address not public' WHEN 8 THEN 'not an absolute URL' END AS reject_reason
FROM v
"""


def public_hosts(spark, sf):
    """Hosts (one per user) with the addresses of their events; one bad address spoils a host."""
    e = spread(table(spark, sf, "events"))
    octet = F.pmod("event_id", F.lit(224))
    address = F.when(F.col("event_type") == "view", F.concat(F.lit("::ffff:"), octet.cast("string"), F.lit(".5.6.7"))).otherwise(
        F.concat(octet.cast("string"), F.lit(".5.6.7"))
    )
    rows = e.select(F.floor(F.col("event_id") / 4).alias("host"), address.alias("address"))
    return classify_addresses(rows)


PUBLIC_HOSTS = """
SELECT event_id // 4 AS host, count(*) AS addresses, bool_and((event_id % 224) NOT IN (0, 10, 127)) AS public
FROM events GROUP BY 1
"""


def resource_audit(spark, sf):
    """Events as the request log of rendered pages, one page per user."""
    e = spread(table(spark, sf, "events"))
    log = e.select(
        F.col("user_id").alias("page_id"),
        F.col("event_id").alias("seq"),
        F.when(F.col("value") < 1, "http://10.0.0.1/x").otherwise("https://cdn.example.com/x").alias("url"),
        F.when(F.col("event_type") == "purchase", "POST").otherwise("GET").alias("method"),
        F.when(F.col("event_type") == "click", "image").when(F.col("event_type") == "signup", "document").otherwise("script").alias("resource_type"),
        (F.col("event_type") == "signup").alias("navigation"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"),
        (F.col("value") * 1000).cast("long").alias("bytes"),
    )
    return audit_resources(log, max_requests=20, max_bytes=500_000)


RESOURCE_AUDIT = """
WITH log AS (
  SELECT user_id AS page_id, event_id AS seq, event_type, value,
         NOT value < 1 AND event_type NOT IN ('purchase', 'click') AS ok, CAST(trunc(value * 1000) AS BIGINT) AS bytes FROM events),
nav AS (SELECT *, event_type = 'signup' AND seq > coalesce(min(CASE WHEN ok AND event_type = 'signup' THEN seq END) OVER (PARTITION BY page_id), seq) AS extra FROM log),
pass AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY seq) AS rk FROM nav WHERE ok AND NOT extra),
kept AS (SELECT *, sum(bytes) OVER (PARTITION BY page_id ORDER BY seq) AS total FROM pass WHERE rk <= 20),
served AS (SELECT page_id, count(*) AS served, count(*) FILTER (total > 500000 OR event_type = 'error') AS failed FROM kept GROUP BY 1),
tot AS (SELECT page_id, count(*) AS requested FROM log GROUP BY 1)
SELECT tot.page_id, requested, coalesce(served, 0) AS served, requested - coalesce(served, 0) AS blocked, coalesce(failed, 0) AS failed,
  CASE WHEN coalesce(failed, 0) > 0 THEN failed || ' 个渲染资源加载失败或未通过访问检查，动态内容可能不完整。' END AS failed_warning,
  CASE WHEN requested > coalesce(served, 0) THEN '已跳过 ' || (requested - coalesce(served, 0)) || ' 个图片、媒体、非 GET 请求或额外导航；依赖这些请求的内容可能缺失。' END AS blocked_warning
FROM tot LEFT JOIN served ON tot.page_id = served.page_id
"""


def _records(spark, sf):
    """Documents as records of runs: 50 rows to a page, 10 pages to a run."""
    d = spread(table(spark, sf, "documents"))
    return d.select(
        F.floor(F.col("doc_id") / 500).alias("run_id"),
        F.pmod(F.floor(F.col("doc_id") / 50), F.lit(10)).alias("page_index"),
        F.pmod("doc_id", F.lit(50)).cast("int").alias("row_pos"),
        "doc_id",
        F.col("lang").alias("language"),
        F.length("text").cast("string").alias("size"),
        F.left(F.regexp_replace("text", r"[^a-zA-Z ]", ""), F.col("n_chars").cast("int")).alias("words"),
    )


RECORD_COLUMNS = ["language", "size", "words"]
SQL_RECORDS = """
r AS (SELECT doc_id // 500 AS run_id, (doc_id // 50) % 10 AS page_index, CAST(doc_id % 50 AS INTEGER) AS row_pos, doc_id,
             lang AS language, CAST(length(text) AS VARCHAR) AS size, left(regexp_replace(text, '[^a-zA-Z ]', '', 'g'), n_chars) AS words
      FROM documents),
s AS (SELECT *, strlen('{"language":"' || language || '","size":"' || size || '","words":"' || words || '"}') AS n FROM r)
"""


def row_caps(spark, sf):
    capped = page_cap(row_cap(_records(spark, sf), max_rows=20), 8)
    return capped.select("doc_id", "run_id", "page_index", "row_pos")


ROW_CAPS = f"""
WITH {SQL_RECORDS} SELECT doc_id, run_id, page_index, row_pos FROM r WHERE row_pos < 20 AND page_index < 8
"""


def byte_cap_pages(spark, sf):
    kept = byte_cap_page(_records(spark, sf), ["run_id", "page_index"], "row_pos", RECORD_COLUMNS, 40_000)
    return kept.select("doc_id", "run_id", "page_index", "row_pos")


BYTE_CAP_PAGES = f"""
WITH {SQL_RECORDS}, t AS (SELECT *, sum(n) OVER (PARTITION BY run_id, page_index ORDER BY row_pos) AS total FROM s)
SELECT doc_id, run_id, page_index, row_pos FROM t WHERE total <= 40000
"""


def byte_cap_runs(spark, sf):
    kept = byte_cap_run(_records(spark, sf), "run_id", "page_index", "row_pos", RECORD_COLUMNS, 300_000)
    return kept.select("doc_id", "run_id", "page_index", "row_pos")


BYTE_CAP_RUNS = f"""
WITH {SQL_RECORDS}, t AS (SELECT *, sum(n) OVER (PARTITION BY run_id ORDER BY page_index, row_pos) AS total FROM s)
SELECT doc_id, run_id, page_index, row_pos FROM t WHERE total <= 300000
"""

def record_limits(spark, sf):
    """All records with all limits as flags and totals, over whole texts."""
    d = spread(table(spark, sf, "documents"))
    records = d.select(
        F.floor(F.col("doc_id") / 500).alias("run_id"), F.pmod(F.floor(F.col("doc_id") / 50), F.lit(10)).alias("page_index"),
        F.pmod("doc_id", F.lit(50)).cast("int").alias("row_pos"), "doc_id", "text", "source",
    )
    columns = ["text", "source"]
    flag = lambda df, name, total: df.withColumnsRenamed({"over_limit": name, total: f"{name}_at"})
    rows = flag(row_cap(records, max_rows=20, drop=False), "rows_over", "total_rows")
    rows = flag(page_cap(rows, 8, drop=False), "pages_over", "total_pages")
    rows = flag(byte_cap_page(rows, ["run_id", "page_index"], "row_pos", columns, 100_000, drop=False), "page_over", "total_bytes")
    rows = flag(byte_cap_run(rows, "run_id", "page_index", "row_pos", columns, 700_000, drop=False), "run_over", "total_bytes")
    return rows.drop("text", "source")


RECORD_LIMITS = """
WITH r AS (SELECT doc_id // 500 AS run_id, (doc_id // 50) % 10 AS page_index, CAST(doc_id % 50 AS INTEGER) AS row_pos, doc_id,
                  strlen('{"text":' || CAST(to_json(text) AS VARCHAR) || ',"source":"' || source || '"}') AS n FROM documents),
t AS (SELECT *, CAST(sum(n) OVER (PARTITION BY run_id, page_index ORDER BY row_pos) AS BIGINT) AS page_over_at,
             CAST(sum(n) OVER (PARTITION BY run_id ORDER BY page_index, row_pos) AS BIGINT) AS run_over_at FROM r)
SELECT run_id, page_index, row_pos, doc_id, row_pos + 1 AS rows_over_at, row_pos >= 20 AS rows_over, page_index + 1 AS pages_over_at, page_index >= 8 AS pages_over,
       page_over_at, page_over_at > 100000 AS page_over, run_over_at, run_over_at > 700000 AS run_over FROM t
"""

QUERIES = {
    "record_limits": (record_limits, RECORD_LIMITS),
    "status_gate": (status_gate, STATUS_GATE),
    "content_type_gate": (content_type_gate, CONTENT_TYPE_GATE),
    "size_gate": (size_gate, SIZE_GATE),
    "classify_kind": (classify_kind, CLASSIFY_KIND),
    "decode_charsets": (decode_charsets, DECODE_CHARSETS),
    "url_admission": (url_admission, URL_ADMISSION),
    "public_hosts": (public_hosts, PUBLIC_HOSTS),
    "resource_audit": (resource_audit, RESOURCE_AUDIT),
    "row_caps": (row_caps, ROW_CAPS),
    "byte_cap_pages": (byte_cap_pages, BYTE_CAP_PAGES),
    "byte_cap_runs": (byte_cap_runs, BYTE_CAP_RUNS),
}
