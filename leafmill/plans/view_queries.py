"""Registered queries: result view, preview, fill rates, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.profile import empty_fields, fill_rates
from ..operators.view import (
    cell_text,
    is_link,
    keyword_filter,
    missing_filter,
    natural_order,
    page_count,
    preview_page,
    select_rows,
    view_counts,
)
from ..sources.sinks import csv_line, csv_parts, read_result, write_csv, write_result, write_result_json
from ..session import work_path
from .common import table


def _documents(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", "text", "lang", "source", F.concat(F.lit("https://docs.example.com/"), "source").alias("_source")
    )


FIELDS = ["text", "lang", "source"]


def keyword_search(spark, sf):
    return keyword_filter(_documents(spark, sf), FIELDS, "  ThE ").select("doc_id")


KEYWORD_SEARCH = """
SELECT doc_id FROM documents WHERE contains(lower(text), 'the') OR contains(lower(lang), 'the') OR contains(lower(source), 'the')
"""


def keyword_in_column(spark, sf):
    return keyword_filter(_documents(spark, sf), FIELDS, "DE", "lang").select("doc_id")


def _contacts(spark, sf):
    """Customers with blank cells: no phone for negative balances, blank mail for low nations."""
    c = table(spark, sf, "customer")
    return c.select(
        F.col("c_custkey").alias("row_pos"),
        F.col("c_name").alias("name"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_nationkey").cast("string")).alias("phone"),
        F.when(F.col("c_nationkey") < 4, F.lit("  ")).otherwise(F.col("c_mktsegment")).alias("mail"),
        F.lit("crm").alias("_source"),
    )


CONTACT_FIELDS = ["name", "phone", "mail"]
SQL_CONTACTS = """
c AS (SELECT c_custkey AS row_pos, c_name AS name, CASE WHEN c_acctbal >= 0 THEN CAST(c_nationkey AS VARCHAR) ELSE '' END AS phone,
             CASE WHEN c_nationkey < 4 THEN '  ' ELSE c_mktsegment END AS mail FROM customer)
"""


def missing_cells(spark, sf):
    missing = missing_filter(_contacts(spark, sf), CONTACT_FIELDS, "missing").select("row_pos", F.lit("missing").alias("part"))
    full = missing_filter(_contacts(spark, sf), CONTACT_FIELDS, "filled", "mail").select("row_pos", F.lit("mail filled").alias("part"))
    return missing.unionByName(full)


MISSING_CELLS = f"""
WITH {SQL_CONTACTS}
SELECT row_pos, 'missing' AS part FROM c WHERE trim(phone) = '' OR trim(mail) = ''
UNION ALL SELECT row_pos, 'mail filled' FROM c WHERE trim(mail) <> ''
"""


def dedupe_documents(spark, sf):
    return select_rows(_documents(spark, sf), FIELDS, "doc_id", dedupe="text")


DEDUPE_DOCUMENTS = """
SELECT doc_id, text, lang, source, 'https://docs.example.com/' || source AS _source FROM documents
QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1
"""


def dedupe_blank_safe(spark, sf):
    """Duplicate phone and mail merge, rows without both never do."""
    df = _contacts(spark, sf)
    return select_rows(df, ["phone", "mail"], "row_pos", dedupe="__all__").select("row_pos", "name")


DEDUPE_BLANK_SAFE = f"""
WITH {SQL_CONTACTS}
SELECT row_pos, name FROM c
QUALIFY (trim(phone) = '' AND trim(mail) = '') OR row_number() OVER (PARTITION BY phone, mail ORDER BY row_pos) = 1
"""


def view_pipeline(spark, sf):
    """Search, keep filled rows, de-duplicate."""
    return select_rows(
        _contacts(spark, sf), CONTACT_FIELDS, "row_pos", query="e", empty="filled", column="mail", dedupe="phone"
    ).select("row_pos", "name", "phone", "mail")


VIEW_PIPELINE = f"""
WITH {SQL_CONTACTS}, f AS (SELECT * FROM c WHERE contains(lower(mail), 'e') AND trim(mail) <> '')
SELECT row_pos, name, CASE WHEN phone = '' THEN NULL ELSE phone END AS phone, mail FROM f
QUALIFY trim(phone) = '' OR row_number() OVER (PARTITION BY phone ORDER BY row_pos) = 1
"""


def view_totals(spark, sf):
    return view_counts(_contacts(spark, sf), CONTACT_FIELDS, "row_pos", query="e", column="mail", dedupe="phone")


VIEW_TOTALS = f"""
WITH {SQL_CONTACTS}, f AS (SELECT *, row_number() OVER (PARTITION BY phone ORDER BY row_pos) AS rn FROM c WHERE contains(lower(mail), 'e'))
SELECT count(*) AS filtered_count, count(*) FILTER (trim(phone) = '' OR rn = 1) AS shown_count,
       count(*) FILTER (trim(phone) <> '' AND rn > 1) AS removed_count FROM f
"""


def natural_sort_preview(spark, sf):
    """Third preview page of the parts in natural order of "name size", descending."""
    p = table(spark, sf, "part").select(
        "p_partkey", F.concat(F.initcap("p_name"), F.lit(" "), F.col("p_size").cast("string")).alias("label")
    )
    return preview_page(p, natural_order("label", "p_partkey", descending=True), page=2)


NATURAL_SORT_PREVIEW = """
WITH p AS (SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') || ' ' || p_size AS label, lower(p_name) AS word, p_size FROM part),
r AS (SELECT *, row_number() OVER (ORDER BY word DESC, p_size DESC, p_partkey) AS n FROM p)
SELECT lpad(CAST(n AS VARCHAR), 2, '0') AS row_no, p_partkey, label FROM r WHERE n BETWEEN 21 AND 30
"""


def preview_pages(spark, sf):
    return page_count(table(spark, sf, "part"))


def link_cells(spark, sf):
    p = table(spark, sf, "pages")
    value = F.when(F.col("url").contains("?"), F.concat("url", F.lit(" x"))).when(F.col("url").contains("#"), "").otherwise(F.col("url"))
    return p.select("page_id", is_link(value).alias("is_link"), cell_text(value).alias("shown"))


LINK_CELLS = """
WITH v AS (SELECT page_id, CASE WHEN contains(url, '?') THEN url || ' x' WHEN contains(url, '#') THEN '' ELSE url END AS v FROM pages)
SELECT page_id, v NOT LIKE '% %' AND v <> '' AS is_link, CASE WHEN v = '' THEN '—' ELSE v END AS shown FROM v
"""


def fill_report(spark, sf):
    """Fill rate of each contact field per segment, and whether it stayed empty."""
    df = _contacts(spark, sf).withColumn("group_name", F.substring("name", -1, 1))
    return fill_rates(df, ["group_name"], CONTACT_FIELDS)


FILL_REPORT = f"""
WITH {SQL_CONTACTS}, g AS (SELECT right(name, 1) AS group_name, count(*) AS sampled, count(*) FILTER (trim(name) <> '') AS a,
  count(*) FILTER (trim(phone) <> '') AS b, count(*) FILTER (trim(mail) <> '') AS d FROM c GROUP BY 1)
SELECT group_name, sampled, CAST(pos AS INTEGER) AS field_pos, field_name, filled, CAST(floor(filled * 100 / sampled + 0.5) AS INTEGER) AS hit_rate FROM (
  SELECT group_name, sampled, 0 AS pos, 'name' AS field_name, a AS filled FROM g
  UNION ALL SELECT group_name, sampled, 1, 'phone', b FROM g UNION ALL SELECT group_name, sampled, 2, 'mail', d FROM g)
"""


def never_filled(spark, sf):
    df = _contacts(spark, sf).withColumn("phone_digit", F.coalesce(F.substring("phone", 1, 1), F.lit("-")))
    return empty_fields(fill_rates(df, ["phone_digit"], CONTACT_FIELDS)).select("phone_digit", "field_name", "sampled")


NEVER_FILLED = f"""
WITH {SQL_CONTACTS}, g AS (SELECT CASE WHEN phone = '' THEN '-' ELSE phone[1] END AS phone_digit, * FROM c)
SELECT phone_digit, 'phone' AS field_name, count(*) AS sampled FROM g GROUP BY 1 HAVING count(*) FILTER (trim(phone) <> '') = 0
UNION ALL SELECT phone_digit, 'mail', count(*) FROM g GROUP BY 1 HAVING count(*) FILTER (trim(mail) <> '') = 0
"""


def _cells(spark, sf):
    """Texts that need guarding, quoting or neither."""
    d = table(spark, sf, "documents")
    lead = (
        F.when(F.col("lang") == "de", "=SUM(1)").when(F.col("lang") == "fr", "  -x \"q\" ").when(F.col("lang") == "es", "\ttab").otherwise("plain, ")
    )
    return d.select("doc_id", F.concat(lead, "text").alias("cell"), F.col("source").alias("_source"))


SQL_CELL = """
(SELECT doc_id, source, CASE lang WHEN 'de' THEN '=SUM(1)' WHEN 'fr' THEN '  -x "q" ' WHEN 'es' THEN chr(9) || 'tab' ELSE 'plain, ' END || text AS cell, lang FROM documents)
"""
SQL_CSV_LINE = """
'"' || CASE WHEN lang = 'en' THEN '' ELSE chr(39) END || replace(cell, '"', '""') || '","' || source || '"'
"""


def csv_cells(spark, sf):
    return _cells(spark, sf).select("doc_id", csv_line(["cell", "_source"]).alias("line"))


CSV_CELLS = f"SELECT doc_id, {SQL_CSV_LINE} AS line FROM {SQL_CELL}"


def csv_files(spark, sf):
    """Writes the guarded CSV and reads the bytes back: every part starts with mark and header."""
    path = work_path(spark, "csv")
    write_csv(_cells(spark, sf), path, ["cell"])
    return csv_parts(spark, path, ["cell"]).groupBy("headed").agg(F.sum("row_bytes").alias("row_bytes"))


CSV_FILES = f"SELECT true AS headed, CAST(sum(strlen({SQL_CSV_LINE}) + 2) AS BIGINT) AS row_bytes FROM {SQL_CELL}"


def result_json(spark, sf):
    """Writes the selected rows as a JSON result and reads them back with the selection counts."""
    path = work_path(spark, "result")
    source = _documents(spark, sf)
    view = select_rows(source, ["lang", "source"], "doc_id", query="de", column="lang", dedupe="source")
    write_result_json(view, ["lang", "source"], path, original=source, filters={"query": "de", "dedupe": "source"})
    rows = spark.read.schema("lang string, source string, _source string").json(f"{path}/rows")
    selection = spark.read.schema("selection struct<originalCount:long,filters:map<string,string>>").json(f"{path}/selection")
    return rows.withColumn("original_count", F.lit(None).cast("long")).unionByName(
        selection.select(
            F.col("selection.filters")["query"].alias("lang"),
            F.col("selection.filters")["dedupe"].alias("source"),
            F.lit("selection").alias("_source"),
            F.col("selection.originalCount").alias("original_count"),
        )
    )


RESULT_JSON = """
SELECT DISTINCT lang, source, 'https://docs.example.com/' || source AS _source, CAST(NULL AS BIGINT) AS original_count FROM documents WHERE lang = 'de'
UNION ALL SELECT 'de', 'source', 'selection', count(*) FROM documents
"""

def csv_empty(spark, sf):
    """An empty view still gives a file with mark and header, and small files keep their headers."""
    path = work_path(spark, "csv")
    cells = _cells(spark, sf)
    write_csv(cells.where("cell is null"), f"{path}/none", ["cell"])
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "7")
    try:
        write_csv(cells, f"{path}/split", ["cell"])
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    parts = csv_parts(spark, path, ["cell"])
    return parts.groupBy(F.element_at(F.split("path", "/"), -2).alias("view")).agg(F.every("headed").alias("headed"), F.sum("row_bytes").alias("row_bytes"))


CSV_EMPTY = f"""
SELECT 'none' AS view, true AS headed, CAST(0 AS BIGINT) AS row_bytes
UNION ALL SELECT 'split', true, CAST(sum(strlen({SQL_CSV_LINE}) + 2) AS BIGINT) FROM {SQL_CELL}
"""


def result_document(spark, sf):
    """A whole result, written and read back: rows, pages, warnings and the document, one line each."""
    path = work_path(spark, "result")
    source = _documents(spark, sf)
    view = select_rows(source, ["lang", "source"], "doc_id", query="de", column="lang", dedupe="source")
    orders = table(spark, sf, "orders").where("o_orderkey < 500")
    started = F.unix_millis(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey")
    pages = orders.select(
        F.concat(F.lit("https://x.example.com/"), "o_orderkey").alias("url"), F.col("o_orderpriority").alias("title"),
        F.month("o_orderdate").cast("long").alias("rows"), started.alias("started_ms"), (started + F.dayofmonth("o_orderdate")).alias("finished_ms"),
    )
    warnings = orders.select(F.concat(F.col("o_orderstatus"), F.lit(" \"late\"")).alias("message"), F.col("o_orderkey").alias("pos"))
    filters = {"query": "de", "dedupe": "source"}
    write_result(view, ["lang", "source"], path, original=source, filters=filters, pages=pages, warnings=warnings)
    parts = read_result(spark, path, ["lang", "source"])
    line = lambda part, *columns: parts[part].select(F.lit(part).alias("part"), F.concat_ws("|", *[F.col(c).cast("string") for c in columns]).alias("line"))
    document = parts["result"].select(
        F.lit("result").alias("part"),
        F.concat_ws("|", F.array_join("fields", ","), F.col("duration").cast("string"), "completedAt", F.col("selection.originalCount").cast("string"), F.col("selection.filters")["query"], F.col("selection.filters")["dedupe"]).alias("line"),
    )
    return line("rows", "lang", "source", "_source").unionByName(line("pages", "url", "title", "rows", "duration")).unionByName(line("warnings", "pos", "message")).unionByName(document)


RESULT_DOCUMENT = """
WITH o AS (SELECT *, epoch_ms(CAST(o_orderdate AS TIMESTAMP)) + o_orderkey AS s FROM orders WHERE o_orderkey < 500)
SELECT DISTINCT 'rows' AS part, lang || '|' || source || '|https://docs.example.com/' || source AS line FROM documents WHERE lang = 'de'
UNION ALL SELECT 'pages', 'https://x.example.com/' || o_orderkey || '|' || o_orderpriority || '|' || month(o_orderdate) || '|' || day(o_orderdate) FROM o
UNION ALL SELECT 'warnings', min(o_orderkey) || '|' || o_orderstatus || ' "late"' FROM o GROUP BY o_orderstatus
UNION ALL SELECT 'result', 'lang,source|' || (max(s + day(o_orderdate)) - min(s)) || '|' || strftime(make_timestamp(max(s + day(o_orderdate)) * 1000), '%Y-%m-%dT%H:%M:%S.%gZ')
  || '|' || (SELECT count(*) FROM documents) || '|de|source' FROM o
"""

QUERIES = {
    "csv_empty": (csv_empty, CSV_EMPTY),
    "result_document": (result_document, RESULT_DOCUMENT),
    "keyword_search": (keyword_search, KEYWORD_SEARCH),
    "keyword_in_column": (keyword_in_column, "SELECT doc_id FROM documents WHERE lang = 'de'"),
    "missing_cells": (missing_cells, MISSING_CELLS),
    "dedupe_documents": (dedupe_documents, DEDUPE_DOCUMENTS),
    "dedupe_blank_safe": (dedupe_blank_safe, DEDUPE_BLANK_SAFE),
    "view_pipeline": (view_pipeline, VIEW_PIPELINE),
    "view_totals": (view_totals, VIEW_TOTALS),
    "natural_sort_preview": (natural_sort_preview, NATURAL_SORT_PREVIEW),
    "preview_pages": (preview_pages, "SELECT CAST(ceil(count(*) / 10.0) AS BIGINT) AS pages FROM part"),
    "link_cells": (link_cells, LINK_CELLS),
    "fill_report": (fill_report, FILL_REPORT),
    "never_filled": (never_filled, NEVER_FILLED),
    "csv_cells": (csv_cells, CSV_CELLS),
    "csv_files": (csv_files, CSV_FILES),
    "result_json": (result_json, RESULT_JSON),
}
