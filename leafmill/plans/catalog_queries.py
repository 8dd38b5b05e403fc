"""Registered queries: rule catalogue, validation, redaction, inference over pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixed import NOTE_HTML, NOTE_HTML_NO_LIST, NOTE_JSON, NOTE_JSON_EMPTY, NOTE_JSON_KEYS, WARN_NO_RECORD_JSON
from ..operators.analyze import analyze, probe_documents, probe_pages, probe_reports
from ..operators.catalog import (
    clear_pointer,
    delete_rules,
    header_violations,
    keep_rules,
    presets,
    read_rules,
    upsert_rules,
    validate_rules,
)
from ..operators.frontier import salted_lookup
from ..operators.html import with_nodes
from ..operators.infer import html_lists, suggest_html, table_columns, unique_names, vote_by_host
from ..operators.runs import redact_config
from ..functions.text import unnest
from ..functions.urls import host_of
from ..schemas import CONFIG
from ..session import work_path
from ..sources.responses import pages_as_responses
from .common import by_key, catalogue_pages, pages, spread, table


def _rules(spark, sf):
    """One rule per part; size, brand and type decide what is wrong with it."""
    p = spread(table(spark, sf, "part"))
    size, key = F.col("p_size"), F.col("p_partkey").cast("string")
    is_json = F.col("p_type") == "ECONOMY"
    field = F.struct(
        F.lit("f").alias("id"),
        F.when(size % 7 == 0, "_source").when(size % 7 == 1, " ").otherwise(F.concat(F.lit(" n"), key)).alias("name"),
        F.when(size % 5 == 0, F.when(is_json, "a..b").otherwise("a[")).otherwise("item").alias("selector"),
        F.when(size % 11 == 0, "1bad").otherwise("text").alias("attribute"),
    )
    config = F.struct(
        F.concat(F.lit("https://u:pw@shop.example.com/"), key, F.lit("?token=x#f")).alias("url"),
        F.when(is_json, "json").otherwise("html").alias("sourceType"),
        F.lit(None).cast("string").alias("renderMode"),
        F.when(size % 13 == 0, 20000).alias("renderWaitMs"),
        F.lit(None).cast("string").alias("waitSelector"),
        F.lit("data.items").alias("rowSelector"),
        F.lit("").alias("nextSelector"),
        F.when(size % 3 == 0, 2).when(size % 17 == 1, 11).otherwise(1).alias("maxPages"),
        F.array(field, field.withField("name", F.lit("other"))).alias("fields"),
        F.when(
            is_json,
            F.struct(
                F.when(size % 2 == 0, "GET").otherwise("POST").alias("method"),
                F.create_map(F.lit("X-Key"), F.lit("k"), F.when(size % 9 == 0, "x-key").otherwise("Accept"), F.lit("v")).alias("headers"),
                F.when(size % 8 == 0, "{}").when(size % 8 == 1, "{broken").otherwise("").alias("body"),
                F.lit("page").alias("pageParam"),
                F.lit(0).alias("startPage"),
            ),
        ).alias("api"),
    ).cast(CONFIG)
    return p.select(
        F.col("p_partkey").cast("int").alias("pos"),
        F.concat(F.lit("r"), (F.col("p_partkey") % 1000).cast("string")).alias("id"),
        "p_name", "p_brand", "p_size", "p_type", "p_partkey",
        F.when(size % 10 == 3, " ").otherwise(F.col("p_name")).alias("name"),
        config.alias("config"),
        F.lit("2024-01-01").alias("updatedAt"),
    )


def rule_violations(spark, sf):
    rules = _rules(spark, sf).withColumn("id", F.col("p_partkey"))
    _, broken = validate_rules(rules)
    return broken.select("id", "violation")


RULE_VIOLATIONS = """
WITH p AS (SELECT p_partkey AS id, p_size AS s, p_type = 'ECONOMY' AS js FROM part)
SELECT id, 'render wait' AS violation FROM p WHERE s % 13 = 0
UNION ALL SELECT id, 'page count' FROM p WHERE s % 3 <> 0 AND s % 17 = 1
UNION ALL SELECT id, 'paging' FROM p WHERE NOT js AND (s % 3 = 0 OR s % 17 = 1)
UNION ALL SELECT id, 'field name' FROM p WHERE s % 7 = 1
UNION ALL SELECT id, 'field name reserved' FROM p WHERE s % 7 = 0
UNION ALL SELECT id, 'field selector' FROM p WHERE s % 5 = 0
UNION ALL SELECT id, 'field attribute' FROM p WHERE s % 11 = 0
UNION ALL SELECT id, 'body not JSON' FROM p WHERE js AND s % 2 = 1 AND s % 8 = 1
UNION ALL SELECT id, 'GET with body' FROM p WHERE js AND s % 2 = 0 AND s % 8 = 0
UNION ALL SELECT id, 'header repeated' FROM p WHERE js AND s % 9 = 0
"""


def rule_normal_form(spark, sf):
    rules = _rules(spark, sf).withColumn("id", F.col("p_partkey"))
    valid, _ = validate_rules(rules)
    return valid.select(
        "id",
        F.col("config.renderMode").alias("render_mode"),
        F.col("config.renderWaitMs").alias("wait_ms"),
        F.col("config.fields")[0]["name"].alias("first_name"),
        F.col("config.api").isNotNull().alias("has_api"),
    )


RULE_NORMAL_FORM = f"""
SELECT p_partkey AS id, 'static' AS render_mode, CAST(2000 AS INTEGER) AS wait_ms, 'n' || p_partkey AS first_name, p_type = 'ECONOMY' AS has_api
FROM part WHERE p_partkey NOT IN (SELECT id FROM ({RULE_VIOLATIONS}))
"""


def redacted_rules(spark, sf):
    df = _rules(spark, sf).withColumn("config", redact_config(F.col("config")))
    return df.select(
        "p_partkey", F.col("config.url").alias("url"), F.coalesce(F.size("config.api.headers"), F.lit(-1)).alias("headers"),
        F.col("config.api.body").alias("body"),
    )


REDACTED_RULES = """
SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN 'https://shop.example.com/' || p_partkey || '#f'
  ELSE 'https://u:pw@shop.example.com/' || p_partkey || '?token=x#f' END AS url,
  CASE WHEN p_type = 'ECONOMY' THEN 0 ELSE -1 END AS headers, CASE WHEN p_type = 'ECONOMY' THEN '' END AS body
FROM part
"""


def stored_rules(spark, sf):
    """Catalogues by brand: usable rules, first of equal ids."""
    kept = keep_rules(_rules(spark, sf), ["p_brand"])
    return kept.select("p_brand", "id", "p_partkey")


STORED_RULES = """
WITH ok AS (SELECT p_brand, 'r' || p_partkey % 1000 AS id, p_partkey FROM part
            WHERE p_size % 10 <> 3 AND NOT p_size % 13 = 0 AND NOT (p_size % 3 <> 0 AND p_size % 17 = 1)),
f AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY p_brand, id ORDER BY p_partkey) = 1)
SELECT p_brand, id, p_partkey FROM f
"""


def rule_files(spark, sf):
    """Writes all rules, unusable ones too, to files of 20 and reads the usable ones back."""
    path = work_path(spark, "rules")
    rules = _rules(spark, sf)
    packed = rules.groupBy(F.floor(F.col("p_partkey") / 20).alias("file_no")).agg(
        F.to_json(
            F.transform(
                F.array_sort(
                    F.collect_list(F.struct("pos", "id", "name", "config", "updatedAt")), lambda a, b: a["pos"] - b["pos"]
                ),
                lambda r: F.struct(r["id"].alias("id"), r["name"].alias("name"), r["config"].alias("config"), r["updatedAt"].alias("updatedAt")),
            )
        ).alias("value")
    )
    packed.write.partitionBy("file_no").text(path)
    back = read_rules(spark, path)
    return back.select("id", "name", F.col("config.url").alias("url"), F.size("config.fields").alias("fields"))


RULE_FILES = """
SELECT 'r' || p_partkey % 1000 AS id, p_name AS name,
       CASE WHEN p_type = 'ECONOMY' THEN 'https://shop.example.com/' || p_partkey || '#f' ELSE 'https://u:pw@shop.example.com/' || p_partkey || '?token=x#f' END AS url,
       CAST(2 AS INTEGER) AS fields
FROM part WHERE p_size % 10 <> 3 AND NOT p_size % 13 = 0 AND NOT (p_size % 3 <> 0 AND p_size % 17 = 1)
"""


def rule_edits(spark, sf):
    """Updates rules of one type, deletes those of one brand, clears the pointer if it named one."""
    base = _rules(spark, sf).withColumn("id", F.col("p_partkey").cast("string")).select("pos", "id", "name", "config", "updatedAt", "p_type", "p_brand")
    catalogue = base.drop("p_type", "p_brand")
    changes = base.filter("p_type = 'ECONOMY'").drop("p_type", "p_brand").withColumn("name", F.lit("edited"))
    gone = base.filter("p_brand = 'Brand#5'").select("id")
    edited = delete_rules(upsert_rules(catalogue, changes), gone)
    pointer = clear_pointer(base.select("id", F.lit("last").alias("role")), gone)
    return edited.join(pointer, ["id"]).select("id", "pos", "name", "role")


RULE_EDITS = """
SELECT CAST(p_partkey AS VARCHAR) AS id, CAST(p_partkey AS INTEGER) AS pos,
       CASE WHEN p_type = 'ECONOMY' THEN 'edited' WHEN p_size % 10 = 3 THEN ' ' ELSE p_name END AS name, 'last' AS role
FROM part WHERE p_brand <> 'Brand#5'
"""


def rule_additions(spark, sf):
    """Changes to catalogues by brand: rules of one type are edited, every third part brings a new one."""
    base = _rules(spark, sf).withColumn("id", F.col("p_partkey").cast("string"))
    catalogue = base.select("p_brand", "pos", "id", "name", "config", "updatedAt")
    edited = base.filter("p_type = 'ECONOMY'").withColumn("name", F.lit("edited"))
    fresh = base.filter("p_partkey % 3 = 1").withColumn("id", F.concat(F.lit("n"), "id")).withColumn("name", F.lit("new"))
    changes = edited.unionByName(fresh).select("p_brand", "pos", "id", "name", "config", "updatedAt")
    return upsert_rules(catalogue, changes, ["p_brand"]).select("p_brand", "pos", "id", "name")


RULE_ADDITIONS = """
WITH p AS (SELECT *, max(p_partkey) OVER (PARTITION BY p_brand) AS top FROM part)
SELECT p_brand, CAST(p_partkey AS INTEGER) AS pos, CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_type = 'ECONOMY' THEN 'edited' WHEN p_size % 10 = 3 THEN ' ' ELSE p_name END AS name FROM p
UNION ALL SELECT p_brand, CAST(top + row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INTEGER), 'n' || p_partkey, 'new' FROM p WHERE p_partkey % 3 = 1
"""


def header_policy(spark, sf):
    """Request headers derived from events, checked against the policy."""
    e = table(spark, sf, "events")
    name = (
        F.when(F.col("event_type") == "view", "X-Forwarded-For").when(F.col("event_type") == "error", "Cookie")
        .when(F.col("event_type") == "click", "bad name").when(F.col("event_type") == "signup", "x-a").otherwise("X-Ok")
    )
    value = F.when(F.col("value") < 5, F.concat(F.lit("a"), F.lit("\n"), F.lit("b"))).otherwise(F.col("value").cast("string"))
    df = e.select("event_id", header_violations(F.create_map(name, value, F.lit("X-A"), F.lit("1"))).alias("codes"))
    return unnest(df, ["event_id"], "codes", "pos", "violation")


HEADER_POLICY = """
SELECT event_id, CAST(row_number() OVER (PARTITION BY event_id ORDER BY k) - 1 AS INTEGER) AS pos, violation FROM (
  SELECT event_id, 1 AS k, 'header syntax' AS violation FROM events WHERE event_type = 'click' OR value < 5
  UNION ALL SELECT event_id, 2, 'header repeated' FROM events WHERE event_type = 'signup'
  UNION ALL SELECT event_id, 3, 'header not allowed' FROM events WHERE event_type IN ('view', 'error'))
"""


def preset_lookup(spark, sf):
    """Preset of each page by exact host; every third site of the corpus is a known one."""
    known = F.when(F.col("page_id") % 3 == 0, "https://books.toscrape.com/").when(F.col("page_id") % 3 == 1, "https://QUOTES.toscrape.com/x")
    df = table(spark, sf, "pages").select("page_id", F.coalesce(known, F.col("url")).alias("url")).withColumn("host", host_of(F.col("url")))
    rules = presets(spark).filter("config.url <> ''").select(host_of(F.col("config.url")).alias("host"), F.col("id").alias("preset"))
    return salted_lookup(df, rules, ["host"], "page_id").select("page_id", "preset")


def page_suggestions(spark, sf):
    """Suggested rule of every page."""
    df = suggest_html(with_nodes(pages(spark, sf)))
    return df.select("page_id", "row_selector", "next_selector", F.array_join(F.transform("fields", lambda f: F.concat(f["name"], F.lit("="), f["selector"])), "|").alias("fields"))


SQL_PAGE_FIELDS = """
'标题=h1,h2,h3,h4' || CASE WHEN contains(html, '<a href=') THEN '|链接=a[href]' ELSE '' END || CASE WHEN contains(html, '<p>') THEN '|描述=p' ELSE '' END
"""


def catalogue_suggestions(spark, sf):
    """Suggested rule of product pages, voted per site."""
    df = suggest_html(with_nodes(catalogue_pages(spark, sf))).withColumn("host", host_of(F.col("url")))
    return vote_by_host(df).select(
        "host", "pages", "votes", "row_selector", "next_selector",
        F.array_join(F.transform("fields", lambda f: f["selector"]), "|").alias("fields"),
    )


CATALOGUE_SUGGESTIONS = """
WITH p AS (SELECT count(DISTINCT p_partkey // 20) AS n FROM part)
SELECT 'books.example.com' AS host, n AS pages, CASE WHEN n > 1 THEN n - 1 ELSE n END AS votes, 'article.product_pod' AS row_selector,
       CASE WHEN n > 1 THEN '.next a[href]' ELSE '' END AS next_selector, 'h1,h2,h3,h4|a[href]|[class*="price"]|p' AS fields FROM p
"""


def catalogue_lists(spark, sf):
    """Candidate lists of product pages with their scores."""
    df = with_nodes(catalogue_pages(spark, sf)).select("page_no", html_lists(F.col("nodes")).alias("lists"))
    return unnest(df, ["page_no"], "lists", "rank", "_l").select("page_no", "rank", "_l.selector", "_l.score")


CATALOGUE_LISTS = """
WITH p AS (SELECT p_partkey // 20 AS page_no, count(*) AS n FROM part GROUP BY 1)
SELECT page_no, CAST(0 AS INTEGER) AS rank, 'article.product_pod' AS selector, CAST(130 + least(n, 20) - 2 AS INTEGER) AS score FROM p WHERE n > 1
UNION ALL SELECT page_no, CAST(CASE WHEN n > 1 THEN 1 ELSE 0 END AS INTEGER), 'li', 2 FROM p
"""


def table_fields(spark, sf):
    """Columns of customer tables, one table per ten customers; some headers repeat or are blank."""
    c = table(spark, sf, "customer").withColumn("page_no", F.floor(F.col("c_custkey") / 10))
    row = F.concat(F.lit("<tr><td>"), "c_name", F.lit("<td>"), F.col("c_nationkey").cast("string"), F.lit("<td>"), F.lower("c_mktsegment"), F.lit("</tr>"))
    tables = by_key(c, "page_no").groupBy("page_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", row.alias("row")))), lambda x: x["row"]), "").alias("rows"))
    second = F.when(F.col("page_no") % 3 == 0, "name").when(F.col("page_no") % 3 == 1, " ").otherwise("nation")
    html = F.concat(F.lit("<table><thead><tr><th> name <th>"), second, F.lit("<th>segment</tr></thead><tbody>"), "rows", F.lit("</table>"))
    df = with_nodes(tables.select("page_no", html.alias("html"))).select("page_no", table_columns(F.col("nodes")).alias("fields"))
    return unnest(df, ["page_no"], "fields", "pos", "_f").select("page_no", "pos", "_f.name", "_f.selector")


TABLE_FIELDS = """
WITH p AS (SELECT DISTINCT c_custkey // 10 AS page_no FROM customer)
SELECT page_no, CAST(i AS INTEGER) AS pos, CASE i WHEN 0 THEN 'name' WHEN 2 THEN 'segment' ELSE CASE WHEN page_no % 3 = 2 THEN 'nation' ELSE '列 2' END END AS name,
       'td:nth-of-type(' || (i + 1) || ')' AS selector
FROM (SELECT page_no, unnest([0, 1, 2]) AS i FROM p)
"""


def field_names(spark, sf):
    """Names made unique: blank, repeated, reserved and over-long ones."""
    p = table(spark, sf, "part")

    def field(name):
        return F.struct(name.alias("name"), F.lit("a").alias("selector"), F.lit("text").alias("attribute"))

    long_name = F.repeat(F.col("p_name"), 9)
    fields = F.array(
        field(F.concat(F.lit(" "), "p_name", F.lit(" "))), field(F.col("p_name")), field(F.lit(" ")),
        field(F.when(F.col("p_size") % 2 == 0, "_source").otherwise("字段 3")), field(long_name),
    )
    df = p.select("p_partkey", unique_names(fields).alias("fields"))
    return unnest(df, ["p_partkey"], "fields", "pos", "_f").select("p_partkey", "pos", "_f.name")


FIELD_NAMES = """
WITH n AS (SELECT p_partkey, [p_name, '字段 2', '字段 3', '字段 4', left(repeat(p_name, 9), 40)] AS names FROM part)
SELECT p_partkey, CAST(unnest([0, 1, 2, 3, 4]) AS INTEGER) AS pos, unnest(names) AS name FROM n
"""

def analyzed_pages(spark, sf):
    """Every page analysed, its suggestion applied and probed."""
    suggested, _, _ = analyze(pages_as_responses(pages(spark, sf)))
    return probe_pages(suggested)


def _sql_inner(x: str) -> str:
    return f"trim(regexp_replace({x}, '<[^>]*(>|$)', '', 'g'))"


ANALYZED_PAGES = f"""
WITH a AS (SELECT page_id, html, regexp_extract(html, '(?s)<article>(.*)$', 1) AS rest FROM pages),
p AS (SELECT page_id, list_filter(list_transform(string_split(string_split(rest, '</article>')[1], '<p>')[2:], lambda x: {_sql_inner("string_split(x, '</p>')[1]")}), lambda x: x <> '') AS ps, html FROM a)
SELECT page_id AS response_id, CAST(0 AS INTEGER) AS field_pos, '标题' AS field_name, CAST(1 AS BIGINT) AS sampled, CAST(1 AS BIGINT) AS filled, CAST(100 AS INTEGER) AS hit_rate FROM p
UNION ALL SELECT page_id, 1, '链接', 1, 1, 100 FROM p WHERE contains(html, '<a href=')
UNION ALL SELECT page_id, CASE WHEN contains(html, '<a href=') THEN 2 ELSE 1 END, '描述', 1, CAST(len(ps) > 0 AS INTEGER), CASE WHEN len(ps) > 0 THEN 100 ELSE 0 END FROM p WHERE contains(html, '<p>')
"""


def analysis_reports(spark, sf):
    """The whole report of every page and of customers as JSON, some without records."""
    html = pages_as_responses(pages(spark, sf)).select("response_id", "url", "content_type", "body")
    c = spread(table(spark, sf, "customer"))
    name = F.when(F.col("c_nationkey") % 3 == 0, "").otherwise(F.col("c_name"))
    some = F.concat(F.lit('{"data":{"items":[{"n":'), F.to_json(F.struct(name.alias("x"))), F.lit(',"v":1.50},{"v":"2"}]}}'))
    body = F.when(F.col("c_nationkey") == 7, '{"list":[]}').otherwise(some)
    json = c.select((-F.col("c_custkey")).alias("response_id"), F.lit("https://api.example.com/x?k=1").alias("url"), F.lit("application/json").alias("content_type"), F.encode(body, "UTF-8").alias("body"))
    reports, _ = probe_reports(html.unionByName(json))
    fields = F.array_join(F.transform("fields", lambda f: F.concat(f["name"], F.lit("="), f["filled"].cast("string"))), "|")
    return reports.select("response_id", "source_type", "matched", "sampled", fields.alias("fields"), F.array_join("notes", "|").alias("notes"))


ANALYSIS_REPORTS = f"""
WITH f AS ({ANALYZED_PAGES}),
h AS (SELECT response_id, string_agg(field_name || '=' || filled, '|' ORDER BY field_pos) AS fields,
             string_agg(CASE WHEN filled = 0 THEN '|' || '「' || field_name || '」没有提取到内容，请检查选择器或属性。' END, '' ORDER BY field_pos) AS empty FROM f GROUP BY 1),
c AS (SELECT *, c_nationkey % 3 = 0 AS unnamed, c_nationkey = 7 AS none FROM customer)
SELECT response_id, 'html' AS source_type, CAST(1 AS INTEGER) AS matched, CAST(1 AS INTEGER) AS sampled, fields, '{NOTE_HTML}|{NOTE_HTML_NO_LIST}' || coalesce(empty, '') AS notes FROM h
UNION ALL
SELECT -c_custkey, 'json', CASE WHEN none THEN 0 ELSE 2 END, CASE WHEN none THEN 0 ELSE 2 END,
  CASE WHEN none THEN '值=0' WHEN unnamed THEN 'n.x=0|v=2' ELSE 'n.x=1|v=2' END,
  '{NOTE_JSON}|' || CASE WHEN none THEN '{NOTE_JSON_EMPTY}|' ELSE '' END || '{NOTE_JSON_KEYS}'
  || CASE WHEN none THEN '|{WARN_NO_RECORD_JSON}' WHEN unnamed THEN '|「n.x」没有提取到内容，请核对 JSON 路径。' ELSE '' END
FROM c
"""


def analyzed_documents(spark, sf):
    """Customers as JSON, cut-off JSON and other responses: suggestions applied and probed, rejects listed."""
    c = spread(table(spark, sf, "customer"))
    name = F.when(F.col("c_nationkey") % 3 == 0, "").otherwise(F.col("c_name"))
    doc = F.concat(F.lit('{"data":{"items":[{"n":'), F.to_json(F.struct(name.alias("x"))), F.lit(',"v":1.50},{"v":"2"}]}}'))
    body = F.when(F.col("c_nationkey") == 7, F.substring(doc, 1, 20)).when(F.col("c_nationkey") == 8, "plain").otherwise(doc)
    responses = c.select(
        F.col("c_custkey").alias("response_id"), F.lit("https://api.example.com/x?k=1").alias("url"),
        F.lit("text/plain").alias("content_type"), F.encode(body, "UTF-8").alias("body"),
    )
    _, documents, rejected = analyze(responses)
    return probe_documents(documents).select("response_id", "field_name", "sampled", "filled", "hit_rate").unionByName(
        rejected.select(
            "response_id", F.col("reject_reason").alias("field_name"), F.lit(0).cast("long").alias("sampled"),
            F.lit(0).cast("long").alias("filled"), F.lit(0).alias("hit_rate"),
        )
    )


ANALYZED_DOCUMENTS = """
WITH c AS (SELECT c_custkey AS response_id, c_nationkey AS n FROM customer)
SELECT response_id, 'n.x' AS field_name, CAST(2 AS BIGINT) AS sampled, CAST(CASE WHEN n % 3 = 0 THEN 0 ELSE 1 END AS BIGINT) AS filled,
       CAST(CASE WHEN n % 3 = 0 THEN 0 ELSE 50 END AS INTEGER) AS hit_rate FROM c WHERE n NOT IN (7, 8)
UNION ALL SELECT response_id, 'v', 2, 2, 100 FROM c WHERE n NOT IN (7, 8)
UNION ALL SELECT response_id, CASE WHEN n = 7 THEN 'invalid JSON' ELSE 'not HTML or JSON' END, 0, 0, 0 FROM c WHERE n IN (7, 8)
"""

QUERIES = {
    "analyzed_pages": (analyzed_pages, ANALYZED_PAGES),
    "analyzed_documents": (analyzed_documents, ANALYZED_DOCUMENTS),
    "rule_violations": (rule_violations, RULE_VIOLATIONS),
    "rule_normal_form": (rule_normal_form, RULE_NORMAL_FORM),
    "redacted_rules": (redacted_rules, REDACTED_RULES),
    "stored_rules": (stored_rules, STORED_RULES),
    "rule_files": (rule_files, RULE_FILES),
    "analysis_reports": (analysis_reports, ANALYSIS_REPORTS),
    "rule_additions": (rule_additions, RULE_ADDITIONS),
    "rule_edits": (rule_edits, RULE_EDITS),
    "header_policy": (header_policy, HEADER_POLICY),
    "preset_lookup": (preset_lookup, "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'books' WHEN 1 THEN 'quotes' END AS preset FROM pages"),
    "page_suggestions": (
        page_suggestions,
        f"SELECT page_id, '' AS row_selector, '' AS next_selector, trim({SQL_PAGE_FIELDS}, chr(10)) AS fields FROM pages",
    ),
    "catalogue_suggestions": (catalogue_suggestions, CATALOGUE_SUGGESTIONS),
    "catalogue_lists": (catalogue_lists, CATALOGUE_LISTS),
    "table_fields": (table_fields, TABLE_FIELDS),
    "field_names": (field_names, FIELD_NAMES),
}
