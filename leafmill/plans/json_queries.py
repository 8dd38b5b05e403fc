"""Registered queries: JSON extraction and inference over JSON bodies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.jsonpath import normalize_path
from ..functions.text import unnest
from ..operators.gates import split_rejects
from ..operators.infer import json_lists, suggest_json
from ..operators.json_records import extract_json, extract_json_page, json_bodies
from .common import by_key, spread, table


def json_props(spark, sf):
    events = spread(table(spark, sf, "events")).withColumn("url", F.lit("https://api.example.com/events?key=secret"))
    rule = {"rowSelector": "$", "fields": [{"name": "k", "selector": "k"}, {"name": "whole", "selector": "$"}, {"name": "none", "selector": "k.x"}]}
    docs = events.select("event_id", F.col("props").alias("doc"), "url")
    return extract_json(docs, rule, ["event_id"])


JSON_PROPS = """
SELECT event_id, CAST(0 AS INTEGER) AS row_pos, json_extract_string(props, '$.k') AS k, replace(props, '": ', '":') AS whole, '' AS none,
       'https://api.example.com/events' AS _source
FROM events
"""



def order_bodies(spark, sf):
    """API bodies of 25 orders each; o_orderkey is unique, so a body has a fixed size."""
    orders = table(spark, sf, "orders").withColumn("body_no", F.floor(F.col("o_orderkey") / 25))
    item = F.to_json(
        F.struct(
            F.col("o_orderkey").alias("id"),
            F.struct(F.col("o_custkey").alias("key"), F.col("o_orderstatus").alias("status")).alias("customer"),
            F.col("o_totalprice").cast("decimal(14,2)").alias("total"),
            F.col("o_orderpriority").alias("priority"),
            (F.col("o_orderstatus") == "F").alias("final"),
            F.array("o_orderstatus", F.substring("o_orderpriority", 1, 1)).alias("tags"),
        )
    )
    bodies = by_key(orders, "body_no").groupBy("body_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", item.alias("item")))), lambda x: x["item"]), ",").alias("items")
    )
    return bodies.select(
        "body_no",
        F.concat(F.lit("https://api.example.com/orders?page="), F.col("body_no").cast("string"), F.lit("&token=t")).alias("url"),
        F.lit(200).alias("status"),
        F.lit("application/json").alias("content_type"),
        F.encode(F.concat(F.lit('﻿{"data":{"items":['), "items", F.lit("]}}")), "UTF-8").alias("body"),
    )


ORDER_RULE = {
    "rowSelector": "data.items",
    "fields": [
        {"name": "id", "selector": "id"},
        {"name": "customer", "selector": "customer.key"},
        {"name": "status", "selector": "$.customer.status"},
        {"name": "total", "selector": "total"},
        {"name": "priority", "selector": "priority"},
        {"name": "final", "selector": "final"},
        {"name": "tag2", "selector": "tags[1]"},
        {"name": "tags", "selector": "tags"},
        {"name": "n_tags", "selector": "tags.length"},
        {"name": "missing", "selector": "customer.name"},
    ],
}


def json_api_roundtrip(spark, sf):
    good, _ = split_rejects(json_bodies(order_bodies(spark, sf)))
    return extract_json(good, ORDER_RULE, ["body_no"])


JSON_API_ROUNDTRIP = """
SELECT o_orderkey // 25 AS body_no,
       CAST(row_number() OVER (PARTITION BY o_orderkey // 25 ORDER BY o_orderkey) - 1 AS INTEGER) AS row_pos,
       CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS customer, o_orderstatus AS status,
       regexp_replace(regexp_replace(CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS VARCHAR), '(\\.\\d*?)0+$', '\\1'), '\\.$', '') AS total,
       o_orderpriority AS priority, CASE WHEN o_orderstatus = 'F' THEN 'true' ELSE 'false' END AS final,
       o_orderpriority[1] AS tag2, '["' || o_orderstatus || '","' || o_orderpriority[1] || '"]' AS tags, '2' AS n_tags,
       '' AS missing, 'https://api.example.com/orders' AS _source
FROM orders
"""


def json_kinds(spark, sf):
    """Bodies whose spelling matters: duplicate names, numbers in strings, numbers with needless digits, nested texts.

    A line item's quantity is written with a fraction of zero, its price as a string with two digits, and its
    tax twice; every seventh body names the list twice, and then only the last one counts.
    """
    lines = spread(table(spark, sf, "lineitem"))
    quantity = F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(".0"))
    price = F.col("l_extendedprice").cast("decimal(14,2)").cast("string")
    tax = F.col("l_tax").cast("decimal(4,2)").cast("string")
    item = F.concat(
        F.lit('{"quantity":'), quantity, F.lit(',"price":"'), price, F.lit('","tax":9.99,"flag":"'), "l_returnflag",
        F.lit('","z":{"b":['), quantity, F.lit(',"'), price, F.lit('"],"a":"\\"1.0\\""},"tax":'), tax, F.lit(',"7":[1e3]}'),
    )
    lists = F.concat(F.lit('"items":[null,'), item, F.lit(","), item, F.lit("]"))
    twice = F.when(F.col("l_orderkey") % 7 == 0, '"items":[{"quantity":5}],').otherwise("")
    docs = lines.select(
        "l_orderkey", "l_linenumber", F.concat(F.lit("{"), twice, lists, F.lit("}")).alias("doc"), F.lit("https://api.example.com/lines?k=1").alias("url")
    )
    paths = {"quantity": "quantity", "price": "price", "tax": "tax", "nested": "z", "second": "z.b[1]", "first": "z.b[0]", "n": "z.b.length", "seven": "[7]", "deep": "[7][0]", "text": "z.a"}
    rule = {"rowSelector": "items", "fields": [{"name": n, "selector": p} for n, p in paths.items()]}
    return extract_json(docs, rule, ["l_orderkey", "l_linenumber"])


JSON_KINDS = r"""
WITH b AS (
  SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS q, CAST(CAST(l_extendedprice AS DECIMAL(14,2)) AS VARCHAR) AS p,
         CAST(CAST(l_tax AS DECIMAL(4,2)) AS VARCHAR) AS t FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(i AS INTEGER) AS row_pos, 'https://api.example.com/lines' AS _source,
  CASE WHEN i > 0 THEN q ELSE '' END AS quantity, CASE WHEN i > 0 THEN p ELSE '' END AS price,
  CASE WHEN i > 0 THEN regexp_replace(regexp_replace(t, '0+$', ''), '\.$', '') ELSE '' END AS tax,
  CASE WHEN i > 0 THEN '{"b":[' || q || ',"' || p || '"],"a":"\"1.0\""}' ELSE '' END AS nested,
  CASE WHEN i > 0 THEN p ELSE '' END AS second, CASE WHEN i > 0 THEN q ELSE '' END AS first, CASE WHEN i > 0 THEN '2' ELSE '' END AS n,
  CASE WHEN i > 0 THEN '[1000]' ELSE '' END AS seven, CASE WHEN i > 0 THEN '1000' ELSE '' END AS deep, CASE WHEN i > 0 THEN '"1.0"' ELSE '' END AS text
FROM (SELECT *, unnest([0, 1, 2]) AS i FROM b)
"""


def json_body_rejects(spark, sf):
    """Malformed bodies are rejected: every customer whose balance is negative has a cut-off body."""
    c = spread(table(spark, sf, "customer"))
    whole = F.to_json(F.struct("c_custkey", "c_name"))
    text = F.when(F.col("c_acctbal") < 0, F.substring(whole, 1, 12)).otherwise(whole)
    _, bad = split_rejects(json_bodies(c.select("c_custkey", F.encode(text, "UTF-8").alias("body"))))
    return bad.select("c_custkey", "doc", "reject_reason")


JSON_BODY_REJECTS = """
SELECT c_custkey, left('{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '"}', 12) AS doc, 'invalid JSON' AS reject_reason
FROM customer WHERE c_acctbal < 0
"""


def _customer_docs(spark, sf):
    """Objects with optional members; a negative balance leaves out the profile, nation 0 is null."""
    c = spread(table(spark, sf, "customer"))
    profile = F.when(
        F.col("c_acctbal") >= 0,
        F.struct(F.col("c_mktsegment").alias("segment"), F.when(F.col("c_nationkey") > 0, F.col("c_nationkey")).alias("nation")),
    )
    return c.select(
        "c_custkey",
        F.concat(F.lit("https://api.example.com/c/"), F.col("c_custkey").cast("string"), F.lit("?k=1")).alias("url"),
        F.to_json(F.struct(F.struct(F.col("c_name").alias("name"), profile.alias("profile")).alias("customer"))).alias("doc"),
    )


OBJECT_RULE = {
    "rowSelector": "customer",
    "fields": [
        {"name": "name", "selector": "name"},
        {"name": "segment", "selector": "profile.segment"},
        {"name": "nation", "selector": "profile.nation"},
    ],
}


def json_missing_object(spark, sf):
    return extract_json(_customer_docs(spark, sf), OBJECT_RULE, ["c_custkey"])


JSON_MISSING_OBJECT = """
SELECT c_custkey, CAST(0 AS INTEGER) AS row_pos, c_name AS name,
       CASE WHEN c_acctbal >= 0 THEN c_mktsegment ELSE '' END AS segment,
       CASE WHEN c_acctbal >= 0 AND c_nationkey > 0 THEN CAST(c_nationkey AS VARCHAR) ELSE '' END AS nation,
       'https://api.example.com/c/' || c_custkey AS _source
FROM customer
"""


def json_page_warnings(spark, sf):
    pages = extract_json_page(_customer_docs(spark, sf), {**OBJECT_RULE, "rowSelector": "customer.profile", "fields": [{"name": "nation", "selector": "nation"}]})
    return unnest(pages, ["c_custkey", "matched", "title"], "warnings", "pos", "message")


JSON_PAGE_WARNINGS = """
SELECT c_custkey, CAST(CASE WHEN c_acctbal >= 0 THEN 1 ELSE 0 END AS INTEGER) AS matched, 'api.example.com' AS title,
       CAST(0 AS INTEGER) AS pos,
       CASE WHEN c_acctbal >= 0 THEN '「nation」没有提取到内容，请核对 JSON 路径。'
            ELSE '数据路径没有匹配到记录，可能已到最后一页，请核对接口返回结构。' END AS message
FROM customer WHERE NOT (c_acctbal >= 0 AND c_nationkey > 0)
"""


def json_paths(spark, sf):
    """Path check over paths derived from the part table, good and bad forms by brand."""
    p = table(spark, sf, "part")
    word = F.element_at(F.split("p_name", " "), 1)
    shape = F.pmod(F.col("p_size"), F.lit(6))
    path = (
        F.when(shape == 0, F.concat(F.lit("$."), word, F.lit("["), F.col("p_partkey").cast("string"), F.lit("].名")))
        .when(shape == 1, F.concat(F.lit(" "), word, F.lit(".a-b ")))
        .when(shape == 2, F.concat(F.lit("$"), word))
        .when(shape == 3, F.concat(word, F.lit("..x")))
        .when(shape == 4, F.concat(word, F.lit(".constructor")))
        .otherwise(F.concat(F.lit("["), F.col("p_partkey").cast("string"), F.lit("]."), word))
    )
    return p.select("p_partkey", normalize_path(path).alias("path"))


JSON_PATHS = """
SELECT p_partkey, CASE p_size % 6
  WHEN 0 THEN '$.' || split_part(p_name, ' ', 1) || '[' || p_partkey || '].名'
  WHEN 1 THEN '$.' || split_part(p_name, ' ', 1) || '.a-b'
  WHEN 5 THEN '$[' || p_partkey || '].' || split_part(p_name, ' ', 1) END AS path
FROM part
"""


def _ranked_docs(spark, sf):
    """Documents with two lists; which one wins depends on the customer's balance and nation."""
    c = spread(table(spark, sf, "customer"))
    return c.select(
        "c_custkey",
        F.concat(
            F.lit('{"meta":[1,2,3],"outer":{"rows":['),
            F.array_join(F.array_repeat(F.to_json(F.struct(F.col("c_name").alias("name"), F.struct(F.col("c_nationkey").alias("id")).alias("nation"))), F.pmod(F.col("c_nationkey"), F.lit(4)).cast("int")), ","),
            F.lit(']},"list":['),
            F.when(F.col("c_acctbal") >= 0, '{"q":1},{"w":{"e":{"r":{"t":1}}}}').otherwise('"x","y"'),
            F.lit("]}"),
        ).alias("doc"),
    )


def json_list_rank(spark, sf):
    """Every candidate list of every document with its score."""
    df = json_lists(_ranked_docs(spark, sf), max_depth=5)
    rows = unnest(df, ["c_custkey"], "lists", "pos", "_l")
    return rows.select("c_custkey", "pos", "_l.path", "_l.score")


JSON_LIST_RANK = """
WITH d AS (SELECT c_custkey, c_nationkey % 4 AS n, c_acctbal >= 0 AS rich FROM customer)
SELECT c_custkey, CAST(0 AS INTEGER) AS pos, 'meta' AS path, CAST(2 AS INTEGER) AS score FROM d
UNION ALL SELECT c_custkey, 1, 'outer.rows', CAST(CASE WHEN n > 0 THEN 100 ELSE 0 END + n - 2 AS INTEGER) FROM d
UNION ALL SELECT c_custkey, 2, 'list', CAST(CASE WHEN rich THEN 100 ELSE 0 END + 1 AS INTEGER) FROM d
"""


def json_suggestions(spark, sf):
    df = suggest_json(_ranked_docs(spark, sf), list_depth=5, field_depth=3)
    return df.select(
        "c_custkey", "row_selector",
        F.array_join(F.transform("fields", lambda f: F.concat(f["name"], F.lit("="), f["selector"])), "|").alias("fields"),
    )


JSON_SUGGESTIONS = """
WITH d AS (SELECT c_custkey, CASE WHEN c_nationkey % 4 > 0 THEN 100 ELSE 0 END + c_nationkey % 4 - 2 AS outer_score,
                  CASE WHEN c_acctbal >= 0 THEN 101 ELSE 1 END AS list_score, c_acctbal >= 0 AS rich FROM customer),
b AS (SELECT *, CASE WHEN 2 >= outer_score AND 2 >= list_score THEN 'meta'
                     WHEN outer_score >= list_score THEN 'outer.rows' ELSE 'list' END AS row_selector FROM d)
SELECT c_custkey, row_selector,
       CASE row_selector WHEN 'meta' THEN '值=$' WHEN 'outer.rows' THEN 'name=name|nation.id=nation.id'
            ELSE CASE WHEN rich THEN 'q=q|w.e.r=w.e.r' ELSE '值=$' END END AS fields
FROM b
"""

def json_deep_suggestions(spark, sf):
    """Lists eight names deep, with fields five names deep."""
    c = spread(table(spark, sf, "customer"))
    item = F.concat(F.lit('{"id":'), "c_custkey", F.lit(',"a":{"b":{"c":{"d":{"e":"'), "c_mktsegment", F.lit('","f":['), "c_nationkey", F.lit("]}}}},\"z{\":1}"))
    rows = F.array_join(F.array_repeat(item, F.pmod("c_nationkey", F.lit(3)).cast("int")), ",")
    deep = F.concat(F.lit('{"l":[1,2,"{["],"p1":{"p2":{"p3":{"p4":{"p5":{"p6":{"p7":{"p8":['), rows, F.lit("]}}}}}}}}}"))
    df = suggest_json(c.select("c_custkey", deep.alias("doc")))
    return df.select("c_custkey", "row_selector", F.array_join(F.transform("fields", lambda f: F.concat(f["name"], F.lit("="), f["selector"])), "|").alias("fields"))


JSON_DEEP_SUGGESTIONS = """
SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN 'l' ELSE 'p1.p2.p3.p4.p5.p6.p7.p8' END AS row_selector,
       CASE WHEN c_nationkey % 3 = 0 THEN '值=$' ELSE 'id=id|a.b.c.d.e=a.b.c.d.e|a.b.c.d.f=a.b.c.d.f' END AS fields
FROM customer
"""

QUERIES = {
    "json_deep_suggestions": (json_deep_suggestions, JSON_DEEP_SUGGESTIONS),
    "json_props": (json_props, JSON_PROPS),
    "json_api_roundtrip": (json_api_roundtrip, JSON_API_ROUNDTRIP),
    "json_kinds": (json_kinds, JSON_KINDS),
    "json_body_rejects": (json_body_rejects, JSON_BODY_REJECTS),
    "json_missing_object": (json_missing_object, JSON_MISSING_OBJECT),
    "json_page_warnings": (json_page_warnings, JSON_PAGE_WARNINGS),
    "json_paths": (json_paths, JSON_PATHS),
    "json_list_rank": (json_list_rank, JSON_LIST_RANK),
    "json_suggestions": (json_suggestions, JSON_SUGGESTIONS),
}
