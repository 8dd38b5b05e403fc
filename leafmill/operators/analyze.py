"""Analysis of unknown responses: classify, suggest a rule, apply it and probe the outcome."""

from __future__ import annotations

import functools
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import selectors
from ..functions.jsonpath import JsonPlace, json_cell, json_records, normalize_path, parsed
from ..functions.selectors import BRANCHES, selector_rows
from ..functions.text import is_blank, let, unnest
from .gates import classify, decode_text, decode_utf8, gate, split_rejects
from .html import extract_html_multi, with_html_records, with_nodes
from .infer import suggest_html, suggest_json
from .json_records import with_json_records
from .profile import hit_rate

for module in (fixed, selectors, sys.modules[__name__]):
    cloudpickle.register_pickle_by_value(module)


_TEST = ("kind", "name", "op", "value", "a", "b")


@functools.lru_cache(maxsize=4096)
def _shaped(text: str) -> list:
    """A selector in the layout of BRANCHES, with field names."""

    def plain(t):
        return dict(zip(_TEST, t))

    return [
        [
            {
                "comb": comb,
                "anchor": dict(zip(("kind", "name", "value"), anchor)),
                "tests": [
                    {**plain(t), "groups": [{"rel": rel, "tests": [plain(i) for i in inner]} for rel, inner in t[6]]}
                    for t in tests
                ],
            }
            for comb, anchor, tests in branch
        ]
        for branch in selector_rows(text)
    ]


def _compiled(texts: pa.Array) -> pa.Array:
    simple = pa.struct([(n, pa.int32() if n in "ab" else pa.string()) for n in _TEST])
    groups = pa.list_(pa.struct([("rel", pa.string()), ("tests", pa.list_(simple))]))
    anchor = pa.struct([(n, pa.string()) for n in ("kind", "name", "value")])
    step = pa.struct([("comb", pa.string()), ("anchor", anchor), ("tests", pa.list_(pa.struct([*simple, pa.field("groups", groups)])))])
    rows = [[_shaped(t or "") for t in row or []] for row in texts.to_pylist()]
    return pa.array(rows, pa.list_(pa.list_(pa.list_(step))))


def compiled_selectors(texts: Column) -> Column:
    """An array of selector texts in evaluated form (type BRANCHES each); short texts, read once each."""
    return F.arrow_udf(_compiled, f"array<{BRANCHES}>").asNondeterministic()(texts)


def analyze(responses: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(HTML pages with their suggestion, JSON documents with theirs, rejected responses).

    ``responses`` has (response_id, url, content_type, body). Pages keep ``nodes``, documents ``doc``.
    """
    kinds = classify(responses)
    unknown = gate(kinds, F.when(F.col("kind").isNull(), "not HTML or JSON"))
    known, rejected = split_rejects(unknown)
    html = known.filter("kind = 'html'").withColumn("html", decode_text(F.col("content_type"), F.col("body"))).drop("body")
    pages = suggest_html(with_nodes(html), keep_nodes=True)
    docs = known.filter("kind = 'json'").withColumn("doc", decode_utf8(F.col("body"))).drop("body")
    good, broken = split_rejects(gate(parsed(docs), F.when(F.col("parsed").isNull(), "invalid JSON")))
    reasons = rejected.select("response_id", "reject_reason").unionByName(broken.select("response_id", "reject_reason"))
    return pages, suggest_json(good), reasons


def _own_rules(suggested: DataFrame) -> DataFrame:
    """Pages with their own suggestion in evaluated form, as ``extract_html_multi`` wants it."""
    texts = F.concat(F.array("row_selector"), F.transform("fields", lambda f: f["selector"]))
    compiled = suggested.withColumn("_sels", compiled_selectors(texts))

    def field(f: Column, i: Column) -> Column:
        own = f["selector"] == ":scope"
        return F.struct(
            f["name"].alias("name"), f["attribute"].alias("attribute"), own.alias("scoped"), own.alias("own"),
            F.get(F.col("_sels"), i + 1).alias("sel"),
        )

    return compiled.withColumnsRenamed({"fields": "suggested_fields"}).withColumns(
        {"rule_id": F.lit("suggested"), "row_sel": F.get(F.col("_sels"), F.lit(0)), "fields": F.transform("suggested_fields", field)}
    ).drop("_sels")


def probe_pages(suggested: DataFrame) -> DataFrame:
    """Applies each page's own suggestion: (response_id, field_pos, field_name, sampled, filled, hit_rate).

    A page keeps its nodes from the analysis, so it is shredded once and nothing moves before the
    final counts.
    """
    routed = _own_rules(suggested).select("response_id", "url", "nodes", "rule_id", "row_sel", "fields")
    return _filled(extract_html_multi(routed, ["response_id"]))


REPORT_COLUMNS = ("response_id", "source_type", "matched", "sampled", "fields", "row_selector", "next_selector", "notes")


def probe_reports(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reports, rejected responses): what the analysis of each response suggests and what it would give.

    A report has source_type, matched, sampled, fields (name, selector, attribute, filled), the suggested
    selectors and notes: those of the analysis, then the warnings of the extraction. One row per response,
    nothing moves.
    """
    pages, documents, rejected = analyze(responses)
    routed = with_html_records(_own_rules(pages))
    html = _report(
        routed, "html", F.col("_records"), F.size("_containers"),
        [F.lit(fixed.NOTE_HTML), F.when(F.col("row_selector") == "", fixed.NOTE_HTML_NO_LIST)], fixed.WARN_NO_CONTAINER, fixed.WARN_EMPTY_FIELD_HTML,
    )
    docs = documents if "parsed" in documents.columns else parsed(documents)
    paths = F.transform("suggested_fields", lambda f: F.struct(f["name"].alias("name"), normalize_path(f["selector"]).alias("path")))
    docs = docs.withColumnRenamed("fields", "suggested_fields").withColumns({"json_rows": normalize_path(F.col("row_selector")), "json_fields": paths})
    listed = with_json_records(docs)
    json = _report(
        listed, "json", F.col("_json_records"), F.size("_items"),
        [F.lit(fixed.NOTE_JSON), F.when(F.size("_items") == 0, fixed.NOTE_JSON_EMPTY), F.lit(fixed.NOTE_JSON_KEYS)], fixed.WARN_NO_RECORD_JSON, fixed.WARN_EMPTY_FIELD_JSON,
    )
    return html.unionByName(json), rejected


def _report(df: DataFrame, kind: str, records: Column, matched: Column, notes: list[Column], none: str, empty: str) -> DataFrame:
    def filled(f: Column, i: Column) -> Column:
        n = F.size(F.filter(records, lambda r: ~is_blank(F.get(r, i)["value"])))
        return F.struct(f["name"].alias("name"), f["selector"].alias("selector"), f["attribute"].alias("attribute"), n.alias("filled"))

    counted = df.withColumn("_found", F.transform("suggested_fields", filled)).withColumn("_kept", records).withColumn("matched", matched)
    blank = F.filter("_found", lambda f: F.exists("_kept", lambda r: F.lit(True)) & F.forall("_kept", lambda r: F.forall(r, lambda c: (c["name"] != f["name"]) | (c["value"] == ""))))
    warned = F.concat(F.array(F.when(F.col("matched") == 0, none)), F.transform(blank, lambda f: F.format_string(empty, f["name"])))
    said = F.filter(F.concat(F.array(*notes), warned), lambda n: n.isNotNull())
    return counted.select(
        "response_id", F.lit(kind).alias("source_type"), "matched", F.size("_kept").alias("sampled"), F.col("_found").alias("fields"),
        "row_selector", "next_selector", said.alias("notes"),
    )


def _filled(values: DataFrame) -> DataFrame:
    counted = values.groupBy("response_id", "field_pos", "field_name").agg(
        F.count(F.lit(1)).alias("sampled"), F.count_if(~is_blank(F.col("value"))).alias("filled")
    )
    return counted.withColumn("hit_rate", hit_rate(F.col("filled"), F.col("sampled")))


def probe_documents(suggested: DataFrame) -> DataFrame:
    """Applies each document's own suggestion, in the same layout as ``probe_pages``."""
    docs = suggested if "parsed" in suggested.columns else parsed(suggested)
    items = json_records(F.col("parsed"), JsonPlace.at(normalize_path(F.col("row_selector"))))
    records = unnest(docs, ["response_id", "url", "fields"], items, "row_pos", "_record")
    cells = unnest(records, ["response_id", "row_pos", "_record"], "fields", "field_pos", "_f")
    text = let(normalize_path(F.col("_f.selector")), lambda p: json_cell(F.col("_record"), JsonPlace.at(p))["text"])
    values = cells.select(
        "response_id", "row_pos", "field_pos", F.col("_f.name").alias("field_name"), F.coalesce(text, F.lit("")).alias("value")
    )
    return _filled(values)
