"""One pass from landed responses to records, pages, warnings and rejected responses, under a catalogue of rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import (
    WARN_EMPTY_FIELD_HTML,
    WARN_EMPTY_FIELD_JSON,
    WARN_NEXT_INVALID,
    WARN_NEXT_OTHER_ORIGIN,
    WARN_NO_CONTAINER,
    WARN_NO_RECORD_JSON,
)
from ..functions.jsonpath import normalize_path, parsed
from ..functions.selectors import select_by
from ..functions.shred import shred
from ..functions.text import let, trim_all
from ..functions.urls import host_of, is_other_scheme, origin_of, parse_url, resolve_url, strip_query
from ..session import work_path, write_by
from .analyze import compiled_selectors
from .frontier import salted_lookup
from .gates import content_type_reason, decode_text, decode_utf8, gate, gate_size, gate_status
from .html import page_bytes_text, page_title, records_as_maps, row_cap_text, rows_within_bytes, with_html_records
from .json_records import json_plan, with_json_records

TAGS = ("record", "page", "warning", "reject")
_SINK = {
    "pos": "int", "cells": "array<struct<name:string,value:string>>", "title": "string", "rows": "int", "matched": "int", "bytes": "long",
    "next_url": "string", "last": "boolean", "message": "string",
}


def compile_catalogue(rules: DataFrame) -> DataFrame:
    """Stored rules (id, config) in evaluated form, one row per rule: its host, and for HTML rules the
    selectors, for JSON rules the paths. Selectors are read in the job, so a catalogue may be of any size."""
    c = F.col("config")
    texts = F.concat(F.array(c["rowSelector"], c["nextSelector"]), F.transform(c["fields"], lambda f: f["selector"]))
    is_json = F.coalesce(c["sourceType"], F.lit("html")) == "json"
    compiled = rules.withColumn("_sels", compiled_selectors(F.when(~is_json, F.transform(texts, lambda t: F.trim(F.coalesce(t, F.lit(""))))).otherwise(F.array().cast("array<string>"))))

    def scoped(selector: Column) -> Column:
        return F.coalesce(F.exists(selector, lambda steps: F.exists(F.get(steps, F.lit(0))["tests"], lambda t: t["kind"] == "scope")), F.lit(False))

    def field(f: Column, i: Column) -> Column:
        selector = F.get(F.col("_sels"), i + 2)
        return F.struct(f["name"].alias("name"), f["attribute"].alias("attribute"), scoped(selector).alias("scoped"), (F.trim(f["selector"]) == ":scope").alias("own"), selector.alias("sel"))

    return compiled.select(
        F.col("id").alias("rule_id"),
        host_of(c["url"]).alias("host"),
        F.when(is_json, "json").otherwise("html").alias("source_type"),
        F.get("_sels", F.lit(0)).alias("row_sel"),
        F.get("_sels", F.lit(1)).alias("next_sel"),
        F.transform(c["fields"], field).alias("fields"),
        F.when(is_json, normalize_path(F.coalesce(c["rowSelector"], F.lit("")))).alias("json_rows"),
        F.when(is_json, F.transform(c["fields"], lambda f: F.struct(f["name"].alias("name"), normalize_path(f["selector"]).alias("path")))).alias("json_fields"),
    ).withColumn("json_plan", json_plan(F.col("json_fields")))


@dataclass(frozen=True)
class Collected:
    """The sinks of one job, all read from one table that has a folder for each of them."""

    table: DataFrame
    keys: list[str]

    def _sink(self, tag: str, *columns) -> DataFrame:
        return self.table.where(F.col("tag") == tag).select(*self.keys, "rule_id", F.col("source").alias("_source"), *columns)

    def records(self) -> DataFrame:
        """Long form: row_pos, field_pos, field_name, value."""
        rows = self._sink("record", F.col("pos").alias("row_pos"), F.posexplode("cells").alias("field_pos", "_c"))
        return rows.select(*self.keys, "rule_id", "_source", "row_pos", "field_pos", F.col("_c.name").alias("field_name"), F.col("_c.value").alias("value"))

    def record_maps(self) -> DataFrame:
        """One row per record, its values by field name."""
        return self._sink("record", F.col("pos").alias("row_pos"), F.map_from_entries("cells").alias("record"))

    def pages(self) -> DataFrame:
        return self._sink("page", "title", "rows", "matched", "bytes", "next_url", "last")

    def warnings(self) -> DataFrame:
        return self._sink("warning", "pos", "message")

    def rejects(self) -> DataFrame:
        return self._sink("reject", F.col("message").alias("reject_reason"))

    def runs(self, run: str = "run_id") -> DataFrame:
        """Per run: pages, rows, bytes, different warnings, rejected responses. One aggregation over all sinks."""
        is_ = lambda tag: F.col("tag") == tag
        return self.table.groupBy(run).agg(
            F.count_if(is_("page")).alias("pages"),
            F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
            F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
            F.count_distinct(F.when(is_("warning"), F.col("message"))).alias("warnings"),
            F.count_if(is_("reject")).alias("rejects"),
        )


def collect(
    responses: DataFrame,
    rules: DataFrame,
    keys: list[str],
    *,
    max_body_bytes: int | None = None,
    max_rows: int | None = None,
    max_chars: int | None = None,
    max_bytes: int | None = None,
) -> Collected:
    """Gates, decodes and extracts every response under each rule of its host, and writes all that comes
    out of it once.

    ``responses`` has the columns of RESPONSES; ``keys`` are those that go on. ``rules`` are stored rules
    (``read_rules``), of either source type. A response is read, routed, shredded or parsed once; its records,
    its page entry, its warnings and what speaks against it are rows of one table below the shared folder,
    which the sinks of the result read.

    A response without a rule, with a bad status, type, size or JSON is rejected with the reason. Limits
    hold only where they are asked for. ``last`` marks the page behind which its run ends: an empty JSON
    page, or one whose next link is missing, invalid or leads to another site.
    """
    catalogue = compile_catalogue(rules)
    keyed = responses.withColumn("host", host_of(F.col("url")))
    routed = salted_lookup(keyed, catalogue, ["host"], "url").drop("host")
    is_json = F.col("source_type") == "json"
    gated = gate(routed, F.when(F.col("rule_id").isNull(), "no rule for the host"))
    gated = gate_size(gate_status(gated), max_body_bytes)
    gated = gate(gated, F.when(is_json, content_type_reason(F.col("content_type"), "json")).otherwise(content_type_reason(F.col("content_type"), "html")))
    sound = F.col("reject_reason").isNull()
    html = F.when(sound & ~is_json, decode_text(F.col("content_type"), F.col("body")))
    read = gated.withColumn("doc", F.when(sound & is_json, decode_utf8(F.col("body")))).withColumn("nodes", shred(html)).drop("body")
    read = gate(parsed(read), F.when(sound & is_json & F.col("parsed").isNull(), "invalid JSON"))
    read = read.withColumn("_source", F.when(is_json, strip_query(F.col("url"))).otherwise(F.col("url")))
    extracted = with_json_records(with_html_records(read, max_rows=max_rows, max_chars=max_chars), max_rows=max_rows, max_chars=max_chars)
    whole = F.when(is_json, F.col("_json_records")).otherwise(F.col("_records"))
    paged = extracted.withColumn("_all", whole).withColumn("_matched", F.when(is_json, F.size("_items")).otherwise(F.size("_containers")))
    kept = F.col("_all") if max_bytes is None else F.slice("_all", 1, rows_within_bytes(records_as_maps(F.col("_all"), F.col("_source")), max_bytes))
    paged = paged.withColumn("_kept", kept).withColumn("_next", F.when(~is_json & (F.size("next_sel") > 0), _next_link()))
    origin = lambda u: let(parse_url(u), origin_of)
    paged = paged.withColumn("_foreign", F.col("_next.url").isNotNull() & (~origin(F.col("_next.url")).eqNullSafe(origin(F.col("url")))))
    rows = paged.select(
        *keys,
        "rule_id",
        F.col("_source").alias("source"),
        F.inline(F.when(F.col("reject_reason").isNotNull(), F.array(_row("reject", message=F.col("reject_reason")))).otherwise(_sinks(is_json, max_rows, max_bytes))),
    )
    path = work_path(responses.sparkSession, "collected")
    write_by(rows, "tag", path, len(TAGS))
    return Collected(responses.sparkSession.read.schema(rows.schema).parquet(path), keys)


def _next_link() -> Column:
    nodes = F.col("nodes")
    href = F.nullif(F.try_element_at(F.get(select_by(nodes, F.col("next_sel")), F.lit(0))["attrs"], F.lit("href")), F.lit(""))
    return let(href, lambda h: F.struct(h.alias("href"), F.coalesce(resolve_url(h, F.col("_base")), F.when(is_other_scheme(h), trim_all(h))).alias("url")))


def _row(tag: str, **values: Column) -> Column:
    # typed one by one: a cast of the whole would copy the cells of every record
    return F.struct(F.lit(tag).alias("tag"), *[values.get(n, F.lit(None).cast(kind)).alias(n) for n, kind in _SINK.items()])


def _sinks(is_json: Column, max_rows: int | None, max_bytes: int | None) -> Column:
    """All rows that a sound response gives, as one array."""
    n = F.size("_kept")
    sizes = F.transform(records_as_maps(F.col("_kept"), F.col("_source")), lambda r: F.octet_length(F.to_json(r)).cast("long"))
    link = F.col("_next.url")
    page = _row(
        "page",
        title=F.when(is_json, host_of(F.col("_source"))).otherwise(page_title(F.col("nodes"), F.col("url"))),
        rows=n,
        matched=F.col("_matched"),
        bytes=F.aggregate(sizes, F.lit(0).cast("long"), lambda total, size: total + size),
        next_url=link,
        last=F.when(is_json, n == 0).otherwise(link.isNull() | F.col("_foreign")),
    )
    empty = F.transform(F.filter("fields", lambda f, i: (n > 0) & F.forall("_kept", lambda r: F.get(r, i)["value"] == "")), lambda f: f["name"])
    empty_text = lambda name: F.when(is_json, F.format_string(WARN_EMPTY_FIELD_JSON, name)).otherwise(F.format_string(WARN_EMPTY_FIELD_HTML, name))
    texts = F.concat(
        F.array(F.when(F.col("_matched") == 0, F.when(is_json, WARN_NO_RECORD_JSON).otherwise(WARN_NO_CONTAINER))),
        F.array(F.when(F.col("_matched") > max_rows, row_cap_text(max_rows))) if max_rows is not None else F.array().cast("array<string>"),
        F.array(F.when(n < F.size("_all"), page_bytes_text(max_bytes))) if max_bytes is not None else F.array().cast("array<string>"),
        F.transform(empty, empty_text),
        F.array(F.when(F.col("_next.href").isNotNull() & link.isNull(), WARN_NEXT_INVALID), F.when(F.col("_foreign"), WARN_NEXT_OTHER_ORIGIN)),
    )
    warnings = F.transform(F.filter(texts, lambda t: t.isNotNull()), lambda t, i: _row("warning", pos=i, message=t))
    records = F.transform("_kept", lambda r, i: _row("record", pos=i, cells=r))
    return F.concat(records, F.array(page), warnings)
