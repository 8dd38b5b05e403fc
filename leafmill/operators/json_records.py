"""Extraction of records from JSON bodies."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import (
    WARN_EMPTY_FIELD_JSON,
    WARN_NO_RECORD_JSON,
)
from ..functions.json_cells import json_cells
from ..functions.jsonpath import JsonPlace, cell_of, json_cell, json_records, nested_text, parsed, path_plan, plan_cells, record_texts, unsure
from ..functions.text import let
from ..functions.urls import host_of, strip_query
from .gates import decode_utf8, gate
from .html import first_of, page_bytes_text, row_cap_text, rows_within_bytes, unnest_records


def json_bodies(responses: DataFrame) -> DataFrame:
    """Adds ``doc`` (text without byte order mark) and ``parsed``, its VARIANT; rejects malformed JSON."""
    df = parsed(responses.withColumn("doc", decode_utf8(F.col("body"))))
    return gate(df, F.when(F.col("parsed").isNull(), "invalid JSON"))


def extract_json_page(
    docs: DataFrame,
    rule: dict,
    *,
    doc: str = "doc",
    url: str = "url",
    max_rows: int | None = None,
    max_chars: int | None = None,
    max_bytes: int | None = None,
) -> DataFrame:
    """One row per body: ``records``, matched, title and warnings; the URL loses its query.

    A body is parsed once, or not at all where ``docs`` has its VARIANT as ``parsed``. Only where a page has
    a cell that is an object or array, its text is read once more for the order of members.
    """
    fields = [(f["name"], JsonPlace.of(f["selector"])) for f in rule["fields"]]
    rows = JsonPlace.of(rule.get("rowSelector") or "")
    df = docs if "parsed" in docs.columns else parsed(docs, doc)
    df = df.withColumn("_source", strip_query(F.col(url)))
    df = df.withColumn("_items", json_records(F.col("parsed"), rows))
    cells = F.transform(first_of(F.col("_items"), max_rows), lambda r: F.struct(*[json_cell(r, place).alias(name) for name, place in fields]))
    df = df.withColumn("_cells", cells)
    nested = F.exists("_cells", lambda r: reduce(or_, [r[name]["nested"] for name, _ in fields]))
    df = df.withColumn("_texts", F.when(nested, record_texts(F.col(doc), rows)))

    def cell(value: Column, text: Column, place: JsonPlace) -> Column:
        printed = F.when(value["nested"], nested_text(value["text"], text, place)).otherwise(value["text"])
        printed = F.coalesce(printed, F.lit(""))
        return printed if max_chars is None else F.left(printed, F.lit(max_chars))

    def all_records(page: Column) -> Column:
        return F.transform(
            page["_cells"],
            lambda r, i: F.struct(
                *[cell(r[name], F.get(page["_texts"], i), place).alias(name) for name, place in fields], page["_source"].alias("_source")
            ),
        )

    df = df.withColumn("_records", let(F.struct("_cells", "_texts", "_source"), all_records))
    out = F.col("_records") if max_bytes is None else F.slice("_records", 1, rows_within_bytes(F.col("_records"), max_bytes))
    df = df.withColumn("records", out)

    def empty_everywhere(name: str) -> Column:
        return (F.size("records") > 0) & F.forall("records", lambda r: r[name] == "")

    warnings = F.filter(
        F.array(
            F.when(F.size("_items") == 0, WARN_NO_RECORD_JSON),
            *([F.when(F.size("_items") > max_rows, row_cap_text(max_rows))] if max_rows is not None else []),
            *([F.when(F.size("records") < F.size("_records"), page_bytes_text(max_bytes))] if max_bytes is not None else []),
            *[F.when(empty_everywhere(f["name"]), WARN_EMPTY_FIELD_JSON % f["name"]) for f in rule["fields"]],
        ),
        lambda w: w.isNotNull(),
    )
    kept = [F.col("_source").alias(c) if c == url else F.col(c) for c in docs.columns if c not in (doc, "parsed")]
    return df.select(
        *kept,
        "records",
        F.size("_items").alias("matched"),
        host_of(F.col("_source")).alias("title"),
        warnings.alias("warnings"),
    )


def extract_json(docs: DataFrame, rule: dict, keys: Sequence[str], **options) -> DataFrame:
    """Records of all bodies under one rule, in wide form."""
    if options.get("max_bytes") is not None:
        return unnest_records(extract_json_page(docs, rule, **options), keys)
    return _json_rows(docs, rule, keys, **options)


def _json_rows(
    docs: DataFrame, rule: dict, keys: Sequence[str], *, doc: str = "doc", url: str = "url", max_rows: int | None = None, max_chars: int | None = None
) -> DataFrame:
    """The rows of ``extract_json_page`` where no step needs a page's records side by side.

    Records become rows first, so that cells are plain columns, which Spark compiles; functions of a page's array
    are interpreted for every cell. Texts, kinds and nested texts follow in steps, each of them computed once.
    Plain texts that nobody has parsed are read by ``json_cells``: their rows have all cells as ``_c``, and to these
    steps they are empty.
    """
    fields = [(f"_{i}", f["name"], JsonPlace.of(f["selector"])) for i, f in enumerate(rule["fields"])]
    rows = JsonPlace.of(rule.get("rowSelector") or "")
    source = strip_query(F.col(url)).alias("_source")
    keyed = [F.col(k) if k != url else strip_query(F.col(url)).alias(k) for k in keys]
    if "parsed" in docs.columns:
        df = docs.select(*keyed, source, F.col(doc).alias("_doc"), "parsed")
    else:
        read = json_cells(F.col(doc), rows.names, [place.names for _, _, place in fields])
        df = docs.select(*keyed, source, F.col(doc).alias("_doc"), read.alias("_read"))
        first = first_of(F.col("_read"), max_rows)
        df = df.select(*keys, "_source", F.when(F.col("_read").isNull(), F.col("_doc")).alias("_doc"), F.posexplode_outer(first).alias("_pos", "_c"))
        df = parsed(df, "_doc")
    items = first_of(json_records(F.col("parsed"), rows), max_rows)
    # texts are read for the order of members, once for a body; a body without objects in objects or lists needs none
    texts = F.when(F.substring_index(F.col("_doc"), "{", 2) != F.col("_doc"), record_texts(F.col("_doc"), rows))
    plain = ["_pos", "_c"] if "_c" in df.columns else []
    found = df.select(*keys, "_source", *plain, F.struct(items.alias("items"), texts.alias("texts")).alias("_page"))
    # each record takes its own text along: the page's would be copied for every record
    pairs = F.transform("_page.items", lambda r, i: F.struct(r.alias("r"), F.get(F.col("_page.texts"), i).alias("text")))
    found = found.select(*keys, "_source", *plain, F.posexplode_outer(pairs).alias("row_pos", "_i"))
    if plain:
        found = found.withColumn("row_pos", F.coalesce("_pos", "row_pos")).drop("_pos")
    plain = plain[1:]
    found = found.where("row_pos is not null")
    found = found.select(*keys, "_source", "row_pos", *plain, F.col("_i.r").alias("_r"), F.col("_i.text").alias("_text"))
    typed = found.select("*", *[place.text(F.col("_r")).alias(i) for i, _, place in fields])
    kinds = typed.select("*", *[F.when(unsure(F.col(i)), F.to_json(place.get(F.col("_r")))).alias(f"{i}j") for i, _, place in fields])
    cells = [(i, *cell_of(F.col(i), F.col(f"{i}j"))) for i, _, _ in fields]
    printed = kinds.select(
        *keys, "_source", "row_pos", *plain, "_text",
        *[c for i, text, nested in cells for c in (F.when(F.col(f"{i}j").isNull(), F.col(i)).otherwise(text).alias(i), F.coalesce(nested, F.lit(False)).alias(f"{i}n"))],
    )

    def cell(i: str, place: JsonPlace) -> Column:
        text = F.when(F.col(f"{i}n"), nested_text(F.col(i), F.col("_text"), place)).otherwise(F.col(i))
        text = F.coalesce(*[F.col(c)[i] for c in plain], text, F.lit(""))
        return text if max_chars is None else F.left(text, F.lit(max_chars))

    return printed.select(*keys, "row_pos", *[cell(i, place).alias(name) for i, name, place in fields], "_source")


def json_plan(fields: Column) -> Column:
    """The ``path_plan`` of fields (name, path)."""
    return path_plan(F.transform(fields, lambda f: f["path"]))


def with_json_records(routed: DataFrame, *, doc: str = "doc", max_rows: int | None = None, max_chars: int | None = None) -> DataFrame:
    """Adds ``_items`` and ``_json_records``: for each record the (name, value) of every field of the body's
    own rule.

    ``routed`` holds bodies (``doc``, ``parsed``) joined with their rule: ``json_rows`` is the path of the
    records, ``json_fields`` an array of (name, path), both as ``normalize_path`` gives them. A catalogue may have
    their ``json_plan`` as a column; else it is made for each body.
    """
    rows = JsonPlace.at(F.col("json_rows"))
    df = routed.withColumn("_items", json_records(F.col("parsed"), rows))

    if "json_plan" not in df.columns:
        df = df.withColumn("json_plan", json_plan(F.col("json_fields")))
    items = first_of(F.col("_items"), max_rows)

    def records(value) -> Column:
        """(name, value) of all cells, from their place, record, text and kind."""
        named = lambda k, c: F.struct(F.get("json_fields", k)["name"].alias("name"), c.alias("value"))
        return F.transform(items, lambda r, i: plan_cells(r, F.col("json_plan"), lambda k, text, nested: named(k, value(i, k, text, nested))))

    def printed(text: Column) -> Column:
        text = F.coalesce(text, F.lit(""))
        return text if max_chars is None else F.left(text, F.lit(max_chars))

    def nested_or_plain(i: Column, k: Column, text: Column, nested: Column) -> Column:
        path = F.get("json_fields", k)["path"]
        return printed(F.when(nested, nested_text(text, F.get("_texts", i), JsonPlace.at(path))).otherwise(text))

    # nested cells stay NULL, which others never are; only bodies that have some are gone through once more
    df = df.withColumn("_cells", records(lambda i, k, text, nested: F.when(~F.coalesce(nested, F.lit(False)), printed(text))))
    open_ = F.exists("_cells", lambda r: F.exists(r, lambda c: c["value"].isNull()))
    df = df.withColumn("_open", open_).withColumn("_texts", F.when(F.col("_open"), record_texts(F.col(doc), rows)))
    whole = F.when(F.col("_open"), records(nested_or_plain)).otherwise(F.col("_cells"))
    return df.withColumn("_json_records", whole).drop("_cells", "_open", "_texts")
