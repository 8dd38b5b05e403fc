"""Extraction of records from shredded pages.

Everything here is narrow: a page and its node array stay in one row until the finished records
are unnested, so no extraction step shuffles and no row is larger than one page.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import (
    URL_ATTRIBUTES,
    WARN_EMPTY_FIELD_HTML,
    WARN_NEXT_INVALID,
    WARN_NO_CONTAINER,
    WARN_PAGE_BYTES,
    WARN_ROW_CAP,
)
from ..functions.selectors import (
    BRANCHES,
    _attr,
    first,
    is_scoped,
    select,
    select_by,
    selector_rows,
    subtree_text,
)
from ..functions.shred import shred
from ..session import small_table
from ..functions.text import collapse, count_upto, let, trim_all, unnest
from ..functions.urls import host_of, is_other_scheme, parse_url, resolve_parts, resolve_url


def with_nodes(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds the node array and drops the page text."""
    return pages.withColumn("nodes", shred(html)).drop(html)


def nodes_table(pages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per node, for ad-hoc SQL over a corpus."""
    return unnest(pages, keys, "nodes", "_pos", "_n").select(*keys, "_n.*")


# --- values -------------------------------------------------------------------------------


def base_url(nodes: Column, url: Column) -> Column:
    """Parsed base of a page: the first base[href] if it is a web URL, else the page URL."""
    href = _attr(first(nodes, "base[href]"), "href")
    return let(
        F.struct(parse_url(url).alias("own"), href.alias("href")),
        lambda x: F.coalesce(F.when(x["href"].isNotNull(), resolve_parts(x["href"], x["own"])), x["own"]),
    )


def page_title(nodes: Column, url: Column) -> Column:
    text = let(first(nodes, "title"), lambda t: F.when(t.isNotNull(), trim_all(subtree_text(nodes, t))))
    return let(text, lambda t: F.coalesce(F.when(t != "", t), let(parse_url(url), lambda p: p["host"])))


def text_value(nodes: Column, n: Column) -> Column:
    return collapse(subtree_text(nodes, n))


def attribute_value(n: Column, name) -> Column:
    return F.coalesce(trim_all(_attr(n, name)), F.lit(""))


def link_value(value: Column, base: Column) -> Column:
    return let(value, lambda v: F.when(v == "", "").otherwise(F.coalesce(resolve_url(v, base), F.lit(""))))


def _value(nodes: Column, base: Column, n: Column, attribute: str) -> Column:
    if attribute == "text":
        return text_value(nodes, n)
    value = attribute_value(n, attribute)
    return link_value(value, base) if attribute in URL_ATTRIBUTES else value


def first_of(items: Column, limit: int | None) -> Column:
    """All items, or the first ones where a caller asks for a limit."""
    return items if limit is None else F.slice(items, 1, limit)


def fold_values(values: Column, max_chars: int | None = None) -> Column:
    """Drops empty values, keeps the first of equal ones and joins by line feed; cuts only if asked."""
    cut = values if max_chars is None else F.transform(values, lambda v: F.left(v, F.lit(max_chars)))
    joined = F.array_join(F.array_distinct(F.filter(cut, lambda v: v != "")), "\n")
    return joined if max_chars is None else F.left(joined, F.lit(max_chars))


def next_link(nodes: Column, base: Column, selector: str) -> Column:
    """STRUCT(href, url): the raw href of the first match and its absolute form.

    Other schemes are kept as they are; admission rejects them later. ``url`` is NULL for a
    reference that cannot be resolved.
    """
    return let(
        F.nullif(_attr(first(nodes, selector), "href"), F.lit("")),
        lambda href: F.struct(
            href.alias("href"),
            F.coalesce(resolve_url(href, base), F.when(is_other_scheme(href), trim_all(href))).alias("url"),
        ),
    )


def placed(hits: Column) -> Column:
    """Hits in document order with their places, to be searched by ``hits_inside``."""
    return F.struct(hits.alias("hits"), F.transform(hits, lambda h: h["pre"]).alias("places"))


def hits_inside(page: Column, c: Column) -> Column:
    """The hits below container ``c``: as both are in document order, they are one stretch, whose ends are
    found by halving. Few hits are looked through."""
    few = F.filter(page["hits"], lambda h: (h["pre"] > c["pre"]) & (h["pre"] <= c["pre"] + c["n_desc"]))
    ends = F.struct(count_upto(page["places"], c["pre"]).alias("first"), count_upto(page["places"], c["pre"] + c["n_desc"]).alias("last"))
    many = let(ends, lambda e: F.slice(page["hits"], e["first"] + 1, e["last"] - e["first"]))
    return F.when(F.size(page["places"]) <= 64, few).otherwise(many)


# --- one rule over many pages -------------------------------------------------------------


def extract_page(
    pages: DataFrame,
    rule: dict,
    *,
    url: str = "url",
    max_rows: int | None = None,
    max_nodes: int | None = None,
    max_chars: int | None = None,
    max_bytes: int | None = None,
) -> DataFrame:
    """One row per page: ``records`` (array of structs), matched, title, next and warnings.

    ``pages`` needs ``nodes``; its other columns are kept, ``nodes`` is dropped.
    """
    fields = rule["fields"]
    names = [f["name"] for f in fields]
    nodes = F.col("nodes")
    row_selector = (rule.get("rowSelector") or "").strip()
    df = pages.withColumn("_base", base_url(nodes, F.col(url)))
    containers = (
        F.transform(select(nodes, row_selector), lambda n: F.struct(n["pre"], n["n_desc"]))
        if row_selector
        else F.transform(F.slice(nodes, 1, 1), lambda n: F.struct(n["pre"], n["n_desc"]))
    )
    df = df.withColumn("_containers", containers)

    # Columns that lambdas use are bound by let(): the optimizer may move an expression that is
    # referenced once into the lambda, where it would be evaluated for every element.
    def valued(found: Column, attribute: str) -> Column:
        def with_base(base: Column) -> Column:
            return F.transform(
                found,
                lambda n: F.struct(n["pre"].alias("pre"), _value(nodes, base, n, attribute).alias("value")),
            )

        return let(F.col("_base"), with_base) if attribute in URL_ATTRIBUTES else with_base(F.lit(None))

    def empty_everywhere(name: str) -> Column:
        return (F.size("records") > 0) & F.forall("records", lambda r: r[name] == "")

    # Each field's hits are valued once per page; a container then takes the ones in its range.
    hits = {}
    for f in fields:
        if is_scoped(f["selector"]):
            continue
        key = (f["selector"], f["attribute"])
        if key not in hits:
            hits[key] = f"_hits{len(hits)}"
            found = valued(select(nodes, f["selector"]), f["attribute"])
            df = df.withColumn(hits[key], let(found, placed))

    def cell(f: dict, c: Column, page: Column) -> Column:
        if f["selector"] == ":scope":
            own = F.get(nodes, c["pre"])
            return fold_values(F.array(_value(nodes, page["_base"], own, f["attribute"])), max_chars)
        if is_scoped(f["selector"]):
            found = valued(select(nodes, f["selector"], scope=c), f["attribute"])
            inside = F.filter(found, lambda h: (h["pre"] > c["pre"]) & (h["pre"] <= c["pre"] + c["n_desc"]))
        else:
            inside = hits_inside(page[hits[f["selector"], f["attribute"]]], c)
        return fold_values(F.transform(first_of(inside, max_nodes), lambda h: h["value"]), max_chars)

    def all_records(page: Column) -> Column:
        return F.transform(
            first_of(page["_containers"], max_rows),
            lambda c: F.struct(*[cell(f, c, page).alias(f["name"]) for f in fields], F.col(url).alias("_source")),
        )

    df = df.withColumn("_records", let(F.struct("_base", "_containers", *hits.values()), all_records))
    selector = (rule.get("nextSelector") or "").strip()
    link = (
        next_link(nodes, F.col("_base"), selector)
        if selector
        else F.struct(F.lit(None).cast("string").alias("href"), F.lit(None).cast("string").alias("url"))
    )
    df = df.withColumn("_next", link)
    out = F.col("_records") if max_bytes is None else F.slice("_records", 1, rows_within_bytes(F.col("_records"), max_bytes))
    df = df.withColumn("records", out)
    warnings = F.filter(
        F.array(
            F.when(F.size("_containers") == 0, WARN_NO_CONTAINER),
            *([F.when(F.size("_containers") > max_rows, row_cap_text(max_rows))] if max_rows is not None else []),
            *([F.when(F.size("records") < F.size("_records"), page_bytes_text(max_bytes))] if max_bytes is not None else []),
            *[F.when(empty_everywhere(name), WARN_EMPTY_FIELD_HTML % name) for name in names],
            F.when(F.col("_next.href").isNotNull() & F.col("_next.url").isNull(), WARN_NEXT_INVALID),
        ),
        lambda w: w.isNotNull(),
    )
    kept = [c for c in pages.columns if c != "nodes"]
    return df.select(
        *kept,
        "records",
        F.size("_containers").alias("matched"),
        page_title(nodes, F.col(url)).alias("title"),
        F.col("_next.url").alias("next_url"),
        warnings.alias("warnings"),
    )


def row_cap_text(max_rows: int) -> str:
    return WARN_ROW_CAP.replace("200", str(max_rows))


def page_bytes_text(max_bytes: int) -> str:
    size = f"{max_bytes >> 20} MB" if max_bytes % (1 << 20) == 0 else f"{max_bytes} 字节"
    return WARN_PAGE_BYTES.replace("1 MB", size)


def rows_within_bytes(records: Column, max_bytes: int) -> Column:
    """How many leading records stay within ``max_bytes`` of UTF-8 JSON; the one that crosses goes."""
    sizes = F.transform(records, lambda r: F.octet_length(F.to_json(r)).cast("long"))
    folded = F.aggregate(
        sizes,
        F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).alias("kept")),
        lambda a, s: F.struct(
            (a["total"] + s).alias("total"),
            (a["kept"] + F.when(a["total"] + s <= max_bytes, 1).otherwise(0)).alias("kept"),
        ),
    )
    return folded["kept"]


def unnest_records(extracted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Wide form: one row per record, one string column per field, ``_source`` and ``row_pos``."""
    return unnest(extracted, keys, "records", "row_pos", "_r").select(*keys, "row_pos", "_r.*")


def extract_html(pages: DataFrame, rule: dict, keys: Sequence[str], **limits) -> DataFrame:
    """Records of all pages under one rule, in wide form."""
    return unnest_records(extract_page(pages, rule, **limits), keys)


def extraction_warnings(extracted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per page and warning, in the order they arise."""
    return unnest(extracted, keys, "warnings", "pos", "message")


# --- many rules: rules as data ------------------------------------------------------------

RULE_PLAN = (
    f"rule_id string, host string, row_sel {BRANCHES}, next_sel {BRANCHES}, "
    f"fields array<struct<name:string,attribute:string,scoped:boolean,own:boolean,sel:{BRANCHES}>>"
)


def compile_rules(spark, rules: Sequence[dict]) -> DataFrame:
    """The rule catalogue in evaluated form, one row per rule (the catalogue is small)."""
    rows = [
        (
            r["id"],
            r["url"],
            selector_rows(r.get("rowSelector") or ""),
            selector_rows(r.get("nextSelector") or ""),
            [
                (f["name"], f["attribute"], is_scoped(f["selector"]), f["selector"] == ":scope", selector_rows(f["selector"]))
                for f in r["fields"]
            ],
        )
        for r in rules
    ]
    schema = RULE_PLAN.replace("host string", "url string")
    return small_table(spark, rows, schema).withColumn("host", host_of(F.col("url"))).drop("url")


def extract_html_multi(
    routed: DataFrame,
    keys: Sequence[str],
    *,
    url: str = "url",
    max_rows: int | None = None,
    max_nodes: int | None = None,
    max_chars: int | None = None,
    max_bytes: int | None = None,
) -> DataFrame:
    """Long form for any number of rules in one plan.

    ``routed`` holds pages joined with their rule (``nodes`` plus the RULE_PLAN columns). Gives
    (keys, rule_id, row_pos, field_pos, field_name, value, _source).
    """
    df = with_html_records(routed, url=url, max_rows=max_rows, max_nodes=max_nodes, max_chars=max_chars)
    kept = F.col("_records")
    if max_bytes is not None:
        kept = F.slice("_records", 1, rows_within_bytes(records_as_maps(F.col("_records"), F.col(url)), max_bytes))
    rows = unnest(df, [*keys, "rule_id", F.col(url).alias("_source")], kept, "row_pos", "_cells")
    cells = unnest(rows, [*keys, "rule_id", "row_pos", "_source"], "_cells", "field_pos", "_c")
    return cells.select(
        *keys, "rule_id", "row_pos", "field_pos",
        F.col("_c.name").alias("field_name"), F.col("_c.value").alias("value"), "_source",
    )


def records_as_maps(records: Column, source: Column) -> Column:
    """Records as the size rule looks at them: name to value, plus the source."""
    return F.transform(records, lambda r: F.map_concat(F.map_from_entries(r), F.create_map(F.lit("_source"), source)))


def with_html_records(
    routed: DataFrame, *, url: str = "url", max_rows: int | None = None, max_nodes: int | None = None, max_chars: int | None = None
) -> DataFrame:
    """Adds ``_base``, ``_containers`` and ``_records``: for each container the (name, value) of every field
    of the page's own rule."""
    nodes = F.col("nodes")
    df = routed.withColumn("_base", base_url(nodes, F.col(url)))
    containers = F.when(F.size("row_sel") == 0, F.slice(nodes, 1, 1)).otherwise(
        select_by(nodes, F.col("row_sel"))
    )
    df = df.withColumn(
        "_containers", F.transform(containers, lambda n: F.struct(n["pre"], n["n_desc"]))
    )

    def value(n: Column, attribute: Column, base: Column) -> Column:
        plain = attribute_value(n, attribute)
        return (
            F.when(attribute == "text", text_value(nodes, n))
            .when(attribute.isin(URL_ATTRIBUTES), link_value(plain, base))
            .otherwise(plain)
        )

    def valued(found: Column, f: Column, base: Column) -> Column:
        return F.transform(
            found, lambda n: F.struct(n["pre"].alias("pre"), value(n, f["attribute"], base).alias("value"))
        )

    no_nodes = F.slice(nodes, 1, 0)
    shared_hits = let(
        F.col("_base"),
        lambda base: F.transform(
            "fields",
            lambda f: let(valued(F.when(f["scoped"], no_nodes).otherwise(select_by(nodes, f["sel"])), f, base), placed),
        ),
    )
    df = df.withColumn("_hits", shared_hits)

    def cell(c: Column, f: Column, i: Column, page: Column) -> Column:
        def inside(x: Column) -> Column:
            return (x["pre"] > c["pre"]) & (x["pre"] <= c["pre"] + c["n_desc"])

        in_scope = F.when(f["own"], F.slice(nodes, c["pre"] + 1, 1)).otherwise(
            F.filter(select_by(nodes, f["sel"], scope=c), inside)
        )
        shared = let(F.get(page["_hits"], i), lambda hits: hits_inside(hits, c))
        chosen = first_of(F.when(f["scoped"], valued(in_scope, f, page["_base"])).otherwise(shared), max_nodes)
        return F.struct(
            f["name"].alias("name"),
            fold_values(F.transform(chosen, lambda h: h["value"]), max_chars).alias("value"),
        )

    def all_records(page: Column) -> Column:
        return F.transform(
            first_of(page["_containers"], max_rows),
            lambda c: F.transform("fields", lambda f, i: cell(c, f, i, page)),
        )

    return df.withColumn("_records", let(F.struct("_base", "_containers", "_hits"), all_records)).drop("_hits")
