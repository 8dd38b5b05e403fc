"""Rule inference: finds lists, fields and the next link of JSON and HTML responses.

Each response is analysed inside its own row with array expressions, so inference is narrow;
only the vote over a site's pages aggregates.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import (
    LABEL_COLUMN_PREFIX,
    LABEL_CONTENT,
    LABEL_DESCRIPTION,
    LABEL_FIELD_PREFIX,
    LABEL_IMAGE,
    LABEL_LINK,
    LABEL_PRICE,
    LABEL_TIME,
    LABEL_TITLE,
    LABEL_VALUE,
    NEXT_SELECTORS,
    RESERVED_NAMES,
)
from ..functions.jsonpath import MAX_PATH_STEPS, nesting, normalize_path
from ..functions.selectors import (
    _all,
    descendants,
    first,
    is_element,
    parse_selector,
    present,
    subtree_text,
)
from ..functions.text import count_upto, is_blank, let, trim_all

FIELD_TYPE = "struct<name:string,selector:string,attribute:string>"


def _field(name, selector, attribute="text") -> Column:
    name, selector, attribute = (x if isinstance(x, Column) else F.lit(x) for x in (name, selector, attribute))
    return F.struct(name.alias("name"), selector.alias("selector"), attribute.alias("attribute"))


def _first_n(items: Column, n: int | None) -> Column:
    """The first ``n`` items; all of them without a limit."""
    return items if n is None else F.slice(items, 1, n)


def _present(fields: Column) -> Column:
    return F.filter(fields, lambda f: f.isNotNull())


# --- JSON ---------------------------------------------------------------------------------

_ENTRY = "struct<path:string,ord:array<int>,depth:int,kind:string,json:string>"


def json_walk(df: DataFrame, roots: Column, out: str, max_depth: int, max_keys: int | None = None) -> DataFrame:
    """Adds ``out``: the values reached from the root values through objects, in document order.

    Entries are (path, ord, depth, kind, json); arrays are not entered. ``ord`` holds the root's
    and the keys' positions, so sorting by it gives document order. Each level is one column
    derived from the level above; a document stays in its row.
    """

    def children(parent: Column) -> Column:
        entries = F.map_entries(F.from_json(parent["json"], "map<string,string>"))
        kinds = F.from_json(parent["json"], "map<string,variant>")
        listed = F.transform(
            _first_n(entries, max_keys),
            lambda e, i: F.struct(
                F.when(parent["path"] == "$", e["key"])
                .otherwise(F.concat(parent["path"], F.lit("."), e["key"]))
                .alias("path"),
                F.array_append(parent["ord"], i).alias("ord"),
                (parent["depth"] + 1).alias("depth"),
                _kind(F.try_element_at(kinds, e["key"])).alias("kind"),
                e["value"].alias("json"),
            ),
        )
        return F.filter(listed, lambda c: normalize_path(c["path"]).isNotNull())

    columns = df.columns
    first_level = F.transform(
        roots,
        lambda json, i: F.struct(
            F.lit("$").alias("path"),
            F.array(i).alias("ord"),
            F.lit(0).alias("depth"),
            let(F.try_parse_json(json), lambda v: F.when(v.isNull(), "scalar").otherwise(_kind(v))).alias("kind"),
            json.alias("json"),
        ),
    )
    df = df.withColumn("_level0", first_level.cast(f"array<{_ENTRY}>"))
    for depth in range(max_depth):
        above = F.filter(f"_level{depth}", lambda x: x["kind"] == "object")
        below = F.flatten(F.transform(above, children)).cast(f"array<{_ENTRY}>")
        df = df.withColumn(f"_level{depth + 1}", below)
    levels = F.concat(*[F.col(f"_level{d}") for d in range(max_depth + 1)])
    ordered = F.array_sort(
        levels, lambda a, b: F.when(a["ord"] < b["ord"], -1).when(a["ord"] > b["ord"], 1).otherwise(0)
    )
    return df.select(*columns, ordered.alias(out))


def _kind(value: Column) -> Column:
    name = F.schema_of_variant(value)
    return (
        F.when(value.isNull() | (name == "VOID"), "null")
        .when(name.startswith("OBJECT"), "object")
        .when(name.startswith("ARRAY"), "array")
        .when(name == "STRING", "string")
        .otherwise("scalar")
    )


def _elements(json: Column) -> Column:
    return F.from_json(json, "array<string>")


def names_deep(docs: DataFrame, doc: str = "doc") -> int:
    """How many names deep any value of the documents can stand, as far as a path may go. One pass over them."""
    return min(docs.agg(F.coalesce(F.max(nesting(F.col(doc))), F.lit(0))).first()[0], MAX_PATH_STEPS)


def json_lists(docs: DataFrame, doc: str = "doc", max_visits: int | None = None, max_depth: int | None = None) -> DataFrame:
    """Adds ``lists``: candidate lists as (path, score, json), in document order.

    Values, keys and lists are not limited in number. Lists stand ``max_depth`` names deep at most, or at
    any depth a path can reach; the documents are then read once more to find how deep they go.
    """
    depth = names_deep(docs, doc) if max_depth is None else max_depth
    df = json_walk(docs, F.array(F.col(doc)), "_walk", depth + 1)
    # Values one level too deep count as visited but are not looked at.
    seen = F.filter(
        _first_n(F.col("_walk"), max_visits), lambda x: (x["depth"] <= depth) & (x["kind"] == "array")
    )

    def score(x: Column) -> Column:
        has_object = F.exists(F.from_json(x["json"], "array<variant>"), lambda v: _kind(v) == "object")
        length = F.json_array_length(x["json"])
        return F.when(has_object, 100).otherwise(0) + F.least(length, F.lit(50)) - x["depth"]

    lists = F.transform(
        seen, lambda x: F.struct(x["path"].alias("path"), score(x).alias("score"), x["json"].alias("json"))
    )
    return df.withColumn("lists", lists).drop("_walk")


def best_scored(candidates: Column) -> Column:
    """First candidate with the highest score, NULL without candidates."""
    top = F.array_max(F.transform(candidates, lambda c: c["score"]))
    return let(top, lambda t: F.get(F.filter(candidates, lambda c: c["score"] == t), F.lit(0)))


def json_field_paths(df: DataFrame, records: Column, max_records: int | None = None, max_depth: int = MAX_PATH_STEPS) -> DataFrame:
    """Adds ``paths``: distinct leaf paths of the records, in first-seen order; an object ``max_depth`` names
    deep is a leaf."""
    roots = F.transform(_first_n(records, max_records), lambda r: F.coalesce(r, F.lit("null")))
    walked = json_walk(df, roots, "_walk", max_depth)
    leaves = F.filter("_walk", lambda x: (x["kind"] != "object") | (x["depth"] == max_depth))
    paths = F.array_distinct(F.transform(leaves, lambda x: x["path"]))
    return walked.withColumn("paths", paths).drop("_walk")


def suggest_json(docs: DataFrame, doc: str = "doc", list_depth: int | None = None, field_depth: int | None = None) -> DataFrame:
    """Adds ``row_selector``, ``fields`` and ``next_selector`` to JSON documents.

    Lists and fields are looked for at any depth, or down to the names given; see ``json_lists``.
    """
    depth = names_deep(docs, doc) if list_depth is None or field_depth is None else 0
    df = json_lists(docs, doc, max_depth=depth if list_depth is None else list_depth).withColumn("_best", best_scored(F.col("lists"))).drop("lists")
    records = F.when(F.col("_best").isNotNull(), _elements(F.col("_best.json"))).otherwise(F.array(F.col(doc)))
    df = json_field_paths(df, records, max_depth=depth if field_depth is None else field_depth)
    named = F.transform(
        "paths",
        lambda p, i: _field(
            F.when(p == "$", LABEL_VALUE)
            .when((F.length(p) <= 40) & ~p.isin(RESERVED_NAMES), p)
            .otherwise(F.concat(F.lit(LABEL_FIELD_PREFIX), (i + 1).cast("string"))),
            p,
        ),
    )
    fields = F.when(F.size("paths") > 0, named).otherwise(F.array(_field(LABEL_VALUE, "$")))
    return df.select(
        *docs.columns,
        F.coalesce("_best.path", F.lit("$")).alias("row_selector"),
        unique_names(fields).alias("fields"),
        F.lit("").alias("next_selector"),
    )


# --- HTML ---------------------------------------------------------------------------------

LIST_TAGS = ("article", "li", "tr", "div")


def _matches(nodes: Column, n: Column, selector: str) -> Column:
    """Test of a comma list of compounds on one node."""
    branches = [_all(nodes, n, branch[0].tests) for branch in parse_selector(selector)]
    return is_element(n) & reduce(lambda a, b: a | b, branches)


def _has(nodes: Column, n: Column, selector: str) -> Column:
    return F.exists(descendants(nodes, n), lambda d: _matches(nodes, d, selector))


def _sibling_key(parent: Column, tag: Column, cls: Column) -> Column:
    return F.pmod(F.xxhash64(parent, tag, cls), F.lit(1 << 62))


def html_lists(nodes: Column, max_elements: int | None = None) -> Column:
    """Candidate row selectors as (selector, score), in order of first qualifying element.

    Siblings are counted once for the page, as a sorted array of keys that is searched by halving, and only
    the first qualifying element of each selector is scored, so the work grows with the page's nodes times
    their depth.
    """
    found = _first_n(F.filter(nodes, lambda n: n["tag"].isin(*LIST_TAGS)), max_elements)
    listed = F.transform(
        found,
        lambda n: F.struct(
            n["pre"].alias("pre"),
            n["n_desc"].alias("n_desc"),
            n["parent"].alias("parent"),
            n["tag"].alias("tag"),
            F.get(
                F.filter(n["classes"], lambda c: (F.length(c) <= 120) & c.rlike(r"^[a-zA-Z_][\w-]*$")), F.lit(0)
            ).alias("cls"),
            n["path"].alias("path"),
        ),
    )
    listed = F.filter(listed, lambda n: (n["tag"] != "div") | n["cls"].isNotNull())
    # an element counts for its tag alone and for its tag with each of its classes
    classes = lambda m: F.concat(F.array(F.lit("")), F.array_distinct(m["classes"]))
    keys = F.flatten(F.transform(F.filter(nodes, is_element), lambda m: F.transform(classes(m), lambda c: _sibling_key(m["parent"], m["tag"], c))))

    def outside(n: Column) -> Column:
        return ~F.exists(n["path"], lambda p: F.get(nodes, p)["tag"].isin("nav", "header", "footer"))

    def selector(n: Column) -> Column:
        return F.concat(n["tag"], F.coalesce(F.concat(F.lit("."), n["cls"]), F.lit("")))

    def counted(n: Column, sorted_keys: Column) -> Column:
        key = _sibling_key(n["parent"], n["tag"], F.coalesce(n["cls"], F.lit("")))
        count = let(key, lambda k: count_upto(sorted_keys, k) - count_upto(sorted_keys, k - 1))
        return F.struct(selector(n).alias("selector"), n["pre"].alias("pre"), n["n_desc"].alias("n_desc"), n["tag"].alias("tag"), count.alias("count"))

    def score(n: Column) -> Column:
        kind = F.when(n["tag"] == "article", 6).when(n["tag"] == "tr", 5).otherwise(0)
        semantic = (
            kind
            + F.when(_has(nodes, n, "h1,h2,h3,h4"), 5).otherwise(0)
            + F.when(_has(nodes, n, "a[href]"), 2).otherwise(0)
            + F.when(_has(nodes, n, "img"), 1).otherwise(0)
        )
        inner = F.size(F.filter(descendants(nodes, n), lambda d: d["tag"].isin(*LIST_TAGS)))
        return semantic * 10 + F.least(n["count"], F.lit(20)) - F.least(inner, F.lit(30))

    def scored(by_name: Column) -> Column:
        # in the order of selector and place, the first of each selector
        firsts = F.filter(by_name, lambda n, i: ~F.coalesce(F.get(by_name, i - 1)["selector"], F.lit("")).eqNullSafe(n["selector"]))
        return F.transform(firsts, lambda n: F.struct(n["pre"].alias("pre"), n["selector"].alias("selector"), score(n).alias("score")))

    def repeated(sorted_keys: Column) -> Column:
        candidates = F.transform(F.filter(listed, outside), lambda n: counted(n, sorted_keys))
        usable = F.filter(candidates, lambda n: (n["count"] >= 2) & ~is_blank(subtree_text(nodes, n)))
        return let(F.array_sort(usable), scored)

    rows = let(F.array_sort(keys), repeated)
    return F.array_sort(rows, lambda a, b: a["pre"] - b["pre"])


def _probes(nodes: Column, sample: Column) -> Column:
    """Semantic fields present below the sample element."""

    def when(name, selector, attribute="text"):
        return F.when(_has(nodes, sample, selector), _field(name, selector, attribute))

    heading = F.coalesce(when(LABEL_TITLE, "h1,h2,h3,h4"), when(LABEL_TITLE, "a[title]", "title"))
    time = F.when(
        _has(nodes, sample, "time"),
        _field(LABEL_TIME, "time", F.when(_has(nodes, sample, "time[datetime]"), "datetime").otherwise("text")),
    )
    return _present(
        F.array(
            heading,
            when(LABEL_LINK, "a[href]", "href"),
            when(LABEL_IMAGE, "img[src]", "src"),
            when(LABEL_PRICE, '[class*="price"]'),
            when(LABEL_DESCRIPTION, "p"),
            time,
        )
    )


def _columns(nodes: Column, row: Column) -> Column:
    """Fields of a table row, named after the header cells of its table."""
    table = F.get(
        F.filter(F.reverse(row["path"]), lambda p: F.get(nodes, p)["tag"] == "table"), F.lit(0)
    )
    heads = let(
        F.get(nodes, table),
        lambda t: F.transform(
            F.filter(
                descendants(nodes, t),
                lambda n: (n["tag"] == "th")
                & F.exists(n["path"], lambda p: (p > t["pre"]) & (F.get(nodes, p)["tag"] == "thead")),
            ),
            lambda n: trim_all(subtree_text(nodes, n)),
        ),
    )
    cells = F.filter(descendants(nodes, row), lambda n: (n["parent"] == row["pre"]) & (n["tag"] == "td"))

    def named(hs: Column) -> Column:
        # A header already taken, empty, too long or reserved gives a numbered column.
        names = F.aggregate(
            F.sequence(F.lit(0), F.size(cells) - 1),
            F.array().cast("array<string>"),
            lambda acc, i: let(
                F.get(hs, i),
                lambda h: F.array_append(
                    acc,
                    F.when(
                        (F.coalesce(h, F.lit("")) != "") & (F.length(h) <= 40) & ~h.isin(RESERVED_NAMES)
                        & ~F.array_contains(acc, h),
                        h,
                    ).otherwise(F.concat(F.lit(LABEL_COLUMN_PREFIX), (i + 1).cast("string"))),
                ),
            ),
        )
        return F.transform(
            names,
            lambda n, i: _field(n, F.concat(F.lit("td:nth-of-type("), (i + 1).cast("string"), F.lit(")"))),
        )

    return F.when(F.size(cells) > 0, let(heads, named)).otherwise(F.array().cast(f"array<{FIELD_TYPE}>"))


def table_columns(nodes: Column) -> Column:
    """Fields suggested for the first row with cells of the page's first table."""
    return let(first(nodes, "tr:has(td)"), lambda r: _columns(nodes, r))


def next_selector(nodes: Column) -> Column:
    return F.coalesce(*[F.when(present(nodes, s), s) for s in NEXT_SELECTORS], F.lit(""))


def suggest_html(pages: DataFrame, keep_nodes: bool = False) -> DataFrame:
    """Adds ``row_selector``, ``fields`` and ``next_selector`` to shredded pages."""
    nodes = F.col("nodes")
    df = pages.withColumn("_best", best_scored(html_lists(nodes)))
    df = df.withColumn("_row", F.coalesce(F.col("_best.selector"), F.lit("")))
    tag = F.substring_index("_row", ".", 1)
    cls = F.when(F.col("_row").contains("."), F.regexp_replace("_row", r"^[^.]*\.", ""))

    # The sample is the first element of the chosen selector on the whole page.
    sampled = F.filter(
        nodes,
        lambda n: F.when(F.col("_row") == "", n["tag"] == "html")
        .when(F.col("_row") == "tr", (n["tag"] == "tr") & _has(nodes, n, "td"))
        .otherwise((n["tag"] == tag) & (cls.isNull() | F.array_contains(n["classes"], cls))),
    )
    df = df.withColumn("_sample", F.get(sampled, F.lit(0)))
    sample = F.col("_sample")
    df = df.withColumn(
        "_fields", F.when(sample["tag"] == "tr", _columns(nodes, sample)).otherwise(_probes(nodes, sample))
    )
    whole = F.array(_field(LABEL_CONTENT, F.when(F.col("_row") == "", "body").otherwise(":scope")))
    return df.select(
        *[c for c in pages.columns if keep_nodes or c != "nodes"],
        F.when(F.col("_row") == "tr", "tr:has(td)").otherwise(F.col("_row")).alias("row_selector"),
        unique_names(F.when(F.size("_fields") > 0, F.col("_fields")).otherwise(whole)).alias("fields"),
        next_selector(nodes).alias("next_selector"),
    )


# --- shared -------------------------------------------------------------------------------


def unique_names(fields: Column) -> Column:
    """Trims and cuts names; blank, taken and reserved ones become the next free numbered name."""
    reserved = F.array(*[F.lit(n) for n in RESERVED_NAMES])

    def step(acc: Column, f: Column) -> Column:
        names = F.transform(acc, lambda x: x["name"])
        cut = F.left(trim_all(f["name"]), F.lit(40))
        index = F.size(acc) + 1
        numbered = F.transform(
            # one more than there are names, so one is free
            F.sequence(index, index * 2), lambda k: F.concat(F.lit(LABEL_FIELD_PREFIX), k.cast("string"))
        )
        free = F.get(F.filter(numbered, lambda n: ~F.array_contains(names, n)), F.lit(0))
        bad = (cut == "") | F.array_contains(F.concat(names, reserved), cut)
        return F.array_append(acc, _field(F.when(bad, free).otherwise(cut), f["selector"], f["attribute"]))

    return F.aggregate(fields, F.array().cast(f"array<{FIELD_TYPE}>"), step)


def vote_by_host(suggestions: DataFrame, host: str = "host") -> DataFrame:
    """Most frequent suggestion per host; ties go to the smallest selector text."""
    key = ["row_selector", "fields", "next_selector"]
    counted = suggestions.groupBy(host, *key).agg(F.count(F.lit(1)).alias("votes"))
    best = F.min_by(
        F.struct(*key, "votes"), F.struct((-F.col("votes")).alias("v"), *key)
    )
    return counted.groupBy(host).agg(F.sum("votes").alias("pages"), best.alias("_b")).select(host, "pages", "_b.*")
