"""Rule catalogue: reading, validation, presets, edits."""

from __future__ import annotations

import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import fixed
from ..fixed import (
    ATTRIBUTE_PATTERN,
    DENIED_HEADER_PREFIXES,
    DENIED_HEADERS,
    PAGE_PARAM_PATTERN,
    RESERVED_NAMES,
)
from ..functions import selectors
from ..functions.jsonpath import normalize_path
from ..functions.selectors import is_valid_selector
from ..functions.text import is_blank, trim_all, unnest
from ..schemas import CONFIG, RULES
from ..session import small_table
from .caps import prefix_sum
from .runs import redact_config

for module in (fixed, selectors, sys.modules[__name__]):
    cloudpickle.register_pickle_by_value(module)

MAX_SELECTOR_CHARS = 300

# --- built-in rules (fixed values) ---
PRESETS = [
    {
        "id": "generic",
        "name": "通用网页",
        "url": "",
        "sourceType": "html",
        "rowSelector": "",
        "nextSelector": "",
        "maxPages": 1,
        "fields": [
            {"id": "title", "name": "标题", "selector": "h1", "attribute": "text"},
            {"id": "description", "name": "描述", "selector": 'meta[name="description"]', "attribute": "content"},
            {"id": "links", "name": "链接", "selector": "a[href]", "attribute": "href"},
        ],
    },
    {
        "id": "books",
        "name": "Books to Scrape · 书籍",
        "url": "https://books.toscrape.com/",
        "sourceType": "html",
        "rowSelector": "article.product_pod",
        "nextSelector": "li.next a",
        "maxPages": 1,
        "fields": [
            {"id": "title", "name": "书名", "selector": "h3 a", "attribute": "title"},
            {"id": "price", "name": "价格", "selector": ".price_color", "attribute": "text"},
            {"id": "stock", "name": "库存", "selector": ".instock.availability", "attribute": "text"},
            {"id": "link", "name": "详情链接", "selector": "h3 a", "attribute": "href"},
        ],
    },
    {
        "id": "quotes",
        "name": "Quotes to Scrape · 名言",
        "url": "https://quotes.toscrape.com/",
        "sourceType": "html",
        "rowSelector": ".quote",
        "nextSelector": ".pager .next a",
        "maxPages": 1,
        "fields": [
            {"id": "quote", "name": "名言", "selector": ".text", "attribute": "text"},
            {"id": "author", "name": "作者", "selector": ".author", "attribute": "text"},
            {"id": "tags", "name": "标签", "selector": ".tags .tag", "attribute": "text"},
        ],
    },
    {
        "id": "article",
        "name": "通用文章模板",
        "url": "",
        "sourceType": "html",
        "rowSelector": "",
        "nextSelector": "",
        "maxPages": 1,
        "fields": [
            {"id": "title", "name": "标题", "selector": "h1", "attribute": "text"},
            {"id": "body", "name": "正文", "selector": "article", "attribute": "text"},
            {"id": "date", "name": "发布时间", "selector": "time[datetime]", "attribute": "datetime"},
        ],
    },
    {
        "id": "json",
        "name": "自定义 JSON 接口",
        "url": "",
        "sourceType": "json",
        "rowSelector": "data.items",
        "nextSelector": "",
        "maxPages": 1,
        "fields": [
            {"id": "id", "name": "ID", "selector": "id", "attribute": "text"},
            {"id": "title", "name": "标题", "selector": "title", "attribute": "text"},
        ],
    },
]


def preset(rule_id: str) -> dict:
    return next(p for p in PRESETS if p["id"] == rule_id)


# --- checks -------------------------------------------------------------------------------


def _valid_selectors(texts: pa.Array) -> pa.Array:
    return pa.array([t is not None and is_valid_selector(t) for t in texts.to_pylist()], pa.bool_())


def valid_selector(c: Column) -> Column:
    """Whether a selector column can be compiled; a short text check per rule, not per page."""
    return F.arrow_udf(_valid_selectors, "boolean")(c)


def header_violations(headers: Column) -> Column:
    """Codes of broken header rules, as an array."""
    names = F.transform(F.map_keys(headers), lambda k: F.lower(k))
    values = F.map_values(headers)
    checks = [
        (F.size(names) > 16, "too many headers"),
        (F.exists(values, lambda v: v.isNull() | (F.length(v) > 2048)), "header value too long"),
        (
            F.exists(names, lambda n: ~n.rlike(r"^[!#$%&'*+.^_`|~0-9a-z-]+$"))
            | F.exists(values, lambda v: v.rlike(r"[^\t\x20-\x7e\x80-\xff]")),
            "header syntax",
        ),
        (F.size(F.array_distinct(names)) < F.size(names), "header repeated"),
        (
            F.exists(
                names,
                lambda n: n.isin(DENIED_HEADERS) | n.rlike("^(" + "|".join(DENIED_HEADER_PREFIXES) + ")"),
            ),
            "header not allowed",
        ),
    ]
    return _codes(checks)


def _codes(checks: list[tuple[Column, str]]) -> Column:
    return F.filter(
        F.array(*[F.when(F.coalesce(bad, F.lit(True)), code) for bad, code in checks]), lambda c: c.isNotNull()
    )


def api_violations(api: Column) -> Column:
    """Codes of broken request options; an absent struct is one violation."""
    method, body = api["method"], F.coalesce(api["body"], F.lit(""))
    param = api["pageParam"]
    checks = [
        (~method.isin("GET", "POST"), "method"),
        (api["headers"].isNull(), "headers missing"),
        (api["body"].isNull() | (F.octet_length(body) > 16_384), "body too long"),
        ((method == "POST") & ~is_blank(body) & F.try_parse_json(body).isNull(), "body not JSON"),
        ((method == "GET") & ~is_blank(body), "GET with body"),
        (param.isNull() | ((param != "") & ~param.rlike(PAGE_PARAM_PATTERN)), "page parameter"),
        (~api["startPage"].between(0, 10_000), "start page"),
    ]
    headers = F.when(api["headers"].isNotNull(), header_violations(api["headers"])).otherwise(F.array().cast("array<string>"))
    return F.when(api.isNull(), F.array(F.lit("api missing"))).otherwise(F.concat(_codes(checks), headers))


def rule_violations(config: Column, selector_ok: Column) -> Column:
    """Codes of everything wrong with a rule.

    ``selector_ok`` maps a trimmed selector text to whether it compiles; JSON rules check their
    paths by expression.
    """
    c = config
    is_json = F.coalesce(c["sourceType"] == "json", F.lit(False))
    blank = F.lit("")

    def bad_selector(s: Column, optional: bool) -> Column:
        text = trim_all(s)
        broken = F.when(is_json, normalize_path(text).isNull()).otherwise(
            ~F.coalesce(F.try_element_at(selector_ok, text), F.lit(False))
        )
        empty = F.lit(False) if optional else text == ""
        return s.isNull() | (F.length(s) > MAX_SELECTOR_CHARS) | empty | ((text != "") & broken)

    fields = F.coalesce(c["fields"], F.array().cast("array<struct<id:string,name:string,selector:string,attribute:string>>"))
    names = F.transform(fields, lambda f: trim_all(f["name"]))
    paged = F.when(is_json, F.coalesce(c["api"]["pageParam"], blank) != "").otherwise(
        ~is_blank(c["nextSelector"])
    )
    checks = [
        (c["sourceType"].isNotNull() & ~c["sourceType"].isin("html", "json"), "source type"),
        (c["renderMode"].isNotNull() & ~c["renderMode"].isin("static", "browser"), "render mode"),
        (is_json & F.coalesce(c["renderMode"] == "browser", F.lit(False)), "rendered JSON"),
        (~F.coalesce(c["renderWaitMs"], F.lit(2000)).between(0, 10_000), "render wait"),
        (c["url"].isNull() | (F.length(c["url"]) > 2048), "url"),
        (~F.size(fields).between(1, 12), "field count"),
        (bad_selector(c["rowSelector"], True), "row selector"),
        (~is_json & bad_selector(F.coalesce(c["waitSelector"], blank), True), "wait selector"),
        (~is_json & bad_selector(c["nextSelector"], True), "next selector"),
        (~c["maxPages"].between(1, 10), "page count"),
        ((c["maxPages"] > 1) & ~paged, "paging"),
        (F.exists(fields, lambda f: is_blank(f["name"]) | (F.length(f["name"]) > 40)), "field name"),
        (F.size(F.array_distinct(names)) < F.size(names), "field name repeated"),
        (F.exists(names, lambda n: n.isin(RESERVED_NAMES)), "field name reserved"),
        (F.exists(fields, lambda f: bad_selector(f["selector"], False)), "field selector"),
        (F.exists(fields, lambda f: ~F.coalesce(f["attribute"], blank).rlike(ATTRIBUTE_PATTERN)), "field attribute"),
    ]
    api = F.when(is_json, api_violations(c["api"])).otherwise(F.array().cast("array<string>"))
    return F.concat(_codes(checks), api)


def _selector_texts(config: Column) -> Column:
    listed = F.concat(
        F.array(config["rowSelector"], config["nextSelector"], F.coalesce(config["waitSelector"], F.lit(""))),
        F.coalesce(F.transform(config["fields"], lambda f: f["selector"]), F.array().cast("array<string>")),
    )
    trimmed = F.transform(listed, lambda s: trim_all(F.coalesce(s, F.lit(""))))
    return F.array_distinct(trimmed)


def _checked(texts: pa.Array) -> pa.Array:
    rows = [[(t, is_valid_selector(t)) for t in row or []] for row in texts.to_pylist()]
    return pa.array(rows, pa.map_(pa.string(), pa.bool_()))


def with_violations(rules: DataFrame) -> DataFrame:
    """Adds ``violations`` (array of codes, empty for a valid rule)."""
    checked = F.arrow_udf(_checked, "map<string,boolean>").asNondeterministic()
    df = rules.withColumn("_selectors", checked(_selector_texts(F.col("config"))))
    return df.withColumn("violations", rule_violations(F.col("config"), F.col("_selectors"))).drop("_selectors")


def normalize_config(config: Column) -> Column:
    """A valid rule with defaults filled in and texts trimmed."""
    is_json = F.coalesce(config["sourceType"] == "json", F.lit(False))
    fields = F.transform(
        config["fields"],
        lambda f: f.withField("name", trim_all(f["name"])).withField("selector", trim_all(f["selector"])),
    )
    return (
        config.withField("sourceType", F.when(is_json, "json").otherwise("html"))
        .withField("renderMode", F.coalesce(config["renderMode"], F.lit("static")))
        .withField("renderWaitMs", F.coalesce(config["renderWaitMs"], F.lit(2000)))
        .withField("waitSelector", F.when(is_json, "").otherwise(trim_all(F.coalesce(config["waitSelector"], F.lit("")))))
        .withField("rowSelector", trim_all(config["rowSelector"]))
        .withField("nextSelector", F.when(is_json, "").otherwise(trim_all(config["nextSelector"])))
        .withField("fields", fields)
        .withField("api", F.when(is_json, config["api"]))
    )


def validate_rules(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rules in normal form, violations as (id, pos, violation))."""
    checked = with_violations(rules)
    valid = checked.filter(F.size("violations") == 0).drop("violations")
    broken = unnest(checked, ["id"], "violations", "pos", "violation")
    return valid.withColumn("config", normalize_config(F.col("config"))), broken


def storable(rules: DataFrame) -> Column:
    """The looser shape test a stored rule has to pass."""
    c = F.col("config")
    api = c["api"]
    shape = (
        F.coalesce(c["renderMode"], F.lit("static")).isin("static", "browser")
        & F.coalesce(c["renderWaitMs"], F.lit(0)).between(0, 10_000)
        & (F.length(F.coalesce(c["waitSelector"], F.lit(""))) <= MAX_SELECTOR_CHARS)
        & (F.length(c["url"]) <= 2048)
        & c["rowSelector"].isNotNull()
        & c["nextSelector"].isNotNull()
        & c["maxPages"].between(1, 10)
        & F.coalesce(c["sourceType"], F.lit("html")).isin("html", "json")
        & F.size(c["fields"]).between(1, 12)
        & F.forall(
            c["fields"],
            lambda f: F.forall(
                F.array(f["id"], f["name"], f["selector"], f["attribute"]),
                lambda x: x.isNotNull() & (F.length(x) <= MAX_SELECTOR_CHARS),
            ),
        )
    )
    request = (
        api["method"].isin("GET", "POST")
        & api["headers"].isNotNull()
        & F.forall(F.map_values(api["headers"]), lambda v: v.isNotNull())
        & api["body"].isNotNull()
        & api["pageParam"].isNotNull()
        & api["startPage"].between(0, 10_000)
    )
    named = F.col("id").isNotNull() & ~is_blank(F.col("name")) & (F.length("name") <= 50) & F.col("updatedAt").isNotNull()
    return F.coalesce(named & shape & ((F.coalesce(c["sourceType"], F.lit("html")) != "json") | request), F.lit(False))


def keep_rules(rules: DataFrame, owner: list[str] | None = None, max_rules: int | None = None) -> DataFrame:
    """Usable stored rules: valid ones, first of equal ids, redacted; ``max_rules`` of an owner, if given.

    ``pos`` is the position in the catalogue.
    """
    keys = owner or []
    valid = rules.filter(storable(rules))
    first = valid.groupBy(*keys, "id").agg(
        F.min_by(F.struct(*[c for c in rules.columns if c not in (*keys, "id")]), "pos").alias("_r")
    ).select(*keys, "id", "_r.*")
    if max_rules is not None:
        w = W.partitionBy(*(keys or [F.lit(0)])).orderBy("pos")
        first = first.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= max_rules).drop("_rank")
    return first.withColumn("config", redact_config(F.col("config"))).select(*rules.columns)


def read_rules(spark: SparkSession, path: str, max_rules: int | None = None) -> DataFrame:
    """Stored rule files (each one JSON array) as (file, pos, id, name, config, updatedAt)."""
    raw = spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("file"), F.from_json("value", "array<string>").alias("_items")
    )
    entries = unnest(raw, ["file"], "_items", "pos", "_json")
    parsed = entries.select("file", "pos", F.from_json("_json", RULES).alias("_r")).select("file", "pos", "_r.*")
    return keep_rules(parsed, ["file"], max_rules)


def upsert_rules(
    catalogue: DataFrame, changes: DataFrame, owner: list[str] | None = None, max_rules: int | None = None
) -> DataFrame:
    """Replaces rules by id in place and appends new ones; where ``max_rules`` is given, while an owner has room.

    Both sides have (owner columns, pos, id, name, config, updatedAt). New rules are ranked block by block,
    so no task sees all of them, and meet the size of their owner's catalogue by an equi-join.
    """
    columns, keys = catalogue.columns, owner or ["_all"]
    if not owner:
        catalogue, changes = catalogue.withColumn("_all", F.lit(0)), changes.withColumn("_all", F.lit(0))
    ids = [*keys, "id"]
    replaced = catalogue.select("pos", *ids).join(changes.drop("pos"), ids)
    untouched = catalogue.join(changes.select(*ids), ids, "left_anti")
    size = catalogue.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.max("pos").alias("_last"))
    fresh = changes.join(catalogue.select(*ids), ids, "left_anti")
    # ranks in two levels: rows are counted per block of positions, only blocks pass through an owner's window
    block = F.floor(F.col("pos") / 4096)
    ranked = prefix_sum(fresh.withColumns({"_block": block, "_one": F.lit(1)}), keys, ["_block"], ["pos", "id"], "_one", "_rank").drop("_block", "_one")
    if max_rules is not None:
        ranked = ranked.filter(F.col("_rank") <= max_rules)
    added = ranked.join(size, keys, "left")
    if max_rules is not None:
        added = added.filter(F.coalesce("_n", F.lit(0)) + F.col("_rank") <= max_rules)
    added = added.withColumn("pos", (F.coalesce("_last", F.lit(-1)) + F.col("_rank")).cast("int"))
    out = untouched.select(*columns).unionByName(replaced.select(*columns)).unionByName(added.select(*columns))
    return out.withColumn("config", redact_config(F.col("config")))


def delete_rules(catalogue: DataFrame, ids: DataFrame) -> DataFrame:
    return catalogue.join(ids.select("id"), ["id"], "left_anti").select(*catalogue.columns)


def clear_pointer(pointer: DataFrame, ids: DataFrame) -> DataFrame:
    """The last-used pointer goes only if it named a deleted rule."""
    return delete_rules(pointer, ids)


def presets(spark: SparkSession) -> DataFrame:
    """The built-in rules as a catalogue table."""
    rows = [
        (
            i, p["id"], p["name"],
            dict(
                url=p["url"], sourceType=p["sourceType"], renderMode=None, renderWaitMs=None, waitSelector=None,
                rowSelector=p["rowSelector"], nextSelector=p["nextSelector"], maxPages=p["maxPages"],
                fields=[tuple(f[k] for k in ("id", "name", "selector", "attribute")) for f in p["fields"]],
                api=("GET", {}, "", "", 1) if p["sourceType"] == "json" else None,
            ),
            "",
        )
        for i, p in enumerate(PRESETS)
    ]
    return small_table(spark, rows, f"pos int, id string, name string, config {CONFIG}, updatedAt string")
