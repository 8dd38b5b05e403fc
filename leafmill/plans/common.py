"""Shared pieces of the registered queries: table access and derived corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import tune

PER_PAGE = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """More partitions for compute-heavy work, only where the scan gives fewer than cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def by_key(df: DataFrame, key: str) -> DataFrame:
    """Partitions a corpus by its page key, so the grouping and the extraction after it share one
    shuffle; the count follows the cluster and is not coalesced below it."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    # a partition count left at its default on a small machine would only make tiny tasks
    wanted = max(cores, min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * cores))
    return df.repartition(wanted, key)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages"))


def money(column: str):
    return F.col(column).cast("decimal(14,2)").cast("string")


def catalogue_pages(spark: SparkSession, sf_dir: str, head: str = "") -> DataFrame:
    """Product pages built from part: (page_no, url, html), PER_PAGE products on each.

    p_partkey is unique, so a page collects a fixed number of rows.
    """
    part = table(spark, sf_dir, "part").withColumn("page_no", F.floor(F.col("p_partkey") / PER_PAGE))
    item = F.concat(
        F.lit('<article class="product_pod"><h3><a title="'), "p_name", F.lit(" &amp; co "), F.col("p_partkey").cast("string"),
        F.lit('" href="item/'), F.col("p_partkey").cast("string"), F.lit('.html">'), "p_name",
        F.lit('</a></h3><p class="price_color"> £'), money("p_retailprice"),
        F.lit('  </p><p class="instock availability">In   stock</p><ul class="facts"><li>'), "p_brand",
        F.lit("<li>"), "p_type", F.lit("</ul></article>"),
    )
    grouped = by_key(part, "page_no").groupBy("page_no").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", item.alias("item")))), lambda x: x["item"]), ""
        ).alias("items")
    )
    following = grouped.select((F.col("page_no") - 1).alias("page_no"), F.lit(True).alias("more"))
    link = F.when(
        F.col("more"),
        F.concat(F.lit('<ul class="pager"><li class="next"><a href="page-'), (F.col("page_no") + 1).cast("string"), F.lit('.html">next</a></li></ul>')),
    ).otherwise("")
    number = F.col("page_no").cast("string")
    return grouped.join(following, ["page_no"], "left").select(
        "page_no",
        F.concat(F.lit("https://books.example.com/catalogue/page-"), number, F.lit(".html")).alias("url"),
        F.concat(
            F.lit("<html><head><title>Books page "), number, F.lit("</title>" + head + "</head><body>"),
            "items", link, F.lit("</body></html>"),
        ).alias("html"),
    )


BOOK_RULE = {
    "id": "books",
    "url": "https://books.example.com/",
    "rowSelector": "article.product_pod",
    "nextSelector": "li.next a",
    "fields": [
        {"name": "title", "selector": "h3 a", "attribute": "title"},
        {"name": "price", "selector": ".price_color", "attribute": "text"},
        {"name": "stock", "selector": ".instock.availability", "attribute": "text"},
        {"name": "link", "selector": "h3 a", "attribute": "href"},
        {"name": "facts", "selector": ".facts li", "attribute": "text"},
    ],
}

NAV_RULE = {
    "rowSelector": "nav li",
    "fields": [
        {"name": "text", "selector": "a", "attribute": "text"},
        {"name": "href", "selector": "a", "attribute": "href"},
    ],
}

ARTICLE_RULE = {
    "rowSelector": "article",
    "fields": [
        {"name": "title", "selector": "h1", "attribute": "text"},
        {"name": "paragraphs", "selector": "p", "attribute": "text"},
    ],
}

# --- DuckDB snippets ----------------------------------------------------------------------


def sql_unescape(x: str) -> str:
    """The entities that occur in the page table; the ampersand comes last."""
    return (
        f"replace(replace(replace(replace(replace(replace({x}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), "
        f"'&lt;', '<'), '&gt;', '>'), '&amp;', '&')"
    )


def sql_encode(x: str) -> str:
    """Percent-encodes blanks and everything outside ASCII, one character at a time."""
    return (
        f"array_to_string(list_transform(string_split({x}, ''), lambda c: CASE WHEN ord(c) > 126 OR ord(c) < 33 "
        f"THEN url_encode(c) ELSE c END), '')"
    )


SQL_ORIGIN = "regexp_extract(url, '^(https?://[^/?#]+)', 1)"
SQL_CATALOGUE_ROWS = """
SELECT p_partkey // 20 AS page_no, CAST(p_partkey % 20 AS INTEGER) AS row_pos,
       p_name || ' & co ' || p_partkey AS title,
       '£' || CAST(CAST(p_retailprice AS DECIMAL(14,2)) AS VARCHAR) AS price,
       'In stock' AS stock,
       'https://books.example.com/{folder}item/' || p_partkey || '.html' AS link,
       CASE WHEN p_brand = p_type THEN p_brand ELSE p_brand || chr(10) || p_type END AS facts,
       'https://books.example.com/catalogue/page-' || (p_partkey // 20) || '.html' AS _source
FROM part
"""
