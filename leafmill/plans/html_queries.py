"""Registered queries: HTML extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.catalog import preset
from ..operators.frontier import route
from ..operators.html import (
    compile_rules,
    extract_html,
    extract_html_multi,
    extract_page,
    extraction_warnings,
    nodes_table,
    page_title,
    with_nodes,
)
from ..operators.profile import probe
from .common import (
    ARTICLE_RULE,
    BOOK_RULE,
    NAV_RULE,
    SQL_CATALOGUE_ROWS,
    SQL_ORIGIN,
    by_key,
    catalogue_pages,
    pages,
    spread,
    sql_encode,
    sql_unescape,
    table,
)


def html_titles(spark, sf):
    df = with_nodes(pages(spark, sf))
    return df.select("page_id", page_title(F.col("nodes"), F.col("url")).alias("title"))


HTML_TITLES = f"""
SELECT page_id, trim({sql_unescape("regexp_extract(html, '<title>([^<]*)</title>', 1)")}) AS title FROM pages
"""


def html_nav_links(spark, sf):
    return extract_html(with_nodes(pages(spark, sf)), NAV_RULE, ["page_id"])


HTML_NAV_LINKS = f"""
WITH links AS (
  SELECT page_id, url, unnest(regexp_extract_all(html, '<li><a href="([^"]*)">', 1)) AS href,
         unnest(regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a>', 1)) AS label,
         generate_subscripts(regexp_extract_all(html, '<li><a href="([^"]*)">', 1), 1) - 1 AS row_pos
  FROM pages)
SELECT page_id, CAST(row_pos AS INTEGER) AS row_pos, {sql_unescape('label')} AS text,
       {SQL_ORIGIN} || {sql_encode(sql_unescape('href'))} AS href, url AS _source
FROM links
"""


def html_links_folded(spark, sf):
    rule = {"rowSelector": "", "fields": [{"name": "links", "selector": "nav a[href]", "attribute": "href"}]}
    return extract_html(with_nodes(pages(spark, sf)), rule, ["page_id"]).select("page_id", "links")


HTML_LINKS_FOLDED = f"""
WITH links AS (
  SELECT page_id, url, unnest(regexp_extract_all(html, '<li><a href="([^"]*)">', 1)) AS href,
         generate_subscripts(regexp_extract_all(html, '<li><a href="([^"]*)">', 1), 1) AS pos
  FROM pages),
firsts AS (
  SELECT page_id, {SQL_ORIGIN} || {sql_encode(sql_unescape('href'))} AS link, min(pos) AS pos
  FROM links GROUP BY ALL)
SELECT p.page_id, coalesce(string_agg(link, chr(10) ORDER BY pos), '') AS links
FROM pages p LEFT JOIN firsts f ON p.page_id = f.page_id GROUP BY p.page_id
"""


def html_articles(spark, sf):
    return extract_html(with_nodes(pages(spark, sf)), ARTICLE_RULE, ["page_id"])


def _sql_text(x: str) -> str:
    return f"trim(regexp_replace({sql_unescape(f'''regexp_replace({x}, '<[^>]*(>|$)', '', 'g')''')}, '\\s+', ' ', 'g'))"


HTML_ARTICLES = f"""
WITH body AS (
  SELECT page_id, url, regexp_extract(html, '(?s)<article>(.*)$', 1) AS rest FROM pages),
art AS (
  SELECT page_id, url, CASE WHEN contains(rest, '</article>') THEN string_split(rest, '</article>')[1] ELSE rest END AS art FROM body),
pieces AS (
  SELECT page_id, unnest(string_split(art, '<p>')[2:]) AS piece,
         generate_subscripts(string_split(art, '<p>')[2:], 1) AS pos FROM art),
paras AS (
  SELECT page_id, {_sql_text("string_split(piece, '</p>')[1]")} AS para, pos FROM pieces),
firsts AS (SELECT page_id, para, min(pos) AS pos FROM paras WHERE para <> '' GROUP BY ALL),
joined AS (SELECT page_id, string_agg(para, chr(10) ORDER BY pos) AS paragraphs FROM firsts GROUP BY page_id)
SELECT a.page_id, CAST(0 AS INTEGER) AS row_pos,
       {_sql_text("regexp_extract(art, '<h1>(.*?)</h1>', 1)")} AS title,
       coalesce(paragraphs, '') AS paragraphs, url AS _source
FROM art a LEFT JOIN joined j ON a.page_id = j.page_id
"""


def html_tag_counts(spark, sf):
    """Corpus profile over the exploded node table."""
    nodes = nodes_table(with_nodes(pages(spark, sf)), ["page_id"])
    return nodes.filter(F.col("tag").isin("article", "h1", "nav", "li", "a", "title", "footer")).groupBy("tag").agg(
        F.count(F.lit(1)).alias("nodes"), F.count_distinct("page_id").alias("pages")
    )


HTML_TAG_COUNTS = """
WITH tags AS (SELECT unnest(['article','h1','nav','li','a','title','footer']) AS tag),
hits AS (
  SELECT tag, page_id, len(regexp_extract_all(html, '<(article|h1|nav|li|a|title|footer)[ >]', 1)
    .list_filter(lambda t: t = tag)) AS n
  FROM pages, tags)
SELECT tag, CAST(sum(n) AS BIGINT) AS nodes, count(*) FILTER (n > 0) AS pages FROM hits GROUP BY tag HAVING sum(n) > 0
"""


def html_all_tags(spark, sf):
    """Every tag of the corpus and in how many pages it stands."""
    nodes = nodes_table(with_nodes(pages(spark, sf)), ["page_id"])
    tags = nodes.where("tag not like '#%' and tag not in ('html', 'head', 'body')").groupBy("tag")
    return tags.agg(F.count_distinct("page_id").alias("pages"))


# scripts and styles are no nodes; a paragraph ends where a new one begins, so tags are counted by page
HTML_ALL_TAGS = """
WITH t AS (SELECT page_id, unnest(regexp_extract_all(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?s)(<(script|style)>).*?(</(script|style)>)', '\\1', 'g'), '<([a-z][a-z0-9]*)[ >/]', 1)) AS tag FROM pages)
SELECT tag, count(DISTINCT page_id) AS pages FROM t WHERE tag NOT IN ('html', 'head', 'body', 'script', 'style') GROUP BY tag
"""


def catalog_roundtrip(spark, sf):
    return extract_html(with_nodes(catalogue_pages(spark, sf)), BOOK_RULE, ["page_no"])


def base_href_resolve(spark, sf):
    based = catalogue_pages(spark, sf, '<base target="_top"><base href="../shop/list.html?x#y"><base href="https://elsewhere.example.net/z/">')
    return extract_html(with_nodes(based), BOOK_RULE, ["page_no"])


def catalog_multisite(spark, sf):
    """Two sites, two rules, one data-driven plan in long form."""
    books = catalogue_pages(spark, sf).select("url", "html")
    customers = table(spark, sf, "customer").withColumn("page_no", F.floor(F.col("c_custkey") / 10))
    card = F.concat(
        F.lit('<div class="quote"><span class="text">'), "c_name", F.lit('</span><small class="author">'),
        F.col("c_nationkey").cast("string"), F.lit('</small><div class="tags"><a class="tag">'),
        F.lower("c_mktsegment"), F.lit('</a> <a class="tag">'), F.col("c_custkey").cast("string"), F.lit("</a></div></div>"),
    )
    quotes = by_key(customers, "page_no").groupBy("page_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", card.alias("card")))), lambda x: x["card"]), "").alias("cards")
    ).select(
        F.concat(F.lit("https://quotes.example.com/page/"), F.col("page_no").cast("string"), F.lit("/")).alias("url"),
        F.concat(F.lit("<html><body>"), "cards", F.lit("</body></html>")).alias("html"),
    )
    quote_rule = {**preset("quotes"), "url": "https://quotes.example.com/"}
    rules = compile_rules(spark, [BOOK_RULE, quote_rule])
    routed = with_nodes(route(books.unionByName(quotes), rules))
    return extract_html_multi(routed, []).select("rule_id", "_source", "row_pos", "field_pos", "field_name", "value")


CATALOG_MULTISITE = f"""
WITH b AS ({SQL_CATALOGUE_ROWS.format(folder='catalogue/')}),
q AS (SELECT 'https://quotes.example.com/page/' || (c_custkey // 10) || '/' AS _source, c_custkey % 10 AS row_pos,
             c_name, CAST(c_nationkey AS VARCHAR) AS nation, lower(c_mktsegment) || chr(10) || c_custkey AS tags FROM customer)
SELECT 'books' AS rule_id, _source, CAST(row_pos AS INTEGER) AS row_pos, CAST(field_pos AS INTEGER) AS field_pos, field_name, value FROM (
  SELECT _source, row_pos, 0 AS field_pos, 'title' AS field_name, title AS value FROM b
  UNION ALL SELECT _source, row_pos, 1, 'price', price FROM b
  UNION ALL SELECT _source, row_pos, 2, 'stock', stock FROM b
  UNION ALL SELECT _source, row_pos, 3, 'link', link FROM b
  UNION ALL SELECT _source, row_pos, 4, 'facts', facts FROM b)
UNION ALL
SELECT 'quotes', _source, CAST(row_pos AS INTEGER), CAST(field_pos AS INTEGER), field_name, value FROM (
  SELECT _source, row_pos, 0 AS field_pos, '名言' AS field_name, c_name AS value FROM q
  UNION ALL SELECT _source, row_pos, 1, '作者', nation FROM q
  UNION ALL SELECT _source, row_pos, 2, '标签', tags FROM q)
"""


def next_links(spark, sf):
    df = extract_page(with_nodes(catalogue_pages(spark, sf)), BOOK_RULE)
    return df.select("page_no", "title", "matched", "next_url")


NEXT_LINKS = """
WITH p AS (SELECT p_partkey // 20 AS page_no, count(*) AS n FROM part GROUP BY 1)
SELECT page_no, 'Books page ' || page_no AS title, CAST(n AS INTEGER) AS matched,
       CASE WHEN page_no < (SELECT max(page_no) FROM p) THEN 'https://books.example.com/catalogue/page-' || (page_no + 1) || '.html' END AS next_url
FROM p
"""


def _sparse(spark, sf):
    """Customer cards, some without balance or segment, one page per customer."""
    c = table(spark, sf, "customer")
    return spread(
        c.select(
            "c_custkey",
            "c_nationkey",
            F.concat(F.lit("https://crm.example.com/"), F.col("c_custkey").cast("string")).alias("url"),
            F.concat(
                F.lit('<div class="card"><b class="name">'), "c_name", F.lit("</b>"),
                F.when(F.col("c_acctbal") >= 0, F.concat(F.lit('<i class="bal">'), money_text(), F.lit("</i>"))).otherwise(""),
                F.lit('<i class="seg"> '), F.when(F.col("c_nationkey") > 5, F.col("c_mktsegment")).otherwise(""), F.lit(" </i></div>"),
            ).alias("html"),
        )
    )


def money_text():
    return F.col("c_acctbal").cast("decimal(14,2)").cast("string")


SPARSE_RULE = {
    "rowSelector": ".card",
    "fields": [
        {"name": "name", "selector": ".name", "attribute": "text"},
        {"name": "balance", "selector": ".bal", "attribute": "text"},
        {"name": "segment", "selector": ".seg", "attribute": "text"},
    ],
}


def page_probe(spark, sf):
    """Probe of every page: filled fields and hit rate."""
    extracted = extract_page(with_nodes(_sparse(spark, sf)), SPARSE_RULE)
    return probe(extracted, ["name", "balance", "segment"], ["c_custkey"])


PAGE_PROBE = """
WITH f AS (SELECT c_custkey, c_acctbal >= 0 AS bal, c_nationkey > 5 AS seg FROM customer)
SELECT c_custkey, 1 AS matched, 1 AS sampled, field_pos, field_name, CAST(filled AS INTEGER) AS filled, CAST(100 * filled AS INTEGER) AS hit_rate FROM (
  SELECT c_custkey, 0 AS field_pos, 'name' AS field_name, 1 AS filled FROM f
  UNION ALL SELECT c_custkey, 1, 'balance', CAST(bal AS INTEGER) FROM f
  UNION ALL SELECT c_custkey, 2, 'segment', CAST(seg AS INTEGER) FROM f)
"""


def page_warnings(spark, sf):
    extracted = extract_page(with_nodes(_sparse(spark, sf)), SPARSE_RULE)
    return extraction_warnings(extracted, ["c_custkey"])


PAGE_WARNINGS = """
WITH w AS (
  SELECT c_custkey, 1 AS k, '「balance」没有提取到内容，请检查选择器或属性。' AS message FROM customer WHERE NOT c_acctbal >= 0
  UNION ALL SELECT c_custkey, 2, '「segment」没有提取到内容，请检查选择器或属性。' FROM customer WHERE c_nationkey <= 5)
SELECT c_custkey, CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY k) - 1 AS INTEGER) AS pos, message FROM w
"""

QUERIES = {
    "html_titles": (html_titles, HTML_TITLES),
    "html_nav_links": (html_nav_links, HTML_NAV_LINKS),
    "html_links_folded": (html_links_folded, HTML_LINKS_FOLDED),
    "html_articles": (html_articles, HTML_ARTICLES),
    "html_all_tags": (html_all_tags, HTML_ALL_TAGS),
    "html_tag_counts": (html_tag_counts, HTML_TAG_COUNTS),
    "catalog_roundtrip": (catalog_roundtrip, SQL_CATALOGUE_ROWS.format(folder="catalogue/")),
    "base_href_resolve": (base_href_resolve, SQL_CATALOGUE_ROWS.format(folder="shop/")),
    "catalog_multisite": (catalog_multisite, CATALOG_MULTISITE),
    "next_links": (next_links, NEXT_LINKS),
    "page_probe": (page_probe, PAGE_PROBE),
    "page_warnings": (page_warnings, PAGE_WARNINGS),
}
