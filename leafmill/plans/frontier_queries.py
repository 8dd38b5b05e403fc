"""Registered queries: pagination, redirects, robots, politeness."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixed import ERROR_PAGE_OTHER_ORIGIN, WARN_LANDED_REPEATED, WARN_NEXT_OTHER_ORIGIN, WARN_NEXT_REPEATED
from ..functions.urls import origin_of, parse_url
from ..functions.text import let
from ..operators.frontier import (
    page_urls,
    paginate,
    parse_robots,
    resolve_redirects,
    robots_allowed,
    schedule,
    stop_at_empty,
)
from .common import SQL_ORIGIN, spread, table


def paginate_sites(spark, sf):
    """Sites of 200 parts, 20 to a page: plain chains, chains with a loop, chains that leave the site."""
    pages = table(spark, sf, "part").select(F.floor(F.col("p_partkey") / 20).alias("n")).distinct()
    site, page = F.floor(F.col("n") / 10), F.pmod("n", F.lit(10))

    def link(s, p):
        return F.concat(F.lit("https://s"), s.cast("string"), F.lit(".example.com/p/"), p.cast("string"))

    kind = F.pmod(site, F.lit(3))
    target = (
        F.when((kind == 1) & (page == 5), link(site, F.lit(2)))
        .when((kind == 2) & (page == 4), link(site + 1, F.lit(0)))
        .when(page < 9, link(site, page + 1))
    )
    links = pages.select(link(site, page).alias("url"), target.alias("next_url"))
    seeds = pages.filter(page == 0).select(site.alias("run_id"), F.concat(link(site, F.lit(0)), F.lit("#top")).alias("url"))
    return paginate(seeds, links)


PAGINATE_SITES = f"""
WITH RECURSIVE p AS (SELECT DISTINCT p_partkey // 20 AS n FROM part),
links AS (
  SELECT n // 10 AS s, 'https://s' || (n // 10) || '.example.com/p/' || (n % 10) AS url,
         CASE WHEN (n // 10) % 3 = 1 AND n % 10 = 5 THEN 'https://s' || (n // 10) || '.example.com/p/2'
              WHEN (n // 10) % 3 = 2 AND n % 10 = 4 THEN 'https://s' || (n // 10 + 1) || '.example.com/p/0'
              WHEN n % 10 < 9 THEN 'https://s' || (n // 10) || '.example.com/p/' || (n % 10 + 1) END AS next_url FROM p),
walk AS (
  SELECT s AS run_id, 0 AS page_index, url, [url] AS seen FROM links WHERE url LIKE '%/p/0'
  UNION ALL
  SELECT w.run_id, w.page_index + 1, l.next_url, list_append(w.seen, l.next_url) FROM walk w JOIN links l ON l.url = w.url
  WHERE l.next_url IS NOT NULL AND NOT list_contains(w.seen, l.next_url)
    AND split_part(l.next_url, '/p/', 1) = split_part(w.url, '/p/', 1))
SELECT w.run_id, CAST(w.page_index AS INTEGER) AS page_index, w.url,
  CASE WHEN split_part(l.next_url, '/p/', 1) <> split_part(w.url, '/p/', 1) THEN '{WARN_NEXT_OTHER_ORIGIN}'
       WHEN list_contains(w.seen, l.next_url) THEN '{WARN_NEXT_REPEATED}' END AS stop_reason
FROM walk w LEFT JOIN links l ON l.url = w.url
"""


def paginate_redirects(spark, sf):
    """The same sites behind redirects: plain ones, a landing on a visited page, on another site, in a loop of
    redirects, and a next link that is the redirected seed."""
    pages = table(spark, sf, "part").select(F.floor(F.col("p_partkey") / 20).alias("n")).distinct()
    site, page = F.floor(F.col("n") / 10), F.pmod("n", F.lit(10))
    kind = F.pmod(site, F.lit(5))

    def link(path, p="", s=site):
        return F.concat(F.lit("https://s"), s.cast("string"), F.lit(f".example.com/{path}"), F.lit(p) if isinstance(p, str) else p.cast("string"))

    target = (
        F.when((kind == 0) & (page < 9), link("r/", page + 1))
        .when((kind == 1) & (page == 5), link("r/", F.lit(2)))
        .when((kind == 2) & (page == 4), link("out"))
        .when((kind == 3) & (page == 6), link("loop"))
        .when((kind == 4) & (page == 3), link("r/", F.lit(0)))
        .when(page < 9, link("p/", page + 1))
    )
    links = pages.select(link("p/", page).alias("url"), target.alias("next_url"))
    moved = [(link("r/", page), link("p/", page)), (link("out"), link("p/0", s=site + 1)), (link("loop"), link("pool")), (link("pool"), link("loop"))]
    answers = [F.struct(link("p/", page).alias("url"), F.lit(200).alias("status"), F.lit(None).cast("string").alias("location"))]
    answers += [F.struct(a.alias("url"), F.lit(302).alias("status"), b.alias("location")) for a, b in moved]
    log = pages.select(F.inline(F.array(*answers))).distinct()
    seeds = pages.filter(page == 0).select(site.alias("run_id"), link("", F.when(kind == 4, "r/0").otherwise("p/0")).alias("url"))
    return paginate(seeds, links, fetch_log=log)


PAGINATE_REDIRECTS = f"""
WITH p AS (SELECT DISTINCT p_partkey // 20 AS n FROM part),
s AS (SELECT n // 10 AS s, max(n % 10) AS m, CASE (n // 10) % 5 WHEN 0 THEN 9 WHEN 1 THEN 5 WHEN 2 THEN 4 WHEN 3 THEN 6 ELSE 3 END AS stop FROM p GROUP BY 1)
SELECT s AS run_id, CAST(i AS INTEGER) AS page_index, 'https://s' || s || '.example.com/p/' || i AS url,
  CASE WHEN i < least(m, stop) THEN NULL WHEN m < stop THEN 'no response'
       WHEN s % 5 = 1 THEN '{WARN_LANDED_REPEATED}' WHEN s % 5 = 2 THEN '{ERROR_PAGE_OTHER_ORIGIN}'
       WHEN s % 5 = 3 THEN 'too many redirects' WHEN s % 5 = 4 THEN '{WARN_NEXT_REPEATED}' END AS stop_reason
FROM (SELECT *, unnest(range(least(m, stop) + 1)) AS i FROM s)
"""


def page_param_urls(spark, sf):
    c = table(spark, sf, "customer")
    rules = c.select(
        F.col("c_custkey").alias("rule_id"),
        F.concat(F.lit("https://api.example.com/list?page=99&seg="), F.lower("c_mktsegment"), F.lit("&page=7#x")).alias("url"),
        F.when(F.col("c_nationkey") > 3, "page").otherwise("p").alias("page_param"),
        F.col("c_nationkey").alias("start_page"),
        (F.pmod("c_nationkey", F.lit(3)) + 1).cast("int").alias("max_pages"),
    )
    return page_urls(rules).select("rule_id", "page_index", "page_url")


PAGE_PARAM_URLS = """
SELECT c_custkey AS rule_id, CAST(i AS INTEGER) AS page_index,
  CASE WHEN c_nationkey > 3 THEN 'https://api.example.com/list?page=' || (c_nationkey + i) || '&seg=' || lower(c_mktsegment)
       ELSE 'https://api.example.com/list?page=99&seg=' || lower(c_mktsegment) || '&page=7&p=' || (c_nationkey + i) END AS page_url
FROM (SELECT *, unnest(range(c_nationkey % 3 + 1)) AS i FROM customer)
"""


def empty_page_stop(spark, sf):
    """Page statistics of runs of 40 orders; a page is empty when its order is open."""
    o = table(spark, sf, "orders").select(
        F.floor(F.col("o_orderkey") / 40).alias("run_id"),
        F.pmod("o_orderkey", F.lit(40)).alias("page_index"),
        F.when(F.col("o_orderstatus") == "O", 0).otherwise(F.month("o_orderdate")).alias("rows"),
    )
    return stop_at_empty(o)


EMPTY_PAGE_STOP = """
WITH o AS (SELECT o_orderkey // 40 AS run_id, o_orderkey % 40 AS page_index, CASE WHEN o_orderstatus = 'O' THEN 0 ELSE month(o_orderdate) END AS rows FROM orders)
SELECT run_id, page_index, CAST(rows AS INTEGER) AS rows FROM (
  SELECT *, count(*) FILTER (rows = 0) OVER (PARTITION BY run_id ORDER BY page_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM o)
WHERE before = 0
"""


def redirect_chains(spark, sf):
    """Every order is a URL; it redirects to half its key until the key is odd."""
    o = spread(table(spark, sf, "orders"))

    def link(k):
        return F.concat(F.lit("https://r.example.com/"), k.cast("string"))

    key = F.col("o_orderkey")
    moved = (key % 2 == 0) & (key > 0)
    log = o.select(
        link(key).alias("url"),
        F.when(moved, F.when(key % 4 == 0, 301).otherwise(307)).when(key % 5 == 0, 404).otherwise(200).alias("status"),
        F.when(moved & (key % 100 != 2), F.concat(F.lit("/"), F.floor(key / 2).cast("string"))).alias("location"),
    )
    requests = o.select(
        key.alias("request_id"),
        link(key).alias("url"),
        F.when(F.col("o_orderstatus") == "P", "POST").otherwise("GET").alias("method"),
        F.lit(True).alias("same_origin"),
    )
    return resolve_redirects(requests, log)


REDIRECT_CHAINS = """
WITH RECURSIVE log AS (
  SELECT o_orderkey AS k, o_orderkey % 2 = 0 AND o_orderkey > 0 AS moved,
    CASE WHEN o_orderkey % 2 = 0 AND o_orderkey > 0 THEN CASE WHEN o_orderkey % 4 = 0 THEN 301 ELSE 307 END
         WHEN o_orderkey % 5 = 0 THEN 404 ELSE 200 END AS status,
    o_orderkey % 100 <> 2 AS has_location FROM orders),
walk AS (
  SELECT o_orderkey AS request_id, o_orderkey AS k, 0 AS hops, o_orderstatus = 'P' AS post FROM orders
  UNION ALL
  SELECT w.request_id, w.k // 2, w.hops + 1, w.post FROM walk w JOIN log l ON l.k = w.k
  WHERE l.moved AND l.has_location AND NOT w.post)
SELECT request_id, 'https://r.example.com/' || request_id AS url, 'https://r.example.com/' || w.k AS final_url, CAST(hops AS INTEGER) AS hops,
  CAST(l.status AS INTEGER) AS status,
  CASE WHEN l.k IS NULL THEN 'no response' WHEN l.moved AND NOT has_location THEN 'invalid redirect' WHEN l.moved AND post THEN 'redirected POST' END AS reason
FROM (SELECT * FROM walk QUALIFY hops = max(hops) OVER (PARTITION BY request_id)) w LEFT JOIN log l ON l.k = w.k
"""


def _origins(spark, sf):
    p = spread(table(spark, sf, "pages"))
    return p.select("page_id", "url", let(parse_url(F.col("url")), origin_of).alias("origin"))


def _robots(spark, sf):
    """One robots file per site of the page table; its form depends on the length of the origin."""
    form = F.pmod(F.length("origin"), F.lit(5))
    body = F.concat(
        F.lit("# rules\nUser-agent: other\nDisallow: /\n\nUser-Agent: *\nDisallow: /en/\nAllow: /en/1\nDisallow: /*?utm\nDisallow: /fr/$\n"),
        F.when(form == 1, "Crawl-delay: 2.5\n").when(form == 2, "Crawl-delay: 20\n").otherwise(""),
        F.when(form == 3, "User-agent: leafmill\nUser-agent: else\nDisallow: /es # all\nAllow: /es/\n").otherwise(""),
        F.lit("Sitemap: https://x.example.com/s.xml\n"),
    )
    status = F.when(form == 4, F.when(F.col("origin").contains("org"), 404).otherwise(503)).otherwise(200)
    return _origins(spark, sf).select("origin").distinct().select("origin", status.alias("status"), body.alias("body"))


SQL_ROBOTS = f"""
r AS (SELECT DISTINCT {SQL_ORIGIN} AS origin FROM pages), f AS (SELECT origin, length(origin) % 5 AS form FROM r)
"""


def robots_groups(spark, sf):
    rows = parse_robots(_robots(spark, sf).filter("status = 200").select("origin", "body"))
    return rows.groupBy("origin").agg(
        F.max("group_id").alias("groups"),
        F.count_if(F.col("field") == "user-agent").alias("agents"),
        F.count_if(F.col("field").isin("allow", "disallow")).alias("rules"),
        F.max(F.when(F.col("field") == "crawl-delay", F.col("value"))).alias("delay"),
    )


ROBOTS_GROUPS = f"""
WITH {SQL_ROBOTS}
SELECT origin, CAST(CASE WHEN form = 3 THEN 3 ELSE 2 END AS BIGINT) AS groups, CAST(CASE WHEN form = 3 THEN 4 ELSE 2 END AS BIGINT) AS agents,
       CAST(CASE WHEN form = 3 THEN 7 ELSE 5 END AS BIGINT) AS rules, CASE form WHEN 1 THEN '2.5' WHEN 2 THEN '20' END AS delay
FROM f WHERE form < 4
"""


def robots_admission(spark, sf):
    return robots_allowed(_origins(spark, sf).drop("origin"), _robots(spark, sf), "leafmill").select(
        "page_id", "robots", "allowed", "interval_ms"
    )


ROBOTS_ADMISSION = f"""
WITH {SQL_ROBOTS},
u AS (SELECT page_id, {SQL_ORIGIN} AS origin, regexp_replace(regexp_replace(url, '^https?://[^/?#]+', ''), '#.*$', '') AS path FROM pages),
j AS (SELECT u.*, form FROM u JOIN f USING (origin))
SELECT page_id,
  CASE WHEN form = 4 THEN CASE WHEN contains(origin, 'org') THEN 'allow all' ELSE 'rules unavailable' END ELSE 'rules' END AS robots,
  CASE WHEN form = 4 THEN contains(origin, 'org')
       WHEN form = 2 THEN false
       WHEN form = 3 THEN NOT starts_with(path, '/es') OR starts_with(path, '/es/')
       ELSE CASE WHEN regexp_matches(path, '^/.*\\?utm') THEN false
                 WHEN starts_with(path, '/en/1') THEN true
                 WHEN starts_with(path, '/en/') OR path = '/fr/' THEN false ELSE true END END AS allowed,
  CAST(CASE form WHEN 1 THEN 2500 WHEN 2 THEN NULL ELSE 1000 END AS BIGINT) AS interval_ms
FROM j
"""


def politeness(spark, sf):
    """Events as requests: ten origins, arrival in milliseconds, interval by event type."""
    millis = F.unix_millis(F.col("ts").cast("timestamp"))
    e = table(spark, sf, "events")
    requests = e.select(
        F.col("event_id").alias("request_id"),
        F.pmod("user_id", F.lit(10)).alias("origin"),
        # one burst per day, so that requests queue up
        (F.floor(millis / 86_400_000) * 86_400_000 + F.pmod(millis, F.lit(50_000))).alias("arrival_ms"),
        F.when(F.col("event_type") == "error", 5000).when(F.col("event_type") == "click", 2000).otherwise(1000).cast("long").alias("interval_ms"),
    )
    return schedule(requests, chunk_ms=20_000).select("request_id", "start_ms", "wait_ms")


POLITENESS = """
WITH e AS (
  SELECT event_id AS request_id, user_id % 10 AS origin,
    epoch_us(ts) // 86400000000 * 86400000 + (epoch_us(ts) // 1000) % 50000 AS arrival,
    CASE event_type WHEN 'error' THEN 5000 WHEN 'click' THEN 2000 ELSE 1000 END AS own FROM events),
g AS (SELECT *, coalesce(greatest(own, lag(own) OVER w), 0) AS gap FROM e WINDOW w AS (PARTITION BY origin ORDER BY arrival, request_id)),
s AS (SELECT *, sum(gap) OVER (PARTITION BY origin ORDER BY arrival, request_id) AS total FROM g),
r AS (SELECT *, total + max(arrival - total) OVER (PARTITION BY origin ORDER BY arrival, request_id) AS start FROM s)
SELECT request_id, CAST(start AS BIGINT) AS start_ms, CAST(start - arrival AS BIGINT) AS wait_ms FROM r
"""

QUERIES = {
    "paginate_sites": (paginate_sites, PAGINATE_SITES),
    "paginate_redirects": (paginate_redirects, PAGINATE_REDIRECTS),
    "page_param_urls": (page_param_urls, PAGE_PARAM_URLS),
    "empty_page_stop": (empty_page_stop, EMPTY_PAGE_STOP),
    "redirect_chains": (redirect_chains, REDIRECT_CHAINS),
    "robots_groups": (robots_groups, ROBOTS_GROUPS),
    "robots_admission": (robots_admission, ROBOTS_ADMISSION),
    "politeness": (politeness, POLITENESS),
}
