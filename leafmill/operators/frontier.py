"""Pagination, redirects, robots rules and politeness over crawl logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..fixed import (
    ERROR_PAGE_OTHER_ORIGIN,
    MAX_CRAWL_DELAY_SECONDS,
    MIN_INTERVAL_MS,
    WARN_LANDED_REPEATED,
    WARN_NEXT_OTHER_ORIGIN,
    WARN_NEXT_REPEATED,
)
from ..functions.text import let, unnest
from ..functions.urls import build_url, host_of, origin_of, parse_url, percent_encode, resolve_url, set_query_param
from ..session import materialize
from .admission import admitted_url
from .chains import follow_chains


def salted_lookup(left: DataFrame, right: DataFrame, keys: list[str], spread: str, salts: int = 8) -> DataFrame:
    """Left join to a table with one row per key, spreading hot keys of ``left``.

    Rows of a hot key go to ``salts`` partitions by a hash of column ``spread``; each right row is
    repeated once per salt. Where the right side is small enough, Spark broadcasts it instead.
    """
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return salted.join(copies, [*keys, "_salt"], "left").drop("_salt")


# --- pagination ---------------------------------------------------------------------------


def paginate(seeds: DataFrame, links: DataFrame, max_pages: int | None = None, fetch_log: DataFrame | None = None) -> DataFrame:
    """Pages visited by following next links: (run_id, page_index, url, stop_reason).

    ``seeds`` (run_id, url); ``links`` (url, next_url), one row per landed page. A run goes on
    until there is no next link, the next one was visited, it leaves the origin, or it has
    ``max_pages`` pages where such a limit is asked for. ``stop_reason`` is set on the last page of
    a run that stopped for a warning or an error.

    With ``fetch_log`` (url, status, location) every URL is asked for first, and the page is where its
    redirects end; ``links`` is then by final URL. The first page may be anywhere, later ones that leave
    its origin on the way are an error, and a landing on a visited page is a warning. A seed whose
    redirects fail has one row, without a URL.

    Pages form chains in which each has one successor, followed by steps that double.
    """
    start = seeds.select("run_id", admitted_url(F.col("url")).alias("asked")).filter(F.col("asked").isNotNull())
    target = let(parse_url(F.col("next_url")), lambda p: F.struct(build_url(p, fragment=False).alias("url"), origin_of(p).alias("origin")))
    given = links.where("next_url is not null").select("url", target.alias("next"))
    foreign = ~F.coalesce(F.col("next.origin") == let(parse_url(F.col("url")), origin_of), F.lit(False))
    given = given.select("url", F.col("next.url").alias("asked"), foreign.alias("foreign"))
    if fetch_log is None:
        start = start.withColumn("node", F.col("asked")).withColumn("failed", F.lit(None).cast("string"))
        given = given.withColumn("target", F.col("asked")).withColumn("failed", F.lit(None).cast("string"))
    else:
        start = _landed(start, fetch_log, same_origin=False).withColumnRenamed("landed", "node")
        given = _landed(given, fetch_log, same_origin=True).withColumnRenamed("landed", "target")
    hops = materialize(given, "links")
    chains = follow_chains(hops.where("not foreign and failed is null").select(F.col("url").alias("node"), "target"))
    runs = start.where("failed is null").join(chains.ends, "node", "left").withColumn("full", F.coalesce("hops", F.lit(0)) + 1)
    runs = materialize(runs.withColumn("length", F.least("full", F.lit(max_pages)).cast("long") if max_pages else F.col("full")), "runs")
    longest = runs.agg(F.coalesce(F.max("length"), F.lit(0))).first()[0]
    pages = chains.walk(runs.select("run_id", "node", "length", "full", F.col("asked").alias("seed"), "entry", "entry_at"), longest)
    at_end = F.col("place") + 1 == F.col("full")
    # the link that first led to the page that comes again, and the one that leads there last
    ways = pages.where(at_end | (F.col("place") + 1 == F.col("entry_at"))).join(hops.withColumnRenamed("url", "node"), "node")
    last = F.max(F.when(at_end, F.struct("asked", "foreign", "failed"))).alias("last")
    ways = ways.groupBy("run_id", "seed").agg(last, F.max(F.when(F.col("place") + 1 == F.col("entry_at"), F.col("asked"))).alias("first"))
    ways = ways.select(F.col("run_id").alias("_run"), F.col("seed").alias("_seed"), "last", "first")
    ended = pages.join(ways, F.col("run_id").eqNullSafe(F.col("_run")) & (F.col("seed") == F.col("_seed")) & at_end, "left")
    known = F.col("last.asked").isin(F.col("entry")) | (F.col("last.asked") == F.when(F.col("entry_at") == 0, F.col("seed")).otherwise(F.col("first")))
    # at the cap nobody looks where the next link leads
    goes_on = F.col("length") < max_pages if max_pages else F.lit(True)
    reason = F.when(F.col("last.foreign"), WARN_NEXT_OTHER_ORIGIN).when(
        goes_on,
        F.when(F.col("last.failed") == OTHER_SITE, ERROR_PAGE_OTHER_ORIGIN)
        .when(F.col("last.failed").isNotNull(), F.col("last.failed"))
        .when(F.col("entry").isNotNull(), F.when(known, WARN_NEXT_REPEATED).otherwise(WARN_LANDED_REPEATED)),
    )
    found = ended.select("run_id", F.col("place").cast("int").alias("page_index"), F.col("node").alias("url"), F.when(at_end, reason).alias("stop_reason"))
    if fetch_log is None:
        return found
    failed = start.where("failed is not null").select("run_id", F.lit(0).alias("page_index"), F.lit(None).cast("string").alias("url"), F.col("failed").alias("stop_reason"))
    return found.unionByName(failed)


def _landed(rows: DataFrame, fetch_log: DataFrame, same_origin: bool) -> DataFrame:
    """``rows`` with ``landed``, where ``asked`` ends after redirects, and ``failed``, why it doesn't."""
    asked = rows.select("asked").where("asked is not null").distinct()
    requests = asked.select(F.col("asked").alias("request_id"), F.col("asked").alias("url"), F.lit("GET").alias("method"), F.lit(same_origin).alias("same_origin"))
    ends = resolve_redirects(requests, fetch_log).select(F.col("request_id").alias("asked"), F.col("final_url").alias("landed"), F.col("reason").alias("failed"))
    return materialize(rows.join(ends, "asked", "left"), "landed")


def page_urls(rules: DataFrame) -> DataFrame:
    """Explodes (rule_id, url, page_param, start_page, max_pages) into one URL per page."""
    pages = rules.select("*", F.explode(F.sequence(F.lit(0), F.col("max_pages") - 1)).alias("page_index"))
    number = (F.col("start_page") + F.col("page_index")).cast("string")
    base = let(parse_url(F.col("url")), lambda p: build_url(p, fragment=False))
    return pages.withColumn(
        "page_url",
        F.when(F.coalesce(F.col("page_param"), F.lit("")) == "", base).otherwise(
            set_query_param(base, F.col("page_param"), number)
        ),
    )


def stop_at_empty(page_stats: DataFrame, run: str = "run_id", page: str = "page_index", rows: str = "rows") -> DataFrame:
    """Pages up to and including the first one without rows.

    The first empty page per run is one small aggregate; the pages join to it, spread by page.
    """
    first_empty = page_stats.filter(F.col(rows) == 0).groupBy(run).agg(F.min(page).alias("_stop"))
    joined = salted_lookup(page_stats, first_empty, [run], page)
    return joined.filter(F.col("_stop").isNull() | (F.col(page) <= F.col("_stop"))).drop("_stop")


# --- redirects ----------------------------------------------------------------------------

REDIRECTS = (301, 302, 303, 307, 308)
OTHER_SITE = "redirect to another site"


def resolve_redirects(requests: DataFrame, fetch_log: DataFrame, max_redirects: int | None = None) -> DataFrame:
    """Final response of each request: (request_id, url, final_url, hops, status, reason).

    ``requests`` (request_id, url, method, same_origin); ``fetch_log`` (url, status, location),
    one row per URL. Every target is admitted again; a POST is never redirected. A chain ends with
    "too many redirects" where it would reach a URL for the second time, or after ``max_redirects``
    hops where such a limit is asked for.

    Targets are resolved once, in a table. Redirects form chains in which each URL has one successor,
    followed by steps that double; requests join the ends of their chains once. Requests that must stay on
    their site follow chains without the hops that leave one.
    """
    moved = F.coalesce(F.col("status").isin(*REDIRECTS), F.lit(False))
    target = F.when(moved, admitted_url(resolve_url(F.col("location"), parse_url(F.col("url")))))
    log = fetch_log.withColumn("target", target).select(
        "url", "status", moved.alias("moved"), (F.coalesce(F.col("location"), F.lit("")) == "").alias("no_location"), "target",
        (~let(parse_url(F.col("target")), origin_of).eqNullSafe(let(parse_url(F.col("url")), origin_of))).alias("leaves"),
    )
    log = materialize(log, "fetch-log")
    asked = requests.select(
        "request_id", "url", (F.coalesce("method", F.lit("GET")) == "POST").alias("post"), F.coalesce("same_origin", F.lit(False)).alias("stays"),
        admitted_url(F.col("url")).alias("start"),
    )
    asked = materialize(asked, "requests")
    # a node is a URL behind a mark that tells whether its requests must stay on their site
    marks = [r["stays"] for r in asked.where("start is not null and not post").select("stays").distinct().collect()]
    node = lambda stays, url: F.concat(F.when(stays, "=").otherwise("+"), url)
    goes_on = log.where(F.col("moved") & ~F.col("no_location") & F.col("target").isNotNull())
    edges = goes_on.withColumn("stays", F.explode(F.array(*[F.lit(m) for m in marks]).cast("array<boolean>"))).where("not (stays and leaves)")
    chains = follow_chains(edges.select(node(F.col("stays"), F.col("url")).alias("node"), node(F.col("stays"), F.col("target")).alias("target")))
    placed = asked.withColumn("node", F.when(~F.col("post"), node(F.col("stays"), F.col("start")))).join(chains.ends, "node", "left")
    end = F.when(F.col("last").isNotNull(), F.expr("substring(last, 2)")).otherwise(F.col("start"))
    placed = placed.select("request_id", "url", "post", "stays", "node", end.alias("final_url"), F.coalesce("hops", F.lit(0)).alias("hops"), F.col("entry").isNotNull().alias("many"))
    if max_redirects is not None:
        far = placed.where(F.col("hops") > max_redirects)
        far = chains.at(far, max_redirects).withColumn("final_url", F.expr("substring(node, 2)")).withColumn("hops", F.lit(max_redirects).cast("long")).withColumn("many", F.lit(True))
        placed = placed.where(F.col("hops") <= max_redirects).unionByName(far)
    known = log.select(F.col("url").alias("final_url"), "status", "moved", "no_location", "target", "leaves")
    found = placed.join(known, "final_url", "left")
    reason = (
        F.when(F.col("final_url").isNull(), "not admitted")
        .when(F.col("status").isNull(), "no response")
        .when(F.col("moved") & F.col("no_location"), "invalid redirect")
        .when(F.col("moved") & F.col("post"), "redirected POST")
        .when(F.col("moved") & F.col("target").isNull(), "invalid redirect")
        .when(F.col("moved") & F.col("stays") & F.col("leaves"), OTHER_SITE)
        .when(F.col("moved") & F.col("many"), "too many redirects")
    )
    return found.select("request_id", "url", "final_url", F.col("hops").cast("int").alias("hops"), "status", reason.alias("reason"))


# --- robots -------------------------------------------------------------------------------


def robots_verdict(status: Column) -> Column:
    """rules, allow all, or why the site is not collected."""
    return (
        F.when(status == 200, "rules")
        .when(status.isin(404, 410), "allow all")
        .when(status.isin(401, 403), "rules denied")
        .when((status == 429) | (status >= 500), "rules unavailable")
        .otherwise("rules unknown")
    )


_LINE = r"^\s*([A-Za-z-]+)\s*:\s*([^#]*)"


def parse_robots(robots: DataFrame) -> DataFrame:
    """Lines of robots files as (origin, line, group_id, field, value).

    ``robots`` has one row per origin; a group starts at an agent line after a rule line. The
    window runs over the lines of one file.
    """
    lines = F.split(F.col("body"), r"\r\n|\r|\n")
    exploded = unnest(robots, ["origin"], lines, "line", "_text")
    parsed = exploded.select(
        "origin",
        "line",
        F.lower(F.regexp_extract("_text", _LINE, 1)).alias("field"),
        F.trim(F.regexp_extract("_text", _LINE, 2)).alias("value"),
    ).filter(F.col("field") != "")
    w = W.partitionBy("origin").orderBy("line")
    is_agent = F.col("field") == "user-agent"
    starts = is_agent & F.coalesce(F.lag("field").over(w) != "user-agent", F.lit(True))
    return parsed.withColumn("_start", starts.cast("int")).select(
        "origin", "line", F.sum("_start").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("group_id"), "field", "value"
    )


def _pattern(value: Column) -> Column:
    """Regular expression of a robots path pattern: ``*`` is a wildcard, a final ``$`` anchors."""
    quoted = F.regexp_replace(value, r"([\\^$.|?+()\[\]{}])", r"\\$1")
    anchored = F.regexp_replace(quoted, r"\\\$$", r"\$")
    return F.concat(F.lit("^"), F.replace(anchored, F.lit("*"), F.lit(".*")))


def agent_rules(parsed: DataFrame, agent: str) -> DataFrame:
    """One row per origin: the rules and delay of the groups for ``agent``, else of ``*``.

    An origin's rules come from one bounded file, so its windows are small and its rules fit one
    row; everything runs on the partitioning by origin.
    """
    wanted = agent.lower()
    named = F.regexp_replace(F.lower("value"), r"/.*$", "")
    rank = F.when(F.col("field") != "user-agent", 0).when(named == wanted, 2).when(named == "*", 1).otherwise(0)
    best_of_file, best_of_group = W.partitionBy("origin"), W.partitionBy("origin", "group_id")
    ranked = (
        parsed.withColumn("_rank", rank)
        .withColumn("_best", F.max("_rank").over(best_of_file))
        .withColumn("_group", F.max("_rank").over(best_of_group))
    )
    rules = ranked.filter("field <> 'user-agent' AND group_id > 0 AND _best > 0 AND _group = _best")
    is_path = F.col("field").isin("allow", "disallow") & (F.col("value") != "")
    plain = ~F.col("value").rlike(r"[*$]")
    delay = F.when(F.col("field") == "crawl-delay", F.col("value").try_cast("double"))
    encoded = percent_encode(F.col("value"))
    return rules.groupBy("origin").agg(
        F.collect_list(
            F.when(
                is_path,
                F.struct(
                    (F.col("field") == "allow").alias("allow"),
                    F.length("value").alias("size"),
                    F.when(plain, encoded).alias("prefix"),
                    F.when(~plain, _pattern(encoded)).alias("pattern"),
                ),
            )
        ).alias("rules"),
        F.max_by(delay, F.when(delay.isNotNull(), F.col("line"))).alias("delay"),
    )


def _allowed(path: Column, rules: Column) -> Column:
    """Longest matching rule decides, allow wins ties, no match allows."""
    hits = F.filter(rules, lambda r: F.coalesce(path.startswith(r["prefix"]), F.rlike(path, r["pattern"]), F.lit(False)))
    best = F.array_max(F.transform(hits, lambda r: F.struct(r["size"].alias("size"), r["allow"].alias("allow"))))
    return F.coalesce(best["allow"], F.lit(True))


def robots_allowed(urls: DataFrame, robots: DataFrame, agent: str, url: str = "url") -> DataFrame:
    """Adds ``robots`` (verdict), ``allowed`` and ``interval_ms`` to each URL.

    ``robots`` has (origin, status, body), one row per origin. The join brings one row per
    origin to each URL, so no URL-by-rule pairs are made and hot origins are salted.
    """
    files = robots.select("origin", robots_verdict(F.col("status")).alias("robots"), F.when(F.col("status") == 200, F.col("body")).alias("body"))
    rules = agent_rules(parse_robots(files.filter("body IS NOT NULL")), agent)
    per_origin = files.drop("body").join(rules, ["origin"], "left")
    parts = let(
        parse_url(F.col(url)),
        lambda p: F.struct(origin_of(p).alias("origin"), F.concat(p["path"], p["query"]).alias("path")),
    )
    keyed = urls.withColumn("_p", parts).withColumn("origin", F.col("_p.origin")).withColumn("_path", F.col("_p.path"))
    joined = salted_lookup(keyed.drop("_p"), per_origin, ["origin"], url)
    verdict = F.coalesce(F.col("robots"), F.lit("allow all"))
    delay_ok = F.coalesce(F.col("delay"), F.lit(0.0)) <= MAX_CRAWL_DELAY_SECONDS
    return joined.select(
        *[c for c in urls.columns if c != "origin"],
        "origin",
        verdict.alias("robots"),
        (
            (verdict == "allow all")
            | ((verdict == "rules") & delay_ok & F.coalesce(_allowed(F.col("_path"), F.col("rules")), F.lit(True)))
        ).alias("allowed"),
        crawl_interval(F.col("delay")).alias("interval_ms"),
    )


def crawl_interval(delay_seconds: Column) -> Column:
    """Milliseconds between requests; NULL when the site asks for more than is honoured."""
    ms = F.greatest(F.lit(MIN_INTERVAL_MS), F.coalesce(delay_seconds, F.lit(0.0)) * 1000).cast("long")
    return F.when(F.coalesce(delay_seconds, F.lit(0.0)) <= MAX_CRAWL_DELAY_SECONDS, ms)


# --- politeness ---------------------------------------------------------------------------


def schedule(requests: DataFrame, chunk_ms: int = 3_600_000) -> DataFrame:
    """Earliest start of each request: same-origin starts are max(own, previous interval) apart.

    ``requests`` (request_id, origin, arrival_ms, interval_ms), served per origin in order of
    arrival and id. With gaps summed along the order, start = sum + max(arrival - sum) so far:
    a prefix scan. It is taken in two levels - rows within an (origin, time chunk), then one
    summary row per chunk within an origin - so a hot origin spreads over its chunks.
    """
    df = requests.withColumn("_chunk", F.floor(F.col("arrival_ms") / chunk_ms))
    order = [F.col("arrival_ms"), F.col("request_id")]
    inner = W.partitionBy("origin", "_chunk").orderBy(*order)
    # The gap in front of a chunk's first row needs the last interval of the chunk before.
    previous = F.lag("interval_ms").over(inner)
    local_gap = F.when(previous.isNull(), F.lit(0)).otherwise(F.greatest(F.col("interval_ms"), previous))
    df = df.withColumn("_gap", local_gap.cast("long"))
    df = df.withColumn("_sum", F.sum("_gap").over(inner.rowsBetween(W.unboundedPreceding, 0)))
    df = df.withColumn(
        "_lead", F.max(F.col("arrival_ms") - F.col("_sum")).over(inner.rowsBetween(W.unboundedPreceding, 0))
    )
    position = F.struct("arrival_ms", "request_id")
    chunks = df.groupBy("origin", "_chunk").agg(
        F.sum("_gap").alias("_gaps"),
        F.max(F.col("arrival_ms") - F.col("_sum")).alias("_max"),
        F.min_by("interval_ms", position).alias("_first"),
        F.max_by("interval_ms", position).alias("_last"),
    )
    outer = W.partitionBy("origin").orderBy("_chunk")
    entry_gap = F.coalesce(F.greatest(F.col("_first"), F.lag("_last").over(outer)), F.lit(0)).cast("long")
    chunks = chunks.withColumn("_entry", entry_gap)
    before = outer.rowsBetween(W.unboundedPreceding, -1)
    chunks = chunks.withColumn(
        "_offset", F.coalesce(F.sum(F.col("_entry") + F.col("_gaps")).over(before), F.lit(0)) + F.col("_entry")
    )
    chunks = chunks.withColumn("_carry", F.max(F.col("_max") - F.col("_offset")).over(before))
    joined = df.join(chunks.select("origin", "_chunk", "_offset", "_carry"), ["origin", "_chunk"])
    total = F.col("_offset") + F.col("_sum")
    start = total + F.greatest(F.col("_lead") - F.col("_offset"), F.col("_carry"))
    return joined.select(
        *requests.columns, start.alias("start_ms"), (start - F.col("arrival_ms")).alias("wait_ms")
    )


def route(pages: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """Each page with the rules of its exact host; run it before shredding.

    A catalogue below Spark's broadcast threshold is broadcast and pages do not move. A larger one
    is joined by shuffle with pages of hot hosts salted.
    """
    keyed = pages.withColumn("host", host_of(F.col(url)))
    salted = keyed.withColumn("_salt", F.pmod(F.xxhash64(url), F.lit(8)).cast("int"))
    copies = rules.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(8)])))
    return salted.join(copies, ["host", "_salt"]).drop("_salt")
