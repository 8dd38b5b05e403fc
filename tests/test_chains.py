"""Chains by doubling steps, and pagination behind redirects, against walks step by step."""

import random

from leafmill.fixed import ERROR_PAGE_OTHER_ORIGIN, WARN_LANDED_REPEATED, WARN_NEXT_OTHER_ORIGIN, WARN_NEXT_REPEATED
from leafmill.operators.chains import follow_chains
from leafmill.operators.frontier import paginate, resolve_redirects


def walked(edges, node):
    seen = [node]
    while seen[-1] in edges and edges[seen[-1]] not in seen:
        seen.append(edges[seen[-1]])
    return seen, edges.get(seen[-1])


def test_chains(spark):
    rng = random.Random(3)
    edges = {f"n{i}": f"n{rng.randrange(260)}" for i in range(200)}
    edges |= {f"l{i}": f"l{i + 1}" for i in range(37)}
    edges |= {f"c{i}": f"c{(i + 1) % 13}" for i in range(13)} | {f"t{i}": f"t{i + 1}" for i in range(21)} | {"t21": "c5", "self": "self"}
    chains = follow_chains(spark.createDataFrame(list(edges.items()), "node string, target string"))
    ends = {r["node"]: r for r in chains.ends.collect()}
    assert ends.keys() == edges.keys()
    for node in edges:
        seen, again = walked(edges, node)
        r = ends[node]
        assert (r["last"], r["hops"]) == (seen[-1], len(seen) - 1)
        assert (r["entry"], r["entry_at"]) == ((again, seen.index(again)) if again else (None, None))
    wanted = [(f"r{k}", node, rng.randint(1, len(walked(edges, node)[0]))) for k, node in enumerate(["l0", "t0", "c3", "self", "n7", "away", "l30"] * 3) if node in edges] + [("z", "away", 1)]
    places = {}
    for r in chains.walk(spark.createDataFrame(wanted, "run string, node string, length long"), max(w[2] for w in wanted)).collect():
        places.setdefault(r["run"], {})[r["place"]] = r["node"]
    for run, node, length in wanted:
        assert [places[run][i] for i in range(length)] == walked(edges, node)[0][:length] and len(places[run]) == length
    at = chains.at(spark.createDataFrame([(n,) for n in ("l0", "t0", "l30")], "node string").selectExpr("node", "node as old"), 11)
    assert {(r["old"], r["node"]) for r in at.collect()} == {("l0", "l11"), ("t0", "t11")}
    assert follow_chains(spark.createDataFrame([], "node string, target string")).ends.collect() == []


def test_long_chains_take_few_rounds(spark, monkeypatch):
    from leafmill.operators import chains as module

    rounds = []
    monkeypatch.setattr(module, "_round", lambda table, real=module._round: rounds.append(1) or real(table))
    edges = spark.range(500).selectExpr("id as node", "id + 1 as target")
    assert follow_chains(edges).ends.where("last = 500 and hops = 500 - node").count() == 500
    assert len(rounds) <= 10


def pages_by_hand(seed, links, log, max_pages):
    origin = lambda u: u.split("/")[2]

    def asked(url, stays):
        seen = [url]
        while True:
            status, location = log.get(seen[-1], (None, None))
            if status is None:
                return None, "no response"
            if status != 302:
                return seen[-1], None
            if stays and origin(location) != origin(url):
                return None, "redirect to another site"
            if location in seen:
                return None, "too many redirects"
            seen.append(location)

    pages, visited, url = [], set(), seed
    while True:
        if url in visited:
            return pages, WARN_NEXT_REPEATED
        visited.add(url)
        page, failed = asked(url, bool(pages))
        if failed:
            return pages, ERROR_PAGE_OTHER_ORIGIN if failed == "redirect to another site" else failed
        if page != url and page in visited:
            return pages, WARN_LANDED_REPEATED
        visited.add(page)
        pages.append(page)
        url = links.get(page)
        if url and origin(url) != origin(page):
            return pages, WARN_NEXT_OTHER_ORIGIN
        if not url or len(pages) == max_pages:
            return pages, None


def test_pagination_behind_redirects(spark):
    rng = random.Random(11)
    hosts = [f"https://h{i}.example.com" for i in range(6)]
    urls = [f"{h}/{i}" for h in hosts for i in range(14)]
    home = lambda u: rng.choice([v for v in urls if v.startswith(u.rsplit("/", 1)[0] + "/")])
    log = {}
    for u in urls:
        kind = rng.random()
        log[u] = (302, rng.choice(urls) if kind < 0.04 else home(u)) if kind < 0.35 else (200, None)
    del log[urls[3]], log[urls[40]]
    log |= {urls[0]: (200, None), urls[1]: (302, urls[20]), urls[14]: (200, None), urls[15]: (302, urls[16]), urls[16]: (302, urls[15])}
    links = {u: (rng.choice(urls) if rng.random() < 0.05 else home(u)) if rng.random() < 0.93 else None for u in urls if log.get(u, (0,))[0] == 200}
    links |= {urls[0]: urls[1], urls[14]: urls[16]}
    seeds = [(i, u) for i, u in enumerate(urls)]
    tables = spark.createDataFrame(seeds, "run_id int, url string"), spark.createDataFrame(list(links.items()), "url string, next_url string")
    fetched = spark.createDataFrame([(u, *x) for u, x in log.items()], "url string, status int, location string")
    for max_pages in (None, 3):
        got = {}
        for r in paginate(*tables, max_pages, fetched).collect():
            got.setdefault(r["run_id"], {})[r["page_index"]] = (r["url"], r["stop_reason"])
        reasons = set()
        for i, u in seeds:
            pages, reason = pages_by_hand(u, links, log, max_pages)
            rows = [got[i][k] for k in sorted(got[i])]
            reasons.add(reason)
            if pages:
                assert [p for p, _ in rows] == pages, u
                assert [x for _, x in rows] == [None] * (len(pages) - 1) + [reason], u
            else:
                assert rows == [(None, reason)], u
        if max_pages is None:
            assert {WARN_NEXT_REPEATED, WARN_LANDED_REPEATED, WARN_NEXT_OTHER_ORIGIN, ERROR_PAGE_OTHER_ORIGIN, "no response", "too many redirects"} <= reasons


def test_redirects_of_both_kinds_of_requests_share_a_log(spark):
    h = "https://a.example.com"
    log = [(f"{h}/{i}", 301, f"/{i + 1}") for i in range(20)] + [(f"{h}/20", 301, "https://b.example.com/"), ("https://b.example.com/", 301, "/x"), ("https://b.example.com/x", 200, None)]
    asked = [(i, f"{h}/{i}", "GET", s) for i in range(21) for s in (True, False, None)]
    got = resolve_redirects(spark.createDataFrame(asked, "request_id int, url string, method string, same_origin boolean"), spark.createDataFrame(log, "url string, status int, location string"))
    rows = {(r["request_id"], r["reason"]): (r["hops"], r["final_url"]) for r in got.collect()}
    for i in range(21):
        assert rows[i, "redirect to another site"] == (20 - i, f"{h}/20")
        assert rows[i, None] == (22 - i, "https://b.example.com/x")
