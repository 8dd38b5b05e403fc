import ipaddress
import re

import pytest
from pyspark.sql import functions as F

from leafmill.fixed import LABEL_COLUMN_PREFIX, LABEL_DESCRIPTION, LABEL_IMAGE, LABEL_TIME, LABEL_TITLE
from leafmill.functions.jsonpath import JsonPathError, normalize_path, path_steps
from leafmill.functions.urls import PLAIN_URL, host_of, normalize_url, parse_url, resolve_url, set_query_param, strip_query
from leafmill.operators.admission import admit_urls, admitted_url, is_public
from leafmill.operators.gates import classify, decode_body, gate_content_type, gate_size, gate_status, split_rejects
from leafmill.operators.infer import suggest_html, suggest_json
from leafmill.operators.html import with_nodes
from leafmill.operators.json_records import extract_json_page, json_bodies


def column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"v {kind}")


# blocks whose neighbours on both sides are public, and blocks of which only the inside is tried
EDGED = "10.0.0.0/8 172.16.0.0/12 100.64.0.0/10 169.254.0.0/16 192.168.0.0/16".split()
INSIDE = "127.0.0.0/8 224.0.0.0/4 198.51.100.0/24 fd00::/8 fe80::/10 ff00::/8".split()


def test_addresses_at_the_edges_of_blocks(spark):
    want = {"no address": False, "7.7.7": False, "2a00:1450::8": True}
    for block in map(ipaddress.ip_network, EDGED):
        want |= {str(block[0]): False, str(block[-1]): False, str(block[0] - 1): True, str(block[-1] + 1): True}
    for block in map(ipaddress.ip_network, INSIDE):
        want |= {str(block[5]): False, str(block[-2]): False}
    got = {r.v: r.p for r in column(spark, list(want)).select("v", is_public(F.col("v")).alias("p")).collect()}
    assert got == want


def test_admission(spark):
    bad = ["ftp://shop.test/list", "http://printer", "http://0300.0250.3.4/", "http://3232236033/", "http://[fd12::9]/x", "http://shop.org:8443/", "https://ann@shop.org/", "", None]
    good = {"HTTP://Shop.org/Shelf?b=1#top": "http://shop.org/Shelf?b=1", "https://shop.org": "https://shop.org/", "http://9.9.9.9/a": "http://9.9.9.9/a"}
    rows = {r.v: r for r in admit_urls(column(spark, [*bad, *good]), "v").collect()}
    assert all(rows[u].reject_reason and rows[u].url_norm is None for u in bad)
    assert {u: rows[u].url_norm for u in good} == good


RESOLVED = {
    "/shelf/9": "https://example.com/shelf/9", "lot/7": "https://example.com/c/x/lot/7", "?sort=up": "https://example.com/c/x/i.html?sort=up",
    "": "https://example.com/c/x/i.html?q=1", "../up": "https://example.com/c/up", "../../../up": "https://example.com/up",
    "//Other.org/a b": "https://other.org/a%20b", "javascript:alert(1)": None, "http://[": None, "HTTP://A.com:80": "http://a.com/",
    "/für?ñ=é#ü": "https://example.com/f%C3%BCr?%C3%B1=%C3%A9#%C3%BC", "http://256.1.1.1": None, "https:foo": "https://example.com/c/x/foo",
    "/a/%2e%2e/b/": "https://example.com/b/", "\\back": "https://example.com/back", "/😀": "https://example.com/%F0%9F%98%80",
    "https://münchen.de/x": "https://xn--mnchen-3ya.de/x", "a/./b/../c": "https://example.com/c/x/a/c", "https://h.com:99999/": None,
    "/q?a='x'": "https://example.com/q?a=%27x%27",
}


def test_url_resolution(spark):
    base = parse_url(F.lit("https://Example.com:443/c/x/i.html?q=1#f"))
    got = {r.v: r.u for r in column(spark, list(RESOLVED)).select("v", resolve_url(F.col("v"), base).alias("u")).collect()}
    assert got == RESOLVED
    row = column(spark, ["https://a.com/x?page=3&b=2&page=9"]).select(
        set_query_param(F.col("v"), F.lit("page"), F.lit("7")).alias("a"), normalize_url(F.col("v")).alias("b")
    ).head()
    assert row.a == "https://a.com/x?page=7&b=2" and row.b == "https://a.com/x?page=3&b=2&page=9"


def test_charsets(spark):
    russian, japanese, korean = "Цена: 5", "価格は五円", "가격"
    rows = [
        (1, "text/html; charset=windows-1251", russian.encode("cp1251")), (2, "text/html", japanese.encode()),
        (3, "text/html", f'<meta charset="shift_jis">{japanese}'.encode("shift_jis")), (4, 'text/html; charset="euc-kr"', korean.encode("euc-kr")),
        (5, "text/html; charset=klingon", "ß".encode()), (6, "text/html", b"x\xfey"),
    ]
    df = spark.createDataFrame([(i, t, bytearray(b)) for i, t, b in rows], "id int, content_type string, body binary")
    want = [russian, japanese, f'<meta charset="shift_jis">{japanese}', korean, "ß", "x\ufffdy"]
    assert [r.html for r in decode_body(df).orderBy("id").collect()] == want


def test_gates_name_the_first_reason(spark):
    rows = [
        (1, 200, "text/html", {}, b"<html>"), (2, 403, "text/html", {}, b""), (3, 200, "image/png", {}, b"x"),
        (4, 200, "application/vnd.api+json", {"content-length": "9999999"}, b" [1]"), (5, 204, "text/html", {}, b"x" * 20),
    ]
    df = spark.createDataFrame([(a, b, c, d, bytearray(e)) for a, b, c, d, e in rows], "id int, status int, content_type string, headers map<string,string>, body binary")
    kept, rejected = split_rejects(gate_size(gate_content_type(gate_status(df), "html"), 10))
    assert [r.id for r in kept.collect()] == [1]
    assert {r.id: r.reject_reason for r in rejected.collect()} == {2: "HTTP 403 forbidden", 3: "not html", 4: "not html", 5: "too large"}
    assert {r.id: r.kind for r in classify(df).collect()} == {1: "html", 2: "html", 3: None, 4: "json", 5: "html"}


def test_json_records(spark):
    body = (
        '\ufeff{"shop":{"jars":[{"no":12,"maker":{"town":"Lund"},"full":true,"litres":2.250,"dose":4e-9,"code":"7.0","lids":["tin","cork","wax"]},'
        '{"no":13},null,"loose"]}}'
    )
    df = spark.createDataFrame([(1, "https://shop.org/jars?key=s3", bytearray(body.encode())), (2, "https://shop.org/", bytearray(b"[1,"))], "id int, url string, body binary")
    good, bad = split_rejects(json_bodies(df))
    assert [r.id for r in bad.collect()] == [2]
    want = {"no": "12", "maker.town": "Lund", "maker": '{"town":"Lund"}', "full": "true", "litres": "2.25", "dose": "4e-9", "code": "7.0",
            "lids": '["tin","cork","wax"]', "lids.length": "3", "lids[2]": "wax"}
    rule = {"rowSelector": "shop.jars", "fields": [{"name": n, "selector": n} for n in [*want, "$"]]}
    got = extract_json_page(good, rule).head()
    assert {n: got.records[0][n] for n in want} == want
    assert got.records[1]["maker.town"] == "" and [r["$"] for r in got.records[2:]] == ["", "loose"]
    assert got.url == got.records[0]["_source"] == "https://shop.org/jars" and got.title == "shop.org" and got.matched == 4


PATHS = {
    "jars[0].lids[2]": "$.jars[0].lids[2]", " $.shop ": "$.shop", "[4]": "$[4]", "店.名": "$.店.名", "a-b_c": "$.a-b_c", "$": "$", "": "$",
    "shop..jars": None, "jars[-1]": None, "jars[*].no": None, "jars[?(@.no>1)]": None, "$shop": None, "1st": None, "jars[0": None, "shop.": None,
    "shop.prototype": None, ".".join(["d"] * 33): None,
}


def test_json_paths(spark):
    got = {r.v: r.n for r in column(spark, list(PATHS)).select("v", normalize_path(F.col("v")).alias("n")).collect()}
    assert got == PATHS
    for path, want in PATHS.items():
        if want is None:
            with pytest.raises(JsonPathError):
                path_steps(path)
        else:
            path_steps(path)


def test_html_inference(spark):
    plant = '<li class="plant tall"><h4>%s</h4><img src="%s.png"><p>grows</p><time datetime="2020-02-0%d">then</time></li>'
    plants = "<ul>" + "".join(plant % (name, name, day) for day, name in enumerate(("Fern", "Moss", "Ivy"), 1)) + "</ul><a class='next' href='/3'>on</a>"
    rates = "<table><thead><tr><th>From</th><th>%s</th><th></th></tr></thead><tbody>" + "<tr><td>oslo</td><td>4</td><td>kr</td></tr>" * 3 + "</tbody></table>"
    df = spark.createDataFrame([(1, plants), (2, rates % "Rate"), (3, rates % "From"), (4, "<p>closed")], "id int, html string")
    got = {r.id: r for r in suggest_html(with_nodes(df)).collect()}
    assert got[1].row_selector == "li.plant"
    assert [(f.name, f.selector, f.attribute) for f in got[1].fields] == [
        (LABEL_TITLE, "h1,h2,h3,h4", "text"), (LABEL_IMAGE, "img[src]", "src"), (LABEL_DESCRIPTION, "p", "text"), (LABEL_TIME, "time", "datetime"),
    ]
    assert got[2].row_selector == "tr:has(td)" and [f.name for f in got[2].fields] == ["From", "Rate", f"{LABEL_COLUMN_PREFIX}3"]
    assert [f.name for f in got[3].fields] == ["From", f"{LABEL_COLUMN_PREFIX}2", f"{LABEL_COLUMN_PREFIX}3"]
    assert got[4].row_selector == "" and [f.selector for f in got[4].fields] == ["p"]


def test_json_inference(spark):
    docs = [
        '{"page":{"sizes":[10,20,50],"plants":[{"name":"Fern","site":{"zone":7}},{"name":"Moss","rare":null}]}}',
        '["wet",4,true,null]', '{"plants":[]}', '{"far":{"off":{"list":[{"k":1},{"k":2}]}},"near":[{"k":1},{"k":2}]}', '{"note":"[1,2]"}',
    ]
    got = [r for r in suggest_json(spark.createDataFrame(list(enumerate(docs)), "id int, doc string")).orderBy("id").collect()]
    assert [r.row_selector for r in got] == ["page.plants", "$", "plants", "near", "$"]
    assert [f.selector for f in got[0].fields] == ["name", "site.zone", "rare"]
    assert [[f.selector for f in r.fields] for r in got[1:]] == [["$"], ["$"], ["k"], ["note"]]


def test_inference_sees_all_fields_and_records(spark):
    wide = '[' + ",".join(f'{{"k{i}":{i}}}' for i in range(57)) + "]"
    got = suggest_json(spark.createDataFrame([(1, wide)], "id int, doc string")).head()
    assert [f.selector for f in got.fields] == [f"k{i}" for i in range(57)]
    cells = "".join(f"<td>{i}</td>" for i in range(31))
    found = suggest_html(with_nodes(spark.createDataFrame([(1, f"<table><tr>{cells}</tr><tr>{cells}</tr></table>")], "id int, html string"))).head()
    assert [f.name for f in found.fields] == [f"{LABEL_COLUMN_PREFIX}{i}" for i in range(1, 32)]


def test_landed_files_are_responses(spark, tmp_path):
    from leafmill.sources.responses import read_files

    (tmp_path / "a.html").write_bytes("<title>é</title>".encode())
    (tmp_path / "b.json").write_bytes(b"{}")
    got = read_files(spark, str(tmp_path), "text/html", "*.html").collect()
    assert len(got) == 1 and got[0].url.endswith("/a.html") and got[0].headers == {"content-length": "17"}


def test_analysis_rejects_and_probes(spark):
    from leafmill.operators.analyze import analyze, probe_documents, probe_pages

    rows = [(1, "text/html", b'<ul><li><a href="/a">x</a><li><a href="/b"></a>y</ul>'), (2, "application/json", b"{broken"), (3, "image/png", b"x"),
            (4, "", b'{"a":[{"b":1.0},{"b":null}]}'), (5, "text/html", b"plain")]
    df = spark.createDataFrame([(i, "https://e.org/", t, bytearray(b)) for i, t, b in rows], "response_id int, url string, content_type string, body binary")
    pages, documents, rejected = analyze(df)
    assert {r.response_id: r.reject_reason for r in rejected.collect()} == {2: "invalid JSON", 3: "not HTML or JSON"}
    found = {(r.response_id, r.field_name): (r.sampled, r.filled) for r in probe_pages(pages).collect()}
    assert found == {(1, "链接"): (2, 2), (5, "内容"): (1, 1)}
    assert [(r.field_name, r.sampled, r.filled, r.hit_rate) for r in probe_documents(documents).collect()] == [("b", 2, 1, 50)]


def test_urls_in_normal_form_are_told_without_parsing(spark):
    """Those that the short way takes are what the long way makes of them; all others go the long way."""
    same = ["https://a.example.com/", "http://1a.b-c.io/x//y.z?q=%20&r=(1)#f/%41", "https://xn--bcher-kva.example/a'b;c=1:@~", "http://host/p"]
    made = {
        "https://a.example.com": "https://a.example.com/", "HTTP://A.example.com/": "http://a.example.com/", "http://a.b/./c": "http://a.b/c", "http://a.b/c/..": "http://a.b/",
        "http://a.b/c\\d": "http://a.b/c/d", "http://0x7f.1/": "http://127.0.0.1/", "http://a.b:80/": "http://a.b/", "http://a.b/?x='": "http://a.b/?x=%27", "http://a.b/c\n": "http://a.b/c",
        "http:///a.b/c": "http://a.b/c", "http://a.b/?#": "http://a.b/?#", "http://a.b/%2e%2e/c": "http://a.b/c", "http://a.1/": None, "mailto:a": None,
    }
    df = spark.createDataFrame([(u,) for u in [*same, *made]], "u string")
    u, base = F.col("u"), parse_url(F.lit("https://a.example.com/x/y?z"))
    rows = df.select("u", u.rlike(PLAIN_URL).alias("plain"), normalize_url(u).alias("n"), host_of(u).alias("host"), strip_query(u).alias("short"), resolve_url(u, base).alias("r")).collect()
    assert {r.u for r in rows if r.plain} == set(same)
    for r in rows:
        want = r.u if r.u in same else made[r.u]
        assert (r.n, r.r) == (want, want)
        assert r.host == (want and want.split("/")[2])
        assert r.short == re.sub(r"\?[^#]*", "", want or "")
    refs = spark.createDataFrame([("/1",), ("//b.io/c",), ("/../k",), ("1",), ("",), ("/\u00fc?a#b",)], "ref string")
    got = [r[0] for r in refs.select(resolve_url(F.col("ref"), base)).collect()]
    root = "https://a.example.com"
    assert got == [f"{root}/1", "https://b.io/c", f"{root}/k", f"{root}/x/1", f"{root}/x/y?z", f"{root}/%C3%BC?a#b"]
    asked = ["http://a.b/c#d", "http://host/p", "http://x.local/", "http://a.b:8080/"]
    admitted = spark.createDataFrame([(a,) for a in asked], "u string").select(admitted_url(F.col("u"))).collect()
    assert [r[0] for r in admitted] == ["http://a.b/c", None, None, None]
