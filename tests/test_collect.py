"""The collect job: one pass, four sinks."""

import json

from pyspark.sql import functions as F

from leafmill.fixed import WARN_NEXT_INVALID, WARN_NEXT_OTHER_ORIGIN, WARN_NO_CONTAINER, WARN_NO_RECORD_JSON
from leafmill.functions.jsonpath import parsed
from leafmill.functions.shred import shred
from leafmill.operators.catalog import read_rules
from leafmill.operators.collect import collect, compile_catalogue
from leafmill.operators.html import with_nodes
from leafmill.operators.json_records import with_json_records
from leafmill.schemas import CONFIG
from leafmill.session import WRITERS, write_by

FIELD = {"id": "f", "attribute": "text"}


def rule(id_, host, rows, fields, next_="", kind="html"):
    api = {"method": "GET", "headers": {}, "body": "", "pageParam": "p", "startPage": 1} if kind == "json" else None
    config = {"url": f"https://{host}/", "sourceType": kind, "rowSelector": rows, "nextSelector": next_, "maxPages": 1, "api": api}
    return {"id": id_, "name": id_, "updatedAt": "2024", "config": config | {"fields": [{**FIELD, "name": n, "selector": s, "attribute": a} for n, s, a in fields]}}


RULES = [
    rule("cards", "shop.example.com", "#list > .card", [("name", "h2, h3", "text"), ("link", "a.more", "href"), ("self", ":scope", "id"), ("kid", ":scope > i", "text")], "a.next"),
    rule("heads", "shop.example.com", "", [("heads", "h2", "text")]),
    rule("api", "api.example.com", "$.rows", [("a", "a", "text"), ("b", "b.c[1]", "text"), ("gone", "x", "text")], kind="json"),
]
PAGE = (
    '<base href="/s/"><div id=list><p class=card id=c1><h2>One</h2></p></div><div id="list"><div class="card big" id=c2><h2>Two</h2><i>k</i><a class="more x" href="q?a=1">m</a></div>'
    '<div class=card><h3>Three</h3><div><i>deep</i></div></div></div><div class=card>out</div><a class=next href="%s">n</a>'
)
HTML, JSON = "text/html", "application/json"


def rows(spark):
    shop, api = "https://shop.example.com/p", "https://api.example.com/v?key=1"
    body = lambda x: x if isinstance(x, bytes) else x.encode()
    found = [
        ("r1", 0, f"{shop}1", 200, HTML, PAGE % "/p2"),
        ("r1", 1, f"{shop}2", 200, HTML, PAGE % "https://other.example.com/"),
        ("r1", 2, f"{shop}3", 200, HTML, PAGE % "http://["),
        ("r1", 3, f"{shop}4", 200, HTML, "<h1>nothing</h1>"),
        ("r2", 0, f"{shop}5", 404, HTML, PAGE % ""),
        ("r2", 1, f"{shop}6", 200, JSON, PAGE % ""),
        ("r2", 2, "https://none.example.com/", 200, HTML, PAGE % ""),
        ("r3", 0, api, 200, JSON, '{"rows":[{"a":"1.50","b":{"c":[0,{"z":1.0,"y":2}]}},{"a":1.50}]}'),
        ("r3", 1, api, 200, JSON, '{"rows":[]}'),
        ("r3", 2, api, 200, JSON, '{"rows":'),
        ("r3", 3, api, 500, JSON, "{}"),
        (None, None, api, 200, JSON, None),
    ]
    data = [(*r[:5], None if r[5] is None else body(r[5]), {}, "x", 7) for r in found]
    return spark.createDataFrame(data, "run_id string, page_index int, url string, status int, content_type string, body binary, headers map<string,string>, host string, rows int")


def job(spark, tmp_path, **limits):
    (tmp_path / "rules").mkdir(exist_ok=True)
    (tmp_path / "rules" / "a.json").write_text(json.dumps(RULES))
    return collect(rows(spark), read_rules(spark, str(tmp_path / "rules")), ["run_id", "page_index"], **limits)


def test_sinks(spark, tmp_path):
    done = job(spark, tmp_path)
    cells = {}
    for r in done.records().collect():
        cells.setdefault((r["rule_id"], r["run_id"], r["page_index"], r["row_pos"]), []).append((r["field_pos"], r["field_name"], r["value"]))
    values = {k: [v for _, _, v in sorted(x)] for k, x in cells.items()}
    for page in (0, 1, 2):
        assert values["cards", "r1", page, 0] == ["", "", "c1", ""]
        assert values["cards", "r1", page, 1] == ["Two", "https://shop.example.com/s/q?a=1", "c2", "k"]
        assert values["cards", "r1", page, 2] == ["Three", "", "", ""]
        assert values["heads", "r1", page, 0] == ["One\nTwo"]
    assert values["api", "r3", 0, 0] == ["1.50", '{"z":1,"y":2}', ""] and values["api", "r3", 0, 1] == ["1.5", "", ""]
    assert len(values) == 3 * 4 + 1 + 2
    pages = {(r["rule_id"], r["run_id"], r["page_index"]): (r["rows"], r["matched"], r["last"], r["next_url"], r["title"]) for r in done.pages().collect()}
    assert pages["cards", "r1", 0][:4] == (3, 3, False, "https://shop.example.com/p2")
    assert pages["cards", "r1", 1][:4] == (3, 3, True, "https://other.example.com/")
    assert pages["cards", "r1", 2][:4] == (3, 3, True, None)
    assert pages["cards", "r1", 3] == (0, 0, True, None, "shop.example.com")
    assert pages["heads", "r1", 3][:2] == (1, 1)
    assert pages["api", "r3", 0] == (2, 2, False, None, "api.example.com") and pages["api", "r3", 1] == (0, 0, True, None, "api.example.com")
    warnings = {}
    for r in done.warnings().orderBy("pos").collect():
        warnings.setdefault((r["rule_id"], r["run_id"], r["page_index"]), []).append(r["message"])
    assert warnings["cards", "r1", 1] == [WARN_NEXT_OTHER_ORIGIN] and warnings["cards", "r1", 2] == [WARN_NEXT_INVALID]
    assert warnings["cards", "r1", 3] == [WARN_NO_CONTAINER] and warnings["api", "r3", 1] == [WARN_NO_RECORD_JSON]
    assert len(warnings["api", "r3", 0]) == 1 and "gone" in warnings["api", "r3", 0][0]
    rejects = sorted((r["run_id"] or "", r["page_index"] or 0, r["rule_id"] or "", r["reject_reason"]) for r in done.rejects().collect())
    assert rejects == [
        ("", 0, "api", "invalid JSON"),
        ("r2", 0, "cards", "HTTP 404"), ("r2", 0, "heads", "HTTP 404"), ("r2", 1, "cards", "not html"), ("r2", 1, "heads", "not html"), ("r2", 2, "", "no rule for the host"),
        ("r3", 2, "api", "invalid JSON"), ("r3", 3, "api", "HTTP 500"),
    ]
    runs = {r["run_id"]: (r["pages"], r["rows"], r["warnings"], r["rejects"]) for r in done.runs().collect()}
    assert runs == {"r1": (8, 13, 4, 0), "r2": (0, 0, 0, 5), "r3": (2, 2, 2, 2), None: (0, 0, 0, 1)}
    sizes = {(r["rule_id"], r["page_index"]): r["bytes"] for r in done.pages().where("run_id = 'r3'").collect()}
    maps = [json.dumps({**r["record"], "_source": r["_source"]}, ensure_ascii=False, separators=(",", ":")) for r in done.record_maps().where("run_id = 'r3'").collect()]
    assert sizes["api", 0] == sum(len(m.encode()) for m in maps)


def test_paths_of_a_rule_are_planned_with_it(spark, tmp_path):
    """A path that isn't known before the job would be parsed for every cell."""
    rules = spark.createDataFrame([(json.dumps(RULES[2]["config"]),)], "c string").select(F.lit("api").alias("id"), F.from_json("c", CONFIG).alias("config"))
    docs = spark.createDataFrame([('{"rows":[{"a":1,"b":{"c":[0,{"z":1,"y":2}]}},{"a":2.50}]}',), ('{"rows":[{"a":"x"}]}',), (None,)], "doc string")
    routed = parsed(docs.join(compile_catalogue(rules)))
    planned, plain = (with_json_records(df).orderBy("doc").collect() for df in (routed, routed.drop("json_plan")))
    assert [[step["name"] for step in r["json_plan"]["inner"]] for r in planned] == [["b", "c"]] * 3
    want = [[], [["x", "", ""]], [["1", '{"z":1,"y":2}', ""], ["2.5", "", ""]]]
    for rows_ in (planned, plain):
        assert sorted([[c["value"] for c in cells] for cells in r["_json_records"]] for r in rows_) == sorted(want)


def test_sinks_are_written_without_a_sort(spark, tmp_path, monkeypatch):
    seen = []
    monkeypatch.setattr("leafmill.operators.collect.write_by", lambda df, column, path, values: (seen.append(values), write_by(df, column, path, values)))
    done = job(spark, tmp_path)
    assert seen == [4] and spark.conf.get(WRITERS) == "0"
    assert {r["tag"] for r in done.table.select("tag").distinct().collect()} == {"record", "page", "warning", "reject"}


def test_limits_are_named_as_they_were_used(spark, tmp_path):
    done = job(spark, tmp_path, max_rows=2, max_chars=3, max_bytes=70)
    rows_of = {(r["rule_id"], r["run_id"], r["page_index"]): (r["rows"], r["matched"]) for r in done.pages().collect()}
    assert rows_of["cards", "r1", 0] == (0, 3) and rows_of["api", "r3", 0] == (1, 2)
    said = [r["message"] for r in done.warnings().where("run_id = 'r1' and page_index = 0 and rule_id = 'cards'").orderBy("pos").collect()]
    assert "2 条" in said[0] and "70 字节" in said[1]
    assert job(spark, tmp_path, max_chars=3).records().where("field_name = 'name' and length(value) > 3").isEmpty()


def test_no_responses_and_no_rules(spark, tmp_path):
    (tmp_path / "rules").mkdir()
    (tmp_path / "rules" / "a.json").write_text("[]")
    empty = read_rules(spark, str(tmp_path / "rules"))
    assert {r["reject_reason"] for r in collect(rows(spark), empty, ["run_id"]).rejects().collect()} == {"no rule for the host"}
    assert collect(rows(spark).limit(0), empty, ["run_id"]).table.count() == 0


def test_missing_pages_stay_missing_and_take_nothing_from_others(spark):
    html = [None, "<p>a</p>", None, None, "<p>b</p>", "", None]
    df = spark.createDataFrame(list(enumerate(html)), "i int, html string").coalesce(1)
    got = {r["i"]: r["n"] for r in df.select("i", F.size(shred("html")).alias("n")).select("i", F.when(F.col("n") >= 0, F.col("n")).alias("n")).collect()}
    whole = {r["i"]: r["n"] for r in df.where("html is not null").select("i", F.size(shred("html")).alias("n")).collect()}
    assert got == {i: whole.get(i) for i in range(len(html))}


def test_many_rows_and_hits(spark):
    """Containers share the page's hits; the time is no product of the two."""
    page = "<ul>" + "".join(f"<li><b>{i}</b><i>{i}</i></li>" for i in range(20_000)) + "</ul>"
    from leafmill.operators.html import extract_html

    fields = [{"name": "b", "selector": "b", "attribute": "text"}, {"name": "i", "selector": "li > i", "attribute": "text"}]
    df = with_nodes(spark.createDataFrame([(1, "https://a.example.com/", page)], "page_id int, url string, html string"))
    got = extract_html(df, {"rowSelector": "li", "fields": fields}, ["page_id"])
    assert got.where("b <> cast(row_pos as string) or i <> b").isEmpty() and got.count() == 20_000
