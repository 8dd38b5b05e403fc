"""JSON cells and records: kinds, order, duplicates and the number of parses."""

import json

import pytest
from pyspark.sql import functions as F

from leafmill.functions.json_cells import json_cells
from leafmill.functions.jsonpath import JsonPlace, browser_text, json_cell, normalize_path, nested_text, parsed, path_plan, path_steps, plan_cells
from leafmill.operators.gates import split_rejects
from leafmill.operators.json_records import extract_json, extract_json_page, json_bodies
from leafmill.plans.json_queries import json_kinds

DEEP = '{"a":{"b":[{"c":"1.50","d":1.50,"e":{"z":1000.0,"y":[1e3,-0,0.10,"1e3"]}},null,"x"]},"k":1,"2":"two","k":{"last":[true,null]}}'
CELLS = [
    (DEEP, "a.b[0].c", "1.50"),
    (DEEP, "a.b[0].d", "1.5"),
    (DEEP, "a.b[0].e", '{"z":1000,"y":[1000,0,0.1,"1e3"]}'),
    (DEEP, "a.b[0].e.z", "1000"),
    (DEEP, "a.b[0].e.y.length", "4"),
    (DEEP, "a.b[1]", None),
    (DEEP, "a.b[1].c", None),
    (DEEP, "a.b[2]", "x"),
    (DEEP, "a.b[2].length", None),
    (DEEP, "a.b[9]", None),
    (DEEP, "k.last", "[true,null]"),
    (DEEP, "[2]", "two"),
    ('["1.50", 2.50]', "[0]", "1.50"),
    ('["1.50", 2.50]', "[1]", "2.5"),
    ('{"length":"own"}', "length", "own"),
    ('{"a":[{"1":["x","y"]}]}', "a[0][1][1]", "y"),
    ('{"a":1.0E-7,"b":"[1.0]"}', "a", "1e-7"),
    ('{"a":1.0E-7,"b":"[1.0]"}', "b", "[1.0]"),
    ('{"a":12345678901234567890}', "a", "12345678901234567890"),
    ('{"s":"true"}', "s", "true"),
    ('{"s":{"q":"a\\\\\\"1.0, \\\\","n":1.0}}', "s", '{"q":"a\\\\\\"1.0, \\\\","n":1}'),
    # what has a name twice prints its members in order, the last one of each
    ('{"o":{"z":1.0,"y":2,"z":{"q":3.0}}}', "o", '{"y":2,"z":{"q":3}}'),
    ('{"o":{"z":1,"y":2},"o":{"z":2,"y":1}}', "o", '{"z":2,"y":1}'),
    ('{"o":{"z":"\\\\ud83d\\\\ude00 \\ud83d\\ude00 😀 \\u00e9","y":[]}}', "o", '{"z":"\\\\ud83d\\\\ude00 😀 😀 é","y":[]}'),
    ("3.10", "$", "3.1"),
    ('"3.10"', "$", "3.10"),
    ("null", "$", None),
    (' { "a" : [ 1.0 , 2 ] } ', "$", '{"a":[1,2]}'),
]


def test_cells(spark):
    docs = parsed(spark.createDataFrame([(i, d, p) for i, (d, p, _) in enumerate(CELLS)], "i int, doc string, path string"))

    def printed(place):
        cell = json_cell(F.col("parsed"), place)
        return F.when(cell["nested"], nested_text(cell["text"], F.col("doc"), place)).otherwise(cell["text"])

    by_column = {r["i"]: r["cell"] for r in docs.select("i", printed(JsonPlace.at(normalize_path(F.col("path")))).alias("cell")).collect()}
    for i, (_, path, want) in enumerate(CELLS):
        assert docs.where(F.col("i") == i).select(printed(JsonPlace.of(path)).alias("cell")).first()["cell"] == want, CELLS[i]
        assert by_column[i] == want, CELLS[i]


def test_cells_of_a_plan(spark):
    """All paths of a rule, read in one go, give what each of them gives."""
    paths = ["$", "a.b[0].c", "a.b[0].e.y[3]", "a.b[0].e.y.length", "a.b.length", "length", "[2]", "[07]", "[99999999999]", "k.last[1]", "a[0][1][1]", "a.b[1]", None, "o.z", "s.q", "s"]
    docs = sorted({d for d, _, _ in CELLS} | {'{"7":1,"07":"seven"}', "[]", '[[1,2],{"length":null},"x"]'})
    some = [p for p in paths if p != "[99999999999]"]
    df = parsed(spark.createDataFrame([(i, d, paths, some) for i, d in enumerate(docs)], "i int, doc string, paths array<string>, some array<string>"))
    df = df.withColumns({"n": F.transform("paths", normalize_path), "m": F.transform("some", normalize_path)}).withColumn("plan", path_plan(F.col("n")))
    cell = lambda k, text, nested: F.struct(text.alias("text"), F.coalesce(nested, F.lit(False)).alias("nested"))
    each = F.transform("m", lambda p: F.struct(json_cell(F.col("parsed"), JsonPlace.at(p))["text"].alias("text"), F.coalesce(json_cell(F.col("parsed"), JsonPlace.at(p))["nested"], F.lit(False)).alias("nested")))
    got = df.select("plan", plan_cells(F.col("parsed"), F.col("plan"), cell).alias("cells"), each.alias("each")).collect()
    for r in got:
        assert r["cells"][:8] + r["cells"][9:] == r["each"] and r["cells"][8]["text"] is None
    # each container is opened once: a, a.b, a.b[0], a.b[0].e, a.b[0].e.y, k, k.last, a[0], a[0][1], o, s
    assert len(got[0]["plan"]["inner"]) == 11 and len(got[0]["plan"]["cells"]) == len(paths)


def test_records(spark):
    docs = spark.createDataFrame(
        [(1, '{"r":[{"v":"1.50"},null,{"v":2.50},{"v":{"b":1.0,"a":2}},"text",7]}'), (2, '{"r":{"v":true}}'), (3, '{"r":null}'), (4, "{}"), (5, '{"r":[]}'), (6, '{"r":[1],"r":[{"v":{"b":1,"a":2}}]}')],
        "i int, doc string",
    ).withColumn("url", F.lit("https://a.example/x?y#z"))
    rule = {"rowSelector": "r", "fields": [{"name": "v", "selector": "v"}, {"name": "all", "selector": "$"}]}
    got = [tuple(r) for r in extract_json(docs, rule, ["i"]).orderBy("i", "row_pos").select("i", "row_pos", "v", "all").collect()]
    assert got == [
        (1, 0, "1.50", '{"v":"1.50"}'), (1, 1, "", ""), (1, 2, "2.5", '{"v":2.5}'), (1, 3, '{"b":1,"a":2}', '{"v":{"b":1,"a":2}}'), (1, 4, "", "text"), (1, 5, "", "7"),
        (2, 0, "true", '{"v":true}'), (6, 0, '{"b":1,"a":2}', '{"v":{"b":1,"a":2}}'),
    ]
    pages = {r["i"]: (r["matched"], len(r["warnings"])) for r in extract_json_page(docs, rule).collect()}
    assert pages == {1: (6, 0), 2: (1, 0), 3: (0, 1), 4: (0, 1), 5: (0, 1), 6: (1, 0)}


@pytest.mark.parametrize("seed", range(3))
def test_nested_texts_agree_with_another_parser(spark, seed):
    import random

    rng = random.Random(seed)

    def value(depth):
        kind = rng.randrange(7 if depth < 4 else 4)
        if kind == 0:
            return rng.choice(["", 'q"\\\n\t/é', "1.0", "-0", "a:{[,", " 😀"])
        if kind < 3:
            return rng.choice([0, -7, 1.5, 1e21, 2.5e-9, 10**17, True, None])
        if kind < 5:
            return {rng.choice("zyxwabc") + str(i): value(depth + 1) for i in range(rng.randrange(4))}
        return [value(depth + 1) for _ in range(rng.randrange(4))]

    rows = [(i, json.dumps({"v": {"n": value(0), "m": value(1)}}, ensure_ascii=bool(i % 2), indent=i % 3 or None)) for i in range(150)]
    docs = spark.createDataFrame(rows, "i int, doc string").withColumn("url", F.lit("https://a.example/"))
    rule = {"rowSelector": "", "fields": [{"name": "v", "selector": "v"}]}
    for r in extract_json(docs, rule, ["i"]).collect():
        assert json.loads(r["v"]) == json.loads(rows[r["i"]][1])["v"]
        assert list(json.loads(r["v"])) == ["n", "m"]
        assert "1e+21" in r["v"] or "e+" not in r["v"]


def test_long_strings_full_of_escapes(spark):
    text = '\\"1.0\\\\' * 60_000
    row = spark.createDataFrame([(f'{{"s":"{text}","n":1.0}}',)], "doc string").select(browser_text(F.col("doc")).alias("t")).first()
    assert row["t"] == f'{{"s":"{text}","n":1}}'


def test_a_body_is_parsed_once(spark, tmp_path):
    path = str(tmp_path / "bodies")
    spark.createDataFrame([(1, b'{"r":[{"v":"1.50","w":{"a":1}}]}'), (2, b"{")], "i int, body binary").withColumn("url", F.lit("https://a.example/")).write.parquet(path)
    good, bad = split_rejects(json_bodies(spark.read.parquet(path)))
    rule = {"rowSelector": "r", "fields": [{"name": "v", "selector": "v"}, {"name": "w", "selector": "w"}]}
    rows = extract_json(good, rule, ["i"])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("try_parse_json") + plan.count("parse_json") <= 2, plan
    assert [tuple(r) for r in rows.select("i", "v", "w").collect()] == [(1, "1.50", '{"a":1}')]
    assert [r["i"] for r in bad.collect()] == [2]


def test_cells_of_a_rule_are_columns(spark):
    """No function of an array stands over the cells of a record but where a text needs one, and kinds stay right."""
    docs = spark.createDataFrame(
        [(1, '{"r":[{"a":["x",{"b":10.50}],"n":0.0,"m":-0.0,"l":123456789.1234567,"o":{"z":[1.50,"a:1.50",-2.0,1e3],"y":"\\"[1.0"}},null,7]}'), (2, '{"r":{"a":{"1":{"b":"1.0"}},"o":{"z":1,"y":2,"z":3}}}')],
        "i int, doc string",
    ).withColumn("url", F.lit("https://a.example/x?y"))
    rule = {"rowSelector": "r", "fields": [{"name": n, "selector": p} for n, p in [("b", "a[1].b"), ("n", "n"), ("m", "m"), ("l", "l"), ("o", "o"), ("k", "a.length")]]}
    rows = extract_json(docs, rule, ["i"], max_rows=2)
    assert [tuple(r) for r in rows.orderBy("i", "row_pos").drop("_source").collect()] == [
        (1, 0, "10.5", "0", "0", "123456789.1234567", '{"z":[1.5,"a:1.50",-2,1000],"y":"\\"[1.0"}', "2"), (1, 1, *[""] * 6),
        (2, 0, "1.0", "", "", "", '{"y":2,"z":3}', ""),
    ]
    assert rows.schema.names == ["i", "row_pos", "b", "n", "m", "l", "o", "k", "_source"]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "_cells" not in plan and "_records" not in plan
    paged = extract_json_page(docs, rule, max_rows=2).select("i", F.posexplode("records").alias("row_pos", "_r")).select("i", "row_pos", "_r.*")
    assert sorted(map(tuple, paged.collect())) == sorted(map(tuple, rows.collect()))


def test_json_kinds_reads_all_lines(spark, tmp_path):
    """A body for each line item, whatever its number: three records each, the first of them empty."""
    lines = [(k, n, float(k + (n or 0)), 100.5 * k, 0.05, "N") for k in (6, 7) for n in (*range(1, 10), None)]
    schema = "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_tax double, l_returnflag string"
    spark.createDataFrame(lines, schema).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = json_kinds(spark, str(tmp_path)).select("l_orderkey", "l_linenumber", "row_pos", "quantity", "price", "tax").collect()
    cells = lambda i, q, p: (str(int(q)), f"{p:.2f}", "0.05") if i else ("", "", "")
    want = [(k, n, i, *cells(i, q, p)) for k, n, q, p, _, _ in lines for i in range(3)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_plain_texts_are_read_in_batches(spark):
    """Plain texts have their cells from one Arrow function, as VARIANT has them; the others are left to VARIANT."""
    plain = [
        '{"r":[null,{"a":39.0,"b":"1.50","a":0.050,"z":{"y":[1e3,-0.0,"é \\" 1.0"],"x":true},"7":[0.000001]},"text",7]}',
        '{"r":[{"a":1}],"r":{"z":{"y":1,"x":{"k":2.50},"y":[]},"a":[]}}', ' {"r" : [ {"a":{ "d":null , "c":1 }} ] } ', '{"b":1,"r":2}', '{"r":[]}', '{"r":null}', "[]",
    ]
    odd = ['{"r":{"a":"\\u00e9"}}', '{"r":{"a":1e21,"z":0.1234567890123}}', '{"r":{"a":NaN}}', '{"r":{"a":1}} x', "[" * 600 + "]" * 600, "[" * 1001 + "]" * 1001, '{"r":{"z":{"é":1,"é":2}}}', "{", "", None]
    docs = spark.createDataFrame(list(enumerate(plain + odd)), "i int, doc string").withColumn("url", F.lit("https://a.example/x?y"))
    paths = ["a", "b", "z", "z.y", "z.y[1]", "z.y.length", "[7]", "[7][0]", "$"]
    rule = {"rowSelector": "r", "fields": [{"name": f"f{i}", "selector": p} for i, p in enumerate(paths)]}
    read = json_cells(F.col("doc"), ["r"], [path_steps(p) for p in paths])
    found = {r["i"]: r["read"] for r in docs.select("i", read.alias("read")).collect()}
    assert [i for i, cells in sorted(found.items()) if cells is None] == [*range(len(plain), len(plain) + len(odd))]
    assert tuple(found[0][1]) == ("0.05", "1.50", '{"y":[1000,0,"é \\" 1.0"],"x":true}', '[1000,0,"é \\" 1.0"]', "0", "3", "[0.000001]", "0.000001", found[0][1]["_8"])
    assert tuple(found[1][0])[2:] == ('{"x":{"k":2.5},"y":[]}', "[]", "", "0", "", "", '{"a":[],"z":{"x":{"k":2.5},"y":[]}}')
    for options in ({}, {"max_rows": 2, "max_chars": 5}):
        rows = extract_json(docs, rule, ["i"], **options)
        assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, extract_json(parsed(docs), rule, ["i"], **options).collect()))
    texts = [r for cells in found.values() for r in cells or []]
    assert len(texts) == 4 + 1 + 1 + 1 and {r["i"] for r in extract_json(docs, rule, ["i"]).collect()} >= {0, 1, 2, 3, 7, 8}
