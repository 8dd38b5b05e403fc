import pytest
from pyspark.sql import functions as F

from leafmill.fixed import WARN_EMPTY_FIELD_HTML, WARN_NO_CONTAINER, WARN_PAGE_BYTES, WARN_ROW_CAP
from leafmill.functions.markup import flatten, tree
from leafmill.functions.selectors import SelectorError, parse_selector, select, select_by, selector_rows, BRANCHES
from leafmill.operators.catalog import preset
from leafmill.operators.html import compile_rules, extract_html, extract_html_multi, extract_page, with_nodes

BOOKS = preset("books")


def page(spark, html, url="https://garden.test/lots/"):
    return with_nodes(spark.createDataFrame([(1, url, html)], "id int, url string, html string"))


def rule(row, *fields, next_selector=""):
    return {
        "rowSelector": row,
        "nextSelector": next_selector,
        "fields": [{"name": n, "selector": s, "attribute": a} for n, s, a in fields],
    }


SHELF = (
    "<title> Seeds and bulbs </title><section class=lot><h2>Tulip<i>!</i></h2><a href='t/9?c=red'>see</a><em data-n='30'>30 bulbs</em></section>"
    "<p>between</p><section class='lot late'><h2>Crocus</h2><b>sold out</b></section><h2>Outside</h2><a class=more href='../p/2'>more</a>"
)
LOTS = rule("section.lot", ("plant", "h2", "text"), ("page", "a", "href"), ("count", "em", "data-n"), ("state", "b", "text"), next_selector="a.more")


def test_records_stay_within_their_container(spark):
    got = extract_page(page(spark, SHELF, "https://garden.test/s/list"), LOTS).head()
    names = [f["name"] for f in LOTS["fields"]]
    assert [[r[n] for n in names] for r in got.records] == [
        ["Tulip!", "https://garden.test/s/t/9?c=red", "30", ""], ["Crocus", "", "", "sold out"],
    ]
    assert (got.matched, got.title, got.next_url, got.warnings) == (2, "Seeds and bulbs", "https://garden.test/p/2", [])


def test_a_preset_reads_its_pages(spark):
    html = "".join(f"<article class='product_pod'><h3><a title='{t}' href='{t}.htm'>..</a></h3><p class='price_color'>{n} kr</p></article>" for n, t in enumerate(("Moss", "Fern", "Ivy")))
    got = extract_page(page(spark, html, "https://garden.test/read/"), BOOKS).head()
    wanted = {f["name"]: f for f in BOOKS["fields"]}
    title = next(n for n, f in wanted.items() if f["attribute"] == "title")
    link = next(n for n, f in wanted.items() if f["attribute"] == "href")
    assert [(r[title], r[link]) for r in got.records] == [(t, f"https://garden.test/read/{t}.htm") for t in ("Moss", "Fern", "Ivy")]


def test_values_of_one_cell_fold(spark):
    """Equal values once, in order of their first place; links that are not web links go; nothing found leaves a warning."""
    html = "<ol><li><a href='b#1'>ash</a> <a href='mailto:x@y.z'>oak</a> <a href='b#1'>ash</a> <a href='//elm.test'>elm</a></li></ol>"
    found = extract_page(page(spark, html, "https://trees.test/a"), rule("li", ("links", "a", "href"), ("names", "a", "text"), ("none", "u", "text"))).head()
    links = found.records[0]["links"].split("\n")
    assert len(links) == 2 and links[0].startswith("https://trees.test/b") and links[1] == "https://elm.test/"
    assert found.records[0]["names"] == "ash\noak\nelm"
    assert found.warnings == [WARN_EMPTY_FIELD_HTML % "none"] and found.title == "trees.test"


def test_scope_is_the_container(spark):
    html = "<nav><span id=s1 title=north>N</span><span id=s2>S<b>!</b></span></nav>"
    got = extract_page(page(spark, html), rule("span", ("own", ":scope", "text"), ("t", ":scope", "title"))).head()
    assert [(r["own"], r["t"]) for r in got.records] == [("N", "north"), ("S!", "")]


def test_nothing_is_cut_unless_asked(spark):
    shelf = "".join(f"<li class='jar'><b>{n}</b></li>" for n in range(517))
    jars = rule("li.jar", ("n", "b", "text"))
    whole = extract_page(page(spark, f"<ul>{shelf}</ul>"), jars).head()
    assert [r["n"] for r in whole.records] == [str(n) for n in range(517)] and whole.warnings == []
    some = extract_page(page(spark, f"<ul>{shelf}</ul>"), jars, max_rows=9).head()
    assert len(some.records) == 9 and some.matched == 517 and "本页超过 9 条记录，仅保留前 9 条。" in some.warnings
    folded = extract_page(page(spark, f"<ul>{shelf}</ul>"), rule("ul", ("all", "b", "text"))).head().records[0]["all"]
    assert folded.split("\n") == [str(n) for n in range(517)]
    bare = extract_page(page(spark, "<section>nothing on sale</section>"), jars).head()
    assert bare.records == [] and bare.warnings == [WARN_NO_CONTAINER]
    assert WARN_ROW_CAP in extract_page(page(spark, f"<ul>{shelf}</ul>"), jars, max_rows=200).head().warnings
    # the record that crosses a byte limit goes too
    notes = "".join(f"<i>{c * 90}</i>" for c in "abcd")
    sized = extract_page(page(spark, notes, "https://shop.test/"), rule("i", ("t", ":scope", "text")), max_bytes=300).head()
    assert WARN_PAGE_BYTES in extract_page(page(spark, f"<i>{'e' * (1 << 20)}</i>"), rule("i", ("t", ":scope", "text")), max_bytes=1 << 20).head().warnings
    assert len(sized.records) == 2 and "本页提取数据超过 300 字节，仅保留限额内的记录。" in sized.warnings


def test_long_cells_stay_whole(spark):
    html = "<em>%s</em>" % ("ab " * 11_111)
    cell = extract_page(page(spark, html), rule("", ("t", "em", "text"))).head().records[0]["t"]
    assert cell == ("ab " * 11_111).strip()
    assert extract_page(page(spark, html), rule("", ("t", "em", "text")), max_chars=7).head().records[0]["t"] == "ab ab a"


BASES = {
    "": "https://garden.test/s/", "<base href='deep/er/x'>": "https://garden.test/s/deep/er/", "<base target=_top><base href='//cdn.test/q/'>": "https://cdn.test/q/",
    "<base href='/one/'><base href='/two/'>": "https://garden.test/one/", "<base href='mailto:a@b.c'>": "https://garden.test/s/", "<base href='https://x:y:z/'>": "https://garden.test/s/",
}


def test_base_url(spark):
    source = "https://garden.test/s/list"
    df = spark.createDataFrame([(b, source, b + "<section class=lot><a href='lot7'>7</a></section><a class=more href='later'>m</a>") for b in BASES], "id string, url string, html string")
    got = {r.id: r for r in extract_page(with_nodes(df), LOTS).collect()}
    for base, folder in BASES.items():
        assert (got[base].records[0]["page"], got[base].next_url, got[base].records[0]["_source"]) == (folder + "lot7", folder + "later", source), base


SAMPLE = (
    '<div id="a" class="x y"><p lang="en-GB">one<b>two</b></p><p>three</p><span data-k="v1">s</span></div>'
    '<ul><li class="x"><a href="/1">l1</a></li><li><a href="/2">l2</a><i></i></li><li>l3</li></ul><div class="y"><p>four</p></div>'
)
SELECTORS = {
    "p": 3, "*": 17, "#a": 1, ".x": 2, ".x.y": 1, "div p": 3, "#a > p": 2, "p + p": 1, "p ~ span": 1, "li, span": 4,
    "[lang]": 1, '[lang|="en"]': 1, '[data-k^="v"]': 1, '[data-k$="1"]': 1, '[href*="/"]': 2, '[class~="y"]': 2,
    '[data-k="V1" i]': 1, "li:has(a)": 2, "div:has(> span)": 1, "li:not(.x)": 2, "li:first-child": 1, "li:last-child": 1,
    "li:nth-child(2n+1)": 2, "p:nth-of-type(2)": 1, "li:nth-last-child(1)": 1, "i:empty": 1, 'li:contains("l3")': 1,
    ":is(p, span)": 4, "ul li a": 2, "body > div.y p": 3, "p:only-child": 1, "span:only-of-type": 1,
}


def test_selectors_in_both_forms(spark):
    """The specialised and the data-driven evaluation agree on every selector."""
    df = page(spark, f"<html><head></head><body>{SAMPLE}</body></html>")
    nodes = F.col("nodes")
    rules = spark.createDataFrame([(s, selector_rows(s)) for s in SELECTORS], f"s string, sel {BRANCHES}")
    by_data = {
        r.s: r.pre
        for r in df.join(rules).select("s", F.transform(select_by(nodes, F.col("sel")), lambda n: n["pre"]).alias("pre")).collect()
    }
    fixed = df.select(*[F.transform(select(nodes, s), lambda n: n["pre"]).alias(f"c{i}") for i, s in enumerate(SELECTORS)]).head()
    for i, (s, count) in enumerate(SELECTORS.items()):
        assert fixed[i] == by_data[s], s
        assert len(fixed[i]) == count, s


@pytest.mark.parametrize("bad", ["div[data-x", "a:hover", "p >", "", "a::before", ":has(a b)", ":eq(1)", "li:nth-child(x)", "a,,b"])
def test_unsupported_selectors_fail(bad):
    with pytest.raises(SelectorError):
        parse_selector(bad)


def test_leading_scope_and_outer_ancestors(spark):
    html = '<div class="o"><div class="r"><p>a</p><div><p>b</p></div></div></div>'
    got = extract_page(page(spark, html), rule(".r", ("direct", ":scope > p", "text"), ("all", ".o p", "text"))).head()
    assert got.records[0]["direct"] == "a" and got.records[0]["all"] == "a\nb"


def test_single_and_multi_rule_agree(spark):
    df = page(spark, SHELF)
    one = extract_html(df, LOTS, ["id"]).collect()
    many = extract_html_multi(df.join(compile_rules(spark, [{**BOOKS, **LOTS}])), ["id"]).collect()
    assert {(r.row_pos, r.field_name): r.value for r in many} == {
        (r.row_pos, f["name"]): r[f["name"]] for r in one for f in LOTS["fields"]
    }


def outline(html):
    return [(n[4], n[12]) if n[4] == "#text" else n[4] for n in flatten(tree(html))][4:]


def test_tree_rules():
    assert outline("<p>a<p>b") == ["p", ("#text", "a"), "p", ("#text", "b")]
    assert outline("<b>1<p>2</b>3</p>") == ["b", ("#text", "1"), "p", "b", ("#text", "2"), ("#text", "3")]
    assert outline("<p><b>x<p>y") == ["p", "b", ("#text", "x"), "p", "b", ("#text", "y")]
    assert outline("<table><tr><td>1<td>2</table>") == ["table", "tbody", "tr", "td", ("#text", "1"), "td", ("#text", "2")]
    assert outline("<table>f<tr><td>x") == [("#text", "f"), "table", "tbody", "tr", "td", ("#text", "x")]
    assert outline('<script>"</p>"</script>x<!-- c -->y') == [("#text", "xy")]
    assert outline("a &amp; b &copy;") == [("#text", "a & b ©")]
    assert outline("<ul><li>a<li>b</ul>") == ["ul", "li", ("#text", "a"), "li", ("#text", "b")]
    assert outline('<a href="/?a=1&copy=2&amp;b">x')[0] == "a"
    assert flatten(tree('<a href="/?a=1&copy=2&amp;b">x'))[4][5] == {"href": "/?a=1&copy=2&b"}


def test_subtrees_are_slices():
    nodes = flatten(tree(SAMPLE))
    for n in nodes:
        inside = [m[0] for m in nodes if n[0] in m[11]]
        assert inside == list(range(n[0] + 1, n[0] + 1 + n[1]))


def test_missing_page_text_gives_no_nodes(spark):
    df = with_nodes(spark.createDataFrame([(1, None), (2, "<p>x"), (3, None)], "id int, html string"))
    assert df.filter(F.col("nodes").isNull()).count() == 2


def test_shredding_happens_once_per_page(spark):
    df = spark.createDataFrame([(1, "https://e.org/", SHELF)], "id int, url string, html string")
    plan = extract_html(with_nodes(df), BOOKS, ["id"]).filter("row_pos >= 0")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan


def test_lists_of_a_large_page(spark):
    """Many elements of many selectors; each selector is scored by its first element."""
    from leafmill.operators.infer import html_lists

    items = "".join(f'<li class="k{i % 40} row"><a href="/{i}">x{i}</a></li>' for i in range(20_000))
    page = f"<nav><ul><li>a</li><li>b</li></ul></nav><ul>{items}</ul><div class=one>alone</div><table><tr><td>1<tr><td>2</table>"
    df = with_nodes(spark.createDataFrame([(page,)], "html string")).select(html_lists(F.col("nodes")).alias("lists"))
    got = [(r["selector"], r["score"]) for r in df.first()["lists"]]
    assert got == [(f"li.k{i}", 40) for i in range(40)] + [("tr", 52)]
