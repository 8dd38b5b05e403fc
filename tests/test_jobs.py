import csv
import io
import random

from pyspark.sql import functions as F

from leafmill.operators.admission import audit_resources
from leafmill.operators.caps import byte_cap_page, byte_cap_run, row_cap
from leafmill.operators.caps import prefix_sum
from leafmill.operators.catalog import keep_rules, presets, upsert_rules, validate_rules
from leafmill.operators.frontier import agent_rules, paginate, parse_robots, resolve_redirects, robots_allowed, schedule
from leafmill.operators.runs import fold_events, retain, run_warnings
from leafmill.operators.view import dedupe_first, natural_order, select_rows, view_counts
from leafmill.schemas import EVENTS
from leafmill.session import work_path
from leafmill.sources.responses import read_events
from leafmill.sources.run_store import RunStore
from leafmill.sources.sinks import csv_parts, write_csv
from leafmill.streaming.jobs import FOLD_OUTPUT, latest_fold, stream_fold, stream_table
from leafmill.plans.registry import registry


def test_view(spark):
    """Three towns in turn, every fourth weight missing, against plain Python."""
    cells = [(i, ("Turku", "oulu", "Vaasa")[i % 3], "" if i % 4 == 0 else str(i * 7 % 24), f"p{i // 6}") for i in range(48)]
    df, fields = spark.createDataFrame(cells, "row_pos int, town string, weight string, _source string"), ["town", "weight"]
    firsts = {}
    for i, town, weight, _ in cells:
        firsts.setdefault((town, weight), i)
    got = select_rows(df, fields, "row_pos", dedupe="__all__", sort="weight").collect()
    assert {r.row_pos for r in got if r.weight} == {i for (_, w), i in firsts.items() if w}
    numbers = [int(r.weight) for r in got if r.weight]
    assert numbers == sorted(numbers)
    found = select_rows(df, fields, "row_pos", query="OUL", column="town").collect()
    assert {r.row_pos for r in found} == {i for i, town, _, _ in cells if town == "oulu"}
    once = {r.row_pos for r in select_rows(df, fields, "row_pos", dedupe="weight").collect()}
    # blank keys are no copies of each other
    assert once == {i for i, _, w, _ in cells if not w or i == min(j for j, _, x, _ in cells if x == w)}
    assert select_rows(df, fields, "row_pos", empty="missing").count() == 12
    assert select_rows(df, fields, "row_pos", column="weight", empty="filled").count() == 36
    counts = view_counts(df, fields, "row_pos", dedupe="weight").head()
    assert (counts.filtered_count, counts.shown_count, counts.removed_count) == (48, len(once), 48 - len(once))


def test_natural_order_is_stable_both_ways(spark):
    data = [(i, t) for i, t in enumerate(["b", "A10", "a2", "", "a02", "B", "10", "2"])]
    df = spark.createDataFrame(data, "pos int, t string")
    up = [r.pos for r in df.orderBy(*natural_order("t", "pos")).collect()]
    down = [r.pos for r in df.orderBy(*natural_order("t", "pos", True)).collect()]
    assert up == [3, 7, 6, 2, 4, 1, 0, 5]
    assert down == [0, 5, 1, 2, 4, 6, 7, 3]


def test_dedupe_keeps_the_first_of_a_hot_key(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    got = dedupe_first(df.orderBy(F.rand(1)), ["k"], "id").collect()
    assert len(got) == 2001 and [r.id for r in got if r.k == "hot"] == [0]


def test_csv_parts_are_complete_files(spark):
    """Every part is read back by Python's own reader; text that a spreadsheet would run is guarded."""
    cells = [("plain", "5"), ('a "b", c', "line\nbreak"), ("+1", "-2"), ("@x", "tab\there"), (" =1", ""), ("x=1", "ü")]
    df = spark.createDataFrame([(a, b, "https://garden.test/") for a, b in cells], "a string, b string, _source string")
    path = work_path(spark, "csv")
    write_csv(df.repartition(3), path, ["a", "b"])
    read = []
    for part in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).collect():
        if part.length:
            text = part.content.decode("utf-8-sig")
            assert text.endswith("\r\n") and part.content.startswith("\ufeff".encode())
            head, *rest = csv.reader(io.StringIO(text, newline=""))
            assert head == ["a", "b", "_source"]
            read += [tuple(r[:2]) for r in rest]
    guard = lambda t: "'" + t if t.strip()[:1] in tuple("=+-@") else t
    assert sorted(read) == sorted((guard(a), guard(b)) for a, b in cells)


def test_csv_parts_are_measured_without_taking_a_file_whole(spark, tmp_path):
    """Sizes and heads of parts that Spark may not read as one value, and of parts without a mark or header."""
    texts = [("en", "word " * 60 + str(i)) for i in range(40)] + [("de", "x\r\ny"), ("fr", 'say "so"'), ("es", None)]
    rows = [(i, t, lang, f"s{i % 3}", len(t or "")) for i, (lang, t) in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    lead = {"en": "plain, ", "de": "'=SUM(1)", "fr": "'  -x \"q\" ", "es": "'\ttab"}
    cell = lambda lang, t: '""' if t is None else '"' + (lead[lang] + t).replace('"', '""') + '"'
    size = sum(len(f'{cell(lang, t)},"{source}"\r\n') for _, t, lang, source, _ in rows)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")
    try:
        got = registry()["csv_empty"][0](spark, str(tmp_path)).collect()
        assert {(r["view"], r.headed, r.row_bytes) for r in got} == {("none", True, 9), ("split", True, size)}
        (whole,) = registry()["csv_files"][0](spark, str(tmp_path)).collect()
        assert (whole.headed, whole.row_bytes) == (True, size)
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    head = '"a","_source"\r\n'
    parts = {"part-0": "\ufeff" + head + '"1","s"\r\n', "part-1": head + '"1","s"\r\n', "part-2": '\ufeff"b","_source"\r\n', "part-3": "", "other": "x"}
    (tmp_path / "csv").mkdir()
    for name, text in parts.items():
        (tmp_path / "csv" / name).write_bytes(text.encode())
    found = {r.path[-6:]: (r.headed, r.row_bytes) for r in csv_parts(spark, f"{tmp_path}/csv", ["a"]).collect()}
    assert found == {"part-0": (True, 9), "part-1": (False, 6), "part-2": (False, 0)}


def test_prefix_sum_over_chunks(spark):
    rnd = random.Random(3)
    data = [(rnd.choice("aab"), i, rnd.randint(0, 50)) for i in range(400)]
    df = spark.createDataFrame(data, "g string, i int, v int").withColumn("c", F.floor(F.col("i") / 16))
    total, want = {}, {}
    for g, i, v in data:
        total[g] = want[i] = total.get(g, 0) + v
    assert {r.i: r.s for r in prefix_sum(df, ["g"], ["c"], ["i"], "v", "s").collect()} == want


def test_schedule_equals_the_sequential_rule(spark):
    rnd = random.Random(5)
    data = sorted((rnd.randint(0, 60_000), i, rnd.choice("aaab"), rnd.choice([1000, 2000, 5000])) for i in range(300))
    last, want = {}, {}
    for arrival, i, origin, interval in data:
        start = arrival
        if origin in last:
            start = max(arrival, last[origin][0] + max(interval, last[origin][1]))
        last[origin], want[i] = (start, interval), start
    df = spark.createDataFrame(data, "arrival_ms long, request_id int, origin string, interval_ms long")
    for chunk in (1000, 7000, 10**9):
        assert {r.request_id: r.start_ms for r in schedule(df, chunk).collect()} == want


def test_pagination_stops(spark):
    host = "https://a.example.com"
    links = [(f"{host}/1", f"{host}/2#x"), (f"{host}/2", f"{host}/1"), (f"{host}/3", "https://b.example.com/"), (f"{host}/4", None), (f"{host}/5", f"{host}/4")]
    seeds = [("loop", f"{host}/1"), ("leaves", f"{host}/3"), ("ends", f"{host}/5"), ("bad", "http://localhost/")]
    got = paginate(spark.createDataFrame(seeds, "run_id string, url string"), spark.createDataFrame(links, "url string, next_url string"), 5).collect()
    pages = {}
    for r in sorted(got, key=lambda r: r.page_index):
        pages.setdefault(r.run_id, []).append((r.url[-2:], r.stop_reason is not None))
    assert pages == {"loop": [("/1", False), ("/2", True)], "leaves": [("/3", True)], "ends": [("/5", False), ("/4", False)]}


def test_redirects(spark):
    h = "https://a.example.com"
    log = [(f"{h}/0", 301, "/1"), (f"{h}/1", 302, "https://b.example.com/2"), ("https://b.example.com/2", 200, None), (f"{h}/x", 307, ""),
           (f"{h}/l", 308, "http://127.0.0.1/"), *[(f"{h}/c{i}", 301, f"c{i + 1}") for i in range(9)]]
    asked = [(1, f"{h}/0", "GET", False), (2, f"{h}/0", "GET", True), (3, f"{h}/0", "POST", False), (4, f"{h}/x", "GET", False),
             (5, f"{h}/l", "GET", False), (6, f"{h}/c0", "GET", False), (7, f"{h}/none", "GET", False), (8, "ftp://x", "GET", False)]
    log += [(f"{h}/round", 302, "trip"), (f"{h}/trip", 302, "round")]
    asked.append((9, f"{h}/round", "GET", False))
    tables = (spark.createDataFrame(asked, "request_id int, url string, method string, same_origin boolean"),
              spark.createDataFrame(log, "url string, status int, location string"))
    want = {1: (2, 200, None), 2: (1, 302, "redirect to another site"), 3: (0, 301, "redirected POST"), 4: (0, 307, "invalid redirect"),
            5: (0, 308, "invalid redirect"), 6: (9, None, "no response"), 7: (0, None, "no response"), 8: (0, None, "not admitted"),
            9: (1, 302, "too many redirects")}
    assert {r.request_id: (r.hops, r.status, r.reason) for r in resolve_redirects(*tables).collect()} == want
    limited = {r.request_id: (r.hops, r.status, r.reason) for r in resolve_redirects(*tables, max_redirects=5).collect()}
    assert limited == want | {6: (5, 301, "too many redirects")}
    none = resolve_redirects(tables[0].where("false"), tables[1])
    assert none.count() == 0


def test_pagination_has_no_limit_of_its_own(spark):
    at = "https://long.example.com/list?p="
    links = spark.createDataFrame([(f"{at}{i}", f"{at}{i + 1}" if i < 13 else None) for i in range(14)], "url string, next_url string")
    seeds = spark.createDataFrame([(7, f"{at}0")], "run_id int, url string")
    assert sorted(r.page_index for r in paginate(seeds, links).collect()) == list(range(14))
    assert paginate(seeds, links, max_pages=4).count() == 4


def test_robots(spark):
    body = "User-agent: *\nDisallow: /\n\nUser-agent: Mine/1.0\nDisallow: /a\nAllow: /a/b$\nDisallow: /*.pdf$\nCrawl-delay: 3\n"
    robots = spark.createDataFrame([("https://a.example.com", 200, body), ("https://b.example.com", 503, ""), ("https://c.example.com", 404, "")], "origin string, status int, body string")
    urls = {"https://a.example.com/": True, "https://a.example.com/a": False, "https://a.example.com/a/b": True, "https://a.example.com/a/bc": False,
            "https://a.example.com/x.pdf": False, "https://a.example.com/x.pdf?y": True, "https://b.example.com/": False, "https://c.example.com/": True}
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = {r.url: r for r in robots_allowed(df, robots, "mine").collect()}
    assert {u: r.allowed for u, r in got.items()} == urls and got["https://a.example.com/"].interval_ms == 3000
    assert {r.url: r.allowed for r in robots_allowed(df, robots, "other").collect()}["https://a.example.com/"] is False
    groups = parse_robots(robots.filter("status = 200").select("origin", "body"))
    assert agent_rules(groups, "mine").head().delay == 3.0


def test_resource_audit_counts(spark):
    log = [(1, i, "https://x.example.com/", "GET", "script", False, 200, 10) for i in range(70)]
    log += [(1, 100, "https://x.example.com/", "POST", "xhr", False, 200, 10), (2, 1, "https://x.example.com/", "GET", "document", True, 404, 5), (2, 2, "https://x.example.com/", "GET", "document", True, 200, 5)]
    df = spark.createDataFrame(log, "page_id int, seq int, url string, method string, resource_type string, navigation boolean, status int, bytes long")
    got = {r.page_id: (r.requested, r.served, r.blocked, r.failed) for r in audit_resources(df, max_requests=60, max_bytes=595).collect()}
    assert got == {1: (71, 60, 11, 1), 2: (2, 1, 1, 1)}


EVENT_ROWS = [
    ("a", 0, "log", "w", "warning", None), ("a", 1, "page", None, None, 1), ("a", 2, "error", "boom", None, None), ("a", 3, "page", None, None, 5),
    ("b", 0, "page", None, None, 2), ("c", 0, "page", None, None, 3), ("c", 1, "done", None, None, None),
]


def test_a_streamed_table_may_be_a_file_or_a_folder_of_parts(spark, tmp_path):
    schema = "run_id string, pos long, type string, message string, level string, rows_n long"
    events = [(f"r{i % 7}", i // 7, "done" if i > 27 else "page", None, None, i) for i in range(35)]
    df = spark.createDataFrame(events, schema)
    df.repartition(3).write.parquet(f"{tmp_path}/folder/events.parquet")
    df.coalesce(1).write.parquet(f"{tmp_path}/once")
    (part,) = (tmp_path / "once").glob("part-*.parquet")
    (tmp_path / "file").mkdir()
    (tmp_path / "file" / "events.parquet").write_bytes(part.read_bytes())
    df.limit(5).coalesce(1).write.parquet(f"{tmp_path}/folder/other.parquet")
    want = {(f"r{i}", "done", 4, 4 * i + 42) for i in range(7)}
    for place in ("folder", "file"):
        got = latest_fold(stream_table(spark, f"{tmp_path}/{place}", schema, "events.parquet"), "stream-runs")
        assert {(r.run_id, r.status, r.pages, r.rows) for r in got.collect()} == want


def test_event_fold_batch_and_stream(spark):
    schema = "run_id string, pos long, type string, message string, level string, rows_n long"
    df = spark.createDataFrame(EVENT_ROWS, schema)
    got = {r.run_id: (r.status, r.pages, r.rows) for r in fold_events(df).collect()}
    assert got == {"a": ("error", 1, 1), "b": ("error", 1, 2), "c": ("done", 1, 3)}
    assert [(r.message, r.pos) for r in run_warnings(df).orderBy("pos").collect()] == [("w", 0), ("boom", 2)]
    path = work_path(spark, "events")
    df.filter("pos < 2").write.parquet(f"{path}/in")
    df.filter("pos >= 2").write.mode("append").parquet(f"{path}/in")
    folded = stream_fold(spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).parquet(f"{path}/in"))
    latest = {}
    query = folded.writeStream.outputMode("update").option("checkpointLocation", f"{path}/check").trigger(availableNow=True).foreachBatch(
        lambda batch, _: latest.update({r.run_id: (r.status, r.pages, r.rows, r.error) for r in batch.collect()})
    ).start()
    query.awaitTermination()
    assert latest == {"a": ("error", 1, 1, "boom"), "b": ("running", 1, 2, ""), "c": ("done", 1, 3, "")}
    assert [f.split()[0] for f in FOLD_OUTPUT.split(", ")] == ["run_id", "status", "pages", "rows", "error"]


def test_event_log_scan(spark):
    path = work_path(spark, "log")
    spark.createDataFrame([('{"run_id":"r","pos":0,"type":"page","page":{"url":"u","rows":1},"rows":[{"a":"1"}]}',), ("",), ('{"run_id":"r","pos":1,"type":"done"}',)], "value string").write.text(path)
    got = read_events(spark, path).orderBy("pos").collect()
    assert [r.type for r in got] == ["page", "done"] and got[0].rows == [{"a": "1"}] and len(EVENTS) > 0


def test_retention(spark):
    runs = spark.createDataFrame([(f"{i:02}", f"2024-01-{i:02}", 10) for i in range(1, 24)], "id string, created_at string, bytes long")
    limits = {"max_runs": 20, "max_bytes": 50 << 20}
    assert sorted(r.id for r in retain(runs, **limits).collect()) == [f"{i:02}" for i in range(4, 24)]
    big = runs.withColumn("bytes", F.lit(10 << 20))
    assert sorted(r.id for r in retain(big, **limits).collect()) == ["19", "20", "21", "22", "23"]
    assert retain(big).count() == 23
    flagged = {r.id: (r.rank, r.over_limit) for r in retain(big, **limits, drop=False).collect()}
    assert flagged == {f"{i:02}": (24 - i, i < 19) for i in range(1, 24)}


def test_caps_cut_only_where_asked(spark):
    df = spark.createDataFrame([("r", p, i, "x" * 4000) for p in range(6) for i in range(300)], "run_id string, page_index int, row_pos int, v string")
    page = (["run_id", "page_index"], "row_pos", ["v"])
    run = ("run_id", "page_index", "row_pos", ["v"])
    assert row_cap(df).count() == byte_cap_page(df, *page).count() == byte_cap_run(df, *run).count() == 1800
    size = len('{"v":""}') + 4000
    assert byte_cap_page(df, *page, 10 * size).count() == 60 and byte_cap_run(df, *run, 310 * size).count() == 310
    for flagged, total, over in (
        (row_cap(df, max_rows=20, drop=False), "total_rows", 6 * 280),
        (byte_cap_page(df, *page, 10 * size, drop=False), "total_bytes", 6 * 290),
        (byte_cap_run(df, *run, 310 * size, drop=False), "total_bytes", 1490),
    ):
        assert flagged.columns == [*df.columns, total, "over_limit"]
        assert flagged.count() == 1800 and flagged.where("over_limit").count() == over


def test_rules(spark):
    found = presets(spark)
    valid, broken = validate_rules(found)
    assert valid.count() == 5 and broken.count() == 0
    books = found.filter("id = 'books'")
    bad = {
        "page count": F.col("config").withField("maxPages", F.lit(11)),
        "row selector": F.col("config").withField("rowSelector", F.lit("ul > [")),
        "field name repeated": F.col("config").withField("fields", F.flatten(F.array("config.fields", "config.fields"))),
        "paging": F.col("config").withField("maxPages", F.lit(2)).withField("nextSelector", F.lit(" ")),
        "url": F.col("config").withField("url", F.repeat(F.lit("x"), 3000)),
    }
    for code, config in bad.items():
        _, violations = validate_rules(books.withColumn("config", config))
        assert [r.violation for r in violations.collect()] == [code], code
    kept = keep_rules(found.withColumn("updatedAt", F.lit("t")).unionByName(books.withColumn("pos", F.lit(9)).withColumn("name", F.lit("again"))))
    assert kept.count() == 5 and kept.filter("name = 'again'").count() == 0
    edited = upsert_rules(found, books.withColumn("name", F.lit("new")).unionByName(books.withColumn("id", F.lit("more"))), max_rules=6)
    assert edited.count() == 6 and edited.filter("name = 'new'").head().pos == 1
    assert upsert_rules(found, books.withColumn("id", F.lit("more")), max_rules=5).count() == 5


def test_store_starts_empty(spark):
    store = RunStore(spark, work_path(spark, "store"))
    assert store.list().count() == 0
    assert store.read("none").count() == 0


def test_every_query_has_its_sql():
    found = registry()
    assert len(found) > 70 and all(sql for _, sql in found.values())
