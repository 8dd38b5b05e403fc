"""Importance draws, scaled sketches and conversation repair against plain Python, and rows that clash or lack ids."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.llm import conversation_repair, importance, jaccard_join, language_id, line_dedup, mixing, packing, permutation_index, quality_rules, scaled_sketch
from leafmill.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, _words string, cell int, rank int, fingerprint string, key long, bounds int"
CLASH = ("en", "w", 1, 2, "f", 3, 4)


def prose(seed: int, n: int, letters: str = "abcdefgé") -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(n))


def texts() -> list:
    base = prose(1, 80)
    return [
        None, "", " \n\t ", "One", "one TWO three four", base, base, base.upper(), base + " tail", "a-b_c'd\x00é,É ÀB 9", "日本語 のテキスト 😀 x",
        prose(2, 3000), "w" * 9000 + " x " + "w" * 9000, "\x85    q", "~{|}`@[", prose(3, 25), prose(4, 21), prose(5, 19), prose(6, 20), "😀😀😀 a b",
    ]


def table(spark, rows):
    return spark.createDataFrame([(i, t, *CLASH) for i, t in rows], DOCS)


def rows_of(df, order):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((r[i] is None, r[i]) for i in order))


# --- importance ---------------------------------------------------------------------------------

FEATURE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def feature_buckets(text, ngrams, n_buckets):
    words = FEATURE_WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    runs = [" ".join(words[i : i + n]) for n in range(1, ngrams + 1) for i in range(len(words) - n + 1)]
    return words, [zlib.crc32(r.encode()) % n_buckets for r in runs]


def drawn_by_hand(docs, targets, n_buckets, ngrams, percent):
    read = [(i, *feature_buckets(t, ngrams, n_buckets)) for i, t in docs]
    source, target = Counter(b for _, _, bs in read for b in bs), Counter(b for t in targets for b in feature_buckets(t, ngrams, n_buckets)[1])
    s_all, t_all = sum(source.values()), sum(target.values())
    gain = {b: math.floor(1000 * math.log((target[b] + 1) * (s_all + n_buckets) / ((source[b] + 1) * (t_all + n_buckets)))) for b in source}
    out = []
    for i, words, bs in read:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in bs) // len(bs) if bs else 0
        out.append([i, len(bs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    for place, row in enumerate(able[: percent * len(able) // 100], 1):
        row[4] = place
    return [tuple(r) for r in out]


@pytest.mark.parametrize(("ngrams", "n_buckets", "percent"), [(1, 10_000, 50), (3, 100_000, 100), (2, 7, 30)])
def test_importance_draw(spark, ngrams, n_buckets, percent):
    docs = list(enumerate(texts())) + [(None, None), (None, prose(9, 30)), (None, prose(9, 30)), (5, prose(7, 40)), (2**62, prose(8, 40)), (-1, prose(8, 40))]
    targets = [prose(2, 50), None, "", "one two three FOUR", prose(4, 21)]
    target = spark.createDataFrame([(t, 1) for t in targets], "text string, key int")
    got = importance.resample(table(spark, docs), target, n_buckets, ngrams, percent=percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank", "n_words"]
    want = drawn_by_hand(docs, targets, n_buckets, ngrams, percent)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_importance_ranks_are_whole_over_many_partitions(spark):
    """Ties of rows alike, a third of them with a null id, still get ranks of their own."""
    rows = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.lit(prose(1, 30)).alias("text")).repartition(13)
    got = importance.resample(rows, rows.limit(5), percent=100).select("rank", "score").collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 3001))
    assert [r["score"] for r in sorted(got)] == sorted((r["score"] for r in got), reverse=True)


def test_importance_of_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert importance.resample(empty, empty).collect() == []
    alone = importance.resample(table(spark, [(1, prose(1, 30))]), empty, percent=100).collect()
    assert [(r["rank"], r["n_features"]) for r in alone] == [(1, 30)]


def test_crc_of_joined_parts():
    rng = np.random.default_rng(5)
    zeros = importance.Zeros()
    heads = [rng.bytes(n) for n in rng.integers(0, 40, 300)]
    tails = [rng.bytes(n) for n in rng.integers(0, 5000, 300)]
    crc = lambda parts: np.array([zlib.crc32(p) for p in parts], np.uint32)
    joined = zeros.append(crc(heads), np.array([len(t) for t in tails]), crc(tails))
    assert (joined == crc([h + t for h, t in zip(heads, tails, strict=True)])).all()


# --- sketches -----------------------------------------------------------------------------------


def sketch_by_hand(text, fraction=1 / 8):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    runs = [words[i : i + 5] for i in range(max(len(words) - 4, 1))] if words else []
    halves = [(31415927, 2**31 - 1), (27182818, 2**31 - 19)]
    hashes = set()
    for run in runs:
        high, low = (sum(zlib.crc32(w.encode()) * pow(base, k + 1, 268435399) for k, w in enumerate(run)) % prime for base, prime in halves)
        hashes.add(f"{high * 2**31 + low:016x}")
    least = f"{int(fraction * (2**31 - 1)) * 2**31:016x}"
    return [h for h in sorted(hashes) if h < least] or sorted(hashes)[:1]


def alike(a, b):
    return 1.0 if not a and not b else 0.0 if not a or not b else len(set(a) & set(b)) / min(len(a), len(b))


def compared_by_hand(docs):
    order = sorted(((i, t or "") for i, t in docs), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(r[1].encode()).hexdigest()), reverse=True)
    out = []
    for n, (i, text) in enumerate(order):
        next_id, after = order[(n + 1) % len(order)]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = sketch_by_hand(text), sketch_by_hand(edited), sketch_by_hand(after)
        out.append((i, len(text), edited, "".join(a), "".join(b), alike(a, b), alike(a, c), next_id))
    return out


@pytest.mark.parametrize("partitions", [1, 8, 300])
def test_scaled_sketch(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        docs = [(7 * i - 40, t) for i, t in enumerate(texts())] + [(None, prose(20 + i, 30)) for i in range(9)] + [(9, prose(40 + i, 30)) for i in range(12)] + [(None, None), (9, None), (2**62, "last"), (-(2**62), "first")]
        got = scaled_sketch.compare_edits(table(spark, docs))
        assert got.columns == ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "next_id"]
        key = lambda r: tuple((x is None, x) for x in r)
        assert sorted(map(tuple, got.collect()), key=key) == sorted(compared_by_hand(docs), key=key)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_scaled_sketch_of_few(spark):
    assert scaled_sketch.compare_edits(spark.createDataFrame([], DOCS)).collect() == []
    for docs in ([(1, "a b c d e f")], [(None, "a b"), (None, "a b")], [(None, None)]):
        got = [tuple(r) for r in scaled_sketch.compare_edits(table(spark, docs)).collect()]
        assert sorted(got, key=str) == sorted(compared_by_hand(docs), key=str)


def test_ids_of_many_rows_are_spread_over_cells(spark):
    rows = spark.range(6000).select(F.when(F.col("id") % 3 == 0, F.lit(77)).when(F.col("id") % 3 == 1, F.col("id")).alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    sizes = [r["count"] for r in scaled_sketch.cells(rows).groupBy("cell").count().collect()]
    assert sum(sizes) == 6000 and max(sizes) < 6000 / 10
    ordered = scaled_sketch.cells(rows).orderBy(F.asc_nulls_first("doc_id"), "digest").select("cell").collect()
    assert all(a["cell"] <= b["cell"] for a, b in zip(ordered, ordered[1:], strict=False))


def test_sketches_merge_and_estimate_containment(spark):
    parts = [prose(60 + i, 4000) for i in range(4)]
    rows = spark.createDataFrame([(" ".join(parts), parts[1])], "whole string, part string")
    made = rows
    for c in ("whole", "part"):
        made = made.withColumn(f"_{c}", scaled_sketch.word_hashes(F.col(c)))
        made = made.withColumn(c, scaled_sketch.sketch(F.col(f"_{c}")))
    row = made.select(
        scaled_sketch.containment(F.col("part"), F.col("whole")).alias("inside"),
        scaled_sketch.containment(F.col("whole"), F.col("part")).alias("share"),
        scaled_sketch.merged(F.col("part"), F.col("whole")).alias("both"),
        "whole",
        "part",
    ).first()
    assert row["inside"] > 0.99 and abs(row["share"] - 0.25) < 0.03
    assert row["both"] == sorted(set(row["whole"]) | set(row["part"]))


# --- conversations ------------------------------------------------------------------------------


def cheapest(rows):
    """(cost, edits, lines) by a search over all edits; ``rows`` are (role, text, fault)."""
    heap, done = [(0, "", 0, "", ())], set()
    best = None
    while heap:
        cost, edits, at, shape, lines = heapq.heappop(heap)
        if best and cost > best[0]:
            break
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", shape) and (best is None or (cost, edits) < best[:2]):
            best = (cost, edits, lines)
        if (at, shape, edits) in done:
            continue
        done.add((at, shape, edits))
        moves = [(2, "I", at, r[0], f"{r}:") for r in ("user", "assistant")]
        if at < len(rows):
            role, text, fault = rows[at]
            moves.append((3, "D", at + 1, "", None))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                moves += [(more, "K", at + 1, role[:1] or "?", f"{role}:{text}")] + [(2 + more, "R", at + 1, r[0], f"{r}:{text}") for r in ("user", "assistant")]
        for price, edit, to, initial, line in moves:
            after = shape + initial
            if re.fullmatch("s?(ua)*u?", after):
                heapq.heappush(heap, (cost + price, edits + edit, to, after, lines + ((line,) if line is not None else ())))
    return best


def judged(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.rstrip(" \t\n\x0b\f\r")
        out.append((role, text, "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "sound"))
        seen.add((role, text))
    return out


def audited_by_hand(conversation):
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in conversation), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    turns = [t for t, _, _ in rows if t is not None]
    faults = judged([(r, x) for _, r, x in rows])
    cost, edits, lines = cheapest(faults)
    kinds = Counter(f for _, _, f in faults)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, kinds["blank"], kinds["duplicate"], kinds["truncated"], illegal, cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def conversations(n, longest, seed=0):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(n)]:
        for turn in range(rng.randint(1, longest)):
            turn = None if rng.random() < 0.1 else turn * rng.choice([1, 1, 1, 2])
            role = rng.choice(["user", "assistant", "user", "assistant", "system", None, "", "tool", "unknown"])
            text = rng.choice(["Yes.", "No!", "Why? \n", "cut off", "", " \t", None, "Yes.", "long " * 20 + ".", " ", "é"])
            rows.append((conv, turn, role, text))
    return rows


ROWS = "conv_id long, turn int, role string, text string"
EXTRA = "lang string, present string, at int, conv int, seen int, forward string, fault string"


def test_conversation_repair(spark):
    rows = conversations(150, 6)
    df = spark.createDataFrame([(*r, "x", "no", 1, 2, 3, "f", "g") for r in rows], f"{ROWS}, {EXTRA}")
    got = {r[0]: tuple(r)[1:] for r in conversation_repair.audit_conversations(df, spill_bytes=2).collect()}
    by_id = {}
    for conv, *row in rows:
        by_id.setdefault(conv, []).append(row)
    assert got.keys() == by_id.keys()
    for conv, conversation in by_id.items():
        assert got[conv] == audited_by_hand(conversation), conversation


def test_repaired_rows_are_those_of_the_audit(spark):
    df = spark.createDataFrame(conversations(60, 6, seed=4), ROWS)
    audits = {r["conv_id"]: r for r in conversation_repair.audit_conversations(df).collect()}
    edits = {}
    for r in conversation_repair.repaired_rows(df).orderBy("nth").collect():
        edits.setdefault(r["conv_id"], []).append(r)
    for conv, report in audits.items():
        rows = edits.get(conv, [])
        assert [r["nth"] for r in rows] == list(range(len(rows)))
        assert "".join(r["edit"] for r in rows) == report["audit"]
        lines = "\n".join(f"{r['role']}:{r['text']}" for r in rows if r["edit"] != "D")
        assert hashlib.sha256(lines.encode()).hexdigest() == report["repaired_sha256"]


def test_a_giant_conversation_streams_through_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        rows = spark.range(3001).select(F.lit("giant").alias("conv_id"), (F.col("id") * 2).alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), "id", F.lit(".")).alias("text"))
        got = conversation_repair.audit_conversations(rows, spill_bytes=64).collect()
        kept = [f"{'user' if i % 2 == 0 else 'assistant'}:t{i}." for i in range(3001)] + ["assistant:"]
        assert [tuple(r)[:-1] for r in got] == [("giant", 3000, 0, 0, 0, 0, 2, "K" * 3001 + "I")]
        assert got[0]["repaired_sha256"] == hashlib.sha256("\n".join(kept).encode()).hexdigest()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_conversations_that_lose_all_rows(spark):
    rows = spark.createDataFrame(conversations(400, 3, seed=9), ROWS)
    broken = conversation_repair.damaged(rows)
    got = {r[0]: tuple(r)[1:] for r in conversation_repair.audit_conversations(broken, F.col("present")).collect()}
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    want = {}
    for conv, turn, role, text in rows.collect():
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        want.setdefault(conv, []).extend([(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1))
    assert any(not v for v in want.values())
    assert got == {conv: audited_by_hand(v) if v else nothing for conv, v in want.items()}
    assert conversation_repair.audit_conversations(rows.limit(0)).collect() == []


def test_backpointers_come_back_in_reverse():
    stack = conversation_repair.Backpointers(3)
    for i in range(250):
        stack.push(i)
    assert [stack.pop() for _ in range(100)] == list(range(249, 149, -1))
    stack.push(7)
    assert [stack.pop() for _ in range(151)] == [7, *range(149, -1, -1)]
    stack.close()


def test_a_slice_makes_its_own_dictionary():
    found = importance.Dictionary([b"a", b"ab", b"b" * 5000])
    ends, words = found.scan(f" a ab  {'b' * 5000} a ")
    assert words.tolist() == [0, 1, 2, 0] and ends.tolist() == [2, 5, 5007, 5009]
    data, offsets = np.frombuffer("A b\nÀ".encode(), np.uint8), np.array([0, 3, 3, 6])
    assert importance.bucket_rows(data, offsets, 1 << 32, 2, importance.Zeros())[1].tolist() == [3, 0, 1]


# --- names that clash, ids that are missing ------------------------------------------------------

CLASHING = "_id string, _hash string, _key string, row_key string, _lk string, _size string, _words string, _copy string, words string, times string, copy string, `a.b` string, found string, _found string"


def clashing(spark, rows):
    extra = CLASHING.split(", ")
    return spark.createDataFrame([(*r, *(f"{c}{r[0]}" for c in extra)) for r in rows], f"doc_id long, text string, source string, {CLASHING}")


def test_columns_that_clash_pass_through(spark):
    line = prose(80, 12)
    docs = clashing(spark, [(1, f"{line}\n{prose(81, 12)}", "a"), (2, f"{prose(82, 12)}\n{line}", "b"), (3, prose(83, 40), "a"), (4, prose(83, 40), "a")])
    extra = [c.strip("`") for c in (x.split()[0] for x in CLASHING.split(", "))]
    for result in (line_dedup.dedup_lines(docs), jaccard_join.one_of_each(docs), mixing.mixed_documents(docs), language_id.identify_languages(docs, {"x": [prose(80, 300)]})):
        rows = result.collect()
        assert rows and set(docs.columns) <= set(result.columns)
        for r in rows:
            assert all(r[c].endswith(str(r["doc_id"])) and r[c].startswith(c[:2] if "." not in c else "`a.b`") for c in extra)
    assert {r["doc_id"] for r in jaccard_join.one_of_each(docs).collect()} == {1, 2, 3}
    pieces = spark.createDataFrame([(1, 0, 30, "s", "c"), (2, 0, 50, "s", "c")], "doc_id long, start long, length long, _size string, _cell string")
    assert {(r["_size"], r["_cell"]) for r in packing.pack(pieces).collect()} == {("s", "c")}


def test_a_mix_of_documents_without_ids(spark):
    """The cut decides: words are taken up to the budget, whatever ids are missing."""
    rows = [(None if i % 3 == 0 else i, " ".join(["w"] * (i % 40)), f"s{i % 4}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    words = sum(i % 40 for i in range(600))
    for share in (0.0, 0.25, 1.0, 1e9):
        taken = mixing.mix(docs, budget_share=share).agg(F.sum("taken")).first()[0]
        assert taken == min(int(share * words), 3 * words)
    sums = {r["source"]: r for r in mixing.mix(docs, [1, 2]).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()}
    assert all(abs(r["taken"] - r["target"]) <= 1 for r in sums.values())
    again = [sorted(map(str, mixing.mix(docs.repartition(n)).collect())) for n in (2, 7)]
    assert again[0] == again[1]


def test_languages_of_texts_beyond_a_window(spark):
    """Phrases of a text of several windows, against a search for the longest matches of each window."""
    references = {"a": [prose(90, 400, "abcde ")], "b": [prose(91, 400, "defgh ")]}
    parser = language_id.CrossParser(references)
    text = prose(92, 900, "abcdefgh")
    symbols = re.sub(r"[^a-z]+", " ", text).lstrip()
    data = np.frombuffer(text.encode(), np.uint8)
    totals, _ = parser.phrases(data, np.array([0, len(data)]))
    for n, name in enumerate(sorted(references)):
        reference = re.sub(r"[^a-z]+", " ", references[name][0]).lstrip()[: language_id.REFERENCE_SYMBOLS]
        known = set(reference)
        count = 0
        for at in range(0, len(symbols), language_id.WINDOW_SYMBOLS):
            phrase = ""
            for c in symbols[at : at + language_id.WINDOW_SYMBOLS]:
                if phrase and phrase + c in reference:
                    phrase += c
                else:
                    count += 1
                    phrase = c if c in known else ""
        assert totals[n, 0] == count
    docs = spark.createDataFrame([(1, text), (2, "defg " * 700), (3, None), (4, "12 .")], "doc_id long, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify_languages(docs, references).collect()}
    assert got[2] == "b" and got[3] == got[4] == "und"


def test_the_language_stage_corrects_labels_and_rejects_texts_without_letters(spark):
    import corpus_pipeline

    rows = [(i, prose(100 + i, 60, "abcde" if i % 2 else "vwxyz"), "odd" if i % 2 else "even", "s", 9) for i in range(40)]
    # held out, so it's no reference itself
    wrong = next(i for i in range(200, 300) if zlib.crc32(str(i).encode()) % 3 == 1)
    rows += [(wrong, prose(300, 60, "abcde"), "even", "s", 9), (101, prose(301, 60, "vwxyz"), None, "s", 9), (102, "123 ...", "odd", "s", 9), (103, None, "odd", "s", 9), (104, "k", "odd", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["lang"] for r in corpus_pipeline.identify_language(spark, docs, "").collect()}
    assert got == {i: lang for i, _, lang, _, _ in rows[:40]} | {wrong: "odd", 101: "even", 104: "odd"}


@pytest.mark.parametrize("max_bytes", [0, 1 << 30])
def test_chunks_are_forgotten_and_learnt_again(max_bytes):
    cache = packing.ChunkIds(tokenizer_path(), max_bytes)
    for part in [texts(), ["Don't 日本語\u00a0x\u2003y \x1cz É\u0301 <|endoftext|>a", "", prose(7, 200)], texts()]:
        part = [t or "" for t in part]
        raw = [t.encode() for t in part]
        ids, counts = cache.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        want = [cache.tokenizer.encode(t, add_special_tokens=False).ids for t in part]
        assert counts.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])


def test_letters_of_all_scripts_count(spark):
    words = {"ru": "река текла мимо старой мельницы и каждый вечер мельник считал мешки зерна".split(), "el": "ο ποταμός κυλούσε δίπλα στον παλιό μύλο και κάθε βράδυ".split(), "zh": "河流 经过 旧 磨坊 每 天 晚上 磨坊主 数 粮食 袋子".split(), "deseret": ["𐐨𐐩𐐪", "𐐫𐐬", "𐐭𐐮𐐯", "𐐰𐐱", "𐐲𐐳𐐴", "𐐵𐐶", "𐐷𐐸𐐹", "𐐺𐐻𐐼𐐽", "𐐾𐐿", "𐑀𐑁𐑂"]}
    rows = []
    for name, own in words.items():
        rng = random.Random(name)
        prose = "\n".join(" ".join("".join(rng.sample(own, 2)) for _ in range(12)) for _ in range(10))
        rows += [(f"{name} plain", prose), (f"{name} IT", f"{prose} IT"), (f"{name} loud", prose.upper()), (f"{name} digits", prose + " " + "٣٤٥٦" * len(prose))]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    kept = {rows[r["doc_id"]][0]: r["kept"] for r in quality_rules.judge(df).collect()}
    for name in words:
        assert kept[f"{name} plain"] and kept[f"{name} IT"]
        assert kept[f"{name} loud"] == (name == "zh")
        assert not kept[f"{name} digits"]


def test_neighbours_of_extreme_vectors_and_other_lengths(spark):
    rows = [(0, [1e200, 1e200]), (1, [1.0, 1.0]), (2, [1e-200, 0.0]), (3, [5e-324, 5e-324]), (4, [-1.0, 0.0]), (50, [1e-200, 0.0]), (100, [1.0, 2.0, 3.0]), (101, [2.0, 4.0, 6.5]), (150, [7.0])]
    rows += [(0, [1e200, 1e200]), (200, [-1e308, 1e308])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, v string, ids int")
    got = {}
    for r in permutation_index.search(df).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], round(r["score"], 9)))
    half = round(math.sqrt(0.5), 9)
    assert got[0] == [(1, 1.0), (3, 1.0), (2, half), (50, half), (200, 0.0)]
    assert got[50] == [(2, 1.0), (0, half), (0, half), (1, half), (3, half)]
    assert got[100][0][0] == 101 and len(got[100]) == 1 and 150 not in got
    assert got[200] == [(4, half), (0, 0.0), (0, 0.0), (1, 0.0), (3, 0.0)]


def test_recall_with_a_tenth_compared(spark):
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(3000, 64))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    got = {}
    for r in permutation_index.search(df).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = sum(len(got[q] & set(np.argsort(-(unit @ unit[q]))[1:6].tolist())) for q in range(0, 3000, 50))
    assert permutation_index.RERANK_SHARE == 0.1 and hits >= 0.95 * 5 * 60
