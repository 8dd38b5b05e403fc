"""Every operator of the folder against plain Python on a small table of awkward rows."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.llm import jaccard_join, language_id, licences, line_dedup, mixing, packing, permutation_index, quality_model, quality_rules, suffix_dedup
from leafmill.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, rank int"
PROSE = "the river ran past the old mill and every evening the miller counted sacks of grain by lamplight while rain fell"
FLUSS = "der fluss lief an der alten mühle vorbei und jeden abend zählte der müller die säcke bei lampenlicht während es regnete"


def sentence(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefgiklmnoprstuw"), rng.integers(2, 8))) for _ in range(n))


def corpus() -> list[tuple]:
    base = sentence(1, 120)
    words = base.split()
    texts = [
        None, "", "   \n\t ", "One.", "one.", base, base, base + " tail", " ".join(words[:60] + ["changed"] + words[61:]), base.upper(),
        PROSE, FLUSS, PROSE + "\n" + FLUSS, "A line that is long enough to count\nAnother line of the same length\nA line that is long enough to count",
        "A line that is long enough to kount\nshort\nshort", "A line that is long enough to coun\n\n", "é" * 30 + "\n" + "é" * 29 + "è", "### $$$ " * 40, "SHOUT!! " * 80,
        "12345 67890 " * 60, "x" * 5000, sentence(2, 6000), "Hello.\nReleased under the MIT License.\nBye", "Licensed under the Apache License, Version 2.0. Licensed under CC BY-NC 4.0.",
        "日本語 のテキスト 😀 <|endoftext|> don't \x1c we'll \x85 \x00", base[:150] + sentence(3, 20), sentence(4, 30) + base[100:500] + sentence(5, 30),
    ]
    rows = [(i, t, ("de" if t and "ü" in t else "en") if i % 5 else None, f"s{i % 3}" if i % 4 else None, 0, 7, 1.5, 3) for i, t in enumerate(texts)]
    rows += [rows[5], rows[21], (None, base, None, None, None, None, None, None), (5, "other text of the same id with some more words in it", "en", "s0", 1, 1, 1.0, 1)]
    rows += [(100 + i, f"{sentence(50 + i, 70)}\n{PROSE}", "en", "hot", 0, 0, 0.0, 0) for i in range(40)]
    rows += [(200 + i, f"{sentence(90 + i, 70)}\n{FLUSS} {sentence(190 + i, 9)}", "de", "hot", 0, 0, 0.0, 0) for i in range(20)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("llm") / "docs.parquet")
    spark.createDataFrame(corpus(), SCHEMA).repartition(4).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs():
    return [(r[0], r[1]) for r in corpus()]


def test_mixing_meets_targets(docs, empty):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(corpus())
    by_source = collections.defaultdict(list)
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by_source[r["source"]].append(r)
    order = sorted(by_source, key=lambda s: (s is None, s))
    sizes = {s: sum(r["size"] for r in by_source[s]) for s in order}
    weights = {s: i % 3 + 1 for i, s in enumerate(order)}
    # plain resharing, round after round
    targets, left, free = {}, float(sum(sizes.values())), set(order)
    while free:
        level = left / sum(weights[s] for s in free)
        full = {s for s in free if 3 * sizes[s] < level * weights[s]}
        for s in full or free:
            targets[s] = 3.0 * sizes[s] if full else level * weights[s]
        left -= sum(targets[s] for s in full)
        free = free - full if full else set()
    for s, group in by_source.items():
        assert group[0]["source_size"] == sizes[s]
        assert group[0]["target"] == pytest.approx(targets[s])
        assert abs(sum(r["taken"] for r in group) - targets[s]) <= 1 + 1e-6 * targets[s]
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert mixing.mix(empty).count() == 0
    assert sum(r["taken"] for r in mixing.mix(docs, budget_share=0.5).collect()) <= 0.5 * sum(sizes.values())
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_quality_rules_count_and_keep(docs, empty):
    got = collections.Counter(tuple(r) for r in quality_rules.judge(docs).collect())
    want = collections.Counter()
    for doc_id, text in pairs():
        w = WORD.findall(text or "")
        grams = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {i + k for i, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if grams[g] > 1 for k in range(3)}
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        failed = len(w) < 50 or 2 * len(covered) > len(w)
        junk = text is not None and (text.isupper() or "#" in text)
        want[doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed, not failed and not junk] += 1
    assert got == want
    assert quality_rules.judge(empty).count() == 0


def test_cascade_order_changes_nothing():
    texts = quality_rules.Texts.of(__import__("pyarrow").array([t for _, t in pairs()]))
    alive = np.ones(texts.n, bool)
    names = list(quality_rules.RULES)
    want = alive.copy()
    for name in names:
        want &= ~quality_rules.RULES[name](texts)
    for order in (names, names[::-1]):
        assert (quality_rules.cascade(texts, alive, order, quality_rules.RULES) == want).all()


def within_one(a: str, b: str) -> bool:
    if a == b:
        return True
    a, b = sorted((a, b), key=len)
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return len(b) - len(a) <= 1 and (a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :])


def test_lines_match_plain_comparison(docs, empty):
    unique = [(i, t) for i, t in dict.fromkeys(pairs()) if i != 5 and i is not None]
    rows = docs.where("doc_id <> 5").select("doc_id", "text", "size")
    got = {r["doc_id"]: (r["text"], r["removed"], r["size"]) for r in line_dedup.dedup_lines(rows).collect()}
    seen = []
    for doc_id, text in sorted(unique, key=lambda x: x[0]):
        removed = []
        for pos, line in enumerate((text or "").split("\n")):
            if len(line) >= line_dedup.MIN_CHARS:
                if any(within_one(line, other) for other in seen):
                    removed.append(pos)
                seen.append(line)
        left = text if not removed else "\n".join(x for p, x in enumerate(text.split("\n")) if p not in removed)
        assert got[doc_id][:2] == (left, removed), doc_id
    assert line_dedup.dedup_lines(docs).count() == len(corpus())
    assert line_dedup.dedup_lines(empty).count() == 0


def test_automaton_reads_substrings_only():
    text = [1, 2, 1, 1, 2, 3, 1, 2]
    moves = language_id.suffix_automaton(text)
    for a in range(len(text)):
        state = 0
        for s in text[a:]:
            state = moves[state][s]
    state = moves[moves[0][3]][1]
    assert 3 not in moves[state]


def test_cross_parsing_counts_phrases():
    parser = language_id.CrossParser({"x": ["ab ab"], "y": ["ba"]})
    data = np.frombuffer(b"abab ba", np.uint8)
    totals, letters = parser.phrases(data, np.array([0, 7]))
    # x: ab | ab b? -> "ab", "ab ", "b", "a"; y: "a", "ba", "b", " ", "ba"
    assert letters.tolist() == [6]
    assert totals[:, 0].tolist() == [4, 5]


def test_language_of_awkward_texts(docs, empty):
    references = {"en": [PROSE], "de": [FLUSS]}
    rows = language_id.identify_languages(docs, references).collect()
    assert len(rows) == len(corpus())
    for r in rows:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters)
        assert 0 <= r["score"] <= 1
        if r["text"] in (PROSE, FLUSS):
            assert r["lang_pred"] == ("en" if r["text"] == PROSE else "de")
    assert language_id.identify_languages(empty, references).count() == 0
    assert {r["lang_pred"] for r in language_id.identify_languages(docs, {}).collect()} == {"und"}
    assert language_id.reference_texts(empty) == {}


def scripts() -> dict[str, str]:
    """Two languages of the same letters in each of three scripts; the words are what differs."""
    made = {}
    for name, low, n in (("la", 0x61, 26), ("han", 0x4E00, 1500), ("old", 0x20000, 400)):
        rng = np.random.default_rng(low)
        for k in range(2):
            vocabulary = ["".join(map(chr, low + rng.integers(0, n, 3))) for _ in range(n)]
            made[f"{name}{k}"] = [" ".join(rng.choice(vocabulary, 1500)) for _ in range(2)]
    return made


def phrases_in(reference: str, text: str) -> int:
    count = at = 0
    while at < len(text):
        end = at + 1
        while end < len(text) and text[at : end + 1] in reference:
            end += 1
        count, at = count + 1, end
    return count


@pytest.mark.parametrize("dense", [200, 0, 10_000])
def test_languages_of_large_alphabets(dense):
    texts = scripts()
    parser = language_id.CrossParser({name: t[:1] for name, t in texts.items()}, dense)
    assert parser.alphabet.size > 1800
    tested = [(name, t[1][:400]) for name, t in texts.items()]
    data = "".join(t for _, t in tested).encode()
    offsets = np.cumsum([0, *(len(t.encode()) for _, t in tested)])
    totals, _ = parser.phrases(np.frombuffer(data, np.uint8), offsets)
    assert totals.tolist() == [[phrases_in(texts[name][0], t) for _, t in tested] for name in parser.languages]
    names, _ = parser.identify(np.frombuffer(data, np.uint8), offsets)
    assert names == [name for name, _ in tested]


def test_references_of_long_texts_only(spark):
    table = spark.createDataFrame([(i, (PROSE + " ") * 300, "en") for i in range(6)] + [(9, None, "en")], "doc_id long, text string, lang string")
    texts = language_id.reference_texts(table)["en"]
    assert texts and all(t == ((PROSE + " ") * 300)[: language_id.REFERENCE_DOC_CHARS] for t in texts)
    parser = language_id.CrossParser({"en": ["ab " * 20_000], "de": ["ba " * 10_000]})
    assert parser.bits[0] == parser.bits[1]


def test_packing_round_trip(docs, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    rows = packing.pack_documents(docs, tokenizer_path(), sequence=512).collect()
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append(r)
    for group in sequences.values():
        at = 0
        for r in sorted(group, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 512
    got = collections.Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows)
    want = collections.Counter()
    for doc_id, text in pairs():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        for at in range(0, len(ids), 512):
            piece = ids[at : at + 512]
            want[doc_id, at, len(piece), zlib.crc32(piece.tobytes()), len(ids)] += 1
    assert got == want
    assert packing.pack_documents(empty, tokenizer_path()).count() == 0


def test_patterns_meet_demand():
    demand = {3: 50, 5: 31, 7: 12, 16: 4}
    made = collections.Counter()
    used = 0
    for pattern, times in packing.cutting_patterns(demand, 16):
        assert sum(s * k for s, k in pattern.items()) <= 16
        used += times
        for s, k in pattern.items():
            made[s] += k * times
    assert made == demand
    assert used <= 1.1 * sum(s * n for s, n in demand.items()) / 16 + 4


@pytest.mark.parametrize("contexts", [4096, 1])
def test_suffixes_match_counted_windows(docs, empty, contexts):
    width = 200
    count = collections.Counter()
    for _, text in pairs():
        data = (text or "").encode()
        count.update(data[i : i + width] for i in range(len(data) - width + 1))
    want = collections.Counter()
    for doc_id, text in pairs():
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - width + 1):
            if count[data[i : i + width]] > 1:
                gone[i : i + width] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want[doc_id, bytes(np.frombuffer(data, np.uint8)[~gone]), len(data), int(gone.sum()), spans] += 1
    rows = suffix_dedup.dedup_substrings(docs, anchor_contexts=contexts).collect()
    assert collections.Counter((r["doc_id"], bytes(r["kept"]), r["n_bytes"], r["n_removed"], r["n_spans"]) for r in rows) == want
    assert suffix_dedup.dedup_substrings(empty).count() == 0


def test_two_stage_order_is_the_suffix_order():
    rng = np.random.default_rng(0)
    x = np.append(rng.integers(1, 4, 400), 0).astype(np.uint8)
    order = suffix_dedup.two_stage_order(x, np.array([len(x) - 1]), np.array([0]), 408)
    assert order.tolist() == sorted(range(len(x)), key=lambda i: x[i:].tobytes())


@pytest.mark.parametrize("bucket", [256, 2])
def test_jaccard_join_matches_all_pairs(docs, empty, bucket):
    rows = [(i, frozenset(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))) if (w := WORD.findall((t or "").lower())) else None) for i, t in pairs()]
    n = len(rows)
    links = [[j for j in range(n) if j != i and rows[i][1] and rows[j][1] and len(rows[i][1] & rows[j][1]) >= 0.8 * len(rows[i][1] | rows[j][1])] for i in range(n)]
    root = list(range(n))
    for _ in range(n):
        root = [min([root[i], *[root[j] for j in links[i]]]) for i in range(n)]
    ids = {r: min((rows[i][0] for i in range(n) if root[i] == r and rows[i][0] is not None), default=None) for r in root}
    want = collections.Counter((rows[i][0], ids[root[i]], len(links[i])) for i in range(n))
    got = collections.Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard_join.join_documents(docs, bucket_sets=bucket).collect())
    assert got == want
    assert jaccard_join.join_documents(empty).count() == 0


def test_one_document_of_each_class_stays(docs):
    left = jaccard_join.one_of_each(docs)
    assert left.columns == docs.columns
    joined = jaccard_join.join_documents(left).collect()
    assert all(r["n_links"] == 0 for r in joined)
    classes = {(r["class_id"]) for r in jaccard_join.join_documents(docs).where("n_links > 0").collect()}
    assert len(classes & {r["doc_id"] for r in joined}) == len(classes)


def test_pairs_meet_at_the_greatest_depth():
    rng = np.random.default_rng(11)
    runs, met, pairs_made = jaccard_join.runs_for(0.9999), 0, 400
    seeds = jaccard_join._seeds(100)
    for _ in range(pairs_made):
        large = rng.integers(0, 1 << 63, 50).astype(np.uint64)
        for seed in seeds:
            ends = [{int(seed)}, {int(seed)}]
            for _ in range(jaccard_join.MAX_DEPTH):
                ends = [{int(p) for e in both for p in jaccard_join.next_paths(tokens, np.uint64(e), 0.8)} for tokens, both in zip((large, large[:40]), ends, strict=True)]
                ends = [ends[0] & ends[1]] * 2
            met += bool(ends[0])
    share = met / (pairs_made * len(seeds))
    assert (1 - share) ** runs <= 1.5e-4


def test_small_class_within_a_large_template(spark):
    template = sentence(400, 44)
    rows = [(i, f"{template} {sentence(500 + i, 30)}") for i in range(60)]
    rows += [(1000 + i, template + (" " + sentence(401, 10) if i else "")) for i in range(2)]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join.join_documents(spark.createDataFrame(rows, "doc_id long, text string"), bucket_sets=1).collect()}
    assert got == {i: (i, 0) for i in range(60)} | {1000: (1000, 1), 1001: (1000, 1)}


def without_near_copies(rows: list[tuple]) -> collections.Counter:
    """The rows (doc_id, text) that stay, by comparison of all pairs; texts without case."""
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))) if (w := WORD.findall((t or "").lower())) else None for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and root[i] != root[j]:
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    groups = collections.defaultdict(list)
    for (doc_id, text), r in zip(rows, root, strict=True):
        key = hashlib.md5(f"{'' if doc_id is None else doc_id} {(text or '').lower()}".encode()).digest()
        groups[r].append(((doc_id is None, doc_id or 0, key), doc_id, text))
    return collections.Counter(min(g)[1:] if len(g) > 1 else g[0][1:] for g in groups.values())


def test_classes_of_null_and_repeated_ids_keep_one_each(spark):
    rows = [(None, f"{sentence(300 + k, 80)}{end}") for k in range(6) for end in ("", " tail", " other")]
    rows += [(7, f"{sentence(320 + k, 80)}{end}") for k in range(3) for end in ("", " tail")]
    rows += [(8, sentence(320, 80) + " more"), (None, sentence(321, 80) + " more"), (None, None), (None, ""), (None, sentence(330, 50)), (7, sentence(331, 50))]
    left = jaccard_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert collections.Counter((r["doc_id"], r["text"]) for r in left.collect()) == without_near_copies(rows)


def test_rows_of_the_first_and_third_stage(spark, docs, tmp_path):
    import corpus_pipeline

    lower = lambda rows: collections.Counter((i, (t or "").lower()) for i, t in rows)
    first = corpus_pipeline.identify_language(spark, docs, str(tmp_path))
    got = [(r["doc_id"], r["text"]) for r in first.collect()]
    assert collections.Counter(got) == collections.Counter((i, t) for i, t in pairs() if any(c.isalpha() for c in t or ""))
    third = corpus_pipeline.drop_near_copies(spark, first, str(tmp_path))
    assert lower((r["doc_id"], r["text"]) for r in third.collect()) == lower(without_near_copies(got).elements())


def test_quality_model(docs, empty, spark):
    labels = spark.createDataFrame([(r[0], 0 if r[1] and (r[1].isupper() or "#" in r[1]) else 1, 5) for r in corpus() if r[0] is not None] + [(None, 1, 1), (1, None, 1)], "doc_id long, quality int, text int")
    rows = quality_model.classify(docs, labels).collect()
    assert len(rows) == len(corpus())
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"] if r["doc_id"] is not None else "").encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    assert quality_model.classify(empty, labels).count() == 0
    assert {r["score"] for r in quality_model.classify(docs, labels.limit(0)).collect()} == {0.5}


def test_quality_model_separates_held_out(spark):
    rows = [(i, sentence(i, 80) if i % 3 else sentence(i, 80).replace(" ", "### "), int(i % 3 > 0)) for i in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    scored = quality_model.classify(table.select("doc_id", "text"), table.select("doc_id", "quality")).where("held_out").collect()
    right = sum(r["predicted"] == int(r["doc_id"] % 3 > 0) for r in scored)
    assert right >= 0.95 * len(scored)


def test_licences(docs, empty):
    found = {r["doc_id"]: (r["licences"], r["n_matches"]) for r in licences.scan(docs).where("n_matches > 0").collect()}
    assert found == {22: ("MIT", 1), 23: ("Apache-2.0,CC-BY-NC-4.0", 2)}
    assert licences.scan(docs).count() == len(corpus())
    assert licences.scan(empty).count() == 0


def test_licence_rules_take_their_sentences_in_order(spark):
    mit = "Permission is hereby granted" + licences.SENTENCES[3][len("permission is hereby granted") :] + ".\n" + licences.SENTENCES[4] + ". "
    rows = [(1, mit), (2, licences.SENTENCES[4] + ". " + licences.SENTENCES[3] + "."), (3, mit + "X. " + mit)]
    got = {r["doc_id"]: (r["licences"], r["n_matches"]) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("MIT", 1), 2: ("", 0), 3: ("MIT", 2)}


def test_every_known_sentence_is_found_as_a_text_of_its_own(spark):
    rows = [(i, s.capitalize() + end) for i, s in licences.SENTENCES.items() for end in ("", ".", ".\nBye")]
    rows += [(26, "All rights reserved."), (26, "All rights reserved. Copyright 2020 A.")]
    got = licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    assert all(str(r["doc_id"]) in r["sentence_ids"].split() or r["n_matches"] == 0 for r in got)
    alone = {ids[0]: name for name, _, ids in licences.RULES if len(ids) == 1}
    assert all(r["licences"] == alone.get(r["doc_id"], "") for r in got)
    assert alone[26] == "proprietary"


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
THIRD = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""


def test_published_licences_in_their_lines(spark):
    texts = {"MIT": MIT, "BSD-2-Clause": BSD, "BSD-3-Clause": BSD + THIRD, "GPL-3.0": GPL, "Apache-2.0": APACHE, "MPL-2.0": MPL}
    shapes = [lambda t: t, lambda t: "Copyright (c) 2020 A\n\n" + t + "\nTHE SOFTWARE IS PROVIDED", lambda t: " ".join(t.split()), lambda t: t.replace("\n", "\r\n")]
    shapes += [lambda t, mark=mark: "".join(f"{mark}{line}\n" for line in t.split("\n")) for mark in ("# ", " * ", "// ", ";; ", "-- ", "   ")]
    shapes += [lambda t: t.replace("1. ", "a) ").replace("2. R", "(b) R"), lambda t: t.replace("1. ", "* ").replace("2. R", "- R")]
    rows = [(k, name, shape(text)) for name, text in texts.items() for k, shape in enumerate(shapes)]
    got = [(r["doc_id"], r["licences"], r["n_matches"]) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, name string, text string").drop("name")).collect()]
    assert collections.Counter(got) == collections.Counter((k, name, 1) for k, name, _ in rows)


def test_line_ends_still_end_sentences(spark):
    rows = [(1, "Notes\nReleased under the MIT License\nmore notes"), (2, "It is not\nreleased under the MIT license of old"), (3, "under the GNU General Public License, version\n3. This work is licensed under the GNU General Public License, version\n3. Bye")]
    got = {r["doc_id"]: (r["sentence_ids"], r["licences"]) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("0  1  0", "MIT"), 2: ("", ""), 3: ("0  10  0", "GPL-3.0")}


def test_permutation_index(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(400, 16))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(1000 + i, rows[7][1]) for i in range(200)] + [(2000, None), (2050, [0.0] * 16), (2100, [float("nan")] + [1.0] * 15), (2150, [None] + [1.0] * 15), (None, rows[3][1]), (2200, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    usable = {i: np.array(v) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    got = collections.defaultdict(list)
    for r in permutation_index.search(table).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    queries = [i for i in usable if i % 50 == 0]
    assert set(got) == set(queries)
    hits = 0
    for q in queries:
        cosine = {i: float(v @ usable[q] / np.linalg.norm(v) / np.linalg.norm(usable[q])) for i, v in usable.items() if i != q}
        best = sorted(cosine, key=lambda i: (-round(cosine[i], 12), i))[:5]
        assert len(got[q]) == 5
        assert all(abs(s - cosine[i]) < 1e-12 for i, s in got[q])
        hits += len(set(best) & {i for i, _ in got[q]})
    assert hits >= 0.9 * 5 * len(queries)
    assert permutation_index.search(table.limit(0)).count() == 0
    few = spark.createDataFrame(rows[:3] , "vec_id long, embedding array<double>")
    assert permutation_index.search(few).count() == 2


def test_pipeline_stages(spark, docs, tmp_path):
    import corpus_pipeline

    path = str(tmp_path / "documents.parquet")
    docs.write.parquet(path)
    table = spark.read.parquet(path)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = str(tmp_path / name)
        stage(spark, table, str(tmp_path)).write.parquet(out)
        table = spark.read.parquet(out)
        assert tuple(table.columns) == corpus_pipeline.COLUMNS
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == {r["doc_id"] for r in table.select("doc_id").collect()}
    assert packed.where(F.col("offset") + F.col("length") > 4096).isEmpty()
    assert hashlib.sha256(b"").hexdigest()
