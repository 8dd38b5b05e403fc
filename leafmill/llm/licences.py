"""Licence scans by sentence identifiers and ordered sentence rules."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let

# Normalised sentences of public licence texts and notices, by identifier.
SENTENCES = {
    1: "released under the mit license",
    2: "licensed under the mit license",
    3: "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    4: "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    5: "licensed under the apache license version 2 0",
    6: "licensed under the apache license version 2 0 the license",
    7: "you may not use this file except in compliance with the license",
    8: "you may obtain a copy of the license at",
    9: "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    10: "this work is licensed under the gnu general public license version 3",
    11: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    12: "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    13: "see the gnu general public license for more details",
    14: "licensed under cc by nc 4 0",
    15: "licensed under cc by 4 0",
    16: "licensed under cc by sa 4 0",
    17: "this work is licensed under a creative commons attribution 4 0 international license",
    18: "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    19: "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    20: "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    21: "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    22: "this source code form is subject to the terms of the mozilla public license v 2 0",
    23: "this is free and unencumbered software released into the public domain",
    24: "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    25: "all rights reserved copyright",
    26: "all rights reserved",
    27: "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    28: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    29: "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    30: "see the gnu affero general public license for more details",
    31: "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    32: "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    33: "see the gnu lesser general public license for more details",
    34: "this software is provided as is without any express or implied warranty",
    35: "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    36: "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    37: "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    38: "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    39: "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license",
    40: "this work is licensed under a creative commons attribution noderivatives 4 0 international license",
    41: "this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license",
    42: "this project is licensed under the mit license",
    43: "this project is licensed under the apache license version 2 0",
    44: "this work is licensed under the gnu general public license version 2",
    45: "distributed under the boost software license version 1 0",
}
# Licence, class, identifiers in their order. Earlier rules win their sentences.
RULES = [
    ("BSD-3-Clause", "permissive", (19, 20, 21, 27)),
    ("MIT", "permissive", (3, 4)),
    ("Apache-2.0", "permissive", (6, 7, 8)),
    ("Apache-2.0", "permissive", (5, 7, 8)),
    ("GPL-3.0", "copyleft", (11, 12, 13)),
    ("GPL-2.0", "copyleft", (28, 12, 13)),
    ("AGPL-3.0", "copyleft", (29, 12, 30)),
    ("LGPL-2.1", "copyleft", (31, 32, 33)),
    ("BSD-2-Clause", "permissive", (19, 20, 21)),
    ("MIT", "permissive", (1,)),
    ("MIT", "permissive", (2,)),
    ("Apache-2.0", "permissive", (5,)),
    ("Apache-2.0", "permissive", (6,)),
    ("GPL-3.0", "copyleft", (10,)),
    ("GPL-3.0", "copyleft", (11,)),
    ("CC-BY-NC-4.0", "noncommercial", (14,)),
    ("CC-BY-4.0", "permissive", (15,)),
    ("CC-BY-SA-4.0", "copyleft", (16,)),
    ("CC-BY-4.0", "permissive", (17,)),
    ("CC-BY-NC-4.0", "noncommercial", (18,)),
    ("MPL-2.0", "copyleft", (22,)),
    ("Unlicense", "permissive", (23,)),
    ("ISC", "permissive", (24,)),
    ("proprietary", "proprietary", (25,)),
    ("proprietary", "proprietary", (26,)),
    ("GPL-2.0", "copyleft", (28,)),
    ("AGPL-3.0", "copyleft", (29,)),
    ("LGPL-2.1", "copyleft", (31,)),
    ("Zlib", "permissive", (35,)),
    ("BSL-1.0", "permissive", (36,)),
    ("0BSD", "permissive", (37,)),
    ("CC-BY-SA-4.0", "copyleft", (38,)),
    ("CC-BY-NC-SA-4.0", "noncommercial", (39,)),
    ("CC-BY-ND-4.0", "noderivatives", (40,)),
    ("CC-BY-NC-ND-4.0", "noncommercial", (41,)),
    ("MIT", "permissive", (42,)),
    ("Apache-2.0", "permissive", (43,)),
    ("GPL-2.0", "copyleft", (44,)),
    ("BSL-1.0", "permissive", (45,)),
]
# Every rule has a sentence that holds one of these, so texts without any need no sentence work.
ANCHORS = ("licen", "copyright", "permi", "redistrib", "software", "warrant", "reserved")

# Marks in a text that is being cut: the end of a paragraph, of a sentence, of a line within a sentence.
_PARAGRAPH, _SENTENCE, _LINE = "\x01", "\x02", "\x03"
_NUMBER = r"(\p{N}{1,2}|[a-z]|[ivx]{1,4})"
_BLANK = r"[ \t\n\f\x0B]"
_INSIDE = rf"[^\p{{L}}\p{{N}} \t\n\f\x0B{_PARAGRAPH}{_SENTENCE}]*"
# (pattern, replacement) in their order, for Spark and for the SQL counterpart. A sentence ends with its
# paragraph, after a word with . ! ? ; before white space, and after one with : where no small letter follows. A list number
# in brackets ends like one with a full stop; "v. 2" is no end.
CUTS = [
    (f"[{_PARAGRAPH}{_SENTENCE}{_LINE}]", " "),
    (r"\r\n?", "\n"),
    (r"([^\p{L}\p{N}]\p{L})\.[ \t\n]+(\p{N})", r"\1 \2"),
    (r"\n([^\p{L}\p{N}\n]*\n)+", _PARAGRAPH),
    (rf"(^|[\n{_PARAGRAPH}]|[.!?;:][ \t])([^\p{{L}}\p{{N}}\n]*)\(?{_NUMBER}\)([ \t\n])", rf"\1\2{_SENTENCE}\4"),
    (rf"([\p{{L}}\p{{N}}]{_INSIDE}[.!?;]{_INSIDE}){_BLANK}+", rf"\1{_SENTENCE}"),
    (rf"([\p{{L}}\p{{N}}]{_INSIDE}:){_BLANK}+([^\p{{Ll}}])", rf"\1{_SENTENCE}\2"),
    (r"\n", _LINE),
    (rf"[^\p{{L}}\p{{N}}{_PARAGRAPH}{_SENTENCE}{_LINE}]+", " "),
]


def sentences(text: Column) -> Column:
    """The sentences of a text, each as the array of its lines: lower-case letters and digits, one blank
    between words. Lines without a word are left out."""
    for pattern, by in CUTS:
        text = F.regexp_replace(text, pattern, re.sub(r"\\(\d)", r"$\1", by))
    lines = lambda s: F.filter(F.transform(F.split(s, _LINE), lambda x: F.trim(x)), lambda x: x != "")
    return F.filter(F.transform(F.split(F.lower(text), f"[{_PARAGRAPH}{_SENTENCE}]"), lines), lambda s: F.size(s) > 0)


def identifiers(lines: Column, known: dict[int, str]) -> Column:
    """The identifiers of one sentence: its own where it is known, whatever lines it is wrapped in; else
    that of its last lines or its first ones, if they make a known sentence; else one for each line. 0 is
    unknown. A list number alone counts for nothing.
    """
    table = F.array(*[F.lit(known[i]) for i in range(1, len(known) + 1)])
    longest = max(len(s.split()) for s in known.values())
    find = lambda s: F.nullif(F.array_position(table, s).cast("int"), F.lit(0))
    join = lambda array: F.array_join(array, " ")
    single = lambda array: F.transform(F.filter(array, lambda x: ~x.rlike(f"^{_NUMBER}$")), lambda x: F.coalesce(find(x), F.lit(0)))

    def parts(ls: Column) -> Column:
        n = F.size(ls)
        some = n > 1
        ends = F.when(some, F.sequence(F.greatest(F.lit(2), n - longest + 1), n))
        starts = F.when(some, F.sequence(F.lit(1), F.least(n - 1, F.lit(longest))))
        tail = F.array_min(F.filter(ends, lambda i: find(join(F.slice(ls, i, n))).isNotNull()))
        head = F.array_max(F.filter(starts, lambda i: find(join(F.slice(ls, F.lit(1), i))).isNotNull()))
        found = lambda t, h: (
            F.when(t.isNotNull(), F.concat(single(F.slice(ls, F.lit(1), t - 1)), F.array(find(join(F.slice(ls, t, n))))))
            .when(h.isNotNull(), F.concat(F.array(find(join(F.slice(ls, F.lit(1), h)))), single(F.slice(ls, h + 1, n))))
            .otherwise(single(ls))
        )
        return let(tail, lambda t: let(head, lambda h: found(t, h)))

    return let(find(join(lines)), lambda whole: F.when(whole.isNotNull(), F.array(whole)).otherwise(parts(lines)))


def scan(docs: DataFrame, known: dict[int, str] = SENTENCES, rules: list = RULES, anchors: tuple = ANCHORS) -> DataFrame:
    """One row per document: (doc_id, sentence_ids, licences, classes, n_matches).

    The whole text is cut into sentences, each is normalised (comment signs, line ends and punctuation
    gone) and looked up among the known ones. ``sentence_ids`` has the identifiers in their order, 0 for
    runs of unknown sentences, as text between blanks. Rules are tried in order; a rule matches where its
    identifiers stand one after the other, and takes those sentences from later rules. ``licences`` and
    ``classes`` are the distinct names found, in code point order, joined by commas.

    ``known`` is numbered from 1. Everything happens within the document's row, without a shuffle. Null
    and empty texts and texts without a known sentence have empty strings and 0 matches. Repeated rows
    give repeated rows; other columns are not read.
    """
    for name, _, ids in rules:
        if not any(a in known[i] for i in ids for a in anchors):
            raise ValueError(f"no anchor occurs in the rule of {name}: {ids}")
    text = F.coalesce(F.col("text"), F.lit(""))
    ids = F.flatten(F.transform(sentences(text), lambda lines: identifiers(lines, known)))
    joined = F.concat(F.lit("  "), F.array_join(ids.cast("array<string>"), "  "), F.lit("  "))
    squeezed = F.regexp_replace(joined, r"( 0 )( 0 )+", " 0 ")
    some = F.lower(text).rlike("|".join(anchors))
    table = F.array(*[F.struct(F.lit("".join(f" {i} " for i in ids)).alias("pattern"), F.lit(name).alias("name"), F.lit(kind).alias("kind")) for name, kind, ids in rules])
    none = F.lit([]).cast("array<string>")

    def apply(state: Column, rule: Column) -> Column:
        left = F.replace(state["rest"], rule["pattern"], F.lit(""))
        hits = ((F.length(state["rest"]) - F.length(left)) / F.length(rule["pattern"])).cast("int")
        add = lambda known, name: F.when(hits > 0, F.array_append(known, name)).otherwise(known)
        return F.struct(
            F.when(hits > 0, F.replace(state["rest"], rule["pattern"], F.lit(" - "))).otherwise(state["rest"]).alias("rest"),
            add(state["names"], rule["name"]).alias("names"),
            add(state["kinds"], rule["kind"]).alias("kinds"),
            (state["n"] + hits).alias("n"),
        )

    start = lambda seen: F.struct(seen.alias("rest"), none.alias("names"), none.alias("kinds"), F.lit(0).alias("n"))
    unique = lambda names: F.array_join(F.array_sort(F.array_distinct(names)), ",")
    rows = docs.select("doc_id", F.when(some, squeezed).alias("seen"))
    rows = rows.withColumn("found", F.when(F.col("seen").isNotNull(), F.aggregate(table, start(F.col("seen")), apply)))
    return rows.select(
        "doc_id",
        F.coalesce(F.when(F.col("found.n") > 0, F.trim("seen")), F.lit("")).alias("sentence_ids"),
        F.coalesce(unique(F.col("found.names")), F.lit("")).alias("licences"),
        F.coalesce(unique(F.col("found.kinds")), F.lit("")).alias("classes"),
        F.coalesce(F.col("found.n"), F.lit(0)).alias("n_matches"),
    )


def _replaced() -> str:
    """The rules as nested DuckDB expressions over the column ``rest0``: (rest after rule n, hits of n)."""
    steps = []
    for n, (_, _, ids) in enumerate(RULES):
        pattern = "".join(f" {i} " for i in ids)
        steps.append(
            f"s{n + 1} AS (SELECT *, replace(rest{n}, '{pattern}', ' - ') AS rest{n + 1}, "
            f"(length(rest{n}) - length(replace(rest{n}, '{pattern}', ''))) // {len(pattern)} AS n{n} FROM s{n})"
        )
    return ",\n".join(steps)


def scan_sql() -> str:
    """The same tables, cuts and rules in DuckDB."""
    hits = " + ".join(f"n{n}" for n in range(len(RULES)))
    pick = lambda at: "[" + ", ".join(f"CASE WHEN n{n} > 0 THEN '{r[at]}' END" for n, r in enumerate(RULES)) + "]"
    joined = lambda at: f"array_to_string(list_sort(list_distinct(list_filter({pick(at)}, lambda x: x IS NOT NULL))), ',')"
    marked = "coalesce(text, '')"
    for pattern, by in CUTS:
        marked = f"regexp_replace({marked}, '{pattern}', '{by}', 'g')"
    table = "[" + ", ".join(f"'{SENTENCES[i]}'" for i in range(1, len(SENTENCES) + 1)) + "]"
    longest = max(len(s.split()) for s in SENTENCES.values())
    find = lambda s: f"nullif(coalesce(list_position({table}, {s}), 0), 0)"
    join = lambda array: f"array_to_string({array}, ' ')"
    single = lambda array: f"list_transform(list_filter({array}, lambda x: NOT regexp_full_match(x, '{_NUMBER}')), lambda x: coalesce({find('x')}, 0))"
    return f"""
WITH cut AS (
    SELECT row_number() OVER () AS row_no, doc_id, string_split_regex(lower({marked}), '[{_PARAGRAPH}{_SENTENCE}]') AS parts FROM documents
),
wrapped AS (
    SELECT row_no, place, list_filter(list_transform(string_split(part, '{_LINE}'), lambda x: trim(x)), lambda x: x <> '') AS lines
    FROM (SELECT row_no, unnest(parts) AS part, generate_subscripts(parts, 1) AS place FROM cut)
),
tried AS (
    SELECT *, {find(join("lines"))} AS whole,
           list_min(list_filter(range(greatest(2, len(lines) - {longest} + 1), len(lines) + 1), lambda i: {find(join("lines[i:]"))} IS NOT NULL)) AS tail,
           list_max(list_filter(range(1, least(len(lines) - 1, {longest}) + 1), lambda i: {find(join("lines[:i]"))} IS NOT NULL)) AS head
    FROM wrapped WHERE len(lines) > 0
),
ids AS (
    SELECT row_no, place, CASE WHEN whole IS NOT NULL THEN [whole]
           WHEN tail IS NOT NULL THEN {single("lines[:tail - 1]")} || [{find(join("lines[tail:]"))}]
           WHEN head IS NOT NULL THEN [{find(join("lines[:head]"))}] || {single("lines[head + 1:]")}
           ELSE {single("lines")} END AS found
    FROM tried
),
strings AS (
    SELECT row_no, '  ' || string_agg(array_to_string(found, '  '), '  ' ORDER BY place) || '  ' AS joined FROM ids WHERE len(found) > 0 GROUP BY row_no
),
s0 AS (
    SELECT cut.row_no, doc_id, regexp_replace(coalesce(joined, ''), '( 0 )( 0 )+', ' 0 ', 'g') AS rest0
    FROM cut LEFT JOIN strings USING (row_no)
),
{_replaced()}
SELECT doc_id, CASE WHEN {hits} > 0 THEN trim(rest0) ELSE '' END AS sentence_ids,
       {joined(0)} AS licences, {joined(1)} AS classes, CAST({hits} AS INTEGER) AS n_matches
FROM s{len(RULES)}
"""
