"""Line deduplication by a deletion-neighbourhood join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import aside

# Shorter lines (headings, bullets, closing marks) always stay.
MIN_CHARS = 20
# Into so many parts a line is cut; deletions are made within one part at a time.
PARTS = 16


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def _windows(line: Column, parts: int) -> Column:
    """For each part of a line: (key of all that stands outside the part, the part, whether the line
    is the shorter one).

    Two lines within one edit are alike outside one part. Parts are measured on the shorter line; a
    line cannot know whether it is that one, so it gives its parts for its own length and for one less.
    """
    length = F.length(line)

    def window(i: Column) -> Column:
        size = length - F.floor(i / parts).cast("int")
        part = i % parts
        head = F.floor(part * size / parts).cast("int")
        tail = size - F.floor((part + 1) * size / parts).cast("int")
        outside = F.xxhash64(part, size, F.substring(line, F.lit(1), head), F.lit("|"), F.substring(line, length - tail + 1, tail))
        return F.struct(outside.alias("outside"), F.substring(line, head + 1, length - head - tail).alias("part"), (i < parts).alias("short"))

    return F.transform(F.sequence(F.lit(0), F.lit(2 * parts - 1)), window)


def _halves(line: Column) -> Column:
    """Keys of which two lines within one edit share one at least: the first and the last characters,
    as many on either side.

    If the edit is not among the first, they are the same in both lines, else the last ones are. The
    number is half the shorter line's length, down to a multiple of four; a line cannot know whether
    it is that one, so it gives the number for one less too where that differs.
    """
    length = F.length(line)
    size = lambda n: (F.floor(n / 8) * 4).cast("int")
    ends = lambda n: (F.xxhash64(F.lit(1), F.substring(line, F.lit(1), n)), F.xxhash64(F.lit(2), F.substring(line, length - n + 1, n)))
    own, less = size(length), size(length - 1)
    return F.when(own == less, F.array(*ends(own))).otherwise(F.array(*ends(own), *ends(less)))


def _shared(windows: DataFrame) -> DataFrame:
    """The keys that at least two different lines have."""
    return windows.groupBy("outside").agg(F.min("line_key").alias("low"), F.max("line_key").alias("high")).where("low < high").select("outside")


def near_lines(source: DataFrame, first: DataFrame, parts: int = PARTS) -> DataFrame:
    """(line_key): lines that have a line within one edit, other than themselves, with an earlier first place.

    ``source`` has (_id, _hash, text), ``first`` (line_key, first, halves) per line. Lines that share
    neither half with another line are set aside; what is left is compared part by part. Within a part
    each line gives its text and the part without each of its characters. Lines alike in a rest and the
    place of the deletion differ by one replaced character, a line that is another's rest by one
    inserted character. In both cases a key's earliest line answers for all, so no pairs are made
    within a key. What is found is verified on the texts.
    """
    halves = first.select("line_key", F.explode("halves").alias("outside"))
    candidates = materialize(halves.join(_shared(halves), "outside").select("line_key").distinct(), "near-candidates")
    # texts move as whole documents, each once, and only the wanted lines of them go on
    wanted = first.drop("halves").join(candidates, "line_key").groupBy(F.col("first._id").alias("_wid"), F.col("first._hash").alias("_whash"))
    wanted = wanted.agg(F.map_from_entries(F.collect_list(F.struct("first.pos", "line_key"))).alias("wanted"))
    texts = source.select("_id", "_hash", "text").join(wanted, (F.col("_id") == F.col("_wid")) & (F.col("_hash") == F.col("_whash")))
    each = texts.select("_id", "_hash", "wanted", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    each = each.withColumn("line_key", F.try_element_at("wanted", F.col("pos"))).where("line_key is not null")
    near = materialize(each.select("line_key", F.struct("_id", "_hash", "pos").alias("first"), "line"), "near-lines")
    windows = near.select("line_key", "first", F.inline(_windows(F.col("line"), parts)))
    windows = materialize(windows.join(_shared(windows), "outside"), "near-windows")
    own = windows.where("short").select("line_key", "first", F.xxhash64("outside", "part").alias("rest"))
    deleted = F.transform(
        F.sequence(F.lit(1), F.length("part")),
        lambda r: F.struct(F.xxhash64(F.col("outside"), F.concat(F.substring("part", F.lit(1), r - 1), F.substring(F.col("part"), r + 1, F.length("part")))).alias("rest"), r.alias("place")),
    )
    rests = windows.where("part <> ''").select("line_key", "first", "short", F.inline(deleted))
    earliest = F.min(F.struct("first", "line_key")).alias("best")
    # lines of one length: the same rest, the deletion at the same place
    equal = rests.where("short")
    replaced = equal.join(equal.groupBy("rest", "place").agg(earliest, F.min("line_key").alias("low"), F.max("line_key").alias("high")).where("low < high"), ["rest", "place"])
    # lines that are one longer than the part was measured for, with the shorter line itself
    longer = rests.where("not short")
    after = own.join(longer.groupBy("rest").agg(earliest), "rest")
    before = longer.join(own.groupBy("rest").agg(earliest), "rest")
    found = [x.select("line_key", "first", "best") for x in (replaced, after, before)]
    pairs = found[0].unionByName(found[1]).unionByName(found[2]).where("best.first < first").select("line_key", F.col("best.line_key").alias("other_key")).distinct()
    texts = near.select("line_key", "line")
    others = near.select(F.col("line_key").alias("other_key"), F.col("line").alias("other"))
    verified = F.levenshtein("line", "other", 1) >= 0
    return pairs.join(texts, "line_key").join(others, "other_key").where(verified).select("line_key").distinct()


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, parts: int = PARTS) -> DataFrame:
    """The rows of ``docs`` with ``text`` replaced, and n_lines, n_removed, removed (positions from 0).

    A line of at least ``min_chars`` code points goes if an equal line, or one within one edit
    (a character inserted, deleted or replaced), stands earlier: in a document with a smaller id or
    further up in the same one. Documents with equal ids are ordered by a hash of their text, null
    ids come first. Whether the earlier line stays itself makes no difference. Shorter lines stay.

    A null text stays null with 0 lines; an empty text is one short line. Rows alike in id and text are
    one document: both get the same result. Other columns pass through unread, whatever their names;
    only the result's own names (n_lines, n_removed, removed) are replaced where they clash. An empty
    table gives no rows.
    """
    keep = [c for c in docs.columns if c not in ("n_lines", "n_removed", "removed")]
    id_ = F.col("doc_id")
    named, names = aside(docs.select(*[f"`{c}`" for c in keep]), ["doc_id", "text"])
    source = named.withColumns({"_id": F.coalesce(id_, F.lit(-(1 << 63))), "_hash": F.coalesce(F.xxhash64(id_.isNull(), "text"), F.lit(0))})
    place = F.struct("_id", "_hash", "pos")
    lines = source.select("_id", "_hash", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.length("line") >= min_chars)
    lines = lines.select(_digest(F.col("line")).alias("line_key"), place.alias("at"), "line")
    keys = materialize(lines.select("line_key", "at", _halves(F.col("line")).alias("halves")), "line-keys")
    # equal lines have equal halves
    first = keys.groupBy("line_key", "halves").agg(F.min("at").alias("first"))
    near = near_lines(source, first, parts).withColumn("near", F.lit(True))
    verdicts = materialize(first.drop("halves").join(near, "line_key", "left"), "line-verdicts")
    gone = keys.select("line_key", "at").join(verdicts, "line_key").where("near or at <> first")
    by_doc = gone.groupBy(F.col("at._id").alias("_gid"), F.col("at._hash").alias("_ghash")).agg(F.sort_array(F.collect_set("at.pos")).alias("removed"))
    counted = source.withColumn("n_lines", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long"))
    counted = counted.withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.col("n_lines")).cast("long"))
    joined = counted.join(by_doc, (F.col("_id") == F.col("_gid")) & (F.col("_hash") == F.col("_ghash")), "left")
    none = F.lit([]).cast("array<int>")
    joined = joined.withColumn("removed", F.coalesce("removed", none)).withColumn("n_removed", F.size("removed").cast("long"))
    left = F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains("removed", i))
    text = F.when(F.col("n_removed") > 0, F.array_join(left, "\n")).otherwise(F.col("text"))
    return joined.select(*[text.alias("text") if c == "text" else F.col(names[c]).alias(c) for c in keep], "n_lines", "n_removed", "removed")


def dedup_sql(min_chars: int = MIN_CHARS) -> str:
    """The same rule in DuckDB: lines within one edit share a half, so that halves are the join keys."""
    half = lambda less: f"length(line) - {less}"
    keys = ", ".join(
        f"struct_pack(side := '{side}', size := {half(less)}, part := {'left' if side == 'head' else 'right'}(line, {size}))"
        for less in (0, 1)
        for side, size in (("head", f"({half(less)}) // 2"), ("tail", f"({half(less)}) - ({half(less)}) // 2"))
    )
    return f"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents
),
firsts AS (SELECT line, min({{'d': doc_id, 'p': pos}}) AS first FROM lines WHERE length(line) >= {min_chars} GROUP BY line),
keyed AS (SELECT line, first, unnest([{keys}]) AS key FROM firsts),
pairs AS (
    SELECT DISTINCT a.line, b.line AS other FROM keyed a JOIN keyed b ON a.key = b.key
    WHERE b.first < a.first AND abs(length(a.line) - length(b.line)) <= 1
),
chars AS (
    SELECT line, other, CASE WHEN length(line) >= length(other) THEN line ELSE other END AS long,
           CASE WHEN length(line) >= length(other) THEN other ELSE line END AS short FROM pairs
),
near AS (
    SELECT DISTINCT line FROM chars
    WHERE len(list_filter(range(0, length(long)), lambda i:
        left(long, i) = left(short, i) AND right(long, length(long) - i - 1) =
        CASE WHEN length(long) = length(short) THEN right(short, length(short) - i - 1) ELSE right(short, length(short) - i) END)) > 0
),
gone AS (
    SELECT l.doc_id, l.pos FROM lines l JOIN firsts f USING (line) LEFT JOIN near n USING (line)
    WHERE n.line IS NOT NULL OR f.first <> {{'d': l.doc_id, 'p': l.pos}}
),
by_doc AS (SELECT doc_id, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS removed, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END AS n_lines,
       coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed
FROM documents LEFT JOIN by_doc USING (doc_id)
"""
