"""Document fingerprints by threshold-scaled sketches of word shingles, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let
from .common import SPACE

SHINGLE_WORDS = 5
# The share of all shingle hashes that a sketch retains.
FRACTION = 1 / 8
# Hexadecimal digits of a hash.
DIGITS = 16
# A shingle's hash has two halves: sums of its words' CRCs, each times a number of its place, modulo a prime.
# The numbers are powers, so small that the sum of seven products fits into a long.
PRIMES = (2**31 - 1, 2**31 - 19)
PLACES = 268435399
BASES = (31415927, 27182818)
# Most cells that documents are dealt to in the order of their ids: the bound of what is broadcast.
MAX_CELLS = 1 << 16


def threshold(fraction: float) -> int:
    """The least first half of a hash that is not retained."""
    return int(fraction * PRIMES[0])


def place_numbers(half: int, n: int) -> list[int]:
    if n > 7:
        raise ValueError("shingles of more than seven words")
    return [pow(BASES[half], k + 1, PLACES) for k in range(n)]


def word_hashes(text: Column) -> Column:
    """The CRCs of a text's words, in their order."""
    return F.transform(F.filter(F.split(text, f"{SPACE}+"), lambda w: w != ""), lambda w: F.crc32(w.cast("binary")))


def sketch(words: Column, fraction: float = FRACTION, n: int = SHINGLE_WORDS) -> Column:
    """The sorted distinct hashes, as hexadecimal text, of all runs of ``n`` words that are below the fixed
    fraction, and the least one in any case. A shorter text is one run, a text without words has none.

    ``words`` are the hashes of the words and should be a column of its own: an expression would be
    evaluated for each run.
    """
    runs = F.sequence(F.lit(0), F.greatest(F.size(words) - n, F.lit(0)))

    def half(i: Column, which: int) -> Column:
        total = sum(F.coalesce(F.get(words, i + k), F.lit(0)) * F.lit(number) for k, number in enumerate(place_numbers(which, n)))
        return total % PRIMES[which]

    whole = lambda i: F.lower(F.lpad(F.hex(half(i, 0) * 2**31 + half(i, 1)), DIGITS, "0"))
    below = F.transform(F.filter(runs, lambda i: half(i, 0) < threshold(fraction)), whole)
    kept = let(below, lambda some: F.when(F.size(some) > 0, F.array_sort(F.array_distinct(some))).otherwise(F.array(F.array_min(F.transform(runs, whole)))))
    return F.when(F.size(words) == 0, F.array().cast("array<string>")).otherwise(kept)


def merged(left: Column, right: Column, fraction: float = FRACTION) -> Column:
    """The sketch of both documents' shingles together, from their sketches alone."""
    both = F.array_sort(F.array_distinct(F.concat(left, right)))
    least = f"{threshold(fraction) << 31:0{DIGITS}x}"
    below = F.filter(both, lambda h: h < least)
    return F.when(F.size(below) > 0, below).otherwise(F.slice(both, 1, 1))


def containment(part: Column, whole: Column) -> Column:
    """The estimated share of ``part``'s shingles that ``whole`` has; 1 for a part without any."""
    return F.when(F.size(part) == 0, 1.0).otherwise(F.size(F.array_intersect(part, whole)) / F.size(part))


def likeness(left: Column, right: Column) -> Column:
    """The estimated containment of the text with fewer shingles in the other: 1 for two empty sketches,
    0 for one."""
    least = F.least(F.size(left), F.size(right))
    shared = F.size(F.array_intersect(left, right))
    return F.when(F.size(left) + F.size(right) == 0, 1.0).when(least == 0, 0.0).otherwise(shared / least)


def written(hashes: Column) -> Column:
    return F.array_join(hashes, "")


def read_back(fingerprint: Column) -> Column:
    """The sorted hashes of a written fingerprint."""
    places = F.sequence(F.lit(0), (F.length(fingerprint) / DIGITS - 1).cast("int"))
    hashes = F.transform(places, lambda i: F.substring(fingerprint, i * DIGITS + 1, F.lit(DIGITS)))
    return F.when(F.length(fingerprint) == 0, F.array().cast("array<string>")).otherwise(hashes)


def fingerprints(docs: DataFrame, fraction: float = FRACTION, n: int = SHINGLE_WORDS) -> DataFrame:
    """The rows of ``docs`` with ``fingerprint``: the sketch of the whole text as one string.

    Null texts are empty and have an empty fingerprint, all others a filled one; equal texts have equal
    ones. No shuffle. Other columns pass through, save one named fingerprint or _words.
    """
    kept = [f"`{c}`" for c in docs.columns if c not in ("fingerprint", "_words")]
    cut = docs.select(*kept).withColumn("_words", word_hashes(F.coalesce(F.col("text"), F.lit(""))))
    return cut.select(*kept, written(sketch(F.col("_words"), fraction, n)).alias("fingerprint"))


def cells(docs: DataFrame) -> DataFrame:
    """doc_id, text and its digest (md5) with ``cell``: a number that rises with (doc_id, digest).

    Bounds are percentiles of the ids. An id with many rows is several bounds, and its rows are spread
    over the cells between them by their digests; so are null ids, below all others.
    """
    spark = docs.sparkSession
    levels = min(int(math.log2(MAX_CELLS)), math.ceil(math.log2(16 * int(spark.conf.get("spark.sql.shuffle.partitions")))))
    n = 2**levels
    rows = docs.agg(F.count("*").alias("n"), F.count("doc_id").alias("ids")).first()
    shares = [i / n for i in range(1, n)]
    bounds = docs.agg(F.percentile_approx("doc_id", shares, 100 * n)).scalar() if rows["ids"] else F.array().cast("array<long>")
    nulls = max(1, math.ceil(n * (rows["n"] - rows["ids"]) / max(rows["n"], 1)))
    halving = F.array(*[F.lit(2**k) for k in reversed(range(levels))])

    def passed(over: bool) -> Column:
        """How many bounds are below the id, or not above it."""
        below = lambda b: (b <= F.col("doc_id")) if over else (b < F.col("doc_id"))
        return F.aggregate(halving, F.lit(0), lambda at, by: F.when(below(F.get(F.col("bounds"), at + by - 1)), at + by).otherwise(at))

    placed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("bounds", bounds)
    placed = placed.withColumn("digest", F.md5(F.col("text").cast("binary")))
    part = F.conv(F.substring("digest", 1, 8), 16, 10).cast("double") / 2**32
    low, high = passed(False), passed(True)
    cell = F.when(F.col("doc_id").isNull(), F.floor(part * nulls) - nulls).otherwise(low + F.floor(part * (high - low + 1)))
    return placed.select("doc_id", "text", "digest", cell.cast("long").alias("cell"))


def with_next(docs: DataFrame) -> DataFrame:
    """Rows of (doc_id, text, fingerprint, next_id, next_text, next_fingerprint): each document with the
    one after it in the order of falling ids (nulls last, equal ids by falling md5 of their texts); after
    the last comes the first. A document alone is its own next.

    Whole texts pass through one exchange. The first document of every cell stands once more at the end
    of the cell before it; which those are is told by one row per cell, ``MAX_CELLS`` at most.
    """
    placed = cells(docs)
    heads = placed.groupBy("cell").agg(F.max(F.struct("doc_id", "digest")).alias("head"))
    falling = Window.orderBy(F.desc("cell"))
    around = F.coalesce(F.lag("cell").over(falling), F.min("cell").over(Window.partitionBy()))
    heads = heads.select("head", F.col("cell").alias("own"), around.alias("before"))
    same = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("digest") == F.col("head.digest")) & (F.col("cell") == F.col("own"))
    # rows alike in id and digest are alike
    echoes = placed.join(F.broadcast(heads), same).dropDuplicates(["own"])
    echoes = echoes.select("doc_id", "text", "digest", F.col("before").alias("cell"), F.lit(1).alias("echo"))
    rows = fingerprints(placed.withColumn("echo", F.lit(0)).unionByName(echoes))
    order = Window.partitionBy("cell").orderBy("echo", F.desc_nulls_last("doc_id"), F.desc("digest"))
    after = F.lead(F.struct("doc_id", "text", "fingerprint")).over(order)
    paired = rows.withColumn("after", after).where("echo = 0")
    return paired.select(
        "doc_id", "text", "fingerprint", F.col("after.doc_id").alias("next_id"), F.col("after.text").alias("next_text"), F.col("after.fingerprint").alias("next_fingerprint")
    )


def compare_edits(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_chars, edited (text), fingerprint, edited_fingerprint, near_edited,
    near_next, next_id.

    The edited text has the last half of the document's characters (rounded down) replaced by as many
    first characters of the next document, or all of it. Likeness is the estimated containment of the
    smaller of two shingle sets in the other. Null texts are empty; texts without a word have empty
    fingerprints, which are alike among themselves and unlike all others. Rows that share an id are
    documents of their own. An empty table gives no rows; other columns are not read.
    """
    n_chars = F.length("text")
    half = F.floor(n_chars / 2).cast("int")
    edited = F.concat(F.left("text", n_chars - half), F.left("next_text", half))
    rows = with_next(docs).select("doc_id", n_chars.cast("long").alias("n_chars"), "fingerprint", "next_fingerprint", "next_id", edited.alias("edited"))
    rows = rows.withColumn("_words", word_hashes(F.col("edited"))).withColumn("_edited", sketch(F.col("_words")))
    own, after = read_back(F.col("fingerprint")), read_back(F.col("next_fingerprint"))
    rows = rows.select("doc_id", "n_chars", "edited", "fingerprint", "next_id", "_edited", own.alias("_own"), after.alias("_after"))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited",
        "fingerprint",
        written(F.col("_edited")).alias("edited_fingerprint"),
        likeness(F.col("_own"), F.col("_edited")).alias("near_edited"),
        likeness(F.col("_own"), F.col("_after")).alias("near_next"),
        "next_id",
    )


def compare_sql(fraction: float = FRACTION, n: int = SHINGLE_WORDS) -> str:
    def alike(a: str, b: str) -> str:
        return (
            f"CASE WHEN len({a}) + len({b}) = 0 THEN 1.0 WHEN least(len({a}), len({b})) = 0 THEN 0.0 "
            f"ELSE len(list_intersect({a}, {b}))::DOUBLE / least(len({a}), len({b})) END"
        )

    halves = [
        "(" + " + ".join(f"coalesce(lead(crc, {k}) OVER w, 0) * {number}" for k, number in enumerate(place_numbers(which, n))) + f") % {PRIMES[which]}"
        for which in (0, 1)
    ]
    return f"""
WITH byte_table AS (
    SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS steps
),
ordered AS (
    SELECT row_number() OVER (ORDER BY doc_id DESC NULLS LAST, md5(coalesce(text, '')) DESC) AS nth, doc_id, coalesce(text, '') AS text FROM documents
),
paired AS (
    SELECT a.nth, a.doc_id, a.text, length(a.text) AS n_chars, b.nth AS next_nth, b.doc_id AS next_id,
           left(a.text, CAST(length(a.text) - length(a.text) // 2 AS BIGINT)) || left(b.text, CAST(length(a.text) // 2 AS BIGINT)) AS edited
    FROM ordered a JOIN ordered b ON b.nth = CASE WHEN a.nth = (SELECT max(nth) FROM ordered) THEN 1 ELSE a.nth + 1 END
),
cut AS (
    SELECT nth, which, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
    FROM (SELECT nth, 0 AS which, text AS t FROM paired UNION ALL SELECT nth, 1, edited FROM paired)
),
each AS (SELECT nth, which, len(words) AS n, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM cut),
spelled AS (SELECT word, hex(encode(word)) AS bytes FROM (SELECT DISTINCT word FROM each)),
crcs AS (
    SELECT word, xor(list_reduce(list_transform(range(1, length(bytes), 2), lambda i: CAST('0x' || substr(bytes, i, 2) AS BIGINT)),
           lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS crc
    FROM spelled, byte_table
),
runs AS (
    SELECT nth, which, n, place, {halves[0]} AS high, {halves[1]} AS low FROM each JOIN crcs USING (word)
    WINDOW w AS (PARTITION BY nth, which ORDER BY place)
),
hashes AS (
    SELECT nth, which, high < {threshold(fraction)} AS below, lower(lpad(to_hex(high * 2147483648 + low), {DIGITS}, '0')) AS h
    FROM runs WHERE place <= greatest(n - {n - 1}, 1)
),
sketches AS (
    SELECT nth, which, coalesce(list_sort(list(DISTINCT h) FILTER (WHERE below)), [min(h)]) AS s FROM hashes GROUP BY nth, which
),
own AS (SELECT p.*, coalesce(s, []) AS s FROM paired p LEFT JOIN sketches k ON k.nth = p.nth AND which = 0),
sketched AS (SELECT o.*, coalesce(k.s, []) AS es FROM own o LEFT JOIN sketches k ON k.nth = o.nth AND which = 1)
SELECT a.doc_id, a.n_chars, sha256(a.edited) AS edited_sha256, array_to_string(a.s, '') AS fingerprint,
       array_to_string(a.es, '') AS edited_fingerprint, {alike("a.s", "a.es")} AS near_edited, {alike("a.s", "b.s")} AS near_next, a.next_id
FROM sketched a JOIN sketched b ON a.next_nth = b.nth
"""
