"""Resampling by importance for a target distribution: hashed word n-grams read by an Aho-Corasick automaton."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import slices, text_bytes

# The counts of so many buckets are all that comes to the driver.
BUCKETS = 10_000
SEED = "2024"
# A longer word stays out of the automaton, whose size is that of its words, and is looked up by itself.
LONG_WORD = 1 << 12
SLICE_BYTES = 2 << 20
# Bytes: A-Z to a-z, all that ends a word to a blank. Words are a-z, 0-9 and all beyond ASCII.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
POLYNOMIAL = 0xEDB88320


def _times(matrix: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A linear map of 32 bits, given by its columns, of each value."""
    out = np.zeros_like(values)
    for bit in range(32):
        out ^= np.where((values >> np.uint32(bit)) & np.uint32(1), matrix[bit], np.uint32(0))
    return out


class Zeros:
    """What appending zero bytes does to a CRC: one linear map for each length, made by squaring."""

    def __init__(self):
        columns = 1 << np.arange(32, dtype=np.uint64)
        for _ in range(8):
            columns = (columns >> np.uint64(1)) ^ np.where(columns & np.uint64(1), np.uint64(POLYNOMIAL), np.uint64(0))
        self.squares = [columns.astype(np.uint32)]
        self.known: dict[int, np.ndarray] = {}

    def map(self, length: int) -> np.ndarray:
        if length not in self.known:
            out = (1 << np.arange(32, dtype=np.uint64)).astype(np.uint32)
            for k in range(length.bit_length()):
                if len(self.squares) <= k:
                    self.squares.append(_times(self.squares[-1], self.squares[-1]))
                if length >> k & 1:
                    out = _times(self.squares[k], out)
            self.known[length] = out
        return self.known[length]

    def append(self, crc: np.ndarray, lengths: np.ndarray, tails: np.ndarray) -> np.ndarray:
        """CRCs of strings followed by tails, from the CRCs of both and the lengths of the tails."""
        out = np.empty_like(crc)
        for length in np.unique(lengths).tolist():
            at = lengths == length
            out[at] = _times(self.map(length), crc[at])
        return out ^ tails


class Dictionary:
    """An automaton over distinct words, each between blanks, with their payloads: the CRC of the word, the
    CRC and the length of a blank and the word."""

    def __init__(self, words: list[bytes]):
        self.crc = np.array([zlib.crc32(w) for w in words], np.uint32)
        self.tail = np.array([zlib.crc32(b" " + w) for w in words], np.uint32)
        self.tail_length = np.array([1 + len(w) for w in words], np.int64)
        self.automaton = ahocorasick.Automaton()
        self.long: list[tuple[str, int]] = []
        for n, word in enumerate(words):
            bounded = f" {word.decode('latin-1')} "
            if len(word) > LONG_WORD:
                self.long.append((bounded, n))
            else:
                self.automaton.add_word(bounded, n)
        if len(self.automaton):
            self.automaton.make_automaton()

    def scan(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(place of the last character, word) of all words of a text that begins and ends with a blank."""
        hits = self.automaton.iter(text) if len(self.automaton) else ()
        found = np.fromiter(chain.from_iterable(hits), np.int64).reshape(-1, 2)
        more = []
        for bounded, n in self.long:
            at = text.find(bounded)
            while at >= 0:
                more.append((at + len(bounded) - 1, n))
                at = text.find(bounded, at + len(bounded) - 1)
        if more:
            found = np.concatenate([found, np.array(more, np.int64)])
            found = found[np.argsort(found[:, 0], kind="stable")]
        return found[:, 0], found[:, 1]


def bucket_rows(data: np.ndarray, offsets: np.ndarray, n_buckets: int, ngrams: int, zeros: Zeros) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of all features, features of each row, words of each row) of texts laid end to end.

    Rows come after each other; the features of a row are its words, then its pairs, and so on.
    """
    raw = data.tobytes().translate(FOLD)
    text = b" ".join([b"", *(raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)), b""]).decode("latin-1")
    n = len(offsets) - 1
    words = sorted(set(text.split(" ")) - {""})
    dictionary = Dictionary([w.encode("latin-1") for w in words])
    ends, word = dictionary.scan(text)
    # row i begins behind i + 1 of the blanks put in
    row = np.searchsorted(offsets[1:] + np.arange(1, n + 1), ends, side="left")
    crc = dictionary.crc[word]
    crcs, owners = [crc], [row]
    for k in range(1, ngrams):
        last = word[k:]
        crc = zeros.append(crc[: len(last)], dictionary.tail_length[last], dictionary.tail[last])
        whole = row[: len(last)] == row[k:]
        crcs.append(crc[whole])
        owners.append(row[k:][whole])
    buckets = np.concatenate(crcs).astype(np.int64) % n_buckets
    owner = np.concatenate(owners)
    if ngrams > 1:
        buckets = buckets[np.argsort(owner, kind="stable")]
    return buckets, np.bincount(owner, minlength=n)[:n], np.bincount(row, minlength=n)[:n]


def features(texts: DataFrame, key: Column, n_buckets: int = BUCKETS, ngrams: int = 1) -> DataFrame:
    """(key, n_words, n_features, buckets): the buckets of each text's features as packed unsigned numbers.

    A bucket is the CRC of the feature's UTF-8 bytes modulo ``n_buckets``. A dictionary is made of the words
    of each slice of a batch, so it is bounded by the slice. Null texts have no features.
    """
    kind = "<u2" if n_buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zeros = Zeros()
        for batch in slices(batches, "text", SLICE_BYTES):
            buckets, n_features, n_words = bucket_rows(*text_bytes(batch.column("text")), n_buckets, ngrams, zeros)
            raw = buckets.astype(kind).tobytes()
            ends = np.cumsum(n_features) * np.dtype(kind).itemsize
            packed = [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()), pa.array(packed, pa.binary())], ["key", "n_words", "n_features", "buckets"])

    return texts.select(key.cast("long").alias("key"), "text").mapInArrow(run, "key long, n_words long, n_features long, buckets binary")


def bucket_counts(featured: DataFrame, n_buckets: int = BUCKETS) -> np.ndarray:
    """How many features each bucket has: a partition adds its rows up, Spark the partitions."""
    kind = "<u2" if n_buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(n_buckets, np.int64)
        for batch in batches:
            for raw in batch.column("buckets"):
                counts += np.bincount(np.frombuffer(raw.as_buffer(), kind), minlength=n_buckets)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(counts[some])], ["bucket", "n"])

    found = featured.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(n_buckets, np.int64)
    counts[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of the smoothed shares) of each bucket."""
    n = len(source)
    over = (target + 1).astype(float) * float(source.sum() + n)
    under = (source + 1).astype(float) * float(target.sum() + n)
    return np.floor(1000 * np.log(over / under)).astype(np.int64)


def weighed(featured: DataFrame, gain: np.ndarray, n_buckets: int = BUCKETS) -> DataFrame:
    """(key, n_words, n_features, weight): the floored mean of the gains of a text's features, 0 without any."""
    kind = "<u2" if n_buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight = [int(gain[np.frombuffer(raw.as_buffer(), kind)].sum()) // max(len(raw.as_buffer()) // np.dtype(kind).itemsize, 1) for raw in batch.column("buckets")]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("key", "n_words", "n_features")] + [pa.array(weight, pa.int64())], ["key", "n_words", "n_features", "weight"])

    return featured.select("key", "n_words", "n_features", "buckets").mapInArrow(run, "key long, n_words long, n_features long, weight long")


def ranked(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """The rows with ``rank``, 1 for the first in the order of ``order``, without a window over all rows:
    a range sort numbers the rows of each partition, and one row per partition tells where it begins."""
    row = F.monotonically_increasing_id()
    placed = materialize(rows.withColumn("_row", row).sort(*order, "_row").withColumn("_at", row), name)
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    within = F.col("_at") - F.shiftleft(part, 33)
    return placed.withColumn("_part", part).join(starts, "_part").withColumn("rank", F.col("_start") + within + 1).select(*rows.columns, "rank")


def resample(docs: DataFrame, target: DataFrame, n_buckets: int = BUCKETS, ngrams: int = 1, least_words: int = 20, percent: int = 10, seed: str = SEED) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank, n_words.

    Features are all runs of 1 to ``ngrams`` consecutive words, hashed to buckets. The gain of a bucket is
    the log of its smoothed share in ``target`` over that in ``docs``, a document's weight the mean gain
    of its features, and its score the weight with Gumbel noise drawn by sha256 of seed and id. Of the
    documents with at least ``least_words`` words the ``percent`` with the highest scores are drawn and
    ranked (ties: smaller id, null ids last, then any order); the others have a null rank.

    Null texts, and texts without a word, have no features and weight 0. A null id counts as an empty one
    in the noise. Repeated rows are documents of their own. Empty tables give no rows, and an empty target
    counts 0 for every bucket. Other columns are not read.
    """
    source = materialize(features(docs, F.col("doc_id"), n_buckets, ngrams), "features")
    wanted = features(target, F.lit(None), n_buckets, ngrams)
    gain = gains(bucket_counts(source, n_buckets), bucket_counts(wanted, n_buckets))
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))).cast("binary"), 256)
    uniform = (F.conv(F.substring(drawn, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    noise = F.floor(-1000 * F.log(-F.log(uniform)))
    scored = weighed(source, gain, n_buckets).withColumn("score", F.col("weight") + noise)
    eligible = F.col("n_words") >= least_words
    drawn_rows = F.floor(source.agg(F.count(F.when(eligible, 1)) * percent).scalar() / 100)
    order = [F.desc(eligible), F.desc("score"), F.asc_nulls_last("key")]
    rows = ranked(scored, order, "scored")
    return rows.select(F.col("key").alias("doc_id"), "n_features", "weight", "score", F.when(eligible & (F.col("rank") <= drawn_rows), F.col("rank")).alias("rank"), "n_words")


def resample_sql(n_buckets: int = BUCKETS, least_words: int = 20, percent: int = 10, seed: str = SEED) -> str:
    """For features of one word. The CRC is taken byte by byte, once for each distinct word."""
    words = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH byte_table AS (
    SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, {POLYNOMIAL}) ELSE c >> 1 END, b)) AS steps
),
docs AS (SELECT row_number() OVER () AS nth, doc_id, coalesce({words}, []) AS words FROM documents),
found AS (SELECT nth, unnest(words) AS word FROM docs),
wanted AS (SELECT unnest({words}) AS word FROM benchmark),
spelled AS (SELECT word, hex(encode(word)) AS bytes FROM (SELECT word FROM found UNION SELECT word FROM wanted)),
hashed AS (
    SELECT word, xor(list_reduce(list_transform(range(1, length(bytes), 2), lambda i: CAST('0x' || substr(bytes, i, 2) AS BIGINT)),
           lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % {n_buckets} AS bucket
    FROM spelled, byte_table
),
source AS (SELECT bucket, count(*) AS s FROM found JOIN hashed USING (word) GROUP BY bucket),
target AS (SELECT bucket, count(*) AS t FROM wanted JOIN hashed USING (word) GROUP BY bucket),
gains AS (
    SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM found) + {n_buckets})::DOUBLE
           / ((s + 1)::DOUBLE * ((SELECT count(*) FROM wanted) + {n_buckets})::DOUBLE))) AS BIGINT) AS gain
    FROM source LEFT JOIN target USING (bucket)
),
weights AS (SELECT nth, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight FROM found JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY nth),
scored AS (
    SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(weight, 0) AS weight,
           coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5)::DOUBLE / 4294967296))) AS BIGINT) AS score
    FROM docs LEFT JOIN weights USING (nth)
),
placed AS (SELECT *, row_number() OVER (ORDER BY n_words >= {least_words} DESC, score DESC, doc_id NULLS LAST) AS place FROM scored)
SELECT doc_id, n_words AS n_features, weight, score, n_words,
       CASE WHEN n_words >= {least_words} AND place <= (SELECT count(*) * {percent} // 100 FROM scored WHERE n_words >= {least_words}) THEN place END AS rank
FROM placed
"""
