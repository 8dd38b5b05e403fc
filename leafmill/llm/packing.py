"""Packing documents into sequences: cutting-stock patterns by column generation."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, small_table
from .common import Rolling, aside, release_memory, slices, small_batches, text_bytes, word_spans

SEQUENCE = 4096
# Lengths are counted in units of so many tokens, rounded up: at most one less is lost with each piece.
UNIT = 16
END_ID = 2
# Ranks within one length are summed in two levels over so many cells.
CELLS = 4096
MAX_COLUMNS = 5000
# Bytes of chunks and their ids that a task remembers at once.
CACHE_BYTES = 48 << 20
SLICE_BYTES = 2 << 20


class ChunkIds:
    """Ids of texts, chunk by chunk between blanks; each chunk is encoded when it is met first.

    A blank always separates words of this tokenizer, so the ids of a text are those of its chunks one
    after the other. A chunk is known by a 64-bit hash of its bytes, so the cache takes some 30 bytes a
    chunk; beyond ``max_bytes`` it keeps what the present slice uses. Chunks in plain Latin letters are cut
    by the tokenizer's own word pattern and each word goes to its model; all other chunks go through the
    whole tokenizer.
    """

    # The word pattern of the vocabulary file, and its byte alphabet (bytes without a
    # printable character of their own follow after 255).
    PATTERN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
    PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
    SPECIAL = re.compile(r"<\|")

    def __init__(self, path: str, max_bytes: int = CACHE_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.max_bytes = Tokenizer.from_file(path), max_bytes
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in printable]
        self.bytes = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        # hashes in their order, and where their ids begin in the pool and how many they are
        self.keys, self.start, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.pool = np.zeros(0, np.uint16)

    def _learn(self, hashes: np.ndarray, chunks: list[str]) -> None:
        """Adds chunks whose hashes, in their order, are not known yet."""
        words: dict[str, list[int]] = {}
        ids: list[int] = []
        counts = []
        tokenize, cut, plain, special = self.tokenizer.model.tokenize, self.PATTERN.findall, self.PLAIN.fullmatch, self.SPECIAL.search
        for chunk in chunks:
            before = len(ids)
            if plain(chunk) and not special(chunk):
                for word in cut(chunk.lower()):
                    found = words.get(word)
                    if found is None:
                        spelled = word if word.isascii() else "".join(self.bytes[b] for b in word.encode())
                        found = words[word] = [t.id for t in tokenize(spelled)]
                    ids += found
            else:
                ids += self.tokenizer.encode(chunk, add_special_tokens=False).ids
            counts.append(len(ids) - before)
        new = np.array(ids, np.uint32)
        if self.pool.dtype == np.uint16 and len(new) and new.max() > 0xFFFF:
            self.pool = self.pool.astype(np.uint32)
        n = np.array(counts, np.int32)
        at = np.searchsorted(self.keys, hashes)
        self.start = np.insert(self.start, at, len(self.pool) + np.cumsum(n, dtype=np.int64) - n)
        self.n = np.insert(self.n, at, n)
        self.keys = np.insert(self.keys, at, hashes)
        self.pool = np.concatenate([self.pool, new.astype(self.pool.dtype)])

    def _keep(self, hashes: np.ndarray) -> None:
        """Forgets all chunks but these."""
        at = np.searchsorted(self.keys, hashes)
        start, n = self.start[at], self.n[at]
        ends = np.cumsum(n, dtype=np.int64)
        self.pool = self.pool[np.repeat(start - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]
        self.keys, self.start, self.n = hashes, ends - n, n

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows end to end, number of ids of each row) of texts laid end to end."""
        starts, ends, row = word_spans(data, offsets)
        hashes, first, which = np.unique(Rolling(data).of(starts, ends), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, hashes)
        unknown = np.ones(len(hashes), bool)
        inside = at < len(self.keys)
        unknown[inside] = self.keys[at[inside]] != hashes[inside]
        if unknown.any():
            if self.keys.nbytes + self.start.nbytes + self.n.nbytes + self.pool.nbytes > self.max_bytes:
                self._keep(hashes[~unknown])
            raw, places = data.tobytes(), first[unknown]
            self._learn(hashes[unknown], [raw[a:b].decode() for a, b in zip(starts[places].tolist(), ends[places].tolist(), strict=True)])
            at = np.searchsorted(self.keys, hashes)
        n = self.n[at][which]
        stop = np.cumsum(n, dtype=np.int64)
        total = int(stop[-1]) if len(stop) else 0
        ids = self.pool[np.repeat(self.start[at][which] - (stop - n), n) + np.arange(total)]
        return ids, np.bincount(row, weights=n, minlength=len(offsets) - 1).astype(np.int64)


def token_pieces(docs: DataFrame, tokenizer_path: str, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids): each document's ids and ``end_id``, cut at every ``sequence``.

    ``ids`` are unsigned 32-bit little-endian numbers. A null text is empty and has the end id alone.
    Repeated rows give repeated pieces. The vocabulary file must be at the same path on every executor; a
    task has its tokenizer and chunks of its own, and lets go of both at its end.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = ChunkIds(tokenizer_path)
        for batch in slices(batches, "text", SLICE_BYTES):
            found, counts = cache.encode(*text_bytes(batch.column("text")))
            rows = len(counts)
            total = counts + 1
            # every row's ids are followed by the end id
            ids = np.full(len(found) + rows, end_id, "<u4")
            ids[np.arange(len(found)) + np.repeat(np.arange(rows), counts)] = found
            pieces = -(-total // sequence)
            owner = np.repeat(np.arange(rows), pieces)
            start = (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * sequence
            length = np.minimum(total[owner] - start, sequence)
            bounds = np.concatenate([[0], np.cumsum(length)]) * 4
            raw = pa.Array.from_buffers(pa.binary(), len(owner), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(owner)), pa.array(start), pa.array(length), pa.array(total[owner]), raw], ["doc_id", "start", "length", "doc_tokens", "ids"])
        del cache
        release_memory()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, start long, length long, doc_tokens long, ids binary")


def knapsack(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The best value within ``capacity`` with any number of each item, and how many of each."""
    best = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if fits[c]:
            total = values[: fits[c]] + best[c - sizes[: fits[c]]]
            i = int(total.argmax())
            if total[i] > best[c]:
                best[c], choice[c] = total[i], i
    counts = np.zeros(len(sizes), int)
    c = capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            counts[choice[c]] += 1
            c -= sizes[choice[c]]
    return float(best[capacity]), counts


def cutting_patterns(demand: dict[int, int], capacity: int, max_columns: int = MAX_COLUMNS) -> list[tuple[dict[int, int], int]]:
    """[(pieces by size, sequences cut that way)] that meet the demand exactly.

    The linear program minimises the number of sequences. It starts with patterns of one size and takes
    in the pattern that the knapsack prices best until none is better than 1. Its basis is rounded down,
    and what is left is filled largest first.
    """
    sizes = np.array(sorted(s for s, n in demand.items() if n > 0), int)
    if not len(sizes):
        return []
    wanted = np.array([demand[int(s)] for s in sizes], float)
    patterns = np.diag(capacity // sizes).astype(float)
    inverse = np.diag(1.0 / np.diag(patterns))
    amounts = inverse @ wanted
    for _ in range(max_columns):
        prices = inverse.sum(axis=0)
        value, column = knapsack(prices, sizes, capacity)
        if value <= 1 + 1e-7:
            break
        direction = inverse @ column
        ratio = np.where(direction > 1e-9, amounts / np.where(direction > 1e-9, direction, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        step = ratio[out]
        amounts = np.maximum(amounts - step * direction, 0)
        amounts[out] = step
        patterns[:, out] = column
        inverse[out] /= direction[out]
        others = direction.copy()
        others[out] = 0
        inverse -= np.outer(others, inverse[out])
    left = wanted.astype(int)
    found = []
    for j in np.argsort(-amounts, kind="stable"):
        column = patterns[:, j].astype(int)
        used = column > 0
        times = int(min(np.floor(amounts[j] + 1e-6), (left[used] // column[used]).min())) if used.any() else 0
        if times > 0:
            found.append(({int(s): int(k) for s, k in zip(sizes[used], column[used], strict=True)}, times))
            left = left - times * column
    while left.any():
        room, pattern = capacity, {}
        for i in range(len(sizes) - 1, -1, -1):
            k = min(int(left[i]), room // int(sizes[i]))
            if k:
                pattern[int(sizes[i])] = k
                left[i] -= k
                room -= k * int(sizes[i])
        times = max(1, min((int(left[np.searchsorted(sizes, s)]) + k) // k for s, k in pattern.items()))
        for s, k in pattern.items():
            left[np.searchsorted(sizes, s)] -= k * (times - 1)
        found.append((pattern, times))
    return found


def pack(pieces: DataFrame, sequence: int = SEQUENCE, unit: int = UNIT, order: tuple = ("doc_id", "start")) -> DataFrame:
    """The rows of ``pieces`` with sequence_id and offset.

    ``pieces`` has ``length`` (1 to ``sequence``) and is read several times, so it should be a table.
    Lengths are counted in units; the histogram, of at most ``sequence / unit`` numbers, is all that
    comes to the driver, where the patterns are made. Pieces of one size are ranked, in two levels so
    that a size may hold any share of all rows, and a rank tells the pattern, the sequence and the
    place. Rows alike in all ``order`` columns are interchangeable. No pieces give no rows; columns
    named sequence_id or offset are replaced.
    """
    spark = pieces.sparkSession
    keep = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    named, names = aside(pieces.select(*[f"`{c}`" for c in keep]), ["length", *order])
    sized = named.withColumn("_size", F.ceil(F.col("length") / unit).cast("int"))
    demand = {r["_size"]: r["n"] for r in sized.groupBy("_size").agg(F.count("*").alias("n")).collect()}
    slots: dict[int, list] = {}
    filled: dict[int, int] = {}
    base = 0
    for pattern, times in cutting_patterns(demand, -(-sequence // unit)):
        for size, each in pattern.items():
            slots.setdefault(size, []).append((filled.get(size, 0), each, base))
            filled[size] = filled.get(size, 0) + each * times
        base += times
    table = small_table(spark, sorted(slots.items()), "_slot_size int, _slots array<struct<first: long, each: long, base: long>>")
    cell = F.pmod(F.xxhash64(*order), F.lit(CELLS))
    celled = sized.withColumn("_cell", cell)
    counts = celled.groupBy("_size", "_cell").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_size").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("_size").alias("_s"), F.col("_cell").alias("_c"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_size", "_cell").orderBy(*order, "length")
    ranked = celled.withColumn("_nth", F.row_number().over(within) - 1).join(starts, (F.col("_size") == F.col("_s")) & (F.col("_cell") == F.col("_c")))
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_nth")).join(table, F.col("_size") == F.col("_slot_size"))
    slot = F.element_at(F.filter("_slots", lambda s: s["first"] <= F.col("_rank")), -1)
    placed = ranked.withColumn("_slot", slot).withColumn("sequence_id", (F.col("_slot.base") + F.floor((F.col("_rank") - F.col("_slot.first")) / F.col("_slot.each"))).cast("long"))
    earlier = Window.partitionBy("sequence_id").orderBy(F.desc("_size"), "_rank").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0)).cast("long")).select(*[F.col(names[c]).alias(c) for c in keep], "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, sequence: int = SEQUENCE, unit: int = UNIT) -> DataFrame:
    """Pieces of all documents with their sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    pieces = token_pieces(docs, tokenizer_path, sequence).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return pack(materialize(pieces, "pieces"), sequence, unit, ("doc_id", "start", "ids_crc32"))
