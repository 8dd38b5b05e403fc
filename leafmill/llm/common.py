"""Small pieces that several operators of this folder share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Number of white-space separated words; null counts as an empty text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n (a null id counts as an empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that the named text column of each part stays near ``max_bytes``.

    A part has one row at least, so a single text may be larger.
    """
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        start = 0
        ends = np.cumsum(sizes)
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def fresh(name: str, columns: list[str]) -> str:
    """A column name that none of ``columns`` has, in any case of letters."""
    taken = {c.lower() for c in columns}
    while f"_{name}".lower() in taken:
        name = f"_{name}"
    return f"_{name}"


def aside(df: DataFrame, used: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with all columns but the ``used`` ones under names that no operator uses, and those names.

    What an operator adds can then not clash with a column that only passes through.
    """
    hidden = {c: c if c in used else f"_aside_{i}" for i, c in enumerate(df.columns)}
    return df.select(*[F.col(f"`{c}`").alias(name) for c, name in hidden.items()]), hidden


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Arrow batches of whole texts stay small: the setting counts rows, and a text may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def release_memory() -> None:
    """Gives the memory that a task is done with back to the system: Python workers live on."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        # only the C library of Linux has it
        ctypes.CDLL(None).malloc_trim(0)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column laid end to end, and the n + 1 offsets of its rows; null is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Polynomial hashes of any substring of a byte buffer, modulo 2**64, from one prefix sum."""

    BASE = 0x9E3779B97F4A7C15 | 1
    # Powers for so many bytes are kept; those of longer buffers are made anew and go with them.
    KEPT = 1 << 18
    _kept: tuple = ()

    @classmethod
    def _powers(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n <= cls.KEPT and cls._kept:
            return cls._kept
        made = []
        for base in (cls.BASE, pow(cls.BASE, -1, 1 << 64)):
            powers = np.full(max(n, cls.KEPT), base, np.uint64)
            powers[0] = 1
            np.cumprod(powers, out=powers)
            made.append(powers)
        if n <= cls.KEPT:
            cls._kept = tuple(made)
        return made[0], made[1]

    def __init__(self, data: np.ndarray):
        up, self.down = self._powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def all_of_width(self, width: int) -> np.ndarray:
        n = len(self.sums) - width
        return mix64((self.sums[width:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (in the buffer) of all words, and the row each belongs to."""
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    word = np.zeros(len(data) + 1, bool)
    word[:-1] = ~blank
    first = word[:-1].copy()
    first[1:] &= blank[:-1]
    cut = offsets[1:-1][offsets[1:-1] < len(data)]
    first[cut] = word[:-1][cut]
    starts = np.flatnonzero(first)
    ends = np.empty(len(starts), np.int64)
    if len(starts):
        # a word ends before the next blank, or where the next row's word begins
        stop = np.flatnonzero(blank)
        at = np.searchsorted(stop, starts)
        ends = np.where(at < len(stop), stop[np.minimum(at, len(stop) - 1)] if len(stop) else len(data), len(data))
        row = np.searchsorted(offsets, starts, side="right") - 1
        ends = np.minimum(ends, offsets[row + 1])
        return starts, ends, row
    return starts, ends, np.zeros(0, np.int64)
