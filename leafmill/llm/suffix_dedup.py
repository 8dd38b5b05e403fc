"""Exact substring deduplication on suffix arrays by two-stage sorting."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import Rolling, slices, text_bytes

WIDTH = 200
# Each window of WIDTH bytes is filed under its smallest substring of GRAM bytes, its anchor.
GRAM = 64
# Bytes of contexts in one suffix array.
ARRAY_BYTES = 2 << 20
# An anchor with more different contexts than this is not held in one array; see repeated_windows.
ANCHOR_CONTEXTS = 4096


def anchored_runs(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(row, start, count, anchor hash) of runs of windows that have the same anchor.

    Starts are buffer positions. The smallest hash wins, the leftmost of equal ones, so that equal
    windows have equal anchors at the same place wherever they stand.
    """
    n = len(data) - width + 1
    empty = np.zeros(0, np.int64)
    if n <= 0:
        return empty, empty, empty, empty
    hashes = Rolling(data).all_of_width(gram)
    bits = np.uint64(max(24, len(data).bit_length()))
    least = ((hashes >> bits) << bits) | np.arange(len(hashes), dtype=np.uint64)
    reach, wanted = 1, width - gram + 1
    while 2 * reach <= wanted:
        least = np.minimum(least[: len(least) - reach], least[reach:])
        reach *= 2
    if wanted > reach:
        least = np.minimum(least[: len(least) - (wanted - reach)], least[wanted - reach :])
    anchor = (least[:n] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    lengths = np.diff(offsets)
    starts = np.arange(n)
    valid = np.zeros(len(data) + 1, np.int32)
    fits = lengths >= width
    np.add.at(valid, offsets[:-1][fits], 1)
    np.add.at(valid, (offsets[1:] - width + 1)[fits], -1)
    inside = np.cumsum(valid)[:n] > 0
    first = inside.copy()
    first[1:] &= ~inside[:-1] | (anchor[1:] != anchor[:-1])
    # rows that touch: a window of the next row starts a run of its own
    heads = offsets[:-1][fits]
    first[heads] = True
    at = starts[first]
    row = np.searchsorted(offsets[1:], at, side="right")
    after = np.append(at[1:], n)
    count = np.minimum(after, offsets[row + 1] - width + 1) - at
    return row, at, count, hashes[anchor[at]].view(np.int64)


def two_stage_order(x: np.ndarray, needed_end: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """The order of the suffixes of ``x`` that begin between ``starts`` and ``needed_end``, by ``depth`` bytes.

    Suffixes that are smaller than their successors are sorted directly. Every other suffix is a byte
    before a smaller suffix, so a scan of the buckets of first bytes in ascending order places it: the
    predecessors of a finished bucket go, in its order, to the ends of their own buckets.
    ``needed_end`` must be smaller than its successor's start and of the first kind.
    """
    n = len(x)
    direct = _smaller_than_next(x)
    marks = np.zeros(n + 1, np.int32)
    np.add.at(marks, starts, 1)
    np.add.at(marks, needed_end + 1, -1)
    needed = np.cumsum(marks)[:n] > 0
    first_kind = np.flatnonzero(needed & direct)
    padded = np.concatenate([x, np.zeros(depth, np.uint8)])
    rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, depth)[first_kind])
    first_kind = first_kind[np.argsort(rows.view(f"S{depth}").ravel(), kind="stable")]
    bounds = np.searchsorted(x[first_kind], np.arange(257))
    induced = needed & ~direct
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in range(256):
        parts = []
        if waiting[c]:
            run = np.concatenate(waiting[c])
            while len(run):
                parts.append(run)
                run = run[run > 0] - 1
                run = run[induced[run] & (x[run] == c)]
        parts.append(first_kind[bounds[c] : bounds[c + 1]])
        bucket = np.concatenate(parts)
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[induced[before] & (x[before] > c)]
        if len(before):
            order = np.argsort(x[before], kind="stable")
            before = before[order]
            cut = np.flatnonzero(np.diff(x[before])) + 1
            for part in np.split(before, cut):
                waiting[x[part[0]]].append(part)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _smaller_than_next(x: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor; the last one, a terminator, counts as such."""
    step = np.diff(x.astype(np.int16), append=np.int16(256))
    different = np.where(step != 0, np.arange(len(x)), len(x) - 1)
    different = np.minimum.accumulate(different[::-1])[::-1]
    return step[different] > 0


def common_prefix_reaches(x: np.ndarray, a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    """Whether the suffixes at ``a`` and ``b`` share ``width`` bytes, eight at a time while they agree."""
    padded = np.concatenate([x, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    alive = np.arange(len(a))
    done = 0
    while done < width and len(alive):
        step = min(8, width - done)
        at = np.minimum(a[alive] + done, len(x)), np.minimum(b[alive] + done, len(x))
        if step == 8:
            alive = alive[words[at[0]].view(np.uint64).ravel() == words[at[1]].view(np.uint64).ravel()]
        else:
            alive = alive[(words[at[0], :step] == words[at[1], :step]).all(axis=1)]
        done += 8
    reaches = np.zeros(len(a), bool)
    reaches[alive] = True
    return reaches


def repeated_starts(contexts: list[bytes], counts: np.ndarray, copies: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """For the windows of all contexts laid end to end: whether the window stands elsewhere too.

    A context holds ``counts`` windows, one at each of its first bytes. UTF-8 has no byte 255, so bytes
    are moved up by one and 0 ends a context.
    """
    lengths = np.array([len(c) + 1 for c in contexts])
    base = np.cumsum(lengths) - lengths
    x = np.frombuffer(b"".join(c + b"\xff" for c in contexts), np.uint8) + np.uint8(1)
    direct = _smaller_than_next(x)
    places = np.where(direct, np.arange(len(x)), len(x) - 1)
    following = np.minimum.accumulate(places[::-1])[::-1]
    order = two_stage_order(x, following[base + counts - 1], base, width + 8)
    owner = np.repeat(np.arange(len(contexts)), counts)
    window = base[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    number = np.full(len(x), -1)
    number[window] = np.arange(len(window))
    order = order[number[order] >= 0]
    same = common_prefix_reaches(x, order[:-1], order[1:], width)
    repeated = copies[owner] > 1
    repeated[number[order[:-1][same]]] = True
    repeated[number[order[1:][same]]] = True
    return repeated


def _ranges(marks: np.ndarray) -> list[int]:
    """Starts and ends of the runs of true values, flat."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], marks, [False]]).astype(np.int8)))
    return edges.tolist()


def _contexts(found: DataFrame, width: int) -> DataFrame:
    """(tid, start, count, anchor, digest, context): the bytes of each run; a context that this task has
    already written is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in slices(batches, "text", 4 << 20):
            out = {"tid": [], "start": [], "count": [], "anchor": [], "digest": [], "context": []}
            for tid, text, runs in zip(batch.column("tid").to_pylist(), batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                data = text.encode()
                for r in runs:
                    context = data[r["start"] : r["start"] + r["count"] + width - 1]
                    digest = hashlib.blake2b(context, digest_size=16).digest()
                    out["tid"].append(tid)
                    out["start"].append(r["start"])
                    out["count"].append(r["count"])
                    out["anchor"].append(r["anchor"])
                    out["digest"].append(digest)
                    out["context"].append(None if digest in seen else context)
                    seen.add(digest)
                if len(seen) > 200_000:
                    seen.clear()
            types = (pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], list(out))

    return found.mapInArrow(run, "tid binary, start int, count int, anchor long, digest binary, context binary")


def repeated_windows(contexts: DataFrame, width: int, array_bytes: int = ARRAY_BYTES, anchor_contexts: int = ANCHOR_CONTEXTS) -> DataFrame:
    """(digest, ranges): which windows of each different context stand elsewhere too.

    ``contexts`` has anchor, digest, count, context, copies. Contexts with the same anchor come together,
    and as many whole anchors as fit make one suffix array. An anchor with more than ``anchor_contexts``
    of them could fill a task, so its windows are dealt out by their own bytes instead, each exactly.
    """
    sizes = contexts.groupBy("anchor").agg(F.count("*").alias("different"))
    sized = materialize(contexts.join(sizes, "anchor"), "sized-contexts")

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {"digest": [], "count": [], "context": [], "copies": []}
        anchor, size = None, 0

        def flush() -> pa.RecordBatch:
            counts = np.array(held["count"], np.int64)
            marks = repeated_starts(held["context"], counts, np.array(held["copies"]), width)
            found = [_ranges(part) for part in np.split(marks, np.cumsum(counts)[:-1])]
            some = [i for i, r in enumerate(found) if r]
            result = pa.RecordBatch.from_arrays([pa.array([held["digest"][i] for i in some], pa.binary()), pa.array([found[i] for i in some], pa.list_(pa.int32()))], ["digest", "ranges"])
            for values in held.values():
                values.clear()
            return result

        for batch in batches:
            for row in batch.to_pylist():
                if row["anchor"] != anchor and size > array_bytes:
                    yield flush()
                    size = 0
                anchor = row["anchor"]
                size += len(row["context"])
                for name, values in held.items():
                    values.append(row[name])
        if held["digest"]:
            yield flush()

    schema = "digest binary, ranges array<int>"
    columns = ("anchor", "digest", "count", "context", "copies")
    usual = sized.where(F.col("different") <= anchor_contexts).select(*columns)
    in_arrays = usual.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(arrays, schema)
    at = F.explode(F.sequence(F.lit(0), F.col("count") - 1))
    windows = sized.where(F.col("different") > anchor_contexts).select("digest", "copies", "context", at.alias("at"))
    windows = windows.select("digest", "at", "copies", F.unhex(F.md5(F.substring("context", F.col("at") + 1, F.lit(width)))).alias("window"))
    twice = windows.groupBy("window").agg(F.sum("copies").alias("n")).where("n > 1").select("window")
    dealt = windows.join(twice, "window").groupBy("digest").agg(F.flatten(F.collect_list(F.array("at", F.col("at") + 1))).alias("ranges"))
    return in_arrays.unionByName(dealt)


def removable(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, array_bytes: int = ARRAY_BYTES, anchor_contexts: int = ANCHOR_CONTEXTS) -> DataFrame:
    """(tid, ranges): for each different text, starts and ends of runs of repeated windows, flat, in any order.

    ``docs`` has tid and text.
    """

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offsets = text_bytes(batch.column("text"))
            row, at, count, anchors = anchored_runs(data, offsets, width, gram)
            ends = np.searchsorted(row, np.arange(len(offsets)))
            lists = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(v)) for v in ((at - offsets[row]).astype(np.int32), count.astype(np.int32), anchors)]
            yield pa.RecordBatch.from_arrays([batch.column("tid"), *lists], ["tid", "start", "count", "anchor"])

    all_runs = docs.select("tid", "text").mapInArrow(runs, "tid binary, start array<int>, count array<int>, anchor array<long>")
    all_runs = materialize(all_runs.where(F.size("start") > 0), "anchors")
    repeated = all_runs.select(F.explode("anchor").alias("anchor")).groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    each = all_runs.select("tid", F.inline(F.arrays_zip("start", "count", "anchor")))
    found = each.join(materialize(repeated, "repeated-anchors"), "anchor")
    by_text = materialize(found.groupBy("tid").agg(F.collect_set(F.struct("start", "count", "anchor")).alias("runs")), "repeated-runs")
    occurrences = materialize(_contexts(docs.select("tid", "text").join(by_text, "tid"), width), "contexts")
    different = occurrences.groupBy("anchor", "digest", "count").agg(F.max("context").alias("context"), F.count("*").alias("copies"))
    windows = materialize(repeated_windows(different, width, array_bytes, anchor_contexts), "repeated-windows")
    hits = occurrences.select("tid", "start", "digest").join(windows, "digest").select("tid", F.struct("start", "ranges").alias("hit"))
    moved = F.transform("hits", lambda hit: F.transform(hit["ranges"], lambda at: at + hit["start"]))
    return hits.groupBy("tid").agg(F.collect_set("hit").alias("hits")).select("tid", F.flatten(moved).alias("ranges"))


def dedup_substrings(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, array_bytes: int = ARRAY_BYTES, anchor_contexts: int = ANCHOR_CONTEXTS) -> DataFrame:
    """One row per document: (doc_id, kept, n_bytes, n_removed, n_spans); ``kept`` are the bytes left.

    Removes each byte covered by a string of ``width`` bytes that also starts anywhere else, in another
    document or elsewhere in the same one; overlaps count, and strings are judged on the input. Matches
    do not cross documents; texts shorter than ``width`` bytes lose nothing. A null text is empty. Rows
    that repeat are documents of their own, so their texts match each other. Cuts fall on bytes, so
    ``kept`` need not be valid UTF-8. Other columns are not read. An empty table gives no rows.

    Windows that could repeat are found through anchors: equal windows have equal anchors, so anchors
    that occur once set most of the text aside. The windows of the others go, with their surroundings,
    to suffix arrays built by two-stage sorting, where neighbours with a common prefix of ``width``
    bytes are the repeats.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    source = source.withColumn("tid", F.unhex(F.md5(F.col("text").cast("binary"))))
    spans = materialize(removable(source, width, gram, array_bytes, anchor_contexts), "repeats")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            data, offsets = text_bytes(batch.column("text"))
            ranges = batch.column("ranges")
            counts = np.asarray(pc.fill_null(pc.list_value_length(ranges), 0), np.int64)
            edges = np.asarray(pc.list_flatten(ranges), np.int64) + np.repeat(offsets[:-1], counts)
            marks = np.bincount(edges[0::2], minlength=len(data) + 1) - np.bincount(edges[1::2] + width - 1, minlength=len(data) + 1)
            gone = np.cumsum(marks)[:-1] > 0
            # a removed run begins after a byte that stays and at the start of a text
            heads = gone.copy()
            heads[1:] &= ~gone[:-1]
            starts = offsets[:-1][np.diff(offsets) > 0]
            heads[starts] = gone[starts]
            removed, n_spans = (np.append(0, np.cumsum(x))[offsets] for x in (gone, heads))
            left = (offsets - removed).astype(np.int32)
            kept = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(left), pa.py_buffer(data[~gone])])
            numbers = [pa.array(np.diff(x).astype(np.int64)) for x in (offsets, removed, n_spans)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), kept, *numbers], ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    joined = source.join(spans, "tid", "left").select("doc_id", "text", "ranges")
    return joined.mapInArrow(cut, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")
