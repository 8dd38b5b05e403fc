"""N-gram Jaccard join by chosen paths."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import Rolling, aside, mix64, slices, text_bytes, word_spans

SHINGLE_WORDS = 5
THRESHOLD = 0.8
TARGET_RECALL = 0.9999
# A bucket with more sets is split on a further token, up to MAX_DEPTH tokens.
BUCKET_SETS = 256
MAX_DEPTH = 4
# Minimum hashes of a set that travel with it; pairs whose sketches agree less are not looked at again.
SKETCH = 128
SKETCH_AGREEMENT = 0.5
# Shingles of one block of a large class.
BLOCK_SHINGLES = 1_000_000
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def run_recall(depth: int) -> float:
    """The chance at least that a pair at the threshold shares a path of ``depth`` tokens in one run.

    A set within the other goes on with one common token a level on average, sets of equal size with more.
    """
    chance = 1.0
    for _ in range(depth):
        chance = 1 - np.exp(-chance)
    return float(chance)


def runs_for(recall: float, depth: int = MAX_DEPTH) -> int:
    """How often to repeat so that a pair at the threshold is met with the given chance at any depth up to ``depth``."""
    return max(1, int(np.ceil(np.log(1 - recall) / np.log(1 - run_recall(depth)))))


def shingle_sets(column: pa.Array, words: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """The different shingles of each text as sorted hashes. Texts of fewer words are one shingle of all
    their words; texts without words have none."""
    data, offsets = text_bytes(column)
    starts, ends, row = word_spans(data, offsets)
    n = len(offsets) - 1
    count = np.bincount(row, minlength=n)[:n]
    hashes = Rolling(data).of(starts, ends)
    first = np.cumsum(count) - count
    shingles = np.zeros(len(hashes), np.uint64)
    for i in range(words):
        part = hashes[i:] if i else hashes
        # beyond the end of a short text nothing is added
        inside = np.arange(len(part)) + i < (first + count)[row[: len(part)]]
        shingles[: len(part)] = mix64(shingles[: len(part)] * np.uint64(3) + np.where(inside, part, np.uint64(i + 1)))
    valid = np.maximum(count - words + 1, np.minimum(count, 1))
    return [np.unique(shingles[f : f + v]) for f, v in zip(first, valid, strict=True)]


def sketches(tokens: np.ndarray, row: np.ndarray, n: int, size: int = SKETCH) -> np.ndarray:
    """For each of ``n`` sets, one byte of the smallest token in each of ``size`` orders (one permutation,
    empty bins filled from the bin that a fixed probe finds). ``row`` is the set of each token; no set is empty."""
    none = np.uint64(np.iinfo(np.uint64).max)
    mixed = mix64(tokens ^ np.uint64(0xA5A5A5A55A5A5A5A))
    bins = (mixed >> np.uint64(57)).astype(np.int64) % size
    least = np.full(n * size, none, np.uint64)
    np.minimum.at(least, row * size + bins, mixed & np.uint64((1 << 57) - 1))
    filled = least.copy()
    empty = np.flatnonzero(least == none)
    probe = 0
    while len(empty):
        probe += 1
        to = (mix64(np.arange(size, dtype=np.uint64) * _GOLDEN + np.uint64(probe)) % np.uint64(size)).astype(np.int64)
        bin_of = empty % size
        at = least[empty - bin_of + to[bin_of]]
        found = at != none
        filled[empty[found]] = at[found]
        empty = empty[~found]
    return (mix64(filled) >> np.uint64(56)).astype(np.uint8).reshape(n, size)


def _limits(sizes: np.ndarray, threshold: float) -> np.ndarray:
    """The hash up to which a token of a set of each size is chosen: with chance 1 / (threshold times size)."""
    return np.minimum(2.0**64 / (threshold * sizes), 2.0**64 - 2048).astype(np.uint64)


def next_paths(tokens: np.ndarray, path: np.uint64, threshold: float) -> np.ndarray:
    """The paths that a set takes from ``path``: each token is chosen by a hash of path and token."""
    hashes = mix64(tokens + path)
    chosen = hashes <= _limits(np.array([len(tokens)]), threshold)[0]
    return mix64(hashes[chosen] + _GOLDEN)


def first_paths(tokens: np.ndarray, row: np.ndarray, sizes: np.ndarray, seeds: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The paths that many sets take from each seed, set by set, and the n + 1 offsets of the sets."""
    limits = _limits(sizes, threshold)[row]
    rows, paths = [], []
    for seed in seeds:
        hashes = mix64(tokens + seed)
        chosen = np.flatnonzero(hashes <= limits)
        rows.append(row[chosen])
        paths.append(mix64(hashes[chosen] + _GOLDEN))
    rows = np.concatenate(rows)
    order = np.argsort(rows, kind="stable")
    return np.concatenate(paths)[order], np.append(0, np.cumsum(np.bincount(rows, minlength=len(sizes))))


def _seeds(runs: int) -> np.ndarray:
    return mix64(np.arange(1, runs + 1, dtype=np.uint64) * _GOLDEN)


def describe(docs: DataFrame, runs: int, words: int, threshold: float) -> DataFrame:
    """(row_key, set_key, n, sketch, paths) for each document that has a word: its first paths of all runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = _seeds(runs)
        for batch in slices(batches, "text", 4 << 20):
            sets = shingle_sets(batch.column("text"), words)
            some = [i for i, s in enumerate(sets) if len(s)]
            if not some:
                continue
            sets = [sets[i] for i in some]
            sizes = np.array([len(s) for s in sets])
            tokens, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
            paths, ends = first_paths(tokens, row, sizes, seeds, threshold)
            columns = {
                "row_key": batch.column("row_key").take(pa.array(some, pa.int64())),
                "set_key": pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                "n": pa.array(sizes.astype(np.int64)),
                "sketch": pa.array([s.tobytes() for s in sketches(tokens, row, len(sets))], pa.binary()),
                "paths": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(paths.view(np.int64))),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return docs.select("row_key", "text").mapInArrow(run, "row_key binary, set_key binary, n long, sketch binary, paths array<long>")


def _split(texts: DataFrame, words: int, threshold: float, levels: int) -> DataFrame:
    """(set_key, level, ways): the paths that go on from each of the large buckets (``hot``) of a set, those
    that go on from these, and so on for ``levels`` levels; texts are read once for all. ``ways`` has a
    parent and its paths; parents from which nothing goes on are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            keys, depths, sizes, parents, paths = [], [], [], [], []
            for key, tokens, hot in zip(batch.column("set_key").to_pylist(), shingle_sets(batch.column("text"), words), batch.column("hot").to_pylist(), strict=True):
                ends = np.array(hot, np.int64).view(np.uint64)
                for level in range(1, levels + 1):
                    new = [(p, on) for p in ends if len(on := next_paths(tokens, p, threshold))]
                    if not new:
                        break
                    keys.append(key)
                    depths.append(level)
                    sizes.append(len(new))
                    parents += np.array([p for p, _ in new]).view(np.int64).tolist()
                    paths += [on.view(np.int64) for _, on in new]
                    ends = np.concatenate([on for _, on in new])
            ways = pa.StructArray.from_arrays([pa.array(parents, pa.int64()), pa.array(paths, pa.list_(pa.int64()))], ["parent", "paths"])
            ways = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), ways)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(depths, pa.int32()), ways], ["set_key", "level", "ways"])

    return texts.select("set_key", "text", "hot").mapInArrow(run, "set_key binary, level int, ways array<struct<parent: long, paths: array<long>>>")


def loose_edges(sketches: np.ndarray, agreement: float) -> list[tuple[int, int]]:
    """Edges that join the rows into the groups that chains of agreeing sketches make.

    Each row is held once against those that no group has yet, so a bucket of near copies takes few
    rounds; other buckets are small.
    """
    edges = []
    left = np.arange(len(sketches))
    least = agreement * sketches.shape[1]
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            i = queue.pop()
            close = (sketches[left] == sketches[i]).sum(axis=1) >= least
            edges += [(int(i), int(j)) for j in left[close]]
            queue += left[close].tolist()
            left = left[~close]
    return edges


def _bucket_edges(members: DataFrame, agreement: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, keys, sketches = None, [], []

        def edges() -> pa.RecordBatch:
            rows = np.frombuffer(b"".join(sketches), np.uint8).reshape(len(sketches), -1)
            found = loose_edges(rows, agreement)
            return pa.RecordBatch.from_arrays([pa.array([keys[a] for a, _ in found], pa.binary()), pa.array([keys[b] for _, b in found], pa.binary())], ["a", "b"])

        for batch in batches:
            for p, key, s in zip(batch.column("path").to_pylist(), batch.column("set_key").to_pylist(), batch.column("sketch").to_pylist(), strict=True):
                if p != path and len(keys) > 1:
                    yield edges()
                if p != path:
                    path, keys, sketches = p, [], []
                keys.append(key)
                sketches.append(s)
        if len(keys) > 1:
            yield edges()

    return members.repartition("path").sortWithinPartitions("path", "set_key").mapInArrow(run, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each connected component, for all nodes of the edges.

    Every round each node takes the smallest root that it or a neighbour has, and then the root of
    that root; rounds go on until nothing changes. Tables between rounds are written to the shared folder.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = materialize(both, "edges")
    roots = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "roots")
    while True:
        offered = both.join(roots, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("offer"))
        lower = roots.join(offered, F.col("node") == F.col("a"), "left").select("node", "root", F.least("root", "offer").alias("next"))
        of_root = roots.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        jumped = lower.join(of_root, F.col("next") == F.col("_n"), "left").select("node", F.least("next", "_r").alias("root"), (F.least("next", "_r") < F.col("root")).alias("moved"))
        table = materialize(jumped, "roots")
        roots = table.select("node", "root")
        if table.where("moved").isEmpty():
            return roots


def exact_links(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """(row of left, rows of right that are similar enough); without ``right`` within left, later rows only.

    Shared tokens are counted as products of 0/1 matrices, for some thousand tokens at a time.
    """
    others = left if right is None else right
    tokens = np.concatenate([*left, *(right or [])])
    _, ids, counts = np.unique(tokens, return_inverse=True, return_counts=True)
    common = np.cumsum(counts > 1) - 1
    n_common = int(common[-1]) + 1 if len(common) else 0
    sizes = [np.array([len(s) for s in x]) for x in (left, others)]
    row = np.repeat(np.arange(len(sizes[0]) + (len(sizes[1]) if right else 0)), np.concatenate([sizes[0], sizes[1] if right else np.zeros(0, int)]))
    useful = counts[ids] > 1
    row, column = row[useful], common[ids[useful]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    shared = np.zeros((len(left), len(others)), np.float32)
    width = 4096
    for at in range(0, n_common, width):
        part = slice(*np.searchsorted(column, [at, at + width]))
        block = np.zeros((len(sizes[0]) + (len(sizes[1]) if right else 0), width), np.float32)
        block[row[part], column[part] - at] = 1
        shared += block[: len(left)] @ (block[len(left) :] if right else block).T
    for i in range(len(left)):
        # shared >= t * (a + b - shared), in whole numbers up to rounding
        close = shared[i] >= threshold * (sizes[0][i] + sizes[1] - shared[i]) - 1e-6
        if right is None:
            close[: i + 1] = False
        found = np.flatnonzero(close)
        if len(found):
            yield i, found


def _class_links(members: DataFrame, words: int, threshold: float) -> DataFrame:
    """(a, b, links): exact comparison within tiles of classes.

    Rows with a = b say how many copies of similar sets the tile gives to a set; the others are the
    edges that join the tile's sets into connected groups.
    """

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("set_key")
        sets = shingle_sets(pa.array(frame["text"], pa.large_string()), words)
        keys, copies, side = frame["set_key"].tolist(), frame["copies"].to_numpy(), frame["side"].to_numpy()
        one = frame["tile_a"].iloc[0] == frame["tile_b"].iloc[0]
        first = np.flatnonzero(side == 0)
        second = first if one else np.flatnonzero(side == 1)
        links = np.zeros(len(frame), np.int64)
        parent = list(range(len(frame)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        joins = []
        for i, found in exact_links([sets[x] for x in first], None if one else [sets[x] for x in second], threshold):
            a, b = int(first[i]), second[found]
            links[a] += copies[b].sum()
            links[b] += copies[a]
            for x in b.tolist():
                if root(a) != root(x):
                    parent[root(x)] = root(a)
                    joins.append((a, x))
        rows = np.flatnonzero(links).tolist()
        return pd.DataFrame({"a": [keys[x] for x in rows] + [keys[a] for a, _ in joins], "b": [keys[x] for x in rows] + [keys[b] for _, b in joins], "links": [int(links[x]) for x in rows] + [0] * len(joins)})

    return members.groupBy("class", "tile_a", "tile_b").applyInPandas(meet, "a binary, b binary, links long")


def join_documents(docs: DataFrame, threshold: float = THRESHOLD, words: int = SHINGLE_WORDS, recall: float = TARGET_RECALL, bucket_sets: int = BUCKET_SETS, max_depth: int = MAX_DEPTH) -> DataFrame:
    """One row per document: (row_key, doc_id, class_id, class_key, n_links).

    Documents are sets of shingles of ``words`` lower-case words between white space; a text of fewer
    words is one shingle. Two documents are linked at a Jaccard similarity of ``threshold`` or more, and
    n_links counts the linked documents, copies too. A class is a connected set of documents; its id is
    the smallest doc_id in it. Texts without words, null ones too, are linked to nothing, and are
    classes of their own. Rows that repeat are documents of their own, linked to each other. A null
    doc_id counts as larger than all others; a class of such rows has a null id. Ids may be null or stand
    for several documents, so classes may share an id; class_key tells them apart and is null for texts
    without words. Other columns are not read. An empty table gives no rows.

    Equal sets are one set with a number of copies. Each run every set chooses tokens by a common hash,
    so similar sets tend to choose the same; sets that chose the same path share a bucket. Large
    buckets are split on further tokens. Within buckets sketches of the sets are compared (a bucket that
    stays large at the greatest depth is one of near copies, and is not cut). ``recall`` sets the number
    of runs, for buckets of the greatest depth. What agrees loosely is compared exactly, whole class against whole class: large classes in
    tiles of bounded size.
    """
    runs = runs_for(recall, max_depth)
    text = F.lower(F.coalesce("text", F.lit("")))
    source = docs.select("doc_id", text.alias("text")).withColumn("row_key", F.unhex(F.md5(F.to_binary(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(" "), "text"), F.lit("utf-8")))))
    table = materialize(describe(source, runs, words, threshold), "sets")
    one = [F.first(c).alias(c) for c in ("n", "sketch", "paths")]
    sets = materialize(table.groupBy("set_key").agg(F.min("row_key").alias("row_key"), F.count("*").alias("copies"), *one), "set-copies")
    paths = sets.select("set_key", F.explode("paths").alias("path"))
    texts = leaves = splits = None
    for depth in range(1, max_depth + 1):
        counts = paths.groupBy("path").agg(F.count("*").alias("size")).where("size > 1")
        sized = materialize(paths.join(counts, "path"), "bucket-members")
        hot = sized.where(F.col("size") > bucket_sets)
        if depth == 1:
            # only sets that share a bucket are looked at again, so only their texts move from here on
            by_set = hot.groupBy("set_key").agg(F.collect_list("path").alias("hot"))
            rows = sets.select("set_key", "row_key", "copies").join(sized.select("set_key").distinct(), "set_key").join(by_set, "set_key", "left")
            texts = source.join(rows, "row_key").dropDuplicates(["row_key"]).select("set_key", "text", "copies", "hot")
            texts = materialize(texts, "bucket-texts")
        cold = sized if depth == max_depth else sized.where(F.col("size") <= bucket_sets)
        leaves = cold.select("set_key", "path") if leaves is None else leaves.unionByName(cold.select("set_key", "path"))
        if depth == max_depth or hot.isEmpty():
            break
        if depth == 1:
            splits = materialize(_split(texts.where("hot is not null"), words, threshold, max_depth - 1), "splits")
        # few rows that become many: dealt out first, so that every task makes its share
        further = splits.where(F.col("level") == depth).repartition("set_key")
        if depth > 1:
            # the first level goes on from large buckets only; a set brings all its large buckets in one row
            by_set = hot.groupBy("set_key").agg(F.collect_list("path").alias("hot"))
            further = further.join(by_set, "set_key").withColumn("ways", F.filter("ways", lambda w: F.array_contains("hot", w["parent"])))
        paths = materialize(further.select("set_key", F.explode(F.flatten("ways.paths")).alias("path")), "paths")
    edges = _bucket_edges(leaves.join(sets.select("set_key", "sketch"), "set_key"), SKETCH_AGREEMENT)
    classes = materialize(components(materialize(edges, "loose-edges")), "loose-classes")
    members = classes.select(F.col("node").alias("set_key"), F.col("root").alias("class")).join(sets.select("set_key", "n"), "set_key")
    tiles = members.groupBy("class").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("tiles"))
    tiled = members.join(tiles, "class").withColumn("own", F.pmod(F.xxhash64("set_key"), F.col("tiles")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    tiled = tiled.withColumn("other", other).select(
        "class", "set_key", F.least("own", "other").alias("tile_a"), F.greatest("own", "other").alias("tile_b"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side")
    )
    compared = texts.drop("hot").join(tiled, "set_key")
    links = materialize(_class_links(compared, words, threshold), "links")
    exact = components(links.select("a", "b"))
    n_links = links.groupBy(F.col("a").alias("_a")).agg(F.sum("links").alias("others"))
    keyed = source.select("row_key", "doc_id").join(table.select("row_key", "set_key").distinct(), "row_key", "left")
    copies = sets.select(F.col("set_key").alias("_s"), "copies")
    full = (
        keyed.join(copies, F.col("set_key") == F.col("_s"), "left")
        .join(exact, F.col("set_key") == F.col("node"), "left")
        .join(n_links, F.col("set_key") == F.col("_a"), "left")
        .withColumn("root", F.coalesce("root", "set_key"))
        .withColumn("n_links", F.coalesce(F.col("copies") - 1, F.lit(0)) + F.coalesce("others", F.lit(0)))
    )
    full = materialize(full.select("row_key", "doc_id", "root", F.col("n_links").cast("long").alias("n_links")), "document-links")
    ids = full.where("root is not null").groupBy(F.col("root").alias("_root")).agg(F.min("doc_id").alias("class_id"))
    joined = full.join(ids, F.col("root") == F.col("_root"), "left")
    return joined.select("row_key", "doc_id", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.col("root").alias("class_key"), "n_links")


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` without those that are linked to a document of their class with a smaller place.

    Of each class the document with the smallest doc_id stays, null ids last; of rows that repeat it, one does.
    """
    key = F.unhex(F.md5(F.to_binary(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(" "), F.lower(F.coalesce("text", F.lit("")))), F.lit("utf-8"))))
    found = join_documents(docs.select("doc_id", "text"), **how)
    named, names = aside(docs, ["doc_id", "text"])
    # rows without links stay as they are; of linked rows the first of each class
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")
    first = found.where("n_links > 0").groupBy("class_key").agg(F.min(place)["row_key"].alias("row_key")).select("row_key")
    linked = found.where("n_links > 0").select(F.col("row_key").alias("_lk")).distinct()
    keyed = named.withColumn("_key", key)
    alone = keyed.join(linked, F.col("_key") == F.col("_lk"), "left_anti")
    chosen = keyed.join(first, F.col("_key") == F.col("row_key"), "left_semi").dropDuplicates(["_key"])
    return alone.unionByName(chosen).select(*[F.col(hidden).alias(c) for c, hidden in names.items()])
