"""Approximate nearest neighbours with a permutation index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

# Pivots are a sample of so many vectors; a vector is posted under half of them, nearest first. With random
# directions in 64 dimensions that leaves 97 to 99 % of the five nearest among the tenth of least footrule.
PIVOTS = 256
DEPTH = 128
# Of its pivots, the nearest ones whose inverted files a query reads.
QUERY_LISTS = 64
# Rows of a block of vectors, queries of a block of queries.
BLOCK_ROWS = 8192
BLOCK_QUERIES = 8192
# Of a block's vectors, the share that is compared exactly, those of smallest footrule first (ties too).
RERANK_SHARE = 0.1
# Vectors of a block that are compared exactly at least.
LEAST_RERANKED = 64


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): vectors as doubles, without nulls, zero vectors and those with bad components."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.where(F.coalesce(fine, F.lit(False))).where(F.exists("v", lambda x: x != 0))


def _matrix(column: pa.Array | list | pd.Series) -> np.ndarray:
    return np.array([np.asarray(x, dtype=np.float64) for x in column])


def units(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1; the largest component is scaled to 1 first, so that no square over- or underflows."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def permutations(unit: np.ndarray, pivots: np.ndarray, depth: int) -> np.ndarray:
    """The numbers of the ``depth`` nearest pivots of each row, nearest first."""
    near = unit.astype(np.float32) @ pivots.T.astype(np.float32)
    depth = min(depth, len(pivots))
    top = np.argpartition(-near, depth - 1, axis=1)[:, :depth] if depth < len(pivots) else np.tile(np.arange(len(pivots)), (len(unit), 1))
    order = np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable")
    return np.take_along_axis(top, order, 1).astype(np.int32)


def postings(ranked: np.ndarray, n_pivots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inverted files of a block: (rows, their ranks, start of each pivot's list)."""
    rows, ranks = np.divmod(np.arange(ranked.size), ranked.shape[1])
    order = np.argsort(ranked.ravel(), kind="stable")
    starts = np.searchsorted(ranked.ravel()[order], np.arange(n_pivots + 1))
    return rows[order], ranks[order], starts


def footrule_gain(query: np.ndarray, index: tuple, n: int, depth: int) -> np.ndarray:
    """By how much the footrule distance of each row is below that of a row with no common pivot.

    A pivot missing from a list has rank ``depth``: with a common pivot of ranks a and b the distance
    is |a - b| instead of (depth - a) + (depth - b).
    """
    rows, ranks, starts = index
    gain = np.zeros(n, np.int32)
    for rank, pivot in enumerate(query):
        part = slice(starts[pivot], starts[pivot + 1])
        # 2 depth - a - b - |a - b|
        gain[rows[part]] += 2 * (depth - np.maximum(ranks[part], rank))
    return gain


def pivot_sample(vectors: DataFrame, wanted: int = PIVOTS) -> list:
    """A bounded sample of the different vectors: those whose contents hash lowest."""
    return [r["v"] for r in vectors.select("v", F.xxhash64("v").alias("h")).orderBy("h").limit(wanted).collect()]


ANSWERS = "query_id long, rank int, vec_id long, score double"


def search(
    vectors: DataFrame, query_modulus: int = 50, k: int = 5, n_pivots: int = PIVOTS, depth: int = DEPTH, query_lists: int = QUERY_LISTS, rerank_share: float = RERANK_SHARE,
    block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """The ``k`` nearest found of every vector whose id is divisible by ``query_modulus``.

    Returns (query_id, rank, vec_id, score), score being the cosine in doubles; ties go to the smaller
    id. Vectors that are null, zero or not finite take no part; null ids neither. Vectors of different
    lengths are no neighbours: each length has an index of its own. Equal vectors are one entry with its
    k + 1 smallest ids, which is all that can be among the nearest, so a vector that a third of the rows
    share is searched once. Rows that repeat an id are vectors of their own, except that a query is never
    its own neighbour. Fewer than k other vectors give them all; an empty table gives no rows.

    Every row is posted under its ``depth`` nearest pivots. Blocks of vectors meet blocks of queries;
    in each such task a query reads the inverted files of its ``query_lists`` nearest pivots, ranks the rows
    found by footrule distance and compares the best exactly. Only its k best leave the task.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    smallest = rows.withColumn("n", place).where(F.col("n") <= k + 1)
    entries = materialize(smallest.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "vectors")
    asked = materialize(rows.where(F.col("vec_id") % query_modulus == 0), "queries")
    sizes = {r["size"]: r["n"] for r in entries.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).collect()}
    met = None
    for width, n in sorted(sizes.items()):
        of_width = F.size("v") == width
        distinct = asked.where(of_width).select("v").distinct()
        found = _met(entries.where(of_width), distinct, n, k, n_pivots, depth, query_lists, rerank_share, block_rows, block_queries)
        met = found if met is None else met.unionByName(found)
    if met is None:
        return spark.createDataFrame([], ANSWERS)
    # queries keep all their ids: equal queries are searched once and answered each
    answers = met.join(asked.select(F.col("v").alias("qv"), F.col("vec_id").alias("query_id")).distinct(), "qv").where("vec_id <> query_id")
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = answers.select("query_id", "vec_id", "score").withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _met(entries: DataFrame, queries: DataFrame, n: int, k: int, n_pivots: int, depth: int, query_lists: int, rerank_share: float, block_rows: int, block_queries: int) -> DataFrame:
    """(qv, vec_id, score): the nearest of each query in each block of ``entries``, all of one length."""
    pivots = units(_matrix(pivot_sample(entries, n_pivots)))
    depth = min(depth, len(pivots))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block_rows):
                part = batch.slice(at, block_rows)
                ranked = permutations(units(_matrix(part.column("v").to_pylist())), pivots, depth)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, ranked.size + 1, ranked.shape[1], dtype=np.int32)), pa.array(ranked.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("v"), part.column("ids"), lists], ["v", "ids", "pivots"])

    posted = materialize(entries.mapInArrow(post, "v array<double>, ids array<long>, pivots array<int>"), "postings")
    queries = materialize(queries.join(posted.select("v", "pivots"), "v"), "query-postings")
    row_blocks, query_blocks = -(-n // block_rows), max(1, -(-queries.count() // block_queries))
    by_hash = lambda blocks: F.pmod(F.xxhash64("v"), F.lit(blocks)).cast("int")
    right = posted.withColumn("rb", by_hash(row_blocks)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    left = queries.withColumn("qb", by_hash(query_blocks)).withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))))

    def meet(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        out = {"qv": [], "vec_id": [], "score": []}
        if len(q) and len(r):
            qv, rv = units(_matrix(q["v"])), units(_matrix(r["v"]))
            index = postings(np.stack(list(r["pivots"])), len(pivots))
            ids = [np.asarray(x) for x in r["ids"]]
            budget = max(int(np.ceil(rerank_share * len(r))), LEAST_RERANKED, 4 * k)
            for i, query in enumerate(q["pivots"]):
                gain = footrule_gain(np.asarray(query)[:query_lists], index, len(r), depth)
                least = np.partition(gain, len(r) - budget)[len(r) - budget] if len(r) > budget else 0
                # ties too; rows without a common pivot only where there are not enough others
                found = np.flatnonzero(gain >= least)
                cosine = np.clip(rv[found] @ qv[i], -1, 1)
                # as many different vectors as can matter, ties at the cut too
                if len(found) > k + 1:
                    close = cosine >= np.partition(cosine, len(found) - k - 1)[len(found) - k - 1]
                    found, cosine = found[close], cosine[close]
                pairs = sorted((-c, int(x)) for c, f in zip(cosine, found, strict=True) for x in ids[f])[: 2 * k + 2]
                out["qv"] += [q["v"].iloc[i]] * len(pairs)
                out["vec_id"] += [x for _, x in pairs]
                out["score"] += [-c for c, _ in pairs]
        return pd.DataFrame(out)

    return left.groupBy("rb", "qb").cogroup(right.groupBy("rb", "qb")).applyInPandas(meet, "qv array<double>, vec_id long, score double")
