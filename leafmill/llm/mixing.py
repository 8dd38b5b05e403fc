"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import aside, n_words

MAX_PASSES = 3
# A document is served in pieces of so many words, so that a long one doesn't hold up its source.
QUANTUM = 256
# Cells of the two-level running sums: a window holds one cell's rows, never a source's.
CELLS = 4096


def source_targets(sizes: DataFrame, weights: list[int], max_passes: int = MAX_PASSES) -> DataFrame:
    """(source, source_size, position, weight, target): weights repeat over the sources in code point order,
    null last. A target stops at ``max_passes`` times its source's size and the excess is reshared by
    weight. The water level is the largest of the levels got by filling up the sources one after the
    other, from the one that fills first. One row per source passes through these windows.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("position") % len(weights) + 1).cast("int"))
    placed = per_source.withColumn("position", (F.row_number().over(by_name) - 1).cast("long")).withColumn("weight", weight.cast("long"))
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), "position")
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_fill.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        placed.withColumn("cap", F.col("source_size") * max_passes)
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(onward))
        .withColumn("level", F.max("level").over(everything))
        .select("source", "source_size", "position", "weight", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))
    )


def running_total(df: DataFrame, group: list[str], cell: Column, order: list, value: str) -> DataFrame:
    """Adds ``total``: the sum of ``value`` up to and with the row's peers, within ``group`` in the
    order of ``order``. ``cell`` must be monotone in that order; only one row per cell passes through
    the group's window, and each cell is summed on its own.
    """
    df = df.withColumn("_cell", cell)
    sums = df.groupBy(*group, "_cell").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*[F.col(g).alias(f"_{g}") for g in group], F.col("_cell").alias("_at"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    same = F.col("_cell") == F.col("_at")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
    inside = Window.partitionBy(*group, "_cell").orderBy(*order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        df.withColumn("_part", F.sum(value).over(inside))
        .join(base, same)
        .withColumn("total", F.col("_base") + F.col("_part"))
        .drop("_cell", "_at", "_base", "_part", *[f"_{g}" for g in group])
    )


def _pieces(max_passes: int, quantum: int) -> Column:
    """The pieces of a row of ``mix-places``: words, and the words of the source up to their end."""
    n = F.ceil(F.col("size") / quantum)

    def piece(k: Column) -> Column:
        nth = F.pmod(k, n)
        words = F.least(F.lit(quantum).cast("long"), F.col("size") - nth * quantum)
        upto = F.floor(k / n) * F.col("source_size") + F.col("start") + nth * quantum + words
        return F.struct(words.cast("long").alias("words"), upto.cast("long").alias("upto"))

    return F.transform(F.sequence(F.lit(0).cast("long"), n * max_passes - 1), piece)


def _queued(pieces: DataFrame, name: str) -> DataFrame:
    """The pieces (position, weight, words, upto) of all sources in the order of their virtual finish times,
    with ``finish`` and ``total``, the words up to there: a range sort, and a sum within each range."""
    key = F.struct((F.col("upto") / F.col("weight")).alias("finish"), "position", "upto")
    queue = pieces.withColumn("key", key).sort("key").withColumn("part", F.spark_partition_id())
    queue = materialize(queue.select("key", "position", "weight", "words", "upto", "part", F.lit(0).alias("all")), name)
    return running_total(queue, ["all"], F.col("part"), [F.col("key")], "words").withColumn("finish", F.col("key.finish"))


def mix(docs: DataFrame, weights: list[int] = [1, 2, 3], budget_share: float = 1.0, seed: str = "mix", max_passes: int = MAX_PASSES, quantum: int = QUANTUM) -> DataFrame:
    """One row per document: (doc_id, source, size, source_size, target, taken).

    Within its source every document has a place in a shuffled order (md5 of seed and id). A word has a
    virtual finish time, the words of its source up to it over the source's weight, and a source goes
    round ``max_passes`` times. The words of all sources are put in the order of their finish times and
    kept while their running sum is within ``budget_share`` of all words. So sources advance in step with
    their weights, and a source that has gone round drops out and leaves its share to the others; its
    target is computed beside the queue. The queue is sorted in pieces of ``quantum`` words first, and only
    the pieces that are being served around the cut once more word by word.

    Null texts and texts without words have size 0 and nothing is taken from them. A null source is a
    source of its own. Rows that share an id are documents of their own, null ids are placed by md5 of
    their texts; rows alike in id, source and size are interchangeable. An empty table gives no rows.
    Other columns are not read.
    """
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit(" "), F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    shuffled = F.md5(F.concat(F.lit(seed), name).cast("binary"))
    sizes = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), shuffled.alias("place"))
    sizes = materialize(sizes.withColumn("row", F.monotonically_increasing_id()), "mix-sizes")
    cell = F.conv(F.substring("place", 1, 3), 16, 10).cast("int")
    placed = running_total(sizes, ["source"], cell, [F.struct("place", "size", "row")], "size")
    targets = source_targets(sizes, weights, max_passes).withColumnRenamed("source", "_source")
    placed = placed.join(targets, F.col("source").eqNullSafe(F.col("_source"))).withColumn("start", F.col("total") - F.col("size"))
    placed = materialize(placed.select("doc_id", "source", "size", "source_size", "position", "weight", "target", "start"), "mix-places")
    pieces = placed.where("size > 0").select("position", "weight", F.inline(_pieces(max_passes, quantum)))
    queue = materialize(_queued(pieces, "mix-queue").drop("key"), "mix-served")
    budget = F.floor(F.lit(budget_share) * sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).scalar())
    # the first piece beyond the budget, or the end of the queue; what is served with whole pieces lags by a piece at most
    end = queue.agg(F.coalesce(F.min(F.when(F.col("total") > budget, F.col("finish"))), F.max("finish") + 1)).scalar()
    sure = end - quantum / min(weights)
    before = F.coalesce(queue.where(F.col("finish") <= sure).agg(F.sum("words")).scalar(), F.lit(0))
    open_ = queue.where((F.col("finish") > sure) & ((F.col("upto") - F.col("words")) / F.col("weight") < end))
    each = open_.select("position", "weight", F.lit(1).cast("long").alias("words"), F.explode(F.sequence(F.col("upto") - F.col("words") + 1, F.col("upto"))).alias("upto"))
    near = _queued(each, "mix-words").where(before + F.col("total") <= budget)
    served = queue.where(F.col("finish") <= sure).select("position", "upto").unionByName(near.select("position", "upto"))
    served = served.groupBy(F.col("position").alias("_position")).agg(F.max("upto").alias("served"))
    decided = placed.join(served, F.col("position") == F.col("_position"), "left")
    left = F.coalesce("served", F.lit(0)) - F.col("start")
    taken = sum(F.greatest(F.lit(0), F.least(F.col("size"), left - i * F.col("source_size"))) for i in range(max_passes))
    return decided.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights: list[int] = [1, 2, 3]) -> DataFrame:
    """The documents of the mix, with the columns of ``docs``: each as often as its taken words make
    whole texts, to the nearest. Rows alike in id, source and size share their decision."""
    decisions = mix(docs, weights).groupBy("doc_id", "source", "size").agg(F.avg(F.col("taken") / F.greatest("size", F.lit(1))).alias("share"))
    decisions = decisions.withColumn("times", F.floor(F.col("share") + 0.5).cast("int")).where("times > 0")
    right = decisions.select(F.col("doc_id").alias("id"), F.col("source").alias("from"), "size", "times")
    left, names = aside(docs, ["doc_id", "source", "text"])
    joined = left.withColumn("words", n_words(F.col("text"))).join(
        right, F.col("doc_id").eqNullSafe(F.col("id")) & F.col("source").eqNullSafe(F.col("from")) & (F.col("words") == F.col("size"))
    )
    copies = joined.withColumn("copy", F.explode(F.sequence(F.lit(1), "times")))
    return copies.select(*[F.col(hidden).alias(c) for c, hidden in names.items()])


def mix_sql() -> str:
    """The queue of single words."""
    return """
WITH sizes AS (
    SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
           md5('mix' || coalesce(CAST(doc_id AS VARCHAR), ' ' || md5(coalesce(text, '')))) AS place
    FROM documents
),
sources AS (
    SELECT source, source_size, position, 1 + (position % 3) AS weight, 3 * source_size AS cap, sum(source_size) OVER () AS total
    FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
                 row_number() OVER (ORDER BY source IS NULL, source) - 1 AS position FROM sizes GROUP BY source)
),
levels AS (
    SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / sum(weight) OVER (ORDER BY cap / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM sources
),
targets AS (SELECT source, source_size, position, weight, total, least(CAST(cap AS DOUBLE), max(level) OVER () * weight) AS target FROM levels),
placed AS (
    SELECT row_number() OVER () AS nth, doc_id, s.source, size, source_size, target, weight, position, total,
           sum(size) OVER (PARTITION BY s.source ORDER BY place, size ROWS UNBOUNDED PRECEDING) - size AS before
    FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
),
words AS (
    SELECT nth, weight, position, total, CAST(pass * source_size + before + unnest(range(1, size + 1)) AS BIGINT) AS upto
    FROM (SELECT *, unnest([0, 1, 2]) AS pass FROM placed)
),
queue AS (SELECT nth, total, row_number() OVER (ORDER BY upto::DOUBLE / weight, position, upto) AS served FROM words),
taken AS (SELECT nth, count(*) AS taken FROM queue WHERE served <= total GROUP BY nth)
SELECT doc_id, size, source_size, target, source, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM placed LEFT JOIN taken USING (nth)
"""
