"""Running caps over record tables and skew-safe prefix sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def record_bytes(columns: Sequence[str]) -> Column:
    """UTF-8 size of a record as compact JSON."""
    return F.octet_length(F.to_json(F.struct(*columns))).cast("long")


def _limited(df: DataFrame, total: Column, limit: Column | int | None, drop: bool, name: str) -> DataFrame:
    """Rows up to the limit, or with ``drop=False`` all rows with their running total and ``over_limit``."""
    if not drop:
        return df.withColumn(name, total).withColumn("over_limit", F.lit(False) if limit is None else F.col(name) > limit)
    return df if limit is None else df.filter(total <= limit)


def row_cap(df: DataFrame, pos: str = "row_pos", max_rows: int | None = None, *, drop: bool = True) -> DataFrame:
    """The first rows of each page, all where no limit is asked for; ``pos`` counts from 0 within the page.

    ``drop=False`` returns all rows with ``total_rows`` and ``over_limit``.
    """
    return _limited(df, F.col(pos) + 1, max_rows, drop, "total_rows")


def prefix_sum(
    df: DataFrame,
    group: Sequence[str],
    chunk: Sequence[str],
    order: Sequence[str],
    value: str,
    out: str,
) -> DataFrame:
    """Running sum of ``value`` per group, computed in two levels.

    ``chunk`` columns split a group into consecutive ordered pieces (a page, an hour, a block of
    positions). Rows are only gathered per chunk; a hot group therefore spreads over many tasks,
    and only one row per chunk passes through the group-level window.
    """
    within = W.partitionBy(*group, *chunk).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    totals = df.groupBy(*group, *chunk).agg(F.sum(value).alias("_chunk_sum"))
    before = W.partitionBy(*group).orderBy(*chunk).rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.withColumn("_offset", F.coalesce(F.sum("_chunk_sum").over(before), F.lit(0))).drop("_chunk_sum")
    return (
        df.withColumn("_within", F.sum(value).over(within))
        .join(offsets, [*group, *chunk])
        .withColumn(out, F.col("_offset") + F.col("_within"))
        .drop("_offset", "_within")
    )


def byte_cap_page(
    df: DataFrame, page: Sequence[str], pos: str, columns: Sequence[str], max_bytes: int | None = None, *, drop: bool = True
) -> DataFrame:
    """Rows of a page up to ``max_bytes`` of JSON, all where no limit is asked for.

    A page holds few rows, so one window serves. ``drop=False`` returns all rows with ``total_bytes``
    and ``over_limit``.
    """
    if drop and max_bytes is None:
        return df
    w = W.partitionBy(*page).orderBy(pos).rowsBetween(W.unboundedPreceding, 0)
    sized = df.withColumn("_bytes", record_bytes(columns))
    summed = sized.withColumn("_total", F.sum("_bytes").over(w))
    return _limited(summed, F.col("_total"), max_bytes, drop, "total_bytes").drop("_bytes", "_total")


def byte_cap_run(
    df: DataFrame,
    run: str,
    page: str,
    pos: str,
    columns: Sequence[str],
    max_bytes: int | None = None,
    *,
    drop: bool = True,
) -> DataFrame:
    """Rows of a run up to ``max_bytes`` of JSON over its pages in order, all where no limit is asked for.

    Later pages go too. ``drop=False`` returns all rows with ``total_bytes`` and ``over_limit``.
    """
    if drop and max_bytes is None:
        return df
    sized = df.withColumn("_bytes", record_bytes(columns))
    summed = prefix_sum(sized, [run], [page], [pos], "_bytes", "_total")
    return _limited(summed, F.col("_total"), max_bytes, drop, "total_bytes").drop("_bytes", "_total")


def page_cap(df: DataFrame, max_pages: Column | int | None = None, page: str = "page_index", *, drop: bool = True) -> DataFrame:
    """Rows of the first pages of each run, of all where no limit is asked for; ``page`` counts from 0.

    ``drop=False`` returns all rows with ``total_pages`` and ``over_limit``.
    """
    return _limited(df, F.col(page) + 1, max_pages, drop, "total_pages")
