"""Result view: search, missing-value filter, keep-first de-duplication, natural sort, preview."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, natural_key, trim_all

ALL_FIELDS = "__all__"
COLLATION = "zh_CI_AI"


def _scope(fields: Sequence[str], column: str) -> list[str]:
    return [column] if column in fields else list(fields)


def _any(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns, F.lit(False))


def keyword_filter(df: DataFrame, fields: Sequence[str], query: str, column: str = "") -> DataFrame:
    """Rows with the trimmed query as a case-insensitive substring of any field in scope."""
    wanted = query.strip().lower()
    if not wanted:
        return df
    return df.filter(
        _any([F.contains(F.lower(F.coalesce(F.col(f), F.lit(""))), F.lit(wanted)) for f in _scope(fields, column)])
    )


def missing_filter(df: DataFrame, fields: Sequence[str], empty: str, column: str = "") -> DataFrame:
    """``missing`` keeps rows with a blank field in scope, ``filled`` rows without one."""
    if empty == "all":
        return df
    missing = _any([is_blank(F.col(f)) for f in _scope(fields, column)])
    return df.filter(missing if empty == "missing" else ~missing)


def dedupe_first(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Keeps the first row (by ``order``, unique) of equal keys; all-blank keys never merge.

    Rows meet by a 128-bit digest of their keys, and only the digest and the order value of a key's first
    row are aggregated, with map-side combine: a key shared by a third of all rows shrinks to one small
    row per map task before the shuffle. The rows themselves are then picked by their order value. A second,
    independent hash of 64 bits stands beside the digest.
    """
    values = [F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("")) for k in keys]
    blank = reduce(lambda a, b: a & b, [is_blank(v) for v in values])
    # lengths keep ("a", "bc") and ("ab", "c") apart
    digest = F.unhex(F.md5(F.concat(*[F.concat(F.length(v).cast("string"), F.lit(":"), v) for v in values]).cast("binary")))
    keyed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{order}`").alias("at"), digest.alias("digest"), F.xxhash64(*values).alias("check"), blank.alias("blank"))
    firsts = keyed.where(~F.col("blank")).groupBy("digest", "check").agg(F.min("at").alias("at")).select("at")
    kept = keyed.where(~F.col("blank")).join(firsts, "at", "left_semi").unionByName(keyed.where("blank"))
    return kept.select("row.*")


def dedupe_keys(fields: Sequence[str], dedupe: str) -> list[str]:
    if dedupe == ALL_FIELDS:
        return list(fields)
    return [dedupe] if dedupe in fields else []


def natural_order(column: str, order: str, descending: bool = False) -> list[Column]:
    """Sort columns: numeric-aware Chinese collation ignoring case and accents; ties keep order."""
    key = F.collate(natural_key(F.col(column)), COLLATION)
    return [key.desc() if descending else key.asc(), F.col(order).asc()]


def select_rows(
    df: DataFrame,
    fields: Sequence[str],
    order: str,
    *,
    query: str = "",
    column: str = "",
    empty: str = "all",
    dedupe: str = "",
    sort: str = "",
    descending: bool = False,
) -> DataFrame:
    """Filter, then de-duplicate, then sort. ``order`` is the unique position of a row."""
    out = missing_filter(keyword_filter(df, fields, query, column), fields, empty, column)
    keys = dedupe_keys(fields, dedupe)
    if keys:
        out = dedupe_first(out, keys, order)
    if sort in fields:
        out = out.orderBy(*natural_order(sort, order, descending))
    return out


def view_counts(df: DataFrame, fields: Sequence[str], order: str, **options) -> DataFrame:
    """One row: filtered_count, shown_count and removed_count of a view."""
    column = options.get("column", "")
    kept = missing_filter(
        keyword_filter(df, fields, options.get("query", ""), column), fields, options.get("empty", "all"), column
    )
    keys = dedupe_keys(fields, options.get("dedupe", ""))
    if not keys:
        total = F.count(F.lit(1))
        return kept.agg(total.alias("filtered_count"), total.alias("shown_count"), F.lit(0).cast("long").alias("removed_count"))
    blank = reduce(lambda a, b: a & b, [is_blank(F.col(k)) for k in keys])
    per_key = kept.groupBy(*[F.coalesce(F.col(k), F.lit("")).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(
        F.count(F.lit(1)).alias("_n"), F.first(blank).alias("_blank")
    )
    shown = F.when(F.col("_blank"), F.col("_n")).otherwise(1)
    return per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("filtered_count"),
        F.coalesce(F.sum(shown), F.lit(0)).alias("shown_count"),
        F.coalesce(F.sum(F.col("_n") - shown), F.lit(0)).alias("removed_count"),
    )


def preview_page(df: DataFrame, order: Sequence[Column], page: int = 0, size: int = 10) -> DataFrame:
    """Page ``page`` of the ordered view with a zero-padded row number; a distributed top-k."""
    rows = df.orderBy(*order).offset(page * size).limit(size)
    # The page itself is at most ``size`` rows, so numbering it in one task is bounded.
    numbered = rows.withColumn("_i", F.monotonically_increasing_id())
    number = (F.col("_i") + page * size + 1).cast("string")
    return numbered.select(F.lpad(number, F.greatest(F.length(number), F.lit(2)), F.lit("0")).alias("row_no"), *df.columns)


def page_count(df: DataFrame, size: int = 10) -> DataFrame:
    return df.agg(F.ceil(F.count(F.lit(1)) / size).alias("pages"))


def is_link(c: Column) -> Column:
    """True for a cell that is exactly one http(s) URL."""
    return F.coalesce(c, F.lit("")).rlike(r"(?i)^https?://\S+$")


def cell_text(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) == "", "—").otherwise(c)


def filled(c: Column) -> Column:
    return trim_all(F.coalesce(c, F.lit(""))) != ""
