"""Fill statistics of extracted records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, unnest


def hit_rate(filled: Column, sampled: Column) -> Column:
    """Rounded percentage, 0 without a sample."""
    return F.when(sampled > 0, F.floor(filled * 100 / sampled + 0.5)).otherwise(0).cast("int")


def probe(extracted: DataFrame, fields: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Per page and field: matched, sampled, filled and hit rate. Narrow: counts arrays in place."""

    def one(name: str, pos: int) -> Column:
        filled = F.size(F.filter("records", lambda r: ~is_blank(r[name])))
        return F.struct(F.lit(pos).alias("field_pos"), F.lit(name).alias("field_name"), filled.alias("filled"))

    rows = unnest(
        extracted, [*keys, "matched", F.size("records").alias("sampled")],
        F.array(*[one(n, i) for i, n in enumerate(fields)]), "_i", "_f",
    )
    return rows.select(
        *keys, "matched", "sampled", "_f.*",
        hit_rate(F.col("_f.filled"), F.col("sampled")).alias("hit_rate"),
    )


def fill_rates(records: DataFrame, group: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Per group and field over all records: sampled, filled and hit rate, one aggregation."""
    counted = records.groupBy(*group).agg(
        F.count(F.lit(1)).alias("sampled"),
        *[F.count_if(~is_blank(F.col(f))).alias(f"_n{i}") for i, f in enumerate(fields)],
    )
    rows = unnest(
        counted, [*group, "sampled"],
        F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"_n{i}").alias("filled")) for i, f in enumerate(fields)]),
        "field_pos", "_f",
    )
    return rows.select(
        *group, "sampled", "field_pos", "_f.*", hit_rate(F.col("_f.filled"), F.col("sampled")).alias("hit_rate")
    )


def empty_fields(rates: DataFrame) -> DataFrame:
    """Fields that stayed empty although there were records."""
    return rates.filter((F.col("sampled") > 0) & (F.col("filled") == 0))
