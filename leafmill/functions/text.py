"""Text helpers: value binding, whitespace, natural sort keys."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"(?U)[\s\x{FEFF}]+"
EDGE_SPACES = r"(?U)^[\s\x{FEFF}]+|[\s\x{FEFF}]+$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates ``value`` once per row and hands it to ``body``."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``let`` for steps that run once a cell: its result isn't copied, as that of a transform is.

    It takes longer to plan, so it is for those only.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda bound, _: bound, body)


def count_upto(numbers: Column, limit: Column) -> Column:
    """How many of an array's rising numbers are not above ``limit``, by halving."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(30))])
    return F.aggregate(steps, F.lit(0), lambda at, by: F.when(F.get(numbers, at + by - 1) <= limit, at + by).otherwise(at))


def trim_all(c: Column) -> Column:
    """Trims every Unicode white space, not only blanks."""
    return F.regexp_replace(c, EDGE_SPACES, "")


def collapse(c: Column) -> Column:
    """Runs of white space become one blank; the ends are trimmed."""
    return F.trim(F.regexp_replace(c, SPACES, " "))


def is_blank(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(r"(?U)^[\s\x{FEFF}]*$")


def natural_key(c: Column, width: int = 20) -> Column:
    """Text whose plain order is numeric-aware: digit runs are zero-padded to ``width``.

    Leading zeros are dropped first, so 07 and 7 compare equal. Longer runs compare as text.
    """
    pieces = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\d+|\D+"), 0)

    def padded(p: Column) -> Column:
        digits = F.regexp_replace(p, r"^0+(?=\d)", "")
        return F.when(
            p.rlike(r"^\d"), F.when(F.length(digits) < width, F.lpad(digits, width, "0")).otherwise(digits)
        ).otherwise(p)

    return F.array_join(F.transform(pieces, padded), "")


def unnest(df: DataFrame, keep: Sequence, array: Column | str, pos: str, item: str) -> DataFrame:
    """One row per array entry.

    The outer generator plus a filter on its output keeps the optimizer from copying the whole
    array expression into an inferred size filter below.
    """
    array = F.col(array) if isinstance(array, str) else array
    rows = df.select(*keep, F.posexplode_outer(array).alias(pos, item))
    return rows.filter(F.col(pos).isNotNull())
