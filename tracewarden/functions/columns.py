"""Column expressions shared by several reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(rows: DataFrame, *columns: Column) -> DataFrame:
    """``rows`` with costly columns that are evaluated exactly once per row.

    As plain columns they would be copied into every filter and projection above
    that mentions them (a JSON record parsed four times, a text upper-cased
    eight times). The optimizer does not copy a generator's output; filters on
    other columns still pass below it and reach the scan.
    """
    return rows.select("*", F.inline(F.array(F.struct(*columns))))


def ratio_pct(part: Column, whole: Column, digits: int = 2) -> Column:
    """``part / whole * 100``; NULL where ``whole`` is 0."""
    return F.round(part.cast("double") / F.nullif(whole, F.lit(0)) * 100, digits)


def weighted_pct(part: Column, whole: Column, digits: int = 2) -> Column:
    """``part * 100 / whole``; differs from :func:`ratio_pct` in the last bit at times."""
    return F.round(part.cast("double") * 100 / F.nullif(whole, F.lit(0)), digits)


def count_where(condition: Column) -> Column:
    """Conditional count that is NULL, not 0, for an empty input (as SUM is)."""
    return F.sum(F.when(condition, 1).otherwise(0))


def exact_avg(value: Column, scale: int) -> Column:
    """Average of values with at most ``scale`` decimals, independent of row order.

    Summing scaled integers keeps the result identical whatever the partitioning
    or task retries, which a sum of doubles does not.
    """
    unit = 10**scale
    scaled = F.round(value * unit).cast("bigint")
    return F.sum(scaled) / (F.count(value) * unit)


def large_sum(value: Column) -> Column:
    """Sum of whole numbers that may leave the range of 64 bits (bytes and rows of large scans)."""
    return F.sum(value.cast("decimal(38,0)"))


def preview(text: Column, length: int) -> Column:
    return F.left(text, F.lit(length))


def level(rate: Column, steps: Sequence[tuple[int, str]], default: str) -> Column:
    """First label whose threshold the rate exceeds."""
    label = F.when(rate > steps[0][0], steps[0][1])
    for threshold, name in steps[1:]:
        label = label.when(rate > threshold, name)
    return label.otherwise(default)


def matches_any(text: Column, patterns: Sequence[str], ignore_case: bool = False) -> Column:
    """True where ``text`` matches one of the LIKE patterns."""
    tests = [text.ilike(p) if ignore_case else text.like(p) for p in patterns]
    found = tests[0]
    for test in tests[1:]:
        found = found | test
    return found


def active_hours(hour: Column) -> Column:
    """Number of distinct hours of day, as one bitmap per group.

    Hours have 24 values, so a 24-bit OR replaces COUNT(DISTINCT): the aggregate
    stays a single partial+final pass without a second shuffle.
    """
    bit = F.call_function("shiftleft", F.lit(1), hour)
    return F.coalesce(F.bit_count(F.bit_or(bit)), F.lit(0)).cast("bigint")


# NULL counts as the largest value: last when ascending, first when descending.
def ascending(name: str) -> Column:
    return F.col(name).asc_nulls_last()


def descending(name: str) -> Column:
    return F.col(name).desc_nulls_first()
