"""Exact medians of integer values without gathering a group in one task, whatever their range."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# A power of two: parts that each doubling of values is cut into, and of a part that is cut again.
PARTS = 4096
SMALLER_PARTS = 65_536
_LARGEST = (1 << 63) - 1


def part_of(value: Column, parts: int = PARTS) -> Column:
    """Number of the part that a 64-bit value lies in, in the order of values.

    Up to ``parts`` every value is a part of its own; then each doubling is cut into ``parts`` equal ones. So
    all values of a group lie in some 50 times ``parts`` parts at most, however far apart they are.
    """
    bits = parts.bit_length() - 1
    size = F.abs(F.greatest(value, F.lit(-_LARGEST)))
    shift = F.greatest(F.length(F.bin(size)) - 1 - bits, F.lit(0))
    part = (shift * parts + F.call_function("shiftright", size, shift.cast("int"))).cast("bigint")
    return F.when(value < 0, -part).otherwise(part)


def exact_medians(
    histogram: DataFrame,
    keys: Sequence[str],
    value: str,
    times: str,
    parts: int = PARTS,
    smaller_parts: int = SMALLER_PARTS,
) -> DataFrame:
    """Interpolated median per ``keys`` out of rows that count each value once.

    Values are first counted by :func:`part_of`, which shows in which one or two parts the middle
    ranks lie. These are cut evenly into ``smaller_parts`` and counted again; only the values
    of the one or two smaller parts found then are put in order. Both counts have a bounded number
    of rows per group, and a smaller part holds few different values (one, if the part holds
    no more than ``smaller_parts``). Groups without a value are left out.

    NULL values get a NULL part and no count, which no condition below selects.
    Filtering them out instead would reach below the histogram's aggregation,
    and Spark would compute it once per use rather than share it.
    """
    counted = F.when(F.col(value).isNotNull(), F.col(times))
    rows = histogram.withColumn("_part", part_of(F.col(value), parts))
    group = W.partitionBy(*keys)
    # Ranks count from 0; they are the same for an odd number of values.
    found = (
        rows.groupBy(*keys, "_part")
        .agg(F.sum(counted).alias("_n"), F.min(value).alias("_least"), F.max(value).alias("_most"))
        .withColumn("_before", _before(group.orderBy("_part")))
        .withColumn("_lower", F.floor((F.sum("_n").over(group) - 1) / 2))
        .withColumn("_upper", F.floor(F.sum("_n").over(group) / 2))
        .where(_holds_a_rank())
        # The difference of two 64-bit values may need more bits.
        .withColumn("_width", (F.expr(f"(CAST(_most AS DECIMAL(20, 0)) - _least) DIV {smaller_parts}") + 1).cast("bigint"))
    )
    inner = _within(rows, found, keys, ["_part"], ["_least", "_width", "_before", "_lower", "_upper"])
    cut = inner.withColumn("_smaller", F.expr(f"CAST((CAST({value} AS DECIMAL(20, 0)) - _least) DIV _width AS BIGINT)"))
    part = W.partitionBy(*keys, "_part")
    smaller = (
        cut.groupBy(*keys, "_part", "_smaller", "_lower", "_upper")
        .agg(F.sum(counted).alias("_n"), F.first("_before").alias("_of_part"))
        .withColumn("_before", F.col("_of_part") + _before(part.orderBy("_smaller")))
        .where(_holds_a_rank())
    )
    last = _within(cut.drop("_before", "_lower", "_upper"), smaller, keys, ["_part", "_smaller"], ["_before", "_lower", "_upper"])
    running = W.partitionBy(*keys, "_part", "_smaller").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    ranked = last.withColumn("_up_to", F.col("_before") + F.sum(times).over(running))

    def at_rank(rank: str) -> Column:
        return F.min(F.when(F.col("_up_to") > F.col(rank), F.col(value)))

    return ranked.groupBy(*keys).agg(((at_rank("_lower") + at_rank("_upper").cast("double")) / 2).alias("median"))


def _before(ordered: W) -> Column:
    return F.coalesce(F.sum("_n").over(ordered.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))


def _holds_a_rank() -> Column:
    return (F.col("_before") <= F.col("_upper")) & (F.col("_before") + F.col("_n") > F.col("_lower"))


def _within(rows: DataFrame, found: DataFrame, keys: Sequence[str], parts: Sequence[str], more: Sequence[str]) -> DataFrame:
    """The rows of the parts that were found, with ``more`` columns of these; keys may be NULL."""
    names = {k: f"_of_{k}" for k in (*keys, *parts)}
    same = F.lit(True)
    for name, other in names.items():
        same = same & F.col(name).eqNullSafe(F.col(other))
    return rows.join(found.select(*[F.col(k).alias(n) for k, n in names.items()], *more), same).drop(*names.values())
