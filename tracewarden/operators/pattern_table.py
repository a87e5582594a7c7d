"""Matching a text column against a table of LIKE patterns, without a test per row and pattern.

Different texts are matched once each. A text meets the patterns with which it shares up to three
letters: those that begin the longest literal stretch of a pattern, which every match must
contain. Only these pairs are tested. Patterns of wildcards alone meet every different text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3


def _longest_literal(pattern: Column) -> Column:
    """The longest stretch between wildcards, lower-cased; escaped characters end one, so that none is misread."""
    stretches = F.split(F.regexp_replace(F.lower(pattern), r"\\.", "%"), "[%_]")
    return F.array_max(F.transform(stretches, lambda s: F.struct(F.length(s).alias("n"), s.alias("s"))))["s"]


def _grams(text: Column) -> Column:
    """All different runs of up to ``GRAM`` characters, the empty one too."""

    def runs(size: int) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.length(text) - (size - 1), F.lit(1)))
        return F.transform(places, lambda k: F.substring(text, k, size))

    return F.array_distinct(F.flatten(F.array(F.array(F.lit("")), *[runs(n) for n in range(1, GRAM + 1)])))


def matched_patterns(texts: DataFrame, column: str, patterns: DataFrame, pattern: str = "pattern") -> DataFrame:
    """(column, columns of ``patterns``): each different text of ``column`` with each pattern that it is like, in any case.

    ``_`` is one character, ``%`` any number, a backslash escapes them. Null texts and
    patterns match nothing. Join the result to what has the texts.
    """
    values = texts.where(F.col(column).isNotNull()).select(column).distinct()
    gram = F.substring(_longest_literal(F.col(pattern)), 1, GRAM)
    known = patterns.where(F.col(pattern).isNotNull()).withColumn("_gram", gram)
    met = values.withColumn("_gram", F.explode(_grams(F.lower(column)))).join(known, "_gram")
    return met.where(F.expr(f"`{column}` ILIKE `{pattern}`")).drop("_gram")
