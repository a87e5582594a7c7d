"""Tokens of a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_PATTERN = r"[\p{L}0-9]+"


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order, with repeats."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))
