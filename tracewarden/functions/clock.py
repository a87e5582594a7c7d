"""The reference time. Every relative window is computed from an explicit ``as_of``."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def instant(as_of: datetime) -> Column:
    """``as_of`` as a zone-less timestamp literal, so comparisons reach the scan."""
    return F.lit(as_of.isoformat(sep=" ")).cast("timestamp_ntz")


def today(as_of: datetime) -> Column:
    return F.lit(as_of.date())


def days_before(as_of: datetime, days: int) -> Column:
    """Start of a window counted from a point in time."""
    return instant(as_of) - F.expr(f"INTERVAL {int(days)} DAY")


def hours_before(as_of: datetime, hours: int) -> Column:
    return instant(as_of) - F.expr(f"INTERVAL {int(hours)} HOUR")


def months_before(as_of: datetime, months: int) -> Column:
    return instant(as_of) - F.expr(f"INTERVAL {int(months)} MONTH")


def dates_before(as_of: datetime, days: int) -> Column:
    """Start of a window counted in calendar days."""
    return F.date_sub(today(as_of), int(days))


def date_months_before(as_of: datetime, months: int) -> Column:
    return F.add_months(today(as_of), -int(months))
