"""Date ranges of the reports. Dates are ``YYYY-MM-DD`` strings."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

LAST_N_CHOICES = (1, 3, 7, 14, 30)


def _shift(day: str, days: int) -> str:
    return (date.fromisoformat(day) + timedelta(days=days)).isoformat()


def default_last_7(date_from, date_to, first, last):
    """The given range, or the last 7 days available when none is given."""
    if date_from or date_to or not last:
        return date_from, date_to
    return max(_shift(last, -6), first), last


def last_n(n: int, last: str) -> tuple[str, str]:
    """The ``n`` days that end on the latest date with data."""
    return _shift(last, 1 - n), last


def compare(date_from, date_to, last: str) -> tuple[str, str, str, str]:
    """Current range and the range of the same length right before it."""
    if not (date_from and date_to):
        date_from, date_to = _shift(last, -6), last
    span = (date.fromisoformat(date_to) - date.fromisoformat(date_from)).days + 1
    return date_from, date_to, _shift(date_from, -span), _shift(date_from, -1)


def date_list(date_from: str, date_to: str) -> list[str]:
    days = (date.fromisoformat(date_to) - date.fromisoformat(date_from)).days
    return [_shift(date_from, i) for i in range(days + 1)]


def trend(current: Column, previous: Column) -> tuple[Column, Column]:
    """Percent change (NULL when there is no previous value) and its direction.

    The direction is ``flat`` below half a percent, ``new`` when the previous value is 0, else ``up`` or ``down``.
    """
    cur, prev = (F.coalesce(c.cast("double"), F.lit(0.0)) for c in (current, previous))
    pct = F.try_divide((cur - prev) * F.lit(100.0), F.abs(prev))
    direction = (
        F.when(prev == 0, F.when(cur == 0, F.lit("flat")).otherwise(F.lit("new")))
        .when(F.abs(pct) < 0.5, F.lit("flat")).when(pct > 0, F.lit("up")).otherwise(F.lit("down"))
    )
    return pct, direction
