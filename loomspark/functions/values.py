"""Stored numbers and times read back as columns; what can't be read becomes null or zero, it fails nothing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

#: The first and last second that a timestamp can name.
FIRST_SECOND, LAST_SECOND = -62135596800, 253402300799


def _number(value) -> Column:
    """A number, or a text that is one; null for all else and for what isn't finite."""
    d = col(value).try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < F.lit(float("inf"))), d)


def epoch_seconds(at) -> Column:
    """Seconds since 1970 in UTC, with their fraction."""
    return F.unix_micros(col(at).cast("timestamp")) / F.lit(1e6)


def from_epoch(value) -> Column:
    """The UTC time of stored epoch seconds; null where they are missing, unreadable or out of range."""
    d = _number(value)
    return F.when(d.between(FIRST_SECOND, LAST_SECOND), F.timestamp_micros(F.round(d * 1e6).cast("bigint")))


def as_count(value) -> Column:
    """A stored number as a whole one, towards zero; 0, for "not recorded", where it can't be read."""
    return F.coalesce(as_page(value), F.lit(0).cast("bigint"))


def as_page(value) -> Column:
    """The same, but null where it can't be read: a missing page is no page."""
    d = _number(value)
    return F.when(F.abs(d) < 9e18, d.cast("bigint"))
