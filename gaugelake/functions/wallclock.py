"""Arithmetic on wall-clock timestamps that never consults the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Counting from year 1 keeps every contract timestamp non-negative, so truncation is floor.
_ORIGIN = "timestamp_ntz'0001-01-01 00:00:00'"


def seconds_between(earlier: Column, later: Column) -> Column:
    """Whole seconds from earlier to later, truncated toward zero."""
    return (later - earlier).cast("interval second").cast("bigint")


def ordinal_seconds(ts: Column) -> Column:
    return (ts - F.expr(_ORIGIN)).cast("interval second").cast("bigint")


def ordinal_micros(ts: Column) -> Column:
    seconds = (ts - F.expr(_ORIGIN)).cast("interval second").cast("decimal(18,6)")
    return (seconds * 1_000_000).cast("decimal(18,0)")


def slot(ts: Column, width_seconds: int) -> Column:
    """Index of the fixed-width time slot holding ts."""
    return F.floor(ordinal_seconds(ts) / F.lit(width_seconds)).cast("bigint")


def iso_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def year_text(day: Column) -> Column:
    return F.date_format(day, "yyyy")


def month_text(day: Column) -> Column:
    return F.date_format(day, "MM")
