"""Date and time functions. Parsing never fails: what cannot be read becomes null."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def human_date_to_iso(text: Column) -> Column:
    """``Sep 05, 2025`` or ``September 5, 2025`` to ``2025-09-05``; other text stays, null is empty."""
    # try_to_date takes its format as a literal; the short form is tried first
    parsed = F.coalesce(F.try_to_date(text, "MMM d, yyyy"), F.try_to_date(text, "MMMM d, yyyy"))
    return F.coalesce(F.date_format(parsed, "yyyy-MM-dd"), text, F.lit(""))


def epoch_to_timestamp(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def coerce_timestamp(text: Column) -> Column:
    return F.try_to_timestamp(text)


def coerce_date(text: Column) -> Column:
    return F.to_date(F.try_to_timestamp(text))


def compact_date(when: Column) -> Column:
    """``yyyyMMdd`` text."""
    return F.date_format(when, "yyyyMMdd")
