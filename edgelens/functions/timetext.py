"""ISO bucket text and its display forms.

Buckets are compared as text, so every expression here renders from the text of
a timestamp and never depends on the session time zone.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, functions as F

ISO = "yyyy-M-d'T'H:m:s'Z'"


def _text(ts: Column) -> Column:
    return ts.cast("string")


def iso_second(ts: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SSZ``."""
    s = _text(ts)
    return F.concat(F.substring(s, 1, 10), F.lit("T"), F.substring(s, 12, 8), F.lit("Z"))


def iso_hour(ts: Column) -> Column:
    """Start of the hour, ``YYYY-MM-DDTHH:00:00Z``."""
    s = _text(ts)
    return F.concat(F.substring(s, 1, 10), F.lit("T"), F.substring(s, 12, 2), F.lit(":00:00Z"))


def day_and_hour(ts: Column) -> list[Column]:
    """Date and hour as plain numbers: grouping keys that need no text per row."""
    return [F.to_date(ts).alias("day"), F.hour(ts).alias("hour")]


def iso_from(day: Column, hour: Column) -> Column:
    """Bucket text of a date and hour."""
    return F.concat(day.cast("string"), F.lit("T"), F.lpad(hour.cast("string"), 2, "0"), F.lit(":00:00Z"))


def hour_of_iso(text: Column) -> Column:
    """Truncate ISO text to its hour."""
    return F.concat(F.substring(text, 1, 13), F.lit(":00:00Z"))


def date_of_iso(text: Column) -> Column:
    """Calendar date of ISO text, as ``YYYY-MM-DD`` text."""
    return F.substring(text, 1, 10)


def partition_date(text: Column) -> Column:
    """Date a row is stored under; text that is no date goes to ``undated``.

    ``undated`` sorts after every date, so no date filter skips it.
    """
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), date_of_iso(text)).otherwise("undated")


def instant(as_of: datetime | str | Column) -> Column:
    """``as_of`` as a zone-free timestamp column."""
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, datetime):
        if as_of.tzinfo is not None:
            as_of = as_of.astimezone(timezone.utc).replace(tzinfo=None)
        as_of = as_of.isoformat(sep=" ")
    return F.lit(as_of.replace("T", " ").removesuffix("Z")).cast("timestamp_ntz")


def cutoff(as_of: datetime | str | Column, *, days: int = 0, hours: int = 0) -> Column:
    """ISO text of ``as_of`` minus a duration."""
    step = F.make_dt_interval(F.lit(days), F.lit(hours), F.lit(0), F.lit(0))
    return iso_second(instant(as_of) - step)


def parse_iso(text: Column) -> Column:
    """Timestamp of ISO text; NULL when it does not parse."""
    return F.try_to_timestamp(text, F.lit(ISO))


def display(text: Column) -> Column:
    """``Mar 18, 10:00 PM UTC``; text that does not parse comes back unchanged."""
    return F.coalesce(F.date_format(parse_iso(text), "MMM d, h:mm a 'UTC'"), text)


def axis_label(text: Column) -> Column:
    """``Mar 18, 10PM``."""
    return F.date_format(parse_iso(text), "MMM d, ha")
