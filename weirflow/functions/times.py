"""Event times: microseconds since the epoch as a long, so that window bounds are exact."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_us(value: Column) -> Column:
    """Microseconds of an ISO 8601 text (Z, +HH:MM or +HHMM, naive as UTC), null if it is none."""
    text = F.regexp_replace(F.trim(value.cast("string")), r"([+-]\d{2})(\d{2})$", "$1:$2")
    dated = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), text)
    return F.unix_micros(F.try_to_timestamp(dated))


def number_us(value: Column) -> Column:
    """Microseconds of a number of seconds."""
    return F.round(value.try_cast("double") * 1e6).try_cast("long")


def parsed_us(value: Column) -> Column:
    """Microseconds of a number of seconds or an ISO text, null if neither."""
    return F.coalesce(number_us(value), iso_us(value))


def event_us(start: Column, end: Column, timestamp: Column) -> Column:
    """A flow's time: its start, else its end, else the event's; 0 if the first that is there cannot be parsed."""
    there = lambda c: F.nullif(F.nullif(F.trim(c.cast("string")), F.lit("")), F.lit("0"))
    return F.coalesce(parsed_us(F.coalesce(there(start), there(end), there(timestamp))), F.lit(0).cast("long"))


def log_us(value: Column) -> Column:
    """A log line's time: ISO text, or a number of seconds, or of milliseconds above 1e12."""
    number = value.try_cast("double")
    return F.coalesce(F.round(F.when(number > 1e12, number * 1e3).otherwise(number * 1e6)).try_cast("long"), iso_us(value))


#: 2000-01-01 in microseconds: an earlier label time is taken for another unit.
_LABELS_FROM = 946_684_800_000_000
#: The last whole second that nanoseconds in a long can tell: a larger number is not one of seconds.
_LAST_SECOND = 9_223_372_036


def label_us(value: Column) -> Column:
    """A label table's time: ISO text, else seconds or else milliseconds, whichever falls after 2000."""
    number = value.try_cast("double")
    seconds, millis = F.when(number <= _LAST_SECOND, F.round(number * 1e6)).try_cast("long"), F.round(number * 1e3).try_cast("long")
    return F.coalesce(iso_us(value), F.when(seconds >= _LABELS_FROM, seconds), F.when(millis >= _LABELS_FROM, millis))


def iso_text(us: Column) -> Column:
    """Microseconds as ISO text in UTC, with the fraction only where there is one."""
    moment = F.timestamp_micros(us)
    return F.when(us % 1_000_000 == 0, F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))


def wall_us(text: Column, zone: str) -> Column:
    """Microseconds of a wall-clock time in a zone."""
    return F.unix_micros(F.to_utc_timestamp(F.to_timestamp(text), zone))


def path_date(path: Column) -> Column:
    """The date DD-MM-YYYY in a path, null if there is none."""
    parts = F.regexp_extract(path, r"(\d{1,2}-\d{1,2}-\d{4})", 1)
    return F.to_date(F.try_to_timestamp(F.nullif(parts, F.lit("")), F.lit("d-M-yyyy")))


def path_weekday(path: Column) -> Column:
    """The folder of a path that is named like a weekday, null if there is none."""
    return F.initcap(F.nullif(F.regexp_extract(F.lower(path), r"(?:^|/)(monday|tuesday|wednesday|thursday|friday)(?=/|$)", 1), F.lit("")))
