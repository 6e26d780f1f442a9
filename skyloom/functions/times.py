"""Times of the simulator's form as column expressions. All instants are UTC and the session's zone is UTC."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The simulator's form; d reads days of one and of two digits.
SIMULATOR_FORM = "d MMM yyyy HH:mm:ss.SSS"


def instant(text: Column) -> Column:
    """The instant of a text in the simulator's form; null where it is none."""
    return F.try_to_timestamp(F.trim(text), F.lit(SIMULATOR_FORM))


def iso_text(at: Column) -> Column:
    """``2025-07-20T02:00:00Z``; the fraction is cut."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def simulator_text(at: Column) -> Column:
    """``20 Jul 2025 02:00:00.000``."""
    return F.date_format(at, "dd MMM yyyy HH:mm:ss.SSS")


def epoch_seconds(at: Column) -> Column:
    """Whole seconds since 1970, the fraction cut downwards."""
    return F.unix_seconds(at)


def epoch_with_millis(at: Column) -> Column:
    """Seconds since 1970 with milliseconds, further digits cut."""
    return F.unix_millis(at) / 1000.0


def from_epoch(seconds: Column) -> Column:
    """The instant of seconds since 1970, to the microsecond."""
    return F.timestamp_micros(F.round(seconds * 1_000_000).cast("long"))


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / 1e6


def shifted(at: Column, days: float = 0, seconds: float = 0) -> Column:
    return F.timestamp_micros(F.unix_micros(at) + F.lit(round((days * 86_400 + seconds) * 1_000_000)))


def offset_seconds(at: Column, origin: datetime) -> Column:
    """Seconds since the start of a scenario."""
    return seconds_between(F.lit(origin), at)


def file_stamp(now: datetime) -> str:
    """A time for file names: 20250720_020000."""
    return now.astimezone(UTC).strftime("%Y%m%d_%H%M%S")
