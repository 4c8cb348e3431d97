"""Moments as UTC text and as epoch seconds."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def utc_now() -> str:
    """Now, to the second, as ISO text with Z."""
    return dt.datetime.now(dt.UTC).isoformat(timespec="seconds").replace("+00:00", "Z")


def iso_utc(c: Column) -> Column:
    """A timestamp as ISO text to the second with Z; the session's time zone must be UTC."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def epoch(c: Column) -> Column:
    """Seconds since 1970 with their fraction."""
    return F.unix_micros(c.cast("timestamp")) / 1e6
