"""Time columns.

Instants are kept as zone-free UTC timestamps (``TIMESTAMP_NTZ``), so a result never
depends on the session time zone. Streams need ``TIMESTAMP`` for watermarks: see ``instant``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearsay.functions.text import as_col

EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
# The years 1 to 9999, in epoch seconds.
FIRST_SECOND, END_SECOND = -62_135_596_800.0, 253_402_300_800.0


def micros_ts(micros: Column | str) -> Column:
    """Epoch microseconds to a UTC timestamp."""
    return F.timestamp_add("MICROSECOND", as_col(micros).cast("bigint"), F.expr(EPOCH))


def seconds_ts(seconds: Column | str) -> Column:
    """Epoch seconds (fractions allowed, text allowed) to a UTC timestamp; null when bad: not a
    finite number, or outside of the years 1 to 9999 (milliseconds taken for seconds, say)."""
    value = as_col(seconds).try_cast("double")
    dated = (value >= FIRST_SECOND) & (value < END_SECOND)  # NaN is larger than any number
    return micros_ts(F.when(dated, F.floor(value * 1_000_000)))


def epoch_micros(ts: Column | str) -> Column:
    return F.timestamp_diff("MICROSECOND", F.expr(EPOCH), as_col(ts).cast("timestamp_ntz"))


def epoch_seconds(ts: Column | str) -> Column:
    """Whole epoch seconds of a UTC timestamp."""
    return F.floor(epoch_micros(ts) / 1_000_000).cast("bigint")


def iso_ts(text: Column | str) -> Column:
    """ISO-8601 text to a timestamp; null when it does not parse.

    Text must start with a year: Spark would read a bare time of day as today's.
    """
    text = as_col(text)
    return F.when(text.rlike(r"^\s*\d{4}"), F.try_to_timestamp(text))


def iso_utc(text: Column | str) -> Column:
    """ISO-8601 text (with its offset) to a zone-free UTC time; null when it does not parse."""
    return micros_ts(F.unix_micros(iso_ts(text)))


def iso_text(ts: Column | str) -> Column:
    return F.date_format(as_col(ts), "yyyy-MM-dd'T'HH:mm:ss")


def month_key(ts: Column | str) -> Column:
    return F.date_format(as_col(ts), "yyyy-MM")


def bucket_start(ts: Column | str, width: str = "10 minutes") -> Column:
    """Start of the tumbling window a time falls in."""
    return F.window(as_col(ts), width)["start"]


def instant(ts: Column | str) -> Column:
    """A zone-free UTC time as ``TIMESTAMP``, which watermarks need."""
    return F.timestamp_micros(epoch_micros(ts))
