"""Durations: integer hundredths of a second are the canonical form, null the only missing value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SEGMENT = r"(?i)_([0-9]+)-([0-9]+)\.wav$"
HEADER_BYTES, BYTES_PER_SECOND = 44, 32_000


def duration_cs(path: Column) -> Column:
    """End minus begin of a path's segment in hundredths, of any sign; null without a segment."""
    return F.regexp_extract(path, _SEGMENT, 2).try_cast("int") - F.regexp_extract(path, _SEGMENT, 1).try_cast("int")


def duration_s(path: Column) -> Column:
    return duration_cs(path) / 100.0


def positive_cs(path: Column) -> Column:
    """duration_cs() where it is above zero."""
    cs = duration_cs(path)
    return F.when(cs > 0, cs)


def guess_duration_s(path: Column, n_bytes: Column) -> Column:
    """From the name if positive, else from the size of a 16 kHz 16-bit mono file, else 0."""
    sized = F.greatest(n_bytes - HEADER_BYTES, F.lit(0)) / float(BYTES_PER_SECOND)
    return F.coalesce(positive_cs(path) / 100.0, sized, F.lit(0.0))


def abs_diff_cs(enroll: Column, test: Column) -> Column:
    return F.abs(enroll - test)


def signed_diff_cs(enroll: Column, test: Column) -> Column:
    return test - enroll


def shorter_cs(enroll: Column, test: Column) -> Column:
    """The shorter of two durations; null if either is missing."""
    return F.when(enroll.isNotNull() & test.isNotNull(), F.least(enroll, test))


def to_cs(seconds_text: Column) -> Column:
    """Seconds as text to hundredths; null for blank or no number."""
    return F.round(seconds_text.try_cast("double") * 100).cast("int")


def from_sentinel(cs: Column, sentinel: int = -1) -> Column:
    return F.nullif(cs, F.lit(sentinel))


def to_sentinel(cs: Column, sentinel: int = -1) -> Column:
    return F.coalesce(cs, F.lit(sentinel))


def to_seconds(cs: Column) -> Column:
    return cs / 100.0


def narrow_type(largest: int) -> str:
    """The smallest type for numbers up to the largest: a cast to it fails on overflow."""
    return "smallint" if largest <= 32_767 else "int"


def duration_bucket(seconds: Column) -> Column:
    return F.when(seconds < 1, "<1s (likely backchannel)").when(seconds < 3, "1-3s").when(seconds < 10, "3-10s").when(seconds.isNotNull(), ">10s")
