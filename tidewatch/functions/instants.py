"""Instants: strict ISO text to timestamp and back, epoch milliseconds, elapsed seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a full ISO instant, up to nine fraction digits, Z or a numeric offset.
ISO_INSTANT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,9})?(Z|[+-]\d{2}:?\d{2})$"


def parse_instant(text: Column) -> Column:
    """ISO text to timestamp (fraction cut to microseconds); null for anything else.

    The shape is checked first because a plain cast also accepts bare dates and times.
    """
    text = F.trim(text)
    return F.when(text.rlike(ISO_INSTANT), text.try_cast("timestamp"))


def parse_lenient(text: Column) -> Column:
    """Like ``parse_instant`` but zone-less date-times, with T or a blank, count as UTC."""
    text = F.trim(text)
    shaped = text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?(Z|[+-]\d{2}:?\d{2})?$")
    return F.when(shaped, text.try_cast("timestamp"))


def millis(ts: Column) -> Column:
    return F.unix_millis(ts)


def from_millis(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def elapsed_seconds(later_ms: Column, earlier_ms: Column) -> Column:
    return (later_ms - earlier_ms) / F.lit(1000.0)


def sql_text(ts: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` plus ``.ffffff`` when there is a fraction."""
    whole = F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
    return F.when(F.unix_micros(ts) % 1_000_000 == 0, whole).otherwise(
        F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def iso_millis(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def iso_like(ts: Column, original: Column) -> Column:
    """ISO text with as many fraction digits as ``original`` had, and its Z or +00:00 ending."""
    original = F.trim(original)
    digits = F.length(F.regexp_extract(original, r"\.(\d+)", 1))
    micros = F.rpad(F.date_format(ts, "SSSSSS"), 9, "0")
    fraction = F.when(digits > 0, F.concat(F.lit("."), F.substring(micros, F.lit(1), digits))).otherwise("")
    zone = F.when(original.endswith("Z"), "Z").otherwise("+00:00")
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), fraction, zone)
