"""Epoch-millisecond columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_SAFE = 2**53 - 1

# Numbers below this are seconds, others milliseconds (fixed value).
SECONDS_BELOW = 10_000_000_000



def _kept(ms: Column) -> Column:
    return F.when(F.abs(ms) <= MAX_SAFE, ms.cast("long"))


def ms_of_number(number: Column) -> Column:
    """Unix seconds or milliseconds, told apart by size, rounded half to even."""
    return _kept(F.bround(F.when(F.abs(number) < SECONDS_BELOW, number * 1000).otherwise(number)))


_ISO = (r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d+)?)?"
        r"([Zz]|[+-]\d{2}:?\d{2}(:?\d{2})?)?)?$")
_OFFSET = r"[Zz]$|[T ].*[+-]\d{2}:?\d{2}(:?\d{2})?$"


def ms_of_text(text: Column) -> Column:
    """ISO-8601 text; a text without offset is UTC."""
    stamp = (
        F.when(F.length(text) == 10, F.try_to_timestamp(F.concat(text, F.lit("T00:00:00Z"))))
        .when(text.rlike(_OFFSET), F.try_to_timestamp(text))
        .otherwise(F.try_to_timestamp(F.concat(text, F.lit("Z"))))
    )
    return F.when(text.rlike(_ISO), F.bround(F.unix_micros(stamp) / 1000).cast("long"))


def iso_of_ms(ms: Column) -> Column:
    """UTC text: no fraction on a whole second, else six digits."""
    text = F.date_format(F.to_utc_timestamp(F.timestamp_millis(ms), F.current_timezone()),
                         "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.format_string(".%03d000", F.pmod(ms, F.lit(1000)))
    return F.concat(text, F.when(F.pmod(ms, F.lit(1000)) == 0, "").otherwise(fraction), F.lit("Z"))


def ms_field(number: Column) -> Column:
    """A field stated in milliseconds: finite, not negative, exactly representable."""
    return F.when(number.between(0, MAX_SAFE), F.bround(number).cast("long"))


def ms_of_seconds(number: Column) -> Column:
    ms = number * 1000
    return F.when(ms.between(0, MAX_SAFE), F.bround(ms).cast("long"))


def ms_of_parts(seconds: Column, nanos: Column) -> Column:
    """Whole seconds plus nanoseconds below one second."""
    parts = F.coalesce(nanos, F.lit(0))
    ms = seconds * 1000.0 + parts / 1_000_000
    valid = (seconds >= 0) & parts.between(0, 999_999_999) & (ms <= MAX_SAFE)
    return F.when(valid, F.bround(ms).cast("long"))


def elapsed_ms(start: Column, end: Column) -> Column:
    """Time between two points; null when unknown or negative."""
    return F.when((end >= start) & (end - start <= MAX_SAFE), end - start)
