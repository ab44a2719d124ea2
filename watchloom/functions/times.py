"""Timestamp reading and writing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from watchloom.functions.text import strip

# Fixed value: numbers above this count as milliseconds.
MILLIS_LIMIT = 10_000_000_000
# First and last second of the years 1 to 9999.
_MIN_SECOND, _MAX_SECOND = -62135596800, 253402300799

_PLAIN = (
    r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]\d{2}:\d{2})?)?$"
)
# Date, separator, time, zone; date, time and zone each in extended or basic spelling throughout.
_LOOSE = (
    r"^(?:(\d{4})-(\d{2})-(\d{2})|(\d{4})(\d{2})(\d{2}))"
    r"(?:.(?:(\d{2})(?::(\d{2})(?::(\d{2})(?:[.,](\d{1,6})\d*)?)?)?|(\d{2})(\d{2})(?:(\d{2})(?:[.,](\d{1,6})\d*)?)?)"
    r"(Z|[+-]\d{2}(?::\d{2}(?::\d{2})?|\d{4}|\d{2})?)?)?$"
)


# Applied in order to "date T hour:minute:second.fraction Z zone" with parts missing.
_FILL = (
    ("T:", "T00:"), ("::", ":00:"), (":\\.", ":00."), ("\\.Z", ".0Z"),
    ("ZZ$", "Z"), ("Z([+-]\\d{2}):?(\\d{2})?:?(\\d{2})?$", "$1:$2:$3"), ("::$", ":00"), ("(\\d):$", "$1"),
)


def _loose_to_plain(text: Column) -> Column:
    plain = F.regexp_replace(text, _LOOSE, "$1$4-$2$5-$3$6T$7$11:$8$12:$9$13.$10$14Z$15")
    for pattern, replacement in _FILL:
        plain = F.regexp_replace(plain, pattern, replacement)
    return plain


def parse_iso(text: Column) -> Column:
    """ISO-8601 text to a timestamp; text without a zone is UTC; NULL when it is not ISO."""
    return _parse_stripped(strip(text))


def _parse_stripped(value: Column) -> Column:
    return (
        F.when(value.rlike(_PLAIN), value.try_cast("timestamp"))
        .when(value.rlike(_LOOSE), _loose_to_plain(value).try_cast("timestamp"))
    )


def from_epoch_number(number: Column) -> Column:
    """Epoch seconds, or milliseconds above the limit; NULL outside the years 1 to 9999."""
    seconds = F.when(number > MILLIS_LIMIT, number / 1000.0).otherwise(number)
    return F.when(
        seconds.between(_MIN_SECOND, _MAX_SECOND),
        F.timestamp_micros(F.bround(seconds * 1e6).cast("long")),
    )


def format_iso_z(ts: Column) -> Column:
    """ISO text in UTC with ``Z``; the fraction appears only when it is not zero."""
    return F.when(
        F.pmod(F.unix_micros(ts), F.lit(1_000_000)) == 0,
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"),
    ).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))


def as_utc(ts_ntz: Column) -> Column:
    """Zone-less timestamp read as UTC (session zone is UTC, see ``session.configure``)."""
    return ts_ntz.cast("timestamp")


def slot(ts: Column, seconds: int) -> Column:
    """Number of the epoch-aligned slot that holds the instant."""
    micros, width = F.unix_micros(ts), F.lit(seconds * 1_000_000)
    return F.call_function("div", micros - F.pmod(micros, width), width)


def window_floor(ts: Column, seconds: int) -> Column:
    """Start of the clock-aligned window that holds the instant."""
    micros = F.unix_micros(ts)
    return F.timestamp_micros(micros - F.pmod(micros, F.lit(seconds * 1_000_000)))


def fixed_window_id(start: Column, seconds: int) -> Column:
    """Fixed format of a clock-aligned window's id."""
    return F.concat(F.lit("fixed_"), F.date_format(start, "yyyyMMdd'T'HHmmss'Z'"), F.lit(f"_{seconds}s"))


def stream_position(entry_id: Column) -> tuple[Column, Column]:
    """``<ms>-<seq>`` entry id -> the two numbers."""
    parts = F.split(entry_id, "-", 2)
    return parts.getItem(0).cast("long"), parts.getItem(1).cast("long")


def elapsed_ms(start: Column, end: Column) -> Column:
    """Milliseconds between two instants, rounded to two places."""
    return F.round((F.unix_micros(end) - F.unix_micros(start)) / 1000.0, 2)
