"""Text cleaning and identifier expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from watchloom.schemas import SOURCES

# The characters a Unicode-aware strip removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Fixed value: stands for a missing key field.
UNKNOWN_KEY = "<unknown>"


def _tight(text: Column) -> Column:
    """Begins and ends with a printable ASCII character, as nearly all text does."""
    last = F.substring(text, -1, 1)
    return (text >= "!") & (text < "\x7f") & (last >= "!") & (last < "\x7f")


def strip(text: Column) -> Column:
    """Remove Unicode whitespace at both ends.

    Tight text is passed on as it is: a few comparisons cost less than searching the
    whitespace list. Pass a plain column; the expression mentions it several times.
    """
    return F.when(_tight(text), text).otherwise(F.btrim(text, F.lit(WHITESPACE)))


def clean_string(text: Column) -> Column:
    """Stripped text, NULL when nothing is left."""
    bare = F.btrim(text, F.lit(WHITESPACE))
    return F.when(_tight(text), text).when(bare != "", bare)


def first_non_empty(*values: Column) -> Column:
    """First value that is neither NULL nor the empty string (blank text does count)."""
    return F.coalesce(*[F.when(v != "", v) for v in values])


def lower_source(text: Column) -> Column:
    """Source name, stripped and in lower case (a known name already is both)."""
    return F.when(text.isin(*SOURCES), text).otherwise(F.lower(strip(text)))


def session_key(value: Column) -> Column:
    """Key text of one session field."""
    return strip(F.coalesce(F.nullif(value.cast("string"), F.lit("")), F.lit(UNKNOWN_KEY)))


def decode_utf8(data: Column) -> Column:
    """Bytes to text; invalid sequences become the replacement character."""
    return F.make_valid_utf8(data.cast("string"))


def feature_name(position: Column) -> Column:
    return F.concat(F.lit("Feature_"), position.cast("string"))


def feature_explanation(name: Column, error: Column) -> Column:
    """Fixed format of one explanation line."""
    return F.format_string("Anomaly driven by %s (Error: %.4f)", name, error)


# Fixed value: explanation given by the short-sequence route.
SHORT_SEQUENCE_TEXT = "Sequence too short. Used statistical fallback."


def split_method_path(action: Column) -> tuple[Column, Column]:
    """``GET /users`` -> method and path; the path is NULL when there is no blank."""
    parts = F.split(action, " ", 2)
    return F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2))
