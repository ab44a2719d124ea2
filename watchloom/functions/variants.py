"""Reading schema-less JSON: known keys through one typed parse, the rest through VARIANT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from watchloom.functions.text import strip

_VALUE, _END = "~value", "~end"
_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
_ONLY_END = T.StructType([T.StructField(_END, T.IntegerType())])


def _wrapped(bare: Column) -> Column:
    return F.concat(F.lit(f'{{"{_VALUE}":'), bare, F.lit(f',"{_END}":1}}'))


def _single(bare: Column) -> Column:
    """Whether a text that fits as a member's value fits as the only element of a list too.

    Inside an object a text may go on with more members, inside a list with more elements; only one value
    fits both. The list is read only where the text could go on: a closing brace, then a comma and a quote,
    or a value that is no object.
    """
    could_go_on = ~bare.startswith("{") | bare.rlike(r"\}\s*,\s*\"")
    as_list = F.from_json(F.concat(F.lit("["), bare, F.lit("]")), "array<string>", _STRICT)
    return F.when(could_go_on, F.size(as_list) == 1).otherwise(True)


def parse_keys(text: Column, keys: T.StructType) -> Column:
    """Parse the known ``keys`` of one JSON text -> struct(``~value``, ``~end``).

    The text is set into ``{"~value": text, "~end": 1}``. A JSON reader stops at the end of the
    first complete value, so ``~end`` is NULL unless the text fits there, and both are NULL unless it is
    exactly one value; ``~value`` is NULL unless that value is an object. NaN and infinities are no JSON.
    """
    wrapper = T.StructType([T.StructField(_VALUE, keys), T.StructField(_END, T.IntegerType())])
    bare = F.when(text.startswith("{") & text.endswith("}"), text).otherwise(strip(text))
    return F.when(_single(bare), F.from_json(_wrapped(bare), wrapper, _STRICT))


def parsed_value(parsed: Column) -> Column:
    return parsed.getField(_VALUE)


def is_whole(parsed: Column) -> Column:
    return parsed.getField(_END).isNotNull()


def parse_object(text: Column) -> Column:
    """Text known to be a JSON object -> VARIANT."""
    return F.try_parse_json(strip(text))


def decode_object(text: Column) -> Column:
    """Any text -> VARIANT of the object it holds; NULL unless it is exactly one JSON object."""
    bare = strip(text)
    whole = F.from_json(_wrapped(bare), _ONLY_END, _STRICT).getField(_END).isNotNull() & _single(bare)
    return F.when(whole & bare.startswith("{"), F.try_parse_json(bare))


def type_of(value: Column) -> Column:
    """VARIANT type name, ``VOID`` for JSON null, NULL where the key is absent."""
    return F.schema_of_variant(value)


def text_of(value: Column) -> Column:
    """Text of a VARIANT; lists and objects give their JSON text, JSON null gives NULL."""
    return F.try_variant_get(value, "$", "string")


def number_of(value: Column) -> Column:
    return F.try_variant_get(value, "$", "double")


def is_number(type_name: Column) -> Column:
    """Numbers, and booleans, which count as 0 and 1."""
    return type_name.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|BOOLEAN)")


def is_falsy(type_name: Column, text: Column) -> Column:
    """Missing, null, false, zero, or empty text, list or object."""
    return (
        F.when(type_name.isNull() | (type_name == "VOID"), True)
        .when(type_name == "STRING", text == "")
        .when(type_name == "BOOLEAN", text == "false")
        .when(type_name.startswith("ARRAY"), text == "[]")
        .when(type_name.startswith("OBJECT"), text == "{}")
        .otherwise(F.coalesce(text.try_cast("double") == 0, F.lit(False)))
    )


def as_map(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>")
