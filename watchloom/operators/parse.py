"""From text lines to classified events: unwrap, validate, check values.

All lines stay in one frame. ``stage`` names the first check that failed and is NULL for a
good event; ``error`` holds its message. One narrow stage, no shuffle, each text parsed once.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from watchloom.functions import times, variants
from watchloom.functions.text import lower_source, strip
from watchloom.schemas import ALIASES, ENVELOPE_KEYS, SOURCE_EXTRA_ALIASES, SOURCES

# Keys whose JSON type decides something; all other known keys are read as text.
_TYPED_KEYS = (
    "timestamp", "source_type", "identity", "event_id", "envelope_id", "id",
    "success", "latency_ms", "host", "ingested_at",
)
_TEXT_KEYS = tuple(
    dict.fromkeys(
        key
        for keys in (*ALIASES.values(), *(k for e in SOURCE_EXTRA_ALIASES.values() for k in e.values()))
        for key in keys
        if key not in _TYPED_KEYS
    )
)
BODY_KEYS = (*_TYPED_KEYS, *_TEXT_KEYS)
# Column that holds a key of the merged event; numbered because keys may differ only by case.
BODY_COLUMN = {key: f"_b{i}_{key}" for i, key in enumerate(BODY_KEYS)}

_ENVELOPE_SCHEMA = T.StructType([T.StructField(k, T.VariantType()) for k in ("raw_payload", *ENVELOPE_KEYS)])
_BODY_SCHEMA = T.StructType(
    [T.StructField(k, T.VariantType()) for k in _TYPED_KEYS]
    + [T.StructField(k, T.StringType()) for k in _TEXT_KEYS]
)


def _type_label(type_name: Column) -> Column:
    """Name used in messages for a payload of the wrong type (fixed values)."""
    return (
        F.when(type_name == "VOID", "NoneType")
        .when(type_name.startswith("ARRAY"), "list")
        .when(type_name == "BIGINT", "int")
        .when(type_name == "BOOLEAN", "bool")
        .otherwise("float")
    )


def read_objects(lines: DataFrame) -> DataFrame:
    """``line`` -> envelope keys as one struct ``_env``, or ``read_error``."""
    parsed = lines.withColumn("_p", variants.parse_keys(F.col("line"), _ENVELOPE_SCHEMA))
    value = variants.parsed_value(F.col("_p"))
    return parsed.select(
        *lines.columns,
        F.when(~variants.is_whole(F.col("_p")), "Invalid JSON")
        .when(value.isNull(), "JSONL line is not an object").alias("read_error"),
        value.alias("_env"),
    )


def parse_payload(frame: DataFrame, payload: str, type_name: str) -> DataFrame:
    """Payload text column -> known keys as one struct ``_body``, or ``parse_error``.

    An object payload arrives as its JSON text, bytes as decoded text (``text.decode_utf8``),
    so that every form takes the same path.
    """
    parsed = frame.withColumn("_p", variants.parse_keys(F.col(payload), _BODY_SCHEMA))
    kind = F.col(type_name)
    readable = (kind == "STRING") | kind.startswith("OBJECT")
    value = variants.parsed_value(F.col("_p"))
    return parsed.select(
        *frame.columns,
        F.when(~readable, F.concat(F.lit("Unsupported payload type: "), _type_label(kind)))
        .when(~variants.is_whole(F.col("_p")) & (strip(F.col(payload)) == ""), "Empty raw payload")
        .when(~variants.is_whole(F.col("_p")), "Invalid JSON payload")
        .when(value.isNull(), "JSON payload must be an object").alias("parse_error"),
        value.alias("_body"),
    )


def unwrap(objects: DataFrame) -> DataFrame:
    """Envelope -> ``_body``; an event without ``raw_payload`` is its own body."""
    payload = F.col("_env.raw_payload")
    frame = objects.withColumns(
        {
            "_wrapped": payload.isNotNull(),
            "_text": F.when(F.col("read_error").isNotNull(), F.lit("{}"))
            .when(payload.isNotNull(), F.coalesce(variants.text_of(payload), F.lit("null")))
            .otherwise(F.col("line")),
            "_type": F.when(payload.isNotNull(), variants.type_of(payload)).otherwise("OBJECT<>"),
        }
    )
    return parse_payload(frame, "_text", "_type").drop("_type")


def _typed(key: str, body: Column) -> Column:
    """Envelope keys win over payload keys when present, even as null."""
    if key not in ENVELOPE_KEYS:
        return body
    stated = F.col("_env").getField(key)
    return F.when(F.col("_wrapped") & stated.isNotNull(), stated).otherwise(body)


def merged(key: str) -> Column:
    """One key of the merged event, on a classified frame."""
    return _typed(key, F.col(BODY_COLUMN[key]))


def merged_text(key: str) -> Column:
    """Text of one key of the merged event, on a classified frame."""
    return variants.text_of(merged(key)) if key in _TYPED_KEYS else merged(key)


def merged_event() -> Column:
    """The whole merged event as VARIANT (built only where a sink asks for it)."""
    payload = variants.as_map(variants.parse_object(F.col("_text")))
    stated = {key: F.col("_env").getField(key) for key in ENVELOPE_KEYS}
    envelope = F.map_filter(
        F.create_map(*[c for key, value in stated.items() for c in (F.lit(key), value)]), lambda _, v: v.isNotNull()
    )
    # Runs for every key of the payload, so it only looks at values that are parsed already.
    kept = F.map_filter(
        payload, lambda k, _: ~functools.reduce(operator.or_, [(k == key) & value.isNotNull() for key, value in stated.items()])
    )
    return F.when(
        F.col("_wrapped"), F.to_variant_object(F.map_concat(kept, envelope))
    ).otherwise(variants.parse_object(F.col("line")))


def validation_error() -> Column:
    """First failed check of the minimum contract (fixed messages), NULL when none fails."""
    source = F.col("_source")
    return (
        F.when(F.col("_time_missing"), "Missing required field: timestamp")
        .when(F.col("_source_missing"), "Missing required field: source_type")
        .when(~source.isin(*SOURCES), F.concat(F.lit("Unsupported source_type: "), source))
        .when((source == "ollama") & F.col("_identity_missing"), "Ollama event is missing mandatory identity")
    )


def _falsy(key: str) -> Column:
    return variants.is_falsy(F.col(f"_type_{key}"), F.col(f"_text_{key}"))


def _read_time() -> Column:
    kind = F.col("_type_time")
    return F.when(
        variants.is_number(kind), times.from_epoch_number(variants.number_of(F.col("_time")))
    ).when(kind == "STRING", times.parse_iso(F.col("_text_time")))


def classify(lines: DataFrame, timestamp_fallback: str | None = None) -> DataFrame:
    """Lines -> one row per line with ``stage``/``error`` and the values needed downstream.

    ``timestamp_fallback`` names a typed key that stands in for a missing timestamp (off by
    default).
    """
    def typed(key: str) -> Column:
        return _typed(key, F.col("_body").getField(key))

    frame = unwrap(read_objects(lines))
    time = typed("timestamp")
    if timestamp_fallback is not None:
        absent = variants.is_falsy(variants.type_of(time), variants.text_of(time))
        time = F.when(absent, typed(timestamp_fallback)).otherwise(time)
    frame = frame.withColumns(
        {
            "_time": time,
            "_value_source": typed("source_type"),
            "_value_identity": typed("identity"),
            "_latency": typed("latency_ms"),
        }
    )
    inputs = {"time": "_time", "source": "_value_source", "identity": "_value_identity"}
    frame = frame.withColumns(
        {
            **{f"_type_{k}": variants.type_of(F.col(v)) for k, v in inputs.items()},
            **{f"_text_{k}": variants.text_of(F.col(v)) for k, v in inputs.items()},
            "_latency_text": variants.text_of(F.col("_latency")),
            "latency_ms": variants.number_of(F.col("_latency")),
        }
    )
    frame = frame.withColumns(
        {
            "_source": lower_source(F.col("_text_source")),
            "_source_missing": _falsy("source"),
            "_identity_missing": _falsy("identity"),
            "_time_missing": _falsy("time"),
            "ts": _read_time(),
        }
    )
    bad_latency = F.col("latency_ms").isNull() & (F.col("_latency_text") != "")
    frame = frame.withColumns(
        {
            "_invalid": validation_error(),
            "_bad_value": F.when(
                bad_latency, F.concat(F.lit("Invalid latency_ms: "), F.col("_latency_text"))
            ).when(F.col("ts").isNull(), F.concat(F.lit("Invalid timestamp: "), F.col("_text_time"))),
        }
    )
    carried = [c for c in lines.columns if c != "line"]
    # One-row explode: a filter on ``stage`` is otherwise pushed below the projections and
    # parses every text again for each place it is mentioned.
    row = F.struct(
        *carried,
        F.when(F.col("read_error").isNotNull(), "read")
        .when(F.col("parse_error").isNotNull(), "parse")
        .when(F.col("_invalid").isNotNull(), "validate")
        .when(F.col("_bad_value").isNotNull(), "normalize").alias("stage"),
        F.coalesce("read_error", "parse_error", "_invalid", "_bad_value").alias("error"),
        "line", "ts", "latency_ms", F.col("_source").alias("source_type"), "_wrapped", "_text",
        F.struct(*[F.col("_env").getField(key).alias(key) for key in ENVELOPE_KEYS]).alias("_env"), "_body",
    )
    flat = frame.select(F.explode(F.array(row)).alias("_r")).select("_r.*")
    kept = [c for c in flat.columns if c != "_body"]
    return flat.select(*kept, "_body.*").toDF(*kept, *BODY_COLUMN.values())


def valid_only(classified: DataFrame) -> DataFrame:
    return classified.filter(F.col("stage").isNull())


def split_valid_invalid(classified: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good events, and failing ones as ``(error, event)``."""
    invalid = classified.filter(F.col("stage").isNotNull())
    return valid_only(classified), invalid.select("ingest_source", "error", F.col("line").alias("event"))


def dead_letters(classified: DataFrame) -> DataFrame:
    """Every failing line with the stage that refused it."""
    extra = [c for c in ("file_path", "line_number") if c in classified.columns]
    return classified.filter(F.col("stage").isNotNull()).select(
        "ingest_source", "stage", "error", *extra, F.col("line").alias("raw")
    )
