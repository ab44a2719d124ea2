"""Classified events -> the fixed 22-column event record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchloom.functions import times, variants
from watchloom.functions.text import clean_string, first_non_empty
from watchloom.operators.parse import classify, merged, merged_event, merged_text, valid_only
from watchloom.schemas import ALIASES, EVENT_FIELDS, SOURCE_EXTRA_ALIASES


def alias_value(name: str, by_source: bool = False) -> Column:
    """One output field from its source keys; optionally with the keys only one source uses."""
    def read(keys) -> Column:
        return first_non_empty(*[merged_text(k) for k in keys])

    value = read(ALIASES[name])
    if by_source:
        for source, extra in SOURCE_EXTRA_ALIASES.items():
            if name in extra:
                special = read((*ALIASES[name], *extra[name]))
                value = F.when(F.col("source_type") == source, special).otherwise(value)
    return value


def alias_column(name: str, by_source: bool = False) -> Column:
    return clean_string(alias_value(name, by_source))


def id_value() -> Column:
    """The first id key that is truthy."""
    def truthy(key: str) -> Column:
        text = merged_text(key)
        return F.when(~variants.is_falsy(variants.type_of(merged(key)), text), text)

    return F.coalesce(truthy("event_id"), truthy("envelope_id"), truthy("id"))


def event_id(stated: Column | None = None) -> Column:
    """The stated id, else SHA-256 of the merged event's canonical JSON."""
    stated = id_value() if stated is None else stated
    return F.coalesce(clean_string(stated), F.sha2(F.to_json(merged_event()), 256))


def success_flag() -> Column:
    """Boolean as given; anything else is NULL (the original stays in raw_payload)."""
    flag = merged("success")
    return F.when(variants.type_of(flag) == "BOOLEAN", F.try_variant_get(flag, "$", "boolean"))


def normalize(classified: DataFrame, by_source: bool = False) -> DataFrame:
    """Good events -> 22 columns plus ``ts`` and the directory they came from."""
    return _records(valid_only(classified), by_source)


def normalize_all(classified: DataFrame) -> DataFrame:
    """Good events and dead letters in one table, so that both can be written by one parse.

    A good event has the columns of :func:`normalize` and no ``line``; of a failing row only what
    ``dead_letters`` tells is kept. Take them apart by ``stage``: :func:`events_of`.
    """
    kept = [c for c in ("stage", "error", "file_path", "line_number", "_block", "_row") if c in classified.columns]
    return _records(classified, False, kept).withColumn("line", F.when(F.col("stage").isNotNull(), F.col("line")))


def events_of(normalized: DataFrame) -> DataFrame:
    """The good events of :func:`normalize_all`."""
    return normalized.filter(F.col("stage").isNull()).select("ingest_source", "ts", *EVENT_FIELDS)


def _records(classified: DataFrame, by_source: bool, kept: list[str] | None = None) -> DataFrame:
    # Two steps keep the plan small: choosing a value mentions many keys, cleaning it mentions
    # the value many times.
    chosen = classified.select(
        *(kept or []), "ingest_source", "ts", "source_type", "latency_ms", "line", "_text", "_wrapped", "_env",
        id_value().alias("_id"), success_flag().alias("success"),
        *[alias_value(name, by_source).alias(f"_v_{name}") for name in ALIASES],
    )
    columns = {
        "event_id": event_id(F.col("_id")),
        "timestamp": times.format_iso_z(F.col("ts")),
        "raw_payload": merged_event(),
        **{name: F.col(name) for name in ("source_type", "success", "latency_ms")},
        **{name: clean_string(F.col(f"_v_{name}")) for name in ALIASES},
    }
    if kept is not None:  # a failing row has no event
        columns = {f: F.when(F.col("stage").isNull(), value) for f, value in columns.items()}
    carried = [] if kept is None else [*kept, "line"]
    return chosen.select("ingest_source", "ts", *[columns[f].alias(f) for f in EVENT_FIELDS], *carried)


def normalize_lines(lines: DataFrame, timestamp_fallback: str | None = None, by_source: bool = False) -> DataFrame:
    return normalize(classify(lines, timestamp_fallback), by_source)


def to_record(events: DataFrame) -> DataFrame:
    """Each event as one JSON text."""
    return events.select("event_id", F.to_json(F.struct(*EVENT_FIELDS)).alias("record"))


def sort_events(events: DataFrame, order: str = "time") -> DataFrame:
    """Global order for a sink: by instant, or by timestamp text as ``order='text'``.

    The id closes the sort key, so a crowded instant is still split over many tasks.
    """
    first = "timestamp" if order == "text" else "ts"
    return events.orderBy(first, "event_id")
