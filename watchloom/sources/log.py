"""Append-only telemetry log: envelopes, cursor reads, range export, retention.

A log is a DataFrame ``(stream, entry_id, ms, seq, <envelope columns>)``; an entry id is
``<ms>-<seq>`` and grows within its stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchloom.functions.times import stream_position
from watchloom.schemas import BATCH_SIZE, DEFAULT_HOST, ENVELOPE, SOURCES, STREAM_MAX_ENTRIES, STREAM_PREFIX
from watchloom.sources.jsonl import check_source


def envelope(payloads: DataFrame, source: Column, payload: Column, host: Column | None = None) -> DataFrame:
    """Wrap payloads; text passes as it is, any other type becomes JSON text."""
    is_text = dict(payloads.select(payload.alias("p")).dtypes)["p"] == "string"
    raw = payload if is_text else F.to_json(payload)
    host = F.lit(DEFAULT_HOST) if host is None else F.coalesce(host, F.lit(DEFAULT_HOST))
    return payloads.select(
        F.uuid().alias("envelope_id"),
        source.alias("source_type"),
        host.alias("host"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias("ingested_at"),
        raw.alias("raw_payload"),
    )


def publish(payloads: DataFrame, source: str, payload: Column, path: str, host: Column | None = None) -> None:
    """Append envelopes to the landing folder of one source."""
    wrapped = envelope(payloads, F.lit(check_source(source)), payload, host)
    wrapped.write.mode("append").partitionBy("source_type").json(path)


def with_position(entries: DataFrame) -> DataFrame:
    ms, seq = stream_position(F.col("entry_id"))
    return entries.withColumns({"ms": ms, "seq": seq})


def _after(ms: int, seq: int) -> Column:
    return (F.col("ms") > ms) | ((F.col("ms") == ms) & (F.col("seq") > seq))


def read_batch(log: DataFrame, stream: str, count: int = BATCH_SIZE, last_id: str = "0-0") -> DataFrame:
    """Next ``count`` entries of a stream after ``last_id``; each task keeps only its best."""
    ms, seq = (int(x) for x in last_id.split("-"))
    return log.filter((F.col("stream") == stream) & _after(ms, seq)).orderBy("ms", "seq").limit(count)


def read_all_once(log: DataFrame, count: int = BATCH_SIZE) -> DataFrame:
    """First ``count`` entries of every stream; the rank limit is applied before the shuffle too."""
    place = F.row_number().over(Window.partitionBy("stream").orderBy("ms", "seq"))
    known = log.filter(F.col("stream").isin(*[STREAM_PREFIX + s for s in SOURCES]))
    return known.withColumn("place", place).filter(F.col("place") <= count)


def export_range(log: DataFrame, stream: str, first: str = "-", last: str = "+") -> DataFrame:
    """Entries of an id range as JSON text; an ``event_id`` among the fields wins over the entry id."""
    chosen = log.filter(F.col("stream") == stream)
    if first != "-":
        ms, seq = (int(x) for x in first.split("-"))
        chosen = chosen.filter(_after(ms, seq) | ((F.col("ms") == ms) & (F.col("seq") == seq)))
    if last != "+":
        ms, seq = (int(x) for x in last.split("-"))
        chosen = chosen.filter(~_after(ms, seq))
    own = F.col("event_id") if "event_id" in log.columns else F.lit(None).cast("string")
    fields = [f.name for f in ENVELOPE if f.name in log.columns]
    return chosen.select(
        "entry_id", F.to_json(F.struct(F.coalesce(own, F.col("entry_id")).alias("event_id"), *fields)).alias("line")
    )


def retain_newest(log: DataFrame, keep: int = STREAM_MAX_ENTRIES, hour_ms: int = 3_600_000) -> DataFrame:
    """Exactly the newest ``keep`` entries of each stream.

    The cut is found by counting: per hour, then per millisecond of the hour that holds it, then
    by sequence number inside that millisecond. No task ever ranks a whole stream; streams are
    few, so the cuts are broadcast.
    """
    hour = F.call_function("div", F.col("ms"), F.lit(hour_ms))

    def cut(counted: DataFrame, unit: str) -> DataFrame:
        """Unit in which the limit is reached, and what it may still contribute."""
        newer = Window.partitionBy("stream").orderBy(F.desc(unit)).rowsBetween(Window.unboundedPreceding, 0)
        totals = counted.withColumn("_sum", F.sum("_n").over(newer))
        return totals.filter((F.col("_sum") >= F.col("_left")) & (F.col("_sum") - F.col("_n") < F.col("_left"))).select(
            "stream", F.col(unit).alias(f"_cut_{unit}"), (F.col("_left") - (F.col("_sum") - F.col("_n"))).alias("_left")
        )

    by_hour = log.groupBy("stream", hour.alias("hour")).agg(F.count(F.lit(1)).alias("_n"))
    hour_cut = cut(by_hour.withColumn("_left", F.lit(keep)), "hour")
    in_hour = log.join(F.broadcast(hour_cut), "stream").filter(hour == F.col("_cut_hour"))
    by_ms = in_hour.groupBy("stream", "ms", "_left").agg(F.count(F.lit(1)).alias("_n"))
    ms_cut = cut(by_ms, "ms")
    in_ms = log.join(F.broadcast(ms_cut), "stream").filter(F.col("ms") == F.col("_cut_ms"))
    place = F.row_number().over(Window.partitionBy("stream").orderBy(F.desc("seq")))
    edge = in_ms.withColumn("_place", place).filter(F.col("_place") <= F.col("_left"))
    edge = edge.groupBy("stream").agg(F.max("_cut_ms").alias("_ms"), F.min("seq").alias("_seq"))
    kept = (
        F.col("_ms").isNull() | (F.col("ms") > F.col("_ms"))
        | ((F.col("ms") == F.col("_ms")) & (F.col("seq") >= F.col("_seq")))
    )
    return log.join(F.broadcast(edge), "stream", "left").filter(kept).drop("_ms", "_seq")
