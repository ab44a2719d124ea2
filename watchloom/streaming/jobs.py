"""The same operators on unbounded input, with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from watchloom.functions.text import strip
from watchloom.functions import times
from watchloom.operators.normalize import events_of, normalize_all
from watchloom.operators.parse import classify, dead_letters
from watchloom.operators.windows import GROUP, KEY_FIELDS, check_seconds, hash_id, with_session_key
from watchloom.schemas import FIXED_WINDOW_SECONDS, SESSION_GAP_SECONDS
from watchloom.session import materialize, configure, scratch_path
from watchloom.sources.sinks import write_jsonl


def read_landing(spark: SparkSession, path: str, pattern: str = "*.jsonl", files_per_batch: int | None = None) -> DataFrame:
    """Lines of a landing folder as they arrive; the checkpoint remembers what was read."""
    configure(spark)
    reader = spark.readStream.format("text").option("pathGlobFilter", pattern)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    text = reader.load(path)
    return text.select(
        F.regexp_extract(F.col("_metadata.file_path"), r"([^/=]+)/[^/]+$", 1).alias("ingest_source"),
        F.col("value").alias("line"),
    ).filter(F.length(strip(F.col("line"))) > 0)


def fixed_windows(events: DataFrame, seconds: int = FIXED_WINDOW_SECONDS, delay: str = "10 minutes") -> DataFrame:
    """Clock-aligned window counts; a window is emitted once the watermark has passed it."""
    check_seconds("window_seconds", seconds)
    counted = events.withWatermark("ts", delay).groupBy(GROUP, F.window("ts", f"{seconds} seconds").alias("w")).agg(
        F.count(F.lit(1)).alias("event_count")
    )
    return counted.select(
        GROUP, times.fixed_window_id(F.col("w.start"), seconds).alias("window_id"), F.col("w.start").alias("start_ts"),
        "event_count",
    )


def sessions(
    events: DataFrame, gap_seconds: int = SESSION_GAP_SECONDS, key_fields=KEY_FIELDS, delay: str = "10 minutes"
) -> DataFrame:
    """Sessions kept as state across batches, so a session may span any number of them."""
    check_seconds("session_gap_seconds", gap_seconds)
    keys = [GROUP, *[f"key_{f}" for f in key_fields]]
    keyed = with_session_key(events, key_fields).withWatermark("ts", delay)
    found = keyed.groupBy(*keys, F.session_window("ts", f"{gap_seconds} seconds").alias("w")).agg(
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count(F.lit(1)).alias("event_count")
    )
    return found.select(*keys, hash_id(keys, "start_ts").alias("window_id"), "start_ts", "end_ts", "event_count")


def temporal_correlation(alerts: DataFrame, key: str, a: Column, b: Column, delta_seconds: int, delay: str = "10 minutes") -> DataFrame:
    """Incidents: slots of a key in which both kinds of alert lie at most ``delta_seconds`` apart.

    Alerts are first reduced to one record per key and slot, then slots meet their neighbours:
    at most three records per slot are joined, however many alerts a key raises.
    """
    width = f"{delta_seconds} seconds"

    def per_slot(kind: Column, side: str) -> DataFrame:
        slots = alerts.filter(kind).withWatermark("ts", delay).groupBy(F.col(key).alias(f"{side}_key"), F.window("ts", width)).agg(
            F.min("ts").alias(f"{side}_first"), F.max("ts").alias(f"{side}_last")
        )
        return slots.select(f"{side}_key", f"{side}_first", f"{side}_last", F.window_time("window").alias(f"{side}_at"))

    step = F.expr(f"INTERVAL {delta_seconds} SECONDS")
    left, right = per_slot(a, "a"), per_slot(b, "b")
    joined = left.join(
        right,
        (F.col("a_key") == F.col("b_key"))
        & (F.col("a_at") >= F.col("b_at") - step) & (F.col("a_at") <= F.col("b_at") + step),
    )
    micros = delta_seconds * 1_000_000
    apart = F.when(F.col("a_at") < F.col("b_at"), F.unix_micros("b_first") - F.unix_micros("a_last")).when(
        F.col("a_at") > F.col("b_at"), F.unix_micros("a_first") - F.unix_micros("b_last")
    ).otherwise(F.lit(0).cast("long"))
    return joined.filter(apart <= micros).select(
        F.col("a_key").alias(key), F.unix_micros("a_first").alias("a_first_us"), F.unix_micros("b_first").alias("b_first_us")
    )


def write_once(stream: DataFrame, path: str, partitions: int | None = None) -> DataFrame:
    """Run a stream over all data present, append to a table, and return the table.

    The first run fixes in how many partitions the state is kept; by default as many as the
    cluster has cores.
    """
    spark = stream.sparkSession
    setting = "spark.sql.shuffle.partitions"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(partitions or spark.sparkContext.defaultParallelism))
    try:
        query: StreamingQuery = (
            stream.writeStream.format("parquet").outputMode("append").option("path", path)
            .option("checkpointLocation", scratch_path(spark, "progress")).trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        spark.conf.set(setting, before)
    return spark.read.schema(stream.schema).parquet(path)


def split_stream(lines: DataFrame, path: str) -> StreamingQuery:
    """Write each batch's good events and dead letters; a repeated batch overwrites itself."""
    def write(batch: DataFrame, number: int) -> None:
        classified = materialize(normalize_all(classify(batch)), "batch")  # both outputs read one parse
        write_jsonl(events_of(classified).drop("ts"), f"{path}/events/batch={number}")
        write_jsonl(dead_letters(classified), f"{path}/errors/batch={number}")

    return (
        lines.writeStream.foreachBatch(write)
        .option("checkpointLocation", scratch_path(lines.sparkSession, "progress")).trigger(availableNow=True).start()
    )
