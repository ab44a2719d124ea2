"""The batch job: lines -> events, dead letters, windows, sessions and a summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchloom.operators import windows as win
from watchloom.operators.normalize import alias_column, events_of, normalize_all
from watchloom.operators.parse import classify, dead_letters
from watchloom.schemas import FIXED_WINDOW_SECONDS, SESSION_GAP_SECONDS, SOURCES
from watchloom.session import scratch_path, temporary_tables
from watchloom.sources.jsonl import not_blank, number_lines
from watchloom.sources.sinks import write_jsonl, write_table

OUTPUTS = ("preprocessed", "windows/fixed", "windows/session", "errors")


def summary_from_staged(
    staged: DataFrame, good: DataFrame, fixed_seconds: int, gap_seconds: int, out_dir: str = ""
) -> DataFrame:
    """Counts per source and where its outputs lie; a source without input has a zero row.

    ``staged`` holds the outcome of every line, ``good`` the events with time, identity and host.
    """
    spark = staged.sparkSession
    counts = staged.groupBy("ingest_source").agg(
        F.count(F.lit(1)).alias("raw_event_count"),
        F.count_if(F.col("stage").isNull()).alias("valid_event_count"),
        F.count_if(F.col("stage").isNotNull()).alias("error_count"),
    )
    fixed = win.fixed_windows(good, fixed_seconds).groupBy("ingest_source").agg(
        F.count(F.lit(1)).alias("fixed_window_count")
    )
    found = win.sessions(good, gap_seconds).groupBy("ingest_source").agg(
        F.count(F.lit(1)).alias("session_window_count")
    )
    sources = spark.createDataFrame([(s,) for s in SOURCES], "ingest_source string")
    joined = sources.join(counts, "ingest_source", "left").join(fixed, "ingest_source", "left").join(
        found, "ingest_source", "left"
    )
    numbers = ("raw_event_count", "valid_event_count", "error_count", "fixed_window_count", "session_window_count")
    names = ("preprocessed_file", "fixed_window_file", "session_window_file", "error_file")
    return joined.select(
        F.col("ingest_source").alias("source_type"),
        *[F.coalesce(n, F.lit(0)).alias(n) for n in numbers],
        *[
            F.concat(F.lit(f"{out_dir}{folder}/ingest_source="), F.col("ingest_source")).alias(name)
            for name, folder in zip(names, OUTPUTS)
        ],
    )


def stage_for_summary(lines: DataFrame) -> DataFrame:
    """Parse once into a narrow table in the shared folder; all counts read that."""
    path = scratch_path(lines.sparkSession, "staged")
    write_table(
        classify(lines).select(
            "ingest_source", "stage", "ts",
            alias_column("identity").alias("identity"), alias_column("host").alias("host"),
        ),
        path,
    )
    return lines.sparkSession.read.parquet(path)


def run_summary(
    lines: DataFrame, fixed_seconds: int = FIXED_WINDOW_SECONDS, gap_seconds: int = SESSION_GAP_SECONDS
) -> DataFrame:
    win.check_seconds("window_seconds", fixed_seconds)
    win.check_seconds("session_gap_seconds", gap_seconds)
    staged = stage_for_summary(lines)
    return summary_from_staged(staged, staged.filter(F.col("stage").isNull()), fixed_seconds, gap_seconds)


def run_preprocessing(
    lines: DataFrame, out_dir: str, fixed_seconds: int = FIXED_WINDOW_SECONDS,
    gap_seconds: int = SESSION_GAP_SECONDS, timestamp_fallback: str | None = None,
) -> DataFrame:
    """Write the four outputs of every source under ``out_dir``, as packed JSON lines, and return the summary.

    Lines from ``read_lines(number=True)`` give dead letters with their line numbers.

    Lines are parsed once, into a staged table beside the outputs; everything else reads that
    table, so a lost executor costs only the tasks it held.
    """
    spark = lines.sparkSession
    win.check_seconds("window_seconds", fixed_seconds)
    win.check_seconds("session_gap_seconds", gap_seconds)
    classified = classify(not_blank(lines), timestamp_fallback)
    staged_path = f"{out_dir}/_staged"
    write_table(normalize_all(classified), staged_path, "zstd")
    classified = spark.read.parquet(staged_path)
    events = events_of(classified)

    def put(rows: DataFrame, name: str, by: str = "ingest_source") -> None:
        write_jsonl(rows, f"{out_dir}/{name}", [by], packed=True)

    put(events.drop("ts"), "preprocessed")
    put(win.fixed_windows(events, fixed_seconds), "windows/fixed")
    put(win.sessions(events, gap_seconds).drop("start_ts", "end_ts", "session_no"), "windows/session")
    # What a window holds is the events' ids in order; the events themselves are written once.
    ids = events.select("ingest_source", "ts", "event_id", "identity", "host")
    with temporary_tables(spark):
        put(win.fixed_window_members(ids, fixed_seconds).drop("ts", "identity", "host"), "windows/fixed_members")
    with temporary_tables(spark):
        members = win.session_members(ids, gap_seconds).drop("ts", "identity", "host", "session_key", "start_time")
        put(members, "windows/session_members")
    if "action" in events.columns:
        with temporary_tables(spark):
            sequences = win.identity_sequences(events, fixed_seconds)
            put(sequences.withColumn("identity_hash", F.pmod(F.xxhash64("identity"), F.lit(64))), "sequences", "identity_hash")
    failing = classified.filter(F.col("stage").isNotNull())
    if "_row" in lines.columns:
        failing = number_lines(lines, failing)
    put(dead_letters(failing), "errors")
    return summary_from_staged(classified, events, fixed_seconds, gap_seconds, f"{out_dir}/")
