"""Queries: sources, sinks, parsing, validation, normalisation, scalar functions."""

from __future__ import annotations

import datetime
import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from watchloom.functions import text, times, variants
from watchloom.operators import access
from watchloom.operators.conformance import schema_conformance as conformance
from watchloom.operators.normalize import alias_column, event_id, normalize_lines, to_record
from watchloom.operators.parse import (
    classify, dead_letters, merged_text, parse_payload, split_valid_invalid,
)
from watchloom.plans.oracle_parts import EV, TELE, iso
from watchloom.plans.preprocessing import OUTPUTS, run_preprocessing, run_summary
from watchloom.plans.registry import query
from watchloom.schemas import ALIASES, EVENT_FIELDS, SOURCES, STREAM_PREFIX
from watchloom.session import materialize, scratch_path
from watchloom.sources import jsonl, log, sinks
from watchloom.sources import landed as landed_files
from watchloom.sources.adapter import event_frame, read_table, telemetry_raw


def classified(spark, sf):
    return classify(telemetry_raw(spark, sf))


def landed(spark, sf) -> str:
    """Telemetry lines written as text files, one folder per source."""
    path = scratch_path(spark, "landing")
    telemetry_raw(spark, sf).write.partitionBy("ingest_source").text(path)
    return path


# --- scans ---------------------------------------------------------------------------------


@query("scan_jsonl", f"""
WITH {TELE} SELECT ingest_source, count(*) AS lines, count(*) FILTER (stage = 'read') AS read_errors FROM tele GROUP BY 1""")
def scan_jsonl(spark, sf):
    lines = jsonl.read_lines(spark, f"{landed(spark, sf)}/*", "*.txt")
    return classify(lines).groupBy("ingest_source").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(F.col("stage") == "read").alias("read_errors")
    )


@query("scan_jsonl_line_numbers", f"""
WITH {TELE} SELECT ingest_source, CAST(count(*) AS BIGINT) AS lines, true AS gapless FROM tele GROUP BY 1""")
def scan_jsonl_line_numbers(spark, sf):
    numbered = jsonl.number_lines(jsonl.read_lines(spark, f"{landed(spark, sf)}/*", "*.txt", number=True))
    n, number = F.count(F.lit(1)), F.col("line_number")
    # The landed files have no blank lines, so each file must be numbered 1, 2, 3, ...
    per_file = numbered.groupBy("ingest_source", "file_path").agg(
        n.alias("n"), ((F.min(number) == 1) & (F.max(number) == n) & (F.sum(number) * 2 == n * (n + 1))).alias("ok")
    )
    return per_file.groupBy("ingest_source").agg(F.sum("n").alias("lines"), F.every("ok").alias("gapless"))


@query("scan_source_dir", f"""
WITH {TELE} SELECT ingest_source, count(*) AS lines FROM tele WHERE ingest_source = 'iam' GROUP BY 1""")
def scan_source_dir(spark, sf):
    path = f"{landed(spark, sf)}/ingest_source={jsonl.check_source('iam')}"
    return jsonl.read_lines(spark, path, "*.txt").groupBy("ingest_source").agg(F.count(F.lit(1)).alias("lines"))


@query("scan_all_sources", f"WITH {TELE} SELECT ingest_source, count(*) AS lines FROM tele GROUP BY 1")
def scan_all_sources(spark, sf):
    lines = jsonl.read_all_sources(spark, landed(spark, sf), "*.txt")
    return lines.groupBy("ingest_source").agg(F.count(F.lit(1)).alias("lines"))


@query("union_files", f"WITH {TELE} SELECT count(*) AS lines, count(DISTINCT ingest_source) AS sources FROM tele")
def union_files(spark, sf):
    lines = jsonl.read_all_sources(spark, landed(spark, sf), "*.txt")
    return lines.agg(F.count(F.lit(1)).alias("lines"), F.count_distinct("ingest_source").alias("sources"))


@query("sorted_paths", f"""
WITH {TELE} SELECT ingest_source AS folder, row_number() OVER (ORDER BY ingest_source) AS place, count(*) AS lines, TRUE AS sorted FROM tele GROUP BY 1""")
def sorted_paths(spark, sf):
    files = jsonl.source_files(jsonl.read_all_sources(spark, landed(spark, sf), "*.txt"))
    files = files.withColumns({"folder": F.regexp_extract("file_path", "ingest_source=([^/]+)", 1), "at": F.monotonically_increasing_id()})
    folders = files.groupBy("folder").agg(F.sum("lines").alias("lines"), F.min("at").alias("first"), F.max("at").alias("last"))
    in_order = Window.orderBy("folder")  # six folders
    follows = F.coalesce(F.lag("last").over(in_order) < F.col("first"), F.lit(True))
    return folders.select("folder", F.row_number().over(in_order).cast("long").alias("place"), "lines", follows.alias("sorted"))


@query("unknown_source_guard", """
SELECT o_orderpriority AS ingest_source, 'Unknown source: ' || o_orderpriority AS error, count(*) AS n FROM orders GROUP BY 1""")
def unknown_source_guard(spark, sf):
    try:
        jsonl.check_source("syslog")
    except ValueError:
        pass
    else:
        raise AssertionError("an unknown source was accepted")
    foreign = read_table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("ingest_source"), F.col("o_orderstatus").alias("line")
    )
    both = foreign.unionByName(event_frame(spark, sf).select("ingest_source", F.col("event_type").alias("line")))
    return jsonl.unknown_sources(both).groupBy("ingest_source", "error").agg(F.count(F.lit(1)).alias("n"))


# --- log -----------------------------------------------------------------------------------

LOG = f"""
{EV}, entries AS (SELECT 'telemetry:' || ingest_source AS stream, us // 1000 AS ms, us % 1000 * 1000000 + n % 1000000 AS seq, n,
  'env-' || n AS envelope_id, ingest_source AS source_type, host, value,
  '{{"identity":"' || identity || '","n":' || n || '}}' AS raw_payload FROM ev)
"""


def entries(spark, sf):
    ev = event_frame(spark, sf)
    us = F.unix_micros("ts")
    seq = F.pmod(us, F.lit(1000)) * 1_000_000 + F.pmod(F.col("n"), F.lit(1_000_000))
    rows = ev.select(
        F.concat(F.lit(STREAM_PREFIX), F.col("ingest_source")).alias("stream"),
        F.concat_ws("-", F.call_function("div", us, F.lit(1000)).cast("string"), seq.cast("string")).alias("entry_id"),
        F.concat(F.lit("env-"), F.col("n").cast("string")).alias("envelope_id"),
        F.col("ingest_source").alias("source_type"), "host",
        F.to_json(F.struct("identity", "n")).alias("raw_payload"),
    )
    return log.with_position(rows)


def landed_log(spark, sf):
    """The entries as a landed log, added in two batches by time, with several files to a stream."""
    rows = entries(spark, sf)
    half = rows.agg(F.percentile_approx("ms", 0.5)).first()[0] or 0
    out = landed_files.LandedLog(spark, scratch_path(spark, "log"))
    return out.add(rows.filter(F.col("ms") < half), 0, 20_000).add(rows.filter(F.col("ms") >= half), 1, 20_000)


@query("stream_read_batch", f"""
WITH {LOG} SELECT ms || '-' || seq AS entry_id FROM entries WHERE stream = 'telemetry:iam' AND ms > 1704700000000
ORDER BY ms, seq LIMIT 100""")
def stream_read_batch(spark, sf):
    return landed_log(spark, sf).read_batch("telemetry:iam", 100, "1704700000000-999999999").select("entry_id")


@query("limit_after_cursor", f"""
WITH {LOG} SELECT ms, seq FROM entries WHERE stream = 'telemetry:vault' ORDER BY ms, seq LIMIT 25""")
def limit_after_cursor(spark, sf):
    return log.read_batch(entries(spark, sf), "telemetry:vault", 25).select("ms", "seq")


@query("stream_read_all_once", f"""
WITH {LOG} SELECT stream, ms || '-' || seq AS entry_id FROM entries
QUALIFY row_number() OVER (PARTITION BY stream ORDER BY ms, seq) <= 100""")
def stream_read_all_once(spark, sf):
    return landed_log(spark, sf).read_all_once().select("stream", "entry_id")


@query("stream_walk", f"""
WITH {LOG} SELECT stream, ms || '-' || seq AS entry_id, (row_number() OVER (PARTITION BY stream ORDER BY ms, seq) - 1) // 100 AS "read",
(row_number() OVER (PARTITION BY stream ORDER BY ms, seq) - 1) % 100 AS place FROM entries""")
def stream_walk(spark, sf):
    """Every cursor read of 100 entries at once, each file read once."""
    return landed_log(spark, sf).walk(100).select("stream", "entry_id", "read", "place")


@query("stream_range_export", f"""
WITH {LOG} SELECT ms || '-' || seq AS entry_id, '{{"event_id":"' || ms || '-' || seq || '","envelope_id":"' || envelope_id ||
  '","source_type":"' || source_type || '","host":"' || host || '","raw_payload":' || CAST(to_json(raw_payload) AS VARCHAR) || '}}' AS line
FROM entries WHERE stream = 'telemetry:ollama'""")
def stream_range_export(spark, sf):
    return landed_log(spark, sf).export_range("telemetry:ollama")


@query("stream_retention", f"""
WITH {LOG} SELECT stream, ms || '-' || seq AS entry_id FROM entries
QUALIFY row_number() OVER (PARTITION BY stream ORDER BY ms DESC, seq DESC) <= 1000""")
def stream_retention(spark, sf):
    return log.retain_newest(entries(spark, sf), 1000).select("stream", "entry_id")


@query("stream_id_parse", f"WITH {LOG} SELECT ms || '-' || seq AS entry_id, ms, seq FROM entries")
def stream_id_parse(spark, sf):
    return entries(spark, sf).select("entry_id", "ms", "seq")


@query("envelope_publish", f"""
WITH {EV} SELECT ingest_source AS source_type, CASE WHEN k < 50 THEN host ELSE 'localhost' END AS host,
  '{{"identity":"' || identity || '","event_name":"' || event_type || '","success":' || (k < 50) || '}}' AS raw_payload FROM ev""")
def envelope_publish(spark, sf):
    ev = event_frame(spark, sf)
    payload = F.struct("identity", F.col("event_type").alias("event_name"), (F.col("k") < 50).alias("success"))
    return log.envelope(ev, F.col("ingest_source"), payload, F.when(F.col("k") < 50, F.col("host"))).drop(
        "envelope_id", "ingested_at"
    )


@query("uuid", "SELECT count(*) AS n, count(*) AS distinct_ids, 36 AS id_length FROM events")
def uuid(spark, sf):
    wrapped = log.envelope(event_frame(spark, sf), F.col("ingest_source"), F.col("event_type"))
    return wrapped.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("envelope_id").alias("distinct_ids"), F.max(F.length("envelope_id")).alias("id_length")
    )


@query("now_utc", f"WITH {EV} SELECT ingest_source AS source_type, count(*) AS n, TRUE AS within_run, TRUE AS in_form FROM ev GROUP BY 1")
def now_utc(spark, sf):
    begun = datetime.datetime.now(datetime.timezone.utc) - datetime.timedelta(seconds=2)
    wrapped = log.envelope(event_frame(spark, sf), F.col("ingest_source"), F.col("event_type"))
    at = F.col("ingested_at").cast("timestamp")
    return wrapped.groupBy("source_type").agg(
        F.count(F.lit(1)).alias("n"), F.every(at.between(F.lit(begun), F.current_timestamp() + F.expr("INTERVAL 1 MINUTE"))).alias("within_run"),
        F.every(F.col("ingested_at").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|\+00:00)$")).alias("in_form"),
    )


# --- sinks ---------------------------------------------------------------------------------


@query("sink_jsonl", f"WITH {TELE} SELECT event_id, {iso('ts_us')} AS timestamp, ingest_source AS source_type FROM good")
def sink_jsonl(spark, sf):
    path = scratch_path(spark, "events")
    sinks.write_jsonl(normalize_lines(telemetry_raw(spark, sf)).drop("ts"), path)
    return spark.read.schema("event_id string, timestamp string, source_type string").json(path)


# Written by run_preprocessing: lines of each of its four outputs.
@query("source_outputs", f"""
WITH {TELE} SELECT 'preprocessed' AS output, ingest_source, count(*) AS records FROM good GROUP BY ALL
UNION ALL SELECT 'errors', ingest_source, count(*) FROM tele WHERE stage IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'windows/fixed', ingest_source, count(DISTINCT ts_us // 60000000) FROM good GROUP BY ALL
UNION ALL SELECT 'windows/session', ingest_source, sum(starts) FROM (
  SELECT ingest_source, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY ingest_source, coalesce(identity, '<unknown>'), host
    ORDER BY ts_us) <= 300000000 THEN 0 ELSE 1 END AS starts FROM good) GROUP BY ALL""")
def source_outputs(spark, sf):
    path = scratch_path(spark, "run")
    run_preprocessing(materialize(telemetry_raw(spark, sf), "lines", "zstd"), path)
    parts = [
        spark.read.text(f"{path}/{name}").groupBy("ingest_source").agg(F.count(F.lit(1)).alias("records"))
        .withColumn("output", F.lit(name))
        for name in OUTPUTS
    ]
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    return both


@query("pipeline_outputs", f"""
WITH {TELE}, g AS (SELECT ingest_source, ts_us, lag(ts_us) OVER (PARTITION BY ingest_source, coalesce(identity, '<unknown>'), host ORDER BY ts_us) AS before FROM good)
SELECT 'preprocessed' AS output, ingest_source, count(*) AS records FROM good GROUP BY ALL
UNION ALL SELECT 'errors', ingest_source, count(*) FROM tele WHERE stage IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'windows/fixed', ingest_source, count(DISTINCT ts_us // 60000000) FROM good GROUP BY ALL
UNION ALL SELECT 'windows/session', ingest_source, count(*) FROM g WHERE before IS NULL OR ts_us - before > 300000000 GROUP BY ALL
UNION ALL SELECT name, ingest_source, count(*) FROM good, (VALUES ('windows/fixed_members'), ('windows/session_members')) v(name) GROUP BY ALL""")
def pipeline_outputs(spark, sf):
    path = scratch_path(spark, "run")
    run_preprocessing(materialize(telemetry_raw(spark, sf), "lines"), path)
    counts = [
        spark.read.text(f"{path}/{name}").groupBy("ingest_source").agg(F.count(F.lit(1)).alias("records")).withColumn("output", F.lit(name))
        for name in (*OUTPUTS, "windows/fixed_members", "windows/session_members")
    ]
    return functools.reduce(DataFrame.unionByName, counts)


@query("run_summary", f"""
WITH {TELE}, s AS (SELECT ingest_source, sum(starts) AS n FROM (
  SELECT ingest_source, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY ingest_source, coalesce(identity, '<unknown>'), host
    ORDER BY ts_us) <= 300000000 THEN 0 ELSE 1 END AS starts FROM good) GROUP BY 1)
SELECT ingest_source AS source_type, count(*) AS raw_event_count, count(*) FILTER (stage IS NULL) AS valid_event_count,
  count(*) FILTER (stage IS NOT NULL) AS error_count,
  count(DISTINCT ts_us // 60000000) FILTER (stage IS NULL) AS fixed_window_count, CAST(any_value(s.n) AS BIGINT) AS session_window_count,
  'preprocessed/ingest_source=' || ingest_source AS preprocessed_file, 'windows/fixed/ingest_source=' || ingest_source AS fixed_window_file,
  'windows/session/ingest_source=' || ingest_source AS session_window_file, 'errors/ingest_source=' || ingest_source AS error_file
FROM tele JOIN s USING (ingest_source) GROUP BY ingest_source""")
def run_summary_query(spark, sf):
    return run_summary(telemetry_raw(spark, sf))


@query("csv_export", f"""
WITH {TELE} SELECT event_id, {iso('ts_us')} AS timestamp, identity, host, action, CASE WHEN is_ollama THEN 'question "é" ' || n END AS prompt,
  CASE WHEN is_ollama THEN 'answer' || chr(10) || n END AS response, 21 AS columns FROM good""")
def csv_export(spark, sf):
    path = scratch_path(spark, "csv")
    sinks.write_csv(normalize_lines(telemetry_raw(spark, sf)).drop("ts", "ingest_source"), path)
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return back.select(
        "event_id", "timestamp", "identity", "host", "action", "prompt", "response", F.lit(len(back.columns)).alias("columns")
    )


@query("partitioned_export", f"""
WITH {EV} SELECT CASE WHEN user_id % 10 < 8 THEN 'train' WHEN user_id % 10 = 8 THEN 'val' ELSE 'test' END AS split,
  'run-' || (user_id % 20) AS scenario_run_id, k >= 90 AS real_seed, count(*) AS n FROM ev GROUP BY ALL""")
def partitioned_export(spark, sf):
    path = scratch_path(spark, "labelled")
    tenth = F.pmod(F.col("user_id"), F.lit(10))
    rows = event_frame(spark, sf).select(
        "event_id", "identity", "action", (F.col("k") >= 90).alias("is_real"),
        F.when(tenth < 8, "train").when(tenth == 8, "val").otherwise("test").alias("split"),
        F.concat(F.lit("run-"), F.pmod(F.col("user_id"), F.lit(20)).cast("string")).alias("scenario_run_id"),
    )
    rows = sinks.spread_by_run(rows, "scenario_run_id")
    sinks.write_partitioned(rows, path, ["split", "scenario_run_id"], F.col("is_real"))
    def back(name):
        return spark.read.text(f"{path}/{name}").groupBy("split", "scenario_run_id").agg(F.count(F.lit(1)).alias("n"))
    return back("generated").withColumn("real_seed", F.lit(False)).unionByName(
        back("real_seed").withColumn("real_seed", F.lit(True))
    )


# --- parsing, validation, normalisation ----------------------------------------------------


@query("parse_payload", """
SELECT event_id AS n, CASE event_id % 7 WHEN 1 THEN 'Empty raw payload' WHEN 2 THEN 'JSON payload must be an object'
  WHEN 3 THEN 'Invalid JSON payload' WHEN 4 THEN 'Unsupported payload type: NoneType' WHEN 5 THEN 'Unsupported payload type: list' END AS error,
  CASE WHEN event_id % 7 IN (0, 6) THEN 'user-' || user_id END AS identity FROM events""")
def parse_payload_query(spark, sf):
    n = F.col("event_id")
    form = F.pmod(n, F.lit(7))
    good = F.to_json(F.struct(F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("identity")))
    rows = read_table(spark, sf, "events").select(
        n.alias("n"),
        F.when(form == 0, good).when(form == 6, F.concat(F.lit(" \n"), good, F.lit("\t")))
        .when(form == 1, "  ").when(form == 2, "[1]").when(form == 3, F.concat(good, F.lit(" x")))
        .when(form == 4, "null").otherwise("[1]").alias("payload"),
        F.when(form == 4, "VOID").when(form == 5, "ARRAY<BIGINT>").otherwise("STRING").alias("kind"),
    )
    parsed = parse_payload(rows, "payload", "kind")
    return parsed.select("n", F.col("parse_error").alias("error"), variants.text_of(F.col("_body.identity")).alias("identity"))


@query("parse_envelope", f"""
WITH {TELE} SELECT event_id, CASE WHEN n % 4 IN (0, 1) THEN host END AS host,
  CASE WHEN n % 89 = 0 THEN ' SysLog ' WHEN n % 17 = 0 THEN ' ' || upper(ingest_source) || ' ' ELSE ingest_source END AS source_type
FROM tele WHERE stage IS NULL OR stage IN ('validate', 'normalize')""")
def parse_envelope(spark, sf):
    merged = classified(spark, sf).filter(F.coalesce("stage", F.lit("")).isin("", "validate", "normalize"))
    return merged.select(
        event_id().alias("event_id"), merged_text("host").alias("host"), merged_text("source_type").alias("source_type")
    )


@query("validate_event", f"""
WITH {TELE} SELECT ingest_source, coalesce(CASE WHEN stage = 'validate' THEN error END, 'valid') AS result, count(*) AS n FROM tele
WHERE stage IS NULL OR stage IN ('validate', 'normalize') GROUP BY ALL""")
def validate_event(spark, sf):
    rows = classified(spark, sf).filter(F.coalesce("stage", F.lit("")).isin("", "validate", "normalize"))
    result = F.when(F.col("stage") == "validate", F.col("error")).otherwise("valid")
    return rows.groupBy("ingest_source", result.alias("result")).agg(F.count(F.lit(1)).alias("n"))


@query("split_valid_invalid", f"""
WITH {TELE} SELECT ingest_source, stage IS NULL AS valid, count(*) AS n FROM tele GROUP BY ALL""")
def split_valid_invalid_query(spark, sf):
    parsed = materialize(classified(spark, sf).select("ingest_source", "stage", "error", "line"), "parsed")
    valid, invalid = split_valid_invalid(parsed)
    return valid.select("ingest_source", F.lit(True).alias("valid")).unionByName(
        invalid.select("ingest_source", F.lit(False).alias("valid"))
    ).groupBy("ingest_source", "valid").agg(F.count(F.lit(1)).alias("n"))


@query("supported_sources", f"WITH {TELE} SELECT ingest_source AS source_type, count(*) AS n FROM good GROUP BY 1")
def supported_sources(spark, sf):
    known = spark.createDataFrame([(s,) for s in SOURCES], "source_type string")
    rows = classified(spark, sf).filter(F.col("stage").isNull())
    return rows.join(F.broadcast(known), "source_type", "left_semi").groupBy("source_type").agg(F.count(F.lit(1)).alias("n"))


FIELDS_SQL = f"""
SELECT event_id, {iso('ts_us')} AS timestamp, ingest_source AS source_type, host, identity, et AS event_type, action,
  CASE WHEN is_host THEN 'proc-' || n END AS process_name,
  CASE WHEN is_host AND n % 4 = 0 THEN '/opt/proc-' || n WHEN is_host AND n % 4 = 1 THEN 'proc-' || n END AS process_path,
  CASE WHEN is_host AND n % 4 <> 3 THEN 'parent-' || n END AS parent_process,
  CASE WHEN is_host THEN CAST(n AS VARCHAR) END AS parent_pid,
  CASE WHEN is_host THEN 'run ' || n END AS command_line,
  CASE WHEN n % 6 = 4 THEN 'secret/' || n END AS resource, '10.0.0.1' AS source_ip,
  CASE WHEN is_access THEN 'agent/1' END AS user_agent,
  CASE WHEN is_access AND n % 41 <> 0 THEN n % 2 = 0 END AS success,
  CASE WHEN is_ollama THEN 'model-a' END AS model, CASE WHEN is_ollama THEN 'question "é" ' || n END AS prompt,
  CASE WHEN is_ollama THEN 'answer' || chr(10) || n END AS response,
  CASE WHEN is_ollama AND n // 6 % 4 IN (0, 1) THEN round(value * 10, 2) END AS latency_ms,
  strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%S.%f+00:00') AS ingested_at
FROM good"""


@query("normalize_event", f"WITH {TELE} {FIELDS_SQL}")
def normalize_event(spark, sf):
    return normalize_lines(telemetry_raw(spark, sf)).select(*[f for f in EVENT_FIELDS if f != "raw_payload"])


@query("raw_payload", f"""
WITH {TELE} SELECT event_id, CASE WHEN n % 3 <> 2 THEN 'env-' || n END AS envelope_id,
  CASE WHEN n % 17 = 0 THEN ' ' || upper(ingest_source) || ' ' ELSE ingest_source END AS source_type,
  CASE WHEN is_host AND n % 4 = 3 THEN 'parent-' || n END AS parent_image FROM good""")
def raw_payload(spark, sf):
    def get(key):
        return F.try_variant_get("raw_payload", f"$.{key}", "string").alias(key)
    return normalize_lines(telemetry_raw(spark, sf)).select("event_id", get("envelope_id"), get("source_type"), get("parent_image"))


@query("first_non_empty", """
SELECT event_id AS n, CASE WHEN event_id % 3 = 0 THEN CAST(event_id AS VARCHAR) WHEN event_id % 5 = 0 THEN NULL
  WHEN event_id % 2 = 0 THEN event_type END AS chosen FROM events""")
def first_non_empty(spark, sf):
    n = F.col("event_id")
    a = F.when(F.pmod(n, F.lit(3)) == 0, F.concat(F.lit(" "), n.cast("string"))).otherwise("")
    b = F.when(F.pmod(n, F.lit(5)) == 0, "   ")
    c = F.when(F.pmod(n, F.lit(2)) == 0, F.col("event_type")).otherwise("")
    return read_table(spark, sf, "events").select(
        n.alias("n"), text.clean_string(text.first_non_empty(a, b, c)).alias("chosen")
    )


@query("normalize_errors", f"WITH {TELE} SELECT ingest_source, error, count(*) AS n FROM tele WHERE stage = 'normalize' GROUP BY ALL")
def normalize_errors(spark, sf):
    rows = classified(spark, sf).filter(F.col("stage") == "normalize")
    return rows.groupBy("ingest_source", "error").agg(F.count(F.lit(1)).alias("n"))


@query("dead_letter", f"WITH {TELE} SELECT ingest_source, stage, error, count(*) AS n FROM tele WHERE stage IS NOT NULL GROUP BY ALL")
def dead_letter(spark, sf):
    return dead_letters(classified(spark, sf)).groupBy("ingest_source", "stage", "error").agg(F.count(F.lit(1)).alias("n"))


@query("union_errors", f"WITH {TELE} SELECT stage, count(*) AS n FROM tele WHERE stage IS NOT NULL GROUP BY ALL")
def union_errors(spark, sf):
    letters = materialize(dead_letters(classified(spark, sf)), "letters")  # read twice, parsed once
    early = letters.filter(F.col("stage").isin("read", "parse"))
    late = letters.filter(~F.col("stage").isin("read", "parse")).withColumn("raw", F.col("raw"))
    return early.unionByName(late, allowMissingColumns=True).groupBy("stage").agg(F.count(F.lit(1)).alias("n"))


@query("to_record", f"WITH {TELE} SELECT event_id, {iso('ts_us')} AS timestamp, identity, et AS event_type FROM good")
def to_record_query(spark, sf):
    record = to_record(normalize_lines(telemetry_raw(spark, sf)))
    return record.select(
        "event_id", *[F.get_json_object("record", f"$.{k}").alias(k) for k in ("timestamp", "identity", "event_type")]
    )


@query("source_adapter", f"""
WITH {TELE} SELECT event_id, CASE WHEN n % 12 = 0 AND n % 23 <> 0 AND n % 29 <> 0 THEN 'user-' || user_id ELSE identity END AS identity,
  CASE WHEN n % 6 = 0 AND n % 4 <> 3 OR n % 6 = 1 AND n % 4 <> 3 OR n % 6 = 0 THEN 'parent-' || n END AS parent_process FROM good""")
def source_adapter(spark, sf):
    return normalize_lines(telemetry_raw(spark, sf), by_source=True).select("event_id", "identity", "parent_process")


CHECKED = [f for f in EVENT_FIELDS if f != "raw_payload"]


@query("schema_conformance", f"""
WITH {TELE}, f AS ({FIELDS_SQL}), v AS (SELECT count(*) FILTER (is_access AND n % 41 = 0) AS bad FROM good)
SELECT c AS field, CAST(n AS BIGINT) AS nulls, CASE c WHEN 'success' THEN bad ELSE 0 END AS violations FROM (
  SELECT {', '.join(f'count(*) FILTER ({c} IS NULL) AS {c}' for c in CHECKED)}, 0 AS raw_payload FROM f)
UNPIVOT (n FOR c IN ({', '.join(EVENT_FIELDS)})), v""")
def schema_conformance(spark, sf):
    events = normalize_lines(telemetry_raw(spark, sf))
    stated = lambda key: F.try_variant_get("raw_payload", f"$.{key}", "variant")
    texts = [f for f in CHECKED if f not in ("success", "latency_ms")]
    rules = {f: ~F.col(f).rlike(r"\S") for f in texts}
    rules |= {
        "source_type": ~F.col("source_type").isin(*SOURCES), "timestamp": ~F.col("timestamp").rlike("^[0-9T:.-]+Z$"),
        "success": F.coalesce(variants.type_of(stated("success")) != "BOOLEAN", F.lit(False)) & F.col("success").isNull(),
        "latency_ms": F.col("latency_ms") < 0,
    }
    return conformance(events, list(EVENT_FIELDS), rules)


@query("alias_table", f"WITH {TELE}, f AS ({FIELDS_SQL}) SELECT event_id, {', '.join(ALIASES)} FROM f")
def alias_table(spark, sf):
    rows = classified(spark, sf).filter(F.col("stage").isNull())
    return rows.select(event_id().alias("event_id"), *(text.clean_string(alias_column(name)).alias(name) for name in ALIASES))


# --- calls ---------------------------------------------------------------------------------


@query("latency_extract", """
WITH p AS (SELECT event_id // 2 AS call_id, max(epoch_us(ts)) - min(epoch_us(ts)) AS d, count(*) AS c FROM events GROUP BY 1)
SELECT call_id, CASE WHEN c = 2 THEN (d + 5) // 10 / 100.0 END AS latency_ms FROM p""")
def latency_extract(spark, sf):
    ev = event_frame(spark, sf).withColumn("call_id", F.call_function("div", F.col("n"), F.lit(2)))
    return access.call_latency(ev, "call_id", F.pmod(F.col("n"), F.lit(2)) == 0)


@query("generate_telemetry", f"""
WITH {EV} SELECT identity, 'model-a' AS model, 'prompt ' || n AS prompt, CASE n % 3 WHEN 0 THEN 'r-' || n WHEN 1 THEN 'oops ' || n
  ELSE '[' || n || ']' END AS response, round(value, 2) AS latency_ms, '10.0.0.1' AS source_ip FROM ev""")
def generate_telemetry(spark, sf):
    number, form = F.col("n").cast("string"), F.pmod(F.col("n"), F.lit(3))
    calls = event_frame(spark, sf).select(
        "identity", F.lit("model-a").alias("model"), F.concat(F.lit("prompt "), number).alias("prompt"),
        F.when(form == 0, F.concat(F.lit('{"response":"r-'), number, F.lit('","done":true}')))
        .when(form == 1, F.concat(F.lit("oops "), number)).otherwise(F.concat(F.lit("["), number, F.lit("]"))).alias("response_body"),
        F.round("value", 2).alias("latency_ms"), F.lit("10.0.0.1").alias("source_ip"),
    )
    return access.generate_telemetry(calls)


@query("chat_telemetry", """
WITH c AS (SELECT conv_id, 'svc-' || (conv_id % 7) AS identity, 'model-' || (conv_id % 3) AS model, CAST(conv_id % 1000 AS DOUBLE) AS latency_ms,
                  CASE WHEN conv_id % 5 = 0 THEN 'said ' || conv_id END AS body, arg_max(role, turn) AS last_role, arg_max(text, turn) AS said
           FROM conversations GROUP BY conv_id)
SELECT conv_id, role, text AS content, count(*) OVER (PARTITION BY conv_id) AS messages,
       row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position, identity, model, latency_ms,
       coalesce(body, CASE WHEN last_role = 'assistant' THEN said END) AS response
FROM conversations JOIN c USING (conv_id)""")
def chat_telemetry(spark, sf):
    turns = read_table(spark, sf, "conversations")
    chat = F.col("conv_id")
    calls = turns.select("conv_id").distinct().select(
        "conv_id", F.concat(F.lit("svc-"), (chat % 7).cast("string")).alias("identity"),
        F.concat(F.lit("model-"), (chat % 3).cast("string")).alias("model"), (chat % 1000).cast("double").alias("latency_ms"),
        F.when(chat % 5 == 0, F.concat(F.lit('{"response": "said '), chat.cast("string"), F.lit('"}'))).alias("response_body"),
    )
    found = access.chat_telemetry(turns, "conv_id", "turn", calls)
    return found.select("conv_id", "role", "content", "messages", "position", "identity", "model", "latency_ms", "response")


@query("required_header", f"""
WITH {TELE} SELECT event_id, CASE WHEN identity IS NULL THEN 'X-Service-Identity header is required' END AS reject_reason FROM good""")
def required_header(spark, sf):
    return access.require_caller(normalize_lines(telemetry_raw(spark, sf))).select("event_id", "reject_reason")


# --- scalar functions ----------------------------------------------------------------------


@query("clean_string", """
SELECT event_id AS n, CASE WHEN event_id % 4 <> 3 THEN event_type END AS cleaned FROM events""")
def clean_string(spark, sf):
    form = F.pmod(F.col("event_id"), F.lit(4))
    padded = (
        F.when(form == 0, F.concat(F.lit(" \t "), F.col("event_type"), F.lit(" \n")))
        .when(form == 1, F.col("event_type")).when(form == 2, F.concat(F.col("event_type"), F.lit("　")))
        .otherwise("   ")
    )
    return read_table(spark, sf, "events").select(F.col("event_id").alias("n"), text.clean_string(padded).alias("cleaned"))


TIME_SQL = f"""
SELECT event_id AS n, {iso("CASE event_id % 6 WHEN 3 THEN epoch_us(ts) // 1000 * 1000 WHEN 4 THEN epoch_us(ts) // 1000000 * 1000000 WHEN 5 THEN epoch_us(date_trunc('day', ts)) ELSE epoch_us(ts) END")} AS timestamp FROM events"""


def _time_forms(spark, sf):
    ts = times.as_utc(F.col("ts"))
    form = F.pmod(F.col("event_id"), F.lit(6))
    shown = (
        F.when(form == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
        .when(form == 1, F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
        .when(form == 2, F.date_format(ts, "yyyyMMdd'T'HHmmss,SSSSSS'+0000'"))
        .when(form == 3, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'+00:00'"))
        .when(form == 4, F.date_format(ts, "yyyyMMdd'T'HHmmss"))
        .otherwise(F.date_format(ts, "yyyy-MM-dd"))
    )
    return read_table(spark, sf, "events").select(F.col("event_id").alias("n"), shown.alias("shown"))


@query("parse_timestamp", TIME_SQL)
def parse_timestamp(spark, sf):
    return _time_forms(spark, sf).select("n", times.format_iso_z(times.parse_iso(F.col("shown"))).alias("timestamp"))


@query("normalize_timestamp", f"""
SELECT event_id AS n, {iso("CASE event_id % 3 WHEN 0 THEN epoch_us(ts) // 1000 * 1000 WHEN 1 THEN epoch_us(ts) // 1000000 * 1000000 ELSE epoch_us(ts) END")} AS timestamp FROM events""")
def normalize_timestamp(spark, sf):
    us, form = F.unix_micros(times.as_utc(F.col("ts"))), F.pmod(F.col("event_id"), F.lit(3))
    number = (
        F.when(form == 0, F.call_function("div", us, F.lit(1000)).cast("double"))
        .when(form == 1, F.call_function("div", us, F.lit(1_000_000)).cast("double")).otherwise(us / 1e6)
    )
    return read_table(spark, sf, "events").select(
        F.col("event_id").alias("n"), times.format_iso_z(times.from_epoch_number(number)).alias("timestamp")
    )


@query("format_iso_z", f"""
SELECT o_orderkey AS n, {iso('epoch_us(o_orderdate)')} AS timestamp FROM orders
UNION ALL SELECT event_id, {iso('epoch_us(ts)')} FROM events""")
def format_iso_z(spark, sf):
    orders = read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("n"), times.as_utc(F.col("o_orderdate")).alias("ts"))
    events = read_table(spark, sf, "events").select(F.col("event_id").alias("n"), times.as_utc(F.col("ts")).alias("ts"))
    return orders.unionByName(events).select("n", times.format_iso_z(F.col("ts")).alias("timestamp"))


@query("make_event_id", """
SELECT event_id AS n, CASE event_id % 4 WHEN 0 THEN 'evt-' || event_id WHEN 1 THEN 'env-' || event_id
  WHEN 2 THEN sha256('{"event_id":" ","n":' || event_id || ',"source_type":"iam","timestamp":1700000000}')
  ELSE sha256('{"n":' || event_id || ',"source_type":"iam","timestamp":1700000000}') END AS id FROM events""")
def make_event_id(spark, sf):
    n = F.col("event_id")
    number, form = n.cast("string"), F.pmod(n, F.lit(4))
    lead = (
        F.when(form == 0, F.concat(F.lit('"event_id":"evt-'), number, F.lit('",')))
        .when(form == 1, F.concat(F.lit('"event_id":"","envelope_id":"env-'), number, F.lit('",')))
        .when(form == 2, '"event_id":" ",').otherwise("")
    )
    line = F.concat(F.lit("{"), lead, F.lit('"timestamp":1700000000,"source_type":"iam","n":'), number, F.lit("}"))
    rows = read_table(spark, sf, "events").select(F.lit("iam").alias("ingest_source"), n.alias("n"), line.alias("line"))
    return classify(rows).select("n", event_id().alias("id"))


@query("latency_to_double", f"""
WITH {TELE} SELECT event_id, CASE WHEN n // 6 % 4 IN (0, 1) THEN round(value * 10, 2) END AS latency_ms FROM good WHERE is_ollama""")
def latency_to_double(spark, sf):
    events = normalize_lines(telemetry_raw(spark, sf))
    return events.filter(F.col("source_type") == "ollama").select("event_id", "latency_ms")


@query("lower_source", f"WITH {TELE} SELECT event_id, ingest_source AS source_type FROM good")
def lower_source(spark, sf):
    return normalize_lines(telemetry_raw(spark, sf)).select("event_id", "source_type")


@query("json_decode", f"WITH {EV} SELECT event_id, CASE WHEN n % 5 NOT IN (1, 2) THEN k END AS k FROM ev")
def json_decode(spark, sf):
    form = F.pmod(F.col("event_id"), F.lit(5))  # some texts go on after the object
    said = F.when(form == 1, F.concat("props", F.lit(" x"))).when(form == 2, F.concat("props", F.lit(',"z":2'))).otherwise(F.col("props"))
    doc = variants.decode_object(said)
    return read_table(spark, sf, "events").select(
        F.concat(F.lit("evt-"), F.col("event_id").cast("string")).alias("event_id"), F.try_variant_get(doc, "$.k", "int").alias("k")
    )


@query("json_encode", """
SELECT event_id AS n, '{"user_id":' || user_id || ',"event_type":"' || event_type || '","tags":["' || event_type || '"]}' AS record FROM events""")
def json_encode(spark, sf):
    return read_table(spark, sf, "events").select(
        F.col("event_id").alias("n"), F.to_json(F.struct("user_id", "event_type", F.array("event_type").alias("tags"))).alias("record")
    )


@query("utf8_decode", "SELECT doc_id, md5(text) AS text_md5, length(text) AS chars FROM documents")
def utf8_decode(spark, sf):
    decoded = text.decode_utf8(F.encode("text", "UTF-8"))
    return read_table(spark, sf, "documents").select(
        "doc_id", F.md5(decoded).alias("text_md5"), F.length(decoded).cast("long").alias("chars")
    )


@query("round2", "SELECT event_id AS n, round(value / 7.0, 2) AS rounded FROM events")
def round2(spark, sf):
    return read_table(spark, sf, "events").select(F.col("event_id").alias("n"), F.round(F.col("value") / 7.0, 2).alias("rounded"))


@query("method_path_split", f"""
WITH {TELE} SELECT event_id, split_part(action, ' ', 1) AS method, CASE WHEN action LIKE '% %' THEN split_part(action, ' ', 2) END AS path FROM good""")
def method_path_split(spark, sf):
    method, path = text.split_method_path(F.col("action"))
    return normalize_lines(telemetry_raw(spark, sf)).select("event_id", method.alias("method"), path.alias("path"))


@query("feature_names", """
SELECT vec_id, 'Feature_' || (i - 1) AS feature, round(CAST(embedding[i] AS DOUBLE), 6) AS x
FROM embeddings, range(1, 65) t(i)""")
def feature_names(spark, sf):
    rows = read_table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "x"))
    return rows.select("vec_id", text.feature_name(F.col("pos")).alias("feature"), F.round(F.col("x").cast("double"), 6).alias("x"))
