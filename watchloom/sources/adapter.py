"""Telemetry lines made from the ``events`` table.

Each event row becomes one JSON line. The row number decides spelling, wrapping and faults,
so that every alias, every timestamp form and every refusal occurs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchloom.functions import times
from watchloom.schemas import SOURCES
from watchloom.session import configure

TASK_ROWS = 100_000  # rows of a table that one task makes lines of and parses


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _every(n: Column, step: int, rest: int = 0) -> Column:
    return F.pmod(n, F.lit(step)) == rest


def _source_of(n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SOURCES]), (F.pmod(n, F.lit(6)) + 1).cast("int"))


def _timestamp_json(n: Column, ts: Column) -> Column:
    iso = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    shifted = F.date_format(ts + F.expr("INTERVAL '5:30' HOUR TO MINUTE"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    micros = F.unix_micros(ts)
    q = F.lit('"')
    form = F.pmod(n, F.lit(5))
    return (
        F.when(_every(n, 97), F.lit(None).cast("string"))
        .when(_every(n, 73), F.lit('"yesterday"'))
        .when(form == 0, F.concat(q, iso, F.lit('Z"')))
        .when(form == 1, F.concat(q, iso, F.lit('+00:00"')))
        .when(form == 2, F.concat(q, shifted, F.lit('+05:30"')))
        .when(form == 3, (micros.cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(10,0)")).cast("decimal(20,6)").cast("string"))
        .otherwise(F.call_function("div", micros, F.lit(1000)).cast("string"))
    )


def telemetry_lines(events: DataFrame) -> DataFrame:
    """``events`` rows -> ``(ingest_source, line)``."""
    n, ts = F.col("event_id"), times.as_utc(F.col("ts"))
    k, k3 = F.pmod(n, F.lit(4)), F.pmod(n, F.lit(3))
    source = _source_of(n)
    et = F.col("event_type")
    is_ollama, is_host = source == "ollama", source.isin("sysmon", "auditd")
    is_access = source.isin("iam", "vault", "api_gateway")
    who = F.concat(F.lit("user-"), F.col("user_id").cast("string"))
    box = F.concat(F.lit("host-"), F.pmod(F.col("user_id"), F.lit(8)).cast("string"))
    number = n.cast("string")
    nobody = _every(n, 23) & ~is_ollama
    blank = _every(n, 29) & ~is_ollama & ~nobody
    by_user = (source == "sysmon") & _every(n, 12) & ~nobody & ~blank
    named = ~nobody & ~blank & ~by_user

    def text(prefix: str) -> Column:
        return F.concat(F.lit(prefix), number)

    def put(condition: Column, value) -> Column:
        return F.when(condition, value if isinstance(value, Column) else F.lit(value))

    lat = F.round(F.col("value") * 10, 2)
    lat_form = F.pmod(F.call_function("div", n, F.lit(6)), F.lit(4))
    slow = is_ollama & _every(n, 71)
    payload = {
        "event_id": put(k3 == 0, text("evt-")),
        "id": put(k3 == 2, text("id-")),
        "identity": put(is_ollama & _every(n, 7), "")
        .when(is_ollama, who)
        .when(blank, "   ")
        .when(named & (k == 0), F.concat(F.lit("  "), who, F.lit("\t")))
        .when(named & (k == 3), ""),
        "service_identity": put((named & ~is_ollama & k.isin(1, 3)) | blank | (is_ollama & _every(n, 7)), who),
        "principal": put(named & ~is_ollama & (k == 2), who),
        "user": put(by_user, who),
        "host": put(k == 1, box).when(k == 3, "masked-host"),
        "hostname": put(k == 2, box),
        "computer": put(k == 3, box),
        "event_type": put(k == 0, et).when(k == 3, ""),
        "event_name": put(k.isin(1, 3), et),
        "type": put(k == 2, et),
        "action": put(k.isin(0, 2), F.concat(F.lit("GET /"), et)),
        "process_name": put(is_host & (k == 0), text("proc-")),
        "Image": put(is_host & (k == 1), text("proc-")),
        "image": put(is_host & (k == 2), text("proc-")),
        "process": put(is_host & (k == 3), text("proc-")),
        "process_path": put(is_host & (k == 0), text("/opt/proc-")),
        "parent_process": put(is_host & k.isin(0, 2), text("parent-")),
        "ParentImage": put(is_host & (k == 1), text("parent-")),
        "parent_image": put(is_host & (k == 3), text("parent-")),
        "parent_pid": put(is_host & k.isin(0, 2), number),
        "command_line": put(is_host & (k == 0), text("run ")),
        "CommandLine": put(is_host & (k == 1), text("run ")),
        "command": put(is_host & (k == 2), text("run ")),
        "cmdline": put(is_host & (k == 3), text("run ")),
        "resource": put((source == "vault") & (k3 == 0), text("secret/")),
        "resource_path": put((source == "vault") & (k3 == 1), text("secret/")),
        "secret_path": put((source == "vault") & (k3 == 2), text("secret/")),
        "source_ip": put(k3 == 0, "10.0.0.1"),
        "src_ip": put(k3 == 1, "10.0.0.1"),
        "client_ip": put(k3 == 2, "10.0.0.1"),
        "user_agent": put(is_access & k.isin(0, 2), "agent/1"),
        "UserAgent": put(is_access & k.isin(1, 3), "agent/1"),
        "model": put(is_ollama, "model-a"),
        "prompt": put(is_ollama, text("question \"é\" ")),
        "response": put(is_ollama, text("answer\n")),
    }
    # Values whose JSON type varies are written as JSON text.
    varying = {
        "timestamp": _timestamp_json(n, ts),
        "ParentProcessId": put(is_host & k.isin(1, 3), number),
        "success": put(is_access & _every(n, 41), '"yes"')
        .when(is_access & _every(n, 2), "true").when(is_access, "false"),
        "latency_ms": put(slow, '"fast"')
        .when(is_ollama & (lat_form == 0), lat.cast("string"))
        .when(is_ollama & (lat_form == 1), F.concat(F.lit('" '), lat.cast("string"), F.lit(' "')))
        .when(is_ollama & (lat_form == 2), '""'),
    }

    def members(fields: dict[str, Column]) -> Column:
        """JSON members without braces; NULL values are left out."""
        return F.concat_ws(",", *[F.concat(F.lit(f'"{name}":'), value) for name, value in fields.items()])

    plain = F.to_json(F.struct(*[v.alias(name) for name, v in payload.items()]))
    inner = F.expr("substring(_plain, 2, length(_plain) - 2)")
    stated_source = (
        F.when(_every(n, 89), " SysLog ")
        .when(_every(n, 17), F.concat(F.lit(" "), F.upper(source), F.lit(" ")))
        .otherwise(source)
    )

    def quoted(value: Column) -> Column:
        return F.concat(F.lit('"'), value, F.lit('"'))

    envelope = {
        "envelope_id": put(k3 != 2, quoted(text("env-"))),
        "source_type": quoted(stated_source),
        "host": put(k == 0, quoted(box)).when(k == 3, "null"),
        "ingested_at": quoted(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")),
    }
    frame = events.select(
        n.alias("n"), source.alias("ingest_source"), plain.alias("_plain"),
        members(varying).alias("_varying"), members(envelope).alias("_envelope"),
    )
    body = F.concat_ws(",", F.nullif(inner, F.lit("")), F.nullif(F.col("_varying"), F.lit("")))
    frame = frame.withColumn("_body", body)
    as_object = F.concat(F.lit("{"), F.col("_body"), F.lit("}"))
    as_text = F.expr("substring(_quoted, 6, length(_quoted) - 6)")
    frame = frame.withColumn(
        "_quoted",
        F.to_json(F.struct(F.when(_every(F.col("n"), 79), "[1]").otherwise(as_object).alias("p"))),
    )
    number = F.col("n")
    line = (
        F.when(_every(number, 79), F.concat(F.lit("{"), F.col("_envelope"), F.lit(',"raw_payload":'), as_text, F.lit("}")))
        .when(_every(number, 11), F.concat(F.lit("{"), F.col("_body"), F.lit(","), F.col("_envelope"), F.lit("}")))
        .when(_every(number, 13), F.concat(F.lit("{"), F.col("_envelope"), F.lit(',"raw_payload":'), as_object, F.lit("}")))
        .otherwise(F.concat(F.lit("{"), F.col("_envelope"), F.lit(',"raw_payload":'), as_text, F.lit("}")))
    )
    line = F.when(_every(number, 83), F.expr("substring(_envelope, 1, 40)")).otherwise(line)
    return frame.select("ingest_source", line.alias("line"))


def telemetry_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry_lines(spread(read_table(spark, sf_dir, "events")))


def spread(df: DataFrame, rows: int = TASK_ROWS) -> DataFrame:
    """Hand the rows to all cores before costly work, about ``rows`` of them to a task.

    File splits don't do that: a Parquet file has as many as its bytes allow, but one of them reads a whole row
    group and the others nothing. Rows are dealt by all their values, so null or repeated ids don't crowd a task.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(df.count() / rows))
    return df.repartition(tasks, *df.columns)


def event_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table with the names of the event model, for operators past parsing."""
    n = F.col("event_id")
    return read_table(spark, sf_dir, "events").select(
        n.alias("n"),
        F.concat(F.lit("evt-"), n.cast("string")).alias("event_id"),
        times.as_utc(F.col("ts")).alias("ts"),
        _source_of(n).alias("ingest_source"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("identity"),
        F.concat(F.lit("host-"), F.pmod(F.col("user_id"), F.lit(8)).cast("string")).alias("host"),
        F.col("event_type"), F.col("event_type").alias("action"), F.col("value"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.col("user_id"),
    )
