"""Queries: streaming runs over the given tables.

The event rows are landed in three steps by time, and the stream runs once after each, so that windows and
sessions stay open from run to run. The end of a run closes what is open.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from watchloom.plans.oracle_parts import EV, TELE, sessions_cte
from watchloom.plans.registry import query
from watchloom.session import scratch_path
from watchloom.sources.adapter import event_frame, telemetry_raw
from watchloom.streaming import incremental, jobs


def folded(spark, sf, columns, job, steps=None, delay_seconds=600):
    """The run of a job over event rows that land step by step; by default in three thirds of the time they span."""
    rows = event_frame(spark, sf).select(*columns)
    run, landing = incremental.Run(job, scratch_path(spark, "run"), delay_seconds), scratch_path(spark, "landing")
    if steps is None:
        first, last = rows.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
        third = F.least(F.lit(2), F.call_function("div", (F.unix_micros("ts") - (first or 0)) * 3, F.lit(max(1, (last or 0) - (first or 0)))))
        steps = [third == k for k in range(3)]
    for step in steps:
        rows.filter(step).write.mode("append").parquet(landing)
        run.over(spark.readStream.schema(rows.schema).parquet(landing))
    return run


@query("stream_tumbling", f"""
WITH {EV} SELECT ingest_source, us // 3600000000 * 3600000000 AS start_us, count(*) AS event_count FROM ev GROUP BY ALL""")
def stream_tumbling(spark, sf):
    run = folded(spark, sf, ["ingest_source", "ts"], incremental.window_job(3600))
    return run.finish(spark).select("ingest_source", F.unix_micros("start_ts").alias("start_us"), "event_count")


@query("stream_late_rows", f"""
WITH {EV}, c AS (SELECT max(us) - 86400000000 AS wm FROM ev WHERE k < 50), l AS (SELECT ingest_source, us, k >= 50 AND (us // 3600000000 + 1) * 3600000000 <= wm AS late FROM ev, c)
SELECT ingest_source, us // 3600000000 * 3600000000 AS start_us, count(*) FILTER (NOT late) AS counted, count(*) FILTER (late) AS late FROM l GROUP BY ALL""")
def stream_late_rows(spark, sf):
    """Half of the rows arrive when the other half has moved the watermark: those a day or more behind are late."""
    run = folded(spark, sf, ["ingest_source", "ts", "k"], incremental.window_job(3600), [F.col("k") < 50, F.col("k") >= 50], 86400)
    counted = run.finish(spark).select("ingest_source", F.unix_micros("start_ts").alias("start_us"), F.col("event_count").alias("counted"), F.lit(0).alias("late"))
    late = run.late(spark).select("ingest_source", (F.call_function("div", F.unix_micros("ts"), F.lit(3_600_000_000)) * 3_600_000_000).alias("start_us"), F.lit(0).alias("counted"), F.lit(1).alias("late"))
    return counted.unionByName(late).groupBy("ingest_source", "start_us").agg(F.sum("counted").alias("counted"), F.sum("late").alias("late"))


@query("stream_session", f"""
WITH {EV}, {sessions_cte('ev', 'ingest_source, identity, host', 6 * 3600 * 1_000_000)}
SELECT ingest_source, identity, host, start_us, end_us, CAST(event_count AS BIGINT) AS event_count FROM ses""")
def stream_session(spark, sf):
    run = folded(spark, sf, ["ingest_source", "ts", "identity", "host"], incremental.session_job(6 * 3600))
    return run.finish(spark).select(
        "ingest_source", F.col("key_identity").alias("identity"), F.col("key_host").alias("host"),
        F.unix_micros("start_ts").alias("start_us"), F.unix_micros("end_ts").alias("end_us"), "event_count",
    )


@query("stream_temporal_correlation", f"""
WITH {EV}, a AS (SELECT identity, us // 21600000000 AS s, min(us) AS f, max(us) AS l FROM ev WHERE event_type = 'error' GROUP BY ALL),
b AS (SELECT identity, us // 21600000000 AS s, min(us) AS f, max(us) AS l FROM ev WHERE k >= 80 GROUP BY ALL)
SELECT identity, a.f AS a_first_us, b.f AS b_first_us FROM a JOIN b USING (identity)
WHERE a.s = b.s OR (b.s = a.s + 1 AND b.f - a.l <= 21600000000) OR (b.s = a.s - 1 AND a.f - b.l <= 21600000000)""")
def stream_temporal_correlation(spark, sf):
    job = incremental.correlation_job("identity", F.col("event_type") == "error", F.col("k") >= 80, 6 * 3600)
    return folded(spark, sf, ["identity", "ts", "event_type", "k"], job).finish(spark)


@query("stream_dead_letter", f"""
WITH {TELE} SELECT coalesce(error, 'valid') AS result, count(*) AS n FROM tele GROUP BY 1""")
def stream_dead_letter(spark, sf):
    landing, out = scratch_path(spark, "landing"), scratch_path(spark, "split")
    telemetry_raw(spark, sf).write.partitionBy("ingest_source").text(landing)
    jobs.split_stream(jobs.read_landing(spark, f"{landing}/*", "*.txt"), out).awaitTermination()
    good = spark.read.schema("event_id string").json(f"{out}/events/*").select(F.lit("valid").alias("result"))
    bad = spark.read.schema("error string").json(f"{out}/errors/*").select(F.col("error").alias("result"))
    return good.unionByName(bad).groupBy("result").agg(F.count(F.lit(1)).alias("n"))
