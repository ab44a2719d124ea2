"""Queries: windows, sessions, ordering."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchloom.functions import times
from watchloom.functions.text import session_key
from watchloom.operators import windows as win
from watchloom.operators.normalize import normalize_lines, sort_events
from watchloom.plans.oracle_parts import EV, TELE, iso, sessions_cte
from watchloom.plans.registry import query
from watchloom.session import materialize
from watchloom.sources.adapter import event_frame, read_table, telemetry_raw

HOUR_US = 3_600_000_000
GOOD = "g AS (SELECT ingest_source, event_id, ts_us AS us, coalesce(identity, '<unknown>') AS identity, host FROM good)"


def good_events(spark, sf):
    return normalize_lines(telemetry_raw(spark, sf))


@query("session_agg", f"""
WITH {TELE}, {GOOD}, {sessions_cte('g', 'ingest_source, identity, host', 6 * HOUR_US)}
SELECT ingest_source, identity, host, {iso('start_us')} AS start_time, {iso('end_us')} AS end_time,
       CAST(event_count AS BIGINT) AS event_count FROM ses""")
def session_agg(spark, sf):
    found = win.sessions(good_events(spark, sf), 6 * 3600)
    return found.select("ingest_source", "session_key.identity", "session_key.host", "start_time", "end_time", "event_count")


@query("fixed_window_agg", f"""
WITH {TELE}
SELECT ingest_source, 'fixed_' || strftime(make_timestamp(w), '%Y%m%dT%H%M%SZ') || '_3600s' AS window_id, event_id,
       count(*) OVER (PARTITION BY ingest_source, w) AS event_count,
       row_number() OVER (PARTITION BY ingest_source, w ORDER BY ts_us, event_id) - 1 AS position
FROM (SELECT *, ts_us // {HOUR_US} * {HOUR_US} AS w FROM good)""")
def fixed_window_agg(spark, sf):
    # The members are sorted by ranges, which reads its input twice: once for the cuts, once to move it.
    events = materialize(good_events(spark, sf).select("ingest_source", "ts", "event_id"), "events")
    return win.fixed_window_members(events, 3600).select("ingest_source", "window_id", "event_count", "position", "event_id")


@query("tumbling_window", f"""
WITH {TELE}
SELECT ingest_source, 'fixed_' || strftime(make_timestamp(w), '%Y%m%dT%H%M%SZ') || '_60s' AS window_id,
       'fixed_time' AS window_type, strftime(make_timestamp(w), '%Y-%m-%dT%H:%M:%SZ') AS start_time,
       strftime(make_timestamp(w + 60000000), '%Y-%m-%dT%H:%M:%SZ') AS end_time, count(*) AS event_count
FROM (SELECT *, ts_us // 60000000 * 60000000 AS w FROM good) GROUP BY ingest_source, w""")
def tumbling_window(spark, sf):
    return win.fixed_windows(good_events(spark, sf))


@query("session_window", f"""
WITH {EV}, {sessions_cte('ev', 'ingest_source, identity, host', 300 * 1_000_000)}
SELECT ingest_source, identity, host, start_us, end_us, CAST(event_count AS BIGINT) AS event_count FROM ses""")
def session_window(spark, sf):
    found = win.sessions(event_frame(spark, sf))
    return found.select(
        "ingest_source", "session_key.identity", "session_key.host",
        F.unix_micros("start_ts").alias("start_us"), F.unix_micros("end_ts").alias("end_us"), "event_count",
    )


@query("session_key_fields", f"""
WITH {EV}, {sessions_cte('ev', 'event_type', 6 * 60 * 1_000_000)}
SELECT event_type, start_us, end_us, CAST(event_count AS BIGINT) AS event_count FROM ses""")
def session_key_fields(spark, sf):
    found = win.sessions(event_frame(spark, sf), 360, key_fields=("event_type",), group=None)
    return found.select(
        "session_key.event_type", F.unix_micros("start_ts").alias("start_us"),
        F.unix_micros("end_ts").alias("end_us"), "event_count",
    )


@query("session_events", f"""
WITH {EV}, {sessions_cte('ev', 'ingest_source, identity, host', 6 * HOUR_US)}
SELECT ingest_source, identity, host, start_us, event_id, count(*) OVER (PARTITION BY ingest_source, identity, host, session_no) AS event_count,
       row_number() OVER (PARTITION BY ingest_source, identity, host, session_no ORDER BY us, event_id) - 1 AS position
FROM ses JOIN ses_ev USING (ingest_source, identity, host, session_no)""")
def session_events(spark, sf):
    events = event_frame(spark, sf).select("ingest_source", "ts", "event_id", "identity", "host")
    return win.session_members(events, 6 * 3600).select(
        "ingest_source", "session_key.identity", "session_key.host",
        F.unix_micros(F.col("start_time").cast("timestamp")).alias("start_us"), "event_count", "position", "event_id",
    )


@query("group_by_key", f"""
WITH {TELE}
SELECT coalesce(identity, '<unknown>') AS key_identity, host AS key_host, count(*) AS event_count,
       min(ts_us) AS first_us, max(ts_us) AS last_us FROM good GROUP BY 1, 2""")
def group_by_key(spark, sf):
    return win.group_by_key(good_events(spark, sf)).select(
        "key_identity", "key_host", "event_count",
        F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"),
    )


@query("gap_to_previous", f"""
WITH {EV} SELECT identity, host, event_id, us - lag(us) OVER (PARTITION BY identity, host ORDER BY us, event_id) AS gap_us
FROM ev""")
def gap_to_previous(spark, sf):
    events = event_frame(spark, sf).select("event_id", "ts", "identity", "host")
    return win.gap_to_previous(events, ["identity", "host"]).select("identity", "host", "event_id", "gap_us")


@query("session_ordinal", f"""
WITH {EV}, {sessions_cte('ev', 'ingest_source, identity, host', 6 * HOUR_US)},
firsts AS (SELECT *, min(start_us) OVER (PARTITION BY ingest_source, identity, host) AS first_us FROM ses)
SELECT ingest_source, identity, host, start_us, 'session_' || lpad(CAST(row_number() OVER (PARTITION BY ingest_source
  ORDER BY first_us, identity, host, session_no) AS VARCHAR), 6, '0') AS window_id FROM firsts""")
def session_ordinal(spark, sf):
    found = win.sessions(event_frame(spark, sf), 6 * 3600, ids="ordinal")
    return found.select(
        "ingest_source", "session_key.identity", "session_key.host",
        F.unix_micros("start_ts").alias("start_us"), "window_id",
    )


@query("sort_events_text", f"""
WITH {TELE} SELECT event_id, {iso('ts_us')} AS timestamp FROM good ORDER BY 2, 1""")
def sort_events_text(spark, sf):
    # A global sort samples its input first: parse once.
    events = materialize(good_events(spark, sf).select("event_id", "timestamp"), "events")
    return sort_events(events, order="text")


@query("sort_by_time", f"WITH {EV} SELECT identity, event_id, us FROM ev ORDER BY us, event_id")
def sort_by_time(spark, sf):
    return sort_events(event_frame(spark, sf)).select("identity", "event_id", F.unix_micros("ts").alias("us"))


@query("sort_sessions", f"""
WITH {EV}, {sessions_cte('ev', 'ingest_source, identity, host', 24 * HOUR_US)}
SELECT identity, host, ingest_source, {iso('start_us')} AS start_time, {iso('end_us')} AS end_time FROM ses ORDER BY start_us""")
def sort_sessions(spark, sf):
    found = win.sort_sessions(win.sessions(event_frame(spark, sf), 24 * 3600))
    return found.select("session_key.identity", "session_key.host", "ingest_source", "start_time", "end_time")


@query("window_floor", f"WITH {EV} SELECT event_id, us // 60000000 * 60000000 AS start_us FROM ev")
def window_floor(spark, sf):
    return event_frame(spark, sf).select(
        "event_id", F.unix_micros(times.window_floor(F.col("ts"), 60)).alias("start_us")
    )


@query("window_id_fixed", f"""
WITH {EV} SELECT event_id, 'fixed_' || strftime(make_timestamp(us // 60000000 * 60000000), '%Y%m%dT%H%M%SZ') || '_60s'
  AS window_id FROM ev""")
def window_id_fixed(spark, sf):
    return win.fixed_window_events(event_frame(spark, sf), 60).select("event_id", "window_id")


@query("session_key", f"""
WITH {TELE} SELECT event_id, coalesce(identity, '<unknown>') AS key_identity, host AS key_host FROM good""")
def session_key_query(spark, sf):
    return good_events(spark, sf).select(
        "event_id", session_key(F.col("identity")).alias("key_identity"), session_key(F.col("host")).alias("key_host")
    )


@query("window_config", f"""
WITH {EV} SELECT ingest_source, us // 900000000 * 900000000 AS start_us, count(*) AS event_count FROM ev GROUP BY ALL""")
def window_config(spark, sf):
    for name, seconds in (("window_seconds", 0), ("session_gap_seconds", -1)):
        try:
            win.check_seconds(name, seconds)
        except ValueError:
            continue
        raise AssertionError(f"{name}={seconds} was accepted")
    found = win.fixed_windows(event_frame(spark, sf), 900)
    return found.select(
        "ingest_source", F.unix_micros(F.col("start_time").cast("timestamp")).alias("start_us"), "event_count"
    )


@query("identity_sequences", f"""
WITH {EV}, w AS (SELECT *, us // {24 * HOUR_US} * {24 * HOUR_US} AS start_us FROM ev)
SELECT identity, start_us, count(*) OVER (PARTITION BY identity, start_us) AS length,
  row_number() OVER (PARTITION BY identity, start_us ORDER BY us, event_id) - 1 AS position, action FROM w""")
def identity_sequences(spark, sf):
    found = win.identity_sequences(event_frame(spark, sf), 24 * 3600)
    return found.select("identity", F.unix_micros("window_start").alias("start_us"), "length", "position", "action")


@query("identity_session_sequences", f"""
WITH {EV}, {sessions_cte('ev', 'identity', 6 * HOUR_US)}
SELECT identity, start_us, row_number() OVER (PARTITION BY identity, session_no ORDER BY us, event_id) - 1 AS position, action
FROM ses JOIN ses_ev USING (identity, session_no)""")
def identity_session_sequences(spark, sf):
    events = event_frame(spark, sf).select("ts", "event_id", "identity", "action")
    found = win.session_members(events, 6 * 3600, key_fields=("identity",), group=None)
    return found.select(
        "session_key.identity", F.unix_micros(F.col("start_time").cast("timestamp")).alias("start_us"), "position", "action"
    )


@query("token_session", f"""
WITH {EV}, m AS (SELECT DISTINCT identity, us, event_type IN ('signup') AS is_start FROM ev WHERE event_type IN ('signup', 'error')),
nx AS (SELECT *, lead(us) OVER (PARTITION BY identity ORDER BY us) AS nus, lead(is_start) OVER (PARTITION BY identity ORDER BY us) AS ns FROM m)
SELECT identity, us AS start_us, coalesce(least(nus, us + 43200000000), us + 43200000000) AS end_us,
  CASE WHEN nus <= us + 43200000000 AND NOT ns THEN 'logout' WHEN nus <= us + 43200000000 THEN 'new_login' ELSE 'expiry' END AS end_reason
FROM nx WHERE is_start""")
def token_session(spark, sf):
    kind = F.col("event_type")
    found = win.token_sessions(event_frame(spark, sf), ["identity"], kind == "signup", kind == "error", 12 * 3600)
    return found.select(
        "identity", F.unix_micros("start_ts").alias("start_us"), F.unix_micros("end_ts").alias("end_us"), "end_reason"
    )


def _order_events(spark, sf):
    return read_table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("event_id"), times.as_utc(F.col("o_orderdate")).alias("ts"),
        F.col("o_custkey").cast("string").alias("identity"), F.col("o_orderpriority").alias("ingest_source"),
    )


@query("session_window_orders", f"""
WITH ord AS (SELECT o_custkey AS identity, epoch_us(o_orderdate) AS us, CAST(o_orderkey AS VARCHAR) AS event_id FROM orders),
{sessions_cte('ord', 'identity', 90 * 24 * HOUR_US)}
SELECT CAST(identity AS VARCHAR) AS identity, start_us, end_us, CAST(event_count AS BIGINT) AS event_count FROM ses""")
def session_window_orders(spark, sf):
    found = win.sessions(_order_events(spark, sf), 90 * 86400, key_fields=("identity",), group=None)
    return found.select(
        "session_key.identity", F.unix_micros("start_ts").alias("start_us"),
        F.unix_micros("end_ts").alias("end_us"), "event_count",
    )


@query("tumbling_window_lineitem", """
SELECT l_returnflag AS ingest_source, epoch_us(l_shipdate) // 604800000000 * 604800000000 AS start_us, count(*) AS event_count
FROM lineitem GROUP BY 1, 2""")
def tumbling_window_lineitem(spark, sf):
    rows = read_table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("ingest_source"), times.as_utc(F.col("l_shipdate")).alias("ts")
    )
    return win.fixed_windows(rows, 7 * 86400).select(
        "ingest_source", F.unix_micros(F.col("start_time").cast("timestamp")).alias("start_us"), "event_count"
    )
