"""SQL shared by the checks: what the adapter's lines mean, by arithmetic on ``events``."""

# Telemetry lines, never re-parsed: stage and error of each, and the values of good events.
TELE = """
src AS (SELECT event_id AS n, epoch_us(ts) AS us, user_id, event_type AS et, value,
          ['sysmon','auditd','ollama','iam','vault','api_gateway'][event_id % 6 + 1] AS ingest_source
        FROM events),
tele AS (
  SELECT n, ingest_source, et, value, user_id, us,
    CASE WHEN n % 83 = 0 THEN 'read' WHEN n % 79 = 0 THEN 'parse'
         WHEN n % 97 = 0 OR n % 89 = 0 OR (n % 6 = 2 AND n % 7 = 0) THEN 'validate'
         WHEN (n % 6 = 2 AND n % 71 = 0) OR n % 73 = 0 THEN 'normalize' END AS stage,
    CASE WHEN n % 83 = 0 THEN 'Invalid JSON' WHEN n % 79 = 0 THEN 'JSON payload must be an object'
         WHEN n % 97 = 0 THEN 'Missing required field: timestamp'
         WHEN n % 89 = 0 THEN 'Unsupported source_type: syslog'
         WHEN n % 6 = 2 AND n % 7 = 0 THEN 'Ollama event is missing mandatory identity'
         WHEN n % 6 = 2 AND n % 71 = 0 THEN 'Invalid latency_ms: fast'
         WHEN n % 73 = 0 THEN 'Invalid timestamp: yesterday' END AS error,
    CASE WHEN n % 5 = 4 THEN us // 1000 * 1000 ELSE us END AS ts_us,
    CASE n % 3 WHEN 0 THEN 'evt-' || n WHEN 1 THEN 'env-' || n ELSE 'id-' || n END AS event_id,
    CASE WHEN n % 6 = 2 THEN 'user-' || user_id
         WHEN n % 23 = 0 OR n % 29 = 0 OR n % 12 = 0 THEN NULL
         ELSE 'user-' || user_id END AS identity,
    'host-' || (user_id % 8) AS host,
    CASE WHEN n % 4 IN (0, 2) THEN 'GET /' || et ELSE et END AS action,
    n % 6 IN (0, 1) AS is_host, n % 6 IN (3, 4, 5) AS is_access, n % 6 = 2 AS is_ollama
  FROM src),
good AS (SELECT * FROM tele WHERE stage IS NULL)
"""


def iso(us: str) -> str:
    """ISO text with ``Z`` of epoch microseconds, fraction only when not zero."""
    return (
        f"CASE WHEN ({us}) % 1000000 = 0 THEN strftime(make_timestamp({us}), '%Y-%m-%dT%H:%M:%SZ') "
        f"ELSE strftime(make_timestamp({us}), '%Y-%m-%dT%H:%M:%S.%fZ') END"
    )


# The events table with model names, for operators past parsing.
EV = """
ev AS (SELECT event_id AS n, 'evt-' || event_id AS event_id, epoch_us(ts) AS us,
         ['sysmon','auditd','ollama','iam','vault','api_gateway'][event_id % 6 + 1] AS ingest_source,
         'user-' || user_id AS identity, 'host-' || (user_id % 8) AS host,
         event_type, event_type AS action, value, CAST(json_extract(props, '$.k') AS INTEGER) AS k, user_id
       FROM events)
"""


def sessions_cte(rows: str, keys: str, gap_us: int, name: str = "ses") -> str:
    """Sessions by lag and running sum: ``<name>_ev`` per event, ``<name>`` per session."""
    return f"""
{name}_lag AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY {keys} ORDER BY us, event_id) <= {gap_us}
                 THEN 0 ELSE 1 END AS starts FROM {rows}),
{name}_ev AS (SELECT *, sum(starts) OVER (PARTITION BY {keys} ORDER BY us, event_id
                 ROWS UNBOUNDED PRECEDING) AS session_no FROM {name}_lag),
{name} AS (SELECT {keys}, session_no, min(us) AS start_us, max(us) AS end_us, count(*) AS event_count
           FROM {name}_ev GROUP BY ALL)
"""
