"""Clock-aligned windows and inactivity-gap sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchloom.functions import times
from watchloom.functions.text import session_key
from watchloom.operators.skew import HOT_ROWS, attach, hot_keys, neighbours, positions, running_totals
from watchloom.schemas import FIXED_WINDOW_SECONDS, SESSION_GAP_SECONDS
from watchloom.session import materialize

KEY_FIELDS = ("identity", "host")
GROUP = "ingest_source"


def check_seconds(name: str, seconds: int) -> int:
    """Window lengths must be positive."""
    if seconds <= 0:
        raise ValueError(f"{name} must be > 0")
    return seconds


# --- fixed windows -------------------------------------------------------------------------


def _fixed_columns(seconds: int) -> list[Column]:
    start = F.col("window_start")
    end = F.timestamp_micros(F.unix_micros(start) + F.lit(seconds * 1_000_000))
    return [
        times.fixed_window_id(start, seconds).alias("window_id"),
        F.lit("fixed_time").alias("window_type"),
        times.format_iso_z(start).alias("start_time"),
        times.format_iso_z(end).alias("end_time"),
    ]


def fixed_windows(events: DataFrame, seconds: int = FIXED_WINDOW_SECONDS, group: str = GROUP) -> DataFrame:
    """Non-empty windows ``[start, start + seconds)`` of each source with their event count.

    Counted with partial aggregation before the one shuffle; the events themselves come from
    :func:`fixed_window_events` or :func:`nest_fixed_windows`.
    """
    check_seconds("window_seconds", seconds)
    counted = (
        events.groupBy(group, F.window("ts", f"{seconds} seconds").alias("_w"))
        .agg(F.count(F.lit(1)).alias("event_count"))
        .withColumn("window_start", F.col("_w.start"))
    )
    return counted.select(group, *_fixed_columns(seconds), "event_count")


def fixed_window_events(events: DataFrame, seconds: int = FIXED_WINDOW_SECONDS) -> DataFrame:
    """Each event with its window's id: the flat form of a window's content, no shuffle."""
    check_seconds("window_seconds", seconds)
    placed = events.withColumn("window_start", times.window_floor(F.col("ts"), seconds))
    return placed.select(*_fixed_columns(seconds), *events.columns)


def fixed_window_members(events: DataFrame, seconds: int = FIXED_WINDOW_SECONDS, group: str = GROUP) -> DataFrame:
    """The content of every window, in time order: one row an event with ``window_id`` and ``position``.

    ``event_count`` is the window's. Windows themselves are :func:`fixed_windows`.
    """
    check_seconds("window_seconds", seconds)
    placed = events.withColumn("window_start", times.window_floor(F.col("ts"), seconds))
    numbered = positions(placed, [group, "window_start"], ["ts", "event_id"])
    kept = [c for c in events.columns if c != group]
    return numbered.select(group, times.fixed_window_id(F.col("window_start"), seconds).alias("window_id"), "event_count", "position", *kept)


# --- sessions ------------------------------------------------------------------------------


def with_session_key(events: DataFrame, key_fields=KEY_FIELDS) -> DataFrame:
    """Key text columns ``key_<field>``; a missing value has a fixed name."""
    return events.withColumns({f"key_{f}": session_key(F.col(f)) for f in key_fields})


def _keys(key_fields, group: str | None) -> list[str]:
    return ([group] if group else []) + [f"key_{f}" for f in key_fields]


def session_slots(
    events: DataFrame, gap_seconds: int = SESSION_GAP_SECONDS, key_fields=KEY_FIELDS, group: str | None = GROUP
) -> DataFrame:
    """Session number of every ``(key, slot)``, slots being ``gap_seconds`` wide.

    Two events in one slot are less than the gap apart and so always share a session. Events
    are therefore combined per slot before the shuffle (first, last, count), and only slots are
    compared in order: a key has at most one row per slot of elapsed time, however many
    events it has. A session goes on while the gap is not exceeded, equality included.
    """
    check_seconds("session_gap_seconds", gap_seconds)
    keys = _keys(key_fields, group)
    keyed = with_session_key(events, key_fields)
    slots = keyed.groupBy(*keys, times.slot(F.col("ts"), gap_seconds).alias("slot")).agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n")
    )
    in_time = Window.partitionBy(*keys).orderBy("slot")
    gap = F.unix_micros("first_ts") - F.unix_micros(F.lag("last_ts").over(in_time))
    starts = F.when(gap.isNull() | (gap > gap_seconds * 1_000_000), 1).otherwise(0)
    return slots.withColumn("_starts", starts).withColumn(
        "session_no", F.sum("_starts").over(in_time.rowsBetween(Window.unboundedPreceding, 0))
    ).drop("_starts")


def _sessions_from_slots(slots: DataFrame, keys: list[str]) -> DataFrame:
    # Slots already lie together by key, so this aggregation needs no further shuffle.
    return slots.groupBy(*keys, "session_no").agg(
        F.min("first_ts").alias("start_ts"), F.max("last_ts").alias("end_ts"), F.sum("n").alias("event_count")
    )


def hash_id(keys: list[str], start: str) -> Column:
    """Id that depends only on the session itself."""
    return F.sha2(F.concat_ws("/", *keys, times.format_iso_z(F.col(start))), 256)


def sessions(
    events: DataFrame, gap_seconds: int = SESSION_GAP_SECONDS, key_fields=KEY_FIELDS,
    group: str | None = GROUP, ids: str = "hash", order: str = "time",
) -> DataFrame:
    """Sessions with key, first and last event time and event count.

    ``ids='hash'`` names a session by its key and start. ``ids='ordinal'`` numbers the sessions
    of each group, keys in order of first appearance (see :func:`session_ordinals`).
    """
    keys = _keys(key_fields, group)
    found = _sessions_from_slots(session_slots(events, gap_seconds, key_fields, group), keys)
    if ids == "ordinal":
        found = session_ordinals(found, keys, group, order)
        window_id = F.concat(F.lit("session_"), F.lpad(F.col("ordinal").cast("string"), 6, "0"))
        window_id = F.when(
            F.col("ordinal") > 999999, F.concat(F.lit("session_"), F.col("ordinal").cast("string"))
        ).otherwise(window_id)
    else:
        window_id = hash_id(keys, "start_ts")
    return found.select(
        *([group] if group else []),
        window_id.alias("window_id"),
        F.lit("session").alias("window_type"),
        F.struct(*[F.col(f"key_{f}").alias(f) for f in key_fields]).alias("session_key"),
        times.format_iso_z(F.col("start_ts")).alias("start_time"),
        times.format_iso_z(F.col("end_ts")).alias("end_time"),
        "event_count", "start_ts", "end_ts", "session_no",
    )


def session_ordinals(found: DataFrame, keys: list[str], group: str | None = GROUP, order: str = "time") -> DataFrame:
    """Number sessions across keys without sorting them in one task.

    Keys are summed up first (first instant, number of sessions); a running total over keys
    gives each key its offset, and sessions are counted on inside their key.

    ``order='text'`` ranks keys by the timestamp's text, where an instant with a fraction sorts
    before the same second without one.
    """
    found = materialize(found, "sessions")  # counted by key, then joined
    first = F.min(F.unix_micros("start_ts"))
    per_key = found.groupBy(*keys).agg(first.alias("_first"), F.count(F.lit(1)).alias("_sessions"))
    if order == "text":
        # Inside a second the text without a fraction comes last.
        second = F.pmod(F.col("_first"), F.lit(1_000_000))
        per_key = per_key.withColumn(
            "_first", F.col("_first") * 2 + F.when(second == 0, 1_999_999).otherwise(0)
        )
    groups = [group] if group else []
    numbered = running_totals(per_key, groups, "_first", [k for k in keys if k not in groups], ["_sessions"])
    offsets = numbered.withColumn("_offset", F.col("cum__sessions") - F.col("_sessions"))
    return found.join(offsets.select(*keys, "_offset"), keys).withColumn(
        "ordinal", F.col("_offset") + F.col("session_no")
    )


def _placed_slots(events: DataFrame, gap_seconds: int, key_fields, group: str | None) -> DataFrame:
    """Slots with their session's number and start, written out once for all that follows."""
    keys = _keys(key_fields, group)
    bounds = Window.partitionBy(*keys, "session_no")
    slots = session_slots(events, gap_seconds, key_fields, group).select(
        *keys, F.col("slot").alias("_slot"), F.col("n").alias("_n"), "session_no",
        F.min("first_ts").over(bounds).alias("start_ts"), F.max("last_ts").over(bounds).alias("end_ts"),
    )
    return materialize(slots, "slots")


def session_events(
    events: DataFrame, gap_seconds: int = SESSION_GAP_SECONDS, key_fields=KEY_FIELDS,
    group: str | None = GROUP, hot_rows: int = HOT_ROWS, slots: DataFrame | None = None,
) -> DataFrame:
    """Each event with its session's number and start; hot slots are dealt over several tasks."""
    keys = _keys(key_fields, group)
    if slots is None:
        slots = _placed_slots(events, gap_seconds, key_fields, group)
    placed = with_session_key(events, key_fields).withColumn("_slot", times.slot(F.col("ts"), gap_seconds))
    return attach(
        placed, slots, [*keys, "_slot"], "_n", ["ts", "event_id"], hot_rows, written=True
    ).drop("_slot", "_n")


def session_members(
    events: DataFrame, gap_seconds: int = SESSION_GAP_SECONDS, key_fields=KEY_FIELDS,
    group: str | None = GROUP, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """The content of every session, in time order: one row an event with ``window_id`` and ``position``.

    ``event_count`` and ``start_time`` are the session's. Sessions themselves are :func:`sessions`.
    """
    keys = _keys(key_fields, group)
    members = session_events(events, gap_seconds, key_fields, group, hot_rows)
    numbered = positions(members, [*keys, "start_ts"], ["ts", "event_id"])
    kept = [c for c in events.columns if c != group]
    return numbered.select(
        *([group] if group else []),
        hash_id(keys, "start_ts").alias("window_id"),
        F.struct(*[F.col(f"key_{f}").alias(f) for f in key_fields]).alias("session_key"),
        times.format_iso_z(F.col("start_ts")).alias("start_time"),
        "event_count", "position", *kept,
    )


def group_by_key(events: DataFrame, key_fields=KEY_FIELDS) -> DataFrame:
    """Event count and time span of each session key."""
    keys = _keys(key_fields, None)
    return with_session_key(events, key_fields).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("event_count"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


def gap_to_previous(events: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Each event with ``gap_us``, the time since the previous event of its key.

    Events at one instant follow each other by id, so all but the first have gap zero; of several copies of the
    first event, one has the gap.
    """
    key_columns = [f"key_{k}" for k in keys]
    keyed = with_session_key(events, keys)
    counts = keyed.groupBy(*key_columns).agg(F.count(F.lit(1)).alias("_n"))
    hot = materialize(hot_keys(counts, key_columns, "_n", hot_rows).select(*key_columns), "hot-keys")
    in_time = Window.partitionBy(*key_columns).orderBy("ts", "event_id")
    gap = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(in_time))
    if not hot.limit(1).count():  # every key fits into one task
        return keyed.withColumn("gap_us", gap).select(*events.columns, "gap_us")
    hot = F.broadcast(hot)  # at most (all rows / hot_rows) keys
    usual = keyed.join(hot, key_columns, "left_anti").withColumn("gap_us", gap).select(*events.columns, "gap_us")
    return usual.unionByName(_gap_by_slots(keyed.join(hot, key_columns, "left_semi"), key_columns, hot_rows).select(*events.columns, "gap_us"))


def _gap_by_slots(keyed: DataFrame, key_columns: list[str], hot_rows: int) -> DataFrame:
    """The same for keys with too many events for one task: instants are compared inside short time slots."""
    instants = neighbours(
        keyed, key_columns, "ts", {"_n": F.count(F.lit(1)), "_first_id": F.min("event_id")}
    ).select(*key_columns, "ts", "_n", "_first_id", F.col("prev").alias("_prev"))
    joined = attach(keyed, instants, [*key_columns, "ts"], "_n", ["event_id"], hot_rows)
    since, named = F.unix_micros("ts") - F.unix_micros("_prev"), F.col("event_id") == F.col("_first_id")
    copy = F.row_number().over(Window.partitionBy(*key_columns, "ts", "event_id").orderBy(F.lit(0)))  # copies of one id, not of an instant
    first = joined.filter(named).withColumn("gap_us", F.when(copy == 1, since).otherwise(F.lit(0).cast("long")))
    return first.unionByName(joined.filter(~named).withColumn("gap_us", F.lit(0).cast("long")))


def sort_sessions(found: DataFrame, order: str = "time") -> DataFrame:
    """Sessions by start; by the start's text with ``order='text'``."""
    return found.orderBy("start_time" if order == "text" else "start_ts", "window_id")


def token_sessions(
    events: DataFrame, keys: list[str], starts: Column, ends: Column, expiry_seconds: int
) -> DataFrame:
    """Sessions from a login or token issue to logout, the next login, or expiry.

    Only marker events take part. Markers of one instant count as one, a login first.
    """
    markers = events.filter(starts | ends).withColumns({k: session_key(F.col(k)) for k in keys})
    near = neighbours(
        markers, keys, "ts",
        {"is_start": F.max(starts.cast("int")), "is_end": F.max(ends.cast("int"))},
        slot_seconds=3600,
    )
    expiry = F.timestamp_micros(F.unix_micros("ts") + F.lit(expiry_seconds * 1_000_000))
    in_time = F.col("next") <= expiry
    return near.filter(F.col("is_start") == 1).select(
        *keys,
        F.col("ts").alias("start_ts"),
        F.when(in_time, F.col("next")).otherwise(expiry).alias("end_ts"),
        F.when(in_time & (F.col("next_is_end") == 1), "logout")
        .when(in_time, "new_login").otherwise("expiry").alias("end_reason"),
    )


def identity_sequences(events: DataFrame, seconds: int, identity: str = "identity") -> DataFrame:
    """Per-identity sequences in clock-aligned windows: one row an action with its place and the length."""
    placed = events.select(
        session_key(F.col(identity)).alias(identity), times.window_floor(F.col("ts"), seconds).alias("window_start"),
        "ts", "event_id", "action",
    )
    return positions(placed, [identity, "window_start"], ["ts", "event_id"], "length")
