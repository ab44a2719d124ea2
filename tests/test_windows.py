"""Windows, sessions and the skew helpers, against plain Python."""

import random
from collections import defaultdict
from datetime import datetime, timedelta, timezone

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from watchloom.operators import decide, evaluate, skew
from watchloom.operators import windows as win

BASE = datetime(2024, 1, 1, 10, tzinfo=timezone.utc)


def frame(spark, rows):
    """rows: (identity, host, seconds after BASE)"""
    data = [(f"e{i:05d}", i_, h, BASE + timedelta(microseconds=round(s * 1e6)), "iam") for i, (i_, h, s) in enumerate(rows)]
    return spark.createDataFrame(data, "event_id string, identity string, host string, ts timestamp, ingest_source string")


def brute_sessions(rows, gap):
    keys = defaultdict(list)
    for i, h, s in rows:
        keys[(i or "<unknown>", h or "<unknown>")].append(round(s * 1e6))
    found = []
    for key, stamps in keys.items():
        stamps.sort()
        run = [stamps[0]]
        for x in stamps[1:]:
            if x - run[-1] > gap * 1_000_000:
                found.append((key, run[0], run[-1], len(run)))
                run = []
            run.append(x)
        found.append((key, run[0], run[-1], len(run)))
    return sorted(found)


def spark_sessions(df, gap):
    base = int(BASE.timestamp() * 1e6)
    return sorted(
        ((r.session_key.identity, r.session_key.host), r.s - base, r.e - base, r.event_count)
        for r in win.sessions(df, gap).withColumns({"s": F.unix_micros("start_ts"), "e": F.unix_micros("end_ts")}).collect()
    )


@pytest.mark.parametrize(
    "seconds, fixed, found",
    [([0, 59.999999], 1, 1), ([0, 60], 2, 1), ([0, 300], 2, 1), ([0, 300.000001], 2, 2)],
)
def test_boundaries(spark, seconds, fixed, found):
    df = frame(spark, [("a", "h", s) for s in seconds])
    assert win.fixed_windows(df).count() == fixed
    assert win.sessions(df).count() == found


def test_window_before_1970(spark):
    df = spark.createDataFrame([("e", datetime(1969, 12, 31, 23, 59, 30, 500000, tzinfo=timezone.utc), "iam")], "event_id string, ts timestamp, ingest_source string")
    assert [r.start_time for r in win.fixed_windows(df).collect()] == ["1969-12-31T23:59:00Z"]
    assert win.fixed_window_events(df, 60).first().start_time == "1969-12-31T23:59:00Z"


def test_fixed_window_record(spark):
    got = win.fixed_windows(frame(spark, [("a", "h", 5)])).first()
    assert (got.window_id, got.window_type, got.start_time, got.end_time, got.event_count) == (
        "fixed_20240101T100000Z_60s", "fixed_time", "2024-01-01T10:00:00Z", "2024-01-01T10:01:00Z", 1)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "", None]), st.sampled_from(["h", None]), st.integers(0, 4000)), min_size=1, max_size=60))
def test_sessions_match_plain_python(spark, rows):
    assert spark_sessions(frame(spark, rows), 300) == brute_sessions(rows, 300)


def skewed(n=900, seed=1):
    rng = random.Random(seed)
    rows = [("hot", "h", rng.choice([0, 0, 0, 10.5, rng.random() * 5000])) for _ in range(n)]
    rows += [(f"u{rng.randrange(5)}", "h", rng.random() * 5000) for _ in range(n // 3)]
    rows += [(None, None, rng.random() * 5000) for _ in range(n // 3)]
    return rows


@pytest.mark.parametrize("hot_rows", [7, 1_000_000])
def test_session_events_keep_every_event_when_keys_are_split(spark, hot_rows):
    rows = skewed()
    members = win.session_events(frame(spark, rows), 300, hot_rows=hot_rows)
    got = members.groupBy("key_identity", "key_host", "session_no").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("d"))
    counts = sorted((r.key_identity, r.n) for r in got.collect())
    assert counts == sorted((k[0], n) for k, _, _, n in brute_sessions(rows, 300))
    assert all(r.n == r.d for r in got.collect())


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_members_are_whole_and_ordered_for_any_layout(spark, partitions):
    df = frame(spark, skewed()).repartition(partitions)
    members = win.fixed_window_members(df, 600).select("window_id", "event_count", "position", "event_id").collect()
    by_window = defaultdict(list)
    for r in members:
        by_window[r.window_id].append((r.position, r.event_id, r.event_count))
    want = defaultdict(list)
    for r in df.select("event_id", F.unix_micros("ts").alias("us")).collect():
        start = datetime.fromtimestamp(r.us // 600_000_000 * 600, tz=timezone.utc)
        want[f"fixed_{start:%Y%m%dT%H%M%SZ}_600s"].append((r.us, r.event_id))
    got = {k: sorted(v) for k, v in by_window.items()}
    assert got == {k: [(i, e, len(v)) for i, (_, e) in enumerate(sorted(v))] for k, v in want.items()}


@pytest.mark.parametrize("hot_rows", [10, 10**9])
def test_a_window_of_60000_events_is_one_window(spark, hot_rows):
    df = frame(spark, [("a", "h", 0.001 * k) for k in range(60_000)])
    for members in (win.fixed_window_members(df, 600), win.session_members(df, 300, hot_rows=hot_rows)):
        r = members.agg(
            F.count_distinct("window_id").alias("w"), F.min("event_count").alias("low"), F.max("event_count").alias("high"),
            F.count_distinct("position").alias("p"), F.max("position").alias("last"),
        ).first()
        assert tuple(r) == (1, 60_000, 60_000, 60_000, 59_999)


@pytest.mark.parametrize("hot_rows", [5, 1_000_000])
def test_gap_to_previous(spark, hot_rows):
    rows = skewed(300)
    df = frame(spark, rows)
    got = {r.event_id: r.gap_us for r in win.gap_to_previous(df, ["identity", "host"], hot_rows).collect()}
    keys = defaultdict(list)
    for i, (a, h, s) in enumerate(rows):
        keys[(a, h)].append((round(s * 1e6), f"e{i:05d}"))
    want = {}
    for group in keys.values():
        group.sort()
        for k, (us, event) in enumerate(group):
            want[event] = None if k == 0 else us - group[k - 1][0]
    assert got == want


def test_gap_to_previous_with_copies(spark):
    df = frame(spark, [("a", "h", 1), ("a", "h", 5), ("a", "h", 5), ("a", "h", 9)])
    df = df.withColumn("event_id", F.when(F.col("ts") == df.agg(F.min("ts")).first()[0], F.lit("e1")).otherwise(F.lit("e2")))
    got = [sorted((r.gap_us for r in win.gap_to_previous(df, ["identity", "host"], hot).collect()), key=str) for hot in (1, 10**6)]
    assert got[0] == got[1] == [0, 4_000_000, 4_000_000, None]


def test_ordinals_of_keys_with_one_first_instant(spark):
    """Ties are cut by key too, so they are numbered over many tasks."""
    n = 20_000
    found = win.session_ordinals(
        spark.range(n).select(F.lit("s").alias("ingest_source"), F.format_string("k%06d", "id").alias("key_a"), F.timestamp_seconds(F.lit(5)).alias("start_ts"), F.lit(1).cast("long").alias("session_no")),
        ["ingest_source", "key_a"],
    )
    r = found.agg(F.count_if(F.col("ordinal") == F.substring("key_a", 2, 6).cast("long") + 1).alias("n"), F.count_distinct("ordinal").alias("d")).first()
    assert tuple(r) == (n, n)


def test_ordinals_follow_first_appearance(spark):
    rows = [("b", "h", 5), ("a", "h", 10), ("b", "h", 1000), ("c", "h", 5), ("a", "h", 2000)]
    found = win.sessions(frame(spark, rows), 300, ids="ordinal").collect()
    got = {(r.session_key.identity, r.session_no): r.window_id for r in found}
    assert got == {("b", 1): "session_000001", ("b", 2): "session_000002", ("c", 1): "session_000003",
                   ("a", 1): "session_000004", ("a", 2): "session_000005"}


def test_text_order_puts_fraction_first(spark):
    rows = [("a", "h", 0), ("b", "h", 0.5)]
    found = win.sessions(frame(spark, rows), 300, ids="ordinal", order="text").collect()
    assert {r.session_key.identity: r.window_id for r in found} == {"b": "session_000001", "a": "session_000002"}


def test_key_fields_are_free(spark):
    df = frame(spark, [("a", "h1", 0), ("a", "h2", 10), ("b", "h1", 20)])
    assert win.sessions(df, 300, key_fields=("identity",)).count() == 2
    assert win.sessions(df, 300, key_fields=("host",), group=None).count() == 2


@pytest.mark.parametrize("bad", [0, -5])
def test_durations_must_be_positive(spark, bad):
    df = frame(spark, [("a", "h", 0)])
    with pytest.raises(ValueError):
        win.fixed_windows(df, bad)
    with pytest.raises(ValueError):
        win.sessions(df, bad)


def test_token_sessions(spark):
    rows = [("a", "login", 0), ("a", "other", 5), ("a", "logout", 60), ("a", "login", 100), ("a", "login", 200),
            ("a", "logout", 99999), (None, "login", 10)]
    df = frame(spark, [(i, k, s) for i, k, s in rows]).withColumnRenamed("host", "kind")
    got = win.token_sessions(df, ["identity"], F.col("kind") == "login", F.col("kind") == "logout", 3600).collect()
    base = BASE
    assert sorted((r.identity, (r.start_ts.astimezone(timezone.utc) - base).total_seconds(), (r.end_ts.astimezone(timezone.utc) - base).total_seconds(), r.end_reason) for r in got) == [
        ("<unknown>", 10, 3610, "expiry"), ("a", 0, 60, "logout"), ("a", 100, 200, "new_login"), ("a", 200, 3800, "expiry")]


@pytest.mark.parametrize("pieces", [2, 16])
def test_running_totals_cross_pieces(spark, pieces):
    rng = random.Random(3)
    values = sorted({(g, rng.randrange(10_000)) for g in "ab" for _ in range(300)})
    data = [(g, o, rng.randrange(5)) for g, o in values]
    df = spark.createDataFrame(data, "g string, o long, v long")
    got = {(r.g, r.o): r.cum_v for r in skew.running_totals(df, ["g"], "o", [], ["v"], pieces).collect()}
    total, want = defaultdict(int), {}
    for g, o, v in data:
        total[g] += v
        want[(g, o)] = total[g]
    assert got == want


@pytest.mark.parametrize("hot_rows", [3, 1_000_000])
def test_correlation_matches_all_pairs(spark, hot_rows):
    rng = random.Random(5)
    rows = [(rng.choice(["x", "x", "y", None]), rng.choice(["a", "b", "ab", "-"]), rng.randrange(0, 20_000) / 2) for _ in range(300)]
    df = frame(spark, rows).withColumnRenamed("host", "kind")
    got = decide.temporal_correlation(df, "identity", F.col("kind").contains("a"), F.col("kind").contains("b"), 100, hot_rows=hot_rows)
    got = {r.event_id: (r.partner_before, r.partner_after) for r in got.collect()}
    assert len(got) == len(rows)
    for i, (who, kind, s) in enumerate(rows):
        near = [
            t - s for w, k, t in rows
            if who is not None and w == who and abs(t - s) <= 100 and (("a" in kind and "b" in k) or ("b" in kind and "a" in k))
        ]
        assert got[f"e{i:05d}"] == (any(d <= 0 for d in near), any(d >= 0 for d in near))


def test_percentiles_are_exact(spark):
    import numpy as np

    rng = random.Random(9)
    data = [(bool(i % 3), round(rng.random() * 50, 1)) for i in range(400)]
    df = spark.createDataFrame(data, "g boolean, x double")
    for r in evaluate.latency_distribution(df, "x", ["g"], [0.5, 0.9, 0.99]).collect():
        xs = [x for g, x in data if g == r.g]
        assert (r.p50, r.p90, r.p99) == pytest.approx(tuple(np.quantile(xs, [0.5, 0.9, 0.99])))


def test_members_are_sorted_from_written_events(spark, sf_dir, monkeypatch):
    from watchloom.plans import q_windows

    seen, inner = [], win.fixed_window_members
    monkeypatch.setattr(q_windows.win, "fixed_window_members", lambda events, seconds: seen.append(events) or inner(events, seconds))
    q_windows.fixed_window_agg(spark, sf_dir)
    # A sort by ranges reads its input twice; the lines must not be parsed again.
    assert "from_json" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()
