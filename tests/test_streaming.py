"""Incremental streams: whole results without a closing row, late rows in a side table, repeated batches."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from watchloom.operators.windows import fixed_windows, sessions
from watchloom.streaming.incremental import Run, correlation_job, session_job, window_job

START = datetime(2024, 3, 1, tzinfo=timezone.utc)
SCHEMA = "n int, ingest_source string, identity string, host string, ts timestamp, k int"


def batches(spark, seed, delay):
    """Four batches of events in loose time order, each with a few rows far behind; and which of them are late."""
    rng, out, late, newest, n = random.Random(seed), [], [], None, 0
    for b in range(4):
        rows = []
        for _ in range(60):
            seconds = b * 900 + rng.randrange(-200, 900) - (rng.random() < 0.1) * 2500
            rows.append((n, rng.choice("xy"), rng.choice(("ann", "bob", None)), "h", START + timedelta(seconds=max(0, seconds)), rng.randrange(3)))
            n += 1
        out.append(spark.createDataFrame(rows, SCHEMA))
        late.append(None if newest is None else newest - timedelta(seconds=delay))
        newest = max([r[4] for r in rows] + ([newest] if newest else []))
    return out, late


def split(parts, watermarks, is_late):
    """All rows in time, by the watermark of the batch before."""
    kept = [p if w is None else p.filter(~is_late(F.lit(w))) for p, w in zip(parts, watermarks, strict=True)]
    out = kept[0]
    for p in kept[1:]:
        out = out.unionByName(p)
    return out


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_windows_equal_the_batch_answer(spark, tmp_path, seed):
    parts, watermarks = batches(spark, seed, 300)
    run = Run(window_job(300), str(tmp_path / "run"), 300)
    for k, p in enumerate(parts):
        run.fold(p, k)
    in_time = split(parts, watermarks, lambda wm: F.timestamp_micros(F.unix_micros("ts") - F.unix_micros("ts") % 300_000_000 + 300_000_000) <= wm)
    assert rows_of(run.finish(spark), "ingest_source", "window_id", "event_count") == rows_of(fixed_windows(in_time, 300), "ingest_source", "window_id", "event_count")
    assert run.late(spark).count() + in_time.count() == 240 and run.late(spark).count() > 3


@pytest.mark.parametrize("seed", [3, 4])
def test_sessions_equal_the_batch_answer(spark, tmp_path, seed):
    parts, watermarks = batches(spark, seed, 400)
    run = Run(session_job(60), str(tmp_path / "run"), 400)
    for k, p in enumerate(parts):
        run.fold(p, k)
        if k == 2:
            closed = rows_of(run.closed(spark, run.finish(spark).schema), "window_id", "event_count")
            run.fold(p, k)  # a batch that is repeated changes nothing
            assert rows_of(run.closed(spark, run.finish(spark).schema), "window_id", "event_count") == closed
    in_time = split(parts, watermarks, lambda wm: F.col("ts") < wm)
    want = sessions(in_time, 60).select("ingest_source", "window_id", "start_ts", "end_ts", "event_count")
    assert rows_of(run.finish(spark), "ingest_source", "window_id", "start_ts", "end_ts", "event_count") == rows_of(want, *want.columns)
    assert run.late(spark).count() + in_time.count() == 240


def test_correlation_equals_pairs_of_slots(spark, tmp_path):
    parts, watermarks = batches(spark, 5, 600)
    run = Run(correlation_job("identity", F.col("k") == 1, F.col("k") == 2, 120), str(tmp_path / "run"), 600)
    for k, p in enumerate(parts):
        run.fold(p, k)
    end = lambda: F.timestamp_micros(F.unix_micros("ts") - F.unix_micros("ts") % 120_000_000 + 120_000_000)
    slots, width = {}, 120_000_000
    for r in split(parts, watermarks, lambda wm: end() <= wm).filter("identity IS NOT NULL AND k > 0").select("identity", F.unix_micros("ts").alias("us"), "k").collect():
        slots.setdefault((r["identity"], r["k"], r["us"] // width), []).append(r["us"])
    want = set()
    for (who, k, s), a in slots.items():
        for d in (-1, 0, 1):
            b = slots.get((who, 2, s + d))
            if k == 1 and b and (d == 0 or (d == 1 and min(b) - max(a) <= width) or (d == -1 and min(a) - max(b) <= width)):
                want.add((who, min(a), min(b)))
    got = rows_of(run.finish(spark), "identity", "a_first_us", "b_first_us")
    assert got == sorted(want, key=str) and len(got) > 10


def test_a_stream_goes_on_after_it_was_finished(spark, tmp_path):
    run, land = Run(session_job(300), str(tmp_path / "run"), 60), str(tmp_path / "land")
    event = lambda n, second: (n, "iam", "ann", None, START + timedelta(seconds=second), 0)
    for rows, want in (([event(1, 0), event(2, 100)], [2]), ([event(3, 350)], [3]), ([event(4, 2000), (5, "iam", "ann", None, None, 0)], [1, 3])):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(land)
        run.over(spark.readStream.schema(SCHEMA).parquet(land))
        assert sorted(r["event_count"] for r in run.finish(spark).collect()) == want
    assert [r["n"] for r in run.late(spark).collect()] == [5] and run.last(spark) == 2
    with pytest.raises(ValueError):
        window_job(0)
