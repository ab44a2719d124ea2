"""The landed log: same entries as a plain read, from few files."""

import random

import pytest
from pyspark.sql import functions as F

from watchloom.sources import log
from watchloom.sources.landed import LandedLog


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    rng = random.Random(2)
    ids = sorted({(rng.choice(["telemetry:iam"] * 9 + ["telemetry:vault", "other"]), rng.randrange(400), rng.randrange(3)) for _ in range(1500)})
    rows = [(s, f"{ms}-{seq}", f"env-{k}") for k, (s, ms, seq) in enumerate(ids)]
    df = log.with_position(spark.createDataFrame(rows, "stream string, entry_id string, envelope_id string"))
    out = LandedLog(spark, str(tmp_path_factory.mktemp("landed log")))
    return out.add(df.filter("ms < 150"), 0, 50).add(df.filter("ms >= 150"), 1, 50), df


def ids(df):
    return [r["entry_id"] for r in df.collect()]


def test_cursor_reads(landed):
    out, df = landed
    for stream, count, last in (("telemetry:iam", 30, "0-0"), ("telemetry:iam", 70, "149-2"), ("telemetry:iam", 40, "203-1"), ("telemetry:vault", 500, "5-0"), ("none", 5, "0-0"), ("telemetry:iam", 5, "999-0")):
        got = out.read_batch(stream, count, last)
        assert ids(got) == ids(log.read_batch(df, stream, count, last))
        assert len(got.inputFiles()) <= count // 40 + 3 or stream == "telemetry:vault"
    assert len(out.entries().inputFiles()) > 20
    assert sorted(ids(out.read_all_once(20))) == sorted(ids(log.read_all_once(df, 20)))
    assert len(out.read_all_once(20).inputFiles()) <= 3


def test_ranges(landed):
    out, df = landed
    for first, last in (("-", "+"), ("100-1", "120-0"), ("149-2", "150-0"), ("500-0", "+")):
        got = out.export_range("telemetry:iam", first, last)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, log.export_range(df, "telemetry:iam", first, last).collect()))
    assert len(out.export_range("telemetry:iam", "100-1", "120-0").inputFiles()) <= 4


def test_walk_equals_all_cursor_reads(landed):
    out, df = landed
    walked = {}
    for r in out.walk(100, "telemetry:iam").orderBy("read", "place").collect():
        walked.setdefault(r["read"], []).append(r["entry_id"])
    last, reads = "0-0", []
    while batch := ids(log.read_batch(df, "telemetry:iam", 100, last)):
        reads.append(batch)
        last = batch[-1]
    if "0-0" in walked[0]:  # a cursor read starts behind this id
        reads = [x for r in reads for x in r]
        reads = [(["0-0", *reads])[k : k + 100] for k in range(0, len(reads) + 1, 100)]
    assert [walked[k] for k in sorted(walked)] == reads
    assert out.walk().count() == df.count()


def test_growth(spark, landed):
    out, df = landed
    n = out.index().agg(F.sum("n")).first()[0]
    assert n == df.count()
    with pytest.raises(ValueError, match="telemetry:iam"):
        out.add(df.filter("stream = 'telemetry:iam' AND ms = 150"), 2)
    out.add(df.filter("ms >= 150"), 1, 70)  # the same batch again
    assert out.index().agg(F.sum("n")).first()[0] == n and out.entries().count() == n


def test_follow_reads_each_file_once(spark, landed, tmp_path):
    out, df = landed
    run = out.follow(3).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted(ids(spark.read.parquet(str(tmp_path / "out")))) == sorted(ids(df))
