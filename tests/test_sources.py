"""Log reads, retention, export, sinks, the preprocessing job and streaming."""

import glob
import gzip
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from watchloom.plans.preprocessing import run_preprocessing
from watchloom.session import discard, freed_shuffles, materialize, scratch_path, shared_dir, temporary_tables
from watchloom.sources import jsonl, log, sinks
from watchloom.streaming import jobs


def entries(spark, n=500, seed=0):
    rng = random.Random(seed)
    ids = set()
    while len(ids) < n:
        ids.add((rng.choice(["telemetry:iam"] * 6 + ["telemetry:vault"]), rng.randrange(0, 4 * 3_600_000, 1000 if rng.random() < 0.5 else 1_800_000), rng.randrange(50)))
    rows = [(s, f"{ms}-{seq}", f"env-{k}") for k, (s, ms, seq) in enumerate(sorted(ids))]
    return log.with_position(spark.createDataFrame(rows, "stream string, entry_id string, envelope_id string")), ids


@pytest.mark.parametrize("keep", [1, 7, 100, 10_000])
def test_retention_is_exact(spark, keep):
    df, ids = entries(spark)
    got = {(r.stream, r.ms, r.seq) for r in log.retain_newest(df, keep).collect()}
    want = set()
    for s in {i[0] for i in ids}:
        want |= set(sorted((i for i in ids if i[0] == s), key=lambda i: i[1:])[-keep:])
    assert got == want


def test_cursor_reads_walk_the_stream(spark):
    df, ids = entries(spark)
    want = [f"{ms}-{seq}" for s, ms, seq in sorted(ids, key=lambda i: i[1:]) if s == "telemetry:vault"]
    got, last = [], "0-0"
    while True:
        batch = [r.entry_id for r in log.read_batch(df, "telemetry:vault", 30, last).orderBy("ms", "seq").collect()]
        if not batch:
            break
        got += batch
        last = batch[-1]
    assert got == [w for w in want if w != "0-0"]
    assert {r["count"] for r in log.read_all_once(df, 5).groupBy("stream").count().collect()} == {5}


def test_export_lets_fields_win(spark):
    rows = spark.createDataFrame([("telemetry:iam", "5-1", "own"), ("telemetry:iam", "6-0", None)], "stream string, entry_id string, event_id string")
    got = [json.loads(r.line)["event_id"] for r in log.export_range(log.with_position(rows), "telemetry:iam").orderBy("entry_id").collect()]
    assert got == ["own", "6-0"]
    only = log.export_range(log.with_position(rows), "telemetry:iam", "5-2", "6-0").collect()
    assert [r.entry_id for r in only] == ["6-0"]


def test_publish_and_read_back(spark, tmp_path):
    payloads = spark.createDataFrame([("a", None), ("b", "h2")], "identity string, host string")
    log.publish(payloads, "iam", F.struct("identity"), str(tmp_path / "land"), F.col("host"))
    got = spark.read.json(str(tmp_path / "land"))
    assert sorted((r.host, r.raw_payload, r.source_type) for r in got.collect()) == [
        ("h2", '{"identity":"b"}', "iam"), ("localhost", '{"identity":"a"}', "iam")]
    assert got.select("envelope_id").distinct().count() == 2
    with pytest.raises(ValueError):
        log.publish(payloads, "syslog", F.col("identity"), str(tmp_path / "x"))


def test_json_sink_keeps_nulls_and_unicode(spark, tmp_path):
    sinks.write_jsonl(spark.createDataFrame([("é", None)], "a string, b string"), str(tmp_path / "deep" / "out"))
    text = [r.value for r in spark.read.text(str(tmp_path / "deep" / "out")).collect()]
    assert text == ['{"a":"é","b":null}']


# One run of every source: (source, host, payload keys that matter)
SIMULATED = (
    [("sysmon", "windows-host", {"EventID": i, "image": f"p{i}", "user": "svc"}) for i in range(6)]
    + [("auditd", "linux-host", {"identity": f"s{i % 3}", "command": f"c{i}"}) for i in range(6)]
    + [("ollama", "llm-host", {"identity": f"s{max(i - 1, 0)}", "latency_ms": 820}) for i in range(4)]
    + [("iam", "iam-host", {"identity": f"s{i}", "event_name": "AssumeRole", "success": True}) for i in range(4)]
    + [("vault", "vault-host", {"identity": f"s{i}", "secret_path": "api/key"}) for i in range(4)]
    + [("api_gateway", "gw-host", {"identity": f"s{i}", "action": "GET /users"}) for i in range(4)]
)


def test_preprocessing_job_writes_four_outputs(spark, tmp_path):
    root = tmp_path / "raw"
    for k, (source, host, payload) in enumerate(SIMULATED):
        (root / source).mkdir(parents=True, exist_ok=True)
        raw = json.dumps({**payload, "timestamp": f"2024-01-01T00:00:00.{k:06d}+00:00"})
        line = {"envelope_id": f"e{k}", "source_type": source, "host": host, "ingested_at": "x", "raw_payload": raw}
        with open(root / source / "part.jsonl", "a") as f:
            f.write(json.dumps(line) + "\n")
    with open(root / "iam" / "part.jsonl", "a") as f:
        f.write("\n[1]\n")
    out = str(tmp_path / "out")
    summary = {r.source_type: r for r in run_preprocessing(jsonl.read_all_sources(spark, str(root)), out).collect()}
    assert {s: r.session_window_count for s, r in summary.items()} == {
        "sysmon": 1, "auditd": 3, "ollama": 3, "iam": 4, "vault": 4, "api_gateway": 4}
    assert {s: r.valid_event_count for s, r in summary.items()} == {
        "sysmon": 6, "auditd": 6, "ollama": 4, "iam": 4, "vault": 4, "api_gateway": 4}
    assert {s: r.error_count for s, r in summary.items() if r.error_count} == {"iam": 1}
    events = [json.loads(r.value) for r in spark.read.text(f"{out}/preprocessed").collect()]
    by_source = {e["source_type"]: e for e in events}
    assert by_source["sysmon"]["identity"] is None and by_source["sysmon"]["process_path"] is None
    assert by_source["vault"]["resource"] == "api/key" and by_source["api_gateway"]["event_type"] is None
    assert by_source["iam"]["event_type"] == by_source["iam"]["action"] == "AssumeRole"
    found = [json.loads(r.value) for r in spark.read.text(f"{out}/windows/session").collect()]
    sysmon = [w for w in found if w["session_key"]["host"] == "windows-host"]
    assert [(w["session_key"]["identity"], w["event_count"]) for w in sysmon] == [("<unknown>", 6)]
    members = [json.loads(r.value) for r in spark.read.text(f"{out}/windows/session_members").collect()]
    held = sorted((m["position"], m["event_id"]) for m in members if m["window_id"] == sysmon[0]["window_id"])
    assert held == list(enumerate(sorted(e["event_id"] for e in events if e["source_type"] == "sysmon")))
    assert len(members) == len(events) == 28


def test_preprocessing_job_packs_its_outputs_and_leaves_no_scratch_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "FILE_ROWS", 40)
    lines = [("iam", json.dumps({"event_id": f"e{k}", "timestamp": k + 1, "source_type": "iam", "identity": f"s{k % 5}", "host": "h", "action": "a" * 300})) for k in range(300)]
    raw = spark.createDataFrame(lines + [("iam", "[1]")], "ingest_source string, line string").repartition(1)
    there, out = set(os.listdir(shared_dir(spark).removeprefix("file:"))), tmp_path / "out"
    assert sum(r.valid_event_count for r in run_preprocessing(raw, str(out)).collect()) == 300
    left = {x for x in set(os.listdir(shared_dir(spark).removeprefix("file:"))) - there if x.startswith(("placed", "slots", "groups"))}
    assert not left
    written = {str(f.relative_to(out)): f for f in out.rglob("part-*") if "_staged" not in str(f)}
    assert {name.partition("/ingest_source")[0].partition("/identity")[0] for name in written} == {
        "preprocessed", "windows/fixed", "windows/session", "windows/fixed_members", "windows/session_members", "sequences", "errors"}
    counts = {}
    for name, f in written.items():
        with gzip.open(f, "rt", encoding="utf-8") as opened:
            rows = [json.loads(x) for x in opened]
        assert len(rows) <= 40
        counts[name.partition("/ingest_source")[0]] = counts.get(name.partition("/ingest_source")[0], 0) + len(rows)
    assert counts["preprocessed"] == counts["windows/fixed_members"] == counts["windows/session_members"] == 300 and counts["errors"] == 1
    assert sum(f.stat().st_size for n, f in written.items() if n.startswith("preprocessed")) < 300 * 300


def test_folders_are_written_without_a_sort_up_to_the_open_files(spark, tmp_path, monkeypatch):
    setting = "spark.sql.maxConcurrentOutputFileWriters"
    before, rows = spark.conf.get(setting), spark.range(900).select("id", (F.col("id") % 150).alias("p"))
    for files in (200, 20):  # below the folders' number, a task sorts the rest
        monkeypatch.setattr(sinks, "OPEN_FILES", files)
        sinks.write_jsonl(rows, str(tmp_path / "out"), ["p"], packed=files == 20)
        assert len(list((tmp_path / "out").glob("p=*"))) == 150
        assert {(r.id, r.p) for r in spark.read.json(str(tmp_path / "out")).collect()} == {(k, k % 150) for k in range(900)}
    assert spark.conf.get(setting) == before
    with freed_shuffles(spark, 64):
        assert spark.conf.get(setting) == "64"


def test_temporary_tables_go_when_their_block_ends(spark):
    kept = materialize(spark.range(5), "kept")
    with temporary_tables(spark):
        gone = materialize(spark.range(6), "gone")
        with temporary_tables(spark):
            inner = materialize(spark.range(7).groupBy("id").count(), "inner")
            assert inner.count() == 7
        assert gone.count() == 6 and not glob.glob(f"{scratch_path(spark, 'inner').rpartition('/')[0].removeprefix('file:')}/inner-*")
    assert kept.count() == 5 and not glob.glob(f"{scratch_path(spark, 'gone').rpartition('/')[0].removeprefix('file:')}/gone-*")
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting)
    with freed_shuffles(spark):
        assert spark.conf.get(setting) == "true"
    assert spark.conf.get(setting) == before
    discard(kept)
    assert not glob.glob(f"{shared_dir(spark).removeprefix('file:')}/kept-*")


def test_source_without_input_has_a_zero_row(spark, tmp_path):
    empty = jsonl.read_all_sources(spark, str(tmp_path))
    rows = run_preprocessing(empty, str(tmp_path / "out")).collect()
    assert len(rows) == 6 and all(r.raw_event_count == r.session_window_count == 0 for r in rows)


def test_session_spans_two_streaming_runs(spark, tmp_path):
    land, out, progress = str(tmp_path / "land"), str(tmp_path / "out"), str(tmp_path / "progress")
    schema = "ingest_source string, identity string, host string, ts timestamp"

    def arrive(*rows):
        spark.createDataFrame(rows, "ingest_source string, identity string, host string, s string").select(
            "ingest_source", "identity", "host", F.col("s").cast("timestamp").alias("ts")
        ).coalesce(1).write.mode("append").parquet(land)
        stream = jobs.sessions(spark.readStream.schema(schema).parquet(land), 300, delay="1 minute")
        run = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", progress).trigger(availableNow=True).start()
        run.awaitTermination()

    arrive(("iam", "a", "h", "2024-01-01T10:00:00Z"))
    arrive(("iam", "a", "h", "2024-01-01T10:04:00Z"))
    arrive(("end", "z", "z", "2025-01-01T00:00:00Z"))
    got = spark.read.parquet(out).collect()
    assert [(r.key_identity, r.event_count) for r in got] == [("a", 2)]


def test_dead_letters_carry_line_numbers(spark, tmp_path):
    folder = tmp_path / "raw" / "iam"
    folder.mkdir(parents=True)
    good = '{"source_type":"iam","identity":"a","timestamp":1700000000}'
    (folder / "a.jsonl").write_text(f'{good}\n\n[1]\n{good}\n{{"source_type":"iam"}}\n')
    out = str(tmp_path / "out")
    run_preprocessing(jsonl.read_lines(spark, str(folder), number=True), out)
    letters = [json.loads(r.value) for r in spark.read.text(f"{out}/errors").collect()]
    assert sorted((x["line_number"], x["stage"], x["error"]) for x in letters) == [
        (3, "read", "JSONL line is not an object"), (5, "validate", "Missing required field: timestamp")]


def test_rows_of_one_row_group_are_dealt_over_the_cores(spark, tmp_path):
    from watchloom.sources.adapter import spread

    ids = F.when(F.col("id") % 3 > 0, F.col("id"))  # some ids are null
    spark.range(40_000).select(ids.alias("event_id"), F.sha2(F.col("id").cast("string"), 256).alias("props")).coalesce(1).write.parquet(f"{tmp_path}/e")
    settings = {"spark.sql.files.openCostInBytes": "1", "spark.sql.files.maxPartitionBytes": "50000"}
    before = {key: spark.conf.get(key) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        df = spark.read.parquet(f"{tmp_path}/e")
        assert df.rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
        sizes = [r["n"] for r in spread(df).groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
        assert sum(sizes) == 40_000 and max(sizes) < 40_000 / 4
        sizes = [r["n"] for r in spread(df, 1_000).groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
        assert sum(sizes) == 40_000 and max(sizes) < 2_000
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_csv_files_stay_small_whatever_a_task_holds(spark, tmp_path):
    rows = spark.range(250).select(F.col("id").cast("string").alias("a"), F.lit('two\nlines, "quoted"').alias("b")).coalesce(1)
    sinks.write_csv(rows, f"{tmp_path}/csv", file_rows=100)
    assert len(list((tmp_path / "csv").glob("*.csv"))) == 3
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{tmp_path}/csv")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
