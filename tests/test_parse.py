"""Envelope, validation and normalisation on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from watchloom.functions import text, times, variants
from watchloom.operators import windows as win
from watchloom.operators.normalize import events_of, normalize, normalize_all, normalize_lines
from watchloom.operators.parse import classify, dead_letters, merged_event
from watchloom.sources import jsonl


def lines(spark, rows, source="iam"):
    rows = [r if isinstance(r, str) else json.dumps(r) for r in rows]
    return spark.createDataFrame([(source, i, r) for i, r in enumerate(rows)], "ingest_source string, i int, line string")


def envelope(payload, **extra):
    raw = payload if isinstance(payload, str) else json.dumps(payload)
    return {"envelope_id": "e1", "source_type": "iam", "host": "h", "ingested_at": "2024-01-01T00:00:00+00:00", "raw_payload": raw, **extra}


OK = {"identity": "a", "timestamp": "2024-01-01T00:00:00Z"}

DIRTY = [
    ("[1]", "read", "JSONL line is not an object"),
    ('{"a": ', "read", "Invalid JSON"),
    ('{"a": 1} trailing', "read", "Invalid JSON"),
    ('{"a": 1}} x', "read", "Invalid JSON"),
    ("{'a': 1}", "read", "Invalid JSON"),
    (json.dumps({"source_type": "iam", **OK}) + ',"x":2', "read", "Invalid JSON"),
    (json.dumps({"source_type": "iam", **OK}) + ' , "x":{}', "read", "Invalid JSON"),
    (json.dumps({"source_type": "iam", **OK}) + "],[{}", "read", "Invalid JSON"),
    ('1,"~value":' + json.dumps({"source_type": "iam", **OK}), "read", "Invalid JSON"),
    ('[],"~value":' + json.dumps({"source_type": "iam", **OK}), "read", "Invalid JSON"),
    (json.dumps({"source_type": "iam", **OK})[:-1] + ',"x":NaN}', "read", "Invalid JSON"),
    (envelope(json.dumps(OK) + ',"zz":{}'), "parse", "Invalid JSON payload"),
    (envelope(json.dumps(OK)[:-1] + ',"x":NaN}'), "parse", "Invalid JSON payload"),
    (json.dumps({"source_type": "iam", **OK, "x": {"a": 1}, "y": '} , "'}), None, None),
    (envelope(""), "parse", "Empty raw payload"),
    (envelope("  "), "parse", "Empty raw payload"),
    (envelope("[1]"), "parse", "JSON payload must be an object"),
    (envelope('{"a"'), "parse", "Invalid JSON payload"),
    ({**envelope(OK), "raw_payload": None}, "parse", "Unsupported payload type: NoneType"),
    ({**envelope(OK), "raw_payload": [1]}, "parse", "Unsupported payload type: list"),
    ({**envelope(OK), "raw_payload": 5}, "parse", "Unsupported payload type: int"),
    ({**envelope(OK), "raw_payload": True}, "parse", "Unsupported payload type: bool"),
    ({**envelope(OK), "raw_payload": 1.5}, "parse", "Unsupported payload type: float"),
    (envelope({"identity": "a"}), "validate", "Missing required field: timestamp"),
    (envelope({**OK, "timestamp": ""}), "validate", "Missing required field: timestamp"),
    (envelope({**OK, "timestamp": 0}), "validate", "Missing required field: timestamp"),
    (envelope({**OK, "timestamp": False}), "validate", "Missing required field: timestamp"),
    (envelope({**OK, "timestamp": []}), "validate", "Missing required field: timestamp"),
    (envelope(OK, source_type=None), "validate", "Missing required field: source_type"),
    (envelope({**OK, "source_type": "iam"}, source_type=""), "validate", "Missing required field: source_type"),
    (envelope(OK, source_type=" SysLog "), "validate", "Unsupported source_type: syslog"),
    (envelope({"principal": "p", "timestamp": OK["timestamp"]}, source_type="ollama"), "validate", "Ollama event is missing mandatory identity"),
    (envelope({**OK, "timestamp": "yesterday"}), "normalize", "Invalid timestamp: yesterday"),
    (envelope({**OK, "timestamp": "2024"}), "normalize", "Invalid timestamp: 2024"),
    (envelope({**OK, "latency_ms": "fast"}), "normalize", "Invalid latency_ms: fast"),
    (envelope({**OK, "latency_ms": "fast", "timestamp": "x"}), "normalize", "Invalid latency_ms: fast"),
    (envelope(OK), None, None),
    (envelope(OK, source_type=" IAM "), None, None),
    ({"source_type": "iam", **OK}, None, None),
    (envelope({"identity": "   ", "timestamp": OK["timestamp"]}, source_type="ollama"), None, None),
]


def test_dirty_rows_name_stage_and_message(spark):
    found = {r.i: (r.stage, r.error) for r in classify(lines(spark, [d[0] for d in DIRTY])).collect()}
    for i, (row, stage, error) in enumerate(DIRTY):
        assert found[i] == (stage, error), row


def test_dead_letters_are_exactly_the_failing_rows(spark):
    letters = dead_letters(classify(lines(spark, [d[0] for d in DIRTY]))).count()
    assert letters == sum(d[1] is not None for d in DIRTY)


TIMES = [
    (1700000000, "2023-11-14T22:13:20Z"),
    (1700000000500, "2023-11-14T22:13:20.500000Z"),
    (10000000000, "2286-11-20T17:46:40Z"),
    (10000000001, "1970-04-26T17:46:40.001000Z"),
    (True, "1970-01-01T00:00:01Z"),
    (-1.5, "1969-12-31T23:59:58.500000Z"),
    ("2024-01-01T00:00:00+05:30", "2023-12-31T18:30:00Z"),
    ("2024-01-01 10:00:00.25", "2024-01-01T10:00:00.250000Z"),
    (" 2024-01-01T10:00:00Z ", "2024-01-01T10:00:00Z"),
    ("2024-01-01", "2024-01-01T00:00:00Z"),
    ("20240101T101112", "2024-01-01T10:11:12Z"),
    ("2024-01-01T10", "2024-01-01T10:00:00Z"),
    ("2024-01-01T10:11+0100", "2024-01-01T09:11:00Z"),
    ("2024-01-01T10:11:12.1234567Z", "2024-01-01T10:11:12.123456Z"),
]


def test_timestamp_forms(spark):
    frame = lines(spark, [envelope({**OK, "timestamp": t}) for t, _ in TIMES])
    found = {r.i: r.t for r in classify(frame).select("i", times.format_iso_z(F.col("ts")).alias("t")).collect()}
    assert [found[i] for i in range(len(TIMES))] == [want for _, want in TIMES]


def one(spark, row, **options):
    return normalize_lines(lines(spark, [row]), **options).collect()[0]


def test_alias_order_and_blank_wins(spark):
    got = one(spark, envelope({"identity": "", "service_identity": "  ", "principal": "p", "timestamp": 1700000000}))
    assert got.identity is None
    got = one(spark, envelope({"identity": None, "service_identity": "", "principal": " p ", "Image": "x", "image": "y", "timestamp": 1700000000}))
    assert (got.identity, got.process_name, got.process_path) == ("p", "x", "x")
    got = one(spark, envelope({**OK, "image": "y"}))
    assert (got.process_name, got.process_path) == ("y", None)


def test_envelope_masks_payload_even_with_null(spark):
    got = one(spark, envelope({**OK, "host": "inner", "hostname": "spare"}, host=None))
    assert got.host == "spare"
    got = one(spark, {k: v for k, v in envelope({**OK, "host": "inner"}).items() if k != "host"})
    assert got.host == "inner"
    # Other envelope keys are dropped.
    got = one(spark, envelope(OK, event_id="outer"))
    assert got.event_id == "e1"


def test_event_id_truthiness_and_hash(spark):
    assert one(spark, envelope({**OK, "event_id": 0, "id": "x"})).event_id == "e1"
    blank = one(spark, envelope({**OK, "event_id": "  "})).event_id
    assert len(blank) == 64
    assert one(spark, envelope({**OK, "event_id": 17})).event_id == "17"


def test_values_and_raw_payload(spark):
    got = one(spark, envelope({**OK, "success": "yes", "latency_ms": " 12.5 ", "prompt": [{"role": "u"}], "user": "x"}))
    assert (got.success, got.latency_ms, got.prompt) == (None, 12.5, '[{"role":"u"}]')
    row = normalize_lines(lines(spark, [envelope({**OK, "user": "x"})])).select(F.to_json("raw_payload").alias("r")).first()
    assert json.loads(row.r) == {**OK, "user": "x", "envelope_id": "e1", "source_type": "iam", "host": "h", "ingested_at": "2024-01-01T00:00:00+00:00"}
    assert one(spark, envelope({**OK, "success": False})).success is False


def test_source_specific_reading_is_opt_in(spark):
    row = {**envelope({"user": "svc", "parent_image": "p.exe", "timestamp": 1700000000}), "source_type": "sysmon"}
    assert one(spark, row).identity is None
    got = one(spark, row, by_source=True)
    assert (got.identity, got.parent_process) == ("svc", "p.exe")


def capture(spark):
    """Five model-call envelopes whose payload carries no timestamp."""
    stamps = ["18:07:40.219495", "18:31:38.615201", "18:33:03.893054", "18:33:23.485000", "18:33:38.857000"]
    names = ["test-service", "test-service", "research-agent", "test-service", "research-agent"]
    rows = [
        {"event_id": f"{i}-0", "envelope_id": f"env{i}", "source_type": "ollama", "host": "localhost",
         "ingested_at": f"2026-09-02T{s}+00:00", "raw_payload": json.dumps({"identity": n, "model": "m", "latency_ms": 1.5})}
        for i, (s, n) in enumerate(zip(stamps, names))
    ]
    return lines(spark, rows, "ollama")


def test_rows_without_timestamp_are_rejected_by_default(spark):
    errors = [r.error for r in classify(capture(spark)).collect()]
    assert errors == ["Missing required field: timestamp"] * 5


def test_ingestion_time_may_stand_in(spark):
    events = normalize(classify(capture(spark), timestamp_fallback="ingested_at"))
    assert events.count() == 5
    assert sorted(r.event_count for r in win.fixed_windows(events).collect()) == [1, 1, 3]
    assert sorted(r.event_count for r in win.sessions(events).collect()) == [1, 2, 2]


def test_strip_knows_unicode_whitespace(spark):
    values = ["a", " a", "a ", "　a b\t", "\x1fa", " ", "", "é", "é "]
    frame = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r[0] for r in frame.select(text.clean_string(F.col("v"))).collect()]
    assert got == [v.strip() or None for v in values]


@pytest.mark.parametrize("number", [True])
def test_line_numbers_count_blank_lines(spark, tmp_path, number):
    folder = tmp_path / "iam"
    folder.mkdir()
    (folder / "a.jsonl").write_text('{"a":1}\n\n{"a":\n   \n[1]\n{"a":2}')
    (folder / "b.jsonl").write_text('\n{"a":\n')
    numbered = jsonl.number_lines(jsonl.read_lines(spark, str(folder), number=number))
    bad = classify(numbered).filter("stage = 'read'").collect()
    got = sorted((r.file_path.rsplit("/", 1)[1], r.line_number) for r in bad)
    assert got == [("a.jsonl", 3), ("a.jsonl", 5), ("b.jsonl", 2)]
    assert {r.ingest_source for r in bad} == {"iam"}


def test_line_numbers_across_file_splits(spark, tmp_path):
    folder = tmp_path / "vault"
    folder.mkdir()
    (folder / "big.jsonl").write_text("".join(f'{{"n":{i}}}\n' for i in range(1, 3001)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        read = jsonl.read_lines(spark, str(folder), number=True)
        assert read.rdd.getNumPartitions() > 4
        rows = jsonl.number_lines(read).select("line_number", F.get_json_object("line", "$.n").cast("long").alias("n")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == 3000 and all(r.line_number == r.n for r in rows)


def test_missing_folder_is_empty_and_unknown_source_raises(spark, tmp_path):
    assert jsonl.read_source(spark, str(tmp_path), "iam").count() == 0
    with pytest.raises(ValueError):
        jsonl.read_source(spark, str(tmp_path), "syslog")


def test_text_is_parsed_once_below_the_filter(spark, sf_dir):
    from watchloom.sources.adapter import telemetry_raw

    plan = normalize_lines(telemetry_raw(spark, sf_dir)).select("event_id", "ts")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 4  # two typed reads, and two list reads for texts that could go on
    assert "parseJson" not in plan.split("Generate")[1]


def test_bytes_decode_with_replacement(spark):
    frame = spark.createDataFrame([(bytearray(b"ok"),), (bytearray(b"a\xffb"),)], "b binary")
    assert [r[0] for r in frame.select(text.decode_utf8(F.col("b"))).collect()] == ["ok", "a�b"]


def test_falsy_values(spark):
    doc = '{"a":0,"b":0.0,"c":false,"d":"","e":[],"f":{},"g":null,"h":"0","i":"false","j":[0],"k":1}'
    frame = spark.createDataFrame([(doc,)], "t string").select(F.parse_json("t").alias("v"))
    def falsy(key):
        value = F.variant_get("v", f"$.{key}", "variant")
        return variants.is_falsy(variants.type_of(value), variants.text_of(value)).alias(key)
    row = frame.select(*[falsy(k) for k in "abcdefghijkz"]).first().asDict()
    assert {k for k, v in row.items() if v} == set("abcdefgz")


def test_merged_event_parses_payload_and_line_once():
    # Once the payload, once a line that is its own event; never a parse for each key of the payload.
    assert str(merged_event()).count("try_parse_json") == 2


def test_merged_event_takes_stated_envelope_keys_only(spark):
    inner = {**OK, "host": "inner", "envelope_id": "in", "ingested_at": 5, "n": [1, {"host": "deep"}]}
    bare = {"source_type": "iam", "raw_payload": json.dumps(inner), "other": 1}
    rows = [{**bare, "host": None, "envelope_id": 7}, bare, {**inner, "source_type": "iam", "other": 1}]
    got = normalize_lines(lines(spark, rows)).select(F.to_json("raw_payload").alias("r")).collect()
    assert [json.loads(r.r) for r in got] == [{**inner, "source_type": "iam", "host": None, "envelope_id": 7}, {**inner, "source_type": "iam"}, rows[2]]


def test_one_table_holds_events_and_dead_letters(spark):
    classified = classify(lines(spark, [envelope(OK), {**OK, "source_type": "iam", "user": "x"}, *[row for row, _, _ in DIRTY]]))
    both = normalize_all(classified)
    assert not {"_text", "_env", "_wrapped"} & set(both.columns)
    shown = lambda df: sorted(map(str, df.withColumn("raw_payload", F.to_json("raw_payload")).collect()))
    assert shown(events_of(both)) == shown(normalize(classified)) and events_of(both).count() >= 2
    assert sorted(map(str, dead_letters(both).collect())) == sorted(map(str, dead_letters(classified).collect()))
    assert all((r.stage is None) == (r.line is None) for r in both.select("stage", "line").collect())
