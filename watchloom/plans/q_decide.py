"""Queries: access decisions, correlation, fusion, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchloom.operators import access, decide, evaluate, features
from watchloom.plans.oracle_parts import EV, TELE
from watchloom.plans.registry import query
from watchloom.session import scratch_path
from watchloom.sources import sinks
from watchloom.sources.adapter import event_frame, read_table, telemetry_raw
from watchloom.operators.normalize import normalize_lines

DELTA = 6 * 3600

# --- access --------------------------------------------------------------------------------

CALLS = f"""
{EV}, calls AS (SELECT event_id, 'svc-' || (user_id * 20) AS identity, 'secret/' || (k * 2) AS secret_path FROM ev),
reg AS (SELECT 'svc-' || c_custkey AS identity, 'token-' || c_name AS token, 'role-' || n_name AS role FROM customer JOIN nation ON c_nationkey = n_nationkey),
sec AS (SELECT 'secret/' || s_suppkey AS path, 'value of ' || s_name AS value FROM supplier)
"""


def calls(spark, sf):
    return event_frame(spark, sf).select(
        "event_id", F.concat(F.lit("svc-"), (F.col("user_id") * 20).cast("string")).alias("identity"),
        F.concat(F.lit("secret/"), (F.col("k") * 2).cast("string")).alias("secret_path"),
    )


def registry(spark, sf):
    nation = read_table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return read_table(spark, sf, "customer").join(nation, "c_nationkey").select(
        F.concat(F.lit("svc-"), F.col("c_custkey").cast("string")).alias("identity"),
        F.concat(F.lit("token-"), F.col("c_name")).alias("token"), F.concat(F.lit("role-"), F.col("n_name")).alias("role"),
    )


def secrets(spark, sf):
    return read_table(spark, sf, "supplier").select(
        F.concat(F.lit("secret/"), F.col("s_suppkey").cast("string")).alias("path"), F.concat(F.lit("value of "), F.col("s_name")).alias("value")
    )


@query("auth_known_identity", f"WITH {CALLS} SELECT event_id, identity, identity IN (SELECT identity FROM reg) AS success FROM calls")
def auth_known_identity(spark, sf):
    return access.known_identity(calls(spark, sf), registry(spark, sf)).select("event_id", "identity", "success")


@query("auth_secret_access", f"""
WITH {CALLS} SELECT event_id, identity IN (SELECT identity FROM reg) AND secret_path IN (SELECT path FROM sec) AS success FROM calls""")
def auth_secret_access(spark, sf):
    return access.secret_access(calls(spark, sf), registry(spark, sf), secrets(spark, sf)).select("event_id", "success")


@query("role_token_lookup", f"""
WITH {CALLS} SELECT event_id, identity, token, role, value AS secret_value FROM calls JOIN reg USING (identity) LEFT JOIN sec ON path = secret_path""")
def role_token_lookup(spark, sf):
    granted = access.secret_access(access.role_token(calls(spark, sf), registry(spark, sf)), registry(spark, sf), secrets(spark, sf))
    return access.secret_value(granted, secrets(spark, sf)).select("event_id", "identity", "token", "role", F.col("value").alias("secret_value"))


# --- labelled events and scores ------------------------------------------------------------

LAB = f"""
{EV}, lab AS (SELECT *, event_type = 'error' AND k >= 60 AS attack, round(least(value / 150.0, 1.0), 4) AS s_l, k / 100.0 AS s_n,
  user_id % 20 AS run FROM ev)
"""


def labelled(spark, sf):
    ev = event_frame(spark, sf)
    return ev.select(
        "event_id", "n", "ts", "identity", "action", "ingest_source", "k", "user_id", "value",
        ((F.col("event_type") == "error") & (F.col("k") >= 60)).alias("attack"),
        F.round(F.least(F.col("value") / 150.0, F.lit(1.0)), 4).alias("s_l"), (F.col("k") / 100.0).alias("s_n"),
        F.pmod("user_id", F.lit(20)).alias("run"),
    )


@query("label_attach", f"""
WITH {LAB} SELECT event_id, CASE WHEN run < 5 THEN 'adversarial' ELSE 'benign' END AS label, CASE WHEN run < 5 THEN 'T' || (1000 + run) END AS technique_id FROM lab""")
def label_attach(spark, sf):
    rows = labelled(spark, sf).withColumn("scenario_run_id", F.concat(F.lit("run-"), F.col("run").cast("string")))
    scenarios = spark.createDataFrame(
        [(f"run-{i}", "adversarial", f"T{1000 + i}") for i in range(5)], "scenario_run_id string, label string, technique_id string"
    )
    return features.attach_labels(rows, scenarios).select("event_id", "label", "technique_id")


CONTEXT = f"""
{LAB}, attr AS (SELECT 'user-' || c_custkey AS identity, c_mktsegment AS role, c_nationkey % 10 AS privilege,
  DATE '2023-06-01' + CAST(c_custkey % 200 AS INTEGER) AS issued FROM customer),
ctx AS (SELECT event_id, role, privilege, date_diff('day', issued, CAST(make_timestamp(us) AS DATE)) AS age FROM lab LEFT JOIN attr USING (identity))
"""


def context(spark, sf):
    attributes = read_table(spark, sf, "customer").select(
        F.concat(F.lit("user-"), F.col("c_custkey").cast("string")).alias("identity"), F.col("c_mktsegment").alias("role"),
        F.pmod("c_nationkey", F.lit(10)).alias("privilege"),
        F.date_add(F.lit("2023-06-01").cast("date"), F.pmod("c_custkey", F.lit(200)).cast("int")).alias("credential_issued"),
    )
    return features.identity_context(labelled(spark, sf), attributes, "ts")


@query("identity_context", f"WITH {CONTEXT} SELECT event_id, role, privilege, age AS credential_age_days FROM ctx")
def identity_context(spark, sf):
    return context(spark, sf).select("event_id", "role", "privilege", "credential_age_days")


@query("static_rule_baseline", f"""
WITH {CONTEXT} SELECT event_id, CASE WHEN privilege >= 8 THEN 'privilege' WHEN age > 300 THEN 'credential_age' ELSE 'none' END AS rule FROM ctx""")
def static_rule_baseline(spark, sf):
    return features.static_rule(context(spark, sf), 8, 300).select("event_id", "rule")


@query("sandbox_trigger", f"WITH {LAB} SELECT event_id, s_l, s_n FROM lab WHERE s_l >= 0.8 OR s_n >= 0.9")
def sandbox_trigger(spark, sf):
    return decide.sandbox_trigger(labelled(spark, sf), "s_l", "s_n", F.lit(0.8), F.lit(0.9)).select("event_id", "s_l", "s_n")


# --- correlation and decision --------------------------------------------------------------

COR = f"""
{LAB}, fl AS (SELECT *, s_l >= 0.7 AS is_a, s_n >= 0.8 AS is_b FROM lab),
al AS (SELECT * FROM fl WHERE is_a OR is_b),
pairs AS (SELECT x.event_id, bool_or(y.us <= x.us) AS pb, bool_or(y.us >= x.us) AS pa FROM al x JOIN al y
  ON x.identity = y.identity AND abs(x.us - y.us) <= {DELTA}000000 AND ((x.is_a AND y.is_b) OR (x.is_b AND y.is_a)) GROUP BY 1),
cor AS (SELECT fl.*, coalesce(pb, false) AS partner_before, coalesce(pa, false) AS partner_after, pairs.event_id IS NOT NULL AS correlated
  FROM fl LEFT JOIN pairs USING (event_id))
"""


def correlated(spark, sf):
    return decide.temporal_correlation(
        labelled(spark, sf), "identity", F.col("s_l") >= 0.7, F.col("s_n") >= 0.8, DELTA
    )


@query("temporal_correlation", f"WITH {COR} SELECT event_id, partner_before, partner_after, correlated FROM cor")
def temporal_correlation(spark, sf):
    return correlated(spark, sf).select("event_id", "partner_before", "partner_after", "correlated")


CONFIG = (0.75, 0.45, 0.6, 1.5, DELTA, 0.5, 0.5)
DEC = f"""
{COR}, fu AS (SELECT *, CASE WHEN correlated THEN least((0.5 * s_l + 0.5 * s_n) * 1.5, 1.0) ELSE 0.5 * s_l + 0.5 * s_n END AS fused,
  abs(s_l - s_n) > 0.6 AS disagree FROM cor),
de AS (SELECT *, CASE WHEN disagree THEN 'ESCALATE' WHEN correlated AND fused >= 0.75 THEN 'HARD_CONTAINMENT' WHEN fused >= 0.75 THEN 'SOFT_QUARANTINE'
  WHEN fused >= 0.45 THEN 'ESCALATE' ELSE 'DISMISS' END AS decision FROM fu)
"""


def config(spark):
    return spark.createDataFrame(
        [tuple(float(x) for x in CONFIG)], ", ".join(f"{n} double" for n in decide.THRESHOLDS)
    )


def decisions(spark, sf):
    return decide.decide(correlated(spark, sf), config(spark), "s_l", "s_n")


@query("threshold_feedback", f"WITH {LAB} SELECT event_id, s_n >= 0.75 AS contained FROM lab")
def threshold_feedback(spark, sf):
    # The thresholds are written and read back as a table, as another tool would change them.
    path = scratch_path(spark, "thresholds")
    sinks.write_table(config(spark), path)
    rows = decide.with_thresholds(labelled(spark, sf), spark.read.parquet(path))
    return rows.select("event_id", (F.col("s_n") >= F.col("theta_contain")).alias("contained"))


@query("fusion_score", f"WITH {LAB} SELECT event_id, round(0.5 * s_l + 0.5 * s_n, 6) AS fused FROM lab")
def fusion_score(spark, sf):
    fused = decide.fusion_score(F.col("s_l"), F.col("s_n"), F.lit(0.5), F.lit(0.5))
    return labelled(spark, sf).select("event_id", F.round(fused, 6).alias("fused"))


@query("disagreement", f"WITH {LAB} SELECT event_id, abs(s_l - s_n) > 0.6 AS disagree FROM lab")
def disagreement(spark, sf):
    return labelled(spark, sf).select("event_id", decide.disagreement(F.col("s_l"), F.col("s_n"), F.lit(0.6)).alias("disagree"))


@query("decision", f"WITH {DEC} SELECT event_id, round(fused, 6) AS fused, decision FROM de")
def decision(spark, sf):
    return decisions(spark, sf).select("event_id", F.round("fused", 6).alias("fused"), "decision")


@query("response_plan", f"""
WITH {DEC} SELECT event_id, identity, decision, CASE decision WHEN 'HARD_CONTAINMENT' THEN 'revoke_credentials'
  WHEN 'SOFT_QUARANTINE' THEN 'restrict_session' ELSE 'notify_analyst' END AS action FROM de WHERE decision <> 'DISMISS'""")
def response_plan(spark, sf):
    path = scratch_path(spark, "actions")
    decide.response_plan(decisions(spark, sf)).write.mode("append").json(path)
    return spark.read.schema("event_id string, identity string, decision string, action string").json(path)


# --- evaluation ----------------------------------------------------------------------------


@query("dataset_summary", f"""
WITH {LAB}, r AS (SELECT CASE WHEN attack THEN 'adversarial' ELSE 'benign' END AS label, CASE WHEN attack THEN 'T' || (1000 + k % 3) ELSE 'none' END AS technique,
  CASE WHEN run < 14 THEN 'train' WHEN run < 17 THEN 'val' ELSE 'test' END AS split FROM lab)
SELECT coalesce(label, 'all') AS label, coalesce(technique, 'all') AS technique, coalesce(split, 'all') AS split, count(*) AS n
FROM r GROUP BY CUBE (label, technique, split)""")
def dataset_summary(spark, sf):
    run = F.col("run")
    rows = labelled(spark, sf).select(
        F.when(F.col("attack"), "adversarial").otherwise("benign").alias("label"),
        F.when(F.col("attack"), F.concat(F.lit("T"), (F.pmod("k", F.lit(3)) + 1000).cast("string"))).alias("technique"),
        F.when(run < 14, "train").when(run < 17, "val").otherwise("test").alias("split"),
    )
    return evaluate.dataset_summary(rows, ["label", "technique", "split"])


METRICS_SQL = """round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall,
  round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1"""


def _rounded(*names):
    return [F.round(n, 6).alias(n) for n in names]


@query("confusion_metrics", f"""
WITH {LAB}, c AS (SELECT ingest_source, count(*) FILTER (attack AND s_n >= 0.7) AS tp, count(*) FILTER (NOT attack AND s_n >= 0.7) AS fp,
  count(*) FILTER (attack AND s_n < 0.7) AS fn, count(*) FILTER (NOT attack AND s_n < 0.7) AS tn FROM lab GROUP BY 1)
SELECT ingest_source, tp, fp, fn, tn, {METRICS_SQL}, round(CASE WHEN fp + tn = 0 THEN 0 ELSE fp / (fp + tn) END, 6) AS fpr FROM c""")
def confusion_metrics(spark, sf):
    found = evaluate.confusion_metrics(labelled(spark, sf), F.col("attack"), F.col("s_n") >= 0.7, ["ingest_source"])
    return found.select("ingest_source", "tp", "fp", "fn", "tn", *_rounded("precision", "recall", "f1", "fpr"))


@query("detector_comparison", f"""
WITH {LAB}, v AS (SELECT attack, unnest(['static', 'dynamic', 'fused']) AS detector, unnest([s_l >= 0.6, s_n >= 0.6, 0.5 * s_l + 0.5 * s_n >= 0.6]) AS hit FROM lab),
c AS (SELECT detector, count(*) FILTER (attack AND hit) AS tp, count(*) FILTER (NOT attack AND hit) AS fp, count(*) FILTER (attack AND NOT hit) AS fn FROM v GROUP BY 1)
SELECT detector, {METRICS_SQL} FROM c""")
def detector_comparison(spark, sf):
    found = evaluate.compare_detectors(
        labelled(spark, sf), F.col("attack"),
        {"static": F.col("s_l") >= 0.6, "dynamic": F.col("s_n") >= 0.6, "fused": 0.5 * F.col("s_l") + 0.5 * F.col("s_n") >= 0.6},
    )
    return found.select("detector", *_rounded("precision", "recall", "f1"))


CURVE = f"""
{LAB}, ps AS (SELECT s_l AS score, count(*) FILTER (attack) AS pos, count(*) FILTER (NOT attack) AS neg FROM lab GROUP BY 1),
cu AS (SELECT score, CAST(sum(pos) OVER (ORDER BY score DESC) AS BIGINT) AS tp, CAST(sum(neg) OVER (ORDER BY score DESC) AS BIGINT) AS fp FROM ps),
cv AS (SELECT *, (SELECT sum(pos) FROM ps) - tp AS fn FROM cu)
"""


@query("cumulative_counts", f"WITH {CURVE} SELECT score, tp, fp FROM cu")
def cumulative_counts(spark, sf):
    return evaluate.cumulative_counts(labelled(spark, sf).withColumnRenamed("s_l", "score"), "score", F.col("attack"))


@query("threshold_sweep", f"WITH {CURVE} SELECT score, {METRICS_SQL} FROM cv")
def threshold_sweep(spark, sf):
    curve = evaluate.threshold_sweep(labelled(spark, sf).withColumnRenamed("s_l", "score"), "score", F.col("attack"))
    return curve.select("score", *_rounded("precision", "recall", "f1"))


@query("operating_threshold", f"WITH {CURVE}, m AS (SELECT score, {METRICS_SQL} FROM cv) SELECT score, precision, recall, f1 FROM m ORDER BY f1 DESC, score DESC LIMIT 1")
def operating_threshold(spark, sf):
    curve = evaluate.threshold_sweep(labelled(spark, sf).withColumnRenamed("s_l", "score"), "score", F.col("attack"))
    return evaluate.best_threshold(curve, "score").select("score", *_rounded("precision", "recall", "f1"))


@query("latency_distribution", f"""
WITH {LAB} SELECT s_l >= 0.7 OR s_n >= 0.9 AS triggered, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95,
  round(quantile_cont(value, 0.99), 6) AS p99 FROM lab GROUP BY 1""")
def latency_distribution(spark, sf):
    rows = labelled(spark, sf).withColumn("triggered", (F.col("s_l") >= 0.7) | (F.col("s_n") >= 0.9))
    found = evaluate.latency_distribution(rows, "value", ["triggered"], [0.5, 0.95, 0.99])
    return found.select("triggered", "n", *_rounded("p50", "p95", "p99"))


@query("source_coverage", f"""
WITH {TELE}, s(ingest_source) AS (VALUES ('sysmon'), ('auditd'), ('ollama'), ('iam'), ('vault'), ('api_gateway'))
SELECT ingest_source, count(n) AS n, count(n) = 0 AS missing FROM s LEFT JOIN good USING (ingest_source) GROUP BY 1""")
def source_coverage(spark, sf):
    return evaluate.source_coverage(normalize_lines(telemetry_raw(spark, sf)))


GRID = [(round(w / 4, 2), round(0.3 + t / 10, 1)) for w in range(5) for t in range(5)]
GRID_SQL = f"""
{LAB}, g(w, theta) AS (VALUES {', '.join(f'({w}::DOUBLE, {t}::DOUBLE)' for w, t in GRID)}),
c AS (SELECT w, theta, count(*) FILTER (attack AND hit) AS tp, count(*) FILTER (NOT attack AND hit) AS fp, count(*) FILTER (attack AND NOT hit) AS fn
  FROM (SELECT w, theta, attack, round(w * s_l + (1 - w) * s_n, 6) >= theta AS hit FROM lab CROSS JOIN g) GROUP BY 1, 2)
"""


@query("weight_grid_sweep", f"WITH {GRID_SQL} SELECT w, theta, {METRICS_SQL} FROM c")
def weight_grid_sweep(spark, sf):
    found = evaluate.weight_grid_sweep(labelled(spark, sf), "s_l", "s_n", F.col("attack"), GRID)
    return found.select("w", "theta", *_rounded("precision", "recall", "f1"))


@query("best_weight_setting", f"WITH {GRID_SQL}, m AS (SELECT w, theta, {METRICS_SQL} FROM c) SELECT w, theta, f1 FROM m ORDER BY f1 DESC, w DESC, theta DESC LIMIT 1")
def best_weight_setting(spark, sf):
    found = evaluate.weight_grid_sweep(labelled(spark, sf), "s_l", "s_n", F.col("attack"), GRID)
    return evaluate.best_setting(found).select("w", "theta", *_rounded("f1"))


@query("group_split", f"""
WITH {LAB} SELECT CASE WHEN run * 37 % 100 < 70 THEN 'train' WHEN run * 37 % 100 < 85 THEN 'val' ELSE 'test' END AS split,
  run, count(*) AS n FROM lab GROUP BY ALL""")
def group_split(spark, sf):
    rows = evaluate.group_split(labelled(spark, sf), F.col("run"))
    return rows.groupBy("split", "run").agg(F.count(F.lit(1)).alias("n"))


@query("class_imbalance_sample", f"WITH {LAB} SELECT event_id, attack FROM lab WHERE NOT attack OR n * 31 % 100 < 20")
def class_imbalance_sample(spark, sf):
    return evaluate.imbalance_sample(labelled(spark, sf), F.col("attack"), F.col("n"), 20).select("event_id", "attack")
