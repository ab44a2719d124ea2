"""Scores, explanations and models on hand-checked cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from watchloom.operators import access, decide, evaluate, features, models, scoring
from watchloom.plans import scoring as job
from watchloom.schemas import EVENT_FIELDS


def seqs(spark, rows):
    """rows: (identity, seq_no, [[features], ...])"""
    data = [(i, n, t + 1, [float(x) for x in step]) for i, n, steps in rows for t, step in enumerate(steps)]
    return spark.createDataFrame(data, "identity string, seq_no long, t int, features array<double>")


def scores(spark, history, current):
    stats = scoring.baseline_fit(seqs(spark, history))
    scored = scoring.baseline_score(scoring.sequence_mean(seqs(spark, current)), stats)
    return {r.identity: r.score for r in scored.collect()}


def test_baseline_scores(spark):
    flat = [[2, 2, 2]] * 5
    spread = [[-1, 1, -1], [1, -1, 1]]
    got = scores(
        spark, [("same", 1, flat), ("moved", 1, flat), ("wide", 1, spread)],
        [("new", 1, flat), ("same", 2, flat), ("moved", 2, [[2.1] * 3] * 5), ("wide", 2, [[1.5] * 3] * 5)],
    )
    assert got["new"] == 1.0 and got["same"] == 0.0 and got["moved"] == 1.0
    assert got["wide"] == pytest.approx(0.5, abs=1e-5)


def test_no_value_gives_no_score(spark):
    row = spark.range(1).select(
        scoring.zscore(F.lit(None).cast("double"), F.lit(0.0), F.lit(1.0)).alias("a"),
        scoring.zscore(F.lit(float("nan")), F.lit(0.0), F.lit(1.0)).alias("b"),
    ).first()
    assert (row.a, row.b) == (None, None)


def test_route_clip_and_explanations(spark):
    current = [("short", 1, [[3, 1, 0]] * 9), ("long", 1, [[3, 1, 0]] * 10), ("far", 1, [[5, 1, 1]] * 10)]
    profile = spark.createDataFrame([(0, [1.0, 1.0, 1.0]), (1, [1.0, 1.0, 1.0])], "t int, expected array<double>")
    errors = scoring.sequence_errors(scoring.reconstruct_profile(seqs(spark, current), profile), 3)
    stats = scoring.baseline_fit(seqs(spark, [("short", 0, [[3, 1, 0]] * 9)]))
    got = {r.identity: r for r in scoring.analyze_sequences(errors, stats).collect()}
    assert got["short"].route == "baseline" and got["short"].score == 0.0
    assert got["short"].explanations == ["Sequence too short. Used statistical fallback."]
    assert got["long"].route == "reconstruction" and got["long"].score == 1.0
    assert got["long"].explanations == [
        "Anomaly driven by Feature_0 (Error: 4.0000)", "Anomaly driven by Feature_2 (Error: 1.0000)",
        "Anomaly driven by Feature_1 (Error: 0.0000)",
    ]
    assert got["far"].score == 1.0


def test_ties_go_in_index_order_and_only_three_are_named(spark):
    row = spark.range(1).select(scoring.top_features(F.array(*[F.lit(0.5)] * 4)).alias("x")).first()
    assert [x.split(" ")[3] for x in row.x] == ["Feature_0", "Feature_1", "Feature_2"]


def test_sequences_split_at_gaps(spark):
    rows = [("a", f"2024-01-01T{h:02d}:30:00Z") for h in (0, 0, 1, 5, 6)]
    events = spark.createDataFrame(rows, "identity string, s string").withColumn("ts", F.col("s").cast("timestamp"))
    steps = features.activity_features(events, 3600, {"all": F.lit(True)})
    got = features.sequences(steps, 2 * 3600).orderBy("step_start").collect()
    assert [(r.seq_no, r.t, r.features) for r in got] == [(1, 1, [2.0]), (1, 2, [1.0]), (2, 1, [1.0]), (2, 2, [1.0])]


def reference_layer(x, w, name):
    """The same recurrence step by step on scalars of one sequence."""
    sig = lambda v: 1 / (1 + np.exp(-v))
    u = w[f"{name}.state"].shape[0]
    h, c, out = np.zeros(u), np.zeros(u), []
    for step in x:
        z = w[f"{name}.input"].T @ step + w[f"{name}.state"].T @ h + w[f"{name}.bias"]
        c = sig(z[u:2 * u]) * c + sig(z[:u]) * np.tanh(z[2 * u:3 * u])
        h = sig(z[3 * u:]) * np.tanh(c)
        out.append(h)
    return np.array(out)


def test_recurrent_model_matches_single_sequence_loop(spark):
    rng = np.random.default_rng(4)
    weights = models.random_weights(3, 16, seed=2)
    data = [(f"i{k}", 1, rng.integers(0, 4, (n, 3)).tolist()) for k, n in enumerate((3, 7, 3))]
    got = {r.identity: r for r in models.recurrent_errors(seqs(spark, data), weights).collect()}
    for name, _, steps in data:
        x = np.array(steps, dtype=float)
        code = reference_layer(reference_layer(x, weights, "encoder0"), weights, "encoder1")[-1]
        rebuilt = reference_layer(reference_layer(np.tile(code, (len(x), 1)), weights, "decoder0"), weights, "decoder1")
        want = ((rebuilt - x) ** 2).mean(axis=0)
        assert got[name].errors == pytest.approx(list(want))
        assert got[name].mse == pytest.approx(min(want.mean(), 1.0))


def test_linear_autoencoder_rebuilds_its_own_plane(spark):
    rng = np.random.default_rng(1)
    plane = rng.normal(size=(60, 2)) @ rng.normal(size=(2, 5)) + 3
    rows = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(plane)] + [(99, [50.0, 0.0, 0.0, 0.0, 0.0])], "id int, v array<double>")
    mean, model = models.fit_linear_autoencoder(rows.filter("id < 60"), "v", 2)
    got = {r.id: r.mse for r in models.reconstruct_linear(rows, "v", mean, model).collect()}
    assert max(got[i] for i in range(60)) < 1e-9 and got[99] > 1


@pytest.mark.parametrize("block", [1, 2, 10_000])
def test_nearest_entries_are_the_same_in_any_blocks(spark, block):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id int, v array<double>")
    index = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(5)], "e int, entry array<double>")
    got = sorted((r.id, r["rank"], r.e) for r in models.nearest_entries(rows, "id", "v", index, "e", 2, block).collect())
    assert got == [(1, 1, 0), (1, 2, 1), (2, 1, 4), (2, 2, 3)]


@pytest.mark.parametrize(
    "s, n, correlated, want",
    [(0.95, 0.1, True, "ESCALATE"), (0.8, 0.8, True, "HARD_CONTAINMENT"), (0.8, 0.8, False, "SOFT_QUARANTINE"),
     (0.5, 0.5, False, "ESCALATE"), (0.1, 0.1, False, "DISMISS"), (0.55, 0.55, True, "HARD_CONTAINMENT")],
)
def test_decision_order(spark, s, n, correlated, want):
    config = spark.createDataFrame([(0.75, 0.45, 0.6, 1.5, 60.0, 0.5, 0.5)], ", ".join(f"{t} double" for t in decide.THRESHOLDS))
    rows = spark.createDataFrame([("e", "u", s, n, correlated)], "event_id string, identity string, s double, n double, correlated boolean")
    got = decide.decide(rows, config, "s", "n")
    assert got.first().decision == want
    plan = got.filter("decision = 'DISMISS'" if want == "DISMISS" else "decision <> 'DISMISS'")
    assert decide.response_plan(plan).count() == (0 if want == "DISMISS" else 1)


def test_access_decisions(spark):
    ids = spark.createDataFrame([("test-service", "t1", "r1"), ("backup-service", "t2", "r2")], "identity string, token string, role string")
    secrets = spark.createDataFrame([("database/password",), ("api/key",)], "path string")
    calls = spark.createDataFrame(
        [(1, "test-service", "api/key"), (2, "test-service", "x"), (3, "ghost", "api/key"), (4, None, "api/key")],
        "n int, identity string, secret_path string",
    )
    got = {r.n: r.success for r in access.secret_access(calls, ids, secrets).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False}
    assert {r.n for r in access.require_caller(calls).filter("reject_reason IS NOT NULL").collect()} == {4}
    assert {(r.n, r.token) for r in access.role_token(calls, ids).collect()} == {(1, "t1"), (2, "t1")}


def test_zero_guards(spark):
    rows = spark.createDataFrame([(False, False)], "y boolean, p boolean").withColumn("g", F.lit(1))
    got = evaluate.confusion_metrics(rows, F.col("y"), F.col("p"), ["g"]).first()
    assert (got.precision, got.recall, got.f1, got.fpr) == (0.0, 0.0, 0.0, 0.0)


def test_runs_are_never_split(spark):
    rows = spark.range(500).select((F.col("id") % 40).alias("run"))
    per_run = evaluate.group_split(rows, F.col("run")).groupBy("run").agg(F.count_distinct("split").alias("n"))
    assert {r.n for r in per_run.collect()} == {1}


def test_record_has_the_fixed_fields():
    assert len(EVENT_FIELDS) == 22


def test_moments_in_steps_equal_the_fit_at_once(spark):
    rng = np.random.default_rng(5)
    rows = [(f"i{n % 7}", n, (1e6 + rng.normal(size=(4, 3))).tolist()) for n in range(60)] + [("late", 60, [[1, 2, 3]])]
    parts = [seqs(spark, rows[:25]), seqs(spark, rows[25:40]), seqs(spark, rows[40:])]
    want = {r.identity: (r.mean, r["std"]) for r in scoring.baseline_fit(seqs(spark, rows)).collect()}
    state = None
    for part in parts:
        new = scoring.moments(part)
        state = new if state is None else scoring.merge_moments(state, new)
    at_once = scoring.merge_moments(*[scoring.moments(p) for p in parts])
    for merged in (state, at_once):
        got = {r.identity: (r.mean, r["std"]) for r in scoring.baseline_of(merged).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)


def test_profiles_in_steps_equal_the_fit_at_once(spark):
    rows = [("a", n, [[n, 2.0 * n, 1.0]] * (1 + n % 4)) for n in range(20)]
    parts = [scoring.profile_sums(seqs(spark, part), 3) for part in (rows[:3], rows[3:])]
    merged = scoring.profile_of(scoring.merge_profiles(*parts, width=3), 3)
    got, want = ({r.t: r.expected for r in p.collect()} for p in (merged, scoring.profile_fit(seqs(spark, rows), 3)))
    assert got.keys() == want.keys() and all(got[t] == pytest.approx(want[t]) for t in want)


def test_a_step_can_be_run_again_and_empty_steps_change_nothing(spark, tmp_path):
    rows = seqs(spark, [("a", 1, [[1, 2, 3]] * 3), ("b", 2, [[4, 5, 9]] * 2)]).withColumn("adversarial", F.lit(False))
    fitted = lambda pair: [sorted(map(str, part.collect())) for part in pair]
    first = fitted(job.fit_step(rows, 3, f"{tmp_path}/1"))
    again = fitted(job.fit_step(rows.filter("false"), 3, f"{tmp_path}/2", previous=f"{tmp_path}/1"))
    assert first == again == fitted(job.fit_step(rows.filter("false"), 3, f"{tmp_path}/2", previous=f"{tmp_path}/1"))
    stats, profile = job.fit_step(rows.filter("false"), 3, f"{tmp_path}/none")
    assert stats.count() == 0 and [r.t for r in profile.collect()] == [0]


@pytest.mark.parametrize("limit", [1000, 1])
def test_phrases_count_wherever_they_begin(spark, limit):
    lexicon = spark.createDataFrame(
        [("rm", 1.0), ("rm rf", 1.0), ("rf", 0.5), ("net  User add", 2.0), ("net", 1.0), ("rm", 0.25), ("--", 9.0), (None, 1.0), ("x", None), ("a a", 4.0)],
        "term string, weight double",
    )
    texts = spark.createDataFrame(
        [(1, "rm -rf / ; RM"), (2, "Net\nuser\tADD net user"), (3, None), (4, ""), (5, "farm rmx net-user"), (6, "a a a")], "id int, text string"
    )
    signals = features.lexicon_weight(texts, "id", F.col("text"), lexicon, limit)
    assert {r.id: r.signal for r in signals.collect()} == {1: 4.0, 2: 4.0, 3: 0.0, 4: 0.0, 5: 1.0, 6: 8.0}
    assert ("Exchange" in signals._jdf.queryExecution().executedPlan().toString()) == (limit == 1)
    nothing = features.lexicon_weight(texts, "id", F.col("text"), lexicon.filter("false"), limit)
    assert {r.signal for r in nothing.collect()} == {0.0}
