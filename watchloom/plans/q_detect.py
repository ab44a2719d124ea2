"""Queries: features, baselines, reconstruction, explanation, models."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchloom.functions.text import feature_explanation
from watchloom.operators import evaluate, features, models, retrieval, scoring
from watchloom.operators.skew import attach
from watchloom.operators.normalize import normalize_lines
from watchloom.plans import scoring as job
from watchloom.plans.detection import detection_run
from watchloom.plans.oracle_parts import EV, TELE
from watchloom.plans.registry import query
from watchloom.session import checkpoint, materialize, scratch_path
from watchloom.sources.adapter import event_frame, read_table, telemetry_raw
from watchloom.sources.sinks import write_table

HOUR, DAY = 3600, 86400
CUTOFF_US = 1_705_795_200_000_000  # 2024-01-21
WIDTH = 3

SEQ = f"""
{EV}, steps AS (SELECT identity, us // {HOUR}000000 * {HOUR}000000 AS step_us, min(us) AS first_us, max(us) AS last_us,
    CAST(count(*) FILTER (event_type IN ('signup', 'view')) AS DOUBLE) AS f0,
    CAST(count(*) FILTER (event_type IN ('click', 'purchase')) AS DOUBLE) AS f1,
    CAST(count(*) FILTER (event_type = 'error') AS DOUBLE) AS f2, bool_or(event_type = 'error' AND k >= 95) AS adv
  FROM ev GROUP BY 1, 2),
lagged AS (SELECT *, CASE WHEN first_us - lag(last_us) OVER (PARTITION BY identity ORDER BY step_us) <= {DAY}000000 THEN 0 ELSE 1 END AS starts FROM steps),
seqd AS (SELECT *, sum(starts) OVER (PARTITION BY identity ORDER BY step_us ROWS UNBOUNDED PRECEDING) AS seq_no FROM lagged),
seq AS (SELECT *, row_number() OVER (PARTITION BY identity, seq_no ORDER BY step_us) AS t,
    min(step_us) OVER (PARTITION BY identity, seq_no) AS seq_start, bool_or(adv) OVER (PARTITION BY identity, seq_no) AS seq_adv FROM seqd),
hist AS (SELECT * FROM seq WHERE seq_start < {CUTOFF_US}), cur AS (SELECT * FROM seq WHERE seq_start >= {CUTOFF_US}),
stats AS (SELECT identity, avg(x) AS mean, stddev_pop(x) + 1e-6 AS std FROM (SELECT identity, unnest([f0, f1, f2]) AS x FROM hist) GROUP BY 1),
prof AS (SELECT t, avg(f0) AS e0, avg(f1) AS e1, avg(f2) AS e2 FROM hist WHERE NOT seq_adv GROUP BY t),
allp AS (SELECT avg(f0) AS a0, avg(f1) AS a1, avg(f2) AS a2 FROM hist WHERE NOT seq_adv),
rec AS (SELECT cur.*, coalesce(e0, a0) AS e0, coalesce(e1, a1) AS e1, coalesce(e2, a2) AS e2 FROM cur CROSS JOIN allp LEFT JOIN prof ON cur.t = prof.t),
err AS (SELECT identity, seq_no, count(*) AS length, sum(f0 + f1 + f2) / (3 * count(*)) AS seq_mean,
    avg((f0 - e0) ** 2) AS m0, avg((f1 - e1) ** 2) AS m1, avg((f2 - e2) ** 2) AS m2 FROM rec GROUP BY 1, 2),
scored AS (SELECT err.*, least((m0 + m1 + m2) / 3, 1.0) AS mse, CASE WHEN mean IS NULL THEN 1.0 ELSE least(abs(seq_mean - mean) / std / 3.0, 1.0) END AS base
    FROM err LEFT JOIN stats USING (identity)),
feat AS (SELECT identity, seq_no, unnest([0, 1, 2]) AS i, unnest([m0, m1, m2]) AS mse FROM scored),
ranked AS (SELECT identity, seq_no, 'Feature_' || i AS feature, mse, row_number() OVER (PARTITION BY identity, seq_no ORDER BY mse DESC, i) AS rank FROM feat)
"""
SEQ_KEY = "identity, CAST(seq_no AS BIGINT) AS seq_no"


def sequences(spark, sf):
    kind = F.col("event_type")
    classes = {
        "logon": kind.isin("signup", "view"), "file": kind.isin("click", "purchase"), "device": kind == "error",
    }
    return job.build_sequences(event_frame(spark, sf), HOUR, DAY, classes, (kind == "error") & (F.col("k") >= 95))


def split(spark, sf):
    # One pass over the events; fitting and scoring read the much smaller step table.
    seqs = materialize(sequences(spark, sf), "sequences")
    is_history = F.unix_micros("seq_start") < CUTOFF_US
    return seqs.filter(is_history), seqs.filter(~is_history)


def errors(spark, sf):
    history, current = split(spark, sf)
    stats, profile = job.fit(history, WIDTH)
    return scoring.sequence_errors(scoring.reconstruct_profile(current, profile), WIDTH), stats


@query("activity_features", f"WITH {SEQ} SELECT identity, step_us, f0, f1, f2 FROM steps")
def activity_features(spark, sf):
    return sequences(spark, sf).select(
        "identity", F.unix_micros("step_start").alias("step_us"), *[F.col("features")[i].alias(f"f{i}") for i in range(3)]
    )


@query("sequence_position", f"WITH {SEQ} SELECT {SEQ_KEY}, step_us, t FROM seq")
def sequence_position(spark, sf):
    return sequences(spark, sf).select("identity", "seq_no", F.unix_micros("step_start").alias("step_us"), "t")


@query("moving_average", f"""
WITH {SEQ} SELECT {SEQ_KEY}, t, round(avg((f0 + f1 + f2) / 3) OVER (PARTITION BY identity, seq_no ORDER BY t ROWS 4 PRECEDING), 6) AS moving_avg FROM seq""")
def moving_average(spark, sf):
    return features.moving_average(sequences(spark, sf)).select("identity", "seq_no", "t", F.round("moving_avg", 6).alias("moving_avg"))


@query("benign_only", f"WITH {SEQ} SELECT {SEQ_KEY}, count(*) AS length FROM seq WHERE NOT seq_adv GROUP BY ALL")
def benign_only(spark, sf):
    return features.benign_only(sequences(spark, sf), "adversarial").groupBy("identity", "seq_no").agg(F.count(F.lit(1)).alias("length"))


@query("baseline_fit", f"WITH {SEQ} SELECT identity, round(mean, 6) AS mean, round(std, 6) AS std FROM stats")
def baseline_fit(spark, sf):
    history, _ = split(spark, sf)
    return scoring.baseline_fit(history).select("identity", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("sequence_mean", f"WITH {SEQ} SELECT {SEQ_KEY}, count(*) AS length, round(sum(f0 + f1 + f2) / (3 * count(*)), 6) AS seq_mean FROM seq GROUP BY ALL")
def sequence_mean(spark, sf):
    return scoring.sequence_mean(sequences(spark, sf)).select("identity", "seq_no", "length", F.round("seq_mean", 6).alias("seq_mean"))


@query("baseline_lookup", f"WITH {SEQ} SELECT {SEQ_KEY}, mean IS NOT NULL AS known FROM err LEFT JOIN stats USING (identity)")
def baseline_lookup(spark, sf):
    history, current = split(spark, sf)
    joined = scoring.sequence_mean(current).join(scoring.baseline_fit(history), "identity", "left")
    return joined.select("identity", "seq_no", F.col("mean").isNotNull().alias("known"))


@query("baseline_score", f"WITH {SEQ} SELECT {SEQ_KEY}, round(base, 6) AS score FROM scored")
def baseline_score(spark, sf):
    history, current = split(spark, sf)
    scored = scoring.baseline_score(scoring.sequence_mean(current), scoring.baseline_fit(history))
    return scored.select("identity", "seq_no", F.round("score", 6).alias("score"))


@query("zscore", """
WITH m AS (SELECT user_id, avg(value) AS mean, stddev_pop(value) + 1e-6 AS std FROM events GROUP BY 1)
SELECT event_id AS n, round(least(abs(value - mean) / std / 3.0, 1.0), 6) AS score FROM events JOIN m USING (user_id)""")
def zscore(spark, sf):
    events = read_table(spark, sf, "events")
    stats = events.groupBy("user_id").agg(
        F.avg("value").alias("mean"), (F.stddev_pop("value") + 1e-6).alias("std"), F.count(F.lit(1)).alias("_n")
    )
    scored = scoring.zscore(F.col("value"), F.col("mean"), F.col("std"))
    return attach(events, stats, ["user_id"], "_n", ["event_id"]).select(F.col("event_id").alias("n"), F.round(scored, 6).alias("score"))


CLASS_SQL = f"""
WITH {SEQ}, x AS (SELECT identity, 'class-' || (user_id % 5) AS entity_class, v FROM (SELECT identity, unnest([f0, f1, f2]) AS v FROM hist)
   JOIN (SELECT DISTINCT identity, user_id FROM ev) USING (identity)),
s0 AS (SELECT identity, count(*) AS n, avg(v) AS mean, stddev_pop(v) + 1e-6 AS std FROM x GROUP BY 1),
s1 AS (SELECT entity_class, avg(v) AS mean, stddev_pop(v) + 1e-6 AS std FROM x GROUP BY 1),
s3 AS (SELECT avg(v) AS mean, stddev_pop(v) + 1e-6 AS std FROM x),
e AS (SELECT err.*, 'class-' || (user_id % 5) AS entity_class FROM err JOIN (SELECT DISTINCT identity, user_id FROM ev) USING (identity))
SELECT identity, CAST(seq_no AS BIGINT) AS seq_no, CASE WHEN s0.n >= 120 THEN 'entity' WHEN s1.mean IS NOT NULL THEN 'class' ELSE 'all' END AS used,
  round(least(abs(seq_mean - CASE WHEN s0.n >= 120 THEN s0.mean ELSE coalesce(s1.mean, s3.mean) END)
    / CASE WHEN s0.n >= 120 THEN s0.std ELSE coalesce(s1.std, s3.std) END / 3.0, 1.0), 6) AS score
FROM e LEFT JOIN s0 USING (identity) LEFT JOIN s1 USING (entity_class) CROSS JOIN s3"""


@query("class_baseline", CLASS_SQL)
def class_baseline(spark, sf):
    def with_class(rows):
        user = F.regexp_replace("identity", "^user-", "").cast("long")
        return rows.withColumn("entity_class", F.concat(F.lit("class-"), F.pmod(user, F.lit(5)).cast("string")))

    history, current = split(spark, sf)
    stats = scoring.class_baseline_fit(with_class(history))
    scored = scoring.class_baseline_score(with_class(scoring.sequence_mean(current)), stats, 120)
    return scored.select("identity", "seq_no", "used", F.round("score", 6).alias("score"))


@query("standard_scaler", """
SELECT event_id AS n, round((value - (SELECT avg(value) FROM events)) / (SELECT stddev_pop(value) FROM events), 6) AS z_value FROM events""")
def standard_scaler(spark, sf):
    rows = features.standard_scaler(read_table(spark, sf, "events").select(F.col("event_id").alias("n"), "value"), ["value"])
    return rows.select("n", F.round("z_value", 6).alias("z_value"))


@query("reconstruct_profile", f"WITH {SEQ} SELECT {SEQ_KEY}, t, round(e0, 6) AS e0, round(e1, 6) AS e1, round(e2, 6) AS e2 FROM rec")
def reconstruct_profile(spark, sf):
    history, current = split(spark, sf)
    _, profile = job.fit(history, WIDTH)
    rebuilt = scoring.reconstruct_profile(current, profile)
    return rebuilt.select("identity", "seq_no", "t", *[F.round(F.col("expected")[i], 6).alias(f"e{i}") for i in range(3)])


@query("reconstruction_mse", f"WITH {SEQ} SELECT {SEQ_KEY}, round(mse, 6) AS mse FROM scored")
def reconstruction_mse(spark, sf):
    return errors(spark, sf)[0].select("identity", "seq_no", F.round("mse", 6).alias("mse"))


@query("feature_error", f"WITH {SEQ} SELECT {SEQ_KEY}, feature, round(mse, 6) AS mse FROM ranked")
def feature_error(spark, sf):
    return scoring.feature_errors(errors(spark, sf)[0]).select("identity", "seq_no", "feature", F.round("mse", 6).alias("mse"))


@query("top_features_rank", f"WITH {SEQ} SELECT {SEQ_KEY}, feature, rank FROM ranked")
def top_features_rank(spark, sf):
    return scoring.feature_errors(errors(spark, sf)[0]).select("identity", "seq_no", "feature", "rank")


@query("top3_features", f"WITH {SEQ} SELECT {SEQ_KEY}, string_agg(feature, ',' ORDER BY rank) AS top FROM ranked WHERE rank <= 3 GROUP BY ALL")
def top3_features(spark, sf):
    lines = scoring.top_features(F.col("errors"))
    names = F.transform(lines, lambda x: F.regexp_extract(x, r"driven by (\S+)", 1))
    return errors(spark, sf)[0].select("identity", "seq_no", F.concat_ws(",", names).alias("top"))


@query("explain_top_features", f"""
WITH {SEQ} SELECT {SEQ_KEY}, CAST(rank AS INTEGER) AS rank, CASE feature WHEN 'Feature_0' THEN 'logon' WHEN 'Feature_1' THEN 'file' ELSE 'device' END AS feature, round(mse, 3) AS mse
FROM ranked WHERE rank <= 3""")
def explain_top_features(spark, sf):
    ranked = scoring.feature_errors(errors(spark, sf)[0]).filter(F.col("rank") <= 3)
    names = F.element_at(F.array(F.lit("logon"), F.lit("file"), F.lit("device")), F.regexp_extract("feature", r"(\d+)", 1).cast("int") + 1)
    return ranked.select("identity", "seq_no", "rank", names.alias("feature"), F.round("mse", 3).alias("mse"))


@query("explanation_text", f"WITH {EV} SELECT event_id, 'Anomaly driven by ' || event_type || ' (Error: ' || format('{{:.4f}}', k * 0.25) || ')' AS line FROM ev")
def explanation_text(spark, sf):
    return event_frame(spark, sf).select("event_id", feature_explanation(F.col("event_type"), F.col("k") * 0.25).alias("line"))


@query("route_by_length", f"WITH {SEQ} SELECT {SEQ_KEY}, length, CASE WHEN length < 10 THEN 'baseline' ELSE 'reconstruction' END AS route FROM err")
def route_by_length(spark, sf):
    _, current = split(spark, sf)
    return scoring.sequence_mean(current).select("identity", "seq_no", "length", scoring.route(F.col("length")).alias("route"))


@query("analyze_sequence", f"""
WITH {SEQ}, tops AS (SELECT identity, seq_no, string_agg(feature, ',' ORDER BY rank) AS top FROM ranked WHERE rank <= 3 GROUP BY ALL)
SELECT {SEQ_KEY}, length, CASE WHEN length < 10 THEN 'baseline' ELSE 'reconstruction' END AS route,
  round(CASE WHEN length < 10 THEN base ELSE mse END, 6) AS score,
  CASE WHEN length < 10 THEN 'Sequence too short. Used statistical fallback.' ELSE top END AS explanation
FROM scored JOIN tops USING (identity, seq_no)""")
def analyze_sequence(spark, sf):
    history, current = split(spark, sf)
    stats, profile = job.fit(history, WIDTH)
    found = job.score(current, stats, profile, WIDTH)
    short = F.transform("explanations", lambda x: F.regexp_replace(x, r"^Anomaly driven by (\S+) .*$", "$1"))
    return found.select("identity", "seq_no", "length", "route", F.round("score", 6).alias("score"), F.concat_ws(",", short).alias("explanation"))


@query("fit_score_job", f"WITH {SEQ} SELECT {SEQ_KEY}, round(CASE WHEN length < 10 THEN base ELSE mse END, 6) AS score FROM scored")
def fit_score_job(spark, sf):
    is_history = F.unix_micros("seq_start") < CUTOFF_US
    scores = job.fit_score_export(materialize(sequences(spark, sf), "sequences"), is_history, WIDTH, scratch_path(spark, "model"))
    return scores.select("identity", "seq_no", F.round("score", 6).alias("score"))


@query("model_state_export", f"""
WITH {SEQ} SELECT 'baseline' AS part, count(*) AS n, round(sum(mean), 4) AS total FROM stats
UNION ALL SELECT 'profile', count(*) + 1, round(sum(e0 + e1 + e2) + any_value(a0 + a1 + a2), 4) FROM prof CROSS JOIN allp""")
def model_state_export(spark, sf):
    path = scratch_path(spark, "state")
    stats, profile = job.fit(split(spark, sf)[0], WIDTH)
    write_table(stats, f"{path}/baseline")
    write_table(profile, f"{path}/profile")
    total = F.aggregate("expected", F.lit(0.0), lambda a, x: a + x)
    def back(part, value):
        return spark.read.parquet(f"{path}/{part}").agg(
            F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 4).alias("total")
        ).withColumn("part", F.lit(part))
    return back("baseline", F.col("mean")).unionByName(back("profile", total))


STEP_US = 1_705_276_800_000_000  # 2024-01-15, inside the history


def _fit_in_steps(spark, sf):
    """The history fitted in two steps, the second from the state of the first and the newer sequences only."""
    history = materialize(split(spark, sf)[0], "history")
    first, path = F.unix_micros("seq_start") < STEP_US, scratch_path(spark, "steps")
    job.fit_step(history.filter(first), WIDTH, f"{path}/1")
    return job.fit_step(history.filter(~first), WIDTH, f"{path}/2", previous=f"{path}/1")


@query("baseline_in_steps", f"WITH {SEQ} SELECT identity, round(mean, 6) AS mean, round(std, 6) AS std FROM stats")
def baseline_in_steps(spark, sf):
    stats, _ = _fit_in_steps(spark, sf)
    return stats.select("identity", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("score_in_steps", f"WITH {SEQ} SELECT {SEQ_KEY}, round(CASE WHEN length < 10 THEN base ELSE mse END, 6) AS score FROM scored")
def score_in_steps(spark, sf):
    scores = job.score(split(spark, sf)[1], *_fit_in_steps(spark, sf), WIDTH)
    return scores.select("identity", "seq_no", F.round("score", 6).alias("score"))


@query("reconstruct_pca")
def reconstruct_pca(spark, sf):
    vectors = read_table(spark, sf, "embeddings").select(
        "vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("vector")
    )
    mean, model = models.fit_linear_autoencoder(vectors.filter("label < 8"), "vector", 8)
    return models.reconstruct_linear(vectors, "vector", mean, model).select("vec_id", "label", F.round("mse", 6).alias("mse"))


@query("reconstruct_lstm")
def reconstruct_lstm(spark, sf):
    _, current = split(spark, sf)
    path = scratch_path(spark, "weights")
    write_table(models.weights_table(spark, models.random_weights(WIDTH, 16)), path)
    return models.recurrent_errors(current, spark.read.parquet(path)).select(
        "identity", "seq_no", "length", F.round("mse", 6).alias("mse")
    )


def classified(spark, sf):
    """All documents as command text, labelled or not, scored out of fold."""
    labels = read_table(spark, sf, "labels").groupBy("doc_id").agg(F.max("toxic").cast("double").alias("label"))
    rows = read_table(spark, sf, "documents").join(labels, "doc_id", "left")
    return models.cross_fitted(rows, "doc_id", "text", "label", F.coalesce(F.lower("text").rlike(RULE), F.lit(False)))


#: Fixed value: the static rule that the classifier is compared with.
RULE = r"\b(password|secret|token)\b"


@query("lotl_classifier")
def lotl_classifier(spark, sf):
    return classified(spark, sf).select("doc_id", "label", "fold", F.round("score", 4).alias("score"), "rule")


@query("lotl_comparison")
def lotl_comparison(spark, sf):
    """Precision, recall and F1 of the model and of the rule over all labelled documents."""
    rows = classified(spark, sf).filter(F.col("label").isNotNull())
    return evaluate.compare_detectors(rows, F.col("label") == 1, {"model": F.coalesce(F.col("score") >= 0.5, F.lit(False)), "rule": F.col("rule")})


@query("topk_similarity", """
WITH parts AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS c FROM embeddings, range(1, 65) t(i) GROUP BY 1, 2),
cent AS (SELECT label, list(c ORDER BY i) AS v FROM parts GROUP BY 1),
sim AS (SELECT vec_id, cent.label AS entry, list_cosine_similarity(CAST(embedding AS DOUBLE[]), v) AS s FROM embeddings CROSS JOIN cent)
SELECT vec_id, entry, round(s, 6) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, entry) AS rank FROM sim) WHERE rank <= 3""")
def topk_similarity(spark, sf):
    vectors = read_table(spark, sf, "embeddings")
    index = checkpoint(models.class_index(vectors, "label", "embedding", 64).withColumnRenamed("label", "entry_id"))
    hits = models.nearest_entries(vectors, "vec_id", "embedding", index, "entry_id", 3)
    return hits.select("vec_id", F.col("entry_id").alias("entry"), F.round("similarity", 6).alias("similarity"), "rank")


@query("topk_similarity_lists", """
WITH sim AS (SELECT q.vec_id, e.vec_id AS entry, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 9) AS s
  FROM embeddings q CROSS JOIN embeddings e WHERE q.vec_id % 20 = 0)
SELECT vec_id, entry, round(s, 6) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, entry) AS rank FROM sim) WHERE rank <= 5""")
def topk_similarity_lists(spark, sf):
    """Every vector is an entry of the index; those whose id 20 divides are the searches."""
    vectors = read_table(spark, sf, "embeddings")
    index = retrieval.build_lists(vectors, "vec_id", "embedding")
    hits = retrieval.nearest_in_lists(vectors.filter("vec_id % 20 = 0"), "vec_id", "embedding", index, 5, "entry")
    return hits.select("vec_id", "entry", F.round("similarity", 6).alias("similarity"), "rank")


LEXICON = {"password": 3.0, "secret": 2.5, "token": 2.0, "the": 0.25, "error": 1.5, "key": 2.0, "and": 0.5, "license": 1.0}


@query("lexicon_weight", """
WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}]+')) AS term FROM documents),
lex(term, weight) AS (VALUES ('password', 3.0), ('secret', 2.5), ('token', 2.0), ('the', 0.25), ('error', 1.5), ('key', 2.0), ('and', 0.5), ('license', 1.0))
SELECT d.doc_id, coalesce(s.signal, 0.0)::DOUBLE AS signal FROM documents d LEFT JOIN (SELECT doc_id, sum(weight) AS signal FROM w JOIN lex USING (term) GROUP BY 1) s USING (doc_id)""")
def lexicon_weight(spark, sf):
    lexicon = spark.createDataFrame(list(LEXICON.items()), "term string, weight double")
    return features.lexicon_weight(read_table(spark, sf, "documents"), "doc_id", F.col("text"), lexicon)


# Fixed values of the query: phrases and their weights; one is the start of another.
PHRASES = {"data": 0.25, "data set": 1.0, "of the": 0.5, "in the same": 1.0, "the": 0.25, "machine learning": 2.0}
PHRASE_SQL = " + ".join(
    f"CASE WHEN array_to_string(list_slice(w, i, i + {len(phrase.split()) - 1}), ' ') = '{phrase}' THEN {weight} ELSE 0 END" for phrase, weight in PHRASES.items()
)


@query("lexicon_phrases", f"""
WITH d AS (SELECT doc_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}]+', ' ', 'g')), ' ') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)
SELECT doc_id, CAST(sum({PHRASE_SQL}) AS DOUBLE) AS signal FROM p GROUP BY doc_id""")
def lexicon_phrases(spark, sf):
    lexicon = spark.createDataFrame(list(PHRASES.items()), "term string, weight double")
    return features.lexicon_weight(read_table(spark, sf, "documents"), "doc_id", F.col("text"), lexicon)


@query("unseen_category", f"""
WITH {EV} SELECT event_id, identity, k FROM ev WHERE us >= {CUTOFF_US} AND (identity, k) NOT IN
  (SELECT (identity, k) FROM ev WHERE us < {CUTOFF_US})""")
def unseen_category(spark, sf):
    ev = event_frame(spark, sf)
    is_history = F.unix_micros("ts") < CUTOFF_US
    return features.unseen_category(ev.filter(~is_history), ev.filter(is_history), ["identity", "k"]).select(
        "event_id", "identity", "k"
    )


# --- the chained run -----------------------------------------------------------------------

# Fixed values of the run: word weights and thresholds.
WORDS = {"error": 0.9, "purchase": 0.5, "get": 0.05}
CHAIN = SEQ.replace(EV, f"""
{TELE}, ev AS (SELECT event_id, ts_us AS us, identity, et AS event_type, action, 0 AS k FROM good WHERE identity IS NOT NULL)""")


@query("detection_pipeline", f"""
WITH {CHAIN}, sc AS (SELECT identity, seq_no, round(CASE WHEN length < 10 THEN base ELSE mse END, 6) AS s FROM scored),
st AS (SELECT seq.identity, step_us, s FROM seq LEFT JOIN sc USING (identity, seq_no)),
al AS (SELECT event_id, ev.identity, us, coalesce(s, 0.0) AS s_n, least(
    CASE WHEN contains(lower(action), 'error') THEN 0.9 ELSE 0 END + CASE WHEN contains(lower(action), 'purchase') THEN 0.5 ELSE 0 END
    + CASE WHEN contains(lower(action), 'get') THEN 0.05 ELSE 0 END, 1.0)::DOUBLE AS s_l
  FROM ev LEFT JOIN st ON ev.identity = st.identity AND us // {HOUR}000000 * {HOUR}000000 = step_us),
fl AS (SELECT *, s_l >= 0.7 AS is_a, s_n >= 0.5 AS is_b FROM al),
near AS (SELECT DISTINCT x.event_id FROM fl x JOIN fl y ON x.identity = y.identity AND abs(x.us - y.us) <= 3600000000
  AND ((x.is_a AND y.is_b) OR (x.is_b AND y.is_a))),
co AS (SELECT fl.*, near.event_id IS NOT NULL AS correlated FROM fl LEFT JOIN near USING (event_id)),
fu AS (SELECT *, CASE WHEN correlated THEN least((0.5 * s_l + 0.5 * s_n) * 1.5, 1.0) ELSE 0.5 * s_l + 0.5 * s_n END AS fused FROM co),
de AS (SELECT *, CASE WHEN abs(s_l - s_n) > 0.6 THEN 'ESCALATE' WHEN correlated AND fused >= 0.75 THEN 'HARD_CONTAINMENT'
  WHEN fused >= 0.75 THEN 'SOFT_QUARANTINE' WHEN fused >= 0.45 THEN 'ESCALATE' ELSE 'DISMISS' END AS decision FROM fu)
SELECT event_id, round(s_l, 4) AS s_l, round(s_n, 4) AS s_n, correlated, decision, CASE decision WHEN 'HARD_CONTAINMENT' THEN 'revoke_credentials'
  WHEN 'SOFT_QUARANTINE' THEN 'restrict_session' WHEN 'ESCALATE' THEN 'notify_analyst' END AS action_taken FROM de""")
def detection_pipeline(spark, sf):
    # Lines are parsed and normalised; thresholds are read from a written table, as tuning leaves them.
    events = normalize_lines(telemetry_raw(spark, sf)).select("event_id", "ts", "identity", "event_type", "action")
    kind = F.col("event_type")
    classes = {
        "logon": kind.isin("signup", "view"), "file": kind.isin("click", "purchase"), "device": kind == "error",
    }
    path = scratch_path(spark, "thresholds")
    config = "0.75D theta_contain, 0.45D theta_escalate, 0.6D theta_disagree, 1.5D boost_factor, 3600D delta_t, 0.5D w_lotllm, 0.5D w_nhi"
    write_table(spark.sql(f"SELECT {config}"), path)
    lexicon = spark.createDataFrame(list(WORDS.items()), "term string, weight double")
    found = detection_run(
        events, classes, F.lit(False), lexicon, spark.read.parquet(path), F.unix_micros("seq_start") < CUTOFF_US, HOUR, DAY, 0.7, 0.5, 3600
    )
    return found.select("event_id", F.round("s_l", 4).alias("s_l"), F.round("s_n", 4).alias("s_n"), "correlated", "decision", "action_taken")
