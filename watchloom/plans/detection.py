"""One detection run: events -> sequences and scores, text signal, correlation, decision, action."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchloom.functions import times
from watchloom.operators import decide, features
from watchloom.plans import scoring as job
from watchloom.session import materialize


def detection_run(
    events: DataFrame, classes: dict[str, Column], adversarial: Column, lexicon: DataFrame, config: DataFrame, fit_before: Column,
    step_seconds: int, gap_seconds: int, alert_static: float, alert_dynamic: float, delta_seconds: int,
) -> DataFrame:
    """Events of named identities with both scores, ``correlated``, ``decision`` and ``action``.

    The dynamic score is that of the sequence the event belongs to, fitted on the sequences for which
    ``fit_before`` holds; events of those have 0. The static score is the lexicon weight of the action's text,
    at most 1. Thresholds and weights come from the one-row table ``config`` when the run starts.
    """
    events = materialize(events.filter(F.col("identity").isNotNull()), "events")
    seqs = materialize(job.build_sequences(events, step_seconds, gap_seconds, classes, adversarial), "sequences")
    width = len(classes)
    stats, profile = job.fit(seqs.filter(fit_before), width)
    scores = job.score(seqs.filter(~fit_before), stats, profile, width).select("identity", "seq_no", F.round("score", 6).alias("s_n"))
    steps = seqs.select("identity", "step_start", "seq_no").join(scores, ["identity", "seq_no"], "left").drop("seq_no")
    texts = events.select("action").distinct()  # each text is weighed once
    signals = features.lexicon_weight(texts, "action", F.col("action"), lexicon).select("action", F.least("signal", F.lit(1.0)).alias("s_l"))
    scored = (
        events.withColumn("step_start", times.window_floor(F.col("ts"), step_seconds)).join(steps, ["identity", "step_start"], "left")
        .join(signals, "action", "left").withColumns({s: F.coalesce(s, F.lit(0.0)) for s in ("s_l", "s_n")})
    )
    near = decide.temporal_correlation(
        materialize(scored, "scored"), "identity", F.col("s_l") >= alert_static, F.col("s_n") >= alert_dynamic, delta_seconds
    )
    decided = decide.decide(near, config, "s_l", "s_n")
    return decided.withColumn("action_taken", decide.planned_action(F.col("decision")))
