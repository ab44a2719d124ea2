"""The detection job: features, fit, score, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchloom.operators import features, scoring
from watchloom.session import checkpoint
from watchloom.sources.sinks import write_table


def build_sequences(
    events: DataFrame, step_seconds: int, gap_seconds: int, classes: dict[str, Column],
    adversarial: Column,
) -> DataFrame:
    steps = features.activity_features(events, step_seconds, classes, {"adversarial": adversarial})
    return features.sequences(steps, gap_seconds)


def fit(history: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Baseline statistics of all history and the position profile of its benign part.

    The profile has one row per position and is fixed by a checkpoint, as its size is checked
    before it is broadcast.
    """
    stats = scoring.baseline_fit(history)
    profile = checkpoint(scoring.profile_fit(features.benign_only(history, "adversarial"), width))
    return stats, profile


def fit_step(new: DataFrame, width: int, out_dir: str, previous: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Fit on ``new`` sequences and all that the state at ``previous`` stands for, without reading those again.

    The state (moments of each entity, sums of each position) is written to ``out_dir``, a folder of its own for each
    step: a step that is run again reads the same ``previous`` and writes the same state. Returns what ``fit`` returns.
    """
    spark = new.sparkSession
    parts = {"moments": scoring.moments(new), "profile": scoring.profile_sums(features.benign_only(new, "adversarial"), width)}
    if previous:
        old = {name: spark.read.parquet(f"{previous}/{name}") for name in parts}
        parts = {
            "moments": scoring.merge_moments(old["moments"], parts["moments"]),
            "profile": scoring.merge_profiles(old["profile"], parts["profile"], width=width),
        }
    for name, part in parts.items():
        write_table(part, f"{out_dir}/{name}")
    state = {name: spark.read.parquet(f"{out_dir}/{name}") for name in parts}
    return scoring.baseline_of(state["moments"]), checkpoint(scoring.profile_of(state["profile"], width))


def score(current: DataFrame, stats: DataFrame, profile: DataFrame, width: int) -> DataFrame:
    errors = scoring.sequence_errors(scoring.reconstruct_profile(current, profile), width)
    return scoring.analyze_sequences(errors, stats)


def fit_score_export(seqs: DataFrame, is_history: Column, width: int, out_dir: str) -> DataFrame:
    """Fit on history, write the model tables, read them back and score the rest."""
    stats, profile = fit(seqs.filter(is_history), width)
    write_table(stats, f"{out_dir}/baseline")
    write_table(profile, f"{out_dir}/profile")
    spark = seqs.sparkSession
    stats, profile = spark.read.parquet(f"{out_dir}/baseline"), spark.read.parquet(f"{out_dir}/profile")
    scores = score(seqs.filter(~is_history), stats, profile, width)
    write_table(scores, f"{out_dir}/scores")
    return spark.read.parquet(f"{out_dir}/scores")
