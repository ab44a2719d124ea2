"""Anomaly scores: statistical baseline, reconstruction error, explanations."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchloom.functions.text import SHORT_SEQUENCE_TEXT, feature_explanation, feature_name
from watchloom.operators.access import small
from watchloom.schemas import MIN_SEQUENCE_LENGTH, STD_FLOOR, Z_THRESHOLD


def _elements(seqs: DataFrame, *keys: str) -> DataFrame:
    return seqs.select(*keys, F.explode("features").alias("x"))


def baseline_fit(history: DataFrame, entity: str = "identity") -> DataFrame:
    """Mean and deviation of each entity over all elements of its history."""
    return _elements(history, entity).groupBy(entity).agg(
        F.avg("x").alias("mean"), (F.stddev_pop("x") + STD_FLOOR).alias("std")
    )


# --- state that grows by days -------------------------------------------------------------


def moments(history: DataFrame, entity: str = "identity") -> DataFrame:
    """Count, mean and squared deviation of each entity's elements: what a baseline needs, and what can be merged.

    Null and NaN elements are left out; an entity without elements has no row.
    """
    kept = _elements(history, entity).filter(F.col("x").isNotNull() & ~F.isnan("x"))
    return kept.groupBy(entity).agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), (F.var_pop("x") * F.count(F.lit(1))).alias("m2")
    )


def merge_moments(*parts: DataFrame, entity: str = "identity") -> DataFrame:
    """The moments of all rows behind ``parts``, in any order and grouping; a merge gathers one value a part.

    Deviations are merged around the means, not from sums of squares, so large values lose no digits.
    """
    rows = functools.reduce(DataFrame.unionByName, [p.select(entity, "n", "mean", "m2") for p in parts])

    def both(a: Column, b: Column) -> Column:
        n, apart = a["n"] + b["n"], b["mean"] - a["mean"]
        share = b["n"].cast("double") / n
        return F.struct(n.alias("n"), (a["mean"] + apart * share).alias("mean"), (a["m2"] + b["m2"] + apart * apart * a["n"] * share).alias("m2"))

    values = F.array_sort(F.collect_list(F.struct("n", "mean", "m2")))
    merged = F.aggregate(F.slice(values, 2, len(parts)), values[0], both)
    return rows.groupBy(entity).agg(merged.alias("all")).select(entity, "all.*")


def baseline_of(state: DataFrame, entity: str = "identity") -> DataFrame:
    """Mean and deviation from moments, as ``baseline_fit`` gives them from the rows."""
    return state.select(entity, "mean", (F.sqrt(F.col("m2") / F.col("n")) + STD_FLOOR).alias("std"))


def profile_sums(benign: DataFrame, width: int) -> DataFrame:
    """Per position the number of benign steps and, per feature, how many values it has and their mean; it can be merged."""
    cell = lambda i: F.struct(F.count(F.col("features")[i]).alias("n"), F.avg(F.col("features")[i]).alias("mean"))
    return benign.groupBy("t").agg(F.array(*[cell(i) for i in range(width)]).alias("cells"))


def merge_profiles(*parts: DataFrame, width: int) -> DataFrame:
    rows = functools.reduce(DataFrame.unionByName, [p.select("t", "cells") for p in parts])
    return rows.groupBy("t").agg(_mean_cells(width).alias("cells"))


def _mean_cells(width: int) -> Column:
    def cell(i: int) -> Column:
        n, mean = F.col("cells")[i]["n"], F.col("cells")[i]["mean"]
        return F.struct(F.sum(n).alias("n"), F.try_divide(F.sum(n * mean), F.sum(n)).alias("mean"))

    return F.array(*[cell(i) for i in range(width)])


def profile_of(state: DataFrame, width: int) -> DataFrame:
    """The profile as ``profile_fit`` gives it: one row a position, and the mean over all of them as position 0."""
    means = F.transform("cells", lambda c: c["mean"]).alias("expected")
    whole = state.agg(_mean_cells(width).alias("cells")).select(F.lit(0).alias("t"), means)
    return state.select("t", means).unionByName(whole)


def class_baseline_fit(history: DataFrame, entity: str = "identity", entity_class: str = "entity_class") -> DataFrame:
    """The same statistics per entity, per class and overall, from one rollup.

    ``level`` is 0 for an entity, 1 for a class, 3 for all.
    """
    return _elements(history, entity_class, entity).rollup(entity_class, entity).agg(
        F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"),
        F.avg("x").alias("mean"), (F.stddev_pop("x") + STD_FLOOR).alias("std"),
    )


def sequence_mean(seqs: DataFrame, entity: str = "identity") -> DataFrame:
    """Length and mean over all elements of each sequence."""
    total = F.aggregate("features", F.lit(0.0), lambda a, x: a + x)
    return seqs.groupBy(entity, "seq_no").agg(
        F.count(F.lit(1)).alias("length"), (F.sum(total) / F.sum(F.size("features"))).alias("seq_mean")
    )


def zscore(value: Column, mean: Column, std: Column, threshold: float = Z_THRESHOLD) -> Column:
    """Distance from the mean in units of ``threshold`` deviations, at most 1; NULL for no value."""
    score = F.abs(value - mean) / std / threshold
    return F.when(value.isNull() | F.isnan(value), None).otherwise(F.least(score, F.lit(1.0)))


def baseline_score(means: DataFrame, stats: DataFrame, entity: str = "identity") -> DataFrame:
    """Score against the entity's baseline; an entity without one gets 1."""
    joined = means.join(stats, entity, "left")
    scored = zscore(F.col("seq_mean"), F.col("mean"), F.col("std"))
    return joined.withColumn("score", F.when(F.col("mean").isNull(), 1.0).otherwise(scored)).drop("mean", "std")


def class_baseline_score(
    means: DataFrame, stats: DataFrame, min_history: int, entity: str = "identity", entity_class: str = "entity_class"
) -> DataFrame:
    """Score against the entity where its history is long enough, else its class, else all."""
    own = stats.filter((F.col("level") == 0) & (F.col("n") >= min_history)).select(
        entity, F.col("mean").alias("_m0"), F.col("std").alias("_s0")
    )
    by_class = stats.filter("level = 1").select(
        entity_class, F.col("mean").alias("_m1"), F.col("std").alias("_s1")
    )
    whole = stats.filter("level = 3")
    joined = means.join(own, entity, "left").join(small(by_class), entity_class, "left")
    mean = F.coalesce("_m0", "_m1", whole.select("mean").scalar())
    std = F.coalesce("_s0", "_s1", whole.select("std").scalar())
    used = F.when(F.col("_m0").isNotNull(), "entity").when(F.col("_m1").isNotNull(), "class").otherwise("all")
    return joined.select(
        *means.columns, used.alias("used"), zscore(F.col("seq_mean"), mean, std).alias("score")
    )


def profile_fit(benign: DataFrame, width: int) -> DataFrame:
    """Mean of each feature at each position of benign sequences.

    One row per position, so at most the longest sequence's steps; position 0 holds the mean
    over all positions, for positions no benign sequence reached.
    """
    means = F.array(*[F.avg(F.col("features")[i]) for i in range(width)])
    at = benign.groupBy("t").agg(means.alias("expected"))
    return at.unionByName(benign.agg(F.lit(0).alias("t"), means.alias("expected")))


def reconstruct_profile(seqs: DataFrame, profile: DataFrame) -> DataFrame:
    """Rows with ``expected``, the profile at their position."""
    overall = profile.filter("t = 0").select("expected").scalar()
    at = small(profile.filter("t > 0"))
    return seqs.join(at, "t", "left").withColumn("expected", F.coalesce("expected", overall))


def sequence_errors(reconstructed: DataFrame, width: int, entity: str = "identity") -> DataFrame:
    """Per sequence: length, mean, error per feature, and error over all elements (at most 1)."""
    squared = [F.pow(F.col("features")[i] - F.col("expected")[i], 2) for i in range(width)]
    total = F.aggregate("features", F.lit(0.0), lambda a, x: a + x)
    grouped = reconstructed.groupBy(entity, "seq_no").agg(
        F.count(F.lit(1)).alias("length"), (F.sum(total) / F.sum(F.size("features"))).alias("seq_mean"),
        F.array(*[F.avg(s) for s in squared]).alias("errors"),
    )
    mse = F.aggregate("errors", F.lit(0.0), lambda a, x: a + x) / width
    return grouped.withColumn("mse", F.least(mse, F.lit(1.0)))


def feature_errors(errors: DataFrame, entity: str = "identity") -> DataFrame:
    """Long form: one row per sequence and feature, ranked by error, ties by position."""
    items = F.transform("errors", lambda e, i: F.struct((-e).alias("neg"), i.alias("i")))
    ranked = errors.select(entity, "seq_no", F.posexplode(F.array_sort(items)).alias("place", "item"))
    return ranked.select(
        entity, "seq_no", feature_name(F.col("item.i")).alias("feature"),
        (-F.col("item.neg")).alias("mse"), (F.col("place") + 1).alias("rank"),
    )


def top_features(errors: Column, names: list[str] | None = None, k: int = 3) -> Column:
    """The ``k`` features with the largest error as explanation lines, largest first."""
    def label(i: Column) -> Column:
        return F.element_at(F.array(*[F.lit(n) for n in names]), i + 1) if names else feature_name(i)

    items = F.array_sort(F.transform(errors, lambda e, i: F.struct((-e).alias("neg"), i.alias("i"))))
    return F.transform(F.slice(items, 1, k), lambda x: feature_explanation(label(x["i"]), -x["neg"]))


def route(length: Column, min_length: int = MIN_SEQUENCE_LENGTH) -> Column:
    """Short sequences go to the baseline, others to reconstruction."""
    return F.when(length < min_length, "baseline").otherwise("reconstruction")


def analyze_sequences(
    errors: DataFrame, stats: DataFrame, min_length: int = MIN_SEQUENCE_LENGTH, entity: str = "identity",
    names: list[str] | None = None,
) -> DataFrame:
    """Score and explanations of each sequence, both routes in one pass."""
    scored = baseline_score(errors, stats, entity).withColumn("route", route(F.col("length"), min_length))
    by_baseline = F.col("route") == "baseline"
    return scored.select(
        entity, "seq_no", "length", "route",
        F.when(by_baseline, F.col("score")).otherwise(F.col("mse")).alias("score"),
        F.when(by_baseline, F.array(F.lit(SHORT_SEQUENCE_TEXT)))
        .otherwise(top_features(F.col("errors"), names)).alias("explanations"),
    )
