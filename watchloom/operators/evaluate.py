"""Evaluation: summaries, confusion metrics, threshold and weight sweeps, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchloom.operators.skew import running_totals
from watchloom.schemas import SOURCES


def ratio(numerator: Column, denominator: Column) -> Column:
    """0 where the denominator is 0."""
    return F.when(denominator == 0, 0.0).otherwise(numerator / denominator)


def _metrics(tp: Column, fp: Column, fn: Column, tn: Column | None = None) -> dict[str, Column]:
    measures = {
        "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn),
    }
    if tn is not None:
        measures["fpr"] = ratio(fp, fp + tn)
    return measures


def dataset_summary(events: DataFrame, dims: list[str]) -> DataFrame:
    """Counts for every combination of the dimensions, with subtotals (``all``)."""
    grouped = events.cube(*dims).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_gid"))
    last = len(dims) - 1
    return grouped.select(
        *[F.when(F.col("_gid").bitwiseAND(1 << (last - i)) != 0, "all").otherwise(F.coalesce(d, F.lit("none"))).alias(d)
          for i, d in enumerate(dims)],
        "n",
    )


def confusion_metrics(rows: DataFrame, truth: Column, verdict: Column, by: list[str]) -> DataFrame:
    """Counts and precision, recall, F1, false-positive rate per group."""
    counted = rows.groupBy(*by).agg(
        F.count_if(truth & verdict).alias("tp"), F.count_if(~truth & verdict).alias("fp"),
        F.count_if(truth & ~verdict).alias("fn"), F.count_if(~truth & ~verdict).alias("tn"),
    )
    return with_metrics(counted)


def with_metrics(counted: DataFrame) -> DataFrame:
    return counted.withColumns(_metrics(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")))


def compare_detectors(rows: DataFrame, truth: Column, verdicts: dict[str, Column]) -> DataFrame:
    """The same metrics for several detectors side by side, one pass over the rows."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("detector"), v.alias("hit")) for n, v in verdicts.items()]))
    long = rows.select(truth.alias("_truth"), each.alias("_d"))
    return confusion_metrics(
        long.select("_truth", "_d.*"), F.col("_truth"), F.col("hit"), ["detector"]
    )


def cumulative_counts(rows: DataFrame, score: str, truth: Column) -> DataFrame:
    """True and false positives when all scores from here up are alerts.

    Rows of one score are combined first; the running totals go over score pieces, highest
    score first, so neither a repeated score nor many scores end up in one task.
    """
    per_score = rows.groupBy(score).agg(
        F.count_if(truth).alias("pos"), F.count_if(~truth).alias("neg")
    ).withColumn("_order", -F.col(score).cast("double"))
    return running_totals(per_score, [], "_order", [], ["pos", "neg"]).select(
        score, F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp")
    )


def threshold_sweep(rows: DataFrame, score: str, truth: Column) -> DataFrame:
    """Precision, recall and F1 at every distinct score taken as threshold."""
    positives = rows.agg(F.count_if(truth)).scalar()
    curve = cumulative_counts(rows, score, truth)
    return curve.withColumns(_metrics(F.col("tp"), F.col("fp"), positives - F.col("tp")))


def best_threshold(curve: DataFrame, score: str) -> DataFrame:
    """Operating point: largest F1, the higher threshold among equals."""
    best = F.max_by(F.struct(score, "precision", "recall", "f1"), F.struct("f1", score))
    return curve.agg(best.alias("b")).select("b.*")


def latency_distribution(rows: DataFrame, latency: str, by: list[str], shares: list[float]) -> DataFrame:
    """Exact interpolated percentiles per group.

    Equal latencies are combined, running counts give each value its rank range, and a
    percentile is read off the two values around its rank: the group is never sorted whole.
    """
    values = rows.groupBy(*by, latency).agg(F.count(F.lit(1)).alias("n"))
    ranked = running_totals(values, by, latency, [], ["n"])
    totals = ranked.groupBy(*by).agg(F.max("cum_n").alias("_total"))
    low, high = F.col("cum_n") - F.col("n"), F.col("cum_n") - 1
    joined = ranked.join(F.broadcast(totals), by)
    picks = []
    for i, share in enumerate(shares):
        place = F.lit(share) * (F.col("_total") - 1)
        for side, at in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            picks.append(F.max(F.when((at >= low) & (at <= high), F.col(latency))).alias(f"_{side}{i}"))
    grouped = joined.groupBy(*by).agg(F.max("_total").alias("n"), *picks)
    result = []
    for i, share in enumerate(shares):
        place = F.lit(share) * (F.col("n") - 1)
        part = place - F.floor(place)
        value = F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * part
        result.append(value.alias(f"p{int(round(share * 100))}"))
    return grouped.select(*by, "n", *result)


def source_coverage(events: DataFrame, source: str = "ingest_source") -> DataFrame:
    """Event count of every known source; a source without events is flagged."""
    spark = events.sparkSession
    known = spark.createDataFrame([(s,) for s in SOURCES], f"{source} string")
    counted = events.groupBy(source).agg(F.count(F.lit(1)).alias("_n"))
    return known.join(counted, source, "left").select(
        source, F.coalesce("_n", F.lit(0)).alias("n"), F.col("_n").isNull().alias("missing")
    )


def weight_grid_sweep(rows: DataFrame, static: str, dynamic: str, truth: Column, grid: list[tuple[float, float]]) -> DataFrame:
    """Metrics of ``w * static + (1 - w) * dynamic >= theta`` for each ``(w, theta)`` of a fixed grid.

    All grid points are counted in one aggregation, so each row is read once and only counts are shuffled.
    """
    counts, points = [], []
    for i, (w, theta) in enumerate(grid):
        hit = F.round(F.lit(w) * F.col(static) + (1 - F.lit(w)) * F.col(dynamic), 6) >= F.lit(theta)
        for name, test in (("tp", truth & hit), ("fp", ~truth & hit), ("fn", truth & ~hit), ("tn", ~truth & ~hit)):
            counts.append(F.count_if(test).alias(f"_{name}{i}"))
        points.append(F.struct(F.lit(w).alias("w"), F.lit(theta).alias("theta"), *(F.col(f"_{n}{i}").alias(n) for n in ("tp", "fp", "fn", "tn"))))
    return with_metrics(rows.agg(*counts).select(F.inline(F.array(*points))))


def best_setting(swept: DataFrame) -> DataFrame:
    best = F.max_by(F.struct("w", "theta", "f1"), F.struct("f1", "w", "theta"))
    return swept.agg(best.alias("b")).select("b.*")


def group_split(rows: DataFrame, run_number: Column, train: int = 70, validation: int = 15) -> DataFrame:
    """Split by scenario run: all events of a run share one split."""
    bucket = F.pmod(run_number * 37, F.lit(100))
    return rows.withColumn(
        "split", F.when(bucket < train, "train").when(bucket < train + validation, "val").otherwise("test")
    )


def imbalance_sample(rows: DataFrame, is_attack: Column, number: Column, keep_percent: int) -> DataFrame:
    """Keep all benign rows and a repeatable share of the attacks."""
    bucket = F.pmod(number * 31, F.lit(100))
    return rows.filter(~is_attack | (bucket < keep_percent))
