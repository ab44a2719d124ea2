"""Correlating two detectors, fusing their scores, deciding, planning the response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchloom.functions import times
from watchloom.operators.skew import HOT_ROWS, attach

# Names of the decision thresholds.
THRESHOLDS = (
    "theta_contain", "theta_escalate", "theta_disagree", "boost_factor", "delta_t", "w_lotllm", "w_nhi",
)


def temporal_correlation(
    rows: DataFrame, key: str, a: Column, b: Column, delta_seconds: int, row_id: str = "event_id",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Rows with ``a``/``b`` alert flags and whether the other kind is near, in either order.

    ``partner_before``/``partner_after`` tell of an alert of the other kind on the same key at
    most ``delta_seconds`` away. Time is cut into slots of that length; per slot the first and
    last alert of each kind decide, so no pairs are formed: inside a row's own slot every
    partner is near enough, and from a neighbouring slot only its nearest end matters.
    """
    flags = ("is_a", "is_b", "partner_before", "partner_after", "correlated")
    flagged = rows.withColumns({"is_a": a, "is_b": b})
    # Only alerts that name a key can correlate; all other rows keep their flags and shuffle nowhere.
    can = F.col(key).isNotNull() & (F.coalesce("is_a", F.lit(False)) | F.coalesce("is_b", F.lit(False)))
    alerts = flagged.filter(can).withColumn("_slot", times.slot(F.col("ts"), delta_seconds))
    slots = alerts.groupBy(key, "_slot").agg(
        F.count(F.lit(1)).alias("_n"),
        *[f(F.when(F.col(f"is_{k}"), F.unix_micros("ts"))).alias(f"_{name}_{k}")
          for k in "ab" for f, name in ((F.min, "min"), (F.max, "max"))],
    )
    in_time = Window.partitionBy(key).orderBy("_slot")
    beside = {}
    for k in "ab":
        is_next = F.lead("_slot").over(in_time) == F.col("_slot") + 1
        is_prev = F.lag("_slot").over(in_time) == F.col("_slot") - 1
        beside[f"_next_{k}"] = F.when(is_next, F.lead(f"_min_{k}").over(in_time))
        beside[f"_prev_{k}"] = F.when(is_prev, F.lag(f"_max_{k}").over(in_time))
    near = attach(alerts, slots.withColumns(beside), [key, "_slot"], "_n", [row_id], hot_rows)
    now, reach = F.unix_micros("ts"), delta_seconds * 1_000_000

    def holds(test: Column) -> Column:
        return F.coalesce(test, F.lit(False))

    def before(k: str) -> Column:
        return holds(F.col(f"_min_{k}") <= now) | holds(F.col(f"_prev_{k}") >= now - reach)

    def after(k: str) -> Column:
        return holds(F.col(f"_max_{k}") >= now) | holds(F.col(f"_next_{k}") <= now + reach)

    is_a, is_b = holds(F.col("is_a")), holds(F.col("is_b"))
    found = near.withColumns(
        {
            "partner_before": (is_a & before("b")) | (is_b & before("a")),
            "partner_after": (is_a & after("b")) | (is_b & after("a")),
        }
    ).withColumn("correlated", F.col("partner_before") | F.col("partner_after"))
    others = flagged.filter(~can).withColumns({f: F.lit(False) for f in flags[2:]})
    return found.select(*rows.columns, *flags).unionByName(others.select(*rows.columns, *flags))


def with_thresholds(rows: DataFrame, config: DataFrame) -> DataFrame:
    """Current thresholds as columns, read from a one-row table when the query runs."""
    return rows.withColumns({name: config.select(name).scalar() for name in THRESHOLDS if name in config.columns})


def fusion_score(static: Column, dynamic: Column, w_static: Column, w_dynamic: Column) -> Column:
    """Weighted sum of the two scores."""
    return w_static * static + w_dynamic * dynamic


def boosted(fused: Column, correlated: Column, boost: Column) -> Column:
    """Correlated alerts weigh more; the score stays at most 1."""
    return F.when(correlated, F.least(fused * boost, F.lit(1.0))).otherwise(fused)


def disagreement(static: Column, dynamic: Column, theta: Column) -> Column:
    return F.abs(static - dynamic) > theta


def decision(fused: Column, disagree: Column, correlated: Column, theta_contain: Column, theta_escalate: Column) -> Column:
    """Disagreement first, then containment gated by correlation, then escalation, else dismissal."""
    return (
        F.when(disagree, "ESCALATE")
        .when(correlated & (fused >= theta_contain), "HARD_CONTAINMENT")
        .when(fused >= theta_contain, "SOFT_QUARANTINE")
        .when(fused >= theta_escalate, "ESCALATE")
        .otherwise("DISMISS")
    )


def decide(rows: DataFrame, config: DataFrame, static: str, dynamic: str) -> DataFrame:
    """Fused score and decision for rows that carry both scores and ``correlated``."""
    ready = with_thresholds(rows, config)
    fused = fusion_score(F.col(static), F.col(dynamic), F.col("w_lotllm"), F.col("w_nhi"))
    ready = ready.withColumn("fused", boosted(fused, F.col("correlated"), F.col("boost_factor")))
    disagree = disagreement(F.col(static), F.col(dynamic), F.col("theta_disagree"))
    verdict = decision(F.col("fused"), disagree, F.col("correlated"), F.col("theta_contain"), F.col("theta_escalate"))
    return ready.withColumn("decision", verdict).drop(*THRESHOLDS)


def sandbox_trigger(rows: DataFrame, static: str, dynamic: str, t_static: Column, t_dynamic: Column) -> DataFrame:
    """Rows where either score reaches its threshold."""
    return rows.filter((F.col(static) >= t_static) | (F.col(dynamic) >= t_dynamic))


def planned_action(decision: Column) -> Column:
    """The action a decision asks for; NULL for none."""
    return F.when(decision == "HARD_CONTAINMENT", "revoke_credentials").when(
        decision == "SOFT_QUARANTINE", "restrict_session"
    ).when(decision == "ESCALATE", "notify_analyst")


def response_plan(decisions: DataFrame, identity: str = "identity") -> DataFrame:
    """One planned action per decision that asks for one; rows for a log, nothing is executed."""
    action = planned_action(F.col("decision"))
    return decisions.withColumn("action", action).filter(F.col("action").isNotNull()).select(
        "event_id", identity, "decision", "action"
    )
