"""Access decisions and model-call telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchloom.functions.times import elapsed_ms
from watchloom.operators.skew import positions

# Rows up to which a registry is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 1_000_000

# Fixed value: refusal of a call that names no caller.
MISSING_CALLER = "X-Service-Identity header is required"


def small(dimension: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a side whose counted size allows it; otherwise the join shuffles."""
    return F.broadcast(dimension) if dimension.count() <= rows else dimension


def require_caller(calls: DataFrame, identity: str = "identity") -> DataFrame:
    """Calls with ``reject_reason``, NULL when a caller is named."""
    missing = F.col(identity).isNull() | (F.col(identity) == "")
    return calls.withColumn("reject_reason", F.when(missing, MISSING_CALLER))


def known_identity(calls: DataFrame, identities: DataFrame) -> DataFrame:
    """``success`` = the caller is registered. ``identities`` has one row per identity."""
    known = small(identities.select("identity").withColumn("_known", F.lit(True)))
    joined = calls.join(known, "identity", "left")
    return joined.withColumn("success", F.coalesce("_known", F.lit(False))).drop("_known")


def secret_access(calls: DataFrame, identities: DataFrame, secrets: DataFrame, path: str = "secret_path") -> DataFrame:
    """``success`` = the caller is registered and the secret exists."""
    checked = known_identity(calls, identities)
    paths = small(secrets.select(F.col("path").alias(path)).withColumn("_found", F.lit(True)))
    joined = checked.join(paths, path, "left")
    return joined.withColumn("success", F.col("success") & F.coalesce("_found", F.lit(False))).drop("_found")


def role_token(calls: DataFrame, identities: DataFrame) -> DataFrame:
    """Token and role of registered callers."""
    return calls.join(small(identities.select("identity", "token", "role")), "identity")


def secret_value(calls: DataFrame, secrets: DataFrame, path: str = "secret_path") -> DataFrame:
    """``value`` of the asked secret for calls that succeed; NULL for all others."""
    values = small(secrets.select(F.col("path").alias(path), F.col("value").alias("_value")))
    joined = calls.join(values, path, "left")
    return joined.withColumn("value", F.when(F.col("success"), F.col("_value"))).drop("_value")


def call_latency(messages: DataFrame, call_id: str, is_request: Column) -> DataFrame:
    """Request and response of each call -> latency in ms, two places; one pass, no self-join."""
    return messages.groupBy(call_id).agg(
        F.min(F.when(is_request, F.col("ts"))).alias("started"),
        F.max(F.when(~is_request, F.col("ts"))).alias("answered"),
    ).select(call_id, elapsed_ms(F.col("started"), F.col("answered")).alias("latency_ms"))


def response_text(body: Column) -> Column:
    """``.response`` of an object body, a plain JSON value as text, else the raw text."""
    parsed = F.try_parse_json(body)
    is_object = F.startswith(F.ltrim(body), F.lit("{"))
    return (
        F.when(parsed.isNull(), body)
        .when(is_object, F.try_variant_get(parsed, "$.response", "string"))
        .otherwise(F.try_variant_get(parsed, "$", "string"))
    )


def generate_telemetry(calls: DataFrame) -> DataFrame:
    """Request and response columns of a completion call -> telemetry payload columns."""
    return calls.select(
        "identity", "model", "prompt", response_text(F.col("response_body")).alias("response"),
        "latency_ms", "source_ip",
    )


def chat_telemetry(turns: DataFrame, chat_id: str, turn: str, calls: DataFrame | None = None) -> DataFrame:
    """The messages of each chat call in turn order, and what the call carries.

    One row a message: ``position``, ``role``, ``content`` and the chat's ``messages``. ``response`` is the
    text of the chat's last turn where that is the model's. ``calls`` adds ``identity``, ``model``,
    ``latency_ms``, ``source_ip`` and ``response_body`` by chat; a body there is the response instead.
    """
    columns = turns.select(F.col(chat_id), F.col(turn), F.col("role"), F.col("text").alias("content"))
    numbered = positions(columns, [chat_id], [turn], "messages")
    last = F.max_by(F.struct("role", F.col("text").alias("said")), turn)
    ends = turns.groupBy(chat_id).agg(last.alias("_last")).select(
        chat_id, F.when(F.col("_last.role") == "assistant", F.col("_last.said")).alias("response")
    )
    if calls is not None:
        ends = ends.join(calls, chat_id, "left")
        ends = ends.withColumn("response", F.coalesce(response_text(F.col("response_body")), "response")).drop("response_body")
    return numbered.join(ends, chat_id)
