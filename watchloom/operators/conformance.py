"""Schema checks over event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def schema_conformance(events: DataFrame, fields: list[str], rules: dict[str, Column]) -> DataFrame:
    """NULL and rule-violation counts of each field, all in one aggregation."""
    counts = events.agg(
        *[F.count_if(F.col(f).isNull()).alias(f"n_{f}") for f in fields],
        *[F.count_if(rules[f]).alias(f"v_{f}") for f in fields if f in rules],
    )
    rows = [
        F.struct(
            F.lit(f).alias("field"), F.col(f"n_{f}").alias("nulls"),
            (F.col(f"v_{f}") if f in rules else F.lit(0).cast("long")).alias("violations"),
        )
        for f in fields
    ]
    return counts.select(F.inline(F.array(*rows)))
