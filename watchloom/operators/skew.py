"""Building blocks that keep every task bounded when one key holds much of the data."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchloom.session import materialize

# Rows of one key that may meet in one task.
HOT_ROWS = 1_000_000


def hot_keys(counts: DataFrame, keys: list[str], n: str, hot_rows: int) -> DataFrame:
    """Keys above ``hot_rows`` with the number of parts to split them into.

    At most (all rows / hot_rows) keys can qualify, which is what makes the list broadcastable:
    a million keys for a trillion rows at the default.
    """
    return counts.filter(F.col(n) > hot_rows).select(
        *keys, F.ceil(F.col(n) / hot_rows).cast("int").alias("_parts")
    )


def attach(
    rows: DataFrame, groups: DataFrame, keys: list[str], n: str, row_id: list[str],
    hot_rows: int = HOT_ROWS, written: bool = False,
) -> DataFrame:
    """Inner join of many rows to one record per key.

    ``groups`` carries in ``n`` how many rows each key has. The record of a hot key is
    repeated once per part and its rows are dealt over the parts; all other keys have one
    part. Key columns must not be NULL. ``groups`` is read twice, so it is written out
    once unless it already is a table.
    """
    groups = groups if written else materialize(groups, "groups")
    hot = F.broadcast(hot_keys(groups, keys, n, hot_rows))
    parts = F.coalesce(F.col("_parts"), F.lit(1))
    # The row number within the task tells exact copies of a row apart.
    deal = F.xxhash64(*row_id, F.monotonically_increasing_id())
    dealt = rows.join(hot, keys, "left").withColumn("_part", F.pmod(deal, parts).cast("int")).drop("_parts")
    copies = F.when(F.col(n) > hot_rows, F.ceil(F.col(n) / hot_rows)).otherwise(1).cast("int")
    repeated = groups.withColumn("_part", F.explode(F.sequence(F.lit(0), copies - 1)))
    return dealt.join(repeated, [*keys, "_part"]).drop("_part")


def positions(members: DataFrame, keys: list[str], order: list[str], total: str = "event_count") -> DataFrame:
    """Members with ``position``, their place in their key's order from 0, and the key's member count.

    Members are range-sorted by key and order over all tasks; ranks run inside a task's piece of a key and
    start from the members of the key's pieces before it. So a key of any size is numbered alike, and no task
    holds more than its share. Key columns must not be NULL; members that are equal in ``order`` may swap.
    """
    placed = members.repartitionByRange(*keys, *order).withColumn("_piece", F.spark_partition_id())
    placed = materialize(placed, "placed")
    pieces = placed.groupBy(*keys, "_piece").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    carry = pieces.select(
        *keys, "_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias(total)
    )
    inside = Window.partitionBy(*keys, "_piece").orderBy(*order)
    ranked = placed.withColumn("_rank", F.row_number().over(inside).cast("long") - 1).join(carry, [*keys, "_piece"])
    return ranked.withColumn("position", F.col("_rank") + F.col("_before")).drop("_piece", "_rank", "_before")


def neighbours(
    rows: DataFrame, keys: list[str], instant: str, values: dict[str, Column], slot_seconds: int = 60
) -> DataFrame:
    """Distinct instants of each key with the instant before (``prev``) and after (``next``).

    ``values`` are aggregates over the rows of one instant (combined before the shuffle), so a
    crowd of rows at one instant is one row here. Instants are compared within short time
    slots, and slots of a key with each other; a slot of 60 s has at most 60 million distinct
    microseconds and a key has one row per non-empty slot, however many rows it holds.
    ``next_<name>`` repeats each value of the following instant.
    """
    width = F.lit(slot_seconds * 1_000_000)
    micros = F.unix_micros(F.col(instant))
    cells = rows.groupBy(*keys, instant).agg(*[v.alias(name) for name, v in values.items()])
    cells = cells.withColumn("_slot", F.call_function("div", micros - F.pmod(micros, width), width))
    names = list(values)
    edge = F.struct(F.col(instant).alias("at"), *names)
    slots = cells.groupBy(*keys, "_slot").agg(F.max(instant).alias("_last"), F.min(edge).alias("_first"))
    by_slot = Window.partitionBy(*keys).orderBy("_slot")
    slots = slots.select(
        *keys, "_slot",
        F.lag("_last").over(by_slot).alias("_prev_last"),
        F.lead("_first").over(by_slot).alias("_next_first"),
    )
    inside = Window.partitionBy(*keys, "_slot").orderBy(instant)
    near = cells.withColumns(
        {"_p": F.lag(instant).over(inside), "_q": F.lead(edge).over(inside)}
    ).join(slots, [*keys, "_slot"])
    following = F.coalesce("_q", "_next_first")
    return near.select(
        *keys, instant, *names,
        F.coalesce("_p", "_prev_last").alias("prev"),
        following.getField("at").alias("next"),
        *[following.getField(name).alias(f"next_{name}") for name in names],
    )


def running_totals(
    rows: DataFrame, groups: list[str], order: str, ties: list[str], values: list[str], pieces: int | None = None
) -> DataFrame:
    """Running sums ``cum_<value>`` over each group in the order of a column and, where it is equal, of ``ties``.

    Rows are range-sorted by group, order and ties over all tasks, sums run inside a task's piece of a group, and
    each piece starts from the totals of the group's pieces before it. So no task holds a whole group, nor all rows of
    one ``order`` value. There are ``pieces`` of all rows, or as many as a shuffle has partitions. Rows equal in order and ties should be combined beforehand.
    """
    ranges = ([pieces] if pieces else []) + [*groups, order, *ties]
    placed = materialize(rows.repartitionByRange(*ranges).withColumn("_piece", F.spark_partition_id()), "placed")
    totals = placed.groupBy(*groups, "_piece").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    before = Window.partitionBy(*(groups or [F.lit(0)])).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *groups, "_piece", *[F.coalesce(F.sum(f"_t_{v}").over(before), F.lit(0)).alias(f"_c_{v}") for v in values]
    )
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}")) for k in (*groups, "_piece")]
    inside = Window.partitionBy(*groups, "_piece").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, 0)
    running = placed.withColumns({f"_r_{v}": F.sum(v).over(inside) for v in values})
    joined = running.alias("r").join(carry.alias("c"), functools.reduce(lambda a, b: a & b, same))
    return joined.select(
        *[F.col(f"r.{c}") for c in rows.columns], *[(F.col(f"_r_{v}") + F.col(f"_c_{v}")).alias(f"cum_{v}") for v in values]
    )
