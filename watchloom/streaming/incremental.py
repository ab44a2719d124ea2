"""Streams whose result is complete when they end: windows, sessions and correlation kept as a table of open slots.

Each micro-batch is folded into slots (first, last and count per key and time slot, combined before the shuffle),
which are merged with the slots left open by the batch before. What the watermark has passed is written out,
what it hasn't stays open. Rows too old for that are written to a side table instead of being lost, and
:meth:`Run.finish` adds what is still open, so that the table equals the batch answer over all rows but the late ones.

Everything a batch writes lies in folders of its number: a batch that is repeated after a failure overwrites
its own files, and reads the slots its predecessor left. Slots older than that are removed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from watchloom.functions import times
from watchloom.operators.windows import GROUP, KEY_FIELDS, check_seconds, hash_id, with_session_key
from watchloom.schemas import FIXED_WINDOW_SECONDS, SESSION_GAP_SECONDS
from watchloom.session import materialize, remove

#: Before any row: earlier than every instant.
NO_WATERMARK = -(2**62)


@dataclass
class Job:
    """What a stream keeps: how rows become slots, which rows are late, and how slots are closed.

    ``slots`` gives ``keys`` and ``slot`` with the ``merge`` columns; ``late`` tells of a row whether the watermark
    (in microseconds) has passed it; ``close`` splits slots into results and the slots to keep, given the watermark of the
    last batch and the new one. Without a new one (None) everything is closed.
    """

    keys: list[str]
    slots: Callable[[DataFrame], DataFrame]
    merge: dict[str, Callable]
    late: Callable[[Column], Column]
    close: Callable[[DataFrame, int, int | None], tuple[DataFrame, DataFrame]]

    def merged(self, slots: DataFrame) -> DataFrame:
        return slots.groupBy(*self.keys, "slot").agg(*[f(c).alias(c) for c, f in self.merge.items()])


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def window_job(seconds: int = FIXED_WINDOW_SECONDS, group: str = GROUP) -> Job:
    """Clock-aligned windows: closed when the watermark reaches their end."""
    width = check_seconds("window_seconds", seconds) * 1_000_000

    def slots(rows: DataFrame) -> DataFrame:
        return rows.groupBy(group, times.slot(F.col("ts"), seconds).alias("slot")).agg(F.count(F.lit(1)).alias("event_count"))

    def close(found: DataFrame, before: int, now: int | None) -> tuple[DataFrame, DataFrame]:
        done = F.lit(True) if now is None else (F.col("slot") + 1) * width <= now
        start = F.timestamp_micros(F.col("slot") * width)
        shown = found.filter(done).withColumn("start_ts", start)
        return shown.select(group, times.fixed_window_id(F.col("start_ts"), seconds).alias("window_id"), "start_ts", "event_count"), found.filter(~done)

    return Job([group], slots, {"event_count": F.sum}, lambda wm: (times.slot(F.col("ts"), seconds) + 1) * width <= wm, close)


def session_job(gap_seconds: int = SESSION_GAP_SECONDS, key_fields=KEY_FIELDS, group: str = GROUP) -> Job:
    """Inactivity sessions, over any number of batches: closed when the watermark is more than the gap behind their end."""
    gap = check_seconds("session_gap_seconds", gap_seconds) * 1_000_000
    keys = [group, *[f"key_{f}" for f in key_fields]]

    def slots(rows: DataFrame) -> DataFrame:
        keyed = with_session_key(rows, key_fields)
        return keyed.groupBy(*keys, times.slot(F.col("ts"), gap_seconds).alias("slot")).agg(
            F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n")
        )

    def close(found: DataFrame, before: int, now: int | None) -> tuple[DataFrame, DataFrame]:
        in_time = Window.partitionBy(*keys).orderBy("slot")
        apart = _micros(F.col("first_ts")) - _micros(F.lag("last_ts").over(in_time))
        numbered = found.withColumn("_new", F.when(apart.isNull() | (apart > gap), 1).otherwise(0))
        numbered = numbered.withColumn("_no", F.sum("_new").over(in_time.rowsBetween(Window.unboundedPreceding, 0)))
        bounds = Window.partitionBy(*keys, "_no")
        placed = numbered.withColumns({"start_ts": F.min("first_ts").over(bounds), "end_ts": F.max("last_ts").over(bounds)})
        done = F.lit(True) if now is None else _micros(F.col("end_ts")) + gap < now
        ended = placed.filter(done).groupBy(*keys, "start_ts", "end_ts").agg(F.sum("n").alias("event_count"))
        return ended.select(*keys, hash_id(keys, "start_ts").alias("window_id"), "start_ts", "end_ts", "event_count"), placed.filter(~done).select(found.columns)

    merge = {"first_ts": F.min, "last_ts": F.max, "n": F.sum}
    # A row that isn't late lies at the watermark or after it: more than the gap behind every closed session.
    return Job(keys, slots, merge, lambda wm: _micros(F.col("ts")) < wm, close)


def correlation_job(key: str, a: Column, b: Column, delta_seconds: int) -> Job:
    """Incidents: slots of a key in which both kinds of alert lie at most ``delta_seconds`` apart.

    A pair of slots is final when the later one is closed; a slot is kept until the one after it is closed too.
    """
    width = check_seconds("delta_seconds", delta_seconds) * 1_000_000
    ends = [f"{k}_{n}" for k in "ab" for n in ("first", "last")]

    def slots(rows: DataFrame) -> DataFrame:
        alerts = rows.filter(F.col(key).isNotNull() & (F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False))))
        values = [f(F.when(kind, _micros(F.col("ts")))).alias(f"{k}_{n}") for k, kind in (("a", a), ("b", b)) for n, f in (("first", F.min), ("last", F.max))]
        return alerts.groupBy(key, times.slot(F.col("ts"), delta_seconds).alias("slot")).agg(*values)

    def close(found: DataFrame, before: int, now: int | None) -> tuple[DataFrame, DataFrame]:
        other = found.select(F.col(key), F.explode(F.array(*[F.col("slot") + d for d in (-1, 0, 1)])).alias("slot"), F.col("slot").alias("b_slot"), F.col("b_first").alias("bf"), F.col("b_last").alias("bl"))
        pairs = found.join(other, [key, "slot"]).filter("a_first IS NOT NULL AND bf IS NOT NULL")
        apart = F.when(F.col("slot") < F.col("b_slot"), F.col("bf") - F.col("a_last")).when(F.col("slot") > F.col("b_slot"), F.col("a_first") - F.col("bl")).otherwise(0)
        end = (F.greatest("slot", "b_slot") + 1) * width
        due = (end > before) & (F.lit(True) if now is None else end <= now)
        shown = pairs.filter(due & (apart <= width)).select(key, F.col("a_first").alias("a_first_us"), F.col("bf").alias("b_first_us"))
        return shown, found.filter(F.lit(False) if now is None else (F.col("slot") + 2) * width > now)

    merge = {c: F.min if c.endswith("first") else F.max for c in ends}
    return Job([key], slots, merge, lambda wm: (times.slot(F.col("ts"), delta_seconds) + 1) * width <= wm, close)


class Run:
    """A stream that folds into ``path``; start it again with the same path to go on where it stopped."""

    def __init__(self, job: Job, path: str, delay_seconds: int = 600):
        self.job, self.path, self.delay = job, path, delay_seconds * 1_000_000

    def _clock(self, spark: SparkSession, number: int) -> int:
        return NO_WATERMARK if number < 0 else spark.read.parquet(f"{self.path}/clock/batch={number}").first()["watermark"]

    def fold(self, batch: DataFrame, number: int) -> None:
        """One micro-batch. Late rows are those that the watermark of the batch before has passed."""
        spark = batch.sparkSession
        before = self._clock(spark, number - 1)
        batch = materialize(batch, "batch")  # read for late rows, for slots and for the clock
        late = F.coalesce(self.job.late(F.lit(before)), F.lit(True))  # also rows without an instant
        batch.filter(late).write.mode("overwrite").parquet(f"{self.path}/late/batch={number}")
        newest = batch.agg(F.max(_micros(F.col("ts")))).first()[0]
        now = before if newest is None else max(before, newest - self.delay)
        slots = self.job.slots(batch.filter(~late))
        if number:
            slots = slots.unionByName(spark.read.schema(slots.schema).parquet(f"{self.path}/open/batch={number - 1}"))
        done, left = self.job.close(materialize(self.job.merged(slots), "slots"), before, now)
        done.write.mode("overwrite").parquet(f"{self.path}/closed/batch={number}")
        left.write.mode("overwrite").parquet(f"{self.path}/open/batch={number}")
        spark.range(1).select(F.lit(now).alias("watermark")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/clock/batch={number}")
        remove(spark, f"{self.path}/open/batch={number - 2}")

    def over(self, stream: DataFrame) -> Run:
        """Fold all that has arrived."""
        writer = stream.writeStream.foreachBatch(self.fold).option("checkpointLocation", f"{self.path}/progress")
        writer.trigger(availableNow=True).start().awaitTermination()
        return self

    def last(self, spark: SparkSession) -> int:
        """Number of the last batch that was folded; -1 before the first."""
        found = spark.read.option("basePath", f"{self.path}/clock").parquet(f"{self.path}/clock").agg(F.max("batch")).first()[0]
        return -1 if found is None else found

    def finish(self, spark: SparkSession) -> DataFrame:
        """All results: those closed so far and, from the open slots, the rest. The stream may still go on afterwards."""
        number = self.last(spark)
        slots = spark.read.parquet(f"{self.path}/open/batch={number}")
        rest, _ = self.job.close(slots, self._clock(spark, number), None)
        return self.closed(spark, rest.schema).unionByName(rest)

    def closed(self, spark: SparkSession, schema: StructType) -> DataFrame:
        """Results that no later row can change."""
        return spark.read.schema(schema).parquet(f"{self.path}/closed/batch=*")

    def late(self, spark: SparkSession) -> DataFrame:
        """Rows that came too late, as they were, with the number of their ``batch``."""
        return spark.read.option("basePath", f"{self.path}/late").parquet(f"{self.path}/late")
