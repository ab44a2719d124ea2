"""A log on shared storage with an index of its files: cursor reads open only the files that hold what they return.

Entries are written in order of stream and id, about ``ENTRIES_A_FILE`` to a file. Beside them lies one index row a file and
stream: first and last id and number of entries. As ids grow within a stream, a stream's files follow one another;
the index therefore tells where the next entries after any ``<ms>-<seq>`` id are, and how many entries come before each file.
"""

from __future__ import annotations

import math
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from watchloom.schemas import BATCH_SIZE, SOURCES, STREAM_PREFIX
from watchloom.sources import log
from watchloom.session import materialize

ENTRIES_A_FILE = 1_000_000
_PLACE = "struct(ms, seq)"


class LandedLog:
    """Entries ``(stream, entry_id, ms, seq, ...)`` under ``path``."""

    def __init__(self, spark: SparkSession, path: str, schema=None):
        self.spark, self.path, self.schema = spark, path, schema

    def add(self, entries: DataFrame, number: int, entries_a_file: int = ENTRIES_A_FILE) -> LandedLog:
        """Append a batch of entries; a batch that is repeated under its ``number`` replaces what it wrote.

        Entries that aren't newer than the stream's last one are refused, as they would change what readers have seen.
        """
        own = materialize(entries, "entries")  # counted, compared and sorted
        self.schema = entries.schema
        if number:
            ends = self.index().filter(F.col("batch") != number).groupBy("stream").agg(F.max("last").alias("end"))
            starts = own.groupBy("stream").agg(F.min(F.expr(_PLACE)).alias("start"))
            old = starts.join(ends, "stream").filter("start <= end").select("stream").limit(5).collect()
            if old:
                raise ValueError(f"entries must be newer than those of {', '.join(r['stream'] for r in old)}")
        files = max(1, math.ceil(own.count() / entries_a_file))
        to = f"{self.path}/entries/batch={number}"
        own.repartitionByRange(files, "stream", "ms", "seq").sortWithinPartitions("stream", "ms", "seq").write.mode("overwrite").parquet(to)
        written = self.spark.read.schema(self.schema).parquet(to).withColumn("file", F.col("_metadata.file_path"))
        rows = written.groupBy("file", "stream").agg(F.min(F.expr(_PLACE)).alias("first"), F.max(F.expr(_PLACE)).alias("last"), F.count(F.lit(1)).alias("n"))
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/index/batch={number}")
        return self

    def index(self) -> DataFrame:
        """``batch``, ``file``, ``stream``, ``first``, ``last``, ``n``, and ``before``, the stream's entries in earlier files."""
        rows = self.spark.read.option("basePath", f"{self.path}/index").parquet(f"{self.path}/index")
        earlier = Window.partitionBy("stream").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))

    def entries(self, files: DataFrame | None = None) -> DataFrame:
        """All entries, or those of the files in an index selection."""
        reader = self.spark.read.schema(self.schema)
        if files is None:
            return reader.parquet(f"{self.path}/entries/batch=*")
        paths = sorted({unquote(r["file"]) for r in files.select("file").collect()})
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read_batch(self, stream: str, count: int = BATCH_SIZE, last_id: str = "0-0") -> DataFrame:
        """Next ``count`` entries after ``last_id``, in order; reads the file that holds the cursor and the files after it until they have enough."""
        ms, seq = (int(x) for x in last_id.split("-"))
        cursor = F.struct(F.lit(ms).cast("long").alias("ms"), F.lit(seq).cast("long").alias("seq"))
        rows = self.index().filter((F.col("stream") == stream) & (F.col("last") > cursor))
        earlier = Window.partitionBy("stream").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
        sure = F.when(F.col("first") > cursor, F.col("n")).otherwise(0)
        rows = rows.withColumn("sure", sure).withColumn("ahead", F.coalesce(F.sum("sure").over(earlier), F.lit(0)))
        return log.read_batch(self.entries(rows.filter(F.col("ahead") < count)), stream, count, last_id)

    def read_all_once(self, count: int = BATCH_SIZE) -> DataFrame:
        """First ``count`` entries of every known stream; reads each stream's first files only."""
        known = F.col("stream").isin(*[STREAM_PREFIX + s for s in SOURCES])
        return log.read_all_once(self.entries(self.index().filter(known & (F.col("before") < count))), count)

    def export_range(self, stream: str, first: str = "-", last: str = "+") -> DataFrame:
        """Entries of an id range as JSON text; reads the files that the range touches."""
        rows = self.index().filter(F.col("stream") == stream)
        at = lambda id_: F.struct(*[F.lit(int(x)).cast("long").alias(n) for x, n in zip(id_.split("-"), ("ms", "seq"), strict=True)])
        if first != "-":
            rows = rows.filter(F.col("last") >= at(first))
        if last != "+":
            rows = rows.filter(F.col("first") <= at(last))
        return log.export_range(self.entries(rows), stream, first, last)

    def walk(self, count: int = BATCH_SIZE, stream: str | None = None) -> DataFrame:
        """All entries with the number ``read`` of the cursor read that would return them and their ``place`` in it.

        Reads every file once, with its place in the stream from the index, instead of once for each read.
        """
        rows = self.index().select("file", "stream", "before")
        entries = self.entries() if stream is None else self.entries(rows.filter(F.col("stream") == stream)).filter(F.col("stream") == stream)
        names = entries.columns
        placed = entries.withColumn("_file", F.col("_metadata.file_path"))
        inside = F.row_number().over(Window.partitionBy("_file", "stream").orderBy("ms", "seq"))  # a file a task, whatever the stream's size
        placed = placed.withColumn("_inside", inside).join(rows.withColumnRenamed("file", "_file"), ["_file", "stream"])
        position = F.col("before") + F.col("_inside") - 1
        return placed.select(F.call_function("div", position, F.lit(count)).alias("read"), F.pmod(position, F.lit(count)).alias("place"), *names)

    def follow(self, files_per_batch: int | None = None) -> DataFrame:
        """The entries as a stream: what later batches add arrives, and the checkpoint is the cursor."""
        reader = self.spark.readStream.schema(self.schema)
        if files_per_batch is not None:
            reader = reader.option("maxFilesPerTrigger", files_per_batch)
        return reader.parquet(f"{self.path}/entries/batch=*")
