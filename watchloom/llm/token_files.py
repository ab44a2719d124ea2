"""Token ids as Parquet list columns, in ascending doc_id order, and what is read back from them.

Columns: the id column, ``part`` and ``place`` (file part, ids before the document in its part), ``n_tokens``
and ``tokens``. Tokens are dictionary encoded, the sorted number columns delta encoded; row groups and
pages are small enough that column and page indexes let a reader fetch one document's ids or only the
numbers. A document's place in the whole is its part's start plus ``place``.

Defined cases: a null text is empty and has the end id only. Null ids come last. Rows that share an id are
ordered by a hash of their text. An empty table gives files without rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from watchloom.llm import kernel
from watchloom.llm.common import order_id, quoted
from watchloom.llm.tokenizer import encoder

SLICE = 2 << 20
FORMAT = {
    "compression": "zstd", "parquet.writer.version": "v2", "parquet.block.size": str(32 << 20), "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000", "parquet.enable.dictionary": "false", "parquet.enable.dictionary#tokens.list.element": "true",
}
SCHEMA = "doc_id long, part int, place long, n_tokens int, tokens array<int>"


def _encoded(path: str, end_id: int):
    def run(batches):
        part, place = TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in kernel.slices(whole, "text", SLICE):
                ids, before = encoder(path).encode(batch.column("text"))
                rows = np.arange(1, len(before))
                tokens, before = np.insert(ids, before[1:], end_id), before + np.arange(len(before))
                sizes = np.diff(before)
                lists = pa.ListArray.from_arrays(pa.array(before.astype(np.int32)), pa.array(tokens, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(np.full(len(rows), part, np.int32)), pa.array(place + before[:-1]), pa.array(sizes.astype(np.int32)), lists],
                    ["doc_id", "part", "place", "n_tokens", "tokens"],
                )
                place += int(before[-1])

    return run


def write_token_files(df: DataFrame, out: str, tokenizer: str, end_id: int = 1, id_column: str = "doc_id", text: str = "text") -> None:
    """Encodes every text, appends ``end_id`` to each, and writes the files below ``out``."""
    rows = df.select(F.col(quoted(id_column)).cast("long").alias("doc_id"), F.col(quoted(text)).alias("text"))
    ordered = rows.repartitionByRange(order_id(), F.xxhash64("text")).sortWithinPartitions(order_id(), F.xxhash64("text"))
    ordered.mapInArrow(_encoded(tokenizer, end_id), SCHEMA).write.options(**FORMAT).parquet(out)


def part_starts(spark: SparkSession, out: str) -> DataFrame:
    """Ids before each part; reads two number columns. One row for each file part."""
    parts = spark.read.parquet(out).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))


def _sums(batches):
    for batch in batches:
        lists = batch.column("tokens")
        offsets = np.asarray(lists.offsets)
        raw = memoryview(np.asarray(lists.values, dtype="<i4").tobytes())
        sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("part"), batch.column("place"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(sums, pa.int64())],
            ["doc_id", "part", "place", "n_tokens", "ids_crc32"],
        )


def read_digests(spark: SparkSession, out: str) -> DataFrame:
    """Per document from the files: start, number of ids, checksum of its ids as little-endian 32-bit numbers."""
    files = spark.read.parquet(out).select("doc_id", "part", "place", "tokens")
    sums = files.mapInArrow(_sums, "doc_id long, part int, place long, n_tokens long, ids_crc32 long")
    starts = F.broadcast(part_starts(spark, out))  # one row for each partition of the write
    return sums.join(starts, "part").select("doc_id", (F.col("part_start") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def read_tokens(spark: SparkSession, out: str, low: int, high: int) -> DataFrame:
    """Documents with ids from ``low`` to ``high``: statistics and page indexes skip the rest."""
    return spark.read.parquet(out).filter(F.col("doc_id").between(low, high)).select("doc_id", "n_tokens", "tokens")
