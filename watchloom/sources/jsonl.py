"""Reading JSON-lines files laid out as ``<root>/<source>/*.jsonl``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from watchloom.schemas import SOURCES
from watchloom.functions.text import strip
from watchloom.session import configure


def check_source(source: str) -> str:
    """Only the known sources may be asked for."""
    if source not in SOURCES:
        raise ValueError(f"Unknown source: {source}")
    return source


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop_path)
    return found is not None and len(found) > 0


def read_lines(spark: SparkSession, path: str, pattern: str = "*.jsonl", number: bool = False) -> DataFrame:
    """Non-blank lines with file path and source directory; no file gives no rows.

    ``number=True`` also carries the position of each line inside its file split, from which
    :func:`number_lines` finds line numbers.
    """
    configure(spark)
    if not _exists(spark, path):
        empty = "ingest_source string, file_path string, line string"
        return spark.createDataFrame([], empty + (", _block long, _row long" if number else ""))
    text = spark.read.option("pathGlobFilter", pattern).text(path)
    columns = [
        # Partition directories may be named by value or as column=value.
        F.regexp_extract(F.col("_metadata.file_path"), r"([^/=]+)/[^/]+$", 1).alias("ingest_source"),
        F.col("_metadata.file_path").alias("file_path"),
        F.col("value").alias("line"),
    ]
    if number:
        columns += [
            F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_row"),
        ]
        return text.select(*columns)
    return not_blank(text.select(*columns))


def not_blank(lines: DataFrame) -> DataFrame:
    return lines.filter(F.length(strip(F.col("line"))) > 0)


def number_lines(lines: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """1-based physical line numbers, blank lines counted, for ``read_lines(number=True)``.

    ``rows`` are the lines to number, by default all that are not blank; pass only the failing
    ones to keep the join small.

    A file split knows the order of its own lines. Splits are counted, the counts are summed
    over the splits of a file, and each line adds its place in its split: the file is never
    read as a whole.
    """
    per_block = lines.groupBy("file_path", "_block").agg(
        F.count(F.lit(1)).alias("_lines"), F.min("_row").alias("_first")
    )
    before = Window.partitionBy("file_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_block.select(
        "file_path", "_block", "_first", F.coalesce(F.sum("_lines").over(before), F.lit(0)).alias("_before")
    )
    numbered = (not_blank(lines) if rows is None else rows).join(offsets, ["file_path", "_block"])
    return numbered.withColumn(
        "line_number", F.col("_before") + F.col("_row") - F.col("_first") + 1
    ).drop("_block", "_row", "_first", "_before")


def read_source(spark: SparkSession, root: str, source: str, pattern: str = "*.jsonl") -> DataFrame:
    """All files of one source."""
    return read_lines(spark, f"{root}/{check_source(source)}", pattern)


def read_all_sources(spark: SparkSession, root: str, pattern: str = "*.jsonl") -> DataFrame:
    """All files of all sources in one scan."""
    return read_lines(spark, f"{root}/*", pattern).filter(F.col("ingest_source").isin(*SOURCES))


def source_files(lines: DataFrame) -> DataFrame:
    """Paths in sorted order with their line counts."""
    return lines.groupBy("file_path").agg(F.count(F.lit(1)).alias("lines")).orderBy("file_path")


def unknown_sources(lines: DataFrame, source_column: str = "ingest_source") -> DataFrame:
    """Rows of a source outside the known ones, as dead letters."""
    known = lines.sparkSession.createDataFrame([(s,) for s in SOURCES], f"{source_column} string")
    return lines.join(F.broadcast(known), source_column, "left_anti").select(
        source_column, F.concat(F.lit("Unknown source: "), F.col(source_column)).alias("error"), F.col("line").alias("raw")
    )
