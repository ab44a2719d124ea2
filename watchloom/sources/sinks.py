"""Writing results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchloom.session import freed_shuffles

FILE_ROWS = 100_000  # rows of a file that one task has to read whole
OPEN_FILES = 64  # folders that a task writes at once; beyond, it sorts


def write_jsonl(rows: DataFrame, path: str, by: list[str] | None = None, packed: bool = False) -> None:
    """Overwrite ``path`` with JSON lines; NULL fields are written, text stays UTF-8.

    ``packed`` files are gzip, which readers unpack by the file's name. A reader can't split such a file, so none has more
    than ``FILE_ROWS`` rows.
    """
    writer = rows.write.mode("overwrite").option("ignoreNullFields", "false")
    if packed:
        writer = writer.option("compression", "gzip").option("maxRecordsPerFile", FILE_ROWS)
    with freed_shuffles(rows.sparkSession, OPEN_FILES if by else 0):
        (writer.partitionBy(*by) if by else writer).json(path)


def write_csv(rows: DataFrame, path: str, file_rows: int = FILE_ROWS) -> None:
    """Flat CSV view: only scalar columns. Quotes are doubled, as ordinary CSV readers expect.

    Values may hold line breaks, so a reader can't split a file: no file has more than ``file_rows`` rows.
    """
    flat = [n for n, t in rows.dtypes if not t.startswith(("array", "struct", "map", "variant"))]
    writer = rows.select(*flat).write.mode("overwrite").option("maxRecordsPerFile", file_rows)
    writer.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_partitioned(rows: DataFrame, path: str, by: list[str], real: Column | None = None) -> None:
    """One JSON object per event by split and run; rows marked real go to their own folder."""
    if real is None:
        write_jsonl(rows, path, by)
        return
    write_jsonl(rows.filter(~real), f"{path}/generated", by)
    write_jsonl(rows.filter(real), f"{path}/real_seed", by)


def write_table(rows: DataFrame, path: str, codec: str = "snappy") -> None:
    rows.write.mode("overwrite").option("compression", codec).parquet(path)


def spread_by_run(rows: DataFrame, key: str) -> DataFrame:
    """Bring rows of one output folder together; a crowded folder is split by size into as many tasks as it needs.

    The rebalancing hint lets the adaptive planner merge small shuffle partitions and split large ones
    (``spark.sql.adaptive.advisoryPartitionSizeInBytes``), so the number of files follows a folder's size.
    """
    return rows.hint("rebalance", key)
