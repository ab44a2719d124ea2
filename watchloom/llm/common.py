"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id where rows are ordered or joined; such rows come last.
NO_ID = 2**63 - 1


#: Rows of a batch that goes to Python: with long texts, the default of 10,000 is tens of megabytes a task.
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> SparkSession:
    """The session, with batches of ``BATCH_ROWS`` at most."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_id(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def shown_id(column: Column) -> Column:
    return F.when(column != NO_ID, column)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def columns(df: DataFrame) -> list[Column]:
    """All columns by name, also those with dots in their names."""
    return [F.col(quoted(c)) for c in df.columns]


def computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that later expressions read and don't repeat.

    A generator of one row keeps the optimizer from writing the expression into lambdas that use it, where
    it would be evaluated once for each element.
    """
    return df.select("*", F.explode(F.array(F.struct(value.alias("v")))).alias(name)).withColumn(name, F.col(f"{quoted(name)}.v"))
