"""Session settings and shared scratch space."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import SparkSession

_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # A repeated JSON key keeps its last value.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # The JVM never compiles a method above 8000 bytes of bytecode. Wide projections pass that
    # in one fused stage; above the limit Spark compiles each operator in small methods.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
_TEMPORARY: list[list[str]] = []  # paths of the tables of each open temporary_tables()


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings every operator here relies on."""
    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see; a local one only where none is configured and all runs in one process."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        base = configured.rstrip("/")
    elif not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    else:
        base = tempfile.mkdtemp(prefix="watchloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(base)
    return base


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder; never reused, never deleted here."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def checkpoint(df):
    """Reliable checkpoint: fixes a small sampled result so that every reader sees the same rows."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextlib.contextmanager
def freed_shuffles(spark: SparkSession, writers: int = 0):
    """Writes in here delete their shuffle files as they end, not when the driver happens to collect its garbage.

    A task that writes up to ``writers`` folders has a file open in each, instead of sorting its rows by folder, on disk if
    they are many.
    """
    wanted = {_FREED: "true"} | ({_WRITERS: str(writers)} if writers else {})
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def materialize(df, label: str, codec: str = "snappy"):
    """Write a table to the shared folder and read it back, for results several readers need.

    Costly steps such as parsing then run once, and a lost executor repeats only its own tasks.
    """
    path = scratch_path(df.sparkSession, label)
    for paths in _TEMPORARY[-1:]:
        paths.append(path)
    with freed_shuffles(df.sparkSession):
        df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.parquet(path)


@contextlib.contextmanager
def temporary_tables(spark: SparkSession):
    """Tables that :func:`materialize` writes in here are deleted at the end; whatever reads them is written by then."""
    _TEMPORARY.append([])
    try:
        yield
    finally:
        for path in _TEMPORARY.pop():
            remove(spark, path)


def discard(df) -> None:
    """Delete a table that :func:`materialize` returned, once nothing reads it any more."""
    for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
        remove(df.sparkSession, folder)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote; a missing one is fine."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
