"""Session settings and lineage cuts shared by all operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# AQE sizes partitions and splits skewed ones at run time; UTC keeps results the same on every cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # bursts of one key are merged before the shuffle
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


def build_session(app: str = "lakeledger", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the library's settings; ``conf`` overrides them (dots written as ``__``)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def apply_settings(spark: SparkSession) -> SparkSession:
    """Put the library's run-time settings on a session somebody else built."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


_scopes: list[list[str]] = []      # folders written inside the open run scopes, innermost last


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Where none is named, a folder below the session's warehouse, where the cluster keeps its tables.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_steps")
    return context.getCheckpointDir()


# Spark's own switch: the shuffle files of a write go when it has ended, else when the driver happens to collect its garbage
_SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df: DataFrame, sparing: bool = False) -> DataFrame:
    """Write ``df`` once as a table below the checkpoint folder and go on from there.

    A table, unlike an RDD checkpoint, lets later steps read single columns and tells the planner its size.
    It stays until its run scope closes (``run_scope``) or ``forget`` names it. ``sparing`` spares disk: the files are packed closer, and
    what the write has shuffled is gone as soon as it has ended.
    """
    spark = df.sparkSession
    folder = f"{checkpoint_folder(spark)}/{uuid.uuid4().hex}"
    if sparing:
        before = spark.conf.get(_SHUFFLES_GO, None)
        spark.conf.set(_SHUFFLES_GO, "true")
        try:
            df.write.option("compression", "zstd").parquet(folder)
        finally:
            spark.conf.unset(_SHUFFLES_GO) if before is None else spark.conf.set(_SHUFFLES_GO, before)
    else:
        df.write.parquet(folder)
    if _scopes:
        _scopes[-1].append(folder)
    step = spark.read.schema(df.schema).parquet(folder)
    step._step_folder = folder
    return step


def delete_folder(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def forget(step: DataFrame) -> None:
    """Delete the table behind a result of ``cut_lineage`` that nothing reads any more, such as a loop's last round."""
    folder = getattr(step, "_step_folder", None)
    if folder is not None:
        delete_folder(step.sparkSession, folder)


@contextmanager
def run_scope(spark: SparkSession) -> Iterator[None]:
    """Tables that ``cut_lineage`` writes inside are deleted at the end. Results must have been written or collected by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for folder in _scopes.pop():
            delete_folder(spark, folder)
