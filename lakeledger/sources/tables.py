"""Stored tables: parquet folders, catalog tables, JDBC, and versioned snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.errors import AnalysisException


def load_table(spark: SparkSession, name_or_path: str, schema: T.StructType | None = None) -> DataFrame:
    """A catalog table by name, or a parquet folder by path."""
    if "/" not in name_or_path:
        return spark.table(name_or_path)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(name_or_path)


def load_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int = 64, **options):
    """A table of an outside database, read in ``parts`` key ranges (needs that database's driver jar)."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts)
        .options(**options)
        .load()
    )


def save_table(df: DataFrame, path: str, mode: str = "append", partition_by: list[str] | None = None) -> None:
    """Write parquet; logs append by session, so that a session filter prunes folders."""
    df.write.mode(mode).partitionBy(*(partition_by or [])).parquet(path)


def save_catalog(df: DataFrame, table: str, buckets: int) -> None:
    """Save a snapshot bucketed and sorted by path: later joins on path do not shuffle this side.

    Take as many buckets as the session has shuffle partitions.
    """
    df.write.mode("overwrite").bucketBy(buckets, "path").sortBy("path").saveAsTable(table)


def write_snapshot(df: DataFrame, root: str, version: int) -> None:
    """Write a new snapshot folder, then append its row to the pointer table.

    A parquet folder cannot be overwritten by a job that reads it, so every version has its own
    folder; readers see a version only after its pointer row is there.
    """
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{root}/snapshot={version}")
    spark.range(1).select(F.lit(version).cast("bigint").alias("version")).write.mode("append").parquet(
        f"{root}/pointer"
    )


def current_version(spark: SparkSession, root: str) -> int | None:
    """Newest published version, None where nothing was published yet."""
    try:
        pointer = spark.read.schema("version BIGINT").parquet(f"{root}/pointer")
        return pointer.agg(F.max("version").alias("version")).first()["version"]
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def read_snapshot(spark: SparkSession, root: str, version: int | None = None, schema=None) -> DataFrame:
    """The snapshot of ``version``, by default the newest published one.

    With a ``schema`` it is empty where nothing was published yet.
    """
    version = current_version(spark, root) if version is None else version
    if version is None:
        if schema is None:
            raise FileNotFoundError(f"no snapshot was published in {root}")
        return spark.createDataFrame([], schema)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{root}/snapshot={version}")
