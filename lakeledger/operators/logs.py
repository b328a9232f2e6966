"""Move logs: listing, counts, removal, verification of copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..constants import MAX_PAGE_LIMIT
from .browse import page_of


def with_status(logs: DataFrame, status: str | None) -> DataFrame:
    return logs.filter(F.col("status") == status) if status else logs


def list_logs(logs: DataFrame, status: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """Newest first (ties by id); limits outside 1..1000 and negative offsets are refused."""
    if not 1 <= limit <= MAX_PAGE_LIMIT:
        raise ValueError("limit must be between 1 and 1000")
    if offset < 0:
        raise ValueError("offset must not be negative")
    return page_of(with_status(logs, status), [F.desc("timestamp"), F.asc("id")], offset, limit)


def log_counts(logs: DataFrame) -> DataFrame:
    """Rows per status, and in all (status ``all``)."""
    per_status = logs.groupBy("status").agg(F.count(F.lit(1)).alias("n_logs"))
    every = per_status.agg(F.coalesce(F.sum("n_logs"), F.lit(0)).alias("n_logs"))
    return per_status.unionByName(every.select(F.lit("all").alias("status"), "n_logs"))


def drop_logs(logs: DataFrame, undo: DataFrame, log_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove logs and, with them, their undo rows. ``log_ids`` has one column ``id``."""
    gone = log_ids.select("id")
    return (
        logs.join(gone, "id", "left_anti"),
        undo.join(gone.withColumnRenamed("id", "log_id"), "log_id", "left_anti").select(*undo.columns),
    )


def verify_copies(logs: DataFrame, source_hashes: DataFrame, target_hashes: DataFrame) -> DataFrame:
    """Successful moves with the hashes of both ends: ``verified`` only when both are there and equal.

    Hash tables have (path, hash).
    """
    before = source_hashes.select(F.col("path").alias("old_path"), F.col("hash").alias("source_hash"))
    after = target_hashes.select(F.col("path").alias("new_path"), F.col("hash").alias("target_hash"))
    return (
        with_status(logs, "success")
        .join(before, "old_path", "left")
        .join(after, "new_path", "left")
        .select(
            "id", "old_path", "new_path", "source_hash", "target_hash",
            F.coalesce(F.col("source_hash") == F.col("target_hash"), F.lit(False)).alias("verified"),
        )
    )
