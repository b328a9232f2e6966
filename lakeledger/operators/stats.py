"""Session statistics and category shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scalars import or_default, percent_share
from .browse import in_session


def category_counts(files: DataFrame) -> DataFrame:
    """Files per category; a missing category counts as ``Others``."""
    return files.groupBy(or_default("category").alias("category")).agg(F.count(F.lit(1)).alias("n_files"))


def session_stats(files: DataFrame, session_id: int) -> DataFrame:
    return category_counts(in_session(files, session_id))


def session_stats_map(files: DataFrame, session_id: int) -> DataFrame:
    """One row: session, total, and category -> count as a map (built from the grouped rows)."""
    return session_stats(files, session_id).agg(
        F.lit(session_id).cast("bigint").alias("session_id"),
        F.coalesce(F.sum("n_files"), F.lit(0)).alias("total_files"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", "n_files")))).alias("categories"),
    )


def category_share(files: DataFrame) -> DataFrame:
    """Categories with count, whole-number percentage and position, largest first (ties by name).

    The windows run over one row per category.
    """
    counts = category_counts(files)
    total = F.sum("n_files").over(Window.partitionBy(F.lit(1)))
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("n_files"), F.asc("category")))
    return counts.select(
        "category", "n_files", percent_share("n_files", total).alias("percent"), rank.cast("bigint").alias("position")
    )
