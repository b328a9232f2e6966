"""Progress as metrics: counted while a job runs, without a job of its own."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation, Row, SparkSession, functions as F


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """``df`` with counters that are filled by whatever action runs over it."""
    watch = Observation(name)
    return df.observe(watch, F.count(F.lit(1)).alias("processed")), watch


def progress_event(
    spark: SparkSession, event: str, session_id: int, processed: int, total: int, started: float,
    message: str | None = None,
) -> DataFrame:
    """One metrics row for a progress table."""
    elapsed = time.time() - started
    row = Row(event=event, session_id=session_id, total_files=total, processed=processed,
              files_per_second=processed / elapsed if elapsed > 0 else 0.0, message=message, payload=None)
    schema = ("event STRING, session_id BIGINT, total_files BIGINT, processed BIGINT, files_per_second DOUBLE, "
              "message STRING, payload STRING")
    return spark.createDataFrame([row], schema)


def stream_progress(query) -> list[dict]:
    """The recent micro-batches of a streaming query in the shape of progress rows."""
    return [
        {"event": "stream_progress", "batch": p["batchId"], "processed": p["numInputRows"],
         "files_per_second": p["processedRowsPerSecond"]}
        for p in query.recentProgress
    ]
