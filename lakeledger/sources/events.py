"""Change-event feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schemas import FS_EVENTS


def read_events(spark: SparkSession, path: str, fmt: str = "json", stream: bool = True, **options) -> DataFrame:
    """File events of a feed folder with the fixed schema; directory events are dropped."""
    reader = spark.readStream if stream else spark.read
    return files_only(reader.format(fmt).schema(FS_EVENTS).options(**options).load(path))


def parse_events(raw: DataFrame, value: str = "value") -> DataFrame:
    """Events from a JSON text column, as a message queue source delivers them."""
    record = F.from_json(F.col(value).cast("string"), FS_EVENTS)
    return files_only(raw.select(record.alias("e")).select("e.*"))


def files_only(events: DataFrame) -> DataFrame:
    """Drop directory events (an event without the mark counts as a file event)."""
    if "is_directory" not in events.columns:
        return events
    return events.filter(~F.coalesce(F.col("is_directory"), F.lit(False)))
