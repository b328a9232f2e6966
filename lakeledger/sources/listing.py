"""File listings.

``list_files`` uses Spark's binary-file source: right for object stores and HDFS, but it leaves out
names starting with '.' or '_' and follows file links. ``list_tree`` walks directories exactly (hidden
names listed, links not followed) on a file system every executor mounts.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..constants import PROTECTED_UNIX
from ..functions.paths import base_name, extension
from ..functions.scalars import to_epoch
from ..session import cut_lineage

LISTING_SCHEMA = (
    "path STRING, name STRING, size BIGINT, last_modified DOUBLE, is_symlink BOOLEAN, is_directory BOOLEAN, "
    "error STRING"
)


def list_files(spark: SparkSession, *roots: str) -> DataFrame:
    """Path, name, extension, size and mtime of every file below ``roots``; content is never read."""
    found = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(list(roots))
        .select(
            F.regexp_replace("path", r"^file:/+", "/").alias("path"),
            F.col("length").alias("size"),
            to_epoch("modificationTime").alias("last_modified"),
        )
    )
    return found.select(
        "path", base_name("path").alias("name"), extension(base_name("path")).alias("extension"), "size",
        "last_modified",
    )


def _under(path: str, roots: list[str]) -> bool:
    return any(path == root or path.startswith(root.rstrip("/") + "/") for root in roots)


def _list_directory(directory: str, protected: list[str]) -> Iterator[tuple]:
    try:
        with os.scandir(directory) as entries:
            for entry in entries:
                try:
                    info = entry.stat(follow_symlinks=False)
                except OSError as error:
                    yield entry.path, entry.name, None, None, False, False, str(error)
                    continue
                is_dir = stat.S_ISDIR(info.st_mode)
                if is_dir and _under(entry.path, protected):
                    yield entry.path, entry.name, None, None, False, True, "protected"
                elif is_dir or stat.S_ISREG(info.st_mode):
                    yield entry.path, entry.name, info.st_size, info.st_mtime, False, is_dir, None
    except OSError as error:
        yield directory, os.path.basename(directory), None, None, False, True, str(error)


def _lister(protected: list[str], batch_rows: int = 10_000):
    columns = [field.split()[0] for field in LISTING_SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        for batch in batches:
            for directory in batch["path"]:
                for row in _list_directory(directory, protected):
                    rows.append(row)
                    if len(rows) >= batch_rows:
                        yield pd.DataFrame(rows, columns=columns).astype({"size": "Int64"})
                        rows = []
        if rows:
            yield pd.DataFrame(rows, columns=columns).astype({"size": "Int64"})

    return run


def list_tree(
    spark: SparkSession, roots: list[str], protected: list[str] = PROTECTED_UNIX, tasks: int | None = None
) -> DataFrame:
    """Exact listing of ``roots``: regular files, directories, and rows with ``error`` for what was skipped.

    One Spark job per tree level lists all directories of that level, spread over the cluster again
    every time, so one huge sub-tree never stays in one task. Protected directories are pruned before
    they are entered. Each level is written once (a directory is not listed again after a lost executor).
    """
    tasks = tasks or spark.sparkContext.defaultParallelism
    roots = sorted({os.path.abspath(root) for root in roots})
    # a root below another root is reached by the walk anyway; it must not be listed twice
    top = [r for r in roots if not any(r != other and _under(r, [other]) for other in roots)]
    skipped = [r for r in top if _under(r, protected)]
    level = spark.createDataFrame([(r,) for r in top if r not in skipped], "path STRING")
    listed = spark.createDataFrame(
        [(r, os.path.basename(r), None, None, False, True, "protected") for r in skipped], LISTING_SCHEMA
    )
    while True:
        entries = cut_lineage(level.repartition(tasks).mapInPandas(_lister(list(protected)), LISTING_SCHEMA))
        listed = listed.unionByName(entries)
        level = entries.filter(F.col("is_directory") & F.col("error").isNull()).select("path")
        if level.isEmpty():
            return listed.withColumn("extension", extension("name"))


def listed_files(listing: DataFrame) -> DataFrame:
    """The regular files of a listing."""
    return listing.filter(~F.col("is_directory") & F.col("error").isNull())
