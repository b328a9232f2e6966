"""The scan: listing to catalog, with session row and statistics."""

from __future__ import annotations

import time
from typing import NamedTuple

from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from ..constants import PROTECTED_UNIX
from ..operators.catalog import file_records, scan_merge, scan_stats
from ..operators.filters import exclude_globs, exclude_prefixes, not_protected, regular_files
from ..schemas import SCAN_SESSIONS
from ..session import cut_lineage


class Scanned(NamedTuple):
    catalog: DataFrame
    session: DataFrame
    stats: DataFrame


def clean_roots(roots: list[str]) -> list[str]:
    """Trimmed roots; none at all, or a blank one, is refused."""
    if not roots or any(not r.strip() for r in roots):
        raise ValueError("paths must not be empty")
    return [r.strip() for r in roots]


def scan_records(
    listing: DataFrame,
    exclude: list[str] | None = None,
    prefixes: list[str] | None = None,
    protected: list[str] = PROTECTED_UNIX,
) -> DataFrame:
    """File records of a listing: narrow work only, pushed into the scan where the source allows."""
    files = not_protected(regular_files(listing), protected)
    if prefixes:
        files = exclude_prefixes(files, prefixes)
    records = file_records(files)
    return exclude_globs(records, exclude) if exclude else records


def scan_catalog(
    catalog: DataFrame, listing: DataFrame, session_id: int, incremental: bool = True, unique: bool = False, **filters
) -> DataFrame:
    """The catalog after a scan, with ``_write`` on the rows the scan changed.

    Change detection and upsert share one join on path; a catalog saved bucketed by path is not
    shuffled for it. Unchanged files keep their old session.
    """
    records = scan_records(listing, **filters).withColumn("scan_session_id", F.lit(session_id).cast("bigint"))
    return scan_merge(catalog, records, incremental=incremental, unique=unique)


def session_row(
    spark: SparkSession, session_id: int, roots: list[str], started: float, completed: float | None, total: int | None,
    status: str,
) -> DataFrame:
    """A row of the sessions table."""
    row = Row(id=session_id, root_path=",".join(roots), started_at=started, completed_at=completed,
              total_files=total, status=status)
    return spark.createDataFrame([row], SCAN_SESSIONS)


def scan(
    catalog: DataFrame,
    listing: DataFrame,
    session_id: int,
    roots: list[str],
    incremental: bool = True,
    unique: bool = False,
    **filters,
) -> Scanned:
    """Run a scan and give the new catalog, the finished session row and the statistics.

    The listing is walked and written once, so statistics and total speak of the same files; the merged rows are written once too, and the session
    total (new and changed files) is counted from them.
    """
    spark, started = catalog.sparkSession, time.time()
    roots = clean_roots(roots)
    try:
        listing = cut_lineage(listing)
        merged = cut_lineage(scan_catalog(catalog, listing, session_id, incremental, unique, **filters))
        total = merged.filter("_write").count()
    except Exception as error:
        failed = session_row(spark, session_id, roots, started, None, None, "failed")
        raise ScanFailed(failed) from error
    done = time.time()
    session = session_row(spark, session_id, roots, started, done, total, "done")
    return Scanned(merged.drop("_write", "_seen"), session, scan_stats(listing, done - started))


class ScanFailed(RuntimeError):
    """The scan did not finish; ``session`` is the row to record."""

    def __init__(self, session: DataFrame):
        super().__init__("scan failed")
        self.session = session
