"""Move plans: requests, preview, collision-free plan, logs, catalog update, outcome counts."""

from __future__ import annotations

from os.path import abspath
from posixpath import normpath
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import ERROR_COLLISIONS, ERROR_NO_SOURCE
from ..functions.paths import base_name, dir_name, join_path, normalize_path, numbered_name, stem, suffix
from ..functions.scalars import or_default
from .browse import in_categories, in_session
from .naming import assign_numbers, first_free_number

PLAN = ["id", "source", "destination", "success", "error", "was_renamed"]


def _clean_base(base: str) -> str:
    """The target folder without '.', '..' and doubled slashes; a store's address keeps its scheme."""
    if "://" in base:
        scheme, rest = base.split("://", 1)
        return f"{scheme}://{normpath(rest)}"
    return abspath(base)


def move_requests(
    files: DataFrame,
    destination_base: str,
    session_id: int | None = None,
    categories: list[str] | None = None,
    route_by: str = "category",
    normalize: bool = False,
) -> DataFrame:
    """(id, source, dest_dir) for the files of a session; ``route_by`` is ``category`` or ``target_folder``.

    Catalog paths are absolute; ``normalize`` also resolves '.', '..' and doubled slashes in paths and
    categories.
    """
    if session_id is not None:
        files = in_session(files, session_id)
    files = in_categories(files, categories)
    source, folder = F.col("path"), join_path(F.lit(_clean_base(destination_base)), or_default(route_by))
    if normalize:
        source, folder = normalize_path(source), normalize_path(folder)
    return files.select("id", source.alias("source"), folder.alias("dest_dir"))


def folder_entries(listing: DataFrame, path: str = "path") -> DataFrame:
    """(dest_dir, name) of listed paths: the occupancy that plans are made against."""
    return listing.select(dir_name(path).alias("dest_dir"), base_name(path).alias("name"))


def _with_source(requests: DataFrame, sources: DataFrame | None) -> DataFrame:
    """Mark requests whose source is in the listing (all of them without a listing)."""
    named = requests.withColumn("name", base_name("source"))
    if sources is None:
        return named.withColumn("_found", F.lit(True))
    there = sources.select(F.col("path").alias("source")).distinct().withColumn("_found", F.lit(True))
    return named.join(there, "source", "left").withColumn("_found", F.col("_found").isNotNull())


def _outcome(rows: DataFrame, number: Column) -> DataFrame:
    placed = F.concat(F.col("dest_dir"), F.when(F.col("dest_dir") == "/", F.lit("")).otherwise(F.lit("/")),
                      numbered_name(stem("name"), number, suffix("name")))
    return rows.select(
        "id",
        "source",
        F.when(F.col("_found") & number.isNotNull(), placed).otherwise(F.col("dest_dir")).alias("destination"),
        (F.col("_found") & number.isNotNull()).alias("success"),
        F.when(~F.col("_found"), F.lit(ERROR_NO_SOURCE))
        .when(number.isNull(), F.concat(F.lit(ERROR_COLLISIONS), F.col("source")))
        .alias("error"),
        F.coalesce(F.col("_found") & (number > 0), F.lit(False)).alias("was_renamed"),
    )


def plan_preview(requests: DataFrame, existing: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Dry run: every request against the existing files only, independent of the other requests."""
    return _outcome(first_free_number(_with_source(requests, sources), existing), F.col("number"))


def plan_moves(
    requests: DataFrame, existing: DataFrame, sources: DataFrame | None = None, skip_in_place: bool = False
) -> DataFrame:
    """The plan of a real run: requests in id order, each given the first name nobody holds.

    One row per request; a missing source or an exhausted name fails that row only. A file that is in
    its folder already collides with itself and is renamed; ``skip_in_place`` leaves such files out.
    """
    rows = _with_source(requests, sources)
    if skip_in_place:
        rows = rows.filter(dir_name("source") != F.col("dest_dir"))
    found = assign_numbers(rows.filter("_found"), existing)
    if sources is None:
        return _outcome(found, F.col("number"))
    lost = rows.filter(~F.col("_found")).withColumn("number", F.lit(None).cast("int"))
    return _outcome(found.unionByName(lost), F.col("number"))


def organize_summary(plan: DataFrame) -> DataFrame:
    return plan.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("success").alias("succeeded"),
        F.count_if(~F.col("success")).alias("failed"),
        F.count_if("was_renamed").alias("renamed"),
    )


def move_log(
    plan: DataFrame, session_id: int | Column, timestamp: float | Column, log_id: str | Column, dry_run: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Log and undo rows of a plan. A dry run logs its failures and nothing else.

    ``log_id`` must be unique over all logs: a column of the plan, such as the one ``organize`` writes.
    """
    def lit(value):
        return value if isinstance(value, Column) else F.lit(value)

    logged = plan.filter(~F.col("success")) if dry_run else plan
    log_id = F.col(log_id) if isinstance(log_id, str) else log_id
    logs = logged.select(
        log_id.alias("id"),
        F.col("source").alias("old_path"),
        F.col("destination").alias("new_path"),
        F.lit("move").alias("operation"),
        F.when(F.col("success"), F.lit("success")).otherwise(F.lit("failed")).alias("status"),
        lit(timestamp).cast("double").alias("timestamp"),
        lit(session_id).cast("bigint").alias("session_id"),
        F.col("error").alias("error_message"),
    )
    undo = logged.filter("success").select(
        log_id.alias("id"), log_id.alias("log_id"), F.col("source").alias("original_path"),
        F.lit(True).alias("can_undo"), F.lit(None).cast("double").alias("undone_at"),
    )
    return logs, undo


def moved_catalog(files: DataFrame, plan: DataFrame) -> DataFrame:
    """The catalog with path and name of the moved files replaced."""
    moved = plan.filter("success").select("id", F.col("destination").alias("_to"))
    new = {"path": F.coalesce("_to", "path"), "name": F.when(F.col("_to").isNull(), F.col("name")).otherwise(
        base_name("_to"))}
    return files.join(moved, "id", "left").select(*[new.get(c, F.col(c)).alias(c) for c in files.columns])


class Organized(NamedTuple):
    plan: DataFrame
    logs: DataFrame
    undo: DataFrame
    files: DataFrame
