"""Undo of logged moves, as a plan."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from ..constants import ERROR_COLLISIONS, ERROR_NO_SOURCE
from ..functions.paths import base_name, dir_name, numbered_name, stem, suffix
from ..session import cut_lineage
from .naming import assign_numbers
from .organize import folder_entries


def undo_candidates(logs: DataFrame, undo: DataFrame, log_ids: DataFrame | None = None) -> DataFrame:
    """Log rows that can still be undone, with their original path; ``log_ids`` has one column ``id``."""
    if log_ids is not None:
        logs = logs.join(log_ids.select("id").distinct(), "id", "left_semi")
    entries = undo.filter("can_undo").select(F.col("log_id").alias("id"), "original_path")
    return logs.join(entries, "id").select(
        F.col("id").alias("log_id"), "original_path", F.col("new_path").alias("current_path"), "session_id"
    )


def plan_undo(candidates: DataFrame, listing: DataFrame) -> DataFrame:
    """Where each file goes back to: (log_id, original_path, current_path, target, success, error).

    The original path when it is free; the first claim by log id has it. Otherwise a numbered variant of
    the *current* name in the original folder. Original paths are given out first, so a variant never
    takes a place another file of the batch returns to. A file that several logs name goes back once, for the
    lowest log id; for the others it is no longer there.
    """
    there = listing.select("path").distinct()
    found = there.select(F.col("path").alias("current_path"), F.lit(True).alias("_found"))
    rows = candidates.join(found, "current_path", "left").select(
        "log_id", "original_path", "current_path", F.col("_found").isNotNull().alias("_found"))
    owners = rows.filter("_found").groupBy("current_path").agg(F.min("log_id").alias("log_id"))
    rows = rows.join(owners.select("log_id", F.lit(True).alias("_owner")), "log_id", "left").withColumn(
        "_found", F.col("_owner").isNotNull()).drop("_owner")
    # one claim per path, however many logs name it; only claims are looked up in the listing, and they are
    # joined back by log id
    first = (
        rows.filter("_found")
        .groupBy("original_path")
        .agg(F.min("log_id").alias("log_id"))
        .join(there.withColumnRenamed("path", "original_path"), "original_path", "left_anti")
        .select("log_id", F.lit(True).alias("_first"))
    )
    claimed = cut_lineage(rows.join(first, "log_id", "left").withColumn("_first", F.col("_first").isNotNull()))
    restored = claimed.filter("_first").withColumn("target", F.col("original_path"))
    others = claimed.filter(F.col("_found") & ~F.col("_first")).select(
        F.col("log_id").alias("id"), "original_path", "current_path",
        dir_name("original_path").alias("dest_dir"), base_name("current_path").alias("name"),
    )
    taken = folder_entries(listing.select("path")).unionByName(folder_entries(restored, "original_path"))
    variant = numbered_name(stem("name"), F.col("number"), suffix("name"))
    renamed = assign_numbers(others, taken).select(
        F.col("id").alias("log_id"), "original_path", "current_path",
        F.when(F.col("number").isNotNull(), F.concat_ws(
            "/", F.when(F.col("dest_dir") == "/", F.lit("")).otherwise(F.col("dest_dir")), variant)).alias("target"),
    )
    lost = claimed.filter(~F.col("_found")).withColumn("target", F.lit(None).cast("string"))
    columns = ["log_id", "original_path", "current_path", "target"]
    failed = F.when(F.col("target").isNull(), F.concat(F.lit(ERROR_COLLISIONS), F.col("current_path")))
    done = restored.select(*columns).unionByName(renamed).withColumn("error", failed)
    missing = lost.select(*columns).withColumn("error", F.lit(ERROR_NO_SOURCE))
    return done.unionByName(missing).select(
        "log_id", "original_path",
        F.coalesce("target", "current_path").alias("current_path"),
        F.col("error").isNull().alias("success"),
        "error",
        F.col("current_path").alias("moved_from"),
    )


def undo_summary(results: DataFrame) -> DataFrame:
    """Eligible rows (not requested ids), and how they went."""
    return results.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("success").alias("succeeded"),
        F.count_if(~F.col("success")).alias("failed"),
    )


class Undone(NamedTuple):
    results: DataFrame
    logs: DataFrame
    undo: DataFrame
    files: DataFrame | None


def undo_moves(
    logs: DataFrame,
    undo: DataFrame,
    listing: DataFrame,
    now: float,
    log_ids: DataFrame | None = None,
    files: DataFrame | None = None,
) -> Undone:
    """Undo plan with the tables after it: logs ``undone``, undo rows used up, catalog paths put right."""
    results = cut_lineage(plan_undo(undo_candidates(logs, undo, log_ids), listing))
    done = results.filter("success")
    ids = done.select(F.col("log_id").alias("id"), F.lit(True).alias("_done"))
    new_logs = logs.join(ids, "id", "left").select(
        *[F.when(F.col("_done"), F.lit("undone")).otherwise(F.col(c)).alias(c) if c == "status" else F.col(c)
          for c in logs.columns]
    )
    used = {
        "can_undo": F.when(F.col("_done"), F.lit(False)).otherwise(F.col("can_undo")),
        "undone_at": F.when(F.col("_done"), F.lit(float(now))).otherwise(F.col("undone_at")),
    }
    new_undo = undo.join(ids.withColumnRenamed("id", "log_id"), "log_id", "left").select(
        *[used.get(c, F.col(c)).alias(c) for c in undo.columns]
    )
    new_files = None
    if files is not None:
        back = done.select(F.col("moved_from").alias("path"), F.col("current_path").alias("_to"))
        put = {"path": F.coalesce("_to", "path"),
               "name": F.when(F.col("_to").isNull(), F.col("name")).otherwise(base_name("_to"))}
        new_files = files.join(back, "path", "left").select(*[put.get(c, F.col(c)).alias(c) for c in files.columns])
    return Undone(results, new_logs, new_undo, new_files)
