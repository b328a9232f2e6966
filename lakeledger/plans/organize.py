"""Organizing the files of a session: plan, logs, undo rows and the catalog afterwards."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, functions as F

from ..operators.organize import Organized, move_log, move_requests, moved_catalog, plan_moves, plan_preview
from ..session import cut_lineage


def organize(
    files: DataFrame,
    session_id: int,
    destination_base: str,
    existing: DataFrame,
    sources: DataFrame | None = None,
    dry_run: bool = False,
    categories: list[str] | None = None,
    route_by: str = "category",
    skip_in_place: bool = False,
    first_log_id: int = 1,
    now: float | None = None,
) -> Organized:
    """All outcomes of one organize run.

    The plan is written once, its log ids with it, so that logs and undo rows agree however often they
    are computed. ``first_log_id`` is the first id not in use.
    """
    requests = move_requests(files, destination_base, session_id, categories, route_by)
    if dry_run:
        plan = plan_preview(requests, existing, sources)
    else:
        plan = plan_moves(requests, existing, sources, skip_in_place)
    plan = plan.withColumn("dry_run", F.lit(dry_run)).withColumn(
        "log_id", F.monotonically_increasing_id() + F.lit(first_log_id)
    )
    plan = cut_lineage(plan)
    logs, undo = move_log(plan, session_id, time.time() if now is None else now, "log_id", dry_run)
    return Organized(plan, logs, undo, files if dry_run else moved_catalog(files, plan))
