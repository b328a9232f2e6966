"""File-inventory analytics on Spark DataFrames."""

from .session import apply_settings, build_session, cut_lineage, run_scope

__all__ = ["apply_settings", "build_session", "cut_lineage", "run_scope"]
