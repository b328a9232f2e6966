"""Schemas of the stored tables, as DDL text, and the public column lists."""

from pyspark.sql import DataFrame


FILES = (
    "id BIGINT, path STRING NOT NULL, name STRING, extension STRING, size BIGINT, category STRING, "
    "last_modified DOUBLE, hash STRING, scan_session_id BIGINT, created_at DOUBLE"
)
SCAN_SESSIONS = (
    "id BIGINT, root_path STRING, started_at DOUBLE, completed_at DOUBLE, total_files BIGINT, status STRING"
)
LOGS = (
    "id BIGINT, old_path STRING, new_path STRING, operation STRING, status STRING, timestamp DOUBLE, "
    "session_id BIGINT, error_message STRING"
)
UNDO_HISTORY = ("id BIGINT, log_id BIGINT, original_path STRING, can_undo BOOLEAN, undone_at DOUBLE")
RULES = (
    "id BIGINT, name STRING, pattern STRING, match_type STRING, category STRING, target_folder STRING, "
    "priority INT, enabled BOOLEAN, created_at DOUBLE"
)
FS_EVENTS = (
    "root STRING, path STRING, kind STRING, dest_path STRING, is_directory BOOLEAN, event_id BIGINT, ts TIMESTAMP"
)



def columns(ddl: str) -> list[str]:
    return [field.split()[0] for field in ddl.split(", ")]


FILE_RESPONSE = "id path name extension size category last_modified hash scan_session_id".split()
LOG_RESPONSE = columns(LOGS)
RULE_RESPONSE = columns(RULES)
SESSION_RESPONSE = columns(SCAN_SESSIONS)

EVENT_KINDS = ["created", "deleted", "modified", "moved"]
MATCH_TYPES = ["glob", "regex", "extension"]


def respond(df: DataFrame, names: list[str]) -> DataFrame:
    """Project to the public column list (drops ``created_at``, undo fields, helper columns)."""
    return df.select(*names)
