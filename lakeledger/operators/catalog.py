"""The file catalog: records, incremental change detection, upsert, roots, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.paths import ancestors, base_name, dir_name, extension
from ..functions.scalars import rate
from ..session import cut_lineage
from .classify import default_category
from .filters import is_protected
from .ranking import dense_ids
from .skew import join_by_key

RECORD = ["name", "extension", "size", "category", "last_modified"]


def file_records(listing: DataFrame) -> DataFrame:
    """Listing rows (path, size, last_modified) with derived name, extension, category and link mark."""
    name = F.col("name") if "name" in listing.columns else base_name("path")
    symlink = F.col("is_symlink") if "is_symlink" in listing.columns else F.lit(False)
    return listing.select(
        *[c for c in ("id",) if c in listing.columns],
        "path",
        name.alias("name"),
        extension(name).alias("extension"),
        "size",
        "last_modified",
        default_category(extension(name)).alias("category"),
        symlink.alias("is_symlink"),
    )


def one_per_path(files: DataFrame) -> DataFrame:
    """One whole row per path, the newest (then largest) one; partial aggregation absorbs repeated paths."""
    rest = [c for c in files.columns if c != "path"]
    lead = [c for c in ("last_modified", "size") if c in rest]
    ordered = lead + [c for c in rest if c not in lead]
    folded = files.groupBy("path").agg(F.max(F.struct(*ordered)).alias("_row"))
    return folded.select(*[F.col("path") if c == "path" else F.col(f"_row.{c}").alias(c) for c in files.columns])


def union_roots(*listings: DataFrame) -> DataFrame:
    """Listings of several roots together; nested roots list a file twice, the path folds it."""
    both = listings[0]
    for listing in listings[1:]:
        both = both.unionByName(listing)
    return one_per_path(both)


def _known(catalog: DataFrame) -> DataFrame:
    """Path, mtime and size as change detection sees them: nulls count as 0."""
    return catalog.select(
        "path",
        F.coalesce("last_modified", F.lit(0.0)).alias("last_modified"),
        F.coalesce("size", F.lit(0)).cast("bigint").alias("size"),
    )


def incremental(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """The new and changed files: whatever has not the same path, mtime and size in the catalog.

    Path is the only join key, so that a catalog bucketed by path stays where it is; mtime and size are
    compared on the matches.
    """
    known = _known(catalog).toDF("_path", "_modified", "_size")
    same = (F.col("last_modified") == F.col("_modified")) & (F.col("size") == F.col("_size"))
    return files.join(known, (F.col("path") == F.col("_path")) & F.coalesce(same, F.lit(False)), "left_anti")


def _status(old: Column, new: Column, same: Column) -> Column:
    return (
        F.when(new.isNull(), F.lit("missing"))
        .when(old.isNull(), F.lit("new"))
        .when(same, F.lit("unchanged"))
        .otherwise(F.lit("changed"))
    )


def snapshot_diff(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """Every path of either side with its status: new, changed, unchanged or missing."""
    new = files.select("path", F.col("last_modified").alias("new_modified"), F.col("size").alias("new_size"),
                       F.lit(1).alias("_new"))
    old = _known(catalog).select("path", F.col("last_modified").alias("old_modified"),
                                 F.col("size").alias("old_size"), F.lit(1).alias("_old"))
    same = (F.col("old_modified") == F.col("new_modified")) & (F.col("old_size") == F.col("new_size"))
    return new.join(old, "path", "full_outer").select(
        "path", _status(F.col("_old"), F.col("_new"), same).alias("status"), "old_size", "new_size"
    )


def with_ids(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """Rows without an id get the numbers above the catalog's highest, in the order of their paths."""
    written = cut_lineage(rows)
    highest = catalog.agg(F.max("id")).first()[0]
    missing = written.filter(F.col("id").isNull())
    numbered = dense_ids(missing.drop("id"), ["path"], 0 if highest is None else highest + 1)
    return written.filter(F.col("id").isNotNull()).unionByName(numbered.select(*written.columns))


def give_ids(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """``files`` with the ``id`` that paths new to the catalog get, null for the others: the numbers above the catalog's highest, in the order of
    the new paths. Only those are written."""
    highest = catalog.agg(F.max("id")).first()[0]
    fresh = files.select("path").join(catalog.select("path"), "path", "left_anti")
    numbered = dense_ids(fresh, ["path"], 0 if highest is None else highest + 1)
    return files.join(numbered, "path", "left")


def scan_changes(catalog: DataFrame, compared: DataFrame, session_id: int, now: Column | None = None, forget_missing: bool = False) -> DataFrame:
    """The rows of a scan that a version of the catalog has to write (``VersionedTable.commit``).

    ``compared`` are the differences of the scanned records from the catalog (``VersionedTable.compare``): new and changed files take the
    record's values and the session, ids, hashes and creation times survive, new ones get ids. Missing files stay unless ``forget_missing`` makes tombstones of them.
    """
    kept = compared if forget_missing else compared.filter("status <> 'missing'")
    fresh = cut_lineage(kept).withColumn("_gone", F.col("status") == "missing")
    made = fresh.filter("status = 'new'").select("path")
    highest = catalog.agg(F.max("id")).first()[0]
    fresh = fresh.join(dense_ids(made, ["path"], 0 if highest is None else highest + 1, "_id"), "path", "left")
    record = set(RECORD) & set(compared.schema["_new"].dataType.names)
    out = []
    for column in catalog.columns:
        if column == "path":
            value = F.col("path")
        elif column in record:
            value = F.when(F.col("_gone"), F.col(f"_old.{column}")).otherwise(F.col(f"_new.{column}"))
        elif column == "scan_session_id":
            value = F.when(F.col("_gone"), F.col("_old.scan_session_id")).otherwise(F.lit(session_id).cast("bigint"))
        elif column == "id":
            value = F.coalesce("_old.id", "_id")
        elif column == "created_at" and now is not None:
            value = F.when(F.col("_old").isNull(), now).otherwise(F.col("_old.created_at"))
        else:
            value = F.col(f"_old.{column}")
        out.append(value.alias(column))
    return fresh.select(*out, "_gone")


def _merge(new: DataFrame, catalog: DataFrame, written: Column, now: Column | None) -> DataFrame:
    """Full outer join on path; ``written`` says which incoming rows overwrite."""
    if "id" in catalog.columns and "id" not in new.columns:
        new = cut_lineage(give_ids(new, catalog))
    incoming = new.select("path", *[F.col(c).alias(f"_new_{c}") for c in [*RECORD, "scan_session_id"]],
                          *([F.col("id").alias("_new_id")] if "id" in new.columns else []),
                          F.lit(True).alias("_new"))
    known = catalog.select("path", *[F.col(c).alias(f"_old_{c}") for c in catalog.columns if c != "path"],
                           F.lit(True).alias("_old"))
    joined = incoming.join(known, "path", "full_outer").withColumn("_write", F.col("_new").isNotNull() & written)
    given = F.col("_new_id") if "id" in new.columns else F.lit(None).cast("bigint")
    out = []
    for column in catalog.columns:
        if column == "path":
            value = F.col("path")
        elif column in (*RECORD, "scan_session_id"):
            value = F.when(F.col("_write"), F.col(f"_new_{column}")).otherwise(F.col(f"_old_{column}"))
        elif column == "id":
            value = F.coalesce(F.col("_old_id"), given)
        elif column == "created_at" and now is not None:
            value = F.when(F.col("_old").isNull(), now).otherwise(F.col("_old_created_at"))
        else:
            value = F.col(f"_old_{column}")
        out.append(value.alias(column))
    return joined.select(*out, "_write", F.col("_new").isNotNull().alias("_seen"))


def upsert_catalog(
    catalog: DataFrame, files: DataFrame, now: Column | None = None, unique: bool = False
) -> DataFrame:
    """The catalog after inserting or overwriting by path.

    Name, extension, size, category, mtime and session are overwritten (a null too); id, hash and
    creation time survive. Incoming rows are first reduced to one per path, unless they are ``unique``.
    """
    return _merge(files if unique else one_per_path(files), catalog, F.lit(True), now).drop("_write", "_seen")


def scan_merge(
    catalog: DataFrame, files: DataFrame, now: Column | None = None, incremental: bool = True, unique: bool = False
) -> DataFrame:
    """Change detection and upsert in one join on path: unchanged files keep their old row.

    ``_write`` marks the rows that are new or changed, ``_seen`` those the listing held. Without
    ``incremental`` every listed file is written. A listing of one walk has every path once; say ``unique``
    then, and it is not grouped before the join.
    """
    same = (
        F.col("_old").isNotNull()
        & F.coalesce(F.coalesce("_old_last_modified", F.lit(0.0)) == F.col("_new_last_modified"), F.lit(False))
        & F.coalesce(F.coalesce("_old_size", F.lit(0)) == F.col("_new_size"), F.lit(False))
    )
    return _merge(files if unique else one_per_path(files), catalog, ~same if incremental else F.lit(True), now)


def scan_stats(files: DataFrame, elapsed_seconds: float | None = None) -> DataFrame:
    """One row: files, directories, protected skips, errors, total bytes and the rate.

    A listing with directory rows has them counted as they are. Otherwise directories are those above the
    files, found from the distinct parents, so that the expansion to all ancestors works on directories.
    """
    protected = is_protected("path")
    error = F.col("error") if "error" in files.columns else F.lit(None).cast("string")
    pruned = F.coalesce(error == "protected", F.lit(False))
    walked = "is_directory" in files.columns
    regular = ~F.col("is_directory") if walked else F.lit(True)
    good = ~protected & error.isNull()
    counts = [
        F.count_if(good & regular).alias("total_files"),
        F.count_if((protected & regular) | pruned).alias("skipped_protected"),
        F.count_if(error.isNotNull() & ~pruned & ~protected).alias("skipped_errors"),
        F.coalesce(F.sum(F.when(good & regular, F.col("size"))), F.lit(0)).cast("bigint").alias("total_bytes"),
    ]
    if walked:
        stats = files.agg(*counts, F.count_if(good & ~regular).alias("total_dirs"))
    else:
        parents = files.filter(good).select(dir_name("path").alias("directory")).distinct()
        directories = (
            parents.select(F.explode(ancestors("directory")).alias("directory"))
            .distinct()
            .agg(F.count(F.lit(1)).alias("total_dirs"))
        )
        # two one-row results side by side
        one = F.lit(1)
        stats = files.agg(*counts).withColumn("_one", one).join(directories.withColumn("_one", one), "_one").drop("_one")
    if elapsed_seconds is None:
        return stats
    return stats.withColumn("elapsed_seconds", F.lit(float(elapsed_seconds))).withColumn(
        "files_per_second", rate("total_files", "elapsed_seconds")
    )


def list_sessions(sessions: DataFrame) -> DataFrame:
    """Newest first."""
    return sessions.orderBy(F.desc("id"))


def latest_session(sessions: DataFrame) -> DataFrame:
    return sessions.orderBy(F.desc("id")).limit(1)


def session_durations(sessions: DataFrame) -> DataFrame:
    """Sessions with their duration and files per second."""
    return sessions.withColumn("duration", F.col("completed_at") - F.col("started_at")).withColumn(
        "files_per_second", F.coalesce(rate("total_files", "duration"), F.lit(0.0))
    )


def session_files(files: DataFrame, sessions: DataFrame) -> DataFrame:
    """Files with the status and roots of their session; orphans stay with nulls."""
    known = sessions.select(F.col("id").alias("scan_session_id"), F.col("status").alias("session_status"),
                            "root_path")
    return join_by_key(files, known, ["scan_session_id"], "left")


def drop_session(files: DataFrame, sessions: DataFrame, session_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove sessions; their files stay, with the session set to null.

    ``session_ids`` has one column ``id``. Gives (files, sessions).
    """
    gone = session_ids.select(F.col("id").alias("scan_session_id")).distinct().withColumn("_gone", F.lit(True))
    kept = join_by_key(files, gone, ["scan_session_id"], "left").select(
        *[F.when(F.col("_gone").isNull(), F.col(c)).alias(c) if c == "scan_session_id" else F.col(c)
          for c in files.columns]
    )
    return kept, sessions.join(session_ids.select("id").distinct(), "id", "left_anti")
