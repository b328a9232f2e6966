"""Registered queries: every operator over the views of the given tables."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import paths as P, scalars as S
from ..operators import browse as B, catalog as C, classify as K, dedup as D, filters as X, indexes as I, logs as L, organize as O
from ..operators import rules as R, stats as A, undo as U
from ..operators.ranking import dense_ids
from ..schemas import FILE_RESPONSE, LOG_RESPONSE, RULE_RESPONSE, respond
from ..session import apply_settings, checkpoint_folder, cut_lineage
from ..sources import events as V, versions as T
from ..streaming import changes as G, debounce as E
from .organize import organize
from .scan import scan as scan_run, scan_catalog
from .views import view

GAP = 12 * 3600
ONE_ROOT_GAP = 240      # seconds; the events of all users together leave few longer gaps
TARGET = "/org"
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(apply_settings(spark), sf_dir.rstrip("/"))

    QUERIES[function.__name__] = run
    return function


def _hashed(spark, sf):
    """Files with the hashes of their content, in one pass over the documents."""
    files = view(spark, sf, "files_text_v").select("id", "path", "size", F.col("text").alias("content"))
    return D.with_hashes(files)


def _placed(rows, *order):
    """Sorted rows with their place in the order, as readers compare tables as sets."""
    return dense_ids(rows, list(order), 1, "position")


# ---- records, paths, scalars


@query
def file_records(spark, sf):
    return C.file_records(view(spark, sf, "files_v").select("id", "path", "size", "last_modified"))


@query
def path_parts(spark, sf):
    path = F.regexp_replace("url", "^https?://[^/]+", "")
    parts = view(spark, sf, "pages").select("page_id", path.alias("path")).withColumn("name", P.base_name("path"))
    return parts.select(
        "page_id", "name", P.dir_name("path").alias("directory"), P.stem("name").alias("stem"),
        P.suffix("name").alias("suffix"), P.extension("name").alias("extension"),
        P.join_path(F.lit("/web"), P.stem("name")).alias("joined"),
        P.numbered_name(P.stem("name"), F.lit(3), P.suffix("name")).alias("numbered"),
    )


@query
def normalize_paths(spark, sf):
    path = F.regexp_replace("url", "^https?://[^/]+", "")
    messy = F.concat(F.lit("/web/.//tmp/../"), path, F.lit("/x/.."))
    return view(spark, sf, "pages").select("page_id", P.normalize_path(messy).alias("path"))


@query
def roots_roundtrip(spark, sf):
    files = view(spark, sf, "files_v").select("id", P.dir_name("path").alias("directory"), "path")
    text = P.roots_text(F.array(F.concat(F.lit(" "), F.col("directory")), F.col("path")))
    listed = files.select("id", text.alias("root_path"))
    return listed.select(
        "id", "root_path", P.roots_valid(P.roots_list("root_path")).alias("valid"),
        F.array_join(P.roots_list("root_path"), "|").alias("roots"),
        P.roots_valid(F.array("root_path", F.lit(" "))).alias("with_blank"),
    )


@query
def epoch_times(spark, sf):
    ts = F.col("ts").cast("timestamp")
    return view(spark, sf, "events").select(
        "event_id", F.unix_micros(S.to_ts(S.to_epoch(ts))).alias("micros"),
        S.display_time(F.floor(S.to_epoch(ts))).alias("shown"),
    )


@query
def format_bytes(spark, sf):
    size = F.col("o_orderkey") * F.lit(97003)
    return view(spark, sf, "orders").select(
        "o_orderkey", S.format_bytes(size).alias("big"), S.format_bytes(F.col("o_custkey")).alias("small"),
        S.format_bytes(F.nullif(F.col("o_custkey"), F.col("o_custkey"))).alias("none"),
    )


@query
def fingerprints(spark, sf):
    files = view(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return D.with_hashes(files).select("id", "head_hash", "hash")


# ---- filters


@query
def not_protected(spark, sf):
    return X.not_protected(view(spark, sf, "places_v"), normalize=True)


@query
def not_below(spark, sf):
    # every directory that holds an executable, and some files by their own path
    files = view(spark, sf, "files_v").select("id", "path")
    kept_out = view(spark, sf, "files_v").filter("extension = '.exe'").select(P.dir_name("path").alias("path"))
    some = view(spark, sf, "files_v").filter("name = 'doc_03.py'").select("path")
    return X.not_below(files, kept_out.unionByName(some))


@query
def exclude_prefixes(spark, sf):
    return X.exclude_prefixes(view(spark, sf, "places_v"), ["/etc", "/home/etc/1-URGENT"])


@query
def exclude_prefix_table(spark, sf):
    files = view(spark, sf, "files_v").select("id", "path", "name")
    return X.exclude_prefix_table(files, view(spark, sf, "prefixes_v"))


@query
def longest_prefixes(spark, sf):
    return X.longest_prefixes(view(spark, sf, "files_v"), view(spark, sf, "prefixes_v"))


@query
def exclude_glob_table(spark, sf):
    files = view(spark, sf, "files_v").select("id", "path", "name")
    return X.exclude_glob_table(files, view(spark, sf, "prefixes_v"))


@query
def exclude_globs(spark, sf):
    files = view(spark, sf, "files_v").select("id", "path", "name")
    return X.exclude_globs(files, ["*.xyz", "DOC_0[0-3]*", "*/src1/*", "tax_20?4.*"])


# ---- classification and rules


@query
def classify_default(spark, sf):
    return K.classify_default(view(spark, sf, "files_v")).select("id", "name", "category")


def _classified(spark, sf, form):
    files = view(spark, sf, "files_v").select("id", "name", "extension")
    return K.classify(files, view(spark, sf, "rules_v"), form)


@query
def classify_rules(spark, sf):
    return _classified(spark, sf, "fold")


@query
def classify_rules_vectorised(spark, sf):
    return _classified(spark, sf, "vectorised")


@query
def classify_part_rules(spark, sf):
    files = view(spark, sf, "files_v").select("id", "name", "extension")
    return K.classify(files, view(spark, sf, "name_rules_v"))


@query
def classify_many_rules(spark, sf):
    """A rule table about as large as the table of names, nearly every pattern another."""
    return K.classify(view(spark, sf, "order_files_v"), view(spark, sf, "many_rules_v"), "table")


@query
def many_rule_hits(spark, sf):
    hits = K.rule_matches(view(spark, sf, "order_files_v"), view(spark, sf, "many_rules_v"), "table", counted=True)
    return hits.groupBy("rule_id", "rule_name").agg(F.coalesce(F.sum("n_files"), F.lit(0)).alias("n_files"))


@query
def rule_quarantine(spark, sf):
    return R.quarantined_rules(view(spark, sf, "name_rules_v")).select("id", "pattern")


@query
def classify_with_fallback(spark, sf):
    files = view(spark, sf, "files_v").select("id", "name", "extension")
    guess = lambda name, ext: F.when(ext == "", F.concat(F.lit("Guess "), F.substring(name, 1, 3)))
    return K.classify(files, view(spark, sf, "rules_v"), fallback=guess).select("id", "category", "confidence")


@query
def rule_hits(spark, sf):
    return K.rule_hits(view(spark, sf, "files_v"), view(spark, sf, "rules_v"))


@query
def classify_rules_join(spark, sf):
    return K.best_matches(view(spark, sf, "files_v"), view(spark, sf, "rules_v"))


@query
def validate_rules(spark, sf):
    checked = R.validate_rules(view(spark, sf, "part_rules_v"))
    return checked.select("id", "is_valid", F.array_join("reasons", "; ").alias("reasons"))


@query
def scan_new_ids(spark, sf):
    """New files get the numbers above the catalog's highest in the order of their paths."""
    old = view(spark, sf, "old_catalog_v")
    new = C.file_records(view(spark, sf, "files_v").select("path", "size", "last_modified")).drop("is_symlink")
    new = new.withColumn("scan_session_id", F.lit(9).cast("bigint"))
    return C.upsert_catalog(old, new).select("id", "path", "size", "scan_session_id")


def _maintained(spark, sf):
    """Accepted rules, changed by the events of the rules' numbers."""
    table = R.validate_rules(view(spark, sf, "part_rules_v")).filter("is_valid").drop("is_valid", "reasons")
    op = F.expr("CASE event_type WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'upsert' ELSE 'update' END")
    changes = view(spark, sf, "events").select(
        F.col("user_id").alias("id"), F.col("event_id").alias("seq"), op.alias("op"),
        F.when(F.col("event_type") == "click", (F.col("event_id") % 2000).cast("int")).alias("priority"),
        F.when(F.col("event_type") == "signup", F.lit("*.new")).alias("pattern"))
    return R.maintain_rules(table, changes)


@query
def maintain_rules(spark, sf):
    return _maintained(spark, sf)[0].select("id", "name", "pattern", "priority")


@query
def rejected_rules(spark, sf):
    return _maintained(spark, sf)[1].select("id", F.array_join("reasons", "; ").alias("reasons"))


@query
def list_rules(spark, sf):
    rules = view(spark, sf, "part_rules_v").withColumn("created_at", F.lit(1.6e9))
    return _placed(respond(R.list_rules(rules), RULE_RESPONSE), F.desc("priority"), F.asc("id"))


@query
def apply_changes(spark, sf):
    table = view(spark, sf, "catalog_v").select("id", "name", "size", "category")
    op = F.expr("CASE event_type WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'create' WHEN 'click' THEN 'upsert' "
                "ELSE 'update' END")
    changes = view(spark, sf, "events").select(
        (F.col("user_id") * 7).alias("id"), F.col("event_id").alias("seq"), op.alias("op"),
        F.when(F.col("event_type") != "view", F.floor(F.col("value")).cast("bigint")).alias("size"),
        F.when(F.col("event_type") == "view", F.col("props")).alias("category"),
    )
    return R.apply_changes(table, changes, defaults={"name": "unnamed", "category": "Others"})


# ---- catalog


@query
def union_roots(spark, sf):
    files = view(spark, sf, "files_v").select("path", "name", "size", "last_modified")
    return C.union_roots(files, files.filter(X.is_under("path", "/data/src1")))


@query
def incremental(spark, sf):
    files = view(spark, sf, "files_v").select("path", "size", "last_modified")
    return C.incremental(files, view(spark, sf, "cache_v"))


@query
def snapshot_diff(spark, sf):
    return C.snapshot_diff(view(spark, sf, "files_v"), view(spark, sf, "old_catalog_v"))


def _incoming(spark, sf):
    return K.classify_default(view(spark, sf, "files_v")).withColumn("scan_session_id", F.lit(9).cast("bigint"))


@query
def upsert_catalog(spark, sf):
    now = F.lit(1700000000.0)
    return C.upsert_catalog(view(spark, sf, "old_catalog_v"), _incoming(spark, sf), now)


def _versions(spark, sf):
    """A store with the old catalog as its first version, and the records of a listing that agrees with it in most folders."""
    folder = f"{checkpoint_folder(spark)}/versions-{uuid.uuid4().hex}"
    old = view(spark, sf, "calm_catalog_v")
    store = T.VersionedTable(spark, folder, old.schema, ["last_modified", "size"])
    store.create(old)
    listing = view(spark, sf, "files_v").select("path", "size", "last_modified")
    return store, C.file_records(listing).drop("is_symlink")


@query
def catalog_versions(spark, sf):
    """Two scans as versions of changed rows, the second one over what the first left; missing files go in the second."""
    store, records = _versions(spark, sf)
    part = records.filter(~F.col("path").contains("/src3/"))
    store.commit(C.scan_changes(store.read(), store.compare(part), 8), 1)
    store.commit(C.scan_changes(store.read(), store.compare(records), 9, F.lit(1700000000.0), forget_missing=True), 2)
    return store.read()


@query
def snapshot_diff_digests(spark, sf):
    """New, changed and missing files, from the buckets whose digests differ."""
    store, records = _versions(spark, sf)
    return store.compare(records).select("path", "status", F.col("_old.size").alias("old_size"), F.col("_new.size").alias("new_size"))


@query
def scan(spark, sf):
    listing = view(spark, sf, "files_v").select("id", "path", "size", "last_modified")
    merged = scan_catalog(view(spark, sf, "old_catalog_v"), listing, 9, exclude=["*/src3/*"])
    return merged.select("path", "id", "name", "size", "category", "last_modified", "hash", "scan_session_id",
                         F.col("_write").alias("written"))


@query
def scan_session_row(spark, sf):
    """The session that a scan records: new and changed files are counted from the merged table."""
    listing = view(spark, sf, "files_v").select("id", "path", "size", "last_modified")
    done = scan_run(view(spark, sf, "old_catalog_v"), listing, 9, [" /data ", "/more"], exclude=["*/src3/*"])
    finished = (F.col("completed_at") >= F.col("started_at")).alias("finished")
    return done.session.select("id", "root_path", "total_files", "status", finished)


@query
def regular_files(spark, sf):
    """A listing with the marks of links, directories and unreadable places."""
    marks = view(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "P", F.lit("denied")).alias("error"),
        (F.col("o_custkey") % 5 == 0).alias("is_symlink"),
        F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey") % 3 == 1).alias("is_directory"))
    return X.regular_files(marks).select("id")


@query
def scan_stats(spark, sf):
    return C.scan_stats(view(spark, sf, "files_v").unionByName(
        view(spark, sf, "places_v"), allowMissingColumns=True))


@query
def list_sessions(spark, sf):
    return _placed(C.list_sessions(view(spark, sf, "sessions_v")), F.desc("id"))


@query
def latest_session(spark, sf):
    return C.latest_session(view(spark, sf, "sessions_v"))


@query
def session_durations(spark, sf):
    sessions = C.session_durations(view(spark, sf, "sessions_v"))
    return sessions.select("id", "duration", F.round("files_per_second", 9).alias("files_per_second"))


@query
def session_files(spark, sf):
    # session 9 is not in the sessions table
    files = view(spark, sf, "files_v").select("id", F.when(F.col("extension") == ".zip", F.lit(9)).otherwise(
        F.col("scan_session_id")).alias("scan_session_id"))
    return C.session_files(files, view(spark, sf, "sessions_v"))


@query
def drop_session(spark, sf):
    sessions = view(spark, sf, "sessions_v")
    gone = sessions.filter(F.col("started_at") > 1704067200).select("id")
    files, _ = C.drop_session(view(spark, sf, "files_v"), sessions, gone)
    return files.select("id", "path", "scan_session_id")


# ---- browsing and statistics


def _catalog(spark, sf):
    return view(spark, sf, "catalog_v").withColumn("hash", F.lit(None).cast("string"))


@query
def browse(spark, sf):
    return B.browse(_catalog(spark, sf), 2, sort_by="size", sort_order="desc", limit=200).select(*FILE_RESPONSE)


@query
def browse_search(spark, sf):
    return B.browse(_catalog(spark, sf), 1, term=" INVOICE_0_ ", sort_by="name", limit=500, offset=3).select("id", "name")


@query
def search_index(spark, sf):
    """``browse_search`` by postings; several terms, one too short for the index."""
    files = _catalog(spark, sf)
    index = I.SearchIndex(spark, f"{checkpoint_folder(spark)}/search-{uuid.uuid4().hex}", buckets=32)
    index.build(files)
    found = [index.search(B.in_session(files, 1), term, literal).select(F.lit(term).alias("term"), "id", "name")
             for term, literal in ((" INVOICE_0_ ", False), ("src1%.TXT", False), ("_(1)", True), ("f", False))]
    return functools.reduce(DataFrame.unionByName, found)


@query
def browse_deep(spark, sf):
    """A page far into a sorted copy."""
    files = view(spark, sf, "order_files_v").withColumn("scan_session_id", F.pmod("id", F.lit(2)).cast("bigint"))
    index = I.RankIndex(spark, f"{checkpoint_folder(spark)}/rank-{uuid.uuid4().hex}", "name", descending=True)
    index.build(files, 16)
    return index.page(1, 6_000, 200)


@query
def browse_category(spark, sf):
    return B.browse(_catalog(spark, sf), 3, category="Documents", sort_by="last_modified").select("id", "path")


@query
def browse_page(spark, sf):
    return B.browse_page(_catalog(spark, sf), 1, 99_999, sort_by="path").select("id", "path")


@query
def browse_after(spark, sf):
    return B.browse_after(_catalog(spark, sf), 2, "doc_03.mp4", 40, sort_by="name", limit=1000).select("id", "name")


@query
def browse_total(spark, sf):
    return B.browse_total(_catalog(spark, sf), 1, term="tax")


@query
def page_counts(spark, sf):
    totals = A.category_counts(_catalog(spark, sf))
    return totals.select("category", S.page_count("n_files").alias("pages"))


@query
def by_id(spark, sf):
    return B.by_id(_catalog(spark, sf), 84).select("id", "path", "size", "category")


@query
def category_list(spark, sf):
    return B.category_list(_catalog(spark, sf))


@query
def session_stats(spark, sf):
    return A.session_stats(view(spark, sf, "old_catalog_v"), 0)


@query
def session_stats_map(spark, sf):
    one = A.session_stats_map(view(spark, sf, "old_catalog_v"), 0)
    return one.select("session_id", "total_files", F.to_json("categories").alias("categories"))


@query
def category_share(spark, sf):
    return A.category_share(_catalog(spark, sf))


# ---- duplicates


@query
def dup_stage1(spark, sf):
    return D.dup_stage1(view(spark, sf, "files_v").select("id", "path", "size"))


@query
def dup_stage2(spark, sf):
    return D.dup_stage2(D.write_hashes(_hashed(spark, sf))).select("id", "path", "size", "head_hash")


@query
def duplicates(spark, sf):
    return D.duplicate_groups(_hashed(spark, sf)).select("fingerprint", "size", "n_files", "wasted_bytes", "keep_id")


@query
def dup_members(spark, sf):
    return D.dup_members(D.write_hashes(_hashed(spark, sf)))


@query
def duplicate_lists(spark, sf):
    lists = D.duplicate_lists(D.dup_members(D.write_hashes(_hashed(spark, sf))))
    return lists.withColumn("files", F.array_join("files", "|"))


@query
def dup_summary(spark, sf):
    return D.dup_summary(D.duplicate_groups(_hashed(spark, sf)))


@query
def top_wasted(spark, sf):
    top = D.top_wasted(D.duplicate_groups(_hashed(spark, sf)), 10)
    return top.select("fingerprint", "size", "n_files", "wasted_bytes")


@query
def size_candidates(spark, sf):
    return D.size_candidates(view(spark, sf, "files_v"))


@query
def fill_hash(spark, sf):
    catalog = view(spark, sf, "old_catalog_v").select("id", "path", "hash")
    return D.fill_hash(catalog, _hashed(spark, sf))


# ---- move plans


def _requests(spark, sf):
    return O.move_requests(view(spark, sf, "catalog_v"), TARGET)


def _sources(spark, sf):
    """What is still on disk: the files of one session are gone."""
    return view(spark, sf, "files_v").filter(F.col("scan_session_id") != 3).select("path")


@query
def plan_preview(spark, sf):
    return O.plan_preview(_requests(spark, sf), view(spark, sf, "existing_v"), _sources(spark, sf))


@query
def plan_moves(spark, sf):
    return O.plan_moves(_requests(spark, sf), view(spark, sf, "existing_v"))


@query
def plan_moves_by_rule(spark, sf):
    files = K.classify(view(spark, sf, "files_v").select("id", "path", "name", "extension"), view(spark, sf, "rules_v"))
    requests = O.move_requests(files, TARGET, route_by="target_folder")
    return O.plan_moves(requests, view(spark, sf, "existing_v"), _sources(spark, sf)).drop("was_renamed")


@query
def organize_summary(spark, sf):
    plan = O.plan_moves(_requests(spark, sf), view(spark, sf, "existing_v"), _sources(spark, sf))
    return O.organize_summary(plan)


@query
def move_log(spark, sf):
    plan = O.plan_preview(_requests(spark, sf), view(spark, sf, "existing_v"), _sources(spark, sf))
    return O.move_log(plan, 1, 1.7e9, "id")[0]


@query
def move_log_dry_run(spark, sf):
    plan = O.plan_preview(_requests(spark, sf), view(spark, sf, "existing_v"), _sources(spark, sf))
    return O.move_log(plan, 1, 1.7e9, "id", dry_run=True)[0]


def _organized(spark, sf):
    return organize(view(spark, sf, "catalog_v"), 2, TARGET, view(spark, sf, "existing_v"),
                    categories=["Documents", "Audio", "Others"], now=1.7e9)


@query
def organize_session(spark, sf):
    return _organized(spark, sf).files.select("id", "path", "name", "scan_session_id")


@query
def organize_logs(spark, sf):
    """Logs of a run with the undo rows that belong to them; log ids differ from run to run."""
    done = _organized(spark, sf)
    undo = done.undo.select(F.col("log_id").alias("id"), "original_path", "can_undo", "undone_at")
    return respond(done.logs, LOG_RESPONSE).join(undo, "id", "left").drop("id")


@query
def organize_undone(spark, sf):
    """A run, and all of it undone: logs are marked, and the catalog names the places the files came from."""
    done = _organized(spark, sf)
    back = U.undo_moves(done.logs, done.undo, done.files.select("path"), 1.8e9, files=done.files)
    marks = back.logs.filter("status = 'undone'").join(back.undo.filter("NOT can_undo").select(F.col("log_id").alias("id"), "undone_at"), "id")
    return back.files.join(marks.select(F.col("old_path").alias("path"), "undone_at"), "path", "left").select("id", "path", "name", "undone_at")


@query
def undo_rows(spark, sf):
    plan = O.plan_preview(_requests(spark, sf), view(spark, sf, "existing_v"), _sources(spark, sf))
    return O.move_log(plan, 1, 1.7e9, "id")[1]


# ---- logs and undo


@query
def list_logs(spark, sf):
    logs = view(spark, sf, "logs_v").withColumn("error_message", F.col("old_path"))
    page = respond(L.list_logs(logs, "failed", 100, 20), LOG_RESPONSE)      # a page, so one window may hold it
    return page.withColumn("position", F.row_number().over(Window.orderBy(F.desc("timestamp"), F.asc("id"))).cast("bigint"))


@query
def log_counts(spark, sf):
    return L.log_counts(view(spark, sf, "logs_v"))


@query
def drop_logs(spark, sf):
    logs, undo = view(spark, sf, "logs_v"), view(spark, sf, "undo_v")
    gone = logs.filter(F.col("session_id") == 2).select("id")
    return L.drop_logs(logs, undo, gone)[1]


@query
def verify_copies(spark, sf):
    # a target's content is its source's, but for what changed since: three sources are corrupted
    plan = O.plan_preview(_requests(spark, sf), view(spark, sf, "existing_v"))
    logs = cut_lineage(O.move_log(plan, 1, 1.7e9, "id")[0])
    hashes = D.write_hashes(_hashed(spark, sf)).select("id", "path", "hash")
    changed = F.when(F.col("old_path").rlike("/src[234]/"), F.lit("damaged")).otherwise(F.col("hash"))
    # previews of different files may name one target; the first file is the one that got there
    targets = (
        logs.join(hashes.select("id", "hash"), "id")
        .groupBy("new_path").agg(F.min_by(changed, "id").alias("hash"))
        .withColumnRenamed("new_path", "path")
    )
    return L.verify_copies(logs, hashes, targets).select("id", "source_hash", "target_hash", "verified")


def _undo(spark, sf):
    candidates = U.undo_candidates(view(spark, sf, "logs_v"), view(spark, sf, "undo_v"))
    return U.plan_undo(candidates, view(spark, sf, "listing_v"))


@query
def undo_candidates(spark, sf):
    logs = view(spark, sf, "logs_v")
    return U.undo_candidates(logs, view(spark, sf, "undo_v"), logs.filter(F.col("session_id") == 1).select("id"))


@query
def undo_plan(spark, sf):
    return _undo(spark, sf)


@query
def undo_shared_path(spark, sf):
    """Every file that the logs name is there once; lower log ids go first."""
    logs = view(spark, sf, "shared_logs_v")
    undo = logs.select(F.col("id").alias("log_id"), F.col("old_path").alias("original_path"), F.lit(True).alias("can_undo"))
    listing = logs.select(F.col("new_path").alias("path")).distinct()
    return U.plan_undo(U.undo_candidates(logs, undo), listing)


@query
def undo_summary(spark, sf):
    return U.undo_summary(_undo(spark, sf))


@query
def undo_logs(spark, sf):
    logs = view(spark, sf, "logs_v")
    undo = view(spark, sf, "undo_v").withColumn("undone_at", F.lit(None).cast("double"))
    done = U.undo_moves(logs, undo, view(spark, sf, "listing_v"), 1.8e9)
    after = done.undo.select(F.col("log_id").alias("id"), "can_undo", "undone_at")
    return done.logs.select("id", "status").join(after, "id", "left")


# ---- events


@query
def debounce(spark, sf):
    return E.debounce(view(spark, sf, "fs_events_v"), GAP)


@query
def debounce_by_path(spark, sf):
    return E.debounce_by_path(view(spark, sf, "fs_events_v"), GAP)


@query
def debounce_one_root(spark, sf):
    """All events below one root: one timer for everything."""
    events = view(spark, sf, "fs_events_v").withColumn("root", F.lit("/watch"))
    return E.debounce(events, ONE_ROOT_GAP)


@query
def parsed_events(spark, sf):
    """Events as JSON text, as a queue delivers them; those of directories are dropped."""
    events = view(spark, sf, "fs_events_v").withColumn("is_directory", F.when(F.col("kind") != "created", F.col("kind") == "deleted"))
    raw = events.select(F.to_json(F.struct(*[c for c in events.columns])).alias("value"))
    return V.parse_events(raw).select("event_id", "root", "path", "kind", "dest_path")


@query
def event_counts(spark, sf):
    return G.event_counts(view(spark, sf, "fs_events_v"))


def _watched(events):
    """The watched folders as they are before the events: every path an event names once, but for some."""
    return events.select("path").distinct().select(
        F.xxhash64("path").alias("id"), "path", P.base_name("path").alias("name"),
        P.extension(P.base_name("path")).alias("extension"), F.length("path").cast("bigint").alias("size"),
        F.lit("Documents").alias("category"),
    ).filter(~F.col("path").endswith("/f3.txt"))


@query
def apply_events(spark, sf):
    events = view(spark, sf, "fs_events_v")
    return G.apply_events(_watched(events), events).select("path", "name", "size", "category")


@query
def replay_moves(spark, sf):
    """Chains of moves, moves over files, paths used again: every file is followed to where it ends."""
    events = view(spark, sf, "busy_events_v")
    catalog = _watched(events)
    done = G.apply_events(catalog, events)
    return done.join(catalog.select("id", F.col("path").alias("came_from")), "id", "left").select(
        "path", "name", "extension", "size", "category", "came_from")


def _in_parts(spark, events, folder, start, *last):
    """The events as a stream whose files come in three parts, in the order of time, and the ``last`` ones after them. After each part
    ``start`` begins the query anew from its checkpoint and it runs until it has caught up."""
    at = F.unix_micros("ts")
    cuts = events.agg(F.percentile_approx(at, [0.33, 0.67])).first()[0] or [0, 0]
    parts = [events.filter(at <= cuts[0]), events.filter((at > cuts[0]) & (at <= cuts[1])), events.filter(at > cuts[1]), *last]
    for part in parts:
        part.select(*events.columns).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(events.schema).parquet(f"{folder}/in")
        start(stream).option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start().awaitTermination()


@query
def debounce_stream(spark, sf):
    """Timers per path on a stream; the marker at the end closes what is open."""
    folder = f"{checkpoint_folder(apply_settings(spark))}/debounce-{uuid.uuid4().hex}"

    def start(stream):
        bursts = E.debounce_by_path_stream(stream, GAP, delay="0 seconds")
        return bursts.writeStream.format("parquet").option("path", f"{folder}/out")

    with E.with_timers(spark):
        _in_parts(spark, view(spark, sf, "fs_events_v"), folder, start, E.end_of_input(spark))
    return spark.read.schema(E.BURST).parquet(f"{folder}/out")


@query
def debounce_root_stream(spark, sf):
    """Debounce per root on a stream; at its end the sink gives out the bursts still open."""
    folder = f"{checkpoint_folder(apply_settings(spark))}/debounce-{uuid.uuid4().hex}"
    sink = E.DebounceSink(f"{folder}/out", f"{folder}/state", GAP)
    _in_parts(spark, view(spark, sf, "fs_events_v"), folder, lambda stream: stream.writeStream.foreachBatch(sink))
    sink.flush(spark)
    return spark.read.parquet(f"{folder}/out").select(
        "root", "path", "kind", "dest_path", "event_id", "n_events", "session_start", "session_end", "fires_at")


@query
def auto_organize_stream(spark, sf):
    """Debounce, classify and number on a stream, to the end of its input."""
    folder = f"{checkpoint_folder(apply_settings(spark))}/organize-{uuid.uuid4().hex}"
    sink = G.OrganizeSink(R.load_rules(view(spark, sf, "rules_v")), TARGET, view(spark, sf, "existing_v"), f"{folder}/out", f"{folder}/state", GAP)
    _in_parts(spark, view(spark, sf, "inbox_events_v"), folder, lambda stream: stream.writeStream.foreachBatch(sink))
    sink.flush(spark)
    return spark.read.parquet(f"{folder}/out").select("id", "source", "destination", "success", "was_renamed")


@query
def classify_events(spark, sf):
    found = G.classify_events(view(spark, sf, "fs_events_v"), view(spark, sf, "rules_v"))
    return found.select("event_id", "file", "category", "confidence")
