"""Listings of real folders, tables and snapshots."""

import os

from pyspark.sql import functions as F

from lakeledger.operators import browse, dedup
from lakeledger.operators.catalog import scan_stats
from lakeledger.operators.organize import folder_entries
from lakeledger.plans.organize import organize
from lakeledger.plans.scan import scan, scan_records
from lakeledger.schemas import FILES
from lakeledger.sources import tables as T
from lakeledger.sources.listing import list_files, list_tree, listed_files

TREE = ["docs/report.pdf", "docs/notes.txt", "images/photo.jpg", "images/screenshot.png", "videos/clip.mp4",
        "code/main.py", "code/app.js", "archives/backup.zip", "deep/a/b/c/file.txt"]


def make_tree(root, extra=()):
    for path in [*TREE, *extra]:
        os.makedirs(os.path.dirname(root / path), exist_ok=True)
        (root / path).write_bytes(b"x" * 10)


def test_tree(spark, tmp_path):
    make_tree(tmp_path, ["docs/doc.PDF", ".hidden/.rc", "sys/secret", "_under"])
    os.symlink(tmp_path / "docs/notes.txt", tmp_path / "docs/link.txt")
    os.symlink(tmp_path / "docs", tmp_path / "docs_link")
    listing = list_tree(spark, [str(tmp_path), str(tmp_path / "docs")], protected=[str(tmp_path / "sys")])
    found = {os.path.relpath(r["path"], tmp_path): r for r in listed_files(listing).collect()}
    assert set(found) == {*TREE, "docs/doc.PDF", ".hidden/.rc", "_under"}
    assert found["docs/doc.PDF"]["extension"] == ".pdf" and found["_under"]["size"] == 10
    info = os.stat(tmp_path / "docs/notes.txt")
    assert found["docs/notes.txt"]["last_modified"] == info.st_mtime
    assert [os.path.basename(r["path"]) for r in listing.filter("error = 'protected'").collect()] == ["sys"]
    stats = scan_stats(listing).collect()[0]
    assert (stats["total_files"], stats["skipped_protected"], stats["skipped_errors"], stats["total_dirs"]) == (12, 1, 0, 10)
    missing = list_tree(spark, [str(tmp_path / "nowhere")]).collect()
    assert len(missing) == 1 and "No such file" in missing[0]["error"]
    nowhere = list_tree(spark, [str(tmp_path / "nowhere")])
    assert scan_stats(nowhere).collect()[0]["skipped_errors"] == 1 and scan_records(nowhere).count() == 0


def test_protected_root(spark, tmp_path):
    rows = list_tree(spark, [str(tmp_path)], protected=[str(tmp_path)]).collect()
    assert [(r["path"], r["error"]) for r in rows] == [(str(tmp_path), "protected")]


def test_binary_listing_reads_no_content(spark, tmp_path):
    make_tree(tmp_path)
    files = list_files(spark, str(tmp_path))
    assert {os.path.relpath(r["path"], tmp_path) for r in files.collect()} == set(TREE)
    plan = files.filter(F.col("size") >= 5)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan and "GreaterThanOrEqual(length,5)" in plan


def test_scan_of_a_folder_and_again(spark, tmp_path):
    make_tree(tmp_path)
    empty = spark.createDataFrame([], FILES)
    first = scan(empty, list_tree(spark, [str(tmp_path)]), 1, [str(tmp_path)], protected=[])
    got = {r["name"]: r["category"] for r in first.catalog.collect()}
    assert got["report.pdf"] == "Documents" and got["main.py"] == "Code" and len(got) == 9
    stats = first.stats.collect()[0]
    assert stats["total_files"] == 9 and stats["total_dirs"] == 9 and stats["files_per_second"] > 0
    (tmp_path / "docs/new_document.docx").write_bytes(b"n")
    second = scan(first.catalog, list_tree(spark, [str(tmp_path)]), 2, [str(tmp_path)], protected=[])
    assert second.session.collect()[0]["total_files"] == 1
    assert second.catalog.count() == 10 and second.catalog.filter("scan_session_id = 2").count() == 1
    assert scan_records(list_tree(spark, [str(tmp_path)]), exclude=["*.txt", "*/code/*"], protected=[]).count() == 6


def test_snapshots(spark, tmp_path):
    root = str(tmp_path / "catalog")
    assert T.current_version(spark, root) is None
    for version in (1, 2):
        T.write_snapshot(spark.range(version), root, version)
    assert T.current_version(spark, root) == 2 and T.read_snapshot(spark, root).count() == 2
    # a half-written version has no pointer row
    spark.range(9).write.parquet(f"{root}/snapshot=3")
    assert T.read_snapshot(spark, root).count() == 2 and T.read_snapshot(spark, root, 1).count() == 1


def test_whole_flow(spark, tmp_path):
    share, store = tmp_path / "share", str(tmp_path / "catalog")
    make_tree(share, ["code/copy.txt", "docs/copy.txt"])
    for name in ("code/copy.txt", "docs/copy.txt"):
        (share / name).write_bytes(b"same" * 500)
    old = T.read_snapshot(spark, store, schema=FILES)
    done = scan(old, list_tree(spark, [str(share)]), 7, [str(share)], unique=True, protected=[])
    T.write_snapshot(done.catalog, store, version=7)
    catalog = T.read_snapshot(spark, store, schema=FILES)
    members = dedup.dup_members(dedup.hash_candidates(catalog)).collect()
    assert sorted(r["label"] for r in members) == ["COPY 1", "KEEP"]
    assert [r["name"] for r in browse.browse(catalog, 7, term="photo").collect()] == ["photo.jpg"]
    moves = organize(catalog, 7, str(share / "sorted"), existing=folder_entries(catalog), sources=catalog.select("path"))
    names = sorted(os.path.relpath(r["destination"], share) for r in moves.plan.collect())
    assert "sorted/Documents/copy.txt" in names and "sorted/Documents/copy_(1).txt" in names and len(names) == 11


def test_tables(spark, tmp_path):
    path = str(tmp_path / "logs")
    rows = spark.createDataFrame([(1, 1), (2, 2)], "id BIGINT, session_id BIGINT")
    T.save_table(rows, path, partition_by=["session_id"])
    T.save_table(rows, path, partition_by=["session_id"])
    back = T.load_table(spark, path)
    assert back.count() == 4
    assert "PartitionFilters: [isnotnull(session_id" in \
        back.filter("session_id = 2")._jdf.queryExecution().executedPlan().toString()


def test_bucketed_catalog_is_not_shuffled_for_a_scan(spark):
    catalog = spark.createDataFrame([(1, "/d/a", "a", "", 1, "Others", 1.0, None, 1, 1.0)], FILES)
    T.save_catalog(catalog, "bucketed_catalog", 8)   # as many as shuffle partitions
    stored = T.load_table(spark, "bucketed_catalog")
    listing = spark.createDataFrame([("/d/a", 1, 1.0), ("/d/b", 1, 1.0)], "path STRING, size BIGINT, last_modified DOUBLE")
    from lakeledger.plans.scan import scan_catalog
    merged = scan_catalog(stored, listing, 2)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    # the only exchange is that of the listing
    assert plan.count("Exchange hashpartitioning") == 1
    assert {r["path"]: r["_write"] for r in merged.collect()} == {"/d/a": False, "/d/b": True}
