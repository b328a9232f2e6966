"""Catalog, browsing and statistics."""

import pytest
from pyspark.sql import functions as F

from lakeledger.operators import browse as B, catalog as C, filters as X, stats as A
from lakeledger.plans.scan import ScanFailed, clean_roots, scan
from lakeledger.schemas import FILES, SCAN_SESSIONS


def catalog(spark, *rows):
    return spark.createDataFrame(list(rows), FILES)


def row(id_, path, size, mtime, session=1, category="Documents", hash_="h"):
    name = path.rsplit("/", 1)[1]
    return (id_, path, name, "." + name.rsplit(".", 1)[-1], size, category, mtime, hash_, session, 5.0)


def listing(spark, *rows):
    return spark.createDataFrame(list(rows), "path STRING, size BIGINT, last_modified DOUBLE")


def test_scan_incremental(spark):
    old = catalog(spark, row(1, "/d/same.txt", 10, 1.0), row(2, "/d/grown.txt", 10, 1.0), row(3, "/d/gone.txt", 10, 1.0),
                  row(4, "/d/null.txt", None, None))
    seen = listing(spark, ("/d/same.txt", 10, 1.0), ("/d/grown.txt", 11, 1.0), ("/d/new.PDF", 5, 2.0),
                   ("/d/null.txt", 0, 0.0), ("/etc/passwd", 1, 1.0), ("/d/skip.tmp", 1, 1.0), ("/d/new.PDF", 5, 2.0))
    done = scan(old, seen, 7, [" /d "], exclude=["*.tmp"])
    got = {r["path"]: (r["id"], r["size"], r["hash"], r["scan_session_id"], r["category"])
           for r in done.catalog.collect()}
    assert got.pop("/d/new.PDF")[1:] == (5, None, 7, "Documents")
    assert got == {"/d/same.txt": (1, 10, "h", 1, "Documents"), "/d/grown.txt": (2, 11, "h", 7, "Documents"),
                   "/d/gone.txt": (3, 10, "h", 1, "Documents"), "/d/null.txt": (4, None, "h", 1, "Documents")}
    session = done.session.collect()[0]
    assert (session["status"], session["total_files"], session["root_path"]) == ("done", 2, "/d")
    stats = done.stats.collect()[0]
    assert (stats["total_files"], stats["skipped_protected"], stats["total_dirs"]) == (6, 1, 1)


def test_full_scan_writes_every_listed_file(spark):
    old = catalog(spark, row(1, "/d/same.txt", 10, 1.0), row(3, "/d/gone.txt", 10, 1.0))
    done = scan(old, listing(spark, ("/d/same.txt", 10, 1.0)), 7, ["/d"], incremental=False)
    got = {r["path"]: (r["scan_session_id"], r["last_modified"]) for r in done.catalog.collect()}
    assert got == {"/d/same.txt": (7, 1.0), "/d/gone.txt": (1, 1.0)}
    assert done.session.collect()[0]["total_files"] == 1


def test_scan_failure_gives_a_failed_session(spark):
    boom = listing(spark, ("/d/a", 1, 1.0)).withColumn("size", F.raise_error(F.lit("boom")).cast("bigint"))
    with pytest.raises(ScanFailed) as failed:
        scan(catalog(spark), boom, 3, ["/d"])
    assert failed.value.session.collect()[0]["status"] == "failed"


def test_roots_are_checked():
    assert clean_roots([" /a "]) == ["/a"]
    for bad in ([], ["/a", " "]):
        with pytest.raises(ValueError):
            clean_roots(bad)


def test_upsert_overwrites_with_null_and_keeps_identity(spark):
    old = catalog(spark, row(1, "/d/a.txt", 10, 1.0))
    new = spark.createDataFrame([("/d/a.txt", "a.txt", ".txt", 4, None, 2.0, 9)],
                                "path STRING, name STRING, extension STRING, size BIGINT, category STRING, "
                                "last_modified DOUBLE, scan_session_id BIGINT")
    got = C.upsert_catalog(old, new).collect()
    assert [(r["id"], r["size"], r["category"], r["hash"], r["created_at"], r["scan_session_id"]) for r in got] == \
        [(1, 4, None, "h", 5.0, 9)]


def test_incremental_and_diff(spark):
    old = catalog(spark, row(1, "/d/a", None, None), row(2, "/d/b", 2, 1.0))
    seen = listing(spark, ("/d/a", 0, 0.0), ("/d/b", 2, 1.5), ("/d/c", 1, 1.0))
    assert {r["path"] for r in C.incremental(seen, old).collect()} == {"/d/b", "/d/c"}
    got = {r["path"]: r["status"] for r in C.snapshot_diff(seen.limit(2), old.union(old.limit(0))).collect()}
    assert got == {"/d/a": "unchanged", "/d/b": "changed"}


def test_one_join_for_detection_and_upsert(spark):
    old = catalog(spark, row(1, "/d/a", 1, 1.0)).repartition(4)
    found = C.file_records(listing(spark, ("/d/a", 1, 1.0))).withColumn("scan_session_id", F.lit(1))
    plan = C.scan_merge(old, found)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1


def test_union_of_nested_roots(spark):
    a = listing(spark, ("/d/a", 1, 1.0), ("/d/x/b", 2, 1.0))
    assert C.union_roots(a, a.filter(X.is_under("path", "/d/x"))).count() == 2


def test_predicates(spark):
    paths = ["/etc", "/etc/x", "/etc2/x", "/home/../etc/x", "/root/a", "/usr/bin", "/usr/binary", "/rootless"]
    df = spark.createDataFrame([(p,) for p in paths], "path STRING")
    assert {r[0] for r in X.not_protected(df, normalize=True).collect()} == {"/etc2/x", "/usr/binary", "/rootless"}
    assert {r[0] for r in X.not_protected(df).collect()} == {"/etc2/x", "/usr/binary", "/rootless", "/home/../etc/x"}
    assert {r[0] for r in X.exclude_prefixes(df, ["/etc", "/r"]).collect()} == {"/home/../etc/x", "/usr/bin", "/usr/binary"}
    windows = spark.createDataFrame([("C:\\Windows\\x",), ("C:\\Windows2",)], "path STRING")
    from lakeledger.constants import PROTECTED_WINDOWS
    assert [r[0] for r in X.not_protected(windows, PROTECTED_WINDOWS, "\\").collect()] == ["C:\\Windows2"]
    links = spark.createDataFrame([("/a", True, False), ("/b", False, True), ("/c", False, False), ("/d", None, None)],
                                  "path STRING, is_symlink BOOLEAN, is_directory BOOLEAN")
    assert {r[0] for r in X.regular_files(links).collect()} == {"/c", "/d"}


@pytest.fixture
def shelf(spark):
    rows = [row(1, "E:/tmp/alpha.txt", 100, 10.0), row(2, "E:/tmp/zeta.txt", 400, 30.0),
            row(3, "E:/tmp/photo.jpg", 200, 20.0, category="Images"), row(4, "E:/tmp/none.bin", None, 5.0, category=None),
            row(5, "E:/tmp/a%_b\\c.txt", 1, 1.0, session=2)]
    return catalog(spark, *rows)


def ids(df):
    return [r["id"] for r in df.collect()]


def test_browse(shelf):
    page = B.browse(shelf, 1, term="TXT ", sort_by="size", sort_order="DESC", limit=1)
    assert ids(page) == [2] and B.browse_total(shelf, 1, term="TXT ").collect()[0]["total"] == 2
    assert ids(B.browse(shelf, 1, sort_by="size")) == [4, 1, 3, 2]
    assert ids(B.browse(shelf, 1, sort_by="size", sort_order="desc")) == [2, 3, 1, 4]
    assert ids(B.browse(shelf, 1, sort_by="bogus")) == [1, 4, 3, 2]
    assert ids(B.browse(shelf, 1, category="Images")) == [3]
    assert ids(B.browse(shelf, 1, limit=0)) == [1] and ids(B.browse(shelf, 1, offset=-5, limit=9999)) == [1, 4, 3, 2]
    assert ids(B.browse_page(shelf, 1, 7, page_size=3)) == [2] and ids(B.browse_page(shelf, 1, 0, page_size=3)) == [1, 4, 3]
    assert ids(B.in_categories(shelf, [])) == [1, 2, 3, 4, 5] and ids(B.by_id(shelf, 99)) == []


def test_search_wildcards(shelf):
    assert ids(B.search(shelf, "a_p")) == [1] and ids(B.search(shelf, "a_p", literal=True)) == []
    assert ids(B.search(shelf, "%_b\\c", literal=True)) == [5] and ids(B.search(shelf, "b\\c")) == [5]


@pytest.mark.parametrize("order", ["asc", "desc"])
@pytest.mark.parametrize("key", ["name", "size", "category", "last_modified"])
def test_keyset_pages_equal_offset_pages(shelf, key, order):
    everything = B.browse(shelf, 1, sort_by=key, sort_order=order).collect()
    for i, r in enumerate(everything):
        rest = B.browse_after(shelf, 1, r[key], r["id"], sort_by=key, sort_order=order)
        assert ids(rest) == [x["id"] for x in everything[i + 1:]]


def test_deep_pages_equal_shallow_ones(spark):
    rows = spark.range(3_000).select("id", (F.col("id") * 37 % 11).alias("size")).repartition(7)
    order = [F.desc("size"), F.asc("id")]
    for offset, limit in ((1, 5), (1_234, 700), (2_990, 50), (5_000, 10)):
        expected = [r["id"] for r in B.page_of(rows, order, offset, limit).collect()]
        assert [r["id"] for r in B.page_of(rows, order, offset, limit, deep_offset=0).collect()] == expected


def test_page_is_a_top_k(shelf):
    plan = B.browse(shelf.repartition(3), 1, offset=2, limit=2)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_statistics(shelf):
    assert {r["category"]: r["n_files"] for r in A.session_stats(shelf, 1).collect()} == \
        {"Documents": 2, "Images": 1, "Others": 1}
    whole = A.session_stats_map(shelf, 1).collect()[0]
    assert (whole["total_files"], whole["categories"]) == (4, {"Documents": 2, "Images": 1, "Others": 1})
    assert A.session_stats_map(shelf, 77).collect()[0]["total_files"] == 0
    shares = [(r["category"], r["percent"], r["position"]) for r in A.category_share(shelf).orderBy("position").collect()]
    assert shares == [("Documents", 60, 1), ("Images", 20, 2), ("Others", 20, 3)]
    assert [r["category"] for r in B.category_list(shelf).collect()] == ["All", "Documents", "Images", "Others"]


def test_sessions(spark, shelf):
    sessions = spark.createDataFrame([(1, "/a", 1.0, 3.0, 4, "done"), (2, "/b", 5.0, 5.0, 1, "done"),
                                      (3, "/c", 6.0, None, None, "running")], SCAN_SESSIONS)
    assert ids(C.list_sessions(sessions)) == [3, 2, 1] and ids(C.latest_session(sessions)) == [3]
    rates = {r["id"]: (r["duration"], r["files_per_second"]) for r in C.session_durations(sessions).collect()}
    assert rates == {1: (2.0, 2.0), 2: (0.0, 0.0), 3: (None, 0.0)}
    files, left = C.drop_session(shelf, sessions, sessions.filter("id = 1").select("id"))
    assert {r["id"]: r["scan_session_id"] for r in files.collect()} == {1: None, 2: None, 3: None, 4: None, 5: 2}
    assert sorted(ids(left)) == [2, 3]
    joined = {r["id"]: r["session_status"] for r in C.session_files(files, left).collect()}
    assert joined == {1: None, 2: None, 3: None, 4: None, 5: "done"}


def test_new_files_get_the_next_ids(spark):
    from lakeledger.operators.ranking import dense_ids

    rows = spark.createDataFrame([(f"/d/{i:04}",) for i in range(500)], "path STRING").repartition(7)
    got = {r["path"]: r["id"] for r in dense_ids(rows, ["path"], 41).collect()}
    assert got == {f"/d/{i:04}": 41 + i for i in range(500)}
    catalog = spark.createDataFrame([(5, "/d/0001")], "id BIGINT, path STRING")
    fresh = spark.createDataFrame([(None, "/b"), (5, "/d/0001"), (None, "/a")], "id BIGINT, path STRING")
    assert {r["path"]: r["id"] for r in C.with_ids(fresh, catalog).collect()} == {"/d/0001": 5, "/a": 6, "/b": 7}


def test_a_closed_run_scope_leaves_no_folder(spark):
    import os

    from lakeledger.session import checkpoint_folder, cut_lineage, forget, run_scope

    root = checkpoint_folder(spark).removeprefix("file:")
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    with run_scope(spark):
        assert cut_lineage(spark.range(3)).count() == 3
        assert set(os.listdir(root)) > before
    step = cut_lineage(spark.range(2))
    forget(step)
    assert set(os.listdir(root)) == before
