"""Move plans, logs, undo."""

import pytest
from pyspark.sql import functions as F

from lakeledger.operators import logs as L, organize as O, undo as U
from lakeledger.plans.organize import organize
from lakeledger.schemas import FILES, LOG_RESPONSE, LOGS, UNDO_HISTORY, respond


def requests(spark, *rows):
    return spark.createDataFrame([(i, s, d) for i, (s, d) in enumerate(rows)], "id BIGINT, source STRING, dest_dir STRING")


def entries(spark, *paths):
    return O.folder_entries(spark.createDataFrame([(p,) for p in paths], "path STRING"))


def listing(spark, *paths):
    return spark.createDataFrame([(p,) for p in paths], "path STRING")


def outcome(plan):
    return {r["source"]: (r["destination"], r["success"], r["was_renamed"], r["error"]) for r in plan.collect()}


def test_collision_and_missing_source(spark):
    reqs = requests(spark, ("/in/photo.jpg", "/out"), ("/in/gone.txt", "/out"), ("/in/new.txt", "/out"))
    got = outcome(O.plan_moves(reqs, entries(spark, "/out/photo.jpg"), listing(spark, "/in/photo.jpg", "/in/new.txt")))
    assert got == {
        "/in/photo.jpg": ("/out/photo_(1).jpg", True, True, None),
        "/in/gone.txt": ("/out", False, False, "Source file not found"),
        "/in/new.txt": ("/out/new.txt", True, False, None),
    }


def test_preview_lets_two_sources_share_a_name(spark):
    reqs = requests(spark, ("/a/x.txt", "/out"), ("/b/x.txt", "/out"))
    none = entries(spark)
    assert {v[0] for v in outcome(O.plan_preview(reqs, none)).values()} == {"/out/x.txt"}
    assert {v[0] for v in outcome(O.plan_moves(reqs, none)).values()} == {"/out/x.txt", "/out/x_(1).txt"}


def test_in_place_file(spark):
    reqs = requests(spark, ("/out/a.txt", "/out"), ("/in/b.txt", "/out"))
    there = entries(spark, "/out/a.txt")
    assert outcome(O.plan_moves(reqs, there))["/out/a.txt"][0] == "/out/a_(1).txt"
    assert set(outcome(O.plan_moves(reqs, there, skip_in_place=True))) == {"/in/b.txt"}


def test_exhausted_name_fails_that_row_only(spark):
    taken = entries(spark, "/out/a.txt", *[f"/out/a_({i}).txt" for i in range(1, 1000)])
    reqs = requests(spark, ("/in/a.txt", "/out"), ("/in/b.txt", "/out"))
    for plan in (O.plan_moves(reqs, taken), O.plan_preview(reqs, taken)):
        got = outcome(plan)
        assert got["/in/a.txt"] == ("/out", False, False,
                                    "Could not resolve collision after 999 attempts: /in/a.txt")
        assert got["/in/b.txt"][1]


def test_requests(spark):
    files = spark.createDataFrame([
        (1, "/in/a.txt", "a.txt", ".txt", 1, "Documents", 1.0, None, 1, 1.0), (2, "/in//b", "b", "", 1, None, 1.0, None, 1, 1.0),
        (3, "/in/c", "c", "", 1, "", 1.0, None, 2, 1.0)], FILES)
    got = {r["id"]: (r["source"], r["dest_dir"]) for r in O.move_requests(files, "/org/./x/", normalize=True).collect()}
    assert got == {1: ("/in/a.txt", "/org/x/Documents"), 2: ("/in/b", "/org/x/Others"), 3: ("/in/c", "/org/x/Others")}
    assert [r["id"] for r in O.move_requests(files, "/o", 1, ["Documents"]).collect()] == [1]
    assert O.move_requests(files, "s3a://bucket/a//b/").first()["dest_dir"] == "s3a://bucket/a/b/Documents"
    assert O.move_requests(files, "/o", 1, []).count() == 2


def run(spark, dry_run):
    files = spark.createDataFrame([(i, f"/in/{d}/f.txt", "f.txt", ".txt", 1, "Documents", 1.0, None, 1, 1.0)
                                   for i, d in enumerate("abc")] +
                                  [(9, "/in/lost.txt", "lost.txt", ".txt", 1, "Documents", 1.0, None, 1, 1.0),
                                   (10, "/in/other.txt", "other.txt", ".txt", 1, "Documents", 1.0, None, 2, 1.0)], FILES)
    sources = files.filter("id <> 9").select("path")
    return organize(files, 1, "/org", entries(spark), sources, dry_run=dry_run, first_log_id=100, now=5.0)


def test_organize(spark):
    done = run(spark, False)
    assert tuple(O.organize_summary(done.plan).collect()[0]) == (4, 3, 1, 2)
    paths = {r["id"]: (r["path"], r["name"]) for r in done.files.collect()}
    assert paths == {0: ("/org/Documents/f.txt", "f.txt"), 1: ("/org/Documents/f_(1).txt", "f_(1).txt"),
                     2: ("/org/Documents/f_(2).txt", "f_(2).txt"), 9: ("/in/lost.txt", "lost.txt"),
                     10: ("/in/other.txt", "other.txt")}
    logs, undo = done.logs.collect(), done.undo.collect()
    assert sorted(r["status"] for r in logs) == ["failed", "success", "success", "success"]
    assert {r["log_id"] for r in undo} == {r["id"] for r in logs if r["status"] == "success"}
    assert all(r["id"] >= 100 for r in logs) and len({r["id"] for r in logs}) == 4
    assert done.logs.schema.names == [f.split()[0] for f in LOGS.split(", ")]
    assert respond(done.logs, LOG_RESPONSE).columns == done.logs.columns
    assert done.undo.schema.names == [f.split()[0] for f in UNDO_HISTORY.split(", ")]


def test_dry_run_logs_failures_only(spark):
    done = run(spark, True)
    assert [r["status"] for r in done.logs.collect()] == ["failed"] and done.undo.count() == 0
    assert {r["path"] for r in done.files.collect()} >= {"/in/a/f.txt"}
    assert done.plan.filter("dry_run").count() == 4


def test_organize_then_undo_restores(spark):
    done = run(spark, False)
    disk = done.files.select("path")
    back = U.undo_moves(done.logs, done.undo, disk, 9.0, files=done.files)
    assert tuple(U.undo_summary(back.results).collect()[0]) == (3, 3, 0)
    assert {r["path"] for r in back.files.collect()} == {"/in/a/f.txt", "/in/b/f.txt", "/in/c/f.txt", "/in/lost.txt",
                                                         "/in/other.txt"}
    assert {r["name"] for r in back.files.filter("id < 3").collect()} == {"f.txt"}
    assert sorted(r["status"] for r in back.logs.collect()) == ["failed", "undone", "undone", "undone"]
    assert {(r["can_undo"], r["undone_at"]) for r in back.undo.collect()} == {(False, 9.0)}
    assert U.undo_candidates(back.logs, back.undo).count() == 0


def test_undo_conflicts(spark):
    logs = spark.createDataFrame([
        (1, "/in/a.txt", "/org/a.txt", "move", "success", 1.0, 1, None),
        (2, "/in/a.txt", "/org/a_(1).txt", "move", "success", 2.0, 1, None),   # same origin as 1
        (3, "/in/b.txt", "/org/b_(7).txt", "move", "success", 3.0, 1, None),   # origin taken
        (4, "/in/c.txt", "/org/c.txt", "move", "success", 4.0, 1, None),       # file gone
        (5, "/in/d.txt", "/org/d.txt", "move", "success", 5.0, 1, None),       # not undoable
        (6, "/in/b_(7).txt", "/org/e.txt", "move", "success", 6.0, 1, None),   # its place must not go to 3
    ], LOGS)
    undo = spark.createDataFrame([(i, i, r["old_path"], i != 5, None) for i, r in
                                  ((r["id"], r) for r in logs.collect())], UNDO_HISTORY)
    disk = listing(spark, "/org/a.txt", "/org/a_(1).txt", "/org/b_(7).txt", "/in/b.txt", "/org/d.txt", "/org/e.txt")
    got = {r["log_id"]: (r["current_path"], r["success"], r["error"])
           for r in U.plan_undo(U.undo_candidates(logs, undo), disk).collect()}
    assert got == {
        1: ("/in/a.txt", True, None), 2: ("/in/a_(1).txt", True, None), 3: ("/in/b_(7)_(1).txt", True, None),
        4: ("/org/c.txt", False, "Source file not found"), 6: ("/in/b_(7).txt", True, None),
    }
    some = U.undo_candidates(logs, undo, spark.createDataFrame([(1,), (5,), (77,)], "id BIGINT"))
    assert [r["log_id"] for r in some.collect()] == [1]


def test_logs(spark):
    logs = spark.createDataFrame([
        (1, "/a", "/b", "move", "success", 5.0, 1, None), (2, "/c", "/d", "move", "failed", 9.0, 1, "x"),
        (3, "/e", "/f", "move", "success", 5.0, 1, None)], LOGS)
    undo = spark.createDataFrame([(1, 1, "/a", True, None), (3, 3, "/e", True, None)], UNDO_HISTORY)
    assert [r["id"] for r in L.list_logs(logs).collect()] == [2, 1, 3]
    assert [r["id"] for r in L.list_logs(logs, "success", 1, 1).collect()] == [3]
    for bad in ({"limit": 0}, {"limit": 1001}, {"offset": -1}):
        with pytest.raises(ValueError):
            L.list_logs(logs, **bad)
    assert {r["status"]: r["n_logs"] for r in L.log_counts(logs).collect()} == {"success": 2, "failed": 1, "all": 3}
    left, left_undo = L.drop_logs(logs, undo, spark.createDataFrame([(1,)], "id BIGINT"))
    assert {r["id"] for r in left.collect()} == {2, 3} and [r["log_id"] for r in left_undo.collect()] == [3]
    before = spark.createDataFrame([("/a", "h1"), ("/e", "h2")], "path STRING, hash STRING")
    after = spark.createDataFrame([("/b", "h1"), ("/f", "other")], "path STRING, hash STRING")
    assert {r["id"]: r["verified"] for r in L.verify_copies(logs, before, after).collect()} == {1: True, 3: False}
    assert {r["id"]: r["verified"] for r in L.verify_copies(logs, before, after.filter(F.lit(False))).collect()} == \
        {1: False, 3: False}


def test_a_file_is_undone_once(spark):
    """Two logs name one file: the lowest log id has it, the other finds no source, and the catalog keeps one row."""
    logs = spark.createDataFrame([(1, "/a/x.txt", "/org/x.txt", "success", 1), (2, "/b/x.txt", "/org/x.txt", "success", 1)],
                                 "id BIGINT, old_path STRING, new_path STRING, status STRING, session_id BIGINT")
    undo = spark.createDataFrame([(1, 1, "/a/x.txt", True, None), (2, 2, "/b/x.txt", True, None)],
                                 "id BIGINT, log_id BIGINT, original_path STRING, can_undo BOOLEAN, undone_at DOUBLE")
    listing = spark.createDataFrame([("/org/x.txt",)], "path STRING")
    files = spark.createDataFrame([(7, "/org/x.txt", "x.txt")], "id BIGINT, path STRING, name STRING")
    done = U.undo_moves(logs, undo, listing, 9.0, files=files)
    rows = {r["log_id"]: (r["success"], r["current_path"]) for r in done.results.collect()}
    assert rows == {1: (True, "/a/x.txt"), 2: (False, "/org/x.txt")}
    assert [r["path"] for r in done.files.collect()] == ["/a/x.txt"]
    assert {r["id"]: r["status"] for r in done.logs.collect()} == {1: "undone", 2: "success"}
