"""A table in versions of changed rows, with digests per bucket."""

import os
import random

import pytest
from pyspark.sql import functions as F

from lakeledger.operators import catalog as C
from lakeledger.sources.versions import VersionedTable, bucket_of, digests_of

SCHEMA = "id BIGINT, path STRING, name STRING, size BIGINT, last_modified DOUBLE, scan_session_id BIGINT"


def rows(spark, *paths, size=1, session=0):
    return spark.createDataFrame([(i, p, p[1:], size, 1.0, session) for i, p in enumerate(paths)], SCHEMA)


def store_of(spark, tmp_path, *paths, buckets=16):
    old = rows(spark, *paths)
    store = VersionedTable(spark, str(tmp_path / "t"), old.schema, ["last_modified", "size"], buckets)
    store.create(old)
    return store


def records(spark, *pairs):
    return spark.createDataFrame([(p, p[1:], s, 1.0) for p, s in pairs], "path STRING, name STRING, size BIGINT, last_modified DOUBLE")


def content(df):
    return {r["path"]: (r["id"], r["size"], r["scan_session_id"]) for r in df.collect()}


def files_below(folder):
    return [os.path.join(d, f) for d, _, fs in os.walk(folder) for f in fs if f.endswith(".parquet")]


def test_changes_tombstones_versions_and_compaction(spark, tmp_path):
    store = store_of(spark, tmp_path, *[f"/{i}" for i in range(40)])
    scanned = records(spark, *[(f"/{i}", 1 + (i == 7)) for i in range(1, 40)], ("/new", 5))
    store.commit(C.scan_changes(store.read(), store.compare(scanned), 1, forget_missing=True), 1)
    expected = {f"/{i}": (i, 1, 0) for i in range(1, 40)} | {"/7": (7, 2, 1), "/new": (40, 5, 1)}
    assert content(store.read()) == expected and content(store.read(0)) == {f"/{i}": (i, 1, 0) for i in range(40)}
    again = records(spark, *[(f"/{i}", 1 + (i == 7)) for i in range(40)], ("/new", 5))
    store.commit(C.scan_changes(store.read(), store.compare(again), 2), 2)           # /0 comes back
    expected["/0"] = (41, 1, 2)
    assert content(store.read()) == expected
    store.compact(3)
    assert content(store.read()) == expected and store._steps(None) == (3, [])
    assert store.compare(again).count() == 0
    assert {tuple(r) for r in store.digests().collect()} == {tuple(r) for r in digests_of(again, ["last_modified", "size"], 16).collect()}


def test_a_scan_writes_what_changed_and_reads_what_differs(spark, tmp_path):
    store = store_of(spark, tmp_path, *[f"/{i}" for i in range(400)], buckets=32)
    scanned = records(spark, *[(f"/{i}", 1 + (i in (3, 4))) for i in range(400)])
    compared = store.compare(scanned)
    assert {(r["path"], r["status"]) for r in compared.collect()} == {("/3", "changed"), ("/4", "changed")}
    differing = {r[0] for r in scanned.filter("size = 2").select(bucket_of("path", 32)).collect()}
    named = store.read(0, sorted(differing)).select(F.input_file_name()).distinct().collect()
    read = {int(r[0].split("bucket=")[1].split("/")[0]) for r in named}
    assert store.differing(scanned) == sorted(differing) and read == differing
    plan = compared._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan
    store.commit(C.scan_changes(store.read(), compared, 1), 1)
    assert spark.read.parquet(str(tmp_path / "t" / "changes=1")).count() == 2
    assert len(files_below(str(tmp_path / "t" / "changes=1"))) <= 2


def test_a_failed_commit_is_not_seen_and_is_overwritten(spark, tmp_path):
    store = store_of(spark, tmp_path, "/a", "/b")
    change = rows(spark, "/a", size=9, session=1).withColumn("_gone", F.lit(False))
    broken = change.withColumn("size", F.raise_error(F.lit("lost")).cast("bigint"))
    with pytest.raises(Exception):
        store.commit(broken, 1)
    assert store.newest() == 0 and content(store.read()) == {"/a": (0, 1, 0), "/b": (1, 1, 0)}
    store.commit(change, 1)
    assert content(store.read()) == {"/a": (0, 9, 1), "/b": (1, 1, 0)}


def test_random_histories(spark, tmp_path):
    r = random.Random(5)
    state = {f"/{i}": (1, 1.0) for i in range(30)}
    store = store_of(spark, tmp_path, *state, buckets=4)
    for version in range(1, 5):
        for p in r.sample([f"/{i}" for i in range(60)], 12):
            if r.random() < 0.3:
                state.pop(p, None)
            else:
                state[p] = (r.randrange(5), 1.0)
        scanned = records(spark, *[(p, s) for p, (s, _) in state.items()])
        store.commit(C.scan_changes(store.read(), store.compare(scanned), version, forget_missing=True), version)
        got = store.read().collect()
        assert {x["path"]: x["size"] for x in got} == {p: s for p, (s, _) in state.items()}
        assert len({x["id"] for x in got}) == len(got)


def test_empty_tables(spark, tmp_path):
    store = store_of(spark, tmp_path)
    assert store.read().count() == 0 and store.compare(records(spark)).count() == 0
    store.commit(C.scan_changes(store.read(), store.compare(records(spark, ("/a", 1))), 1), 1)
    assert content(store.read()) == {"/a": (0, 1, 1)}
