"""Duplicate detection in tables and on files; numbering of large groups."""

import hashlib
import os

import pytest
from pyspark.sql import Window, functions as F

from lakeledger.operators import dedup as D
from lakeledger.operators.ranking import number_rows
from lakeledger.operators.skew import _salted, join_by_key
from lakeledger.sources.content import hash_paths, path_digests

A, B_, U = b"duplicate content A" * 200, b"duplicate content B" * 150, b"only once" * 300
TINY = b"tiny"


def table(spark, *contents):
    rows = [(i, f"/d/f{i:02d}", len(c), bytearray(c)) for i, c in enumerate(contents)]
    return spark.createDataFrame(rows, "id BIGINT, path STRING, size BIGINT, content BINARY")


def test_one_outlying_id_spoils_no_slice(spark):
    from lakeledger.operators import slabs

    rows = spark.range(8000).select(F.lit("hot").alias("k"), F.when(F.col("id") == 0, F.lit(2**60)).otherwise(F.col("id")).alias("v"), F.lit(8000).alias("n"))
    slices = [r["count"] for r in slabs.in_slabs(rows, ["k"], ["v"], 8).groupBy("_slab").count().collect()]
    assert len(slices) > 5 and max(slices) <= 2 * sorted(slices)[len(slices) // 2]
    ranked = number_rows(rows, ["k"], "v", per_bucket=500, slabs=8).collect()
    assert [r["rank"] for r in sorted(ranked, key=lambda r: r["v"])] == list(range(1, 8001))


def test_groups(spark):
    hashed = D.with_hashes(table(spark, A, B_, A, U, TINY, TINY, TINY, B_, A))
    groups = D.duplicate_groups(hashed)
    got = {r["size"]: (r["n_files"], r["wasted_bytes"], r["keep_id"], r["fingerprint"]) for r in groups.collect()}
    assert got == {3800: (3, 7600, 0, hashlib.sha256(A).hexdigest()),
                   2850: (2, 2850, 1, hashlib.sha256(B_).hexdigest())}
    assert [r["size"] for r in D.top_wasted(groups, 5).collect()] == [3800, 2850]
    assert tuple(D.dup_summary(groups).collect()[0]) == (2, 3, 10450)
    members = D.dup_members(hashed)
    labels = {r["path"]: r["label"] for r in members.collect()}
    assert labels == {"/d/f00": "KEEP", "/d/f02": "COPY 1", "/d/f08": "COPY 2", "/d/f01": "KEEP", "/d/f07": "COPY 1"}
    lists = {(r["size"], r["chunk"]): r["files"] for r in D.duplicate_lists(members, chunk=2).collect()}
    assert lists == {(3800, 0): ["/d/f00", "/d/f02"], (3800, 1): ["/d/f08"], (2850, 0): ["/d/f01", "/d/f07"]}


def test_nothing_and_unreadable(spark):
    empty = D.duplicate_groups(D.with_hashes(table(spark)))
    assert empty.count() == 0 and tuple(D.dup_summary(empty).collect()[0]) == (0, 0, 0)
    broken = table(spark, A, A).withColumn("content", F.when(F.col("id") == 0, F.col("content")))
    assert D.duplicate_groups(D.with_hashes(broken)).count() == 0


def test_stages_and_heads(spark):
    head = b"h" * 65_536
    hashed = D.with_hashes(table(spark, head + b"1", head + b"2", head + b"1", A, U + b"x" * 1100))
    assert {r["id"] for r in D.dup_stage1(hashed).collect()} == {0, 1, 2, 3, 4} - ({4} if len(U) + 1100 != len(A) else set())
    assert {r["id"] for r in D.dup_stage2(hashed).collect()} == {0, 1, 2}
    assert [r["n_files"] for r in D.duplicate_groups(hashed).collect()] == [2]


def test_size_bounds(spark):
    sizes = spark.createDataFrame([(1024, "a"), (1024, "b"), (1025, "c"), (1025, "d"), (1023, "e"), (1023, "f")],
                                  "size BIGINT, path STRING")
    assert {r["path"] for r in D.dup_stage1(sizes).collect()} == set("abcd")
    assert [(r["fingerprint"], r["wasted_bytes"]) for r in D.size_candidates(sizes).collect()] == [("size:1025", 1025)]


@pytest.mark.parametrize("algorithm", ["sha256", "xxh64"])
def test_staged_hashing_of_files(spark, tmp_path, algorithm):
    big = b"z" * 100_000
    contents = {"a1": A, "a2": A, "b": B_[:-1] + b"!", "b2": B_, "u": U, "big1": big + b"1", "big2": big + b"1",
                "big3": big + b"2", "odd": big[:-5]}
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    rows = [(i, str(tmp_path / n), len(c)) for i, (n, c) in enumerate(contents.items())]
    rows.append((99, str(tmp_path / "gone"), len(A)))
    files = spark.createDataFrame(rows, "id BIGINT, path STRING, size BIGINT")
    hashed = D.hash_candidates(files, algorithm)
    assert {os.path.basename(r["path"]) for r in hashed.collect()} == {"a1", "a2", "big1", "big2", "big3"}
    got = {r["size"]: r["n_files"] for r in D.duplicate_groups(hashed).collect()}
    assert got == {3800: 2, 100_001: 2}
    if algorithm == "sha256":
        digests = {os.path.basename(r["path"]): r["digest"] for r in path_digests(files).collect()}
        assert digests == {n: hashlib.sha256(c).hexdigest() for n, c in contents.items()}
        gone = hash_paths(files.filter("id = 99")).collect()[0]
        assert gone["digest"] is None
        heads = {r["id"]: r["digest"] for r in hash_paths(files.filter("size > 65536"), head_only=True).collect()}
        assert set(heads.values()) == {hashlib.sha256(b"z" * 65_536).hexdigest()}


def test_hot_group_is_numbered_in_slices(spark):
    n = 20_000
    rows = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("k"),
        (F.col("id") * 7 - 30_000 + F.when(F.col("id") > 15_000, 10**12).otherwise(0)).alias("v"))
    stats = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("first"), F.max("v").alias("last"))
    ranked = number_rows(rows.join(stats, "k"), ["k"], "v", per_bucket=500)
    got = sorted((r["k"], r["v"], r["rank"]) for r in ranked.collect())
    expected, count = [], {}
    for k, v in sorted((r["k"], r["v"]) for r in rows.collect()):
        count[k] = count.get(k, 0) + 1
        expected.append((k, v, count[k]))
    assert got == expected


def skewed_files(spark, n=6_000):
    """A third of the files are copies of one content, another key is half as hot."""
    copies = F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 3 == 1, (F.col("id") % 2).cast("string"))
    digest = F.coalesce(copies, F.col("id").cast("string"))
    return spark.range(n).select("id", F.concat(F.lit("/p/"), F.col("id").cast("string")).alias("path"),
                                 (F.length(digest) + 5000).cast("bigint").alias("size"), digest.alias("hash"))


def test_hot_keys_are_salted_and_nothing_is_lost(spark):
    files = skewed_files(spark)
    counts = files.groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
    hot = counts.filter("n > 100").select("hash", F.ceil(F.col("n") / 100).alias("_copies"))
    pieces = _salted(files, hot, ["hash"], "path").groupBy("hash", "_salt").count()
    assert pieces.agg(F.max("count")).first()[0] < 200
    plain = files.join(counts, "hash")
    for given in ("n", None):
        salted = join_by_key(files, counts, ["hash"], "inner", given, "path", hot_rows=100)
        assert sorted(salted.select(plain.columns).collect()) == sorted(plain.collect())
    kept = join_by_key(files, counts.filter("n > 1"), ["hash"], "left_anti", "n", "path", hot_rows=100)
    assert kept.count() == 2_000
    assert D.repeated(files, ["hash"], hot_rows=100).count() == 4_000


def test_rows_without_a_key_stay_in_outer_and_anti_joins(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "z"), (4, "a")], "id BIGINT, k STRING")
    table = spark.createDataFrame([("a", 2)], "k STRING, n BIGINT")
    left = join_by_key(rows, table, ["k"], "left", "n", hot_rows=1)
    assert {(r["id"], r["n"]) for r in left.collect()} == {(1, 2), (2, None), (3, None), (4, 2)}
    for given in ("n", None):
        anti = join_by_key(rows, table, ["k"], "left_anti", given, hot_rows=1)
        assert {r["id"] for r in anti.collect()} == {2, 3}
        semi = join_by_key(rows, table, ["k"], "left_semi", given, hot_rows=1)
        assert {r["id"] for r in semi.collect()} == {1, 4}


def test_hot_duplicate_group(spark):
    files = skewed_files(spark)
    expected = {(r["hash"], r["id"]): r["rank"] for r in files.filter("id % 3 < 2").select(
        "hash", "id", F.row_number().over(Window.partitionBy("hash").orderBy("id")).alias("rank")).collect()}
    members = D.dup_members(files, per_bucket=70, hot_rows=90)
    assert {(r["fingerprint"], r["id"]): r["rank"] for r in members.collect()} == expected
    whole = D.duplicate_lists(members, chunk=64)
    assert whole.agg(F.max(F.size("files"))).first()[0] <= 64
    assert whole.agg(F.sum(F.size("files"))).first()[0] == 4_000


def test_content_never_reaches_a_shuffle(spark):
    groups = D.duplicate_groups(D.with_hashes(table(spark, A, A)))
    plan = groups._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():
        if "Exchange" in line:
            assert "content" not in line


def test_fill_hash(spark):
    hashed = D.with_hashes(table(spark, A)).select("path", "hash")
    catalog = spark.createDataFrame([(1, "/d/f00", None), (2, "/x", "old")], "id BIGINT, path STRING, hash STRING")
    got = {r["id"]: r["hash"] for r in D.fill_hash(catalog, hashed).collect()}
    assert got == {1: hashlib.sha256(A).hexdigest(), 2: "old"}
