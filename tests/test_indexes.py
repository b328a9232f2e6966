"""Search postings, sorted copies, and exclusion by tables of prefixes and globs."""

import random

import pytest
from pyspark.sql import functions as F

from lakeledger.operators import browse as B, filters as X
from lakeledger.operators.indexes import RankIndex, SearchIndex

r = random.Random(2)
PARTS = ["Tax", "invoice", "_", "%", " 20", "é", "İ", "a", ".pdf", "\\", "ab"]


def catalog(spark, n=300):
    rows = [(i, "".join(r.choice(PARTS) for _ in range(r.randint(0, 5))), i % 3, r.choice([None, 5, 7])) for i in range(n)]
    rows = [(i, f"/d{i % 4}/{name}", None if i % 50 == 0 else name, s, v) for i, name, s, v in rows]
    return spark.createDataFrame(rows, "id BIGINT, path STRING, name STRING, scan_session_id BIGINT, size BIGINT")


def ids(df):
    return [x["id"] for x in df.collect()]


def folders(df, name):
    return {f[0].split(f"{name}=")[1].split("/")[0] for f in df.select(F.input_file_name()).distinct().collect()}


def test_search_index_like_a_scan(spark, tmp_path):
    files = catalog(spark)
    index = SearchIndex(spark, str(tmp_path / "i"), 16)
    index.build(files)
    for term in ["tax", "INVOICE", "tax_", "a%b", "tax%pdf", "é.p", "/d1/tax", " 20 ", "%", "", "nothing at all", "\\ab", "İa"]:
        for literal in (False, True):
            assert sorted(ids(index.search(files, term, literal))) == sorted(ids(B.search(files, term, literal))), (term, literal)
    assert index.candidates("ab") is None and index.candidates("a%b") is None
    assert SearchIndex.pieces_of("Tax_inv%x") == ["inv", "tax"]


def test_a_search_opens_the_folders_of_its_pieces(spark, tmp_path):
    index = SearchIndex(spark, str(tmp_path / "i"), 64)
    index.build(catalog(spark))
    plan = index.candidates("invoice")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "PushedFilters: [In(piece" in plan


@pytest.mark.parametrize("key,down", [("name", False), ("size", True), ("nonsense", True)])
def test_pages_of_a_sorted_copy(spark, tmp_path, key, down):
    files = catalog(spark)
    index = RankIndex(spark, str(tmp_path / "r"), key, down)
    index.build(files, 12)
    for offset, limit in ((0, 10), (37, 30), (95, 50), (99, 1), (100, 5), (0, 500)):
        expected = B.in_session(files, 1).orderBy(*index.order).collect()[offset:offset + limit]
        got = index.page(1, offset, limit)
        assert ids(got) == [x["id"] for x in expected] and got.columns == files.columns
    assert ids(index.page(9, 0, 5)) == []
    assert len(folders(spark.read.parquet(str(tmp_path / "r" / "rows")), "_range")) > 6


def test_prefix_table(spark):
    paths = ["/etc", "/etc2/x", "/etc/x", "/usr/bin", "/usr", "", "/data/a/b/c", "/é/x", None]
    files = spark.createDataFrame([(i, p, "n") for i, p in enumerate(paths)], "id INT, path STRING, name STRING")
    prefixes = ["/etc/", "/data/a/", "/data/a/b", "/usr/bin/long", "/é", None, "/etc/"]
    table = spark.createDataFrame([(p,) for p in prefixes], "prefix STRING")
    assert {(x["path"], x["prefix"]) for x in X.longest_prefixes(files, table).collect()} == {("/etc/x", "/etc/"), ("/data/a/b/c", "/data/a/b"), ("/é/x", "/é")}
    assert sorted(ids(X.exclude_prefix_table(files, table))) == [0, 1, 3, 4, 5, 8]
    assert X.exclude_prefix_table(files, table.limit(0)).count() == 9
    everything = spark.createDataFrame([("",)], "prefix STRING")
    assert ids(X.exclude_prefix_table(files, everything)) == [8]


def test_glob_table_like_the_list(spark):
    globs = ["*.PDF", "/d1/*tax*", "[!a-z]*", "*İ*", "ab", "/d2/?*"]
    files = catalog(spark, 120)
    table = spark.createDataFrame([(g,) for g in globs], "pattern STRING")
    without_null = files.filter("name IS NOT NULL")
    assert sorted(ids(X.exclude_glob_table(without_null, table))) == sorted(ids(X.exclude_globs(without_null, globs)))
