"""Column functions against Python's own path, glob and number handling."""

import fnmatch
import os
import posixpath
import re
from pathlib import PurePosixPath

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from lakeledger.constants import category_by_extension
from lakeledger.functions import paths as P, scalars as S
from lakeledger.functions.hashing import fingerprint, xxh64_fingerprint
from lakeledger.functions.patterns import glob_match, glob_to_regex, python_compiles, regex_match, same_in_java

NAMES = ["foo.", "..foo", ".bashrc", "a.tar.gz", "...", "a..b", "x.PDF", ".a.b", " .txt", "noext", "a.b.", "a.b c",
         "ü.Äx", "line\nbreak.txt", "x.t\nt"]


def values(spark, rows, column):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i INT, v STRING")
    return [r[0] for r in df.orderBy("i").select(column.alias("o")).collect()]


def test_suffix_and_stem(spark):
    assert values(spark, NAMES, P.suffix("v")) == [PurePosixPath(n).suffix for n in NAMES]
    assert values(spark, NAMES, P.stem("v")) == [PurePosixPath(n).stem for n in NAMES]
    assert values(spark, NAMES, P.extension("v")) == [PurePosixPath(n).suffix.lower() for n in NAMES]


def test_base_and_dir(spark):
    paths = ["/a/b/c.txt", "/x", "rel/y", "z", "/a/b/"]
    assert values(spark, paths, P.base_name("v")) == [posixpath.basename(p) for p in paths]
    assert values(spark, paths, P.dir_name("v")) == [posixpath.dirname(p) for p in paths]


def test_normalize(spark):
    paths = ["/a/./b//c/../d", "/..", "/a/b/", "/", "/clean/path.txt", "/a/.../b", "/a/..b", "//x", "/a/b/..",
             "/a/../../c", "/x/."]
    expected = ["/" + posixpath.normpath(p).lstrip("/") for p in paths]
    assert values(spark, paths, P.normalize_path("v")) == expected


def test_join(spark):
    parts = ["b", "/abs", "", "c/d"]
    assert values(spark, parts, P.join_path(F.lit("/a"), F.col("v"))) == ["/a/b", "/abs", "/a", "/a/c/d"]
    assert values(spark, ["x"], P.join_path(F.lit("/"), F.col("v"))) == ["/x"]


def test_ancestors(spark):
    assert values(spark, ["/a/b/c", "/"], P.ancestors("v")) == [["/a", "/a/b", "/a/b/c"], []]


def test_roots(spark):
    assert values(spark, [" /a, /b "], P.roots_list("v")) == [["/a", "/b"]]
    assert values(spark, ["/a", " "], P.roots_valid(F.array("v"))) == [True, False]


def test_format_bytes(spark):
    sizes = [0, 1, 1023, 1024, 1280, 1536, 1_048_575, 1_048_576, 1_073_741_823, 1_073_741_824, 5_368_709_120]
    df = spark.createDataFrame([(s,) for s in [*sizes, None]], "s BIGINT")
    got = [r[0] for r in df.select(S.format_bytes("s")).collect()]
    assert got == ["0 B", "1 B", "1023 B", "1.0 KB", "1.3 KB", "1.5 KB", "1024.0 KB", "1.0 MB", "1024.0 MB",
                   "1.00 GB", "5.00 GB", "—"]


def test_shares_rates_defaults(spark):
    df = spark.createDataFrame([(1, 3, 2.0, ""), (0, 0, 0.0, None), (1, 8, 0.5, "Code")],
                               "a BIGINT, b BIGINT, t DOUBLE, c STRING")
    got = df.select(S.percent_share("a", "b"), S.rate("b", "t"), S.or_default("c")).collect()
    assert [tuple(r) for r in got] == [(33, 1.5, "Others"), (0, 0.0, "Others"), (13, 16.0, "Code")]


def test_page_arithmetic(spark):
    assert [S.clamp_limit(x) for x in (-1, 0, 5, 5000)] == [1, 1, 5, 1000]
    assert S.clamp_offset(-3) == 0 and S.clamp_page(9, 101) == 2 and S.clamp_page(-1, 0) == 0
    df = spark.createDataFrame([(0,), (50,), (51,)], "n BIGINT")
    assert [r[0] for r in df.select(S.page_count("n")).collect()] == [1, 1, 2]


def test_time_round_trip(spark):
    df = spark.createDataFrame([(1704067200.123457,), (0.5,)], "t DOUBLE")
    assert [r[0] for r in df.select(S.to_epoch(S.to_ts("t"))).collect()] == [1704067200.123457, 0.5]


def test_digests(spark):
    import hashlib

    import xxhash

    df = spark.createDataFrame([("abc",), ("",)], "v STRING")
    got = df.select(fingerprint("v"), xxh64_fingerprint("v")).collect()
    for text, row in zip(["abc", ""], got):
        assert row[0] == hashlib.sha256(text.encode()).hexdigest()
        assert row[1] == xxhash.xxh64_hexdigest(text.encode()) and len(row[1]) == 16


GLOB_TEXTS = ["abc", "a.c", "a\nc", "[x]", "a-b", "a]b", "ABC", "", "a^b", "!a", "a&&b", "x\\y", "{a}", "aüc"]
GLOBS = ["*", "a*c", "a?c", "[x]", "[[]x]", "a[!-]b", "a[]]b", "a[^]b", "[!a]*", "a[b-a]c", "a[a-c]c", "[", "a[", "*b*",
         "b*", "*c", "", "?", "[]", "[!]", "a[&&]*", "x[\\]y", "{*}", "a[!b-a]c", "**c", "a[b-]b", "[-x]*", "a[]-]b"]


def test_globs(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(GLOB_TEXTS)], "i INT, v STRING").orderBy("i")
    rows = df.select(*[glob_match("v", g).alias(f"g{i}") for i, g in enumerate(GLOBS)]).collect()
    for text, row in zip(GLOB_TEXTS, rows):
        for i, glob in enumerate(GLOBS):
            assert row[i] == fnmatch.fnmatchcase(text.lower(), glob.lower()), (text, glob, glob_to_regex(glob))


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ab-]![^*?.&\\|", max_size=7), min_size=20, max_size=20),
       st.lists(st.text("ab-]![^.&\\|", max_size=5), min_size=10, max_size=10))
def test_random_globs(spark, globs, texts):
    pattern = spark.sparkContext._jvm.java.util.regex.Pattern
    for glob in globs:
        compiled = pattern.compile(glob_to_regex(glob))
        for text in texts:
            assert compiled.matcher(text).find() == fnmatch.fnmatchcase(text, glob), (glob, text)


def test_regexes(spark):
    patterns = [r"tax_\d{4}", r"^inv", r"(?P<a>x)(?P=a)", r"end\Z", r"\w+ü$", r"a.c", r"\\Z"]
    texts = ["TAX_2024.pdf", "my tax_12", "Invoice", "xx", "x", "the end", "the end\n", "GrünÜ", "a\nc", "a\rc", "\\Z"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, v STRING").orderBy("i")
    rows = df.select(*[regex_match("v", p).alias(f"r{i}") for i, p in enumerate(patterns)]).collect()
    for text, row in zip(texts, rows):
        for i, p in enumerate(patterns):
            assert row[i] == bool(re.search(p, text, re.IGNORECASE)), (text, p)


def test_pattern_checks(spark):
    assert not python_compiles("a(") and python_compiles("a(b)")
    for pattern in (r"tax_\d{4}", "^x", r"(a|b)+\.txt$", "[a-c_0-9]?", "a{2,}b*?", "[^.]+"):
        assert same_in_java(pattern), pattern
    for pattern in ("[x&&y]", "[[:alpha:]]", r"\w+", "(?P<x>a)(?P=x)", "a(?(1)b|c)", "a++", "{,3}", "(?=a)", "é", r"[\w]", "[]a]"):
        assert not same_in_java(pattern), pattern


def test_later_category_holds_a_shared_extension():
    table = category_by_extension()
    assert table[".ts"] == "Code" and table[".mp4"] == "Videos" and len(table) == len(set(table))
    assert os.path.splitext("a.TS")[1].lower() in table


@pytest.mark.parametrize("number,expected", [(0, "a.txt"), (7, "a_(7).txt")])
def test_numbered(spark, number, expected):
    assert values(spark, ["a.txt"], P.numbered_name(P.stem("v"), F.lit(number), P.suffix("v"))) == [expected]
