"""Collision numbering against a sequential model."""

import random
from functools import cache
from pathlib import PurePosixPath

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from lakeledger.operators.naming import assign_numbers, first_free_number, numbered_parents
from pyspark.sql import functions as F


@cache
def candidate(name, i):
    p = PurePosixPath(name)
    return name if i == 0 else f"{p.stem}_({i}){p.suffix}"


def sequential(rows, existing, limit=999):
    held = set(existing)
    out = {}
    for id_, folder, name in sorted(rows):
        number = next((i for i in range(limit + 1) if (folder, candidate(name, i)) not in held), None)
        out[id_] = number
        if number is not None:
            held.add((folder, candidate(name, number)))
    return out


def run(spark, rows, existing, **kw):
    df = spark.createDataFrame(rows, "id BIGINT, dest_dir STRING, name STRING")
    there = spark.createDataFrame(existing, "dest_dir STRING, name STRING")
    return {r["id"]: r["number"] for r in assign_numbers(df, there, **kw).collect()}


def many_cases(seed, n_folders, names, max_rows, max_existing):
    """Independent cases, one folder each, so that one Spark run checks all of them."""
    rng = random.Random(seed)
    rows, existing, id_ = [], set(), 0
    for f in range(n_folders):
        pool = rng.sample(names, rng.randint(1, len(names)))
        for _ in range(rng.randint(1, max_rows)):
            rows.append((id_, f"/d{f}", rng.choice(pool)))
            id_ += 1
        for _ in range(rng.randint(0, max_existing)):
            existing.add((f"/d{f}", candidate(rng.choice(names), rng.randint(0, 3))))
    ids = [r[0] for r in rows]
    rng.shuffle(ids)
    rows = [(i, d, n) for i, (_, d, n) in zip(ids, rows)]
    return rows, sorted(existing)


@pytest.mark.parametrize("names", [
    ["a.txt", "a_(1).txt", "a_(2).txt", "b.txt"],
    ["a.txt", "a_(1).txt", "a_(1)_(1).txt", "a_(1)_(2).txt", "a_(2).txt", "a_(1)_(1)_(1).txt"],
    ["x", "x_(1)", "x_(1)_(1)", "x.tar.gz", "x.tar_(1).gz", ".rc", ".rc_(1)", "x_(01)", "x_(0)"],
    ["y.", "y_(1).", "y._(1)", "y_(1)._(1)", "y_(2).", "y._(2)", "y_(1)._(2)", "y_(2)._(1)"],
])
def test_matches_sequential_model(spark, names):
    rows, existing = many_cases(len(names), 150, names, 9, 3)
    assert run(spark, rows, existing) == sequential(rows, existing)


def test_two_bases_share_a_name_nobody_arrives_under(spark):
    rows = [(1, "/d", "y_(1)."), (2, "/d", "y._(1)"), (3, "/d", "y_(1)."), (4, "/d", "y._(1)"), (5, "/d", "y_(1).")]
    assert run(spark, rows, []) == sequential(rows, [])


def test_more_files_than_names(spark):
    rows = [(i, "/d", "a.txt") for i in range(1500)] + [(5000 + i, "/d", "a_(7).txt") for i in range(3)]
    rows += [(-1, "/d", "a_(9).txt")]
    existing = [("/d", "a_(3).txt")]
    expected = sequential(rows, existing)
    assert sum(v is None for v in expected.values()) > 400
    # one salt: the ranking inside it cuts rows off, and the rest still come out right
    assert run(spark, rows, existing, salts=1) == expected


@settings(max_examples=2, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10**6))
def test_random_families(spark, seed):
    names = ["p.jpg", "p_(1).jpg", "p_(2).jpg", "p_(1)_(1).jpg", "q", "q_(1)", "q_(2)"]
    rows, existing = many_cases(seed, 60, names, 14, 4)
    assert run(spark, rows, existing) == sequential(rows, existing)


def test_preview_ignores_other_rows(spark):
    rows = spark.createDataFrame([(1, "/d", "a.txt"), (2, "/d", "a.txt"), (3, "/e", "b")],
                                 "id BIGINT, dest_dir STRING, name STRING")
    existing = spark.createDataFrame([("/d", "a.txt"), ("/d", "a_(2).txt")], "dest_dir STRING, name STRING")
    got = {r["id"]: r["number"] for r in first_free_number(rows, existing).collect()}
    assert got == {1: 1, 2: 1, 3: 0}


def test_preview_all_taken(spark):
    rows = spark.createDataFrame([(1, "/d", "a.txt")], "id BIGINT, dest_dir STRING, name STRING")
    existing = spark.createDataFrame([("/d", candidate("a.txt", i)) for i in range(1000)],
                                     "dest_dir STRING, name STRING")
    assert first_free_number(rows, existing).collect()[0]["number"] is None


def test_parents(spark):
    names = ["a_(1).txt", "a_(1)", "a.b_(1)", "_(1).txt", "a_(0).txt", "a_(1000)", "a_(1)._(2)", "a_(1).b_(2)"]
    df = spark.createDataFrame([(n,) for n in names], "name STRING")
    got = {r["name"]: {(p["base"], p["slot"]) for p in r["p"]}
           for r in df.select("name", numbered_parents(F.col("name")).alias("p")).collect()}
    for name in names:
        bases = {name.replace(f"_({i})", "", 1) for i in (1, 2)} | {"a_(1).", "a._(2)"}
        expected = {(b, i) for b in bases for i in range(1, 1000) if b and candidate(b, i) == name}
        assert got[name] == expected, name
