"""Line dedup, source divergence and the prefix trie on small awkward tables, against brute force and SQL."""

import random

import duckdb
import pytest
from brute import prefix_nodes, repeated_lines, source_divergence
from pyspark.sql import functions as F

from lakeledger.llm import divergence, lines, prefix_trie
from lakeledger.llm.queries import ORACLE, QUERIES
from lakeledger.session import cut_lineage

rng = random.Random(3)
SF = "/root/testdata/sf0.001"


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is not None, x) for x in r))


# ---- lines


LINES = [(i, "\n".join(rng.choice(["Common line", "  common LINE\t", "", " \x0b", "rare %d" % i, "twice", "é\x85", "\u3000x"]) for _ in range(rng.randint(1, 6))))
         for i in range(40)]
LINES += [(100, None), (101, ""), (102, "\n"), (103, "common line"), (104, "twice\r\ntwice"), (105, "x" * 90_000), (106, "common line\n" * 30_000)]


@pytest.mark.parametrize("least,keep_first,more", [(10, False, {}), (10, True, {}), (2, True, {"max_sent": 0}), (3, False, {"max_bits": 64})])
def test_lines(spark, least, keep_first, more):
    docs = spark.createDataFrame(LINES, "doc_id int, text string").withColumn("_key", F.lit("x")).withColumn("n_lines", F.lit(0))
    docs = cut_lineage(docs.repartition(3))
    done = lines.drop_repeated(docs, min_documents=least, keep_first=keep_first, **more)
    assert done.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, bytes(r.kept)) for r in done.collect()) == sorted(repeated_lines(LINES, least, keep_first))


def test_lines_of_rows_that_share_an_id(spark):
    docs = spark.createDataFrame([(1, "a\nA\nb"), (1, "a\nc"), (None, "a\nd"), (2, "a")], "doc_id long, text string")
    done = lines.drop_repeated(docs, min_documents=4, keep_first=True).collect()
    assert sorted((r.doc_id or 0, bytes(r.kept)) for r in done) == [(0, b"d"), (1, b"a\nb"), (1, b"a\nc"), (2, b"")]
    with pytest.raises(ValueError):
        lines.drop_repeated(docs, min_documents=1)


def test_twice_has_no_false_negatives():
    import numpy as np
    generator = np.random.default_rng(0)
    filters = lines.Filters(3, 5000)
    keys = [np.sort(generator.integers(0, 2**63, 900).astype(np.uint64)) for _ in range(3)]
    keys[2] = np.sort(np.concatenate([keys[2], keys[0][:50], keys[1][:50]]))
    import pyarrow as pa
    bits = []
    for segment in range(3):
        rows = []
        for one in keys:
            a, b = filters.places(one[filters.segment(one) == segment] ^ np.uint64(5))
            rows.append((segment, lines.planes(a), lines.planes(b), np.packbits(np.zeros(len(a), bool)).tobytes()))
        table = pa.table(dict(zip(["segment", "a", "b", "several"], map(list, zip(*rows)))))
        bits += [(r["segment"], r["bits"]) for r in filters.fill(table).to_pylist()]

    class Sent:
        value = bits

    let = lines.Suspects(filters, Sent())(keys[2], keys[2] ^ np.uint64(5))
    repeated = np.isin(keys[2], np.concatenate(keys[:2]))
    assert repeated.sum() == 100 and let[repeated].all() and let[~repeated].mean() < 0.2


# ---- divergence


def small_docs():
    words = ["Ab", "ab", "é", "x1y", "long-word", "ﬁ", "zz", "\U0001F600", "Q"]
    rows = [(rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "s10", None]), " ".join(rng.choice(words[:rng.randint(1, 9)]) for _ in range(rng.randint(0, 30))))
            for _ in range(120)]
    return rows + [("en", "silent", None), ("en", "silent", "123"), ("fr", "only", "alone " * 5), ("fr", "other", ""), ("it", "one", "sola " * 9),
                   ("en", "s1", "ab " * 40_000)] + [("it", "one", "sola")] * 12


@pytest.mark.parametrize("entries", [divergence.SLICE_ENTRIES, 2])
def test_divergence(spark, entries):
    rows = small_docs()
    docs = spark.createDataFrame(rows, "lang string, source string, text string").withColumn("value", F.lit(1)).withColumn("term", F.lit("t"))
    got = divergence.audit(docs.repartition(4), slice_entries=entries)
    assert ordered(got.collect()) == ordered(source_divergence(rows))
    assert {r.part for r in got.collect()} == {"pair", "term"}


def test_shares_are_exact_beyond_long():
    import numpy as np
    big = np.array([10**13, 5], np.int64)
    assert divergence.shares(big, 2 * 10**13, 7).tolist() == [1 + 10**9 * (c + 2) // (2 * 10**13 + 14) for c in big.tolist()]


def test_share_column_is_exact_beyond_long(spark):
    row = spark.range(1).select(divergence.share(F.lit(10**13), F.lit(2 * 10**13), F.lit(7)).alias("p")).first()
    assert row.p == 1 + 10**9 * (10**13 + 2) // (2 * 10**13 + 14)


def test_runs_meet_at_all_boundaries():
    import numpy as np
    width = np.array([3, 1, 4, 2, 5])
    starts = np.cumsum(width) - width
    a, b = np.array([5, 5, 9, 9, 5]), np.array([7, 2, 2, 2, 7])
    expected = sum(int(w) * ((int(x) - int(y)) ** 2 // (int(x) + int(y))) for w, x, y in zip(width, a, b))
    encoded = divergence.runs(a, starts), divergence.runs(b, starts)
    assert [len(v) for v, _ in encoded] == [3, 3] and divergence.divergence(*encoded, int(width.sum())) == expected


# ---- prefix trie


def small_conversations():
    rows = []
    for c in range(-7, 60):
        for t in range(rng.choice([1, 1, 2, 3, 9, 12])):
            rows.append((c, rng.choice([t, t, None]), rng.choice(["user", None, ""]), rng.choice(["hello", "é", None, "", "b:c"])))
    rows += [(70, t, "user", "same") for t in range(300)] + [(71, t, "user", "same") for t in range(310)]
    rows += [(80, 1, "a", "b")] * 5 + [(None, 1, "a", "b"), (1000, 0, "user", "y" * 70_000)] + [(c, t, "u", str(t)) for c in (90, 95) for t in range(20)]
    # neither rest: the family head is absent, and there are no own turns after the borrowed ones
    return rows + [(c, 0, "user", "gone") for c in (201, 202, 203, 204)]


def by_turn_id(rows):
    """Ties of position in the operator's order, as positions."""
    import hashlib
    def turn_id(role, text):
        role, text = role or "", text or ""
        return hashlib.md5(f"{len(role)}:{role}:{text}".encode()).hexdigest() + f":{len(text.encode())}"
    kept = sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, turn_id(*r[2:])))
    return [(c, i, role, text) for i, (c, _, role, text) in enumerate(kept)]


@pytest.mark.parametrize("width,partitions", [(8, 1), (3, 7)])
def test_trie(spark, width, partitions):
    rows = small_conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("n", F.lit(0)).withColumn("block", F.lit(1))
    got = prefix_trie.trie(df.repartition(partitions), width=width).collect()
    expected = prefix_nodes(by_turn_id(rows))
    assert ordered(got) == ordered(expected)
    assert max(r.depth for r in got) > 250 and any(r.n_convs > 5 for r in got)


def test_trie_slices_of_long_conversations(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SLICE", 2)
    rows = [(c, t, "u", str(t % 7)) for c in (0, 5, 10) for t in range(40 + c)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert ordered(prefix_trie.trie(df, width=2).collect()) == ordered(prefix_nodes(by_turn_id(rows)))


def test_ends_in_pieces(spark, monkeypatch):
    import hashlib
    monkeypatch.setattr(prefix_trie, "PIECE_BYTES", 40)
    rows = [("a", i) for i in range(2000)] + [("b", 7), ("b", -7)]
    got = {r.node: r.ends_sha256 for r in prefix_trie.ends_digest(spark.createDataFrame(rows, "node string, conv_id long")).collect()}
    assert got == {"a": hashlib.sha256(",".join(map(str, range(2000))).encode()).hexdigest(), "b": hashlib.sha256(b"-7,7").hexdigest()}


@pytest.mark.parametrize("name", ["op11_divergence", "op12_prefix_trie", "op13_lines"])
def test_like_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = QUERIES[name](spark, SF)
    expected = con.sql(f"SELECT {', '.join(df.columns)} FROM ({ORACLE[name]})").fetchall()
    assert ordered(df.collect()) == ordered(expected)
