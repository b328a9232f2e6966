"""Rule classification: defaults, match types, priority, broken patterns, equal forms."""

import fnmatch
import os
import re

import pytest
from pyspark.sql import functions as F

from lakeledger.functions.paths import extension
from lakeledger.operators import classify as K, rules as R

RULES = "id BIGINT, name STRING, pattern STRING, match_type STRING, category STRING, target_folder STRING, " \
        "priority INT, enabled BOOLEAN"
EXPECTED = {
    "Images": ".jpg .jpeg .png .webp .gif .heic", "Videos": ".mp4 .avi .mkv .mov", "Audio": ".mp3 .wav .flac .aac",
    "Documents": ".pdf .docx .txt .xlsx", "Code": ".py .js .ts .rs .go", "Archives": ".zip .tar .7z .rar",
}


def files(spark, *names):
    return spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id BIGINT, name STRING").withColumn(
        "extension", extension("name"))


def rules(spark, *rows):
    return spark.createDataFrame(list(rows), RULES)


def categories(df):
    return {r["name"]: (r["category"], r["target_folder"], r["confidence"], r["rule_name"]) for r in df.collect()}


def test_default_table(spark):
    names = {f"f{e}": c for c, es in EXPECTED.items() for e in es.split()}
    names.update({"f.xyz": "Others", "plain": "Others", "UPPER.PDF": "Documents"})
    got = {r["name"]: r["category"] for r in K.classify_default(files(spark, *names)).collect()}
    assert got == names


def test_confidence_without_rules(spark):
    got = categories(K.classify(files(spark, "a.pdf", "b.xyz"), rules(spark)))
    assert got == {"a.pdf": ("Documents", "Documents", 0.95, None), "b.xyz": ("Others", "Others", 0.5, None)}


@pytest.mark.parametrize("form", ["fold", "vectorised"])
def test_rules(spark, form):
    table = rules(
        spark,
        (1, "ext", ".pdf", "extension", "Finance", "Finance", 100, True),
        (2, "inv", "*invoice*", "glob", "Invoices", "Finance/Invoices", 50, True),
        (3, "tax", r"tax_\d{4}", "regex", "Tax", "Finance/Tax", 50, True),
        (4, "off", ".txt", "extension", "Never", "X", 999, False),
        (5, "low", ".pdf", "extension", "Low", "Low", 10, True),
        (6, "broken", "a(", "regex", "Never", "X", 1000, True),
        (7, "set", "img_[0-9]?.[!p]*", "glob", "Shots", "Shots", 1, True),
    )
    got = categories(K.classify(files(spark, "r.PDF", "My INVOICE_1.xyz", "a tax_2024.txt", "n.txt", "Img_12.jpg",
                                      "img_12.png", "invoice tax_2024"), table, form))
    assert got == {
        "r.PDF": ("Finance", "Finance", 1.0, "ext"),
        "My INVOICE_1.xyz": ("Invoices", "Finance/Invoices", 1.0, "inv"),
        "a tax_2024.txt": ("Tax", "Finance/Tax", 1.0, "tax"),
        "n.txt": ("Documents", "Documents", 0.95, None),
        "Img_12.jpg": ("Shots", "Shots", 1.0, "set"),
        "img_12.png": ("Images", "Images", 0.95, None),
        "invoice tax_2024": ("Invoices", "Finance/Invoices", 1.0, "inv"),
    }
    assert [r["id"] for r in R.quarantined_rules(table).collect()] == [6]


def test_patterns_that_only_python_accepts(spark):
    table = rules(spark, (1, "cond", r"(a)?b(?(1)c|d)", "regex", "Cond", "Cond", 1, True))
    got = categories(K.classify(files(spark, "abc", "bd", "bc"), table))
    assert {n: v[0] for n, v in got.items()} == {"abc": "Cond", "bd": "Cond", "bc": "Others"}
    assert [r["n_files"] for r in K.rule_hits(files(spark, "abc", "bd", "bc"), table).collect()] == [2]


def test_many_rules_same_result(spark):
    many = [(i, f"r{i}", f"*{i:03d}*", "glob", f"c{i}", "t", i % 5, True) for i in range(1, 250)]
    data = files(spark, *[f"file{i:04d}.txt" for i in range(0, 400, 7)])
    ruleset = R.load_rules(rules(spark, *many))
    fold = categories(K.classify(data, ruleset, "fold"))
    assert fold == categories(K.classify(data, ruleset)) == categories(K.classify(data, ruleset, "vectorised"))


def test_all_matches_and_winner(spark):
    table = rules(spark, (1, "a", "*x*", "glob", "A", "t", 5, True), (2, "b", ".txt", "extension", "B", "t", 5, True),
                  (3, "c", "^x", "regex", "C", "t", 9, True))
    data = files(spark, "x.txt", "ax.txt", "y.md")
    hits = {r["rule_id"]: r["n_files"] for r in K.rule_hits(data, table).collect()}
    assert hits == {1: 2, 2: 2, 3: 1}
    assert {r["id"]: r["rule_id"] for r in K.best_matches(data, table).collect()} == {0: 3, 1: 1}
    fold = sorted(K.rule_matches(data, table, "fold").collect())
    assert fold == sorted(K.rule_matches(data, table, "vectorised").collect()) and len(fold) == 5
    assert K.rule_hits(data, table.limit(0)).count() == 0


def test_fallback_only_where_nothing_matched(spark):
    seen = lambda name, ext: F.concat(F.lit("ml:"), name)
    got = categories(K.classify(files(spark, "a.pdf", "b"), rules(spark), fallback=seen))
    assert got["a.pdf"][0] == "Documents" and got["b"][:3] == ("ml:b", "ml:b", 0.5)


def test_classification_is_one_projection(spark):
    table = rules(spark, (1, "a", "*x*", "glob", "A", "t", 5, True))
    plan = K.classify(files(spark, "x"), table)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and "Python" not in plan


def test_validation(spark):
    table = rules(spark, (1, "", "", "fuzzy", "c" * 65, "", 1001, True), (2, "n" * 128, "p", "glob", "c" * 64, "t", 1000, True),
                  (3, None, "p", None, "c", "t", None, True))
    got = {r["id"]: len(r["reasons"]) for r in R.validate_rules(table).collect()}
    assert got == {1: 6, 2: 0, 3: 3}


@pytest.mark.parametrize("fillers", [0, 199, 200, 400])
def test_the_number_of_rules_changes_nothing(spark, fillers):
    table = rules(spark, (1, "set", "[x&&y]", "regex", "Set", "t", 9, True), (2, "end", "^$", "regex", "Blank", "t", 8, True),
                  (3, "all", "*z*", "glob", "All", "t", 7, True), (4, "word", r"\bq", "regex", "Word", "t", 6, True),
                  *[(100 + i, f"f{i}", f"nothing{i}*", "glob", "F", "t", 1, True) for i in range(fillers)])
    got = categories(K.classify(files(spark, "x", "&", "z.md", "b q", "", None), table))
    assert {n: v[0] for n, v in got.items()} == {"x": "Set", "&": "Set", "z.md": "All", "b q": "Word", "": "Blank", None: "Others"}


def test_list_rules(spark):
    table = rules(spark, (1, "a", "p", "glob", "c", "t", 5, True), (2, "b", "p", "glob", "c", "t", 9, True),
                  (3, "c", "p", "glob", "c", "t", 5, True))
    assert [r["id"] for r in R.list_rules(table).collect()] == [2, 1, 3]


def test_changes(spark):
    table = rules(spark, (1, "a", "p", "glob", "c", "t", 5, True), (2, "b", "p", "glob", "c", "t", 9, True))
    changes = spark.createDataFrame([
        (1, 1, "update", None, 7, None), (1, 2, "update", "new", None, None),
        (2, 3, "delete", None, None, None),
        (3, 4, "create", "made", None, "q"), (3, 5, "update", None, 3, None),
        (4, 6, "update", "ghost", None, None),
        (5, 7, "update", "early", 9, None), (5, 8, "create", "late", None, "r"),
        (2, 9, "create", "again", None, "s"),
        (6, 10, "upsert", "up", None, "u"), (6, 11, "delete", None, None, None),
    ], "id BIGINT, seq INT, op STRING, name STRING, priority INT, pattern STRING")
    got = {r["id"]: (r["name"], r["pattern"], r["match_type"], r["priority"], r["enabled"])
           for r in R.apply_changes(table, changes, defaults=R.RULE_DEFAULTS).collect()}
    assert got == {
        1: ("new", "p", "glob", 7, True), 2: ("again", "s", "glob", 0, True), 3: ("made", "q", "glob", 3, True),
        5: ("late", "r", "glob", 0, True),
    }


def test_maintenance_validates_updates_too(spark):
    table = rules(spark, (1, "a", "p", "glob", "c", "t", 5, True), (2, "b", "p", "glob", "c", "t", 9, True))
    changes = spark.createDataFrame([
        (1, 1, "update", None, 5000, None, None), (2, 2, "update", None, 7, None, None),
        (3, 3, "create", "x", None, "c", "t"), (4, 4, "create", "", None, "c", "t"), (2, 5, "update", None, None, "", None),
    ], "id BIGINT, seq INT, op STRING, name STRING, priority INT, category STRING, target_folder STRING")
    changes = changes.withColumn("pattern", F.when(F.col("op") == "create", F.lit("*.x")))
    after, rejected = R.maintain_rules(table, changes)
    assert {r["id"]: (r["name"], r["priority"], r["enabled"]) for r in after.collect()} == \
        {1: ("a", 5, True), 2: ("b", 9, True), 3: ("x", 0, True)}
    assert {r["id"]: list(r["reasons"]) for r in rejected.collect()} == {
        1: ["priority must be between 0 and 1000"], 2: ["category must have 1 to 64 characters"],
        4: ["name must have 1 to 128 characters"]}


NAMES = ["Tax_2023.PDF", "tax_20é.pdf", "ſTRASSE.txt", "K-report", "İx", "ıx", "x.y", "", "中文报告.docx", "a[b].c", "q*r", "invoice 7 (final).doc",
         "UPPER lower", "line\nbreak", "ab", "b", "aXb", "straße", "sTrasse"]
PATTERNS = [("glob", "*tax_20*"), ("glob", "TAX*"), ("glob", "*.pdf"), ("glob", "*"), ("glob", "?"), ("glob", "[a-z]?"), ("glob", "a[[]b].c"), ("glob", "q[*]r"),
            ("glob", "*报告*"), ("glob", "*strasse*"), ("glob", "i\u0307x"), ("glob", "ab"), ("glob", "*[!0-9].c"), ("glob", "x.y"), ("glob", "**voice*7*"),
            ("regex", r"tax_\d{2,4}"), ("regex", "strasse"), ("regex", "k-re"), ("regex", "ix"), ("regex", "(invoice|bill) [0-9]"), ("regex", "(voice){1,2} 7"),
            ("regex", "^$"), ("regex", "."), ("regex", "(?i:UPP)er"), ("regex", "a(?=X)"), ("regex", "(unclosed"), ("regex", "报告"), ("regex", r"\blower$"),
            ("regex", "line.break"), ("regex", "(?s)line.break"), ("regex", "[[:x"), ("regex", "(?x) x  [.] y"), ("extension", ".PDF"), ("extension", ".txt")]


def table_of(spark, patterns):
    return rules(spark, *[(i + 1, f"r{i}", p, m, f"c{i}", "t", i % 4, i % 7 != 5) for i, (m, p) in enumerate(patterns)])


def test_rules_as_a_table_match_what_python_matches(spark):
    import fnmatch
    import re
    import warnings

    warnings.simplefilter("ignore")
    table, df = table_of(spark, PATTERNS), files(spark, *NAMES, None)
    expected = set()
    for row in df.collect():
        for r in table.collect():
            if not r["enabled"]:
                continue
            if r["match_type"] == "extension":
                hit = row["extension"] is not None and row["extension"].lower() == r["pattern"].lower()
            elif row["name"] is None:
                hit = False
            elif r["match_type"] == "glob":
                hit = fnmatch.fnmatchcase(row["name"].lower(), r["pattern"].lower())
            else:
                try:
                    hit = re.search(r["pattern"], row["name"], re.I) is not None
                except re.error:
                    hit = False
            if hit:
                expected.add((row["name"], r["id"]))
    found = [(r["name"], r["rule_id"]) for r in K.rule_matches(df, table, "table").collect()]
    assert set(found) == expected and len(found) == len(expected)
    best = {r["name"]: r["rule_name"] for r in K.classify(df, table, "table").collect()}
    order = {r["id"]: (-(r["priority"] or 0), r["id"], r["name"]) for r in table.collect()}
    assert best == {n: min([order[i] for m, i in expected if m == n], default=(0, 0, None))[2] for n in [*NAMES, None]}
    assert categories(K.classify(df, table, "table")) == categories(K.classify(df, table))


def test_many_rules_stay_a_table(spark):
    many = table_of(spark, [("glob", f"*{i}*x") for i in range(R.FOLDED_RULES * 2)])
    with pytest.raises(ValueError):
        R.load_rules(many)
    df = files(spark, "a17bx", "a999", "zzzx")
    got = {r["name"]: r["rule_name"] for r in K.classify(df, many).collect()}
    assert got == {"a17bx": "r7", "a999": None, "zzzx": None}
    assert K.rule_hits(df, many).count() == 3


def test_a_pattern_with_a_piece_no_name_has_is_never_tested(spark):
    from lakeledger.operators import rule_index as I

    assert I.describe_pattern("regex", "(?:abc)+d?ef")[2] == ["abc"]
    assert I.describe_pattern("glob", "*ab?cdef*")[2] == ["cde", "def"]
    assert I.describe_pattern("glob", "*a?b*")[2] == ["a"] and I.describe_pattern("regex", r"\d+")[2] == [""]


def test_quarantine_is_a_filter_of_the_table(spark):
    table = table_of(spark, PATTERNS)
    assert sorted(r["pattern"] for r in R.quarantined_rules(table).collect()) == ["(unclosed", "[[:x"]


def test_names_meet_patterns_on_whole_runs(spark):
    """Pairs to test follow what matches, not names times patterns: three letters of a number are in many names, the whole number in one."""
    from lakeledger.operators import rule_index as I

    assert I.describe_pattern("glob", "*-123456.?*", I.LONGEST)[2] == ["-123456."]
    assert I.describe_pattern("glob", "*" + "ab" * 20 + "*", I.LONGEST)[2] == ["ab" * 16, "ba" * 16]
    names = spark.range(100000, 101000).selectExpr("concat('Cust-', id, '.low') AS name")
    asked = spark.range(100000, 101000).selectExpr("concat('-', id, '.') AS key").unionByName(spark.createDataFrame([("",), ("w",), ("gone",)], "key STRING"))
    met = I._met_keys(names, asked).groupBy(F.length("key")).count().collect()
    assert {tuple(r) for r in met} == {(8, 1000), (0, 1000), (1, 1000)}
    twice = spark.createDataFrame([("abcabc",), ("",)], "name STRING")
    held = I._met_keys(twice, spark.createDataFrame([("abc",), ("b",), ("",), ("ca",), ("abcabcd",)], "key STRING")).collect()
    assert sorted(map(tuple, held)) == sorted([("abc", "abcabc"), ("b", "abcabc"), ("", "abcabc"), ("ca", "abcabc"), ("", "")])


def test_counted_hits_make_no_row_per_file_and_rule(spark):
    table = table_of(spark, [*PATTERNS, *[("extension", ".TXT")] * 5, *[("glob", "*a*")] * 5])
    table = table.unionByName(table.filter("id < 3"))            # rows that come twice
    df = files(spark, *NAMES, *NAMES[:5], "a.txt", "a.txt", None)
    found = K.rule_matches(df, table, "table")
    expected = found.groupBy("rule_id", "rule_name").agg(F.count(F.lit(1)).alias("n_files"))
    assert sorted(map(tuple, K.rule_hits(df, table, "table").collect())) == sorted(map(tuple, expected.collect()))
    counted = K.rule_matches(df, table, "table", counted=True)
    assert "name" not in counted.columns and counted.count() <= table.count() < found.count()
    once = table.dropDuplicates(["id"])
    assert sorted(map(tuple, K.rule_hits(df, once).collect())) == sorted(map(tuple, K.rule_hits(df, once, "table").collect()))


def test_pieces_of_names_begin_and_end_like_keys(spark):
    """Of a name only those pieces meet patterns that begin, end and are as long as a key; digits alone made one for every length at every place."""
    from lakeledger.operators import rule_index as I

    names = spark.range(100000, 101000).selectExpr("concat('Cust', id, '-', id, '.low') AS name", "id AS other")
    asked = spark.range(100000, 101000).selectExpr("concat(substr(CAST(id AS STRING), 1, 3 + id % 4), '-') AS key").distinct()
    held = I._pieces(names, I._begins(asked), (0, 1))
    assert held.columns == ["name", "other", "key"] and held.filter("key NOT LIKE '%-'").isEmpty()
    assert held.count() <= 5000 and held.distinct().count() == held.count()
    shares = [I._pieces(names, I._begins(asked), (p, 3)) for p in range(3)]
    assert sorted(map(tuple, shares[0].union(shares[1]).union(shares[2]).collect())) == sorted(map(tuple, held.collect()))


def test_passes_change_nothing(spark, monkeypatch):
    from lakeledger.operators import rule_index as I

    table = table_of(spark, [*PATTERNS, *[("extension", ".TXT")] * 5, *[("glob", "*a*")] * 5])
    table = table.unionByName(table.filter("id < 3"))
    df = files(spark, *NAMES, *NAMES[:5], "a.txt", "a.txt", None)
    counted, best = K.rule_matches(df, table, "table", counted=True).collect(), K.classify(df, table, "table").collect()
    every = K.rule_matches(df, table, "table").collect()
    monkeypatch.setattr(I, "PASS_NAMES", 1)
    assert sorted(map(str, K.rule_matches(df, table, "table", counted=True).collect())) == sorted(map(str, counted))
    assert sorted(map(str, K.classify(df, table, "table").collect())) == sorted(map(str, best))
    assert sorted(map(str, K.rule_matches(df, table, "table").collect())) == sorted(map(str, every))


def test_the_jvm_tests_what_java_reads_alike(spark):
    from lakeledger.operators import rule_index as I

    assert I.describe_pattern("regex", "^cust0*7-[0-9]+[.](low|high)$")[3:] == ("(?iudU)^cust0*7-[0-9]+[.](low|high)$", "7-")
    for kind, pattern in (("regex", r"\bab"), ("regex", "é.b"), ("glob", "*[a-c]x*"), ("glob", "é?x*"), ("glob", "?" * (I.SHORT + 1)), ("regex", "(")):
        assert I.describe_pattern(kind, pattern)[3] is None
    names = ["Cust7-12.LOW", "cust007-3.low", "cust17-3.low", "CU\u017fT7-1.low", "cust7-1.low\n", "cust7-12\u0663.low", "cust7-" + "1" * I.SHORT + ".low", "x-3.lo"]
    table = table_of(spark, [("regex", "^cust0*7-[0-9]+[.](low|high)$"), ("regex", "[.]LO.?$"), ("glob", "*7-?*.l*w"), ("glob", "X-?.??"), ("regex", "(st|x)+\\d*-")])
    expected = set()
    for row in table.collect():
        for name in names:
            if fnmatch.fnmatchcase(name.lower(), row["pattern"].lower()) if row["match_type"] == "glob" else re.search(row["pattern"], name, re.I):
                expected.add((name, row["id"]))
    found = [(r["name"], r["rule_id"]) for r in K.rule_matches(files(spark, *names), table, "table").collect()]
    assert sorted(found) == sorted(expected)


def test_sparing_steps_leave_no_shuffle_files(spark):
    import time

    from lakeledger.session import cut_lineage

    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def shuffled():
        return sum(f.startswith("shuffle_") for top in disk.localDirsString() for _, _, found in os.walk(top) for f in found)

    rows = spark.range(1000).selectExpr("id % 100 AS k").groupBy("k").count()
    before = shuffled()
    step = cut_lineage(rows, sparing=True)
    assert len(step.collect()) == 100
    deadline = time.time() + 20
    while shuffled() > before and time.time() < deadline:
        time.sleep(0.2)
    assert shuffled() <= before and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) is None


def _left(spark, run):
    """What ``run`` returns collected, and the rows of the tables that it leaves in the checkpoint folder."""
    from lakeledger.session import checkpoint_folder

    top = checkpoint_folder(spark).removeprefix("file:")
    before = set(os.listdir(top)) if os.path.isdir(top) else set()
    result = run()
    left = [f"{top}/{x}" for x in set(os.listdir(top)) - before]
    return result.collect(), sum(spark.read.parquet(x).count() for x in left)


def test_counted_hits_leave_a_row_per_pattern_on_disk(spark):
    df = files(spark, *(f"Cust{i}-{i}.low" for i in range(300, 500)))
    table = table_of(spark, [("glob", f"cust{i}-*") for i in range(300, 500)] + [("regex", f"^cust0*{i}-[0-9]+[.]") for i in range(300, 400)])
    table = table.withColumn("enabled", F.lit(True)).withColumn("priority", F.lit(0))
    found, rows = _left(spark, lambda: K.rule_matches(df, table, "table", counted=True))
    assert len(found) == 300 and all(r["n_files"] == 1 for r in found)
    assert rows == 300 + 1          # and that of the only extension


def test_best_rules_leave_a_row_per_name_on_disk(spark):
    df = files(spark, *(f"Cust{i}-{i}.low" for i in range(300, 500)), "a.x7", "b")
    table = table_of(spark, [("glob", f"cust{i}-*") for i in range(300, 500)] + [("regex", f"^cust0*{i}-[0-9]+[.]") for i in range(300, 400)]
                     + [("extension", f".x{i}") for i in range(50)])
    table = table.withColumn("enabled", F.lit(True)).withColumn("priority", F.lit(0))
    found, rows = _left(spark, lambda: K.classify(df, table, "table"))
    assert {r["name"]: r["rule_name"] for r in found} == {**{f"Cust{i}-{i}.low": f"r{i - 300}" for i in range(300, 500)}, "a.x7": "r307", "b": None}
    assert rows == 200 + 1          # the best rule of each name, and of the only extension with files and a rule
