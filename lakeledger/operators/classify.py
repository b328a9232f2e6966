"""Classification of file names by rules and by extension.

With up to ``FOLDED_RULES`` rules everything is a projection on the rows where they are: no join, no shuffle, whatever the number of
files or however often one name occurs. More rules stay a table and are joined with the distinct names (``rule_index``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, functions as F

from ..constants import (
    DEFAULT_CATEGORY,
    FALLBACK_CONFIDENCE,
    RULE_CONFIDENCE,
    TABLE_CONFIDENCE,
    category_by_extension,
)
from ..functions.paths import extension as extension_of
from ..functions.patterns import glob_match, regex_match
from .rule_index import all_matches, best_rules, match_counts
from .rules import RuleSet, load_few_rules, load_rules


def category_of(extension: Column | str) -> Column:
    """Category of an extension, null when the table does not hold it (hash-set tests, no join)."""
    extension = F.lower(F.col(extension) if isinstance(extension, str) else extension)
    by_category: dict[str, list[str]] = {}
    for ext, category in category_by_extension().items():
        by_category.setdefault(category, []).append(ext)
    found = F.lit(None).cast("string")
    for category, extensions in by_category.items():
        found = F.when(extension.isin(extensions), F.lit(category)).otherwise(found)
    return found


def default_category(extension: Column | str) -> Column:
    return F.coalesce(category_of(extension), F.lit(DEFAULT_CATEGORY))


def classify_default(files: DataFrame) -> DataFrame:
    """Add ``category`` from the extension table alone, as a scan does."""
    return files.withColumn("category", default_category("extension"))


def rule_condition(rule: Row, name: Column | str = "name", extension: str = "extension") -> Column:
    """Whether one rule matches a file."""
    if rule["match_type"] == "extension":
        hit = F.lower(F.col(extension)) == rule["pattern"].lower()
    elif rule["match_type"] == "glob":
        hit = glob_match(name, rule["pattern"])
    else:
        hit = regex_match(name, rule["pattern"])
    return F.coalesce(hit, F.lit(False))


def _first_by(key: Column, places: dict[str, int]) -> Column:
    """Position of the first rule by an exact key: one lookup, however many rules."""
    entries = [F.lit(x) for pair in places.items() for x in pair]
    return F.element_at(F.create_map(*entries), key) if entries else F.lit(None).cast("int")


def _plain_glob(rule: Row) -> bool:
    return rule["match_type"] == "glob" and not any(ch in rule["pattern"] for ch in "*?[")


def _folded_position(rules: list[tuple[int, Row]]) -> Column:
    """Position of the first matching rule that the JVM tests: lookups for extensions and globs without wildcards, and
    one flat CASE in priority order for the rest.

    The CASE stands inside ``transform`` over the one name, which Spark evaluates without generating code: hundreds of
    rules would exceed what a generated method may hold.
    """
    by_extension: dict[str, int] = {}
    by_name: dict[str, int] = {}
    rest = []
    for i, rule in rules:
        if rule["match_type"] == "extension":
            by_extension.setdefault(rule["pattern"].lower(), i)
        elif _plain_glob(rule):
            by_name.setdefault(rule["pattern"].lower(), i)
        else:
            rest.append((i, rule))

    def first(name: Column) -> Column:
        (i, rule), *more = rest
        found = F.when(rule_condition(rule, name), F.lit(i))
        for i, rule in more:
            found = found.when(rule_condition(rule, name), F.lit(i))
        return found

    position = F.get(F.transform(F.array("name"), first), F.lit(0)) if rest else F.lit(None).cast("int")
    return _least(_first_by(F.lower("extension"), by_extension), _first_by(F.lower("name"), by_name), position)


def _least(*positions: Column) -> Column:
    """The lowest position that is not null (``least`` skips nulls)."""
    return F.least(*positions)


def _matcher(rules: list[tuple[int, str, str]]) -> Callable[[str | None, str | None], Iterator[int]]:
    import fnmatch
    import re
    import warnings

    warnings.simplefilter("ignore", FutureWarning)        # about sets that another engine may read differently
    tests = []
    for i, match_type, pattern in rules:
        if match_type == "extension":
            tests.append((i, lambda name, ext, p=pattern.lower(): ext is not None and ext.lower() == p))
        elif match_type == "glob":
            compiled = re.compile(fnmatch.translate(pattern.lower()))
            tests.append((i, lambda name, ext, c=compiled: name is not None and c.match(name.lower()) is not None))
        else:
            compiled = re.compile(pattern, re.IGNORECASE)
            tests.append((i, lambda name, ext, c=compiled: name is not None and c.search(name) is not None))

    def matching(name: str | None, ext: str | None) -> Iterator[int]:
        return (i for i, test in tests if test(name, ext))

    return matching


def _vectorised(rules: list[tuple[int, Row]], every: bool) -> Column:
    """Position of the first matching rule (or an array of all) by Arrow batches.

    Patterns are compiled once per task, each distinct name of a batch is tested once.
    """
    specs = [(i, r["match_type"], r["pattern"]) for i, r in rules]

    @F.pandas_udf("array<int>" if every else "int")
    def position(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        matching = _matcher(specs)
        for names, extensions in batches:
            pairs = [(n if isinstance(n, str) else None, e if isinstance(e, str) else None) for n, e in zip(names, extensions)]
            found = {
                pair: list(matching(*pair)) if every else next(matching(*pair), None) for pair in dict.fromkeys(pairs)
            }
            yield pd.Series([found[pair] for pair in pairs], dtype=object if every else "Int32")

    return position(F.col("name"), F.col("extension"))


def _split(ruleset: RuleSet, form: str) -> tuple[list[tuple[int, Row]], list[tuple[int, Row]]]:
    """(rules tested by the JVM, rules tested by Python) with their positions; what a rule matches is the same in both."""
    python = [form == "vectorised" or r["id"] in ruleset.python_only for r in ruleset.active]
    numbered = list(enumerate(ruleset.active))
    return [x for x, p in zip(numbered, python) if not p], [x for x, p in zip(numbered, python) if p]


def _ruleset(rules: DataFrame | RuleSet, form: str, streaming: bool) -> RuleSet | None:
    """Rules to fold into a projection; None for a table of rules that is joined."""
    if isinstance(rules, RuleSet):
        return rules
    if form == "table":
        return None
    return load_few_rules(rules) if form == "auto" and not streaming else load_rules(rules)


def classify(
    files: DataFrame,
    rules: DataFrame | RuleSet,
    form: str = "auto",
    fallback: Callable[[Column, Column], Column] | None = None,
) -> DataFrame:
    """Add ``category``, ``target_folder``, ``confidence`` and ``rule_name``.

    The enabled rule of the highest priority wins, equal priorities go by id; then the extension
    table, then ``Others``. Rules mean what they mean to Python's ``fnmatch`` and ``re``: those that mean the same to Java
    are tested by the JVM, only the others by Arrow batches (all of them in the form ``vectorised``). A rule DataFrame of more than ``FOLDED_RULES``
    enabled rules is joined as a table (form ``table``; not on streams). ``fallback(name, extension)`` gives a category (or null) for files
    that nothing matched, from a column function or a ``pandas_udf``.
    """
    if "extension" not in files.columns:
        files = files.withColumn("extension", extension_of("name"))
    ruleset = _ruleset(rules, form, files.isStreaming)
    if ruleset is None:
        placed = best_rules(files, rules).withColumnRenamed("_best", "_rule")

        def of_rule(field: str) -> Column:
            return F.col("_rule")[field]
    else:
        folded, python = _split(ruleset, form)
        placed = files.withColumn("_rule", _folded_position(folded))
        if python:
            placed = placed.withColumn("_rule", _least(F.col("_rule"), _vectorised(python, every=False)))

        def of_rule(field: str) -> Column:
            values = F.array(*[F.lit(r[field]) for r in ruleset.active]) if ruleset.active else F.array().cast("array<string>")
            return F.when(F.col("_rule").isNotNull(), F.get(values, F.col("_rule")))

    placed = placed.withColumn("_table", F.when(F.col("_rule").isNull(), category_of("extension")))
    unmatched = F.col("_rule").isNull() & F.col("_table").isNull()
    rest = F.lit(DEFAULT_CATEGORY)
    if fallback is not None:
        # asked only for what is left; the guard keeps it off rows that a rule or the table decided
        placed = placed.withColumn(
            "_fallback",
            F.when(unmatched, fallback(F.when(unmatched, F.col("name")), F.when(unmatched, F.col("extension")))),
        )
        rest = F.coalesce(F.col("_fallback"), rest)
    by_table = F.coalesce(F.col("_table"), rest)
    result = placed.select(
        *[F.col(c) for c in files.columns if c not in ("category", "target_folder", "confidence", "rule_name")],
        F.when(F.col("_rule").isNotNull(), of_rule("category")).otherwise(by_table).alias("category"),
        F.when(F.col("_rule").isNotNull(), of_rule("target_folder")).otherwise(by_table).alias("target_folder"),
        F.when(F.col("_rule").isNotNull(), F.lit(RULE_CONFIDENCE))
        .when(F.col("_table").isNotNull(), F.lit(TABLE_CONFIDENCE))
        .otherwise(F.lit(FALLBACK_CONFIDENCE))
        .alias("confidence"),
        of_rule("name").alias("rule_name"),
    )
    return result


def rule_matches(files: DataFrame, rules: DataFrame | RuleSet, form: str = "auto", counted: bool = False) -> DataFrame:
    """One row per file and matching rule (all of them); up to ``FOLDED_RULES`` rules map-side without a join.

    ``counted`` folds the files of a rule into their number ``n_files``: of a table of rules before they meet it, so no row per file and rule is made.
    """
    ruleset = _ruleset(rules, form, False)
    if ruleset is None:
        named = files if "extension" in files.columns else files.withColumn("extension", extension_of("name"))
        return match_counts(named, rules) if counted else all_matches(named, rules)
    active = ruleset.active
    if not active:
        nothing = "CAST(NULL AS BIGINT) rule_id, CAST(NULL AS INT) priority, CAST(NULL AS STRING) rule_name, " \
                  "CAST(NULL AS STRING) rule_category"
        hits = files.selectExpr("*", *nothing.split(", ")).limit(0)
    else:
        folded, python = _split(ruleset, form)
        found = F.array_compact(F.array(*[F.when(rule_condition(r), F.lit(i)) for i, r in folded])) if folded else None
        if python:
            more = _vectorised(python, every=True)
            found = more if found is None else F.array_sort(F.concat(found, more))

        def of_rule(field: str, kind: str) -> Column:
            return F.get(F.array(*[F.lit(r[field]).cast(kind) for r in active]), F.col("_hit"))

        hits = files.withColumn("_hit", F.explode(found)).select(
            *files.columns, of_rule("id", "bigint").alias("rule_id"), of_rule("priority", "int").alias("priority"),
            of_rule("name", "string").alias("rule_name"), of_rule("category", "string").alias("rule_category"),
        )
    if not counted:
        return hits
    return hits.groupBy("rule_id", "priority", "rule_name", "rule_category").agg(F.count(F.lit(1)).alias("n_files"))


def rule_hits(files: DataFrame, rules: DataFrame | RuleSet, form: str = "auto") -> DataFrame:
    """How many files each rule matches."""
    hits = rule_matches(files, rules, form, counted=True)
    return hits.groupBy("rule_id", "rule_name").agg(F.coalesce(F.sum("n_files"), F.lit(0)).alias("n_files"))


def best_matches(files: DataFrame, rules: DataFrame | RuleSet, key: str = "id") -> DataFrame:
    """The winning rule per file from all its matches: highest priority, then lowest id."""
    order = F.struct(F.col("priority"), -F.col("rule_id"))
    return rule_matches(files, rules).groupBy(key).agg(
        F.max_by("rule_id", order).alias("rule_id"),
        F.max_by("rule_name", order).alias("rule_name"),
        F.max_by("rule_category", order).alias("category"),
    )
