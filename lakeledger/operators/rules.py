"""Rule tables: validation, quarantine of broken patterns, listing, maintenance by change table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, functions as F

from ..functions.patterns import python_compiles, same_in_java
from ..schemas import MATCH_TYPES
from ..session import cut_lineage
from .rule_index import compiles


def rule_reasons():
    """Array of the reasons a rule row is not acceptable (empty when it is)."""

    def blank(column: str):
        return F.coalesce(F.length(column), F.lit(0)) < 1

    checks = [
        (blank("name") | (F.length("name") > 128), "name must have 1 to 128 characters"),
        (blank("pattern"), "pattern must not be empty"),
        (F.coalesce(~F.col("match_type").isin(MATCH_TYPES), F.lit(True)), "match_type must be glob, regex or extension"),
        (blank("category") | (F.length("category") > 64), "category must have 1 to 64 characters"),
        (blank("target_folder"), "target_folder must not be empty"),
        (F.coalesce(~F.col("priority").between(0, 1000), F.lit(True)), "priority must be between 0 and 1000"),
    ]
    return F.array_compact(F.array(*[F.when(bad, F.lit(reason)) for bad, reason in checks]))


def validate_rules(rules: DataFrame) -> DataFrame:
    """Rules with ``is_valid`` and the list of ``reasons``; the same test serves creation and update."""
    return rules.withColumn("reasons", rule_reasons()).withColumn("is_valid", F.size("reasons") == 0)


def list_rules(rules: DataFrame) -> DataFrame:
    """Highest priority first, then in the order of creation."""
    return rules.orderBy(F.desc("priority"), F.asc("id"))


@dataclass(frozen=True)
class RuleSet:
    """Rules ready to apply, best first, with the ones whose pattern no engine accepts set aside."""

    active: list[Row]
    broken: list[Row]
    python_only: frozenset[int]   # ids of regex rules that are left to Python's engine


FOLDED_RULES = 1_000    # enabled rules that a projection tests; more are joined as a table (``rule_index``)


def load_rules(rules: DataFrame) -> RuleSet:
    """Bring up to ``FOLDED_RULES`` enabled rules to the driver: a configuration that every row is tested against.

    Broken regular expressions never match, so they are set aside before a job could fail on them.
    """
    found = load_few_rules(rules)
    if found is None:
        raise ValueError(f"more than {FOLDED_RULES} enabled rules: give the table to classify, rule_matches or rule_hits")
    return found


def load_few_rules(rules: DataFrame) -> RuleSet | None:
    """The same, None where there are more rules."""
    wanted = rules.filter(F.col("enabled")).select(
        "id", "name", "pattern", "match_type", "category", "target_folder", "priority"
    )
    rows = wanted.limit(FOLDED_RULES + 1).collect()
    if len(rows) > FOLDED_RULES:
        return None
    rows.sort(key=lambda r: (-(r["priority"] or 0), r["id"]))
    broken, active, python_only = [], [], set()
    for row in rows:
        if row["match_type"] == "regex" and not python_compiles(row["pattern"]):
            broken.append(row)
            continue
        if row["match_type"] == "regex" and not same_in_java(row["pattern"]):
            python_only.add(row["id"])
        active.append(row)
    return RuleSet(active, broken, frozenset(python_only))


def quarantined_rules(rules: DataFrame) -> DataFrame:
    """The enabled rules whose pattern is broken."""
    return rules.filter(F.col("enabled") & (F.col("match_type") == "regex") & F.col("pattern").isNotNull() & ~compiles("pattern"))


def apply_changes(table: DataFrame, changes: DataFrame, key: str = "id", defaults: dict | None = None) -> DataFrame:
    """A table after a batch of changes.

    ``changes`` has the key, ``seq`` (order of the changes), ``op`` and any columns of the table; a null
    there keeps the old value. ``create`` makes a row, ``update`` changes a row that is there (and does
    nothing otherwise), ``upsert`` does either, ``delete`` forgets the row and all changes before it.
    All changes of a key fold into one row before the join, whatever their number. ``defaults`` fills
    columns of rows that did not exist.
    """
    columns = [c for c in table.columns if c != key]
    present = [c for c in columns if c in changes.columns]

    def last(op: str):
        return F.coalesce(F.max(F.when(F.col("op") == op, F.col("seq").cast("bigint"))), F.lit(_NEVER))

    folded = changes.groupBy(key).agg(
        last("delete").alias("_cut"), last("create").alias("_made"), last("upsert").alias("_put"),
        # the newest value of each column, with the change it came from
        *[F.max(F.when((F.col("op") != "delete") & F.col(c).isNotNull(),
                       F.struct(F.col("seq").cast("bigint").alias("seq"), F.col(c).alias("v")))).alias(f"_new_{c}")
          for c in present],
    )
    old = table.select(key, F.lit(True).alias("_old"), *[F.col(c).alias(f"_old_{c}") for c in columns])
    joined = old.join(folded, key, "full_outer").na.fill(_NEVER, ["_cut", "_made", "_put"])
    survives = F.col("_old").isNotNull() & (F.col("_cut") == _NEVER)
    put, made = F.col("_put") > F.col("_cut"), F.col("_made") > F.col("_cut")
    # a row made by ``create`` takes no values of updates before it
    since = F.when(~survives & ~put, F.greatest(F.col("_cut"), F.col("_made") - 1)).otherwise(F.col("_cut"))

    def value(column: str):
        options = []
        if column in present:
            new = F.col(f"_new_{column}")
            options.append(F.when(new["seq"] > since, new["v"]))
        options.append(F.when(survives, F.col(f"_old_{column}")))
        if defaults and column in defaults:
            options.append(F.when(~survives, F.lit(defaults[column])))
        return F.coalesce(*options).cast(table.schema[column].dataType)

    kept = joined.filter(survives | put | made)
    return kept.select(*[(F.col(key) if c == key else value(c)).alias(c) for c in table.columns])


_NEVER = -(2**63)
RULE_DEFAULTS = {"match_type": "glob", "priority": 0, "enabled": True}


def maintain_rules(rules: DataFrame, changes: DataFrame, now: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(rules, rejected): the table after a batch of changes, and the rows that would not be acceptable.

    A changed rule is tested like a new one; where it fails, the rule stays as it was.
    """
    defaults = dict(RULE_DEFAULTS)
    if now is not None and "created_at" in rules.columns:
        defaults["created_at"] = now
    checked = cut_lineage(validate_rules(apply_changes(rules, changes, defaults=defaults)))
    rejected = checked.filter(~F.col("is_valid")).drop("is_valid")
    unchanged = rules.join(rejected.select("id"), "id", "left_semi").select(*rules.columns)
    return checked.filter("is_valid").select(*rules.columns).unionByName(unchanged), rejected
