"""Path predicates and listing filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import PROTECTED_UNIX
from ..functions.patterns import glob_match, literal
from ..functions.paths import _col, ancestors, dir_name, normalize_path
from ..session import cut_lineage
from .rule_index import name_matches
from .skew import join_by_key


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def is_under(path: Column | str, directory: str, separator: str = "/") -> Column:
    """The path is the directory or lies below it."""
    path = _col(path)
    return (path == directory) | path.startswith(directory.removesuffix(separator) + separator)


def has_prefix(path: Column | str, prefix: str) -> Column:
    """Raw text prefix, without a separator boundary."""
    return _col(path).startswith(prefix)


def is_protected(
    path: Column | str, protected: list[str] = PROTECTED_UNIX, separator: str = "/", normalize: bool = False
) -> Column:
    """Equal to, or below, a protected directory.

    Listings give absolute paths; ``normalize`` makes others absolute first, at the price of leaving
    generated code.
    """
    if not protected:
        return F.lit(False)
    path = normalize_path(path) if normalize else _col(path)
    either = "|".join(literal(p) for p in protected)
    return path.rlike(rf"\A(?:{either})(?:{literal(separator)}|\z)")


def not_protected(
    files: DataFrame, protected: list[str] = PROTECTED_UNIX, separator: str = "/", normalize: bool = False
) -> DataFrame:
    return files.filter(~is_protected("path", protected, separator, normalize))


def not_below(files: DataFrame, directories: DataFrame) -> DataFrame:
    """Files that neither are, nor lie below, one of many directories (``directories`` has one column ``path``).

    The test runs on the distinct parent directories of the files, expanded to their ancestors; the files
    themselves meet only the result, a crowded directory in pieces.
    """
    listed = directories.select(F.col("path").alias("_above")).distinct()
    parents = files.select(dir_name("path").alias("_dir")).distinct()
    below = (
        parents.select("_dir", F.explode(ancestors("_dir")).alias("_above"))
        .join(listed, "_above", "left_semi")
        .select("_dir")
        .distinct()
    )
    kept = join_by_key(files.withColumn("_dir", dir_name("path")), below, ["_dir"], "left_anti", spread="path")
    return kept.join(listed.withColumnRenamed("_above", "path"), "path", "left_anti").select(*files.columns)


def exclude_prefixes(files: DataFrame, prefixes: list[str]) -> DataFrame:
    return files.filter(~_any([has_prefix("path", p) for p in prefixes]))


def longest_prefixes(files: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(path, prefix): the longest of a table of raw prefixes (column ``prefix``) that each distinct path begins with, for paths that have one.

    A path is cut at every length that prefixes have, and the pieces meet the prefixes by equality. The lengths are no more than the longest
    prefix has characters, whatever the number of prefixes.
    """
    listed = prefixes.select("prefix").filter(F.col("prefix").isNotNull()).distinct()
    lengths = sorted(r[0] for r in listed.select(F.length("prefix")).distinct().collect())
    if not lengths:
        return files.select("path", F.lit(None).cast("string").alias("prefix")).limit(0)
    fitting = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("path"))
    pieces = files.select("path").distinct().select("path", F.explode(F.transform(
        fitting, lambda n: F.substring(F.col("path"), F.lit(1), n))).alias("prefix"))
    return pieces.join(listed, "prefix", "left_semi").groupBy("path").agg(F.max_by("prefix", F.length("prefix")).alias("prefix"))


def exclude_prefix_table(files: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Files whose path begins with none of a table of raw prefixes; rows without a path stay."""
    return files.join(cut_lineage(longest_prefixes(files, prefixes).select("path")), "path", "left_anti").select(*files.columns)


def exclude_glob_table(files: DataFrame, globs: DataFrame) -> DataFrame:
    """Files whose path and name match none of a table of globs (column ``pattern``); globs meet texts on their rarest piece (``rule_index``)."""
    rules = globs.filter(F.col("pattern").isNotNull()).select(F.struct(F.lit("glob").alias("type"), F.lower("pattern").alias("pattern")).alias("_match"))
    texts = files.select(F.explode(F.array("path", "name")).alias("name")).filter(F.col("name").isNotNull()).distinct()
    parts = name_matches(cut_lineage(texts), rules.distinct(), lambda pairs: pairs.select("name").distinct())
    matched = cut_lineage(reduce(DataFrame.unionByName, parts).distinct())
    kept = files.join(matched, "name", "left_anti")
    return kept.join(matched.withColumnRenamed("name", "path"), "path", "left_anti").select(*files.columns)


def exclude_globs(files: DataFrame, globs: list[str]) -> DataFrame:
    """Drop files whose path or name matches one of the globs."""
    return files.filter(~_any([glob_match("path", g) | glob_match("name", g) for g in globs]))


def regular_files(listing: DataFrame) -> DataFrame:
    """Regular files only; links are not followed, rows of what could not be read are left out.

    A listing without these marks holds files only.
    """
    if "error" in listing.columns:
        listing = listing.filter(F.col("error").isNull())
    for mark in ("is_symlink", "is_directory"):
        if mark in listing.columns:
            listing = listing.filter(~F.coalesce(F.col(mark), F.lit(False)))
    return listing


def min_size(files: DataFrame, bytes_: int) -> DataFrame:
    return files.filter(F.col("size") >= bytes_)
