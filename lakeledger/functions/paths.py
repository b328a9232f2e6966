"""Path and name functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def suffix(name: Column | str) -> Column:
    """Last suffix with its case kept; '' for dotfiles, names without a dot, and a trailing dot."""
    name = _col(name)
    last = F.substring_index(name, ".", -1)
    # nothing before the dot, or no dot at all: ``last`` lacks at most one character of the name
    return F.when((last == "") | (F.length(last) >= F.length(name) - 1), F.lit("")).otherwise(
        F.concat(F.lit("."), last))


def extension(name: Column | str) -> Column:
    """Lower-cased last suffix."""
    return F.lower(suffix(name))


def stem(name: Column | str) -> Column:
    """Name without its last suffix."""
    name = _col(name)
    return F.substring(name, F.lit(1), F.length(name) - F.length(suffix(name)))


def base_name(path: Column | str) -> Column:
    """Part after the last slash."""
    return F.substring_index(_col(path), "/", -1)


def dir_name(path: Column | str) -> Column:
    """Part before the last slash; '/' for a file right below the root, '' without a slash."""
    path = _col(path)
    head = F.length(path) - F.length(base_name(path))
    return F.when(head == 1, F.lit("/")).otherwise(F.substring(path, F.lit(1), F.greatest(head - 1, F.lit(0))))


def join_path(*parts: Column | str) -> Column:
    """Join with single slashes; an absolute later part restarts the path, empty parts vanish."""
    joined = _col(parts[0])
    for part in map(_col, parts[1:]):
        joined = (
            F.when(part.startswith("/"), part)
            .when((joined == "") | joined.endswith("/"), F.concat(joined, part))
            .when(part == "", joined)
            .otherwise(F.concat(joined, F.lit("/"), part))
        )
    return joined


def normalize_path(path: Column | str) -> Column:
    """Absolute form without '.', '..', doubled and trailing slashes.

    Paths that are clean already skip the segment walk.
    """
    path = _col(path)

    def step(kept: Column, segment: Column) -> Column:
        return (
            F.when((segment == "") | (segment == "."), kept)
            .when(segment == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))))
            .otherwise(F.array_append(kept, segment))
        )

    walked = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    dirty = ~path.startswith("/") | path.rlike(r"/(\.{0,2})(/|\z)")
    return F.when(dirty & (path != "/"), F.concat(F.lit("/"), F.array_join(walked, "/"))).otherwise(path)


def numbered_name(name_stem: Column, number: Column, name_suffix: Column) -> Column:
    """``stem_(n)suffix``; number 0 stands for the plain name."""
    return F.when(number == 0, F.concat(name_stem, name_suffix)).otherwise(
        F.concat(name_stem, F.lit("_("), number.cast("string"), F.lit(")"), name_suffix)
    )


def roots_text(roots: Column | str) -> Column:
    """Root list as the comma text kept in session rows."""
    return F.array_join(_col(roots), ",")


def roots_list(text: Column | str) -> Column:
    """Comma text as a trimmed root list."""
    return F.transform(F.split(_col(text), ","), lambda root: F.trim(root))


def roots_valid(roots: Column | str) -> Column:
    """True when there is a root and none is blank."""
    return (F.size(_col(roots)) > 0) & ~F.exists(_col(roots), lambda root: F.trim(root) == "")


def ancestors(directory: Column | str) -> Column:
    """All directories from the top down to ``directory`` itself, as an array."""
    parts = F.filter(F.split(_col(directory), "/"), lambda s: s != "")
    return F.transform(
        F.when(F.size(parts) > 0, F.sequence(F.lit(1), F.size(parts))).otherwise(F.array().cast("array<int>")),
        lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")),
    )
