"""Catalog browsing: filters, totals, pages, key lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import DEFAULT_CATEGORY, PAGE_SIZE
from ..functions.paths import _col
from ..functions.scalars import clamp_limit, clamp_offset, clamp_page, or_default
from ..session import cut_lineage

DEEP_OFFSET = 100_000
SORT_KEYS = ("name", "size", "category", "last_modified", "path")


def in_session(files: DataFrame, session_id: int) -> DataFrame:
    return files.filter(F.col("scan_session_id") == session_id)


def in_categories(files: DataFrame, categories: list[str] | None) -> DataFrame:
    """An empty list means no filter."""
    return files.filter(F.col("category").isin(categories)) if categories else files


def contains_term(column: Column | str, term: str, literal: bool = False) -> Column:
    """Case-insensitive substring; ``%`` and ``_`` in the term are wildcards unless ``literal``."""
    pattern = term.strip().replace("\\", "\\\\")
    if literal:
        pattern = pattern.replace("%", "\\%").replace("_", "\\_")
    return _col(column).ilike(f"%{pattern}%")


def search(files: DataFrame, term: str | None, literal: bool = False) -> DataFrame:
    """Files whose name or path contains the term; no term, no filter."""
    if not term:
        return files
    return files.filter(contains_term("name", term, literal) | contains_term("path", term, literal))


def select_files(
    files: DataFrame, session_id: int, category: str | None = None, term: str | None = None, literal: bool = False
) -> DataFrame:
    """The rows a page and its total are taken from."""
    return search(in_categories(in_session(files, session_id), [category] if category else None), term, literal)


def page_of(rows: DataFrame, order: list[Column], offset: int, limit: int, deep_offset: int = DEEP_OFFSET) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in the given order.

    Up to ``deep_offset`` that is a top-k of offset + limit rows. Deeper, the rows are range-sorted into
    partitions and written with their partition number; the counts per partition tell which ones hold
    the page, and only those are ordered.
    """
    if offset <= deep_offset:
        ordered = rows.orderBy(*order)
        return (ordered.offset(offset) if offset else ordered).limit(limit)
    ranged = cut_lineage(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).orderBy("_range").collect()
    before, wanted, skip = 0, [], 0
    for part in counts:
        if before < offset + limit and before + part["n"] > offset:
            skip = skip if wanted else offset - before
            wanted.append(part["_range"])
        before += part["n"]
    held = ranged.filter(F.col("_range").isin(wanted)).drop("_range") if wanted else rows.limit(0)
    return held.orderBy(*order).offset(skip).limit(limit)


def _sort_key(sort_by: str) -> str:
    return sort_by if sort_by in SORT_KEYS else "name"


def browse(
    files: DataFrame,
    session_id: int,
    category: str | None = None,
    term: str | None = None,
    sort_by: str = "name",
    sort_order: str = "asc",
    limit: int = 200,
    offset: int = 0,
    literal: bool = False,
) -> DataFrame:
    """One page of the catalog; ties by id. ``browse_after`` goes through page after page at less cost."""
    key = F.col(_sort_key(sort_by))
    order = [key.desc() if sort_order.lower() == "desc" else key.asc(), F.col("id").asc()]
    rows = select_files(files, session_id, category, term, literal)
    return page_of(rows, order, clamp_offset(offset), clamp_limit(limit))


def browse_after(
    files: DataFrame,
    session_id: int,
    after_key,
    after_id: int,
    category: str | None = None,
    term: str | None = None,
    sort_by: str = "name",
    sort_order: str = "asc",
    limit: int = 200,
    literal: bool = False,
) -> DataFrame:
    """The page after the row with the given sort key and id, at the same cost for every depth.

    Nulls come first ascending and last descending, as in ``browse``.
    """
    key, row_id = F.col(_sort_key(sort_by)), F.col("id")
    descending = sort_order.lower() == "desc"
    if after_key is None:
        same_null = key.isNull() & (row_id > after_id)
        behind = same_null if descending else same_null | key.isNotNull()
    else:
        further = key < F.lit(after_key) if descending else key > F.lit(after_key)
        behind = further | ((key == F.lit(after_key)) & (row_id > after_id))
        if descending:
            behind = behind | key.isNull()
    order = key.desc() if descending else key.asc()
    rows = select_files(files, session_id, category, term, literal).filter(behind)
    return rows.orderBy(order, row_id.asc()).limit(clamp_limit(limit))


def browse_total(
    files: DataFrame, session_id: int, category: str | None = None, term: str | None = None, literal: bool = False
) -> DataFrame:
    """The filtered count, as its own aggregate."""
    rows = select_files(files, session_id, category, term, literal)
    return rows.agg(F.count(F.lit(1)).alias("total"))


def browse_page(
    files: DataFrame,
    session_id: int,
    page: int,
    category: str | None = None,
    term: str | None = None,
    sort_by: str = "name",
    sort_order: str = "asc",
    page_size: int = PAGE_SIZE,
) -> DataFrame:
    """Page ``page`` (from 0); a page behind the end becomes the last one."""
    if page > 0:
        total = browse_total(files, session_id, category, term).first()["total"]
        page = clamp_page(page, total, page_size)
    return browse(files, session_id, category, term, sort_by, sort_order, page_size, max(page, 0) * page_size)


def by_id(table: DataFrame, row_id: int) -> DataFrame:
    """The row with that id, or no row."""
    return table.filter(F.col("id") == row_id).limit(1)


def category_list(files: DataFrame) -> DataFrame:
    """Distinct categories in order, ``All`` first."""
    known = files.select(or_default("category", DEFAULT_CATEGORY).alias("category")).distinct()
    every = files.sparkSession.range(1).select(F.lit("All").alias("category"), F.lit(0).alias("position"))
    return every.unionByName(known.withColumn("position", F.lit(1))).orderBy("position", "category")
