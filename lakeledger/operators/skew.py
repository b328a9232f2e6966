"""Joins with a table of one row per key, for keys of any frequency.

AQE splits a hot key only where both join sides are plain shuffles; here the table side is mostly an
aggregate, so the cut is made in the plan: a key with more than ``hot_rows`` rows gets as many salts as it
needs, the rows take one by their id, the key's table row is repeated once per salt. The list of hot keys is
broadcast: every one of them stands for more than ``hot_rows`` rows, so it has at most (all rows) / ``hot_rows``
entries, 200,000 for 10^12 rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

HOT_ROWS = 5_000_000


def _salted(rows: DataFrame, hot: DataFrame, keys: list[str], spread: str | Column) -> DataFrame:
    """Rows with ``_salt``: 0, or for a hot key one of its ``_copies`` numbers."""
    marked = rows.join(F.broadcast(hot), keys, "left")
    salt = F.pmod(F.xxhash64(spread), F.col("_copies"))
    return marked.withColumn("_salt", F.coalesce(salt, F.lit(0)).cast("bigint")).drop("_copies")


def join_by_key(
    rows: DataFrame,
    table: DataFrame,
    keys: list[str],
    how: str = "inner",
    count: str | None = None,
    spread: str | Column = "id",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join ``rows`` with ``table`` (one row per key): ``inner``, ``left``, ``left_semi`` or ``left_anti``.

    ``count`` names the table's column with the number of rows of each key; without it the rows are
    counted. ``spread`` is what the rows of a key differ in. The table's columns follow those of the rows.
    """
    copies = F.ceil(F.col("_n") / F.lit(hot_rows)).cast("bigint")
    if count is not None:
        counted = table.withColumn("_n", F.col(count))
        hot = counted.filter(F.col("_n") > hot_rows).select(*keys, copies.alias("_copies"))
        sized = counted.withColumn("_copies", F.greatest(copies, F.lit(1)))
    else:
        counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        hot = counts.filter(F.col("_n") > hot_rows).select(*keys, copies.alias("_copies"))
        sized = table.join(F.broadcast(hot), keys, "left").withColumn("_n", F.lit(0))
    salts = F.sequence(F.lit(0).cast("bigint"), F.coalesce("_copies", F.lit(1)) - 1)
    repeated = sized.withColumn("_salt", F.explode(salts)).drop("_copies", "_n")
    joined = _salted(rows, hot, keys, spread).join(repeated, [*keys, "_salt"], how)
    kept = [c for c in rows.columns if c not in keys]
    more = [] if how in ("left_semi", "left_anti") else [c for c in table.columns if c not in keys]
    return joined.select(*keys, *kept, *more)
