"""Row numbers inside groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage
from .slabs import earlier, in_slabs

ROWS_PER_BUCKET = 200_000


def number_rows(
    members: DataFrame, keys: list[str], order: str, rank: str = "rank", per_bucket: int = ROWS_PER_BUCKET, largest: int | None = None,
    slabs: int | None = None
) -> DataFrame:
    """Number the rows of each group from 1 by a unique ``order`` column.

    ``members`` carries its group's size ``n``. Groups of up to ``per_bucket`` rows are numbered by a window; larger ones are cut into ranges of
    (group, order) with about the same number of rows each, whatever the values are, numbered range by range and moved up by the sizes of the
    ranges before, so no task ever sorts a whole large group. Who knows that no group is larger says so with ``largest``.
    """
    near = F.row_number().over(Window.partitionBy(*keys).orderBy(order)).cast("bigint")
    if largest is not None and largest <= per_bucket:
        return members.withColumn(rank, near)
    dealt = in_slabs(members.filter(F.col("n") > per_bucket), keys, [order], slabs)
    part = [*keys, "_slab"]
    sizes = dealt.groupBy(*part).agg(F.count(F.lit(1)).alias("_rows"))
    # a range has at most one group that began in an earlier one, so this is at most a row per range
    carried = sizes.select(*part, F.sum("_rows").over(earlier(keys)).alias("_before")).filter("_before IS NOT NULL")
    inside = F.row_number().over(Window.partitionBy(*part).orderBy(order))
    large = dealt.repartition(*part).withColumn("_near", inside).join(F.broadcast(carried), part, "left").withColumn(
        rank, (F.col("_near") + F.coalesce("_before", F.lit(0))).cast("bigint")).drop("_slab", "_near", "_before")
    return members.filter(F.col("n") <= per_bucket).withColumn(rank, near).unionByName(large)


def dense_ids(rows: DataFrame, order: list[str | Column], start: int = 0, name: str = "id") -> DataFrame:
    """``rows`` with whole numbers from ``start`` in the given order, without gaps.

    The rows are range-partitioned, sorted and written once with their place in the partition; the sizes of the partitions before
    (one row per partition) move them up. No task sees more than its range.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    written = cut_lineage(placed)
    part = F.shiftright("_place", 33)           # how Spark builds these numbers: partition, then row
    sizes = written.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    moved = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    joined = written.withColumn("_part", part).join(moved, "_part")
    return joined.withColumn(name, (F.lit(start) + F.col("_before") + inside).cast("bigint")).drop("_part", "_place", "_before")
