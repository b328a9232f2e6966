"""Looking back along an ordered group of any size: a prefix scan in slabs.

A group's rows in order are what a window function would see in one task. Here rows are dealt to ranges of (group, order), so a group
with most of the rows lies in many slabs; each slab is scanned by a window of its own, and what it leaves to the next ones is a row in a carry
table, settled by a window over slabs. A slab holds no more than a range partition, and since ranges follow one another, only its first
group can have begun before it: at most a row per slab is carried, which is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage


def in_slabs(rows: DataFrame, keys: list[str], order: list[str], slabs: int | None = None) -> DataFrame:
    """The rows, written once, with the number of their range of (keys, order) as ``_slab``; AQE sizes the ranges unless ``slabs`` says how many."""
    ranged = rows.repartitionByRange(*([slabs] if slabs else []), *keys, *order)
    return cut_lineage(ranged.withColumn("_slab", F.spark_partition_id()))


def earlier(keys: list[str]) -> Window:
    """The slabs of a group before this one."""
    return Window.partitionBy(*keys).orderBy("_slab").rowsBetween(Window.unboundedPreceding, -1)


def previous(slabs: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """``slabs`` with the value of the row before in the group; null for the first row. Values are not null."""
    part = [*keys, "_slab"]
    near = F.lag("_value").over(Window.partitionBy(*part).orderBy(*order))
    valued = slabs.withColumn("_value", value)
    left = valued.groupBy(*part).agg(F.max_by("_value", F.struct(*order)).alias("_tail"))
    carry = left.select(*part, F.last("_tail").over(earlier(keys)).alias("_carry"))
    carry = carry.filter("_carry IS NOT NULL")
    return (valued.repartition(*part).withColumn("_near", near).join(F.broadcast(carry), part, "left")
            .withColumn(name, F.coalesce("_near", "_carry")).drop("_value", "_near", "_carry"))


def highest_so_far(slabs: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """``slabs`` with the largest value up to the row, the row's own included."""
    part = [*keys, "_slab"]
    near = F.max("_value").over(Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    valued = slabs.withColumn("_value", value)
    carry = valued.groupBy(*part).agg(F.max("_value").alias("_top"))
    carry = carry.select(*part, F.max("_top").over(earlier(keys)).alias("_carry")).filter("_carry IS NOT NULL")
    return (valued.repartition(*part).withColumn("_near", near).join(F.broadcast(carry), part, "left")
            .withColumn(name, F.greatest("_near", "_carry")).drop("_value", "_near", "_carry"))
