"""Versions of a table keyed by path: a base, small change folders, bucket digests.

A version writes only the rows that changed: a folder of changed rows and tombstones, cut into buckets by a hash of the path. A reader
merges the base with the changes after it, and the newest row of each path counts; of buckets without changes the base is read as it is. When changes
have grown, ``compact`` writes a new base. Every version keeps a digest per bucket: the number of rows and an order-free
sum over their hashes. Two states that agree in a bucket's digest agree in its rows, so a comparison reads only the buckets whose digests differ.

The pointer table is written last; what a failed job left behind is overwritten by the next one with its version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.paths import _col
from ..session import cut_lineage
from .tables import current_version

BUCKETS = 256                               # of a table; at most a few thousand, their numbers are listed on the driver
POINTER = "version BIGINT, base BIGINT"
DIGEST = ["bucket", "n", "digest"]


def bucket_of(path: str | Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(_col(path)), F.lit(buckets)).cast("int")


def digests_of(rows: DataFrame, columns: list[str], buckets: int) -> DataFrame:
    """(bucket, n, digest) over path and ``columns``: sums of 64-bit hashes, the same in any order and partitioning."""
    value = F.xxhash64("path", *columns).cast("decimal(38,0)")
    return rows.groupBy(bucket_of("path", buckets).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("digest"))


class VersionedTable:
    """``columns`` of the digests say when two rows are the same; ``schema`` is that of the rows, with a ``path``."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, columns: list[str], buckets: int = BUCKETS):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self.columns, self.buckets = columns, buckets
        self._stored = T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])
        self._changed = T.StructType([*schema.fields, T.StructField("_gone", T.BooleanType()), T.StructField("bucket", T.IntegerType())])

    # ---- versions

    def newest(self) -> int | None:
        return current_version(self.spark, self.root)

    def _steps(self, version: int | None) -> tuple[int, list[int]]:
        """(base, changes after it) that make up a version."""
        version = self.newest() if version is None else version
        rows = self.spark.read.schema(POINTER).parquet(f"{self.root}/pointer").filter(F.col("version") <= version).collect()
        base = max(r["base"] for r in rows)
        return base, sorted({r["version"] for r in rows if r["version"] > base})

    def _publish(self, version: int, base: int) -> None:
        row = self.spark.range(1).select(F.lit(version).cast("bigint").alias("version"), F.lit(base).cast("bigint").alias("base"))
        row.write.mode("append").parquet(f"{self.root}/pointer")

    def _write(self, rows: DataFrame, folder: str) -> None:
        placed = rows.withColumn("bucket", bucket_of("path", self.buckets))
        placed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/{folder}")

    def create(self, rows: DataFrame, version: int = 0) -> None:
        """The first base."""
        self._write(rows.select(*self.schema.names), f"base={version}")
        self._digest(version, self._base(version), None)
        self._publish(version, version)

    def commit(self, changes: DataFrame, version: int) -> None:
        """A new version: the rows of the table and ``_gone`` for what changed, one per path. Writes those rows and the digests of their buckets."""
        before = self.newest()
        self._write(changes.select(*self.schema.names, "_gone"), f"changes={version}")
        touched = self._touched([version])
        base, steps = self._steps(before)
        self._digest(version, self._merged(base, [*steps, version], touched), before, touched)
        self._publish(version, base)

    def compact(self, version: int) -> None:
        """A version with the rows of the newest one in a base of its own."""
        before = self.newest()
        self._write(self.read(before), f"base={version}")
        self.digests(before).write.mode("overwrite").parquet(f"{self.root}/digests={version}")
        self._publish(version, version)

    # ---- reading

    def _touched(self, steps: list[int]) -> list[int]:
        """Buckets that changes touch: at most ``buckets`` numbers, from the folders' names alone."""
        return sorted(r["bucket"] for r in self._changes(steps).select("bucket").distinct().collect()) if steps else []

    def _base(self, base: int) -> DataFrame:
        return self.spark.read.schema(self._stored).parquet(f"{self.root}/base={base}")

    def _changes(self, steps: list[int]) -> DataFrame:
        parts = None
        for step in steps:
            part = self.spark.read.schema(self._changed).parquet(f"{self.root}/changes={step}").withColumn("_version", F.lit(step).cast("bigint"))
            parts = part if parts is None else parts.unionByName(part)
        return parts

    def _merged(self, base: int, steps: list[int], buckets: list[int] | None) -> DataFrame:
        """Rows of the given buckets (all of them for None)."""
        def within(df: DataFrame) -> DataFrame:
            return df if buckets is None else df.filter(F.col("bucket").isin(buckets))

        old = within(self._base(base)).select(*self.schema.names)
        if not steps:
            return old
        changes = within(self._changes(steps))
        touched = self._touched(steps)
        names = [c for c in self.schema.names if c != "path"]
        newest = changes.groupBy("path").agg(F.max_by(F.struct("_gone", *names), "_version").alias("_row"))
        live = newest.filter(~F.col("_row._gone")).select(*["path" if c == "path" else F.col(f"_row.{c}").alias(c) for c in self.schema.names])
        # buckets without changes need no comparison
        quiet = within(self._base(base)).filter(~F.col("bucket").isin(touched)).select(*self.schema.names)
        stirred = within(self._base(base)).filter(F.col("bucket").isin(touched)).select(*self.schema.names)
        return quiet.unionByName(stirred.join(newest.select("path"), "path", "left_anti")).unionByName(live)

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a version, by default the newest; of some ``buckets`` only those folders are read."""
        return self._merged(*self._steps(version), buckets)

    # ---- digests

    def _digest(self, version: int, rows: DataFrame, before: int | None, touched: list[int] | None = None) -> None:
        made = digests_of(rows, self.columns, self.buckets)
        if before is not None:
            made = made.unionByName(self.digests(before).filter(~F.col("bucket").isin(touched)))
        made.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/digests={version}")

    def digests(self, version: int | None = None) -> DataFrame:
        version = self.newest() if version is None else version
        return self.spark.read.schema("bucket INT, n BIGINT, digest DECIMAL(38,0)").parquet(f"{self.root}/digests={version}")

    def differing(self, rows: DataFrame, version: int | None = None) -> list[int]:
        """Buckets in which ``rows`` are not the rows of the version."""
        new = digests_of(rows, self.columns, self.buckets).select("bucket", F.struct("n", "digest").alias("_new"))
        old = self.digests(version).select("bucket", F.struct("n", "digest").alias("_old"))
        met = new.join(old, "bucket", "full_outer").filter(~F.col("_new").eqNullSafe(F.col("_old")))
        return sorted(r["bucket"] for r in met.select("bucket").collect())

    def compare(self, rows: DataFrame, version: int | None = None) -> DataFrame:
        """(path, status, _new row, _old row) of new, changed and missing paths; only buckets whose digests differ are read and joined."""
        rows = cut_lineage(rows)                     # a listing is walked once
        buckets = self.differing(rows, version)
        new = rows.filter(bucket_of("path", self.buckets).isin(buckets)).select("path", F.struct(*[c for c in rows.columns if c != "path"]).alias("_new"))
        old = self.read(version, buckets)
        old = old.select("path", F.struct(*[c for c in self.schema.names if c != "path"]).alias("_old"))
        same = F.lit(True)
        for c in self.columns:
            same = same & F.col(f"_new.{c}").eqNullSafe(F.col(f"_old.{c}"))
        status = F.when(F.col("_new").isNull(), "missing").when(F.col("_old").isNull(), "new").when(~same, "changed")
        return new.join(old, "path", "full_outer").withColumn("status", status).filter(F.col("status").isNotNull())
