"""Exact duplicate detection: size, then head hash, then full hash.

Content is read in one narrow pass and never shuffled: only sizes, digests, ids and paths move.
Group sizes come from partial aggregates, so a size or a content that a third of all files share is
counted map-side; its rows are spread over salts in joins (see ``skew``) and numbered slice by slice
(see ``ranking``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import HEAD_BYTES, MIN_HASH_BYTES
from ..functions.hashing import fingerprint, head_fingerprint
from ..functions.scalars import copy_label, wasted_bytes
from ..session import cut_lineage
from ..sources.content import hash_paths
from .filters import min_size
from .ranking import ROWS_PER_BUCKET, number_rows
from .skew import HOT_ROWS, join_by_key


def repeated(files: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rows whose key occurs more than once; files of a hot key are spread by their path."""
    counts = files.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > 1)
    return join_by_key(files, counts, keys, "left_semi", "_rows", "path", hot_rows)


def dup_stage1(files: DataFrame, min_bytes: int = MIN_HASH_BYTES) -> DataFrame:
    """Files that share their size with another one; metadata only."""
    return repeated(min_size(files, min_bytes), ["size"])


def with_hashes(
    files: DataFrame, content: str = "content", min_bytes: int = 0, head_bytes: int = HEAD_BYTES
) -> DataFrame:
    """Replace the content column by ``head_hash`` and ``hash`` (whole content), row by row.

    A file no longer than the head is hashed once. Null content gives null hashes.
    """
    data = F.col(content).cast("binary")
    wanted = F.length(data) >= min_bytes
    heads = files.withColumn("head_hash", F.when(wanted, head_fingerprint(content, head_bytes)))
    whole = F.when(F.length(data) <= head_bytes, F.col("head_hash")).when(wanted, fingerprint(content))
    return heads.withColumn("hash", whole).drop(content)


def dup_stage2(hashed: DataFrame) -> DataFrame:
    """Stage-1 files whose first 64 KB equal those of another file of the same size."""
    return repeated(dup_stage1(hashed).filter(F.col("head_hash").isNotNull()), ["size", "head_hash"])


def hash_candidates(files: DataFrame, algorithm: str = "sha256") -> DataFrame:
    """Staged hashing of files by path: ``hash`` for every file that may have a copy, nothing read for others.

    Sizes first (no reads), then heads of files with a shared size, then whole files beyond the head
    where size and head are shared. Each stage is written once, so no byte is read twice.
    """
    shared = dup_stage1(files.select("id", "path", "size"))
    heads = hash_paths(shared.repartition("path"), head_only=True, algorithm=algorithm)
    heads = cut_lineage(heads.withColumnRenamed("digest", "head_hash"))
    likely = repeated(heads.filter(F.col("head_hash").isNotNull()), ["size", "head_hash"])
    short = likely.filter(F.col("size") <= HEAD_BYTES).withColumn("hash", F.col("head_hash"))
    long = hash_paths(likely.filter(F.col("size") > HEAD_BYTES).repartition("path"), algorithm=algorithm)
    return cut_lineage(short.unionByName(long.withColumnRenamed("digest", "hash")))


def _hashed(files: DataFrame, min_bytes: int) -> DataFrame:
    return min_size(files, min_bytes).filter(F.col("hash").isNotNull())


def duplicate_groups(hashed: DataFrame, min_bytes: int = MIN_HASH_BYTES) -> DataFrame:
    """One row per set of equal files: fingerprint, size, number of files, wasted bytes, id of the file to keep.

    Files are equal when size and whole-content hash are; unreadable files (null hash) take no part.
    """
    return (
        _hashed(hashed, min_bytes)
        .groupBy("size", "hash")
        .agg(
            F.count(F.lit(1)).alias("n_files"),
            F.min("id").alias("keep_id"),
            F.max("id").alias("last_id"),
        )
        .filter(F.col("n_files") > 1)
        .select(
            F.col("hash").alias("fingerprint"), "size", "n_files",
            wasted_bytes("size", "n_files").alias("wasted_bytes"), "keep_id", "last_id",
        )
    )


def dup_members(
    hashed: DataFrame,
    min_bytes: int = MIN_HASH_BYTES,
    per_bucket: int = ROWS_PER_BUCKET,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """One row per file of every duplicate group, numbered by id, with its KEEP / COPY label.

    ``hashed`` is read several times; pass a written hash table (``write_hashes``), not one that still
    has to read content. The groups, far fewer than files, are written once.
    """
    groups = cut_lineage(duplicate_groups(hashed, min_bytes)).select(
        F.col("fingerprint").alias("hash"), "size", F.col("n_files").alias("n"), F.col("keep_id").alias("first"),
        F.col("last_id").alias("last"),
    )
    files = _hashed(hashed, min_bytes).select("id", "path", "size", "hash")
    members = join_by_key(files, groups, ["size", "hash"], "inner", "n", hot_rows=hot_rows)
    largest = groups.agg(F.max("n")).first()[0] or 0
    ranked = number_rows(members, ["size", "hash"], "id", "rank", per_bucket, largest)
    return ranked.select(
        F.col("hash").alias("fingerprint"), "size", "id", "path", "rank", F.col("n").alias("n_files"),
        copy_label("rank").alias("label"),
    )


def write_hashes(hashed: DataFrame) -> DataFrame:
    """The narrow hash table (id, path, size, hashes), written once so that content is read once."""
    columns = [c for c in ("id", "path", "size", "head_hash", "hash") if c in hashed.columns]
    return cut_lineage(hashed.select(*columns))


def duplicate_lists(members: DataFrame, chunk: int = 1000) -> DataFrame:
    """The paths of each group as arrays of at most ``chunk`` files, in numbered chunks.

    A group of any size stays whole over its chunks; no row holds more than ``chunk`` paths.
    """
    chunk_no = F.floor((F.col("rank") - 1) / F.lit(chunk)).cast("bigint")
    return (
        members.groupBy("fingerprint", "size", "n_files", chunk_no.alias("chunk"))
        .agg(F.sort_array(F.collect_list(F.struct("rank", "path"))).alias("_files"))
        .select(
            "fingerprint", "size", "chunk", F.transform("_files", lambda f: f["path"]).alias("files"),
            wasted_bytes("size", "n_files").alias("wasted_bytes"),
        )
    )


def top_wasted(groups: DataFrame, n: int) -> DataFrame:
    """The groups that waste most."""
    return groups.orderBy(F.desc("wasted_bytes"), F.asc("fingerprint")).limit(n)


def dup_summary(groups: DataFrame) -> DataFrame:
    """Totals: groups, files beyond the first of each group, wasted bytes."""
    return groups.agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.coalesce(F.sum(F.col("n_files") - 1), F.lit(0)).cast("bigint").alias("extra_copies"),
        F.coalesce(F.sum("wasted_bytes"), F.lit(0)).cast("bigint").alias("wasted_bytes"),
    )


def size_candidates(files: DataFrame) -> DataFrame:
    """Groups by size alone (more than 1,024 bytes), for a preview without any hashing."""
    return (
        files.filter(F.col("size") > MIN_HASH_BYTES)
        .groupBy("size")
        .agg(F.count(F.lit(1)).alias("n_files"))
        .filter(F.col("n_files") > 1)
        .select(
            F.concat(F.lit("size:"), F.col("size").cast("string")).alias("fingerprint"), "size", "n_files",
            wasted_bytes("size", "n_files").alias("wasted_bytes"),
        )
    )


def fill_hash(catalog: DataFrame, hashed: DataFrame, by: str = "path") -> DataFrame:
    """The catalog with its ``hash`` column filled from a hash table."""
    new = hashed.select(by, F.col("hash").alias("_hash"))
    filled: Column = F.coalesce("_hash", "hash")
    return catalog.join(new, by, "left").select(
        *[(filled if c == "hash" else F.col(c)).alias(c) for c in catalog.columns]
    )
