"""Stored indexes of a catalog snapshot: postings of three-letter pieces for searches, sorted copies for pages at any depth.

Both are built once per snapshot, beside it, and read by folders: a search opens the folders of its term's pieces, a page the one or two
that hold it. Results are those of ``browse`` without an index.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .browse import SORT_KEYS, in_session, search
from .rule_index import pieces

GRAM = 3
BUCKETS = 512


class SearchIndex:
    """Postings (piece, id) of the lower-cased names and paths, cut into folders by a hash of the piece and sorted by it."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _bucket(self, piece: Column) -> Column:
        return F.pmod(F.xxhash64(piece), F.lit(self.buckets)).cast("int")

    def build(self, files: DataFrame) -> None:
        both = F.array_union(*[F.coalesce(pieces(F.lower(c), GRAM), F.array().cast("array<string>")) for c in ("name", "path")])
        postings = files.select("id", F.explode(both).alias("piece"))
        # a piece that most paths have is spread over several files of its folder
        spread = F.pmod(F.xxhash64("id"), F.lit(8))
        (postings.withColumn("bucket", self._bucket(F.col("piece"))).repartition("bucket", spread).sortWithinPartitions("bucket", "piece")
         .write.mode("overwrite").partitionBy("bucket").parquet(self.root))

    @staticmethod
    def pieces_of(term: str, literal: bool = False) -> list[str]:
        """Pieces that every hit of a term holds. Wildcards stand for anything, so pieces lie between them."""
        runs = [term.strip().lower()] if literal else re.split("[%_]", term.strip().lower())
        return sorted({run[i:i + GRAM] for run in runs for i in range(len(run) - GRAM + 1)})

    def candidates(self, term: str, literal: bool = False) -> DataFrame | None:
        """(id) of files that hold all pieces of the term; None where it has none, and only a scan can tell."""
        wanted = self.pieces_of(term, literal)
        if not wanted:
            return None
        numbers = self.spark.range(1).select(*[self._bucket(F.lit(p)) for p in wanted]).first()
        postings = self.spark.read.schema("id BIGINT, piece STRING, bucket INT").parquet(self.root)
        met = postings.filter(F.col("bucket").isin(sorted(set(numbers))) & F.col("piece").isin(wanted))
        return met.groupBy("id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == len(wanted)).select("id")

    def search(self, files: DataFrame, term: str | None, literal: bool = False) -> DataFrame:
        """Like ``browse.search`` on the files that the index was built from: candidates by the index, each tested."""
        found = self.candidates(term, literal) if term else None
        return search(files if found is None else files.join(found, "id", "left_semi").select(*files.columns), term, literal)


class RankIndex:
    """A copy of the files, sorted by session and one key, with the number of rows of each folder."""

    def __init__(self, spark: SparkSession, root: str, sort_by: str = "name", descending: bool = False):
        self.spark, self.root = spark, root.rstrip("/")
        key = sort_by if sort_by in SORT_KEYS else "name"
        self.order = [F.desc(key) if descending else F.asc(key), F.asc("id")]

    def build(self, files: DataFrame, ranges: int | None = None) -> None:
        """AQE sizes the ranges unless ``ranges`` says how many."""
        order = ["scan_session_id", *self.order]
        ranged = files.repartitionByRange(*([ranges] if ranges else []), *order).withColumn("_range", F.spark_partition_id())
        placed = ranged.sortWithinPartitions("scan_session_id", "_range", *self.order)
        placed.withColumn("session", F.col("scan_session_id")).write.mode("overwrite").partitionBy("session", "_range").parquet(f"{self.root}/rows")
        counts = self._rows().groupBy("session", "_range").agg(F.count(F.lit(1)).alias("n"))
        counts.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/counts")

    def _rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/rows")

    def page(self, session_id: int, offset: int, limit: int) -> DataFrame:
        """Rows ``offset`` to ``offset + limit`` of a session in the index' order; reads the ranges that hold them."""
        counts = self.spark.read.parquet(f"{self.root}/counts").filter(F.col("session") == session_id).orderBy("_range").collect()
        before, wanted, skip = 0, [], 0
        for part in counts:
            if before < offset + limit and before + part["n"] > offset:
                skip = skip if wanted else offset - before
                wanted.append(part["_range"])
            before += part["n"]
        rows = self._rows().filter((F.col("session") == session_id) & F.col("_range").isin(wanted)) if wanted else self._rows().limit(0)
        return in_session(rows, session_id).drop("session", "_range").orderBy(*self.order).offset(skip).limit(limit)
