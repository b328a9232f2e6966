"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet in the shared checkpoint folder and read again as the
next stage's ``docs``. Every stage works on all that its predecessor kept:

1. quality classifier: documents below the score cut go;
2. n-gram Jaccard join: of every class of near duplicates (``NEAR_WORDS``-word shingles, similarity of at least ``NEAR_PERCENT`` %)
   the document with the smallest id stays;
3. benchmark decontamination: documents with a window of a benchmark item go;
4. secret scans: secrets are replaced by their kind in brackets, ``n_chars`` follows;
5. byte-level BPE: token ids of every document, with the digest of what they decode to.

Rows that share a ``doc_id`` are judged one by one in stages 1 and 3 and stay or go together in stage 2. A null or empty text has quality 0
and goes in stage 1; in the other stages it is an empty text, which is nobody's copy, holds no item and no secret, and has no tokens. A null
``doc_id`` is kept as it is. Every stage takes an empty table and gives an empty one, carries extra columns of any name along (the last
returns its own), and works on whole texts, very long ones in chunks of their own. Only ``doc_id`` and ``text`` are needed.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from lakeledger.llm import bpe, crf, decontaminate, jaccard, learn, secrets
from lakeledger.llm.texts import modest_batches
from lakeledger.session import cut_lineage

NEAR_WORDS = 5
NEAR_PERCENT = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that score at least ``crf.SCORE_CUT``; learns from the labels of the documents given."""
    modest_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    field = crf.fit(docs, labels, learn.bucket_of("doc_id", 5) != 0)
    return crf.keep_good(docs, field)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    modest_batches(spark)
    return jaccard.keep_one(docs, words=NEAR_WORDS, percent=NEAR_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    modest_batches(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    modest_batches(spark)
    clean = secrets.redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256)."""
    modest_batches(spark)
    coded = bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("redaction", redaction),
    ("tokens", tokens),
]

# A conditional random field and a tokenizer have no SQL; the pipeline is tested stage by stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
