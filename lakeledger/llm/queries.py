"""The registered queries of this subpackage: thin callers that derive digest columns from the operators' outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import (backoff, bpe, crf, decontaminate, divergence, jaccard, learn, lines, prefix_trie, quality_rules, secrets, substrings,
               toxicity, url_lists)
from .texts import modest_batches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    modest_batches(spark)
    return _table(spark, sf_dir, "documents")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = bpe.round_trip(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                           public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def _listed(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    one = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(one, ",")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    remainder = learn.bucket_of("doc_id", 5)
    field = crf.fit(docs, _table(spark, sf_dir, "labels"), remainder != 0)
    return crf.score(docs, field).select(
        "doc_id", (remainder == 0).alias("held_out"), "score",
        (F.col("score") >= crf.SCORE_CUT).cast("int").alias("predicted"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_documents(spark, sf_dir))
    base = [rule.kind for rule in secrets.BASE_RULES]

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[count(kind) for kind in base],
        F.sha2(_listed(F.filter("spans", lambda s: s["kind"].isin(base))).cast("binary"), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"))


def op4_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, events = _table(spark, sf_dir, "pages").select("page_id", "url"), _table(spark, sf_dir, "events")
    judged = url_lists.evaluate(url_lists.captures_of(pages, events), url_lists.entries_of(pages, events))
    return judged.withColumnRenamed("id", "page_id")


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substrings.remove_repeated(_documents(spark, sf_dir))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    remainder = learn.bucket_of("doc_id", 10)
    scored = backoff.score(_documents(spark, sf_dir), remainder != 0)
    return scored.select("doc_id", (remainder == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                         "base_score", "score")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(_documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("bigint"), lambda n, r: n + r["end"] - r["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"), "longest", "longest_item", "longest_start")


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(_documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    remainder = learn.bucket_of("doc_id", 4)
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"), remainder != 2)
    return toxicity.score(docs, model).select(
        "doc_id", (remainder == 2).alias("held_out"), "score",
        (F.col("score") >= toxicity.SCORE_CUT).cast("int").alias("predicted"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(_documents(spark, sf_dir), _table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_documents(spark, sf_dir))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(_table(spark, sf_dir, "conversations"))


def op13_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.drop_repeated(_documents(spark, sf_dir))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_quality": op2_quality,
    "op3_secrets": op3_secrets,
    "op4_url_lists": op4_url_lists,
    "op5_substrings": op5_substrings,
    "op6_backoff": op6_backoff,
    "op7_decontaminate": op7_decontaminate,
    "op8_jaccard": op8_jaccard,
    "op9_toxicity": op9_toxicity,
    "op10_quality_rules": op10_quality_rules,
    "op11_divergence": op11_divergence,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_lines": op13_lines,
}
ORACLE: dict[str, str] = {
    "op4_url_lists": url_lists.ORACLE,
    "op5_substrings": substrings.ORACLE,
    "op7_decontaminate": decontaminate.ORACLE,
    "op8_jaccard": jaccard.ORACLE,
    "op10_quality_rules": quality_rules.oracle_sql(),
    "op11_divergence": divergence.ORACLE,
    "op12_prefix_trie": prefix_trie.ORACLE,
    "op13_lines": lines.ORACLE,
}
