"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Each rule rejects documents whose rate lies above a cutoff. The cutoffs are chosen per stratum on labelled documents:
for every rule and candidate the good documents that it would reject are counted, and a candidate is certified when the
exact binomial (Clopper-Pearson) upper bound of the false rejection rate stays within the rule's share of the allowed
risk. The confidence is corrected for all tests made (rules x candidates x strata, Bonferroni), so with
probability 1 - ``error`` every stratum loses at most ``risk`` of its good documents to the rules together. The
strictest certified candidate is used; a stratum with too few labels to certify any keeps all its documents.

Null and empty texts have no words and fail the base rules. A row is judged by itself: a repeated document is judged
each time, and rows of the labels that repeat a document count once (the best label). A null stratum is
a stratum of its own. Empty tables on either side are taken; columns other than those named are not looked at. Texts of
any length are judged whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage

BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
RISK = 0.05         # share of the good documents of a stratum that the rules may reject
ERROR = 0.05        # probability that this fails anywhere
# Candidate cutoffs of each rule; a document is rejected when its rate is greater.
CANDIDATES = {
    "symbol_rate": (0.01, 0.02, 0.04, 0.06, 0.08, 0.1, 0.15, 0.2, 0.3),
    "shout_rate": (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9),
    "dup_line_rate": (0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8),
    "repeat_rate": (0.02, 0.04, 0.06, 0.08, 0.1, 0.15, 0.2, 0.3, 0.4),
    "word_length": (6.0, 7.0, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0, 30.0),
}


def _covered(hashes: Column) -> Column:
    """Number of words in windows whose hash stands at two positions or more; windows are compared within one text.

    Windows are sorted with their positions, equal neighbours kept, and the words they cover counted once.
    """
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    last = F.size(hashes) - 1

    def repeated(entry: Column, j: Column, all_: Column) -> Column:
        return ((j > 0) & (F.get(all_, j - 1)["h"] == entry["h"])) | ((j < last) & (F.get(all_, j + 1)["h"] == entry["h"]))

    # the sorted list is bound once as the only element of a list, so that its use inside the filter costs no new sort
    kept = F.flatten(F.transform(F.array(placed), lambda all_: F.filter(all_, lambda e, j: repeated(e, j, all_))))
    words = F.flatten(F.transform(kept, lambda e: F.array(e["i"], e["i"] + 1, e["i"] + 2)))
    return F.size(F.array_distinct(words)).cast("bigint")


def measures(docs: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """(key, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_shouts) per row."""
    whole = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.col(key).alias("_key"), F.col(stratum).cast("string").alias("_stratum"), whole.alias("_text"))
    split = base.select(
        "*",
        F.array_remove(F.split("_text", BLANKS, -1), "").alias("_words"),
        F.filter(F.split("_text", "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
    )
    n = F.size("_words")
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(
        F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)))).otherwise(F.array().cast("array<bigint>"))

    def characters(kept: str) -> Column:
        return F.length(F.regexp_replace("_text", kept, "")).cast("bigint")

    counted = split.select(
        "_key", "_stratum", n.cast("bigint").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        characters(r"[^#*$%&|<>]+").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        characters(r"[^A-Z!]+").alias("n_shouts"),
        windows.alias("_windows"),
    )
    different = F.size(F.array_distinct("_windows")) == F.size("_windows")
    return counted.select(
        F.col("_key").alias(key), F.col("_stratum").alias(stratum), "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.when(different, F.lit(0).cast("bigint")).otherwise(_covered(F.col("_windows"))).alias("n_repeat_words"),
        "n_lines", "n_shouts")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))


def rates() -> dict[str, Column]:
    """Rule -> rate, 0 where there is nothing to divide by."""

    def share(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))

    return {
        "symbol_rate": share("n_symbols", "word_chars"),
        "shout_rate": share("n_shouts", "word_chars"),
        "dup_line_rate": share("n_dup_lines", "n_lines"),
        "repeat_rate": share("n_repeat_words", "n_words"),
        "word_length": share("word_chars", "n_words"),
    }


def binomial_log_cdf(x: Column, n: Column, p: float) -> Column:
    """ln P(X <= x) for X ~ Binomial(n, p), term by term in logarithms."""
    odds = math.log(p) - math.log1p(-p)
    first = n * F.lit(math.log1p(-p))

    def add(state: Column, k: Column) -> Column:
        term = state["term"] + F.log((n - k + 1) / k) + F.lit(odds)
        top = F.greatest(term, state["total"])
        total = top + F.log(F.exp(term - top) + F.exp(state["total"] - top))
        return F.struct(term.alias("term"), total.alias("total"))

    start = F.struct(first.alias("term"), first.alias("total"))
    steps = F.when(x >= 1, F.sequence(F.lit(1).cast("bigint"), x)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(steps, start, add, lambda state: state["total"])


def thresholds(measured: DataFrame, good: DataFrame, key: str = "doc_id", stratum: str = "lang",
               risk: float = RISK, error: float = ERROR, candidates: dict = CANDIDATES) -> DataFrame:
    """One row per stratum with the certified cutoff of every rule (null where none is).

    ``good`` has the keys of the documents labelled as good.
    """
    rate = rates()
    passed = measured.filter(~base_failed()).join(good.select(key).distinct(), key, "left_semi")
    counts = cut_lineage(passed.groupBy(F.col(stratum).alias("_stratum")).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum((rate[rule] > c).cast("bigint")).alias(f"{rule}:{i}")
          for rule, cutoffs in candidates.items() for i, c in enumerate(cutoffs)]))
    tests = sum(map(len, candidates.values())) * max(1, counts.count())
    allowed = risk / len(candidates)
    entries = F.array(*[
        F.struct(F.lit(rule).alias("rule"), F.lit(float(c)).alias("cutoff"), F.col(f"`{rule}:{i}`").alias("x"))
        for rule, cutoffs in candidates.items() for i, c in enumerate(cutoffs)])
    rows = counts.select("_stratum", "_n", F.explode(entries).alias("_e"))
    level = math.log(error / tests)
    # beyond the mean the distribution function is above any such level
    certified = F.when(F.col("_e.x") < F.col("_n") * allowed,
                       binomial_log_cdf(F.col("_e.x"), F.col("_n"), allowed) <= level).otherwise(F.lit(False))
    return rows.filter(certified).groupBy("_stratum").agg(
        *[F.min(F.when(F.col("_e.rule") == rule, F.col("_e.cutoff"))).alias(f"_max_{rule}") for rule in candidates])


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang",
          label: str = "quality", risk: float = RISK, error: float = ERROR) -> DataFrame:
    """Measures, ``base_failed`` and ``kept`` per row of ``docs``.

    The measures are written once below the checkpoint folder (numbers only, no texts); the cutoffs come from
    them and the labels, and meet them again in a join on the stratum that Spark broadcasts while it is small.
    """
    measured = cut_lineage(measures(docs, key, text, stratum))
    good = labels.filter(F.col(label) == 1).select(F.col(key))
    limits = cut_lineage(thresholds(measured, good, key, stratum, risk, error))
    rate = rates()
    joined = measured.join(limits, F.col(stratum).eqNullSafe(F.col("_stratum")), "left")
    over = F.lit(False)
    for rule in CANDIDATES:
        over = over | F.coalesce(rate[rule] > F.col(f"_max_{rule}"), F.lit(False))
    failed = base_failed()
    return joined.select(*measured.columns, failed.alias("base_failed"), (~failed & ~over).alias("kept"))


def oracle_sql(tables: str = "documents", labels: str = "labels") -> str:
    """DuckDB SQL for the columns of the query, with the same cutoffs search."""
    tests = sum(map(len, CANDIDATES.values()))
    allowed = RISK / len(CANDIDATES)
    values = ", ".join(f"('{rule}', CAST({c!r} AS DOUBLE))" for rule, cutoffs in CANDIDATES.items() for c in cutoffs)
    picks = ", ".join(f"min(cutoff) FILTER (rule = '{rule}') AS max_{rule}" for rule in CANDIDATES)
    over = " OR ".join(f"coalesce({rule} > max_{rule}, false)" for rule in CANDIDATES)
    return rf"""
WITH texts AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM {tables}),
parts AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws,
                 list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM texts),
windows AS (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c
            FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM parts WHERE len(ws) >= 3)),
repeated AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM windows) WHERE n >= 2),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words
            FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM repeated) GROUP BY doc_id),
measured AS (
  SELECT doc_id, lang, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         len(ls) AS n_lines, length(regexp_replace(t, '[^A-Z!]+', '', 'g')) AS n_shouts
  FROM parts LEFT JOIN covered USING (doc_id)),
rated AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words AS base_failed,
         CASE WHEN word_chars > 0 THEN CAST(n_symbols AS DOUBLE) / word_chars ELSE 0 END AS symbol_rate,
         CASE WHEN word_chars > 0 THEN CAST(n_shouts AS DOUBLE) / word_chars ELSE 0 END AS shout_rate,
         CASE WHEN n_lines > 0 THEN CAST(n_dup_lines AS DOUBLE) / n_lines ELSE 0 END AS dup_line_rate,
         CASE WHEN n_words > 0 THEN CAST(n_repeat_words AS DOUBLE) / n_words ELSE 0 END AS repeat_rate,
         CASE WHEN n_words > 0 THEN CAST(word_chars AS DOUBLE) / n_words ELSE 0 END AS word_length
  FROM measured),
good AS (SELECT * FROM rated WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM {labels} WHERE quality = 1)),
candidates AS (SELECT * FROM (VALUES {values}) AS v(rule, cutoff)),
counts AS (
  SELECT lang, rule, cutoff, count(*) AS n,
         count(*) FILTER (CASE rule WHEN 'symbol_rate' THEN symbol_rate WHEN 'shout_rate' THEN shout_rate
                          WHEN 'dup_line_rate' THEN dup_line_rate WHEN 'repeat_rate' THEN repeat_rate
                          ELSE word_length END > cutoff) AS x
  FROM good, candidates GROUP BY ALL),
certified AS (
  SELECT lang, rule, cutoff FROM counts
  WHERE x < n * {allowed!r} AND
        list_sum(list_transform(range(0, x + 1), lambda k: exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)
                 + k * ln({allowed!r}) + (n - k) * ln(1 - {allowed!r}))))
        <= {ERROR!r} / ((SELECT count(DISTINCT coalesce(lang, chr(0))) FROM good) * {tests})),
limits AS (SELECT lang AS stratum, {picks} FROM certified GROUP BY lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT ({over}) AS kept
FROM rated LEFT JOIN limits ON lang IS NOT DISTINCT FROM stratum
"""
