"""How far the sources of a language lie apart in their words, from run-length encoded count columns.

A source of a language is a group; every group, and the language as a whole, has a column of counts over the language's vocabulary (its
terms in at least ``MIN_DOCUMENTS`` documents). The smoothed share of a term is ``p = 1 + floor(10^9 (c + 2) / (N + 2 V))``, the divergence of
two columns at a term ``floor((p - q)^2 / (p + q))``, of two groups its sum over the vocabulary.

Terms with the same counts in all groups are one entry with a width; the entries of a language are ordered by their counts, which puts
equal counts of every column next to each other, and cut into slices of ``SLICE_ENTRIES``. In a slice each
group's column is run-length encoded; for a pair the boundaries of both columns' runs are intersected and the divergence of
each piece is multiplied by its length. Sums of the slices add up to the pair's value, so neither a vocabulary nor a language is in one task.
All arithmetic is whole-numbered and exact.

Null texts, languages and sources are empty strings; every row is a document of its own, also where rows share an id. A language without
terms has pairs of value 0. A language with one source has no pairs. An empty table gives an empty one. Only the named columns are looked
at. A very long text is counted in chunks of its own. Counts of one group and term stay below 2^63.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage
from .texts import LOWER, byte_table, chunks, documents_of, hash_spans, mix, word_bounds

MIN_DOCUMENTS = 10
TOP = 10
SCALE = 1_000_000_000
SLICE_ENTRIES = 50_000
HELD_ROWS = 400_000           # counted entries a task holds before it passes them on
LETTER = byte_table((0x61, 0x7A), (0x80, 0xFF))        # [^\x00-\x40\x5B-\x60\x7B-\x7F], after lower-casing A-Z


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The pieces data[starts:ends] as strings."""
    lengths = ends - starts
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], lengths)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data[at]))


def count_terms(data: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(group, term, occurrences, documents) of every term of every group, for texts with a group number each."""
    data = LOWER[data]
    starts, ends, first = word_bounds(data, offsets, LETTER)
    hashes = hash_spans(data, starts, ends)
    doc = np.repeat(np.arange(len(group)), np.diff(first))
    place = mix(hashes + (group[doc] + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, one, which, n = np.unique(place, return_index=True, return_inverse=True, return_counts=True)
    # texts stand in order, so the first occurrence of (text, term) opens a document of the term
    order = np.lexsort((doc, which))
    new = np.ones(len(order), bool)
    new[1:] = (which[order][1:] != which[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    n_docs = np.bincount(which[order][new], minlength=len(one))
    return group[doc[one]], _strings(data, starts[one], ends[one]), n, n_docs


def _summed(parts: list[pa.Table]) -> pa.Table:
    table = pa.concat_tables(parts).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
    return table.rename_columns(["lang", "source", "term", "n", "docs"])


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs), pre-aggregated over the batches of a task."""
    held: list[pa.Table] = []
    rows = 0
    for batch in batches:
        data, offsets = documents_of(batch, "_text")
        langs, sources = batch.column(0), batch.column(1)
        a, b = (np.asarray(x.dictionary_encode().indices).astype(np.int64) for x in (langs, sources))
        _, at, group = np.unique(a * (len(b) + 1) + b, return_index=True, return_inverse=True)
        langs, sources = langs.take(pa.array(at)), sources.take(pa.array(at))
        for low, high in chunks(offsets):
            g, terms, n, docs = count_terms(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low], group[low:high])
            g = pa.array(g)
            held.append(pa.table([langs.take(g), sources.take(g), terms, pa.array(n), pa.array(docs)],
                                 ["lang", "source", "term", "n", "docs"]))
            rows += len(terms)
            if rows > HELD_ROWS:
                held = [_summed(held)]
                rows = held[0].num_rows
                if rows > HELD_ROWS // 2:
                    yield from held[0].to_batches()
                    held, rows = [], 0
    if held:
        yield from _summed(held).to_batches()


def runs(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Run-length encoding of a column: (value, start) of its runs; ``starts`` is where each entry begins in the vocabulary."""
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return values[new], starts[new]


def divergence(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], end: int) -> int:
    """Sum of f over the vocabulary entries up to ``end``, piece by piece between the run boundaries of both columns."""
    cuts = np.union1d(a[1], b[1])
    p, q = (column[np.searchsorted(start, cuts, side="right") - 1] for column, start in (a, b))
    return int(((p - q) ** 2 // (p + q) * np.diff(np.append(cuts, end))).sum())


def shares(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """p of each count of a column."""
    if len(counts) and int(counts.max()) >= (1 << 63) // SCALE - 2:
        return np.array([1 + SCALE * (c + 2) // (total + 2 * terms) for c in counts.tolist()], np.int64)
    return 1 + SCALE * (counts + 2) // (total + 2 * terms)


def _pairs(entries: pa.Table, groups: pa.Table) -> pa.Table:
    """Partial sums of all pairs of groups of a language over one slice of its vocabulary."""
    groups = groups.combine_chunks()
    sources = groups.column("source").to_pylist()
    number = {name: k for k, name in enumerate(sources)}
    entries = entries.sort_by("entry").combine_chunks()
    starts = np.cumsum(np.concatenate([[0], np.asarray(entries.column("width"))])).astype(np.int64)
    starts, end = starts[:-1], int(starts[-1])
    columns = [(np.zeros(0, np.int64), starts)] * len(sources)
    if entries.num_rows:
        lists = entries.column("counts").combine_chunks()
        flat = lists.flatten()
        entry = np.repeat(np.arange(entries.num_rows), np.asarray(lists.value_lengths()))
        coded = flat.field("source").dictionary_encode()
        of = np.array([number[name] for name in coded.dictionary.to_pylist()])[np.asarray(coded.indices)]
        n = np.asarray(flat.field("n"))
        by_group = np.argsort(of, kind="stable")
        cut = np.searchsorted(of[by_group], np.arange(len(sources) + 1))
        for k, (total, terms) in enumerate(zip(groups.column("total").to_pylist(), groups.column("terms").to_pylist())):
            values = np.zeros(entries.num_rows, np.int64)
            mine = by_group[cut[k]:cut[k + 1]]
            values[entry[mine]] = n[mine]
            values, run_starts = runs(values, starts)
            columns[k] = (shares(values, total, terms), run_starts)
    pairs = [(i, j) for i in range(len(sources)) for j in range(i + 1, len(sources))]
    value = [divergence(columns[i], columns[j], end) if entries.num_rows else 0 for i, j in pairs]
    lang = groups.column("lang").take(pa.array(np.zeros(len(pairs), np.int64)))
    return pa.table([lang, pa.array([sources[i] for i, _ in pairs], pa.string()), pa.array([sources[j] for _, j in pairs], pa.string()),
                     pa.array(value, pa.int64())], ["lang", "source", "item", "value"])


def share(count: Column, total: Column, terms: Column) -> Column:
    """p of a count; decimals, because 10^9 times a large count is no long."""
    number = F.lit(SCALE).cast("decimal(10,0)") * (count + F.lit(2)).cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", number, (total + 2 * terms).cast("decimal(20,0)"))


def _f(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", min_documents: int = MIN_DOCUMENTS,
          top: int = TOP, slice_entries: int = SLICE_ENTRIES) -> DataFrame:
    """(lang, source, part, item, value, rank): per group its divergence from every other source of the language (part ``pair``) and the
    ``top`` terms that it uses more than the language does (part ``term``). Ranks go by falling value, then by the item's bytes."""
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"),
                        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.col(text).alias("_text"))
    counts = texts.mapInArrow(_counted, "lang string, source string, term string, n bigint, docs bigint")
    # one exchange, on (lang, term): both aggregates below use it, and tasks have summed up frequent terms before
    counts = counts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    # as many entries as the language has sources, in the order of the sources
    by_term = counts.groupBy("lang", "term").agg(
        F.array_sort(F.collect_list(F.struct("source", "n"))).alias("counts"), F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = cut_lineage(by_term.filter(F.col("docs") >= min_documents).drop("docs"))
    # totals: a row per language and per group, groups without terms included
    whole = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("lang_total"))
    totals = kept.select("lang", F.explode("counts").alias("_c")).groupBy("lang", "_c.source").agg(F.sum("_c.n").alias("total"))
    groups = texts.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(whole, "lang", "left")
    groups = cut_lineage(groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "terms", "lang_total")]))
    some = groups.filter("terms > 0")

    def ranked(rows: DataFrame) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
        return rows.withColumn("rank", place)

    # part term
    each = kept.select("lang", "term", F.col("n").alias("lang_n"), F.explode("counts").alias("_c")).select("lang", "term", "lang_n", "_c.*")
    shares = each.join(some, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("terms"))).withColumn(
        "q", share(F.col("lang_n"), F.col("lang_total"), F.col("terms")))
    terms = ranked(shares.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                                                 _f(F.col("p"), F.col("q")).alias("value"))).filter(F.col("rank") <= top)

    # part pair: terms with equal counts are one entry; entries in their order, cut into slices
    entries = cut_lineage(kept.groupBy("lang", "counts").agg(F.count(F.lit(1)).alias("width")))
    n_slices = max(1, -(-entries.count() // slice_entries))
    ordered = entries.repartitionByRange(n_slices, "lang", "counts").sortWithinPartitions("lang", "counts")
    sliced = cut_lineage(ordered.withColumn("slice", F.spark_partition_id()).withColumn("entry", F.monotonically_increasing_id()))
    without = groups.filter("terms = 0").select("lang", F.lit(-1).alias("slice"))
    present = sliced.select(F.col("lang").alias("lang"), F.col("slice").alias("slice")).unionByName(without).distinct()
    sides = groups.join(present, "lang")
    half = sliced.groupBy("lang", "slice").cogroup(sides.groupBy("lang", "slice")).applyInArrow(
        _pairs, "lang string, source string, item string, value bigint").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    sides = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    pairs = ranked(half.select("lang", "value", sides.alias("_s")).select("lang", "_s.source", F.lit("pair").alias("part"), "_s.item", "value"))
    names = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(*names).unionByName(terms.select(*names))


ORACLE = r"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
words AS (SELECT row, lang, source, unnest(words) AS term FROM (SELECT *, row_number() OVER () AS row FROM texts)),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT row) >= 10),
counts AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM texts),
vocabulary AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
full_counts AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM groups g JOIN kept k USING (lang)
  LEFT JOIN counts c USING (lang, source, term)),
p AS (SELECT lang, source, term, n, 1 + 1000000000 * (n::HUGEINT + 2) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS p
  FROM full_counts JOIN vocabulary USING (lang)),
q AS (SELECT lang, term, 1 + 1000000000 * (n::HUGEINT + 2) // (sum(n) OVER (PARTITION BY lang) + 2 * v) AS q
  FROM (SELECT lang, term, sum(n) AS n FROM counts GROUP BY ALL) JOIN vocabulary USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL
  SELECT p.lang, p.source, 'term', p.term, (p - q) * (p - q) // (p + q) FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM parts)
WHERE part = 'pair' OR rank <= 10"""
