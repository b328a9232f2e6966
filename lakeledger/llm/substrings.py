"""Substring deduplication behind a count-min prefilter.

A window is 50 consecutive words of one text. First every window of the corpus is counted in a count-min sketch: each batch counts
its own windows, segments of the sketch merge what the batches counted, and cells saturate at two, which is all that is
asked of them. The sketch never underestimates. In a second pass only windows whose cells all say "twice or more" are grouped exactly, by
96-bit hashes in shards of the hash space, so a repeated window is never lost and one that is not costs
nothing but its place in that shuffle. A block of documents sends each window once, with the smallest id that has it there, so a passage that
very many documents share is a row per block. It learns whether another block has the window with a smaller id;
the third pass removes the words that windows of later documents cover. The number of shards follows the bytes of the texts.

The merged sketch has ``DEPTH`` rows of ``2 ** WIDTH_BITS`` cells, one bit each, whatever the size of the corpus: that bounds what is
broadcast (64 MB). With many more windows than cells ever more windows pass the filter and the second pass does more
of the work, with the same result; a cluster with large executors should widen it.

Null texts have no words. Rows that share an id are no smaller than each other and keep what they share; a null id counts as the
largest. ``docs`` must read the same twice (a table, not a random sample). An empty table gives an empty one. Columns other than key and text
are not looked at. A very long text is a block of its own.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .blobs import blocks, from_planes, from_steps, planes, shard_edges, steps
from .texts import WORD, chunks, documents_of, hash_spans, word_bounds

WINDOW = 50
DEPTH = 2
WIDTH_BITS = 28
SHARD_BYTES = 32 << 20      # of text whose repeated windows one task compares at most
_LAST = np.iinfo(np.int64).max


def windows(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, second hash, first word, text) of every window; ``first word`` counts through all texts."""
    starts, ends, first = word_bounds(data, offsets, WORD)
    words = hash_spans(data, starts, ends)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    at = np.flatnonzero(np.arange(len(words)) + size <= first[1:][doc]) if len(words) else np.zeros(0, np.int64)
    return hash_spans(words, at, at + size, 0), hash_spans(words, at, at + size, 1), at, doc[at]


def cells(one: np.ndarray, two: np.ndarray, depth: int, bits: int) -> Iterator[np.ndarray]:
    """The cell of each window in every row of the sketch."""
    for row in range(depth):
        yield ((one + two * np.uint64(row)) >> np.uint64(64 - bits)).astype(np.uint32)


def _sketched(batches: Iterable[pa.RecordBatch], size: int, depth: int, bits: int, segments: int) -> Iterator[pa.RecordBatch]:
    """Per batch, row and segment the cells with windows, those with several twice."""
    edges = np.array([(s << bits) // segments for s in range(segments)], np.uint32)
    for batch in batches:
        data, offsets = documents_of(batch, "_text")
        found = [[np.zeros(0, np.uint32)] for _ in range(depth)]
        for low, high in chunks(offsets):
            one, two, _, _ = windows(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low], size)
            for row, cell in enumerate(cells(one, two, depth, bits)):
                found[row].append(cell)
        out = []
        for row in range(depth):
            cell = np.sort(np.concatenate(found[row]))
            third = np.zeros(len(cell), bool)
            third[2:] = cell[2:] == cell[:-2]
            cell = cell[~third]
            cut = [*np.searchsorted(cell, edges).tolist(), len(cell)]
            out += [(row * segments + s, steps(cell[cut[s]:cut[s + 1]], int(edges[s])))
                    for s in range(segments) if cut[s] < cut[s + 1]]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.int32()), pa.array([c for _, c in out], pa.binary())],
                                             ["segment", "cells"])


def _merged(bits: int, segments: int):
    """A segment of the merged sketch: a bit per cell that counted two or more, compressed."""
    def run(table: pa.Table) -> pa.Table:
        segment = table.column("segment")[0].as_py()
        low, high = ((segment % segments + i << bits) // segments for i in (0, 1))
        seen, twice = np.zeros(high - low, bool), np.zeros(high - low, bool)
        for blob in table.column("cells"):
            cell = from_steps(blob.as_py(), low, np.uint32).astype(np.int64) - low
            again = np.zeros(len(cell), bool)
            again[1:] = cell[1:] == cell[:-1]
            twice[cell[again | seen[cell]]] = True
            seen[cell] = True
        return pa.table({"segment": pa.array([segment], pa.int32()),
                         "bits": pa.array([zlib.compress(np.packbits(twice).tobytes(), 1)], pa.binary())})

    return run


class Sketch:
    """The merged sketch on an executor."""

    def __init__(self, parts: list[tuple[int, bytes]], depth: int, bits: int, segments: int):
        self.depth, self.bits = depth, bits
        self.rows = [np.zeros((1 << bits) + 7 >> 3, np.uint8) for _ in range(depth)]
        for segment, packed in parts:
            row, s = divmod(segment, segments)
            low, high = (s << bits) // segments, (s + 1 << bits) // segments
            twice = np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8), count=high - low)
            if low % 8 == 0 and high % 8 == 0:
                self.rows[row][low >> 3:high >> 3] = np.packbits(twice)
            else:
                at = np.flatnonzero(twice) + low
                np.bitwise_or.at(self.rows[row], at >> 3, (128 >> (at & 7)).astype(np.uint8))

    def repeated(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Whether the estimate is two or more."""
        result = np.ones(len(one), bool)
        for row, cell in zip(self.rows, cells(one, two, self.depth, self.bits)):
            result &= (row[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool)
        return result


_READY: dict[str, Sketch] = {}


def _sketch(name: str, shared, depth: int, bits: int, segments: int) -> Sketch:
    """One sketch per Python worker."""
    if name not in _READY:
        _READY.clear()
        _READY[name] = Sketch(shared.value, depth, bits, segments)
    return _READY[name]


class Flagged:
    """The windows of a block that the sketch lets through, those of equal hashes as one, in the order of the hashes."""

    def __init__(self, sketch: Sketch, data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, size: int):
        one, two, at, doc = windows(data, offsets, size)
        kept = np.flatnonzero(sketch.repeated(one, two))
        kept = kept[np.lexsort((ids[doc[kept]], two[kept], one[kept]))]
        one, two, self.at, self.doc = one[kept], two[kept], at[kept], doc[kept]
        new = np.ones(len(one), bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        head = np.flatnonzero(new)
        # the first of a window has the smallest id in this block
        self.one, self.two, self.first_doc, self.group = one[head], two[head], self.doc[head], np.cumsum(new) - 1


def _asked(batches: Iterable[pa.RecordBatch], sketch: Sketch, size: int, shards: int) -> Iterator[pa.RecordBatch]:
    """Per block and shard every window once, with the smallest id that has it in the block."""
    edges = shard_edges(shards)
    for block, rows, data, offsets in blocks(batches, "_text"):
        ids = np.asarray(rows.column(0).fill_null(_LAST))
        found = Flagged(sketch, data, offsets, ids, size)
        one = found.one
        if not len(one):
            continue
        cut = [*np.searchsorted(one, edges).tolist(), len(one)]
        out = [(p, slice(cut[p], cut[p + 1])) for p in range(shards) if cut[p] < cut[p + 1]]
        columns = []
        for p, s in out:
            here, number = np.unique(found.first_doc[s], return_inverse=True)
            columns.append((p, steps(one[s], int(edges[p])), planes((found.two[s] >> np.uint64(32)).astype(np.uint32)),
                            planes(number.astype(np.uint32)), planes(ids[here])))
        yield pa.RecordBatch.from_arrays(
            [pa.array([c[0] for c in columns], pa.int32()), pa.array([block] * len(columns), pa.int64()),
             *[pa.array([c[i] for c in columns], pa.binary()) for i in (1, 2, 3, 4)]],
            ["shard", "block", "one", "two", "numbers", "ids"])


def _answers(shards: int):
    """Per block a bit for each window asked about: whether a document of another block has it with a smaller id than all of this block."""
    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        base = int(shard_edges(shards)[shard])
        one = [from_steps(x, base) for x in table.column("one").to_pylist()]
        two = np.concatenate([from_planes(x, np.uint32) for x in table.column("two").to_pylist()])
        ids = np.concatenate([from_planes(i, np.int64)[from_planes(n, np.uint32)] for n, i in
                              zip(table.column("numbers").to_pylist(), table.column("ids").to_pylist())])
        cut = np.cumsum([len(x) for x in one])[:-1]
        one = np.concatenate(one)
        order = np.lexsort((two, one))
        a, b = one[order], two[order]
        new = np.ones(len(order), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        least = np.minimum.reduceat(ids[order], np.flatnonzero(new))[np.cumsum(new) - 1]
        later = np.empty(len(order), bool)
        later[order] = ids[order] > least
        return pa.table({"block": table.column("block"), "shard": pa.array([shard] * table.num_rows, pa.int32()),
                         "later": pa.array([np.packbits(x).tobytes() for x in np.split(later, cut)], pa.binary())})

    return run


def _told(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per block: its ids and texts."""
    for block, rows, data, offsets in blocks(batches, "_text"):
        whole = pa.array([data.tobytes()], pa.binary())
        yield pa.RecordBatch.from_arrays([
            pa.array([block], pa.int64()), pa.ListArray.from_arrays(pa.array([0, rows.num_rows], pa.int32()), rows.column(0)),
            pa.array([planes(np.diff(offsets))], pa.binary()), whole], ["block", "ids", "lengths", "texts"])


def _removed(shared, name: str, size: int, depth: int, bits: int, segments: int, shards: int):
    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        if block.num_rows != 1:
            raise ValueError("the documents were not read in the same blocks twice")
        sketch = _sketch(name, shared, depth, bits, segments)
        keys = block.column("ids").chunk(0).flatten()
        lengths = from_planes(block.column("lengths")[0].as_py(), np.int64)
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        text = block.column("texts")[0].as_py()
        data = np.frombuffer(text, np.uint8)
        ids = np.asarray(keys.fill_null(_LAST))
        found = Flagged(sketch, data, offsets, ids, size)
        one, at = found.one, found.at
        cut = [*np.searchsorted(one, shard_edges(shards)).tolist(), len(one)]
        later = np.zeros(len(one), bool)
        told = 0
        for shard, bits_ in zip(answers.column("shard").to_pylist(), answers.column("later").to_pylist()):
            n = cut[shard + 1] - cut[shard]
            later[cut[shard]:cut[shard + 1]] = np.unpackbits(np.frombuffer(bits_, np.uint8), count=n)
            told += n
        if told != len(one):
            raise ValueError("the documents were not read in the same blocks twice")
        # later than another block, or than a document of this one
        later = later[found.group] | (ids[found.doc] > ids[found.first_doc][found.group])
        _, _, first = word_bounds(data, offsets, WORD)
        change = np.zeros(int(first[-1]) + 1, np.int64)
        np.add.at(change, at[later], 1)
        np.add.at(change, at[later] + size, -1)
        kept = np.cumsum(change[:-1]) == 0
        texts = []
        for i, (low, high) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
            words = text[offsets[i]:offsets[i + 1]].split()
            mask = kept[low:high]
            texts.append(b" ".join(words if mask.all() else compress(words, mask.tolist())))
        n_words = np.diff(first)
        still = np.concatenate([[0], np.cumsum(kept)])
        return pa.table({"key": keys, "n_words": n_words.astype(np.int64),
                         "n_removed": (n_words - (still[first[1:]] - still[first[:-1]])).astype(np.int64),
                         "kept": pa.array(texts, pa.binary())})

    return run


def remove_repeated(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, depth: int = DEPTH,
                    width_bits: int = WIDTH_BITS) -> DataFrame:
    """(key, n_words, n_removed, kept) per row: ``kept`` are the UTF-8 bytes of the remaining words joined by spaces. Keys are integers."""
    spark = docs.sparkSession
    texts = docs.select(F.col(key).cast("bigint"), F.col(text).alias("_text"))
    n_bytes = texts.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()[0]
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // SHARD_BYTES))
    counted = texts.select("_text").mapInArrow(
        lambda batches: _sketched(batches, window, depth, width_bits, shards), "segment int, cells binary")
    parts = counted.groupBy("segment").applyInArrow(_merged(width_bits, shards), "segment int, bits binary").collect()
    shared = spark.sparkContext.broadcast([(row["segment"], bytes(row["bits"])) for row in parts])
    name = uuid.uuid4().hex

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _asked(batches, _sketch(name, shared, depth, width_bits, shards), window, shards)

    asked = texts.mapInArrow(ask, "shard int, block bigint, one binary, two binary, numbers binary, ids binary")
    answers = asked.groupBy("shard").applyInArrow(_answers(shards), "block bigint, shard int, later binary")
    told = texts.mapInArrow(_told, "block bigint, ids array<bigint>, lengths binary, texts binary")
    done = told.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _removed(shared, name, window, depth, width_bits, shards, shards), "key bigint, n_words bigint, n_removed bigint, kept binary")
    return done.select(F.col("key").cast(docs.schema[key].dataType).alias(key), "n_words", "n_removed", "kept")


ORACLE = r"""
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
windows AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM texts)),
firsts AS (SELECT h, min(doc_id) AS first FROM windows GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM windows JOIN firsts USING (h) WHERE first < doc_id),
words AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM texts),
marked AS (SELECT w.doc_id, w.i, w.w, g.i IS NOT NULL AS removed FROM words w LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.i = w.i)
SELECT t.doc_id, CAST(len(ws) AS BIGINT) AS n_words, count(*) FILTER (removed) AS n_removed,
       sha256(coalesce(string_agg(w, ' ' ORDER BY i) FILTER (NOT removed), '')) AS kept_sha256
FROM texts t LEFT JOIN marked m ON m.doc_id = t.doc_id GROUP BY t.doc_id, ws"""
