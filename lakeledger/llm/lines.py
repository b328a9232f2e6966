"""Line deduplication behind two Bloom filters.

A line's key is the line without blanks at its ends and with A-Z lower-cased. Two Bloom filters are filled by one scan: ``once`` takes the
hash of every key a document has, ``twice`` those that were in ``once`` already. The filters are cut into segments by the
hash; scans send each segment the places of its hashes, and the tasks that hold the segments fill both. ``twice`` has
no false negatives, so a second scan sends on only the keys it lets through, counted per batch; they are
grouped exactly by 128-bit hashes, with the number of documents and the first one. A last scan drops the lines.

The filters have ``BITS_PER_KEY`` bits for every line that was counted, ``MAX_BITS`` at most: that bounds what is broadcast (64 MB). With more
lines than that the filter lets more of them through and the exact grouping, which is pre-aggregated, does more of the work
with the same result. The repeated keys are broadcast up to ``MAX_SENT`` of them; beyond, blocks of documents meet
theirs in a shuffle.

A null or empty text is one empty line. Every row is a document of its own, also where rows share an id or have none.
Keys without a code point are never repeated. An empty table gives an empty one; columns other than key and text are not looked at. A very
long text is a block of its own. ``docs`` must read the same several times (a table, not a random sample).
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .blobs import blocks, from_planes, planes
from .texts import LOWER, WORD, chunks, documents_of, hash_spans

MIN_DOCUMENTS = 10
BITS_PER_KEY = 16
MAX_BITS = 1 << 29
SEGMENT_KEYS = 1 << 18          # lines whose places one task fills a segment with
MAX_SENT = 1 << 22
LINE_CHUNK = 1 << 18        # bytes of text whose lines are worked on at once
_LAST = np.iinfo(np.int64).max


class Lines:
    """The lines of some texts: ``first[i]:first[i + 1]`` are those of text i, with bounds and the hashes of their keys."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(offsets) - 1
        breaks = np.flatnonzero(data == 0x0A)
        per_text = np.searchsorted(breaks, offsets[1:]) - np.searchsorted(breaks, offsets[:-1]) + 1
        self.first = np.concatenate([[0], np.cumsum(per_text)])
        self.doc = np.repeat(np.arange(n), per_text)
        total = int(self.first[-1])
        opens = np.zeros(total, bool)
        opens[self.first[:-1]] = True
        self.starts, self.ends = np.empty(total, np.int64), np.empty(total, np.int64)
        self.starts[opens], self.starts[~opens] = offsets[:-1], breaks + 1
        closes = np.append(opens[1:], True) if total else opens
        self.ends[closes], self.ends[~closes] = offsets[1:], breaks
        solid = np.flatnonzero(WORD[data])
        low, high = np.searchsorted(solid, self.starts), np.searchsorted(solid, self.ends)
        self.full = low < high                                       # lines with a key
        at, to = low[self.full], high[self.full] - 1
        key_starts, key_ends = solid[at], solid[to] + 1
        data = LOWER[data]
        self.one, self.two = hash_spans(data, key_starts, key_ends, 0), hash_spans(data, key_starts, key_ends, 1)
        self.of = self.doc[self.full]
        self.at = np.flatnonzero(self.full)


def distinct_keys(lines: Lines) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, second hash, text) of each key once per text, in the order of the hashes."""
    order = np.lexsort((lines.of, lines.two, lines.one))
    one, two, of = lines.one[order], lines.two[order], lines.of[order]
    new = np.ones(len(order), bool)
    new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1]) | (of[1:] != of[:-1])
    return one[new], two[new], of[new]


def grouped(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """First entries of runs of equal keys."""
    new = np.ones(len(one), bool)
    new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    return np.flatnonzero(new)


class Filters:
    """Where a key falls: its segment and two places there. ``width`` is the number of bits of a segment."""

    def __init__(self, segments: int, width: int):
        self.segments, self.width = segments, width

    def segment(self, one: np.ndarray) -> np.ndarray:
        return ((one >> np.uint64(32)) * np.uint64(self.segments) >> np.uint64(32)).astype(np.int64)

    def places(self, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, high = two & np.uint64(0xFFFFFFFF), two >> np.uint64(32)
        width = np.uint64(self.width)
        return (low * width >> np.uint64(32)).astype(np.uint32), (high * width >> np.uint64(32)).astype(np.uint32)

    def send(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per batch and segment the places of its keys; a flag where several of the batch's documents have the key."""
        for batch in batches:
            data, offsets = documents_of(batch, "_text")
            found = [distinct_keys(Lines(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low]))[:2]
                     for low, high in chunks(offsets, LINE_CHUNK)]
            if not found:
                continue
            one, two = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((two, one))
            one, two = one[order], two[order]
            head = grouped(one, two)
            several = np.diff(np.append(head, len(one))) > 1
            one, (a, b) = one[head], self.places(two[head])
            segment = self.segment(one)
            here, low = np.unique(segment, return_index=True)
            cut = [*low.tolist(), len(segment)]
            parts = [slice(*x) for x in zip(cut[:-1], cut[1:])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(here.astype(np.int32)), pa.array([planes(a[s]) for s in parts], pa.binary()),
                 pa.array([planes(b[s]) for s in parts], pa.binary()),
                 pa.array([np.packbits(several[s]).tobytes() for s in parts], pa.binary())], ["segment", "a", "b", "several"])

    def fill(self, table: pa.Table) -> pa.Table:
        """A segment of ``twice``, compressed. A key is in at most one entry per batch, so an entry never meets itself."""
        once, twice = np.zeros(self.width, bool), np.zeros(self.width, bool)
        for a, b, several in zip(*(table.column(c).to_pylist() for c in ("a", "b", "several"))):
            a, b = from_planes(a, np.uint32), from_planes(b, np.uint32)
            again = once[a] & once[b] | np.unpackbits(np.frombuffer(several, np.uint8), count=len(a)).astype(bool)
            twice[a[again]] = True
            twice[b[again]] = True
            once[a] = True
            once[b] = True
        return pa.table({"segment": table.column("segment").slice(0, 1),
                         "bits": pa.array([zlib.compress(np.packbits(twice).tobytes(), 1)], pa.binary())})


class Suspects:
    """The filter ``twice`` in a Python worker, unpacked once for all tasks."""

    _ready: dict[str, list] = {}

    def __init__(self, filters: Filters, shared: Broadcast):
        self.filters, self.shared, self.name = filters, shared, uuid.uuid4().hex

    def _rows(self) -> np.ndarray:
        if self.name not in Suspects._ready:
            Suspects._ready.clear()
            rows = np.zeros((self.filters.segments, self.filters.width + 7 >> 3), np.uint8)
            for segment, bits in self.shared.value:
                rows[segment] = np.frombuffer(zlib.decompress(bits), np.uint8)
            Suspects._ready[self.name] = rows
        return Suspects._ready[self.name]

    def __call__(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        rows, segment = self._rows(), self.filters.segment(one)
        let = np.ones(len(one), bool)
        for place in self.filters.places(two):
            let &= (rows[segment, place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1).astype(bool)
        return let


def _counted(batches: Iterable[pa.RecordBatch], suspects: Suspects) -> Iterator[pa.RecordBatch]:
    """Per batch the suspected keys, their documents and the smallest id among them."""
    for batch in batches:
        data, offsets = documents_of(batch, "_text")
        ids = np.asarray(batch.column(0).fill_null(_LAST))
        found = []
        for low, high in chunks(offsets, LINE_CHUNK):
            one, two, of = distinct_keys(Lines(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low]))
            let = suspects(one, two)
            found.append((one[let], two[let], ids[low + of[let]]))
        if not found:
            continue
        one, two, key = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((key, two, one))
        one, two, key = one[order], two[order], key[order]
        head = grouped(one, two)
        yield pa.RecordBatch.from_arrays(
            [pa.array(one[head].view(np.int64)), pa.array(two[head].view(np.int64)),
             pa.array(np.diff(np.append(head, len(one))).astype(np.int64)), pa.array(key[head])], ["one", "two", "n", "first"])


class Repeated:
    """Repeated keys, in the order of their hashes, with the id of the first document of each."""

    def __init__(self, one: np.ndarray, two: np.ndarray, first: np.ndarray):
        order = np.argsort(one.view(np.uint64), kind="stable")
        self.one, self.two, self.first = one.view(np.uint64)[order], two.view(np.uint64)[order], first[order]

    def dropped(self, lines: Lines, ids: np.ndarray, keep_first: bool) -> np.ndarray:
        """Per line whether it goes."""
        gone = np.zeros(len(lines.full), bool)
        if not len(self.one):
            return gone
        place = np.minimum(np.searchsorted(self.one, lines.one), len(self.one) - 1)
        hit = (self.one[place] == lines.one) & (self.two[place] == lines.two)
        if keep_first:
            # in the first document the first line with the key stays
            own = np.flatnonzero(hit & (self.first[place] == ids[lines.of]))
            pair = np.column_stack([lines.of[own], place[own]])
            _, leader = np.unique(pair, axis=0, return_index=True)
            hit[own[leader]] = False
        gone[lines.at[hit]] = True
        return gone


_KEPT = "n_lines bigint, n_dropped bigint, kept binary"


def _drop(data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, repeated: Repeated, keep_first: bool) -> list[pa.Array]:
    lines = Lines(data, offsets)
    gone = repeated.dropped(lines, ids, keep_first)
    n_gone = np.bincount(lines.doc[gone], minlength=len(offsets) - 1)
    whole = data.tobytes()
    texts = []
    for i, (low, high) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        if not n_gone[i]:
            texts.append(whole[low:high])
            continue
        a, b = int(lines.first[i]), int(lines.first[i + 1])
        stay = np.flatnonzero(~gone[a:b]) + a
        texts.append(b"\n".join([whole[s:e] for s, e in zip(lines.starts[stay].tolist(), lines.ends[stay].tolist())]))
    return [pa.array(np.diff(lines.first)), pa.array(n_gone.astype(np.int64)), pa.array(texts, pa.binary())]


def _with_sent(texts: DataFrame, shared: Broadcast, keep_first: bool) -> DataFrame:
    """The last scan with all repeated keys at hand."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated = Repeated(*shared.value)
        for batch in batches:
            data, offsets = documents_of(batch, "_text")
            ids = np.asarray(batch.column(0).fill_null(_LAST))
            for low, high in chunks(offsets, LINE_CHUNK):
                made = _drop(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low], ids[low:high], repeated, keep_first)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), *made],
                                                 ["_key", "n_lines", "n_dropped", "kept"])

    return texts.mapInArrow(run, f"_key bigint, {_KEPT}")


def _suspected_in_blocks(suspects: Suspects) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, data, offsets in blocks(batches, "_text"):
            one, two, _ = distinct_keys(Lines(data, offsets))
            head = grouped(one, two)
            head = head[suspects(one[head], two[head])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(head), block)), pa.array(one[head].view(np.int64)), pa.array(two[head].view(np.int64))],
                ["block", "one", "two"])

    return run


def _told(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block, rows, data, offsets in blocks(batches, "_text"):
        yield pa.RecordBatch.from_arrays([
            pa.array([block], pa.int64()), pa.ListArray.from_arrays(pa.array([0, rows.num_rows], pa.int32()), rows.column(0)),
            pa.array([planes(np.diff(offsets))], pa.binary()), pa.array([data.tobytes()], pa.binary())],
            ["block", "ids", "lengths", "texts"])


def _in_shuffle(texts: DataFrame, suspects: Suspects, repeated: DataFrame, keep_first: bool) -> DataFrame:
    """The last scan where the repeated keys are too many for one worker: each block meets those it has itself."""
    asked = texts.mapInArrow(_suspected_in_blocks(suspects), "block bigint, one bigint, two bigint")
    # a key is in a block once, and `repeated` is a plain table, so a key of very many blocks is split by AQE
    met = asked.join(repeated.select("one", "two", "first"), ["one", "two"])

    def run(block: pa.Table, keys: pa.Table) -> pa.Table:
        if block.num_rows != 1:
            raise ValueError("the documents were not read in the same blocks twice")
        own = Repeated(*(np.asarray(keys.column(c).combine_chunks()) for c in ("one", "two", "first")))
        ids = block.column("ids").chunk(0).flatten()
        offsets = np.concatenate([[0], np.cumsum(from_planes(block.column("lengths")[0].as_py(), np.int64))])
        data = np.frombuffer(block.column("texts")[0].as_py(), np.uint8)
        made = _drop(data, offsets, np.asarray(ids.fill_null(_LAST)), own, keep_first)
        return pa.table([ids, *made], ["_key", "n_lines", "n_dropped", "kept"])

    told = texts.mapInArrow(_told, "block bigint, ids array<bigint>, lengths binary, texts binary")
    return told.groupBy("block").cogroup(met.groupBy("block")).applyInArrow(run, f"_key bigint, {_KEPT}")


def drop_repeated(docs: DataFrame, key: str = "doc_id", text: str = "text", min_documents: int = MIN_DOCUMENTS, keep_first: bool = False,
                  max_bits: int = MAX_BITS, max_sent: int = MAX_SENT) -> DataFrame:
    """(key, n_lines, n_dropped, kept) per row: lines whose key at least ``min_documents`` (two or more) rows have are dropped.

    With ``keep_first`` one line of each such key stays: the first one in the document with the smallest id (a null id is the
    largest; of rows that share the smallest id each keeps its first). ``kept`` are the UTF-8 bytes of the other lines joined by \\n.
    Keys are integers.
    """
    if min_documents < 2:
        raise ValueError("a key of one document is not repeated")
    spark = docs.sparkSession
    texts = docs.select(F.col(key).cast("bigint").alias("_key"), F.col(text).alias("_text"))
    breaks = F.length("_text") - F.length(F.replace("_text", F.lit("\n"), F.lit(""))) + 1
    n_lines = texts.agg(F.coalesce(F.sum(breaks), F.lit(0))).first()[0]
    segments = max(1, -(-n_lines // SEGMENT_KEYS))
    filters = Filters(segments, max(64, min(BITS_PER_KEY * n_lines, max_bits) // segments))
    sent = texts.select("_text").mapInArrow(filters.send, "segment int, a binary, b binary, several binary")
    filled = sent.groupBy("segment").applyInArrow(lambda table: filters.fill(table), "segment int, bits binary").collect()
    suspects = Suspects(filters, spark.sparkContext.broadcast([(row["segment"], bytes(row["bits"])) for row in filled]))
    counted = texts.mapInArrow(lambda batches: _counted(batches, suspects), "one bigint, two bigint, n bigint, first bigint")
    exact = counted.groupBy("one", "two").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    repeated = cut_lineage(exact.filter(F.col("n") >= min_documents))
    if repeated.count() <= max_sent:
        rows = repeated.select("one", "two", "first").toArrow()
        arrays = [np.asarray(rows.column(c).combine_chunks(), dtype=np.int64) for c in ("one", "two", "first")]
        done = _with_sent(texts, spark.sparkContext.broadcast(arrays), keep_first)
    else:
        done = _in_shuffle(texts, suspects, repeated, keep_first)
    return done.select(F.col("_key").cast(docs.schema[key].dataType).alias(key), "n_lines", "n_dropped", "kept")


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
repeated AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(r.k) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN r.k IS NULL THEN line END, chr(10) ORDER BY i), '')) AS kept_sha256
FROM keyed LEFT JOIN repeated r ON r.k = keyed.k GROUP BY doc_id"""
