"""Benchmark decontamination with suffix arrays of the training texts.

Every shard of documents (a chunk of a few megabytes of whole texts) gets a suffix array over its words. Suffixes whose first
words begin no test suffix can't match and are left out before sorting. The test suffixes are then searched at once by
bisection, word by word; suffixes that begin with the same window are searched once, and their items are looked up by that window.
The range after ``WINDOW`` words holds every location of a window, so the work grows with the text and the items, not with their product.
The longest verbatim match of a document is found by halving: a match of some length holds matches of all shorter ones.
Shards need nothing of each other, so the documents are never shuffled.

Test items are sent to the executors in blocks of at most ``BLOCK_BYTES`` of text (a longer item alone); several blocks are
several passes over the documents whose hits are put together per row.

Words are lower-cased runs of letters, digits and non-ASCII characters, compared by 64-bit hashes of every word. Null texts and
items have no words; items with a null id are left out. An item row that repeats an id adds its windows to that item.
Rows of documents are judged one by one. Empty tables on either side are taken. ``find`` looks at key and text only, ``clean`` carries all
columns along. A very long text is a shard of its own.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .texts import ALNUM, LOWER, chunks, documents_of, hash_spans, hash_sums, mix, prefix_sums, word_bounds

WINDOW = 10
BLOCK_BYTES = 16 << 20
_SIEVE_BITS = 20
_HEAD = 3                     # words that sieve suffixes, fewer where an item is shorter


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, first): the words of text i are hashes[first[i]:first[i + 1]]."""
    data = LOWER[data]
    starts, ends, first = word_bounds(data, offsets, ALNUM)
    return hash_spans(data, starts, ends), first


def _heads(words: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the ``length`` words from each place."""
    key = np.zeros(len(at), np.uint64)
    for j in range(length):
        key = mix(key + words[at + j])
    return key


@dataclass
class TestItems:
    """Words of all items of a block, the end of the item at every word, and the words that a window there needs."""

    ids: list[str]
    words: np.ndarray
    item: np.ndarray              # number of the item at each word
    end: np.ndarray               # end of that item
    starts: np.ndarray            # where a window starts
    window: np.ndarray            # number of that window: equal ones have one
    reps: np.ndarray              # a start of each window
    need: np.ndarray              # words of each window
    members: np.ndarray           # items of window w: members[edges[w]:edges[w + 1]]
    edges: np.ndarray
    head: int
    heads: np.ndarray
    sieve: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[str, str]], window: int) -> TestItems:
        data = [text.encode("utf-8", "replace") for _, text in rows]
        offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
        words, first = words_of(np.frombuffer(b"".join(data), np.uint8), offsets)
        lengths = np.diff(first)
        item, end = np.repeat(np.arange(len(rows)), lengths), np.repeat(first[1:], lengths)
        left = end - np.arange(len(words))
        need = np.minimum(window, lengths)[item] if len(words) else np.zeros(0, np.int64)
        starts = np.flatnonzero(left >= need)
        need = need[starts]
        _, one, same = np.unique(hash_spans(words, starts, starts + need), return_index=True, return_inverse=True)
        owners = np.unique(np.column_stack([same, item[starts]]), axis=0) if len(starts) else np.zeros((0, 2), np.int64)
        head = int(min(_HEAD, need.min())) if len(need) else 1
        heads = np.unique(_heads(words, starts, head))
        sieve = np.zeros(1 << _SIEVE_BITS, bool)
        sieve[(heads >> np.uint64(64 - _SIEVE_BITS)).astype(np.int64)] = True
        return cls([i for i, _ in rows], words, item, end, starts, same, starts[one], need[one], owners[:, 1],
                   np.searchsorted(owners[:, 0], np.arange(len(one) + 1)), head, heads, sieve)


def suffix_array(words: np.ndarray, end: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """``starts`` in the order of the words from there, down to ``depth`` words; a text that ends comes first.

    ``end`` is the end of the text of each start. Ties alone are looked at further, a few words at a time.
    """
    n = len(starts)
    order, group = np.arange(n), np.zeros(n, np.int64)       # group: number of the tie class, in order
    tied = np.arange(n)                                      # places in ``order`` that still have ties
    for low in range(0, depth, 4):
        if not len(tied):
            break
        member = order[tied]
        columns = []
        for j in range(low, min(low + 4, depth)):
            at = starts[member] + j
            inside = at < end[member]
            columns += [inside, np.where(inside, words[np.minimum(at, len(words) - 1)], np.uint64(0))]
        rank = np.lexsort([*columns[::-1][0:0], *[columns[i ^ 1] for i in range(len(columns))][::-1], group[tied]])
        order[tied] = member[rank]
        columns = [c[rank] for c in columns]
        held = group[tied][rank]
        new = np.ones(len(tied), bool)
        new[1:] = held[1:] != held[:-1]
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        group[tied] = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))]
        alone = new & np.append(new[1:], True)
        tied = tied[~alone]
    return starts[order]


def _bound(column: np.ndarray, inside: np.ndarray, low: np.ndarray, high: np.ndarray, value: np.ndarray, right: bool):
    """Per row the first place in column[low:high] whose entry is not below (``right``: above) the value."""
    low, high = low.copy(), high.copy()
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        middle = (low[open_] + high[open_]) >> 1
        entry = column[middle]
        below = ~inside[middle] | (entry <= value[open_] if right else entry < value[open_])
        low[open_[below]] = middle[below] + 1
        high[open_[~below]] = middle[~below]


def search(items: TestItems, words: np.ndarray, end: np.ndarray, array: np.ndarray):
    """Bisect a suffix of every window in a suffix array: (window, place) wherever one occurs.

    ``end`` is the end of the text at each entry of the array. Windows of one length share no place, so there are at most
    ``WINDOW`` pairs per place.
    """
    low, high = np.zeros(len(items.reps), np.int64), np.full(len(items.reps), len(array), np.int64)
    window_low, window_high = np.zeros(len(low), np.int64), np.zeros(len(low), np.int64)
    live = np.arange(len(low))
    depth = 0
    while len(live) and len(array):
        at = array + depth
        inside = at < end
        column = np.where(inside, words[np.minimum(at, len(words) - 1)], np.uint64(0))
        value = items.words[items.reps[live] + depth]
        a = _bound(column, inside, low[live], high[live], value, False)
        b = _bound(column, inside, a, high[live], value, True)
        found = a < b
        live, a, b = live[found], a[found], b[found]
        low[live], high[live] = a, b
        depth += 1
        full = live[items.need[live] == depth]
        window_low[full], window_high[full] = low[full], high[full]
        live = live[items.need[live] > depth]
    count = window_high - window_low
    window = np.repeat(np.arange(len(count)), count)
    place = np.repeat(window_low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return window, array[place]


def longest_matches(items: TestItems, words: np.ndarray, doc: np.ndarray, end: np.ndarray, window: np.ndarray,
                    place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length, place, item) of the longest match of every text that has a window; of equals the first place, then the first item.

    The length is halved in for all texts at once: a text has a match of n words if the hash of the n words at one of its window places is
    that of n words at one of the items' places with such a window.
    """
    shortest = np.full(int(doc[place].max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(shortest, doc[place], items.need[window])
    place = np.unique(place)
    text, of = np.unique(doc[place], return_inverse=True)
    hit = np.zeros(len(items.reps), bool)
    hit[window] = True
    starts = items.starts[hit[items.window]]
    room, left = end[place] - place, items.end[starts] - starts
    in_items, in_texts = prefix_sums(items.words), prefix_sums(words)

    def matching(length: np.ndarray, texts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per length asked: places of those texts whose next words are in an item, their hashes, and the items' hashes in order with the starts."""
        out = []
        rank = np.full(len(text), -1)
        rank[texts] = np.arange(len(texts))
        for n in np.unique(length):
            mine = np.flatnonzero((rank[of] >= 0) & (room >= n))
            mine = mine[length[rank[of[mine]]] == n]
            own = starts[left >= n]
            known = hash_sums(in_items, own, own + n)
            order = np.argsort(known, kind="stable")
            known, own = known[order], own[order]
            asked = hash_sums(in_texts, place[mine], place[mine] + n)
            at = np.minimum(np.searchsorted(known, asked), max(len(known) - 1, 0))
            met = known[at] == asked if len(known) else np.zeros(len(asked), bool)
            out.append((mine[met], known, own, asked[met]))
        return out

    low = shortest[text]                                    # a match of so many words there is
    longest_room = np.zeros(len(text), np.int64)
    np.maximum.at(longest_room, of, room)
    high = np.maximum(np.minimum(longest_room, int(left.max())), low)
    open_ = np.flatnonzero(low < high)
    while len(open_):
        middle = (low[open_] + high[open_] + 1) >> 1
        yes = np.zeros(len(text), bool)
        for met, *_ in matching(middle, open_):
            yes[of[met]] = True
        found = yes[open_]
        low[open_[found]] = middle[found]
        high[open_[~found]] = middle[~found] - 1
        open_ = open_[low[open_] < high[open_]]
    best_place, best_item = np.full(len(text), -1), np.zeros(len(text), np.int64)
    for met, known, own, asked in matching(low, np.arange(len(text))):
        first, at = np.unique(of[met], return_index=True)   # places are in order
        best_place[first] = place[met[at]]
        a, b = np.searchsorted(known, asked[at], "left"), np.searchsorted(known, asked[at], "right")
        item = items.item[own]
        best_item[first] = [item[x:y].min() for x, y in zip(a.tolist(), b.tolist())]
    return low, best_place, best_item


def shard_hits(items: TestItems, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, list, list, int, str | None, int]]:
    """Per text of a shard: words, hit ranges [start, end), ids hit, longest match, its item, its word."""
    words, first = words_of(data, offsets)
    n_docs = len(first) - 1
    doc = np.repeat(np.arange(n_docs), np.diff(first))
    end = first[1:][doc] if len(words) else np.zeros(0, np.int64)
    result = [(int(n), [], [], 0, None, -1) for n in np.diff(first)]
    if not len(words) or not len(items.starts):
        return result
    at = np.flatnonzero(end - np.arange(len(words)) >= items.head)
    heads = _heads(words, at, items.head)
    maybe = items.sieve[(heads >> np.uint64(64 - _SIEVE_BITS)).astype(np.int64)]
    at, heads = at[maybe], heads[maybe]
    near = np.minimum(np.searchsorted(items.heads, heads), len(items.heads) - 1)
    at = at[items.heads[near] == heads]
    if not len(at):
        return result
    array = suffix_array(words, end[at], at, int(items.need.max()))
    window, place = search(items, words, end[array], array)
    if len(place):
        mark = np.zeros(len(words) + 1, np.int64)
        np.add.at(mark, place, 1)
        np.add.at(mark, place + items.need[window], -1)
        covered = np.cumsum(mark[:-1]) > 0
        opened = covered.copy()
        opened[1:] &= ~covered[:-1] | (doc[1:] != doc[:-1])
        closed = covered.copy()
        closed[:-1] &= ~covered[1:] | (doc[1:] != doc[:-1])
        ranges: dict[int, list] = {}
        for a, b in zip(np.flatnonzero(opened).tolist(), (np.flatnonzero(closed) + 1).tolist()):
            ranges.setdefault(int(doc[a]), []).append((a - int(first[doc[a]]), b - int(first[doc[a]])))
        pairs = np.unique(doc[place] * len(items.reps) + window)
        owner, held = np.divmod(pairs, len(items.reps))
        # texts with the same windows have the same items
        ids_of: dict[bytes, list[str]] = {}
        texts, cut = np.unique(owner, return_index=True)
        best = longest_matches(items, words, doc, end, window, place)
        for d, own, length, start, item in zip(texts.tolist(), np.split(held, cut[1:]), *(x.tolist() for x in best)):
            ids = ids_of.get(own.tobytes())
            if ids is None:
                members = np.concatenate([items.members[items.edges[w]:items.edges[w + 1]] for w in own.tolist()])
                ids = ids_of[own.tobytes()] = sorted({items.ids[i] for i in np.unique(members).tolist()})
            result[d] = (result[d][0], ranges[d], ids, length, items.ids[item], start - int(first[d]))
    return result


_ROW = pa.struct([("n_words", pa.int64()), ("hits", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                  ("items", pa.list_(pa.string())), ("longest", pa.int64()), ("longest_item", pa.string()),
                  ("longest_start", pa.int64())])
_SCHEMA = ("n_words bigint, hits array<struct<start:bigint,end:bigint>>, items array<string>, longest bigint, "
           "longest_item string, longest_start bigint")


def _batch_hits(items: TestItems, batch: pa.RecordBatch, text: str) -> list[tuple]:
    data, offsets = documents_of(batch, text)
    rows = []
    for low, high in chunks(offsets):
        rows += shard_hits(items, data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low])
    return rows


def item_blocks(items: DataFrame, item_id: str, item_text: str, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[str, str]]]:
    """The test items in lists of bounded size."""
    table = items.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).alias("text"))
    table = table.filter(F.col("id").isNotNull() & F.col("text").isNotNull())
    total = table.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for b in range(n):
        rows = table.filter(F.pmod(F.xxhash64("id"), F.lit(n)) == b).collect() if n > 1 else table.collect()
        yield sorted((row["id"], row["text"]) for row in rows)


def find(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_id: str = "item_id",
         item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row: (key, n_words, hits, items, longest, longest_item, longest_start).

    ``hits`` are the word ranges inside occurring windows, ``items`` the ids with such windows, ``longest`` the words of the
    longest verbatim match of at least a window, with its item and first word; of equally long ones the first in the document,
    then the smallest id. With several blocks of items the rows are put together
    by a row number of their own, so repeated keys stay apart.
    """
    context = docs.sparkSession.sparkContext
    blocks = list(item_blocks(items, item_id, item_text, block_bytes))
    kind = docs.schema[key].dataType.simpleString()
    if len(blocks) == 1:
        return _one_block(docs.select(key, text), context.broadcast(pickle.dumps(TestItems.of(blocks[0], window))), key, text,
                          f"`{key}` {kind}, {_SCHEMA}")
    from ..session import cut_lineage

    numbered = cut_lineage(docs.select(F.monotonically_increasing_id().alias("_row"), F.col(key).alias("_key"),
                                       F.col(text).alias("_text")))
    parts = None
    for rows in blocks:
        shared = context.broadcast(pickle.dumps(TestItems.of(rows, window)))
        part = _one_block(numbered.select("_row", "_text"), shared, "_row", "_text", f"_row bigint, {_SCHEMA}")
        parts = part if parts is None else parts.unionByName(part)
    best = F.min(F.struct((-F.col("longest")).alias("shorter"), "longest_start", "longest_item", "longest"))
    merged = parts.groupBy("_row").agg(
        F.max("n_words").alias("n_words"), F.flatten(F.collect_list("hits")).alias("_hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), best.alias("_best"))
    joined = numbered.select("_row", F.col("_key").alias(key)).join(merged, "_row")
    return joined.select(key, "n_words", merge_ranges(F.col("_hits")).alias("hits"), "items", "_best.longest",
                         "_best.longest_item", "_best.longest_start")


def merge_ranges(ranges):
    """Overlapping or touching [start, end) ranges made one, in order."""
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def add(out, r):
        last = F.element_at(out, -1)
        grown = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(
            last["start"].alias("start"), F.greatest(last["end"], r["end"]).alias("end"))))
        return F.when((F.size(out) > 0) & (F.get(out, F.size(out) - 1)["end"] >= r["start"]), grown).otherwise(
            F.concat(out, F.array(r)))

    return F.aggregate(F.array_sort(ranges), empty, add)


def _one_block(docs: DataFrame, shared, key: str, text: str, schema: str) -> DataFrame:
    def searched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = pickle.loads(shared.value)
        names = [f.name for f in _ROW]
        for batch in batches:
            rows = pa.array([dict(zip(names, (n, [{"start": a, "end": b} for a, b in spans], *rest)))
                             for n, spans, *rest in _batch_hits(items, batch, text)], _ROW)
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.names.index(key)), *rows.flatten()], [key, *names])

    return docs.select(key, text).mapInArrow(searched, schema)


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
          window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, in which no window of a test item occurs; one pass per block of items."""
    context = docs.sparkSession.sparkContext
    for rows in item_blocks(items, item_id, item_text, block_bytes):
        shared = context.broadcast(pickle.dumps(TestItems.of(rows, window)))

        def kept(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = pickle.loads(shared.value)
            for batch in batches:
                yield batch.filter(pa.array([not spans for _, spans, *_ in _batch_hits(items, batch, text)], pa.bool_()))

        docs = docs.mapInArrow(kept, docs.schema)
    return docs


_SQL_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
ORACLE = f"""
WITH texts AS (SELECT doc_id, {_SQL_WORDS} AS ws FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item_id, ws, least(10, len(ws)) AS k
          FROM (SELECT item_id, {_SQL_WORDS} AS ws FROM benchmark) WHERE len(ws) > 0 AND item_id IS NOT NULL),
item_windows AS (SELECT item_id, k, s, array_to_string(ws[s:s + k - 1], ' ') AS w FROM (SELECT *, unnest(range(1, len(ws) - k + 2)) AS s FROM items)),
text_windows AS (SELECT doc_id, k, p, array_to_string(ws[p:p + k - 1], ' ') AS w
                 FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM texts, (SELECT DISTINCT k FROM items))),
met AS (SELECT doc_id, item_id, k, p, s FROM text_windows JOIN item_windows USING (k, w)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS p FROM met) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM met) GROUP BY doc_id),
runs AS (SELECT doc_id, item_id, k, p - s AS diagonal, min(p) AS p, count(*) + k - 1 AS length
         FROM (SELECT *, p - row_number() OVER (PARTITION BY doc_id, item_id, p - s ORDER BY p) AS island FROM met) GROUP BY doc_id, item_id, k, diagonal, island),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, p, item_id) AS rk FROM runs) WHERE rk = 1)
SELECT t.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       n_hit IS NOT NULL AS contaminated, coalesce(length, 0) AS longest, b.item_id AS longest_item, coalesce(b.p - 1, -1) AS longest_start
FROM texts t LEFT JOIN hits h ON h.doc_id = t.doc_id LEFT JOIN found f ON f.doc_id = t.doc_id LEFT JOIN best b ON b.doc_id = t.doc_id"""
