"""N-gram Jaccard join by vertical partitioning.

A document's set are its distinct shingles, as 64-bit hashes. The global order of all shingles is cut into fragments and a
pair's overlap is the sum of what its fragments share.

1. Documents with equal sets are one class (size and 128-bit fingerprint of the set); only one document per class goes on.
2. The leading fragments of the hash order are grouped by shingle. A document linked to another has at most
   (100 - percent) % of its shingles to itself, so one with more unshared shingles than that in these
   fragments alone has no link and leaves.
3. The shingles of the rest are ordered by frequency, rarest first. Two linked documents share one among
   their first (100 - percent) % + 1 shingles, so candidates meet there.
4. Each candidate is first compared with one leader of its lists, the document with the fewest unshared shingles. Then
   all remaining candidate pairs of *different* components are compared: pairs within a component add nothing to
   the classes, all others are looked at, so no link that matters is lost and a group of n near copies costs about n pairs.
5. Overlaps are counted fragment by fragment and summed per pair.

Null texts, empty texts and texts without words have no set and are linked with nothing. Of rows that share a key the one with the
smallest set (then fingerprint) counts; the result has one row per key. Rows without a key are one document without a name: it joins
a class only by an equal set. The result is classes, not links. An empty table gives an empty one; other columns are not looked at, and
``keep_one`` carries them along. A very long text is a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.skew import join_by_key
from ..session import cut_lineage
from .blobs import from_planes, from_steps, planes, steps
from .components import connected
from .texts import LOWER, WORD, chunks, documents_of, hash_spans, mix, word_bounds

WORDS = 4
PERCENT = 85
FRAGMENTS = 8               # of the hash order, in which overlaps are counted
LEADING = 0.4               # share of the hash order that decides which documents stay
SIEVE_BITS = 23             # of the bitmap that keeps most other texts out of the shuffle: 1 MB


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer words than a shingle has make one shingle together."""
    data = LOWER[data]
    starts, ends, first = word_bounds(data, offsets, WORD)
    hashes = hash_spans(data, starts, ends)
    n = len(hashes)
    whole = np.zeros(max(n - words + 1, 0), np.uint64)
    for j in range(words):
        whole = mix(whole + hashes[j:j + len(whole)])
    for low, high in zip(first[:-1].tolist(), first[1:].tolist()):
        if high - low >= words:
            yield np.unique(whole[low:high - words + 1])
        elif high > low:
            key = np.uint64([high - low])
            for h in hashes[low:high]:
                key = mix(key + h)
            yield key
        else:
            yield np.zeros(0, np.uint64)


def _sets(batch: pa.RecordBatch, text: str, words: int) -> Iterator[np.ndarray]:
    data, offsets = documents_of(batch, text)
    for low, high in chunks(offsets):
        yield from shingle_sets(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low], words)


def _fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    return (int(mix(shingles).sum(dtype=np.uint64).view(np.int64)),
            int(np.bitwise_xor.reduce(mix(shingles ^ np.uint64(0x5851F42D4C957F2D))).view(np.int64)) if len(shingles) else 0)


def describe(docs: DataFrame, key: str, text: str, words: int, share: float) -> DataFrame:
    """(id, n, lo, hi, lead): size and fingerprint of each row's set, and its shingles in the leading fragments."""
    limit = np.uint64(int(share * 2**64))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(len(s), *_fingerprint(s), int(np.searchsorted(s, limit))) for s in _sets(batch, text, words)]
            columns = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.names.index(key)), *[pa.array(c, pa.int64()) for c in columns]],
                ["id", "n", "lo", "hi", "lead"])

    return docs.select(key, text).mapInArrow(
        run, f"id {docs.schema[key].dataType.simpleString()}, n bigint, lo bigint, hi bigint, lead bigint")


def shared_leading(docs: DataFrame, text: str, words: int, share: float, parts: int) -> DataFrame:
    """(lo, shared): shingles in the leading fragments that another set has too, for sets with any.

    A batch sends each fragment one row of sorted hashes and the sets that they belong to; a fragment holds about
    1 / ``parts`` of all leading shingles. The counts of a fragment leave it in ``parts`` rows, by fingerprint.
    """
    limit = int(share * 2**64)

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(_sets(batch, text, words))
            lead = [s[:np.searchsorted(s, np.uint64(limit))] for s in sets]
            owner = np.repeat(np.arange(len(sets), dtype=np.uint32), [len(s) for s in lead])
            hashes = np.concatenate([np.zeros(0, np.uint64), *lead])
            names = np.array([_fingerprint(s)[0] for s in sets], np.int64)
            order = np.argsort(hashes, kind="stable")
            hashes, owner = hashes[order], owner[order]
            edges = np.array([limit * p // parts for p in range(parts)] + [limit], np.uint64)
            cut = np.searchsorted(hashes, edges)
            rows = []
            for p in range(parts):
                h, o = hashes[cut[p]:cut[p + 1]], owner[cut[p]:cut[p + 1]]
                if not len(h):
                    continue
                used, o = np.unique(o, return_inverse=True)
                rows.append((p, steps(h, int(edges[p])), planes(o.astype(np.uint32)), planes(names[used])))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int32()), *[pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2, 3)]],
                    ["part", "steps", "owners", "names"])

    def count(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        hashes, owners = [], []
        for hashed, owner, names in zip(*(table.column(c).to_pylist() for c in ("steps", "owners", "names"))):
            hashes.append(from_steps(hashed, limit * part // parts))
            owners.append(from_planes(names, np.int64)[from_planes(owner, np.uint32)])
        hashes, owners = np.concatenate(hashes), np.concatenate(owners)
        order = np.lexsort((owners, hashes))
        hashes, owners = hashes[order], owners[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])      # once per set
        hashes, owners = hashes[new], owners[new]
        shared = np.zeros(len(hashes), bool)
        shared[1:] |= hashes[1:] == hashes[:-1]
        shared[:-1] |= hashes[:-1] == hashes[1:]
        lo, n = np.unique(owners[shared], return_counts=True)
        cut = np.searchsorted(lo, lows)
        rows = [(q, lo[a:b], n[a:b]) for q, (a, b) in enumerate(zip(cut, [*cut[1:], len(lo)])) if a < b]
        return pa.table({"range": pa.array([q for q, _, _ in rows], pa.int32()),
                         "lo": pa.array([planes(x) for _, x, _ in rows], pa.binary()),
                         "shared": pa.array([planes(x.astype(np.uint32)) for _, _, x in rows], pa.binary())})

    def total(table: pa.Table) -> pa.Table:
        lo = np.concatenate([from_planes(x, np.int64) for x in table.column("lo").to_pylist()])
        n = np.concatenate([from_planes(x, np.uint32) for x in table.column("shared").to_pylist()])
        lo, place = np.unique(lo, return_inverse=True)
        return pa.table({"lo": lo, "shared": np.bincount(place, n).astype(np.int64)})

    lows = np.array([(q << 64) // parts - (1 << 63) for q in range(parts)], np.int64)
    blobs = docs.select(text).mapInArrow(spread, "part int, steps binary, owners binary, names binary")
    counts = blobs.groupBy("part").applyInArrow(count, "range int, lo binary, shared binary")
    return counts.groupBy("range").applyInArrow(total, "lo bigint, shared bigint")


def sieve(rows: DataFrame, wanted: DataFrame, bits: int = SIEVE_BITS) -> DataFrame:
    """``rows`` without most of those whose ``id`` is not in ``wanted``: a bitmap of hashed ids, of ``2 ** bits`` bits in
    all whatever the number of ids, so it may be broadcast. What it lets through by chance an exact join must drop."""
    def place() -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(1 << bits))

    bitmaps = wanted.select(place().alias("_p")).groupBy(F.bitmap_bucket_number("_p").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_p")).alias("_bitmap"))
    met = rows.withColumn("_p", place()).withColumn("_bucket", F.bitmap_bucket_number("_p")).join(F.broadcast(bitmaps), "_bucket")
    position = F.bitmap_bit_position("_p")
    byte = F.conv(F.hex(F.substring("_bitmap", (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return met.filter(F.getbit(byte, (position % 8).cast("int")) == 1).drop("_p", "_bucket", "_bitmap")


def fragments_of(docs: DataFrame, stay: DataFrame, key: str, text: str, words: int, fragments: int) -> DataFrame:
    """(id, n, fragment, hashes) of the documents in ``stay`` (id, lo), once for each of their rows."""
    texts = sieve(docs.select(F.col(key).alias("id"), F.col(text).alias("_text")), stay)
    wanted = texts.join(stay.select("id", "lo"), "id")
    kind = stay.schema["id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array([(i << 64) // fragments for i in range(1, fragments)], np.uint64)
        for batch in batches:
            rows = []
            for i, lo, s in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), _sets(batch, "_text", words)):
                if len(s) and _fingerprint(s)[0] == lo:
                    for f, piece in enumerate(np.split(s, np.searchsorted(s, edges))):
                        if len(piece):
                            rows.append((i, len(s), f, piece.view(np.int64)))
            if rows:
                yield pa.RecordBatch.from_arrays([
                    pa.array([r[0] for r in rows], batch.schema.field(0).type), pa.array([r[1] for r in rows], pa.int64()),
                    pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.list_(pa.int64()))],
                    ["id", "n", "fragment", "hashes"])

    return wanted.mapInArrow(run, f"id {kind}, n bigint, fragment int, hashes array<bigint>")


def _reaches(shared: Column, a: Column, b: Column, percent: int) -> Column:
    """Whether an overlap of ``shared`` is enough for sets of sizes a and b."""
    return (100 + percent) * shared >= percent * (a + b)


def prefixes(pieces: DataFrame, percent: int) -> DataFrame:
    """(h, id, n, unshared, place): the first shingles of each set in the order of frequency, without unshared ones.

    Rows that repeat a document count in the frequencies, which only moves their shingles in the order.
    """
    each = pieces.select("id", F.explode("hashes").alias("h"))
    counts = each.groupBy("h").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    ordered = each.join(counts, "h").groupBy("id").agg(F.sort_array(F.collect_set(F.struct("df", "h"))).alias("shared"))
    ordered = ordered.join(pieces.select("id", "n").distinct(), "id")
    unshared = F.col("n") - F.size("shared")
    slack = F.floor(F.col("n") * (100 - percent) / F.lit(100)).cast("bigint")
    kept = ordered.withColumn("unshared", unshared).withColumn("length", slack + 1 - F.col("unshared")).filter("length > 0")
    first = F.slice("shared", F.lit(1), F.col("length").cast("int"))
    return kept.select("id", "n", "unshared", F.posexplode(first).alias("i", "s")).select(
        F.col("s.h").alias("h"), "id", "n", "unshared", (F.col("unshared") + F.col("i")).cast("bigint").alias("place"))


def overlaps(pairs: DataFrame, pieces: DataFrame) -> DataFrame:
    """(x, y, shared): per fragment what both sides have there, summed per pair."""
    one = pieces.select(F.col("id").alias("x"), "fragment", F.col("hashes").alias("_a"))
    two = pieces.select(F.col("id").alias("y"), "fragment", F.col("hashes").alias("_b"))
    partial = pairs.select("x", "y").join(one, "x").join(two, ["y", "fragment"]).select(
        "x", "y", "fragment", F.size(F.array_intersect("_a", "_b")).cast("bigint").alias("_n")).distinct()
    return partial.groupBy("x", "y").agg(F.sum("_n").alias("shared"))


def _linked(pairs: DataFrame, pieces: DataFrame, percent: int) -> DataFrame:
    found = pairs.join(overlaps(pairs, pieces), ["x", "y"])
    return found.filter(_reaches(F.col("shared"), F.col("nx"), F.col("ny"), percent)).select("x", "y")


def leader_pairs(first: DataFrame, percent: int) -> DataFrame:
    """(x, y, nx, ny): each document with the best leader of its lists that its size allows."""
    leaders = first.groupBy("h").agg(F.min(F.struct("unshared", "id", "n")).alias("l"))
    met = first.join(leaders, "h").filter(F.col("id") != F.col("l.id"))
    met = met.filter(_reaches(F.least("n", "l.n"), F.col("n"), F.col("l.n"), percent))
    best = met.groupBy("id", "n").agg(F.min("l").alias("l"))
    return best.select(F.col("id").alias("x"), F.col("l.id").alias("y"), F.col("n").alias("nx"), F.col("l.n").alias("ny"))


def open_pairs(first: DataFrame, components: DataFrame, percent: int) -> DataFrame:
    """(x, y, nx, ny): all candidate pairs of different components that the bounds leave.

    A list whose documents are all of one component has none. In the others every pair has a side outside the list's largest
    component, and only such documents are joined with the list.
    """
    labelled = first.join(components.withColumnRenamed("node", "id"), "id", "left")
    labelled = labelled.withColumn("component", F.coalesce("component", "id"))
    sizes = labelled.groupBy("h", "component").agg(F.count(F.lit(1)).alias("_c"))
    main = sizes.groupBy("h").agg(F.max_by("component", F.struct("_c", "component")).alias("main"),
                                  F.count(F.lit(1)).alias("_k")).filter("_k > 1")
    mixed = labelled.join(main.select("h", "main"), "h")
    a = mixed.filter("component <> main").select("h", *[F.col(c).alias(f"a_{c}") for c in ("id", "n", "unshared", "place", "component")])
    b = mixed.select("h", "main", *[F.col(c).alias(f"b_{c}") for c in ("id", "n", "unshared", "place", "component")])
    most = F.least(F.col("a_n") - F.greatest("a_place", "a_unshared"), F.col("b_n") - F.greatest("b_place", "b_unshared"))
    # of two documents outside the main component only one order is kept
    once = (F.col("b_component") == F.col("main")) | (F.col("a_id") < F.col("b_id"))
    met = a.join(b, "h").filter((F.col("a_component") != F.col("b_component")) & once
                                & _reaches(most, F.col("a_n"), F.col("b_n"), percent))
    return met.select(F.col("a_id").alias("x"), F.col("b_id").alias("y"), F.col("a_n").alias("nx"),
                      F.col("b_n").alias("ny")).distinct()


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT,
            fragments: int = FRAGMENTS, leading: float = LEADING) -> DataFrame:
    """(key, n_shingles, component_id): one row per key, the component named by its smallest key."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = describe(docs, key, text, words, leading).groupBy("id").agg(F.min(F.struct("n", "lo", "hi", "lead")).alias("s"))
    sets = cut_lineage(rows.select("id", "s.n", "s.lo", "s.hi", "s.lead"))
    heads = sets.filter("n > 0").groupBy("n", "lo", "hi").agg(
        F.min("id").alias("id"), F.first("lead").alias("lead"), F.count(F.lit(1)).alias("copies"))
    shared = shared_leading(docs, text, words, leading, parts)
    slack = F.floor(F.col("n") * (100 - percent) / F.lit(100))
    unshared = F.col("lead") - F.coalesce("shared", F.lit(0))
    stay = cut_lineage(heads.join(shared, "lo", "left").filter(unshared <= slack).select("id", "lo"))
    pieces = cut_lineage(fragments_of(docs, stay, key, text, words, fragments))
    first = cut_lineage(prefixes(pieces, percent))
    links = cut_lineage(_linked(leader_pairs(first, percent), pieces, percent))
    components = connected(links, "x", "y")
    more = _linked(cut_lineage(open_pairs(first, components, percent)), pieces, percent)
    components = connected(cut_lineage(links.unionByName(more)), "x", "y")
    named = heads.join(components.withColumnRenamed("node", "id"), "id", "left").select(
        "n", "lo", "hi", "copies", F.coalesce("component", "id").alias("component_id"))
    joined = join_by_key(sets, named, ["n", "lo", "hi"], "left", count="copies")
    return joined.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, of the smallest key of every class. Rows of one key stay or go together, so do those without."""
    name = "_keep"
    while name in docs.columns:
        name += "_"
    chosen = classes(docs, key, text, **options).filter(F.col("component_id").eqNullSafe(F.col(key))).select(F.col(key).alias(name))
    return docs.join(chosen, docs[key].eqNullSafe(chosen[name]), "left_semi")


ORACLE = r"""
WITH RECURSIVE texts AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                          '[^\x20\x09-\x0D]+') AS ws FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS s
             FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM texts WHERE len(ws) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM texts UNION SELECT r.doc_id, l.b FROM reach r JOIN both_ways l ON l.a = r.other)
SELECT t.doc_id, coalesce(n, 0) AS n_shingles, c.component_id FROM texts t
JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) c ON c.doc_id = t.doc_id LEFT JOIN sizes s ON s.doc_id = t.doc_id"""
