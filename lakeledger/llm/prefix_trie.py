"""The prefix trie of rebuilt conversations, by ROLLUP over columns of turn ids.

A rebuilt conversation is the first h turns of another one (``h`` below 9, by a hash of its id) and its own turns after its first h. The turns
of a rebuilt conversation stand in blocks of ``BLOCK`` columns, a row per conversation and block, so a long conversation goes on in
further rows. A row knows the node its block starts from: the prior node, a content hash of all turns before. Grouping by (block,
prior node, ROLLUP over the columns) aggregates every prefix of every conversation at once; ``grouping_id`` says how long
the prefix is. Null columns, where a conversation has ended, are no prefixes.

Two passes of it: the first finds the smallest member of every node, its owner. Below its first own node a conversation owns all its nodes,
so what subtrees hold (leaves, bytes of distinct nodes) are sums over members of what they own, which the second pass adds up.
No pair of a node and an ancestor is ever made; the work grows with turns, whatever the depth.

Definitions: a turn's id is an MD5 of role and text with the text's bytes, so equal turns are one. Equal positions are ordered by that id; rows repeated
in a conversation are turns of their own. Null roles and texts are empty. Rows without a conversation id belong to none and are left
out. An empty table gives an empty result, not even a root. Only the four named columns are looked at. Ids are integers; h is
crc32 of the id as text, modulo 9, and the source of a prefix is id - id % 5 with the sign of Spark's remainder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage

BLOCK = 8
HEADS = 9             # a conversation borrows fewer turns than this
FAMILY = 5            # conversations that borrow from the same one
SLICE = 4096          # blocks of a conversation that one running sum goes through
PIECE_BYTES = 1 << 16


def _turn_id(role: Column, text: Column) -> Column:
    """MD5 over the length of the role, the role and the text; the bytes of the text follow after a colon."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.concat_ws(":", F.md5(F.concat_ws(":", F.length(role).cast("string"), role, text).cast("binary")),
                       F.octet_length(text).cast("string"))


def _bytes(turn: Column) -> Column:
    return F.coalesce(F.element_at(F.split(turn, ":"), 2).cast("bigint"), F.lit(0).cast("bigint"))


def _places(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows with their place in the conversation, counted from where the conversation starts in this partition."""
    last, reached = None, 0
    for batch in batches:
        conv = np.asarray(batch.column(0))
        if not len(conv):
            continue
        new = np.ones(len(conv), bool)
        new[1:] = conv[1:] != conv[:-1]
        start = np.maximum.accumulate(np.where(new, np.arange(len(conv)), 0))
        place = np.arange(len(conv)) - start + 1
        if conv[0] == last:
            place[start == 0] += reached
        last, reached = conv[-1], int(place[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], [*batch.schema.names, "place"])


def numbered_turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn_id, pos): every turn's position from 1. Conversations of any length: they are sorted by ranges, and one that crosses
    partitions is put together from their counts. Only ids go through the shuffle."""
    turns = conversations.filter(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("bigint").alias("conv_id"), F.col(turn).alias("_turn"), _turn_id(F.col(role), F.col(text)).alias("turn_id"))
    order = ["conv_id", "_turn", "turn_id"]
    ranged = turns.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn_id").mapInArrow(
        _places, "conv_id bigint, turn_id string, place bigint")
    placed = cut_lineage(ranged.withColumn("part", F.spark_partition_id()))
    # only the first conversation of a partition can have begun in an earlier one: a row per partition and edge
    edges = placed.groupBy("part").agg(F.min("conv_id").alias("low"), F.max("conv_id").alias("high"))
    ends = edges.select("part", F.explode(F.array_distinct(F.array("low", "high"))).alias("conv_id"))
    sizes = placed.join(F.broadcast(ends), ["part", "conv_id"]).groupBy("conv_id", "part").agg(F.max("place").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    carry = sizes.select("conv_id", "part", before.alias("before")).filter("before IS NOT NULL")
    joined = placed.join(F.broadcast(carry), ["conv_id", "part"], "left")
    return joined.select("conv_id", "turn_id", (F.col("place") + F.coalesce("before", F.lit(0))).alias("pos"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, turn_id, pos, n): the turns of the rebuilt conversations; ``n`` is how many there are. One without turns has a row of position 0."""
    turns = cut_lineage(turns)
    heads = turns.filter((F.col("conv_id") % FAMILY == 0) & (F.col("pos") < HEADS)).select(
        F.col("conv_id").alias("base"), "pos", "turn_id")
    borrowed = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    lengths = turns.groupBy("conv_id").agg(F.max("pos").alias("own"))
    base_length = heads.groupBy("base").agg(F.max("pos").alias("has"))
    convs = lengths.withColumn("h", borrowed).withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).join(base_length, "base", "left")
    convs = convs.withColumn("taken", F.least("h", F.coalesce("has", F.lit(0))))
    convs = cut_lineage(convs.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n")))
    copied = convs.filter("taken > 0").join(heads, "base").filter("pos <= taken").select("conv_id", "turn_id", "pos", "n")
    # both sides are plain tables: AQE splits a conversation with very many turns
    own = turns.join(convs.select("conv_id", "h", "taken", "n"), "conv_id").filter("pos > h").select(
        "conv_id", "turn_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "n")
    none = convs.filter("n = 0").select("conv_id", F.lit(None).cast("string").alias("turn_id"), F.lit(0).cast("bigint").alias("pos"), "n")
    return copied.unionByName(own).unionByName(none)


def _mark(pos: Column, turn: Column, seed: int) -> Column:
    """What a turn adds to the content hash of the prefixes that hold it."""
    return F.xxhash64(F.lit(seed), pos, turn).cast("decimal(38,0)")


def blocks_of(turns: DataFrame, width: int = BLOCK) -> DataFrame:
    """(conv_id, n, total, block, t1..tw, prior, prior_bytes): a row per conversation and block of ``width`` turns.

    ``prior`` is the content hash of the turns of the blocks before (two sums of 64-bit hashes of position and turn), ``prior_bytes`` their
    bytes. Running sums go through slices of ``SLICE`` blocks, whose own sums are added up apart.
    """
    at = F.greatest(F.col("pos") - 1, F.lit(0))
    slots = [F.max(F.when((F.col("pos") > 0) & (F.pmod(at, F.lit(width)) == i), F.col("turn_id"))).alias(f"t{i + 1}") for i in range(width)]
    wide = turns.groupBy("conv_id", F.floor(at / width).alias("block")).agg(
        F.max("n").alias("n"), F.sum(_bytes(F.col("turn_id"))).alias("bytes"),
        *[F.sum(F.when(F.col("pos") > 0, _mark(F.col("pos"), F.col("turn_id"), s))).alias(f"s{s}") for s in (1, 2)], *slots)
    wide = cut_lineage(wide.withColumn("slice", F.floor(F.col("block") / SLICE)))
    sums = ("bytes", "s1", "s2")
    running = Window.partitionBy("conv_id", "slice").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = {"bytes": F.lit(0).cast("bigint"), "s1": F.lit(0).cast("decimal(38,0)"), "s2": F.lit(0).cast("decimal(38,0)")}
    within = wide.select("*", *[F.coalesce(F.sum(c).over(running), zero[c]).alias(f"_in_{c}") for c in sums])
    slices = wide.groupBy("conv_id", "slice").agg(*[F.sum(c).alias(c) for c in sums])
    earlier = Window.partitionBy("conv_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv_id")
    slices = cut_lineage(slices.select("conv_id", "slice", F.sum("bytes").over(whole).alias("total"),
                                       *[F.coalesce(F.sum(c).over(earlier), zero[c]).alias(f"_to_{c}") for c in sums]))
    joined = within.join(slices, ["conv_id", "slice"])
    prior = [(F.col(f"_in_{c}") + F.col(f"_to_{c}")).cast("decimal(38,0)").alias(c) for c in ("s1", "s2")]
    return joined.select("conv_id", "n", "total", "block", *[f"t{i + 1}" for i in range(width)], F.struct(*prior).alias("prior"),
                         (F.col("_in_bytes") + F.col("_to_bytes")).alias("prior_bytes"))


def _key(depth: Column, s1: Column, s2: Column) -> Column:
    return F.struct(depth.cast("bigint").alias("depth"), s1.cast("decimal(38,0)").alias("s1"), s2.cast("decimal(38,0)").alias("s2"))


def prefixes(blocks: DataFrame, aggregates: dict[str, str], width: int = BLOCK) -> DataFrame:
    """(node, parent, depth, bytes, before, aggregates): all prefixes of all conversations by one ROLLUP.

    ``bytes`` are those of the prefix's last text, ``before`` those of all texts ahead of it. The root is the rollup of no column in the first block.
    """
    names = [f"t{i + 1}" for i in range(width)]
    spark = blocks.sparkSession
    asked = ", ".join(f"{sql} AS {name}" for name, sql in aggregates.items())
    rolled = spark.sql(f"""SELECT block, prior, prior_bytes, {", ".join(names)}, grouping_id() AS gid, {asked}
        FROM {{blocks}} GROUP BY block, prior, prior_bytes, ROLLUP ({", ".join(names)})""", blocks=blocks)
    # of w columns a prefix of j has the lowest w - j bits set
    length = F.lit(width) - F.round(F.log2(F.col("gid").cast("double") + 1)).cast("int")
    rolled = rolled.withColumn("length", length)
    last = F.get(F.array(*names), F.col("length") - 1)
    rolled = rolled.filter(((F.col("length") > 0) & last.isNotNull()) | ((F.col("length") == 0) & (F.col("block") == 0)))
    depth = F.col("block") * width + F.col("length")

    def upto(places: int, seed: int) -> Column:
        """Content hash after all columns but the last ``places`` that the prefix has."""
        value = F.col(f"prior.s{seed}")
        for i, name in enumerate(names):
            inside = F.lit(i) < F.col("length") - places
            mark = _mark(F.col("block") * width + i + 1, F.col(name), seed)
            value = (value + F.when(inside, mark).otherwise(F.lit(0).cast("decimal(38,0)"))).cast("decimal(38,0)")
        return value

    ahead = F.col("prior_bytes")
    for i, name in enumerate(names):
        ahead = ahead + F.when(F.lit(i) < F.col("length") - 1, _bytes(F.col(name))).otherwise(F.lit(0))
    return rolled.select(
        _key(depth, upto(0, 1), upto(0, 2)).alias("node"),
        F.when(depth > 0, _key(depth - 1, upto(1, 1), upto(1, 2))).alias("parent"),
        depth.cast("bigint").alias("depth"), _bytes(last).alias("bytes"), ahead.alias("before"), *aggregates)


def ends_digest(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) for (node, conv_id) rows: digest of the ids, ascending and comma-joined.

    A node where very many conversations end is sorted in ranges, whose tasks join their ids to pieces; one task then only reads the
    node's pieces, in order, and holds none.
    """
    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, conv = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows: list[tuple[str, int, list[str]]] = []
            size = 0
            for k, c in zip(node, conv):
                if not rows or rows[-1][0] != k or size > PIECE_BYTES:
                    rows.append((k, c, []))
                    size = 0
                rows[-1][2].append(str(c))
                size += len(rows[-1][2][-1]) + 1
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()),
                                              pa.array([",".join(r[2]) for r in rows], pa.string())], ["node", "first", "piece"])

    def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, sha = None, None
        for batch in batches:
            done: list[tuple[str, str]] = []
            for k, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k == current:
                    sha.update(b"," + piece.encode())
                    continue
                if sha is not None:
                    done.append((current, sha.hexdigest()))
                current, sha = k, hashlib.sha256(piece.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.string())],
                                             ["node", "ends_sha256"])
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([current]), pa.array([sha.hexdigest()])], ["node", "ends_sha256"])

    ranged = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").select("node", "conv_id")
    joined = ranged.mapInArrow(pieces, "node string, first bigint, piece string")
    return joined.repartition("node").sortWithinPartitions("node", "first").select("node", "piece").mapInArrow(
        digests, "node string, ends_sha256 string")


def _name(node: str | Column) -> Column:
    """A node as one string, for exchanges."""
    node = F.col(node) if isinstance(node, str) else node
    return F.concat_ws(":", node["depth"].cast("string"), node["s1"].cast("string"), node["s2"].cast("string"))


def trie(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
         width: int = BLOCK) -> DataFrame:
    """A row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    blocks = cut_lineage(blocks_of(rebuilt(numbered_turns(conversations, conv_id, turn, role, text)), width))
    first = prefixes(blocks, {"conv_id": "min(conv_id)"}, width)
    first = cut_lineage(first.select(_name("node").alias("node"), _name("parent").alias("parent"), "depth", "bytes", "conv_id"))
    # a node is childless if it is nobody's parent
    children = cut_lineage(first.filter("depth > 0").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children")))
    owned = first.join(children, "node", "left").groupBy("conv_id").agg(
        F.sum("bytes").alias("owned"), F.count_if(F.col("n_children").isNull()).alias("leaves"))
    owned = cut_lineage(owned)
    marked = blocks.join(owned, "conv_id", "left").withColumn("owned", F.coalesce("owned", F.lit(0))).withColumn(
        "leaves", F.coalesce("leaves", F.lit(0)))
    second = prefixes(marked, {
        "n_convs": "count(*)", "totals": "sum(total)", "owned": "sum(owned)", "n_leaves": "sum(leaves)",
        "owner": "min(struct(conv_id, total, owned))"}, width)
    all_bytes = F.col("totals") - F.col("n_convs") * F.col("before")
    distinct_bytes = F.col("owned") - F.col("owner.owned") + F.col("owner.total") - F.col("before")
    nodes = cut_lineage(second.select(
        _name("node").alias("node"), _name("parent").alias("parent"), "depth", F.col("owner.conv_id").alias("conv_id"), "n_convs", "n_leaves",
        (all_bytes - distinct_bytes).alias("saved_tokens")))
    # where conversations end: the last block's full content
    here = F.col("n") - F.col("block") * width
    last = blocks.filter((here >= 1) & (here <= width) | (F.col("n") == 0))
    hashes = []
    for seed in (1, 2):
        value = F.col(f"prior.s{seed}")
        for i in range(width):
            mark = _mark(F.col("block") * width + i + 1, F.col(f"t{i + 1}"), seed)
            value = (value + F.when(F.col(f"t{i + 1}").isNotNull(), mark).otherwise(F.lit(0).cast("decimal(38,0)"))).cast("decimal(38,0)")
        hashes.append(value)
    ends = last.select(_name(_key(F.col("n"), *hashes)).alias("node"), "conv_id")
    digests = cut_lineage(ends_digest(ends))
    parents = first.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    none = hashlib.sha256(b"").hexdigest()
    return (nodes.join(parents, "parent", "left").join(children, "node", "left").join(digests, "node", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("bigint").alias("n_children"),
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256")))


def _crc32_sql(text: str) -> str:
    """crc32 of an ASCII string in DuckDB: bytes are folded in, each followed by eight shifts (-1)."""
    steps = f"list_concat([4294967295], flatten(list_transform(string_split({text}, ''), lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1])))"
    fold = "CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END) END"
    return f"xor(list_reduce(list_transform({steps}, lambda v: v::BIGINT), lambda a, x: {fold}), 4294967295)"


ORACLE = f"""
WITH turns AS (SELECT conv_id, octet_length(encode(coalesce(text, ''))) AS b,
    md5(concat_ws(':', length(coalesce(role, '')), coalesce(role, ''), coalesce(text, ''))) || ':' || octet_length(encode(coalesce(text, ''))) AS t, turn
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(t ORDER BY turn NULLS FIRST, t) AS ts FROM turns GROUP BY conv_id),
borrowed AS (SELECT conv_id, ts, conv_id - conv_id % 5 AS base, {_crc32_sql('CAST(conv_id AS VARCHAR)')} % 9 AS h FROM own),
seqs AS (SELECT c.conv_id, list_concat(coalesce(b.ts[1:c.h], []), c.ts[c.h + 1:]) AS ts FROM borrowed c LEFT JOIN own b ON b.conv_id = c.base),
members AS (SELECT conv_id, unnest(range(len(ts) + 1)) AS depth, ts FROM seqs),
nodes AS (SELECT depth, ts[1:depth] AS path, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CASE WHEN len(ts) = depth THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM members GROUP BY ALL),
childless AS (SELECT path, depth, conv_id, n_convs, ends_sha256, coalesce(n, 0) AS n_children,
    CASE WHEN depth = 0 THEN 0 ELSE CAST(string_split(path[depth], ':')[2] AS BIGINT) END AS b
  FROM nodes LEFT JOIN (SELECT depth - 1 AS depth, path[1:depth - 1] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL) USING (depth, path)),
above AS (SELECT path[1:d] AS path, d AS depth, sum((n_convs - 1) * b) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
  FROM (SELECT *, unnest(range(depth + 1)) AS d FROM childless) GROUP BY ALL)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, a.n_leaves, CAST(a.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM childless n JOIN above a USING (depth, path) LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.path = n.path[1:n.depth - 1]"""
