"""Byte-level BPE: encoding with a hierarchical-bitmap rank queue, decoding by table.

The queue has a bucket per merge rank that holds positions of a linked list of tokens. Two levels of 256-bit
words say which buckets have entries; find-first-set picks the lowest rank. A merge leaves old entries behind,
which are recognised (the pair at that position has another rank now) and skipped. A pre-token of n bytes costs
O(n log n) however long it is.

The pre-tokens of about ``GROUP_BYTES`` of text share one linked list and one queue, so that a bucket is merged at once for all
of them. Pre-tokens do not touch, and each sees its own ranks in ascending order, as if it were alone.

Null and empty texts have no tokens; the rows of a repeated document are encoded one by one. An empty table gives an empty one; columns other than key and text are not looked at, so
their names cannot clash.
"""

from __future__ import annotations

import base64
import itertools
from array import array
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .texts import buffer_of, byte_table, chunks

# Words that a Python worker remembers, in each of two generations: bounds its memory, never changes a result.
CACHE_ENTRIES = 350_000
CACHE_CHARS = 48            # longer ones are encoded anew each time
GROUP_BYTES = 4 << 20       # of texts encoded together; a longer text stands alone
FEW_BYTES = 8 << 10         # fewer of pre-tokens are merged one by one
_BITS = [1 << i for i in range(256)]
_HIGH = [i << 8 for i in range(256)]
_WHITE = [chr(c).encode() for c in range(0x3001) if chr(c).isspace()]
_WHITE_BYTE = byte_table(*((c[0], c[0]) for c in _WHITE if len(c) == 1))
_WHITE_WIDE = {n: np.array([int.from_bytes(c) for c in _WHITE if len(c) == n]) for n in (2, 3)}


class ByteBpe:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, rank_file: bytes, pattern: str):
        import regex

        pairs = (line.split() for line in rank_file.splitlines() if line)
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.longest = max(map(len, self.ranks))
        size = max(self.ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.pairs = [self.ranks.get(bytes((a, b)), -1) for a in range(256) for b in range(256)]
        # The rank queue: positions by rank, a bit per bucket with entries, a bit per word with such a bit.
        self.buckets: list[list[int]] = [[] for _ in range(size)]
        self.words = [0] * ((size >> 8) + 1)
        self.pieces = regex.compile(pattern).findall
        self.known = _Known()
        self._tables()

    def _tables(self) -> None:
        """What is looked up for many at once: bytes of tokens, tokens of single bytes and of their pairs, and what a token makes with others."""
        get, size = self.ranks.get, len(self.tokens)
        self.flat = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.sizes = np.fromiter(map(len, self.tokens), np.int64, size)
        self.single = np.array([get(bytes((a,)), -1) for a in range(256)], np.int32)
        self.byte_pairs = np.array(self.pairs, np.int32)
        made = [(left, right, rank) for token, rank in self.ranks.items() for i in range(1, len(token))
                if (left := get(token[:i])) is not None and (right := get(token[i:])) is not None]
        left, right, rank = np.array(made, np.int32).reshape(-1, 3).T
        self.after, self.before = _by(left, right, rank, size), _by(right, left, rank, size)
        # A merge into such a token may leave a pair of a lower rank, due before the next merge of the same rank.
        lower = np.zeros(size, bool)
        lower[left[rank < left]] = lower[right[rank < right]] = True
        self.lower = lower.tolist()

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        get, buckets, words, bits, longest = self.ranks.get, self.buckets, self.words, _BITS, self.longest
        known = get(piece)
        if known is not None:
            return [known]
        n, top = len(piece), 0
        following, before = list(range(1, n + 2)), list(range(-1, n))
        # rank of the token that this one and the next would make, -1 for none
        pair = list(map(self.pairs.__getitem__, map(int.__add__, map(_HIGH.__getitem__, piece), piece[1:])))
        pair.append(-1)
        for i, rank in enumerate(pair):
            if rank >= 0:
                bucket = buckets[rank]
                if not bucket:
                    word = rank >> 8
                    words[word] |= bits[rank & 255]
                    top |= bits[word]
                bucket.append(i)                          # ascending, and so a heap
        while top:
            word = (top & -top).bit_length() - 1
            mask = words[word]
            rank = word << 8 | (mask & -mask).bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket.pop()
                words[word] = mask = mask & (mask - 1)
                if not mask:
                    top &= top - 1
            if pair[i] != rank:                           # stale
                continue
            right = following[i]
            pair[right] = -1
            after = following[right]
            following[i] = after
            at = i
            if after < n:
                before[after] = i
                rank = get(piece[i:following[after]]) if following[after] - i <= longest else None
            else:
                rank = None
            while True:                                   # the pair from here, then the one before
                if rank is None:
                    pair[at] = -1
                else:
                    pair[at] = rank
                    bucket = buckets[rank]
                    if bucket:
                        heappush(bucket, at)
                    else:
                        bucket.append(at)
                        word = rank >> 8
                        words[word] |= bits[rank & 255]
                        top |= bits[word]
                left = before[i]
                if at != i or left < 0:
                    break
                at = left
                rank = get(piece[at:after]) if after - at <= longest else None
        ids, ranks, i = [], self.ranks, 0
        while i < n:
            ids.append(ranks[piece[i:following[i]]])
            i = following[i]
        return ids

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pre-tokens as little-endian uint32; none is empty or a token itself."""
        if sum(map(len, pieces)) < FEW_BYTES or self.single.min() < 0:
            return [array("I", self.merge(piece)).tobytes() for piece in pieces]
        words, buckets = self.words, self.buckets
        gaps = np.cumsum([0, *(len(piece) + 1 for piece in pieces)])     # before, between and after pre-tokens
        data = np.frombuffer(b"\0".join([b"", *pieces, b""]), np.uint8)
        n = len(data)
        token = self.single[data]
        token[gaps] = len(self.tokens)                    # no token
        codes = data[:-1].astype(np.uint16) << np.uint16(8) | data[1:]
        pair = np.append(self.byte_pairs[codes], np.int32(-1))
        pair[gaps] = pair[gaps[1:] - 1] = -1
        following, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        alive = np.ones(n, bool)
        alive[gaps] = False
        at = np.flatnonzero(pair >= 0).astype(np.int32)
        at = at[np.argsort(codes[at], kind="stable")]
        top = self._file(at, pair[at], 0)
        anew: set[int] = set()
        while top:
            word = (top & -top).bit_length() - 1
            mask = words[word]
            rank = word << 8 | (mask & -mask).bit_length() - 1
            words[word] = mask = mask & (mask - 1)
            if not mask:
                top &= top - 1
            bucket = buckets[rank]
            at = np.concatenate(bucket)
            bucket.clear()
            at = at[pair[at] == rank]                     # others are stale
            if len(at) > 1:
                at.sort()
                at = at[np.append(True, at[1:] != at[:-1])]
            if not len(at):
                continue
            if self.lower[rank] and len(at) > 1:
                inside = np.searchsorted(gaps, at) - 1
                again = inside[1:] == inside[:-1]
                if again.any():
                    many = np.append(again, False) | np.append(False, again)
                    some = at[many]
                    early = self._early(rank, token[before[some]], token[following[following[some]]])
                    anew.update(inside[many][early].tolist())
            right = following[at]
            if len(at) > 1:
                shared = right[:-1] == at[1:]             # of overlapping pairs the first, third, ... are merged
                if shared.any():
                    order = np.arange(len(at))
                    begin = np.maximum.accumulate(np.where(np.append(True, ~shared), order, 0))
                    at = at[(order - begin) % 2 == 0]
                    right = following[at]
            after = following[right]
            following[at] = after
            before[after] = at
            alive[right] = False
            pair[right] = -1
            token[at] = rank
            positions, ranks = [], []
            left = before[at]
            for partners, ends, there in ((self.after, after, at), (self.before, left, left)):
                pair[there] = new = partners(rank, token[ends])
                hit = new >= 0
                positions.append(there[hit])
                ranks.append(new[hit])
            at, new = np.concatenate(positions), np.concatenate(ranks)
            order = np.argsort(new, kind="stable")
            top = self._file(at[order], new[order], top)
        ids = token[alive].astype("<u4").tobytes()
        ends = [0, *(4 * np.cumsum(alive)[gaps[1:]]).tolist()]
        found = [ids[low:high] for low, high in zip(ends, ends[1:])]
        for i in anew:
            found[i] = array("I", self.merge(pieces[i])).tobytes()
        return found

    def _early(self, rank: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether a merge into ``rank`` between these tokens leaves a pair that is due before the next of its rank."""
        twin = self.after(rank, np.array([rank]))
        found = np.stack([self.before(rank, left), self.after(rank, right), np.broadcast_to(twin, left.shape)])
        return ((found >= 0) & (found < rank)).any(axis=0)

    def _file(self, at: np.ndarray, ranks: np.ndarray, top: int) -> int:
        """Put positions, sorted by rank, into their buckets; returns the upper level of the bitmap."""
        if not len(at):
            return top
        buckets, words, bits = self.buckets, self.words, _BITS
        cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(at)]
        for low, high, rank in zip(cuts, cuts[1:], ranks[cuts[:-1]].tolist()):
            bucket = buckets[rank]
            if not bucket:
                word = rank >> 8
                words[word] |= bits[rank & 255]
                top |= bits[word]
            bucket.append(at[low:high])
        return top

    def stretches(self, texts: list[str]) -> list[bytes]:
        """Ids of stretches of text, pre-token by pre-token; each pre-token that occurs is merged once.

        Those that begin with a single space and do not end in white space may stand behind each other for the pattern.
        """
        chained = [text[:1] == " " and not text[1:2].isspace() and not text[-1].isspace() for text in texts]
        chain = list(itertools.compress(texts, chained))
        links = self.pieces("".join(chain))
        reach = np.cumsum(np.fromiter(map(len, links), np.int64, len(links)))
        ends = np.cumsum(np.fromiter(map(len, chain), np.int64, len(chain)))
        bounds = [0, *(np.searchsorted(reach, ends) + 1).tolist()]
        if chain and (reach[-1:].tolist() != ends[-1:].tolist() or (reach[np.array(bounds[1:]) - 1] != ends).any()):
            chained, links, bounds = [False] * len(texts), [], [0]        # a pattern that leaves characters out
        others = [self.pieces(text) for text, chains in zip(texts, chained) if not chains]

        ranks, ids, rest = self.ranks, {}, []
        for piece in dict.fromkeys(itertools.chain(links, *others)):
            rank = ranks.get(piece.encode("utf-8", "replace"))
            if rank is None:
                rest.append(piece)
            else:
                ids[piece] = rank.to_bytes(4, "little")
        ids.update(zip(rest, self.merge_all([piece.encode("utf-8", "replace") for piece in rest])))
        coded = list(map(ids.__getitem__, links))
        in_chain = (b"".join(coded[low:high]) for low, high in zip(bounds, bounds[1:]))
        alone = (b"".join(map(ids.__getitem__, pieces)) for pieces in others)
        return [next(in_chain if chains else alone) for chains in chained]

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian uint32."""
        return self.encode_column(pa.array([(text or "").encode("utf-8", "replace")]))[0].as_py()

    def encode_column(self, texts: pa.Array) -> pa.Array:
        """Ids of every text of a column as little-endian uint32."""
        data, offsets = buffer_of(texts)
        ids, counts = [], []
        for low, high in chunks(offsets, GROUP_BYTES):
            found, n = self._encode_group(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low])
            ids.append(found)
            counts.append(n)
        return _binary(np.concatenate(ids) if ids else np.zeros(0, "<u4"), 4 * np.concatenate(counts) if counts else [])

    def _encode_group(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, their number in each).

        A single space between two characters that are no white space always begins a pre-token, so the
        stretches between such spaces are looked up as a whole before they are taken apart.
        """
        begins = np.zeros(len(data) + 1, bool)
        begins[_single_spaces(data, offsets)] = True
        begins[offsets] = True
        starts = np.flatnonzero(begins)                   # the last one is the end
        words = pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), pa.py_buffer(data))
        words = words.dictionary_encode()
        codes, words = words.indices.to_numpy(), words.dictionary.to_pylist()
        ids, new = self.known.find(words)
        made = dict(zip(new, self.stretches(new)))
        self.known.keep(made)
        ids.update(made)
        coded = list(map(ids.__getitem__, words))
        sizes = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        return _picked(np.frombuffer(b"".join(coded), "<u4"), sizes, codes, np.searchsorted(starts, offsets))

    def decode(self, ids: bytes) -> bytes:
        return self.decode_column(pa.array([ids], pa.binary()))[0].as_py()

    def decode_column(self, ids: pa.Array) -> pa.Array:
        """The bytes that the ids stand for."""
        data, offsets = buffer_of(ids)
        codes = np.frombuffer(data.tobytes(), "<u4")
        offsets = offsets // 4
        found = [_picked(self.flat, self.sizes, codes[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low])
                 for low, high in chunks(offsets, GROUP_BYTES // 4)]
        parts, counts = zip(*found) if found else ((np.zeros(0, np.uint8),), ([],))
        return _binary(np.concatenate(parts), np.concatenate(counts))


class _Known:
    """Ids of stretches of text with the space before them, for stretches seen lately.

    Two generations: when one is full it becomes the old one, and what is asked for again moves on from there.
    """

    def __init__(self):
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def find(self, words: Iterable[str]) -> tuple[dict[str, bytes], list[str]]:
        """The ids of the words that are known, and the other words."""
        ids, aged, new, young, old = {}, {}, [], self.young, self.old
        for word in words:
            if (known := young.get(word)) is not None:
                ids[word] = known
            elif (known := old.get(word)) is not None:
                ids[word] = aged[word] = known
            else:
                new.append(word)
        self.keep(aged)
        return ids, new

    def keep(self, made: dict[str, bytes]) -> None:
        for word, ids in made.items():
            if len(word) <= CACHE_CHARS and "\n" not in word:
                if len(self.young) >= CACHE_ENTRIES:
                    self.old, self.young = self.young, {}
                self.young[word] = ids


def _white(data: np.ndarray, at: np.ndarray, before: bool) -> np.ndarray:
    """Whether the character before or behind each place in UTF-8 is white space."""
    near = at - 1 if before else at + 1
    white = _WHITE_BYTE[data[near]]
    wide = np.flatnonzero(data[near] >= 0x80)
    for n, codes in _WHITE_WIDE.items():
        first = at[wide] - n if before else at[wide] + 1
        value = np.zeros(len(wide), np.int64)
        for i in range(n):
            value = value << 8 | data.take(first + i, mode="clip")
        white[wide] |= np.isin(value, codes)
    return white


def _single_spaces(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places of the spaces between two characters of one text that are no white space."""
    inner = data == 0x20
    some = offsets[offsets < len(data)]
    inner[some] = False                                   # the first byte of a text
    inner[offsets[offsets > 0] - 1] = False               # and the last
    at = np.flatnonzero(inner)
    return at[~(_white(data, at, True) | _white(data, at, False))]


def _picked(flat: np.ndarray, sizes: np.ndarray, codes: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of the items that the codes name, one after the other, and their number between any two edges in the codes.

    Item i has sizes[i] of the values.
    """
    first = np.cumsum(sizes) - sizes
    lengths = sizes[codes]
    ends = np.append(0, np.cumsum(lengths))
    values = flat[np.repeat(first[codes] - ends[:-1], lengths) + np.arange(ends[-1])]
    return values, np.diff(ends[edges])


def _binary(values: np.ndarray, sizes) -> pa.Array:
    """A binary column of the bytes of the values; value i takes sizes[i] bytes."""
    offsets = np.append(0, np.cumsum(sizes)).astype(np.int64)
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values)])
    return column.cast(pa.binary())


def _by(one: np.ndarray, other: np.ndarray, made: np.ndarray, size: int):
    """A function from a token and others to what it makes with each of them, -1 for nothing."""
    order = np.lexsort((other, one))
    other, made = other[order], made[order]
    edges = np.searchsorted(one[order], np.arange(size + 1)).tolist()

    def find(token: int, others: np.ndarray) -> np.ndarray:
        low, high = edges[token], edges[token + 1]
        if low == high:
            return np.full(len(others), -1, np.int32)
        k = other[low:high].searchsorted(others)
        found = made[low:high].take(k, mode="clip")
        found[other[low:high].take(k, mode="clip") != others] = -1
        return found

    return find


_READY: dict[int, ByteBpe] = {}


def _encoder(shared, pattern: str) -> ByteBpe:
    """One encoder per Python worker and vocabulary."""
    key = hash((shared.value, pattern))
    if key not in _READY:
        _READY.clear()
        _READY[key] = ByteBpe(shared.value, pattern)
    return _READY[key]


def _encoded(batches: Iterable[pa.RecordBatch], shared, pattern: str, key: str, text: str) -> Iterator[pa.RecordBatch]:
    encoder = _encoder(shared, pattern)
    for batch in batches:
        names = batch.schema.names
        ids = encoder.encode_column(batch.column(names.index(text)))
        counts = pc.divide(pc.binary_length(ids), 4).cast(pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(names.index(key)), counts, ids],
                                         [key, "n_tokens", "ids"])


def _decoded(batches: Iterable[pa.RecordBatch], shared, pattern: str) -> Iterator[pa.RecordBatch]:
    encoder = _encoder(shared, pattern)
    for batch in batches:
        ids = batch.column(batch.schema.names.index("ids"))
        data = pc.if_else(ids.is_valid(), encoder.decode_column(ids), None)
        yield pa.RecordBatch.from_arrays([*batch.columns, data], [*batch.schema.names, "decoded"])


def _share(spark: SparkSession, rank_path: str):
    with open(rank_path, "rb") as file:          # a vocabulary of fixed size, read by the driver
        return spark.sparkContext.broadcast(file.read())


def _type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def encode(docs: DataFrame, rank_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids): the ids of every whole text as little-endian 32-bit integers in one binary value."""
    shared = _share(docs.sparkSession, rank_path)
    return docs.select(key, text).mapInArrow(
        lambda batches: _encoded(batches, shared, pattern, key, text),
        f"`{key}` {_type(docs, key)}, n_tokens bigint, ids binary")


def decode(encoded: DataFrame, rank_path: str, pattern: str = "") -> DataFrame:
    """Adds ``decoded``, the bytes that the ids stand for; null ids give null."""
    shared = _share(encoded.sparkSession, rank_path)
    kept = encoded.drop("decoded")
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(lambda batches: _decoded(batches, shared, pattern), f"{types}, decoded binary")


def round_trip(docs: DataFrame, rank_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encoding and decoding in one Python worker: (key, n_tokens, ids, decoded)."""
    shared = _share(docs.sparkSession, rank_path)
    return docs.select(key, text).mapInArrow(
        lambda batches: _decoded(_encoded(batches, shared, pattern, key, text), shared, pattern),
        f"`{key}` {_type(docs, key)}, n_tokens bigint, ids binary, decoded binary")
