"""Texts of an Arrow batch as one byte buffer: chunks, words and hashes, all in numpy.

A null text counts as an empty one everywhere. Words never cross from one text into the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

BATCH_BYTES = "8m"
CHUNK_BYTES = 1 << 20       # of text that numpy works on at once: its temporaries take some hundred times as much
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_SEEDS = (np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344))


def modest_batches(spark: SparkSession) -> None:
    """Let Spark hand documents to Python in batches of ``BATCH_BYTES``: workers and Spark's buffers hold several at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def byte_table(*ranges: tuple[int, int]) -> np.ndarray:
    """256 booleans, true for the bytes in the given closed ranges."""
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low:high + 1] = True
    return table


BLANK = byte_table((0x09, 0x0D), (0x20, 0x20))
WORD = ~BLANK                                                        # [^\x20\x09-\x0D]
ALNUM = byte_table((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))         # after lower-casing A-Z
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; text i is bytes[offsets[i]:offsets[i + 1]]."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary())
    column = pc.fill_null(column, b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, 8 * column.offset)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``limit`` bytes; a longer text stands alone."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1
        high = min(max(high, low + 1), n)
        yield low, high
        low = high


def word_bounds(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): the words of all texts; those of text i are first[i]:first[i + 1]."""
    n = len(data)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    inside = table[data]
    cut = np.zeros(n + 1, bool)                       # a text begins here
    cut[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | cut[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | cut[1:n]
    starts = np.flatnonzero(starts)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


_POWERS: dict[int, np.ndarray] = {}


def powers(which: int, n: int) -> np.ndarray:
    """1, b, b^2, ... of the base, modulo 2^64."""
    have = _POWERS.get(which)
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK_BYTES), _BASES[which], np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        _POWERS[which] = have
    return have[:n]


def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


_INVERSES: dict[int, np.ndarray] = {}


def inverse_powers(which: int, n: int) -> np.ndarray:
    have = _INVERSES.get(which)
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK_BYTES), np.uint64(_inverse(int(_BASES[which]))), np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        _INVERSES[which] = have
    return have[:n]


def prefix_sums(values: np.ndarray, which: int = 0) -> np.ndarray:
    """What ``hash_sums`` hashes pieces from, for those who hash many of the same values."""
    n = len(values)
    if values.dtype == np.uint8:
        terms = mix(np.arange(1, 257, dtype=np.uint64) * _SEEDS[which])[values]
    else:
        terms = mix(values ^ _SEEDS[which])
    terms *= powers(which, n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(terms, out=sums[1:])
    return sums


def hash_sums(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    return mix((sums[ends] - sums[starts]) * inverse_powers(which, len(sums))[starts] + (ends - starts).astype(np.uint64))


def hash_spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hashes of values[starts:ends] by prefix sums of a polynomial; ``which`` picks one of two families.

    ``values`` are bytes or 64-bit word hashes. Each value is mixed first, so that the polynomial sees no structure.
    """
    if len(values) == 0 or len(starts) == 0:
        return np.zeros(len(starts), np.uint64)
    return hash_sums(prefix_sums(values, which), starts, ends, which)


def documents_of(batch: pa.RecordBatch, name: str = "text") -> tuple[np.ndarray, np.ndarray]:
    return buffer_of(batch.column(batch.schema.get_field_index(name)))
