"""Number columns as bytes, and blocks of documents that two scans of the same table form alike.

Operators that count something over the whole corpus and need the answer back at the text work in blocks: a block is a
chunk of whole texts of about a megabyte, or one longer text. A first scan sends every shard of the hash space
one row per block; the shard answers each block in the order of what it was sent. A second scan forms the same blocks and meets the
answers there. Both scans read the same files in the same partitions and batches, so a block is known by its partition, its
number in it and a hash of its documents; a repeated task forms the same blocks again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext

from .texts import chunks, documents_of


def planes(values: np.ndarray) -> bytes:
    """All lowest bytes, then all second bytes, and so on: planes of zeros compress to nothing."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def from_planes(data: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def steps(values: np.ndarray, base: int) -> bytes:
    """Sorted unsigned integers as differences."""
    return planes(np.diff(values, prepend=values.dtype.type(base)))


def from_steps(data: bytes, base: int, dtype=np.uint64) -> np.ndarray:
    return np.cumsum(from_planes(data, dtype), dtype=dtype) + np.dtype(dtype).type(base)


def shard_edges(shards: int) -> np.ndarray:
    """Lower ends of equal ranges of the 64-bit hashes."""
    return np.array([(p << 64) // shards for p in range(shards)], np.uint64)


def blocks(batches: Iterable[pa.RecordBatch], text: str) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(block, its rows, bytes, offsets)."""
    context = TaskContext.get()
    partition, number = context.partitionId() if context else 0, 0
    for batch in batches:
        data, offsets = documents_of(batch, text)
        for low, high in chunks(offsets):
            own = offsets[low:high + 1] - offsets[low]
            mark = hashlib.blake2b(f"{partition}:{number}:".encode() + own.tobytes(), digest_size=8).digest()
            number += 1
            yield (int.from_bytes(mark, "little", signed=True), batch.slice(low, high - low),
                   data[offsets[low]:offsets[high]], own)
