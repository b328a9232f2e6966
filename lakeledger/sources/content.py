"""Hashing of files by path, read in chunks inside Arrow batches."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..constants import HEAD_BYTES, READ_CHUNK_BYTES


def _digest(path: str, limit: int | None, make: Callable) -> str | None:
    state = make()
    try:
        with open(path, "rb") as handle:
            if limit is not None:
                state.update(handle.read(limit))
            else:
                while chunk := handle.read(READ_CHUNK_BYTES):
                    state.update(chunk)
    except OSError:
        return None
    return state.hexdigest()


def hash_paths(paths: DataFrame, head_only: bool = False, algorithm: str = "sha256", path: str = "path") -> DataFrame:
    """Add ``digest`` to a DataFrame of readable paths; null where a file cannot be read.

    ``head_only`` reads the first 64 KB and nothing more. ``algorithm`` is ``sha256`` or ``xxh64``.
    """
    fields = paths.schema.fields
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", digest STRING"
    limit = HEAD_BYTES if head_only else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if algorithm == "xxh64":
            from xxhash import xxh64 as make
        else:
            make = hashlib.sha256
        for batch in batches:
            yield batch.assign(digest=[_digest(p, limit, make) for p in batch[path]])

    return paths.mapInPandas(run, schema)


def path_digests(paths: DataFrame, **options) -> DataFrame:
    """(path, digest) rows for many paths; unreadable ones are left out."""
    return hash_paths(paths.select("path"), **options).filter(F.col("digest").isNotNull())
