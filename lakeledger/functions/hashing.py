"""Content fingerprints."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F

from ..constants import HEAD_BYTES
from .paths import _col


def fingerprint(content: Column | str) -> Column:
    """SHA-256 of the whole content, as hex."""
    return F.sha2(_col(content).cast("binary"), 256)


def head_fingerprint(content: Column | str, head_bytes: int = HEAD_BYTES) -> Column:
    """SHA-256 of the first bytes of the content."""
    return F.sha2(F.substring(_col(content).cast("binary"), 1, head_bytes), 256)


def xxh64_fingerprint(content: Column | str) -> Column:
    """xxHash64 with seed 0 as 16 hex digits.

    Spark's own ``xxhash64`` starts from seed 42, so this digest runs on Arrow batches in Python.
    """

    @F.pandas_udf("string")
    def digest(values: pd.Series) -> pd.Series:
        import xxhash

        return values.map(lambda v: None if v is None else xxhash.xxh64_hexdigest(bytes(v)))

    return digest(_col(content).cast("binary"))
