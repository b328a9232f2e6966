"""Small scalar functions: times, sizes, shares, labels, page arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from ..constants import DEFAULT_CATEGORY, MAX_PAGE_LIMIT, PAGE_SIZE
from .paths import _col


def to_ts(epoch: Column | str) -> Column:
    """Epoch seconds (double) to timestamp, at microseconds."""
    return F.timestamp_micros(F.round(_col(epoch) * 1_000_000).cast("bigint"))


def to_epoch(ts: Column | str) -> Column:
    """Timestamp to epoch seconds (double)."""
    return F.unix_micros(_col(ts)) / F.lit(1e6)


def display_time(epoch: Column | str, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Epoch seconds as text in the session time zone."""
    return F.date_format(to_ts(epoch), pattern)


def format_bytes(size: Column | str) -> Column:
    """Human size: B, then KB and MB with one decimal, GB with two; a dash for null."""
    size = _col(size)

    def scaled(unit: int, digits: int, label: str) -> Column:
        # HALF_UP on the decimal value, printed with all its digits
        return F.concat(
            F.round(size.cast("decimal(20,0)") / F.lit(unit), digits).cast(f"decimal(20,{digits})").cast("string"),
            F.lit(" " + label),
        )

    return (
        F.when(size.isNull(), F.lit("—"))
        .when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < 1_048_576, scaled(1024, 1, "KB"))
        .when(size < 1_073_741_824, scaled(1_048_576, 1, "MB"))
        .otherwise(scaled(1_073_741_824, 2, "GB"))
    )


def or_default(value: Column | str, default=DEFAULT_CATEGORY) -> Column:
    """Replace null and the empty (or zero) value."""
    value = _col(value)
    if isinstance(default, str):
        value = F.nullif(value, F.lit(""))
    return F.coalesce(value, F.lit(default))


def percent_share(part: Column | str, total: Column | str) -> Column:
    """Whole-number percentage, 0 when the total is 0."""
    return F.coalesce(
        F.floor(_col(part) * F.lit(100.0) / F.nullif(_col(total), F.lit(0)) + F.lit(0.5)), F.lit(0)
    ).cast("bigint")


def rate(count: Column | str, seconds: Column | str) -> Column:
    """Items per second, 0 when no time passed."""
    return F.when(_col(seconds) > 0, _col(count) / _col(seconds)).otherwise(F.lit(0.0))


def wasted_bytes(size: Column | str, copies: Column | str) -> Column:
    return _col(size) * (_col(copies) - 1)


def copy_label(rank: Column | str) -> Column:
    """KEEP for the first file of a group, then COPY 1, COPY 2, ..."""
    rank = _col(rank)
    return F.when(rank == 1, F.lit("KEEP")).otherwise(F.concat(F.lit("COPY "), (rank - 1).cast("string")))


def clamp_limit(limit: int) -> int:
    return min(max(limit, 1), MAX_PAGE_LIMIT)


def clamp_offset(offset: int) -> int:
    return max(offset, 0)


def clamp_page(page: int, total: int, page_size: int = PAGE_SIZE) -> int:
    """The page to show when ``total`` rows are there."""
    return min(max(page, 0), max(0, math.ceil(total / page_size) - 1))


def page_count(total: Column | str, page_size: int = PAGE_SIZE) -> Column:
    return F.greatest(F.lit(1), F.ceil(_col(total) / F.lit(page_size))).cast("bigint")
