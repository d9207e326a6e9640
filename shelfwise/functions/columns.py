"""Scalar expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType


def to_id(name: str) -> Column:
    """Id as ``bigint``; text that is not a whole number becomes NULL, so its row drops out."""
    return F.col(name).try_cast("bigint")


def tier(count: Column, name: str, thresholds: Sequence[int]) -> Column:
    """Highest tier reached: ``name3``, ``name2``, ``name1`` or NULL below the first threshold."""
    t1, t2, t3 = thresholds
    return (
        F.when(count >= t3, F.lit(f"{name}3")).when(count >= t2, F.lit(f"{name}2")).when(count >= t1, F.lit(f"{name}1"))
    )


def lookback_start(as_of: datetime, days: int, dtype: DataType) -> Column:
    """``as_of`` less ``days`` calendar days, in the type of the compared column so the filter reaches the scan.

    A moment with a zone is that instant, one without is local to the session's zone. For a DATE column, whose values
    are midnights, the bound is rounded up to the next day.
    """
    text = as_of.isoformat(" ", "microseconds")
    start = F.lit(text).cast("timestamp") - F.make_interval(days=F.lit(days))
    if isinstance(dtype, DateType):
        return F.to_date(start) + F.when(start > F.date_trunc("day", start), 1).otherwise(0)
    return start.cast(dtype)


def position_in(value: Column, ordered: Sequence[str]) -> Column:
    """1-based place of ``value`` in ``ordered``, 0 when absent."""
    return F.array_position(F.array(*[F.lit(v) for v in ordered]), value)


def join_ids(ids: Column) -> Column:
    """Comma-joined text of an id array, order kept."""
    return F.array_join(F.transform(ids, lambda x: x.cast("string")), ",")


def image_url(file_name: Column, domain: str | None) -> Column:
    """``https://<domain>/<file>``, or NULL when there is no file or no domain."""
    if not domain:
        return F.lit(None).cast("string")
    return F.when(F.length(file_name) > 0, F.concat(F.lit(f"https://{domain}/"), file_name))
