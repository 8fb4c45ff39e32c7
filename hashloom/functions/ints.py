"""u32 arithmetic and the small integer formulas of search."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

U32_MAX = 4294967295


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row; the planner inlines a named column into every turn of a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def u32(value: Column) -> Column:
    """A hash that may be held as a signed 32-bit number, as u32 in a BIGINT."""
    return value.bitwiseAND(F.lit(U32_MAX))


def u32_bag(hashes: Column) -> Column:
    """Non-null elements as u32, repeated ones kept; null for a null array."""
    return F.transform(F.filter(hashes, lambda h: h.isNotNull()), u32)


def u32_set(hashes: Column) -> Column:
    """Sorted distinct u32 elements; empty for a null array."""
    return F.sort_array(F.array_distinct(F.coalesce(u32_bag(hashes), F.array().cast("array<bigint>"))))


def is_u32(value: Column) -> Column:
    return value.isNotNull() & value.between(0, U32_MAX)


def default_min_score(raw_len: Column) -> Column:
    """ceil(n / 20) of the query's length before duplicates are removed."""
    return F.floor((raw_len + 19) / 20).cast("bigint")


def percent_floor(score: Column, pct: Column) -> Column:
    return F.floor(score * pct / 100).cast("bigint")


def clamp(value: Column, low: int, high: int) -> Column:
    return F.greatest(F.least(value, F.lit(high)), F.lit(low))
