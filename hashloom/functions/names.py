"""File names, index names and hash lists as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INDEX_NAME = "^[A-Za-z0-9_-]{1,255}$"


def valid_index_name(name: Column) -> Column:
    return F.coalesce(name.rlike(INDEX_NAME), F.lit(False))


def hex16(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def segment_name(commit_id: Column, merges: Column) -> Column:
    return F.concat(hex16(commit_id), F.lit("-"), F.lpad(F.lower(F.hex(merges)), 8, "0"), F.lit(".data"))


def log_name(first_commit: Column) -> Column:
    return F.concat(hex16(first_commit), F.lit(".xlog"))


def lineage_dir(generation: Column) -> Column:
    """``v%06d``; longer numbers are kept whole."""
    digits = generation.cast("string")
    return F.concat(F.lit("v"), F.when(F.length(digits) < 6, F.lpad(digits, 6, "0")).otherwise(digits))


def parse_segment_name(name: Column) -> Column:
    """``struct(commit_id, merges)``, null for any other name."""
    pattern = "^([0-9a-f]{16})-([0-9a-f]{8})\\.data$"
    whole = name.rlike(pattern)
    part = lambda i: F.conv(F.regexp_extract(name, pattern, i), 16, 10).cast("decimal(20,0)").cast("bigint")
    return F.when(whole, F.struct(part(1).alias("commit_id"), part(2).alias("merges")))


def effective_version(version: Column, commit_id: Column, merges: Column) -> Column:
    return F.coalesce(version, commit_id + merges)


def parse_hash_list(text: Column) -> Column:
    """Comma-separated signed decimals as u32; null if the text is empty or any item is no 64-bit integer."""
    items = F.split(text, ",")
    numbers = F.transform(items, lambda x: x.try_cast("bigint"))
    good = (F.length(text) > 0) & F.forall(items, lambda x: x.rlike("^[+-]?[0-9]+$")) & F.forall(numbers, lambda x: x.isNotNull())
    return F.when(good, F.transform(numbers, lambda x: x.bitwiseAND(F.lit(4294967295))))


def format_results(ids_scores: Column) -> Column:
    """``id:score id:score`` from an array of structs in order."""
    return F.concat_ws(" ", F.transform(ids_scores, lambda r: F.concat_ws(":", r["id"], r["score"])))


def clamped_nap(hint_ms: Column, left_ms: Column) -> Column:
    """How long a poller sleeps: the hint, 50 ms at least, within the time left; null when none is left."""
    return F.when(left_ms.isNull(), F.greatest(hint_ms, F.lit(50))).when(left_ms > 0, F.least(F.greatest(hint_ms, F.lit(50)), left_ms))
