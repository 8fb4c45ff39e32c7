"""The N best rows of every group, whatever the size of the groups (hot-cold split).

Exact group counts, taken with map-side combining, name the heavy groups: more than
``hot_rows`` rows and more than one ten-thousandth of all, so at most 10 000 keys, a
proven bound for the broadcast. Rows of light groups go through an ordinary window.
Rows of heavy groups are range-sorted by (group, order), the input partition salting
equal rows, so one group covers as many tasks as it needs; each range keeps its first
N rows of a group, and a window over those few rows ranks them.

Defined results: order is score descending with nulls last, then the tie columns
ascending with nulls first, then the other columns kept, so a tie is always broken
alike and repeated rows rank one after the other; a null group is a group; an empty
table gives no rows; the input's own column ``rank``, if it has one that is neither
group, score nor tie, gives way to the result's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hashloom.runtime import stage

HOT_ROWS = 100_000
MOST_HOT_GROUPS = 10_000


def _head(n: int):
    """First ``n`` rows of each run of equal first column in a sorted partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            key = batch.column(0)
            here, before = key[1:], key[:-1]
            differ = pc.fill_null(pc.not_equal(here, before), False).to_numpy(zero_copy_only=False) | (
                here.is_valid().to_numpy(zero_copy_only=False) != before.is_valid().to_numpy(zero_copy_only=False)
            )
            goes_on = last is not None and last[0].as_py() == key[0].as_py()
            start = np.r_[not goes_on, differ]
            at = np.arange(size)
            begin = np.maximum.accumulate(np.where(start, at, -1))
            place = np.where(begin < 0, at + seen, at - begin)
            seen, last = int(place[-1]) + 1, key[-1:]
            yield batch.filter(pa.array(place < n))

    return run


def heavy_groups(rows: DataFrame, group: str, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, int]:
    """Heavy groups by exact count, staged, and how many they are."""
    counts = stage(rows.groupBy(F.col(group).alias("group")).agg(F.count("*").alias("rows")), "group-counts")
    total = counts.agg(F.sum("rows")).first()[0] or 0
    heavy = counts.where(F.col("rows") > max(hot_rows, total // MOST_HOT_GROUPS)).select("group")
    return heavy, heavy.count()


def split_heavy(rows: DataFrame, group: str, heavy: DataFrame, count: int) -> tuple[DataFrame | None, DataFrame]:
    """(rows of heavy groups or None, rows of light groups)."""
    if not count:
        return None, rows
    flagged = rows.join(F.broadcast(heavy.select(F.col("group").alias("_heavy_key"), F.lit(True).alias("_hot"))), F.col(group).eqNullSafe(F.col("_heavy_key")), "left")
    return flagged.where("_hot").select(*rows.columns), flagged.where("_hot is null").select(*rows.columns)


def rank_light(rows: DataFrame, group: str, order: list, n: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= n)


def rank_heavy(rows: DataFrame, group: str, order: list, n: int) -> DataFrame:
    columns = [group, *[c for c in rows.columns if c != group]]
    salted = rows.select(*columns, F.spark_partition_id().alias("_salt"))
    ordered = salted.repartitionByRange(F.col(group), *order, F.col("_salt")).sortWithinPartitions(F.col(group), *order).select(*columns)
    return rank_light(ordered.mapInArrow(_head(n), ordered.schema), group, order, n).select(*rows.columns, "rank")


def top_n(rows: DataFrame, group: str, score: str, ties: list[str], n: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The first ``n`` rows of each group with their ``rank``; the input is read three times, shuffled once."""
    if "rank" not in (group, score, *ties):
        rows = rows.drop("rank")
    order = [F.desc_nulls_last(score), *[F.asc_nulls_first(c) for c in [*ties, *[c for c in rows.columns if c not in (group, score, *ties)]]]]
    heavy, light = split_heavy(rows, group, *heavy_groups(rows, group, hot_rows))
    ranked = rank_light(light, group, order, n)
    return ranked if heavy is None else ranked.unionByName(rank_heavy(heavy, group, order, n))


def top_n_newest(rows: DataFrame, group: str, item: str, score: str, newest: str, n: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """As ``top_n`` over (group, item, score), after reducing rows of one (group, item) to the greatest ``newest`` (then score).

    ``score`` and ``newest`` are u32 in BIGINT (null ``newest`` counts as 0), so both fit one long whose
    maximum is aggregated by hash. Rows with a null score are dropped.
    """
    base = 4294967296
    packed = (F.coalesce(newest, F.lit(0)) - F.lit(base // 2)) * F.lit(base) + F.col(score)
    rows = rows.where(F.col(score).isNotNull()).select(F.col(group), F.col(item), packed.alias("_packed"))
    counts = heavy_groups(rows, group, hot_rows)
    order = [F.desc_nulls_last(score), F.asc_nulls_first(item)]

    def reduced(part: DataFrame) -> DataFrame:
        last = part.groupBy(group, item).agg(F.max("_packed").alias("_packed"))
        return last.select(group, item, F.col("_packed").bitwiseAND(F.lit(base - 1)).alias(score))

    heavy, light = split_heavy(rows, group, *counts)
    ranked = rank_light(reduced(light), group, order, n)
    return ranked if heavy is None else ranked.unionByName(rank_heavy(reduced(heavy), group, order, n))
