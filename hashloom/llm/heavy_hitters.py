"""Most frequent values of a huge column in bounded memory.

First pass: one space-saving summary of at most ``counters`` values per input partition,
merged in a tree of fan-in 64. A summary is kept in the form that merges exactly: each
counter holds its count above the smallest counter (a lower bound of the true count),
and ``floor`` is the sum of what was cut off, so ``low <= true count <= low + floor`` and
``floor <= N / (counters + 1)``. Every value with more than N / (counters + 1) rows
survives. Second pass: the surviving candidates (at most ``counters``, a proven bound for
the broadcast) are counted exactly.

Defined results: nulls, null arrays and null elements count for nothing; repeated rows
count each time; ties at the share are kept; an empty column gives no rows; other columns
are ignored. An element type may be any that Arrow can group (numbers, strings, dates).
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

COUNTERS = 4096
FAN_IN = 64


class Summary:
    """Space-saving summary of a stream of values."""

    def __init__(self, counters: int) -> None:
        self.counters, self.floor, self.n = counters, 0, 0
        self.table: pa.Table | None = None

    def add(self, values: pa.Array, counts: pa.Array, floor: int, n: int) -> None:
        """Merge a summary (a batch counted exactly is one with floor 0)."""
        self.floor += floor
        self.n += n
        part = pa.table({"value": values, "low": counts.cast(pa.int64())})
        both = part if self.table is None else pa.concat_tables([self.table, part]).group_by("value").aggregate([("low", "sum")]).rename_columns(["value", "low"])
        self.table = both
        if both.num_rows > self.counters:
            low = both.column("low").to_numpy()
            cut = int(np.partition(low, -self.counters - 1)[-self.counters - 1])
            keep = pa.array(low > cut)
            self.floor += cut
            self.table = pa.table({"value": both.column("value").filter(keep), "low": pa.array(low[low > cut] - cut, pa.int64())})

    def batch(self, kind: pa.DataType) -> pa.RecordBatch:
        """One row per counter; a summary without counters is one row with a null value."""
        part = TaskContext.get().partitionId()
        if self.table is None or self.table.num_rows == 0:
            value, low = pa.nulls(1, kind), pa.array([0], pa.int64())
        else:
            value, low = self.table.column("value").combine_chunks().cast(kind), self.table.column("low").combine_chunks()
        size = len(low)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(size, part), pa.int64()), value, low, pa.array(np.full(size, self.floor), pa.int64()), pa.array(np.full(size, self.n), pa.int64())],
            names=["part", "value", "low", "floor", "n"],
        )


def _flatten(column: pa.Array) -> pa.Array:
    return column.flatten() if pa.types.is_list(column.type) or pa.types.is_large_list(column.type) else column


def _summarize(counters: int, prepare):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary, kind = Summary(counters), None
        for batch in batches:
            values = prepare(_flatten(batch.column(0)).drop_null())
            kind = values.type
            if len(values):
                counted = pc.value_counts(values)
                summary.add(counted.field("values"), counted.field("counts"), 0, len(values))
        if kind is not None:
            yield summary.batch(kind)

    return run


def _merge(counters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary, kind, seen = Summary(counters), None, set()
        for batch in batches:
            kind = batch.column("value").type
            parts = batch.column("part").to_numpy()
            for start, end in zip(runs := np.flatnonzero(np.r_[True, parts[1:] != parts[:-1]]), np.append(runs[1:], len(parts)), strict=True):
                piece = batch.slice(start, end - start)
                new = parts[start] not in seen  # floor and n count once per summary, whatever batches it spans
                seen.add(parts[start])
                valid = piece.column("value").is_valid()
                summary.add(piece.column("value").filter(valid), piece.column("low").filter(valid), piece.column("floor")[0].as_py() * new, piece.column("n")[0].as_py() * new)
        if kind is not None:
            yield summary.batch(kind)

    return run


def _same(values: pa.Array) -> pa.Array:
    return values


def summarize(df: DataFrame, column: str, counters: int = COUNTERS, prepare=_same) -> DataFrame:
    """``(value, low, floor, n)``: the summary of the whole column; ``low + floor`` is the upper bound."""
    source = df.select(F.col(column).alias("value"))
    kind = source.schema["value"].dataType
    kind = kind.elementType if isinstance(kind, T.ArrayType) else kind
    schema = T.StructType([T.StructField("part", T.LongType()), T.StructField("value", kind), *[T.StructField(c, T.LongType()) for c in ("low", "floor", "n")]])
    level = source.mapInArrow(_summarize(counters, prepare), schema)
    width = source.rdd.getNumPartitions()
    while width > 1:
        width = -(-width // FAN_IN)
        # Each task gets all rows of 64 summaries (the last one of fewer) and merges them.
        level = level.repartitionById(width, F.floor(F.col("part") / FAN_IN).cast("int")).mapInArrow(_merge(counters), schema)
    return level.where("value is not null").select("value", "low", "floor", "n")


def frequent_values(df: DataFrame, column: str, share: str, counters: int = COUNTERS, prepare=_same, prepared=None) -> DataFrame:
    """``(value, count, low, high, total)`` of values that make up at least ``share`` of all non-null values.

    ``prepare`` maps Arrow values before they are summarized, ``prepared`` does the same to a column
    in the exact pass. ``share`` is an exact decimal such as '0.002'.
    """
    exact_share = Fraction(share)
    if exact_share * (counters + 1) <= 1:
        raise ValueError(f"{counters} counters can't hold all values with a share of {share}")
    up, down = exact_share.numerator, exact_share.denominator
    candidates = summarize(df, column, counters, prepare).where((F.col("low") + F.col("floor")) * F.lit(down) >= F.col("n") * F.lit(up))
    kind = df.schema[column].dataType
    values = df.select((F.explode(column) if isinstance(kind, T.ArrayType) else F.col(column)).alias("value"))
    values = values.where("value is not null").select((prepared(F.col("value")) if prepared else F.col("value")).alias("value"))
    counted = values.join(F.broadcast(candidates), "value").groupBy("value", "low", "floor", "n").agg(F.count("*").alias("count"))
    kept = counted.where(F.col("count") * F.lit(down) >= F.col("n") * F.lit(up))
    return kept.select("value", "count", "low", (F.col("low") + F.col("floor")).alias("high"), F.col("n").alias("total"))


def mask_u32(values: pa.Array) -> pa.Array:
    return pc.bit_wise_and(values.cast(pa.int64()), pa.scalar(4294967295, pa.int64()))
