"""Per-key counts with even load, however skewed the keys are (exact offset chunking).

Rows are range-partitioned and sorted by (key, item), so a hot key covers as many
partitions as its rows need. The rows of each key are counted per partition, the counts are
prefix-summed over the partitions into offsets, and every row gets its exact number in its key:
offset plus place in the partition. A key is cut into chunks of exactly ``chunk_rows`` numbers (the
last one shorter), wherever the partitions end. A run of rows of one chunk leaves one boundary
state: first row number, rows, distinct items, first and last item. Joining neighbouring
states in order (an item that ends one and starts the next is counted once) gives the totals of
a chunk or key. Only states of keys that touch the end of a partition or of a chunk are shuffled again.

Defined results: a null key is a key of its own, as is NaN; a null item counts as a row but not
as a distinct item; repeated rows count as rows; an empty table gives no rows; other
columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hashloom.runtime import stage

CHUNK_ROWS = 100_000


def _changes(values: pa.Array) -> np.ndarray:
    """For each row but the first: does it differ from the row before? Nulls are equal to each other, and so are NaNs."""
    here, before = values[1:], values[:-1]
    differ = pc.fill_null(pc.not_equal(here, before), False).to_numpy(zero_copy_only=False)
    if pa.types.is_floating(values.type):
        nan = pc.fill_null(pc.is_nan(values), False).to_numpy(zero_copy_only=False)
        differ = differ & ~(nan[1:] & nan[:-1])
    valid = values.is_valid().to_numpy(zero_copy_only=False)
    return differ | (valid[1:] != valid[:-1])


def _differ(a: pa.Array, b: pa.Array) -> bool:
    """Of two arrays of one value."""
    return bool(_changes(pa.concat_arrays([a, b]))[0])


def _placed(key_at: int):
    """Adds the partition and the place of each row in its key's run there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, next_place = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            key = batch.column(key_at)
            new = np.r_[last is None or _differ(last, key[:1]), _changes(key)]
            at = np.arange(len(key))
            start = np.maximum.accumulate(np.where(new, at, -1))
            place = np.where(start < 0, at + next_place, at - start)
            last, next_place = key[-1:], int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(key), part), pa.int32()), pa.array(place, pa.int64())], names=[*batch.schema.names, "_part", "_place"])

    return run


def number_rows(df: DataFrame, key: str, item: str) -> DataFrame:
    """``df`` with ``_part`` and ``row_no``: the exact 0-based number of each row among its key's rows, in the order of ``item``.

    No task holds more than a range of (key, item), however hot a key is. Rows with equal items are numbered in any order.
    Columns named ``row_no``, ``_part`` or ``_place`` in the input give way.
    """
    rows = df.drop("row_no", "_part", "_place")
    kept = T.StructType([*rows.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_place", T.LongType())])
    # The source partition breaks ties, so even one (key, item) pair can cover many partitions.
    ranges = rows.withColumn("_src", F.spark_partition_id()).repartitionByRange(key, item, "_src").sortWithinPartitions(key, item).drop("_src")
    ranges = stage(ranges.mapInArrow(_placed(rows.columns.index(key)), kept), "key-ranges")
    counts = ranges.groupBy("_part", F.col(key).alias("_key")).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("_part").alias("_of"), "_key", F.sum("_n").over(earlier).alias("_offset")).where("_offset > 0")
    # At most the first key of a partition goes on from an earlier one: no more rows than partitions.
    side = F.broadcast(stage(offsets, "offsets"))
    numbered = ranges.join(side, (F.col("_part") == F.col("_of")) & F.col(key).eqNullSafe(F.col("_key")), "left")
    return numbered.select(*rows.columns, "_part", (F.coalesce("_offset", F.lit(0)) + F.col("_place")).alias("row_no"))


_STATE = ("chunk", "first_row", "n", "n_items")


def _fold(chunk_rows: int):
    """Boundary states of (key, item, _part, row_no) rows; a scan may bring parts of partitions in any order, each part's rows in theirs."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last run so far: key, first and last item as arrays of one value, then numbers.
        held: dict | None = None

        def states(key, numbers, first_item, last_item, edge) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([key, *[pa.array(numbers[c], pa.int64()) for c in _STATE], first_item, last_item, pa.array(edge)], names=["key", *_STATE, "first_item", "last_item", "edge"])

        def one(edge: bool) -> pa.RecordBatch:
            numbers = {c: [held[c]] for c in _STATE[1:]} | {"chunk": [held["first_row"] // chunk_rows]}
            return states(held["key"], numbers, held["first_item"], held["last_item"], [edge or held["first_row"] > 0])

        for batch in batches:
            if batch.num_rows == 0:
                continue
            key, item = batch.column(0), batch.column(1)
            part, row = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            valid = item.is_valid().to_numpy(zero_copy_only=False)
            new_key, same_part = _changes(key), part[1:] == part[:-1]
            begins = np.r_[True, new_key | ~same_part | (row[1:] != row[:-1] + 1) | (row[1:] % chunk_rows == 0)]
            segs = np.flatnonzero(begins)
            ends = np.append(segs[1:], len(row))
            new_item = np.r_[True, _changes(item)]
            new_item[segs] = True
            counts, items = ends - segs, np.add.reduceat((new_item & valid).astype(np.int64), segs)
            # A key is whole only if it began with its first row and the next row, of the same partition, has another key.
            over = np.append(new_key[segs[1:] - 1] & same_part[segs[1:] - 1], False)
            first_row = row[segs].astype(np.int64)
            firsts, lasts, keys = item.take(pa.array(segs)), item.take(pa.array(ends - 1)), key.take(pa.array(segs))
            if held is not None:
                other_key, near = _differ(held["key"], keys[:1]), held["part"] == part[0]
                if not other_key and near and held["next_row"] == row[0] and row[0] % chunk_rows:
                    joined = bool(valid[0]) and not _differ(held["last_item"], firsts[:1])
                    counts[0] += held["n"]
                    items[0] += held["n_items"] - joined
                    first_row[0] = held["first_row"]
                    firsts = pa.concat_arrays([held["first_item"], firsts[1:]])
                else:
                    yield one(not (other_key and near))
            done = len(segs) - 1
            if done:
                numbers = {"chunk": first_row[:done] // chunk_rows, "first_row": first_row[:done], "n": counts[:done], "n_items": items[:done]}
                yield states(keys[:done], numbers, firsts[:done], lasts[:done], ~over[:done] | (first_row[:done] > 0))
            held = {
                "key": keys[done:], "first_item": firsts[done:], "last_item": lasts[done:], "part": part[-1], "next_row": int(row[-1]) + 1,
                "first_row": int(first_row[-1]), "n": int(counts[-1]), "n_items": int(items[-1]),
            }
        if held is not None:
            yield one(True)

    return fold


def chunk_states(df: DataFrame, key: str, item: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``(key, chunk, first_row, n, n_items, first_item, last_item, edge)``, staged: one boundary state per chunk, or per part of it that one task holds.

    Without ``edge`` the state is that of a whole key.
    """
    rows = number_rows(df.select(F.col(key).alias("key"), F.col(item).alias("item")), "key", "item")
    kinds = {f.name: f.dataType for f in rows.schema}
    fields = [("key", kinds["key"]), *[(c, T.LongType()) for c in _STATE], ("first_item", kinds["item"]), ("last_item", kinds["item"]), ("edge", T.BooleanType())]
    schema = T.StructType([T.StructField(name, kind) for name, kind in fields])
    return stage(rows.select("key", "item", "_part", "row_no").mapInArrow(_fold(chunk_rows), schema), "chunks")


def _joined(states: DataFrame, *same: str) -> DataFrame:
    """States in order, ``n_items`` without an item that the state before, of the same ``same``, ends with."""
    order = Window.partitionBy(*same).orderBy("first_row")
    again = F.coalesce((F.lag("last_item").over(order) == F.col("first_item")).cast("long"), F.lit(0))
    return states.withColumn("n_items", F.col("n_items") - again)


def key_chunks(df: DataFrame, key: str, item: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``(key, chunk, n, n_items, first_item, last_item)``: each key's rows in order of item, in chunks of exactly ``chunk_rows`` (the last one shorter)."""
    states = chunk_states(df, key, item, chunk_rows)
    columns = ["key", "chunk", "n", "n_items", "first_item", "last_item"]
    ends = [F.min_by("first_item", "first_row").alias("first_item"), F.max_by("last_item", "first_row").alias("last_item")]
    cut = _joined(states.where("edge"), "key", "chunk").groupBy("key", "chunk").agg(F.sum("n").alias("n"), F.sum("n_items").alias("n_items"), *ends)
    return states.where("not edge").select(*columns).unionByName(cut.select(*columns))


def chunked_counts(df: DataFrame, key: str, item: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``(key, n, n_items)``: rows and distinct non-null items of every key, with even load."""
    states = chunk_states(df, key, item, chunk_rows)
    merged = _joined(states.where("edge"), "key").groupBy("key").agg(F.sum("n").alias("n"), F.sum("n_items").alias("n_items"))
    return states.where("not edge").select("key", "n", "n_items").unionByName(merged)
