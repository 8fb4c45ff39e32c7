"""Prefix keys of sets: which rare tokens two similar sets must share.

Tokens are ordered by an estimate of how many sets hold them, then by value. The
estimate is the load of the token's bucket among ``SKETCH`` buckets, so it is one small
array, whatever the data's size (the bound of what is broadcast), and still one fixed
order for all sets, which is all that the filter's exactness needs: two sets of sizes
a and b with Jaccard similarity t or more share at least t/(1+t)(a+b) tokens, so they
share one of the first ``size - ceil(t * size) + 1`` tokens of each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hashloom.functions.ints import u32_set

#: A prime below 2**20: bucket loads are collected as at most so many pairs of numbers.
SKETCH = 1_048_573


def sets_by_id(rows: DataFrame, item: str, hashes: str, newest: str | None = None) -> DataFrame:
    """``(id, tokens)``: one set of sorted distinct u32 tokens for each id.

    Of several rows of one id the one with the greatest ``newest`` counts, then the greatest set
    in array order; an id whose counting row has no tokens, or a null id, is left out.
    """
    tokens = u32_set(F.col(hashes)).alias("tokens")
    rank = F.struct(*([F.col(newest).alias("newest")] if newest else []), tokens)
    last = rows.where(F.col(item).isNotNull()).groupBy(F.col(item).alias("id")).agg(F.max(rank).alias("r"))
    return last.select("id", F.col("r.tokens").alias("tokens")).where("size(tokens) > 0")


def token_loads(sets: DataFrame) -> np.ndarray:
    """Postings per sketch bucket."""
    buckets = sets.select(F.explode("tokens").alias("t")).groupBy(F.pmod("t", F.lit(SKETCH)).cast("int").alias("b")).agg(F.count("*").alias("n"))
    found = buckets.toArrow()
    loads = np.zeros(SKETCH, np.int64)
    loads[found.column("b").to_numpy()] = found.column("n").to_numpy()
    return np.minimum(loads, 2**31 - 1).astype(np.int32)


def prefix_length(size: np.ndarray, up: int, down: int) -> np.ndarray:
    """size - ceil(up/down * size) + 1."""
    return size - -(-size * up // down) + 1


def ordered_prefixes(tokens: pa.Array, loads: np.ndarray, up: int, down: int):
    """(sizes, row of each key, token of each key, place of each key) of one batch of list values."""
    offsets = tokens.offsets.to_numpy().astype(np.int64)
    flat = tokens.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((flat, loads[flat % SKETCH], row))
    place = np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], sizes)
    keep = place < prefix_length(sizes, up, down)[row]
    return sizes, row[keep], flat[order][keep], place[keep]


def prefix_keys(sets: DataFrame, loads: np.ndarray, up: int, down: int) -> DataFrame:
    """``(token, id, size, place)`` for the prefix of every set (columns ``id`` and ``tokens``)."""
    shared = sets.sparkSession.sparkContext.broadcast(loads)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, row, token, place = ordered_prefixes(batch.column("tokens"), shared.value, up, down)
            yield pa.RecordBatch.from_arrays(
                [pa.array(token, pa.int64()), batch.column("id").take(pa.array(row)), pa.array(sizes[row].astype(np.int32)), pa.array(place.astype(np.int32))],
                names=["token", "id", "size", "place"],
            )

    return sets.select("id", "tokens").mapInArrow(run, f"token bigint, id {sets.schema['id'].dataType.simpleString()}, size int, place int")
