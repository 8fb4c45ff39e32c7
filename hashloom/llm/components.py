"""Connected components of a link table, without collecting it.

Every task first contracts the links it holds: each node is linked to the smallest node it
reaches there. Then two star contractions alternate until the links stop changing: every node
hands its larger, then its smaller neighbours to the smallest node it knows. Each round is two
aggregations and joins over the links, staged in the shared folder, and their number
grows with the logarithm of the component size. A node with very many links is combined
map-side in the aggregation and split by adaptive execution in the join. Links that one task
holds are done after the first contraction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hashloom.runtime import drop_staged, stage

#: Links contracted at once, and distinct nodes a task holds before it passes them on.
STEP, HELD = 500_000, 4_000_000


def smallest_reached(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for every node that isn't that one."""
    ids, place = np.unique(np.r_[u, v], return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    root = np.arange(len(ids))
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        if (low == high).all():
            break
        np.minimum.at(root, high, low)
        while not (root[root] == root).all():
            root = root[root]
    moved = root != np.arange(len(ids))
    return ids[moved], ids[root[moved]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    u, v, fresh = [], [], 0

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(u[0], pa.int64()), pa.array(v[0], pa.int64())], names=["u", "v"])

    for batch in batches:
        u.append(batch.column(0).to_numpy())
        v.append(batch.column(1).to_numpy())
        fresh += batch.num_rows
        if fresh >= STEP:
            a, b = smallest_reached(np.concatenate(u), np.concatenate(v))
            u, v, fresh = [a], [b], 0
            if len(a) >= HELD:
                yield rows()
                u, v = [], []
    if u:
        a, b = smallest_reached(np.concatenate(u), np.concatenate(v))
        u, v = [a], [b]
        yield rows()


def _contracted(links: DataFrame) -> DataFrame:
    return stage(links.mapInArrow(_contract, "u bigint, v bigint"), "links")


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def connected(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``(id, root)`` for every node of ``links (u, v)`` that isn't the smallest of its component.

    Nodes are whole numbers. Links may be repeated, in either direction or from a node to itself; nulls are left out.
    """
    clean = links.where("u <> v").select(F.greatest("u", "v").cast("bigint").alias("u"), F.least("u", "v").cast("bigint").alias("v"))
    edges = _contracted(clean.distinct())
    before = None
    for _ in range(most_rounds):
        if len(edges.inputFiles()) <= 1:
            break  # one task held all links
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u")
        handed = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        own = small_least.select("u", F.col("m").alias("v"))
        passed = edges
        edges = _contracted(handed.unionByName(own).distinct())
        after = _state(edges)
        drop_staged(passed)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components still change after {most_rounds} rounds")
    # A node that several tasks hold may come more than once until the links are stable; then each has one root.
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).distinct() if before is not None else edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
