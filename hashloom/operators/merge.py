"""Segment algebra: merged postings, merged intervals, delta coding and scan histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hashloom.functions.names import effective_version
from hashloom.runtime import stage

SCANNED_DOCS = (1, 2, 3, 5, 10, 50, 100, 500, 1000)
SCANNED_BLOCKS = (1, 2, 3, 5, 10)
SECONDS = (0.001, 0.005, 0.01, 0.05, 0.1, 0.5, 1.0, 5.0)


def merged_postings(items: DataFrame, docs: DataFrame) -> DataFrame:
    """``(hash, id)`` of several segments in order, without items of documents a newer segment mentions.

    ``items (commit_id, hash, id)`` and ``docs (commit_id, id)`` come from all segments of the snapshot.
    """
    latest = docs.groupBy("id").agg(F.max("commit_id").alias("commit_id"))
    return items.join(latest, ["id", "commit_id"], "left_semi").select("hash", "id").orderBy("hash", "id")


def merged_info(infos: DataFrame) -> DataFrame:
    """Adjacent ``(commit_id, merges, version)`` as one interval."""
    return infos.agg(F.min("commit_id").alias("commit_id"), (F.sum(F.col("merges") + 1) - 1).alias("merges"), F.max("version").alias("version"))


def contains(commit_id: Column, merges: Column, other_id: Column, other_merges: Column) -> Column:
    return (commit_id <= other_id) & (commit_id + merges >= other_id + other_merges)


def watermarks(infos: DataFrame) -> DataFrame:
    """``(commit_id, version)``: the last commit and the last effective version that segments cover."""
    return infos.agg(F.max(F.col("commit_id") + F.col("merges")).alias("commit_id"), F.max(effective_version(F.col("version"), F.col("commit_id"), F.col("merges"))).alias("version"))


def merge_estimate(size: Column, live_pct: Column) -> Column:
    """Expected items of a merge source: its size times its live share, ten points more, at most all."""
    return F.floor(size * F.least(F.lit(100), live_pct + 10) / 100).cast("bigint")


def _ranges(rows: DataFrame, *order: str) -> DataFrame:
    """Rows with the number ``_part`` of their range of ``order``, staged: hot keys cover many ranges."""
    return stage(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")


def _carried(ranges: DataFrame, *columns: str) -> DataFrame:
    """For each range the greatest row of the range before: one row per range."""
    edges = ranges.groupBy("_part").agg(F.max(F.struct(*columns)).alias("_edge"))
    return edges.select("_part", F.lag("_edge").over(Window.orderBy("_part")).alias("_edge"))


def delta_encoded(rows: DataFrame) -> DataFrame:
    """``(hash, id, delta)``: ids as gaps within the run of a hash, which starts over with the id itself."""
    ranges = _ranges(rows.select("hash", "id"), "hash", "id")
    inside = F.lag("id").over(Window.partitionBy("_part", "hash").orderBy("id"))
    before = F.coalesce(inside, F.when(F.col("_edge.hash") == F.col("hash"), F.col("_edge.id")), F.lit(0))
    edged = ranges.join(F.broadcast(_carried(ranges, "hash", "id")), "_part")
    return edged.withColumn("_before", before).select("hash", "id", (F.col("id") - F.col("_before")).alias("delta"))


def delta_decoded(rows: DataFrame) -> DataFrame:
    """``(hash, id, delta)`` from ``(hash, place, delta)``: sums along the run, added up over its ranges."""
    ranges = _ranges(rows.select("hash", "place", "delta"), "hash", "place")
    sums = ranges.groupBy("_part", "hash").agg(F.sum("delta").alias("_sum"))
    earlier = Window.partitionBy("hash").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("_part", "hash", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    inside = F.sum("delta").over(Window.partitionBy("_part", "hash").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    return ranges.withColumn("_inside", inside).join(carried, ["_part", "hash"]).select("hash", (F.col("_before") + F.col("_inside")).alias("id"), "delta")


def hash_gaps(hashes: DataFrame) -> DataFrame:
    """``(hash, gap)`` between neighbouring distinct hashes, the first counted from 0."""
    ranges = _ranges(hashes.select("hash").distinct(), "hash")
    inside = F.lag("hash").over(Window.partitionBy("_part").orderBy("hash"))
    edged = ranges.join(F.broadcast(_carried(ranges, "hash")), "_part").withColumn("_inside", inside)
    return edged.select("hash", (F.col("hash") - F.coalesce("_inside", F.col("_edge.hash"), F.lit(0))).alias("gap"))


def histogram(values: DataFrame, column: str, bounds: tuple) -> DataFrame:
    """Cumulative ``(le, cnt)``, with null for +Inf, of a numeric column."""
    sums = values.agg(*[F.count(F.when(F.col(column) <= b, 1)).alias(f"b{i}") for i, b in enumerate(bounds)], F.count(column).alias("every"))
    kind = "double" if any(isinstance(b, float) for b in bounds) else "bigint"
    rows = [F.struct(F.lit(b).cast(kind).alias("le"), F.col(f"b{i}").alias("cnt")) for i, b in enumerate(bounds)]
    rows.append(F.struct(F.lit(None).cast(kind).alias("le"), F.col("every").alias("cnt")))
    return sums.select(F.explode(F.array(*rows)).alias("r")).select("r.le", "r.cnt")
