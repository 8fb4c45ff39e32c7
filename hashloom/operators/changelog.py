"""Reads and folds over the ordered feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hashloom.runtime import stage

MOST_ENTRIES, DEFAULT_ENTRIES = 1024, 256


def read_after(entries: DataFrame, after: int, most: int = DEFAULT_ENTRIES) -> DataFrame:
    """Entries of one lineage above a position, in order, at most ``most``."""
    return entries.where(F.col("seq") > after).orderBy("seq").limit(min(most, MOST_ENTRIES))


def appended(changes: DataFrame, last: int, order: str) -> DataFrame:
    """``changes`` with the next ``seq`` for each, in order, without gathering them in one task.

    Rows are numbered inside ranges of the order and shifted by the prefix sums of the ranges' counts.
    """
    rows = stage(changes.repartitionByRange(order).withColumn("_part", F.spark_partition_id()), "append")
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return rows.withColumn("_i", inside).join(F.broadcast(before), "_part").withColumn("seq", F.lit(last) + F.col("_before") + F.col("_i")).drop("_part", "_i", "_before")


def folded_meta(ops: DataFrame) -> DataFrame:
    """``(index_name, generation, active)``: the last op of each name by ``pos``."""
    last = ops.groupBy("index_name").agg(F.max(F.struct("pos", "kind")).alias("op"))
    return last.select("index_name", F.col("op.pos").alias("generation"), (F.col("op.kind") == "create").alias("active"))


def stale(local: DataFrame, folded: DataFrame) -> DataFrame:
    """Names held locally that the feed has no active lineage of."""
    return local.select("index_name").distinct().join(folded.where("active").select("index_name"), "index_name", "left_anti")


def ranked_donors(probes: DataFrame, generation: int, after: int) -> DataFrame:
    """Peers from which a snapshot helps, freshest first; few rows by nature (one per peer)."""
    fit = probes.where((F.col("ok")) & (F.col("generation") == generation) & (F.col("file_version") > after))
    return fit.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("file_version"), "base_url")).cast("bigint"))
