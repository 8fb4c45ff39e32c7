"""State of a change log: newest operation per id, live documents, metadata and statistics.

Change rows have ``commit_id``, ``ordinal`` (place in the commit), ``op`` (insert, delete or
set_metadata, or the first letter), ``id`` and ``hashes``. An insert replaces the document, a
delete leaves a tombstone that shadows all older versions. Ids that are null or 0 touch nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hashloom.operators.feeds import op_kind


def document_ops(changes: DataFrame) -> DataFrame:
    """Inserts and deletes of valid ids with ``kind`` i or d."""
    return changes.withColumn("kind", op_kind(F.col("op"))).where("kind in ('i', 'd') and id is not null and id <> 0")


def last_in_commit(changes: DataFrame) -> DataFrame:
    """The last operation on each id within each commit."""
    last = Window.partitionBy("commit_id", "id").orderBy(F.desc("ordinal"))
    return document_ops(changes).withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r")


def newest(changes: DataFrame) -> DataFrame:
    """The newest operation on each id; only candidates of each task are shuffled."""
    last = Window.partitionBy("id").orderBy(F.desc("commit_id"), F.desc("ordinal"))
    return document_ops(changes).withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r")


def doc_versions(changes: DataFrame) -> DataFrame:
    """``(id, version, deleted)``."""
    return newest(changes).select("id", F.col("commit_id").alias("version"), (F.col("kind") == "d").alias("deleted"))


def live_docs(changes: DataFrame) -> DataFrame:
    return newest(changes).where("kind = 'i'")


def tombstones(changes: DataFrame) -> DataFrame:
    return newest(changes).where("kind = 'd'").select("id")


def superseded(segments: DataFrame) -> DataFrame:
    """Rows ``(commit_id, id)`` that a newer segment mentions, as an insert or a delete."""
    latest = segments.groupBy("id").agg(F.max("commit_id").alias("latest"))
    return segments.join(latest, "id").where("commit_id < latest").drop("latest")


def not_superseded(segments: DataFrame) -> DataFrame:
    older = superseded(segments).select("id", "commit_id").distinct()
    return segments.join(older, ["id", "commit_id"], "left_anti")


def metadata_state(entries: DataFrame) -> DataFrame:
    """``(key, value)``: the newest value of each key of rows ``(commit_id, ordinal, key, value)``."""
    place = F.struct("commit_id", "ordinal")
    return entries.where("key is not null").groupBy("key").agg(F.max_by("value", place).alias("value"))


def statistics(changes: DataFrame) -> DataFrame:
    """One row: version, segments, documents as their sum over segments, live documents, smallest and greatest id."""
    ops = last_in_commit(changes)
    by_commit = ops.agg(
        F.countDistinct("commit_id").alias("num_segments"), F.count("*").alias("num_docs"), F.coalesce(F.min("id"), F.lit(0)).alias("min_doc_id"), F.coalesce(F.max("id"), F.lit(0)).alias("max_doc_id"),
    )
    version = changes.agg(F.coalesce(F.max("commit_id"), F.lit(0)).alias("version"))
    live = live_docs(changes).agg(F.count("*").alias("num_live"))
    # One row each, put side by side.
    parts = by_commit.unionByName(version, allowMissingColumns=True).unionByName(live, allowMissingColumns=True)
    return parts.agg(*[F.max(c).alias(c) for c in ("version", *by_commit.columns, "num_live")])
