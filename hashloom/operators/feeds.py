"""Shared readings of the meta feed, the oplog and the changelog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def op_kind(op: Column) -> Column:
    """``i``, ``d`` or ``s`` from the op's name or its first letter; null for anything else."""
    letter = F.lower(F.substring(F.trim(op), 1, 1))
    return F.when(letter.isin("i", "d", "s"), letter)


def active_generations(meta: DataFrame) -> DataFrame:
    """``(index_name, generation)`` of indexes whose last op by ``pos`` is a create; repeated rows don't matter."""
    last = meta.where("pos is not null and index_name is not null").groupBy("index_name").agg(F.max("pos").alias("pos"))
    kinds = meta.select("index_name", "pos", F.lower(F.trim("kind")).alias("kind")).distinct()
    return kinds.join(last, ["index_name", "pos"]).where("kind = 'create'").select("index_name", F.col("pos").alias("generation")).distinct()


def applied_positions(oplog: DataFrame) -> DataFrame:
    """``(index_name, generation, applied)``: the greatest feed position of a commit that isn't torn."""
    return oplog.where("crc_ok").groupBy("index_name", "generation").agg(F.coalesce(F.max("version"), F.lit(0)).alias("applied"))


def oplog_changes(oplog: DataFrame) -> DataFrame:
    """One row per change of every commit that isn't torn, with its place in the commit."""
    whole = oplog.where("crc_ok and changes is not null")
    return whole.select("index_name", "generation", F.col("id").alias("commit_id"), F.coalesce("version", "id").alias("version"), F.posexplode("changes").alias("ordinal", "change"))
