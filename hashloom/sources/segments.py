"""Immutable Parquet segments: ``docs (id, alive, commit_id, version)`` sorted by id and ``postings (hash, id, n, commit_id)`` sorted by hash.

Range partitions sorted by hash give every row group narrow hash statistics, which stand
in for a block index when few hashes are looked up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from hashloom.errors import CorruptSegment
from hashloom.sources import files

DOCS = "id bigint, alive boolean, commit_id bigint, version bigint"
POSTINGS = "hash bigint, id bigint, n bigint, commit_id bigint"


def segment_name(commit_id: int, merges: int) -> str:
    return f"{commit_id:016x}-{merges:08x}.data"


#: A segment of at most so many items is sorted and written by one task.
ONE_TASK_ITEMS = 500_000


def write_segment(spark: SparkSession, folder: str, info: dict, docs: DataFrame, postings: DataFrame, items: int) -> dict:
    """Write a segment whose ``info`` has commit_id, merges, version and metadata; returns the info with counts, taken while it is written.

    ``items``: an upper bound of the postings' multiplicities. ``info.json`` is written last: a folder without it is no segment.
    """
    name = segment_name(info["commit_id"], info["merges"])
    path = f"{folder}/{name}"
    files.delete(spark, path)
    counted, summed = Observation(), Observation()
    docs = docs.select("id", "alive", "commit_id", "version")
    docs = docs.coalesce(1) if items <= ONE_TASK_ITEMS else docs.repartitionByRange("id")
    docs.sortWithinPartitions("id").observe(counted, F.count(F.lit(1)).alias("n"), F.min("id").alias("least"), F.max("id").alias("most")).write.parquet(f"{path}/docs")
    rows = postings.select("hash", "id", "n", "commit_id")
    rows = rows.repartition(1) if items <= ONE_TASK_ITEMS else rows.repartitionByRange("hash", "id")
    rows.sortWithinPartitions("hash", "id").observe(summed, F.sum("n").alias("n")).write.parquet(f"{path}/postings")
    whole = info | {
        "name": name, "num_docs": counted.get["n"], "num_items": summed.get["n"] or 0, "min_doc_id": counted.get["least"] or 0, "max_doc_id": counted.get["most"] or 0,
    }
    files.write_json(spark, f"{path}/info.json", whole)
    return whole


def check_segment(spark: SparkSession, folder: str, info: dict) -> None:
    if files.read_json(spark, f"{folder}/{info['name']}/info.json") != info:
        raise CorruptSegment(f"{info['name']} doesn't hold what the manifest says")


def read_docs(spark: SparkSession, folder: str, infos: list[dict]) -> DataFrame:
    paths = [f"{folder}/{i['name']}/docs" for i in infos]
    return spark.read.schema(DOCS).parquet(*paths) if paths else spark.createDataFrame([], DOCS)


def read_postings(spark: SparkSession, folder: str, infos: list[dict]) -> DataFrame:
    paths = [f"{folder}/{i['name']}/postings" for i in infos]
    return spark.read.schema(POSTINGS).parquet(*paths) if paths else spark.createDataFrame([], POSTINGS)
