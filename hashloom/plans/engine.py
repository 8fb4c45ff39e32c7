"""Queries that go through the engine's own storage: log, segments, snapshots and the streaming consumer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hashloom.catalog import Catalog
from hashloom.index import Index, restore_snapshot
from hashloom.plans import fixtures as fx
from hashloom.plans.searches import ORACLES as SEARCHES
from hashloom.plans.searches import hour_queries
from hashloom.runtime import new_folder
from hashloom.sources.feed import Feed
from hashloom.streaming.consumer import Consumer

_ENTRIES = "cast(null as map<string,string>) as entries"
#: The event log is written as so many commits.
PARTS = 3


def _filled(spark: SparkSession, sf_dir: str, folder: str) -> Index:
    """An index with the event log in a few commits, of which some are checkpointed and merged and the last is still logged."""
    index = Index(spark, folder)
    changes = fx.event_changes(spark, sf_dir).selectExpr("ordinal", "op", "id", "hashes", _ENTRIES)
    last = changes.agg(F.max("ordinal")).first()[0] or 0
    step = -(-last // PARTS) or 1
    for part in range(PARTS):
        index.update_frame(changes.where(F.col("ordinal").between(part * step + 1, (part + 1) * step)))
        if part < PARTS - 1:
            index.checkpoint(force=True)
    index.merge(0, 2)
    return index


def _searched(index: Index) -> DataFrame:
    return index.search_batch(hour_queries(index.spark)).select("query_id", "id", "score")


def checkpoint_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search over live state, through log, checkpoints, a merge and a restart."""
    folder = new_folder(spark, "roundtrip")
    _filled(spark, sf_dir, folder)
    return _searched(Index(spark, folder))


def snapshot_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search over live state, on a node restored from another's snapshot."""
    folder = new_folder(spark, "donor")
    index = _filled(spark, sf_dir, f"{folder}/one")
    index.checkpoint(force=True)
    index.export_snapshot(f"{folder}/snapshot")
    restore_snapshot(spark, f"{folder}/snapshot", f"{folder}/two", index.generation)
    return _searched(Index(spark, f"{folder}/two"))


def stream_apply_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents after a streaming consumer applied the whole feed."""
    folder = new_folder(spark, "stream")
    feed, catalog = Feed(spark, f"{folder}/feed"), Catalog(spark, f"{folder}/node")
    catalog.create("events", generation=1)
    index = catalog.get("events")
    feed.append_frame("events", 1, fx.event_changes(spark, sf_dir).selectExpr("ordinal", "op", "id", "hashes", _ENTRIES), "ordinal")
    Consumer(spark, feed, index, f"{folder}/checkpoint", files_per_batch=2).catch_up()
    return index.reader().newest().select("id", (~F.col("alive")).alias("deleted"))


QUERIES = {"checkpoint_roundtrip": checkpoint_roundtrip, "snapshot_roundtrip": snapshot_roundtrip, "stream_apply_state": stream_apply_state}
ORACLES = {
    "checkpoint_roundtrip": SEARCHES["search_live_state"],
    "snapshot_roundtrip": SEARCHES["search_live_state"],
    "stream_apply_state": "SELECT user_id + 1 AS id, arg_max(event_type, event_id) = 'error' AS deleted FROM events GROUP BY 1",
}
