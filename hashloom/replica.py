"""A node that follows the feeds: indexes by the meta feed, their content by snapshots, corpus streams and replay."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import SparkSession

from hashloom import errors
from hashloom.catalog import Catalog
from hashloom.index import Index, read_snapshot_header
from hashloom.operators.changelog import folded_meta, ranked_donors, stale
from hashloom.runtime import new_folder, scratch
from hashloom.sources import files
from hashloom.sources.feed import Feed
from hashloom.sources.remote import RemoteFeed
from hashloom.streaming.consumer import Consumer, PollingConsumer


@dataclass(frozen=True)
class Peer:
    """Another node as a donor of snapshots; here a catalog in reach, by whatever transport."""

    base_url: str
    catalog: Catalog

    def probe(self, name: str) -> tuple:
        try:
            status = self.catalog.get(name).status()
        except errors.EngineError:
            return (self.base_url, 0, 0, False)
        return (self.base_url, status["generation"], status["file_version"], True)

    def snapshot(self, name: str, spark: SparkSession, target: str) -> dict:
        """Copy a fresh snapshot to ``target``; returns its header."""
        return self.catalog.get(name).export_snapshot(target)


class Replica:
    def __init__(self, spark: SparkSession, catalog: Catalog, feed: Feed | RemoteFeed, peers: list | None = None) -> None:
        self.spark, self.catalog, self.feed, self.peers = spark, catalog, feed, peers or []
        self.consumers: dict[str, Consumer | PollingConsumer] = {}
        self.parked: dict[str, dict] = {}
        self.meta_position = 0

    # Meta feed

    def catch_up_meta(self) -> None:
        """Fold the whole meta feed: drop what it has no active lineage of, create what it has."""
        ops = self.feed.meta_frame()
        folded = folded_meta(ops)
        local = self.spark.createDataFrame([(n,) for n in self.catalog.names()], "index_name string")
        for row in stale(local, folded).collect():
            self._drop(row.index_name)
        for row in folded.where("active").collect():
            self._apply_meta({"pos": row.generation, "kind": "create", "index_name": row.index_name})
        self.meta_position = max((o["pos"] for o in self.feed.read_meta(0, 10**9)), default=0)

    def follow_meta(self) -> int:
        """Apply new operations; one that fails is parked and tried again next time, without holding up others."""
        for op in list(self.parked.values()):
            self._try_meta(op)
        for op in self.feed.read_meta(self.meta_position):
            self._try_meta(op)
            self.meta_position = op["pos"]
        return self.meta_position

    def _try_meta(self, op: dict) -> None:
        try:
            self._apply_meta(op)
        except errors.EngineError:
            self.parked[op["index_name"]] = op
        else:
            self.parked.pop(op["index_name"], None)

    def _drop(self, name: str) -> None:
        self.remove_consumer(name)
        generation = self.catalog.get(name).generation if self.catalog.exists(name) else None
        self.catalog.delete(name)
        if generation is not None:
            files.delete(self.spark, self._offsets(name, generation))

    def _apply_meta(self, op: dict) -> None:
        name = op["index_name"]
        if op["kind"] == "delete":
            self._drop(name)
            return
        if self.catalog.exists(name) and self.catalog.get(name).generation != op["pos"]:
            self._drop(name)
        self.catalog.create(name, generation=op["pos"])
        self.add_consumer(name)

    # Consumers

    def add_consumer(self, name: str) -> Consumer | PollingConsumer:
        """One consumer for each name; adding it again changes nothing."""
        index = self.catalog.get(name)
        held = self.consumers.get(name)
        if held is None or held.index is not index:
            self.remove_consumer(name)
            if isinstance(self.feed, RemoteFeed):
                held = PollingConsumer(self.spark, self.feed, index)
            else:
                held = Consumer(self.spark, self.feed, index, self._offsets(name, index.generation))
            self.consumers[name] = held
        return held

    def _offsets(self, name: str, generation: int) -> str:
        """Where the stream of a lineage keeps what files it has seen: beside the lineage, for the next start."""
        return f"{self.catalog.folder(name, generation)}.stream"

    def remove_consumer(self, name: str) -> None:
        held = self.consumers.pop(name, None)
        if held is not None:
            held.stop()

    def sync(self, name: str) -> int:
        """Seed an empty index, restore one below the retention floor, then apply what the feed has."""
        index = self.catalog.get(name)
        if isinstance(self.feed, RemoteFeed):
            try:
                return self.add_consumer(name).catch_up()
            except errors.BelowRetention:
                if index.version == 0:
                    self.seed(name)
                else:
                    self.restore_from_peer(name, index.version, 0)
                return self.add_consumer(name).catch_up()
        floor = self.feed.floor(name, index.generation)
        if index.version == 0 and (floor or self.peers):
            self.seed(name)
        elif index.version < floor:
            self.restore_from_peer(name, index.version, floor)
        if not self.feed.position(name, self.catalog.get(name).generation):
            return self.catalog.get(name).version
        return self.add_consumer(name).catch_up()

    # Bootstrap

    def donors(self, name: str, generation: int, after: int) -> list[str]:
        if not self.peers:
            return []
        with ThreadPoolExecutor(max_workers=min(len(self.peers), 64)) as pool:
            found = list(pool.map(lambda p: p.probe(name), self.peers))
        probes = self.spark.createDataFrame(found, "base_url string, generation bigint, file_version bigint, ok boolean")
        return [r.base_url for r in ranked_donors(probes, generation, after).orderBy("rank").collect()]

    def restore_from_peer(self, name: str, after: int, floor: int) -> Index:
        """Take the freshest donor's snapshot; if even that is below the floor, none helps."""
        index = self.catalog.get(name)
        by_url = {p.base_url: p for p in self.peers}
        self.catalog.set_loading(name, True)
        try:
            for url in self.donors(name, index.generation, after):
                with scratch(self.spark):
                    target = new_folder(self.spark, f"snapshot-{name}")
                    try:
                        # Only the transfer has a deadline; the install below always runs to its end.
                        header = by_url[url].snapshot(name, self.spark, target)
                    except (OSError, errors.EngineError):
                        continue
                    if max((i["version"] if i["version"] is not None else i["commit_id"] + i["merges"] for i in header["segments"]), default=0) < floor:
                        break  # the freshest is below the floor, so are all others
                    read_snapshot_header(self.spark, target)
                    self.remove_consumer(name)
                    return self.catalog.restore(name, index.generation, target)
        finally:
            self.catalog.set_loading(name, False)
        raise errors.BelowRetention(f"no donor of {name} reaches {floor}")

    def seed(self, name: str) -> Index:
        """Fill an empty index: a peer's snapshot, else the feed's corpus, else nothing (replay from 0)."""
        index = self.catalog.get(name)
        floor = 0 if isinstance(self.feed, RemoteFeed) else self.feed.floor(name, index.generation)
        try:
            return self.restore_from_peer(name, 0, floor)
        except errors.BelowRetention:
            pass
        position, content = self.feed.bootstrap(name, index.generation)
        if not position:
            return index
        self.catalog.set_loading(name, True)
        try:
            self.remove_consumer(name)
            return self.catalog.install_built(name, index.generation, lambda staged: staged.update_frame(content, version=position))
        finally:
            self.catalog.set_loading(name, False)

    # Writes

    def update(self, name: str, changes: list[dict], expected_version: int | None = None) -> int:
        """Append to the feed, then apply up to it, so that the writer reads its own write; pinned to the lineage."""
        index = self.catalog.get(name)
        position = self.feed.append(name, index.generation, changes, expected_version)
        self.sync(name)
        if self.catalog.get(name, index.generation).version < position:
            raise errors.ReplicationTimeout(name)
        return position

    def create_index(self, name: str, generation: int | None = None) -> dict:
        if generation is not None:
            raise errors.GenerationNotAllowed("the feed gives generations")
        made = self.feed.create_index(name)
        self.follow_meta()
        index = self.catalog.get(name, made)
        return {"version": index.version, "ready": self.catalog.health(name) == "ready", "generation": made}

    def delete_index(self, name: str) -> dict:
        existed = self.catalog.exists(name)
        self.feed.delete_index(name)
        self.follow_meta()
        return {"deleted": existed}
