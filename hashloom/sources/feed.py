"""Ordered feeds in a folder: the meta feed of index creations and deletions, and one data feed for each lineage.

A batch of entries is one file named by its first and last position and appears by an
atomic rename, so Structured Streaming can follow the folder, and readers never see part
of a batch. Positions start at 1, one for each operation.
"""

from __future__ import annotations

import json
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hashloom import errors
from hashloom.operators.changelog import DEFAULT_ENTRIES, appended, read_after
from hashloom.operators.state import newest
from hashloom.sources import files
from hashloom.sources.oplog import CHANGE

ENTRY = f"seq bigint, change {CHANGE}"
FLAT = "seq bigint, op string, id bigint, hashes array<bigint>, entries map<string,string>"
BATCH = 256
IDLE_RETRY_MS = 1000


class Feed:
    def __init__(self, spark: SparkSession, root: str, read_only: bool = False) -> None:
        self.spark, self.root, self.read_only = spark, root.rstrip("/"), read_only
        self._lock = threading.RLock()

    # Meta feed

    def _meta(self) -> list[dict]:
        """All operations, in order; a few for each index ever created."""
        return [files.read_json(self.spark, f"{self.root}/meta/{n}") for n in files.names(self.spark, f"{self.root}/meta") if n.endswith(".json")]

    def read_meta(self, after: int = 0, most: int = DEFAULT_ENTRIES) -> list[dict]:
        return [op for op in self._meta() if op["pos"] > after][:most]

    def meta_frame(self) -> DataFrame:
        return self.spark.createDataFrame([(o["pos"], o["kind"], o["index_name"]) for o in self._meta()], "pos bigint, kind string, index_name string")

    def _last(self, name: str) -> dict | None:
        return next((op for op in reversed(self._meta()) if op["index_name"] == name), None)

    def _add_meta(self, kind: str, name: str) -> int:
        pos = len(self._meta()) + 1
        files.write_json(self.spark, f"{self.root}/meta/{pos:016x}.json", {"pos": pos, "kind": kind, "index_name": name})
        return pos

    def create_index(self, name: str) -> int:
        """The active generation, or a new one: the position of the create."""
        with self._lock:
            last = self._last(name)
            if last and last["kind"] == "create":
                return last["pos"]
            self._writable()
            return self._add_meta("create", name)

    def delete_index(self, name: str) -> int:
        """Position of the delete; of the last operation (0 if none) when the index isn't active."""
        with self._lock:
            last = self._last(name)
            if last is None or last["kind"] == "delete":
                return last["pos"] if last else 0
            self._writable()
            return self._add_meta("delete", name)

    # Data feeds

    def folder(self, name: str, generation: int) -> str:
        return f"{self.root}/data/{name}/{generation}"

    def _writable(self) -> None:
        if self.read_only:
            raise errors.FeedIsReadOnly(self.root)

    def _batches(self, name: str, generation: int) -> list[tuple[int, int, str]]:
        folder = self.folder(name, generation)
        return [(int(n[:16], 16), int(n[17:33], 16), f"{folder}/{n}") for n in files.names(self.spark, folder) if n.endswith(".json") and len(n) == 38]

    def position(self, name: str, generation: int) -> int:
        return max((last for _, last, _ in self._batches(name, generation)), default=0)

    def append(self, name: str, generation: int, changes: list[dict], expected: int | None = None) -> int:
        """Append a batch at once; returns the last position, also for an empty batch."""
        self._writable()
        with self._lock:
            last = self.position(name, generation)
            if expected is not None and expected != last:
                raise errors.VersionMismatch(f"at {last}, not {expected}")
            if not changes:
                return last
            lines = "".join(json.dumps({"seq": last + i, "change": c}) + "\n" for i, c in enumerate(changes, 1))
            end = last + len(changes)
            files.write_text(self.spark, f"{self.folder(name, generation)}/{last + 1:016x}-{end:016x}.json", lines)
            return end

    def append_frame(self, name: str, generation: int, changes: DataFrame, order: str) -> int:
        """Append a DataFrame ``(op, id, hashes, entries, <order>)`` of any size in its order; returns the last position.

        Spark writes the files; each is then renamed to the positions it holds, in order, so a reader
        always sees a prefix of the batch.
        """
        self._writable()
        with self._lock:
            last = self.position(name, generation)
            rows = appended(changes, last, order).select("seq", F.struct("op", "id", "hashes", "entries").alias("change"))
            temp = f"{self.root}/tmp-{uuid.uuid4().hex}"
            rows.repartitionByRange("seq").sortWithinPartitions("seq").write.json(temp)
            written = self.spark.read.schema(ENTRY).json(temp).groupBy(F.input_file_name().alias("file")).agg(F.min("seq").alias("first"), F.max("seq").alias("last"))
            for row in written.orderBy("first").collect():
                files.rename(self.spark, f"{temp}/{row.file.rsplit('/', 1)[1]}", f"{self.folder(name, generation)}/{row.first:016x}-{row.last:016x}.json")
                last = row.last
            files.delete(self.spark, temp)
            return last

    def floor(self, name: str, generation: int) -> int:
        return (files.read_json(self.spark, f"{self.root}/floors/{name}-{generation}.json") or {"floor": 0})["floor"]

    def truncate(self, name: str, generation: int, floor: int) -> None:
        """Entries up to ``floor`` may no longer be read one by one; their files stay for bootstraps."""
        files.write_json(self.spark, f"{self.root}/floors/{name}-{generation}.json", {"floor": max(floor, self.floor(name, generation))})

    def entries(self, name: str, generation: int, after: int = 0) -> DataFrame:
        """``(seq, op, id, hashes, entries)`` above ``after``; only files that reach above it are read."""
        if after < self.floor(name, generation):
            raise errors.BelowRetention(f"{after} is below {self.floor(name, generation)}")
        return self.flat([path for _, last, path in self._batches(name, generation) if last > after]).where(F.col("seq") > after)

    def next_files(self, name: str, generation: int, after: int, most: int) -> list[str]:
        """At most ``most`` files that go on from ``after`` without a gap, in order of their positions, whatever their write times.

        Files appear in order, so one that a first listing missed while a later one was there is in the second; else it is lost.
        """
        for _ in range(2):
            found, at = [], after
            for first, last, path in sorted(b for b in self._batches(name, generation) if b[1] > after):
                if first > at + 1 or len(found) == most:
                    break
                if last > at:
                    found.append(path)
                    at = last
            else:
                return found
            if found:
                return found
        raise errors.FeedGap(f"{name} goes on at {first}, but {at + 1} is missing")

    def flat(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], FLAT)
        return self.spark.read.schema(ENTRY).json(paths).select("seq", "change.op", "change.id", "change.hashes", "change.entries")

    def read(self, name: str, generation: int, after: int = 0, most: int = DEFAULT_ENTRIES) -> list[dict]:
        """One page of entries in order."""
        rows = read_after(self.entries(name, generation, after), after, most).collect()
        return [{"seq": r.seq, "op": r.op, "id": r.id, "hashes": r.hashes, "entries": r.entries} for r in rows]

    def retry_after_ms(self, found: int, most: int) -> int:
        return 0 if found == most else IDLE_RETRY_MS

    def bootstrap(self, name: str, generation: int) -> tuple[int, DataFrame]:
        """(position, the lineage's content as inserts and metadata ``(ordinal, op, id, hashes, entries)``), whatever the retention."""
        position = self.position(name, generation)
        rows = self.flat([path for first, _, path in self._batches(name, generation) if first <= position]).where(F.col("seq") <= position)
        docs = newest(rows.withColumn("commit_id", F.col("seq")).withColumn("ordinal", F.lit(0))).where("kind = 'i'")
        content = docs.select(F.col("seq").alias("ordinal"), "op", "id", "hashes", "entries")
        metadata = rows.where("entries is not null").select(F.col("seq").alias("ordinal"), "op", "id", "hashes", "entries")
        return position, content.unionByName(metadata)
