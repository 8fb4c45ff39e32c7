"""Follow a lineage's data feed with Structured Streaming and apply it to an index.

The stream only tells that files have arrived: it takes them by their write times, which aren't
the order of the feed. What is applied are the feed's files after the index's version, in order of
their positions; each step of some files becomes one commit whose version is its last position.
Entries at or below the index's version are skipped, so a batch that runs again after a failure
changes nothing: the position is the index's own version, stored with the data in the same commit.
"""

from __future__ import annotations

import threading
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hashloom import errors
from hashloom.functions.ints import U32_MAX
from hashloom.index import Index
from hashloom.sources.feed import BATCH, ENTRY, FLAT, Feed
from hashloom.sources.remote import RemoteFeed

READ_YOUR_WRITES_S = 30.0


def valid_changes(rows: DataFrame) -> DataFrame:
    """Entries an index can apply; an entry with an invalid id still moves the position."""
    return rows.where(f"entries is not null or (id is not null and id between 1 and {U32_MAX})")


def apply_entries(index: Index, rows: DataFrame) -> int:
    """Apply ``(seq, op, id, hashes, entries)`` above the index's version as one commit; returns the version.

    Entries that would leave a position out are refused as a whole, since later ones would then never be applied.
    """
    version = index.version
    fresh = rows.where(F.col("seq") > version).dropDuplicates(["seq"])
    found = fresh.agg(F.max("seq").alias("last"), F.count("seq").alias("n")).first()
    if found.last is None:
        return version
    if found.last - version != found.n:
        raise errors.FeedGap(f"{found.n} entries between {version} and {found.last}")
    changes = valid_changes(fresh).select(F.col("seq").alias("ordinal"), "op", "id", "hashes", "entries")
    return index.update_frame(changes, version=found.last)


class Consumer:
    """A streaming query over one lineage's feed."""

    def __init__(self, spark: SparkSession, feed: Feed, index: Index, checkpoint: str, files_per_batch: int = 100) -> None:
        self.spark, self.feed, self.index, self.checkpoint, self.files_per_batch = spark, feed, index, checkpoint, files_per_batch
        self.query = None

    def _stream(self) -> DataFrame:
        folder = self.feed.folder(self.index.name, self.index.generation)
        reader = self.spark.readStream.schema(ENTRY).option("maxFilesPerTrigger", self.files_per_batch).option("pathGlobFilter", "*.json")
        return reader.json(folder)

    def _batch(self, _rows: DataFrame | None = None, _: int = 0) -> None:
        name, generation = self.index.name, self.index.generation
        if self.index.version < self.feed.floor(name, generation):
            raise errors.BelowRetention(f"at {self.index.version}")
        while paths := self.feed.next_files(name, generation, self.index.version, self.files_per_batch):
            apply_entries(self.index, self.feed.flat(paths))
            if self.index.needs_checkpoint():
                self.index.maintain()

    def start(self, every: str = "1 second"):
        # A stream that has seen all files says nothing, also where the index was set back to a snapshot since.
        self._batch()
        self.query = self._writer().trigger(processingTime=every).start()
        return self.query

    def catch_up(self, timeout_s: float = 300) -> int:
        """Apply all that is there, then stop; returns the version."""
        self.query = self._writer().trigger(availableNow=True).start()
        if not self.query.awaitTermination(timeout_s):
            self.query.stop()
            raise errors.ReplicationTimeout(self.index.name)
        self._batch()
        return self.index.version

    def _writer(self):
        return self._stream().writeStream.foreachBatch(self._batch).option("checkpointLocation", self.checkpoint)

    def stop(self) -> None:
        if self.query is not None:
            self.query.stop()
            self.query = None

    def wait(self, version: int, timeout_s: float = READ_YOUR_WRITES_S) -> None:
        """Return once the index has applied ``version``."""
        end = time.monotonic() + timeout_s
        while self.index.version < version:
            if time.monotonic() > end:
                raise errors.ReplicationTimeout(f"{version} isn't applied after {timeout_s} s")
            time.sleep(0.05)


class PollingConsumer:
    """As ``Consumer``, for a feed behind HTTP: each page of at most 256 entries is one commit."""

    def __init__(self, spark: SparkSession, feed: RemoteFeed, index: Index) -> None:
        self.spark, self.feed, self.index = spark, feed, index
        self._stopped = threading.Event()
        self._thread: threading.Thread | None = None

    def step(self, timeout_s: float = 0) -> bool:
        """Apply the next page; False if there was none in time."""
        rows = self.feed.wait_page(self.index.name, self.index.generation, self.index.version, BATCH, timeout_s)
        if rows:
            apply_entries(self.index, self.spark.createDataFrame(rows, FLAT))
            if self.index.needs_checkpoint():
                self.index.maintain()
        return bool(rows)

    def catch_up(self, timeout_s: float = 300) -> int:
        end = time.monotonic() + timeout_s
        while self.step():
            if time.monotonic() > end:
                raise errors.ReplicationTimeout(self.index.name)
        return self.index.version

    def start(self, retry_s: float = 1.0) -> None:
        def loop() -> None:
            while not self._stopped.is_set():
                try:
                    self.step(1.0)
                except errors.BelowRetention:
                    return
                except errors.EngineError:
                    # Nothing was applied, so the same page is read again.
                    self._stopped.wait(retry_s)

        self._thread = threading.Thread(target=loop, daemon=True)
        self._thread.start()

    def stop(self) -> None:
        self._stopped.set()
        if self._thread is not None:
            self._thread.join(30)

    wait = Consumer.wait
