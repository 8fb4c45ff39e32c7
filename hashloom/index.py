"""One index lineage: log, segments, snapshots, search and maintenance.

A write is one commit in the log (its rename is the commit point); a checkpoint turns
logged commits into a Parquet segment and publishes it by replacing the manifest. Readers
hold the manifest and the logged commits they started with, so a search never sees half a change;
files that a reader of this process may use, commits as well as segments, are only removed by ``vacuum`` once
no reader holds them.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hashloom import errors
from hashloom.functions.ints import U32_MAX, u32_bag
from hashloom.functions.msgpack import pack, unpack_first
from hashloom.metrics import Metrics
from hashloom.operators.feeds import op_kind
from hashloom.operators.search import MOST_TIMEOUT_MS, SearchOptions, batch, counted_postings, ranked
from hashloom.operators.state import metadata_state
from hashloom.plans.merge_policy import TieredPolicy
from hashloom.runtime import scratch, stage
from hashloom.sources import files, segments
from hashloom.sources.oplog import Oplog


SNAPSHOT_FORMAT = 1
#: Logged items, hashes and changes, that are also kept in memory.
MEMORY_ITEMS = 200_000
#: Hashes of one query that are pushed into the scan one by one.
MOST_PUSHED = 1000


@dataclass(frozen=True)
class IndexOptions:
    """Checkpoint after so many logged items or milliseconds (0: never by age); how many logged commits a search reads before they are folded."""

    checkpoint_threshold: int = 100_000
    checkpoint_age_ms: int = 60_000
    most_logged_commits: int = 16
    #: Of so many searches, one counts the documents scanned for each of its hashes; 0: none.
    scan_metrics_every: int = 100
    policy: TieredPolicy = field(default_factory=TieredPolicy)


def insert(doc_id: int, hashes: Iterable[int]) -> dict:
    return {"op": "insert", "id": doc_id, "hashes": list(hashes), "entries": None}


def delete(doc_id: int) -> dict:
    return {"op": "delete", "id": doc_id, "hashes": None, "entries": None}


def set_metadata(entries: dict[str, str]) -> dict:
    return {"op": "set_metadata", "id": None, "hashes": None, "entries": dict(entries)}


@dataclass(frozen=True)
class MemorySegment:
    """One logged commit in the driver's memory: the last operation on each id, and its postings by hash."""

    commit_id: int
    version: int
    #: Is the document alive?
    docs: dict[int, bool]
    postings: dict[int, list[tuple[int, int]]]

    @staticmethod
    def of(commit_id: int, version: int | None, changes: list[dict]) -> MemorySegment:
        last = {c["id"]: c for c in changes if c["op"] != "set_metadata"}
        postings: dict[int, list[tuple[int, int]]] = {}
        for change in last.values():
            if change["op"] == "insert":
                for h, n in Counter(change["hashes"]).items():
                    postings.setdefault(h, []).append((change["id"], n))
        return MemorySegment(commit_id, commit_id if version is None else version, {i: c["op"] == "insert" for i, c in last.items()}, postings)


class Reader:
    """An immutable view: the segments of one manifest and the log up to one commit."""

    def __init__(self, index: Index) -> None:
        self.index, self._open = index, True
        with index._lock:
            self.infos, self.commit_id, self.file_commit_id = list(index.infos), index.commit_id, index.file_commit_id
            #: All logged commits, the oldest first; None if some aren't in memory.
            self.memory: tuple[MemorySegment, ...] | None = index._memory
            self._held = [i["name"] for i in self.infos] + list(range(self.file_commit_id + 1, self.commit_id + 1))
            index._leases.update(self._held)
            self.stored_docs, self._stored_postings = index._stored(self.infos)

    @cached_property
    def logged(self) -> DataFrame | None:
        """Changes of the logged commits."""
        return self.index.oplog.read(self.file_commit_id, self.commit_id) if self.commit_id > self.file_commit_id else None

    def close(self) -> None:
        with self.index._lock:
            if self._open:
                self.index._leases.subtract(self._held)
            self._open = False

    def __enter__(self) -> Reader:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def _logged_docs(self) -> DataFrame | None:
        """The last operation on each id in each logged commit."""
        if self.logged is None:
            return None
        ops = self.logged.withColumn("kind", op_kind(F.col("op"))).where("kind in ('i', 'd')")
        last = Window.partitionBy("commit_id", "id").orderBy(F.desc("ordinal"))
        return ops.withColumn("_r", F.row_number().over(last)).where("_r = 1").withColumn("version", F.coalesce("version", "commit_id"))

    def docs(self) -> DataFrame:
        """``(id, alive, commit_id, version)`` of all segments and logged commits."""
        fresh = self._logged_docs()
        return self.stored_docs if fresh is None else self.stored_docs.unionByName(fresh.selectExpr("id", "kind = 'i' AS alive", "commit_id", "version"))

    def postings(self) -> DataFrame:
        """``(hash, id, n, commit_id)``."""
        fresh = self._logged_docs()
        return self._stored_postings if fresh is None else self._stored_postings.unionByName(counted_postings(fresh.where("kind = 'i'"), "commit_id").select("hash", "id", "n", "commit_id"))

    def metadata_entries(self) -> DataFrame:
        """``(commit_id, ordinal, key, value)``: folded metadata of segments and of logged commits."""
        rows = [(i["commit_id"] + i["merges"], -1, k, v) for i in self.infos for k, v in i["metadata"].items()]
        stored = self.index.spark.createDataFrame(rows, "commit_id bigint, ordinal bigint, key string, value string")
        if self.logged is None:
            return stored
        fresh = self.logged.where("entries is not null").select("commit_id", "ordinal", F.explode("entries").alias("key", "value"))
        return stored.unionByName(fresh)

    def metadata(self) -> dict[str, str]:
        return {r.key: r.value for r in metadata_state(self.metadata_entries()).collect()}

    def newest(self, only: DataFrame | None = None) -> DataFrame:
        """``(id, alive, commit_id, version)``: the newest mention of each id, or of the ids in ``only``."""
        return _newest(self.docs() if only is None else self.docs().join(only.select("id").distinct(), "id", "left_semi"))

    def mention(self, doc_id: int) -> tuple[bool, int] | None:
        """(alive, version) of the newest mention of an id."""
        for segment in reversed(self.memory or ()):
            if doc_id in segment.docs:
                return segment.docs[doc_id], segment.version
        if self.memory is not None and not self.infos:
            return None
        docs = self.docs() if self.memory is None else self.stored_docs
        row = docs.where(f"id = {int(doc_id)}").agg(F.max_by(F.struct("alive", "version"), "commit_id").alias("d")).first().d
        return None if row is None else (row.alive, row.version)

    def live(self) -> DataFrame:
        return self.newest().where("alive").select("id", "version")

    def _current(self, hits: DataFrame, docs: DataFrame, sources: int) -> DataFrame:
        """Those of ``hits (id, commit_id, ...)`` that no newer commit of ``docs`` replaces or deletes."""
        if sources <= 1:
            return hits  # one segment holds an id once, and postings of live documents only
        current = _newest(docs.join(hits.select("id").distinct(), "id", "left_semi")).where("alive").select("id", "commit_id")
        return hits.join(current, ["id", "commit_id"], "left_semi")

    def _sources(self) -> int:
        return len(self.infos) + self.commit_id - self.file_commit_id

    def search(self, queries: DataFrame, options: SearchOptions | None = None) -> DataFrame:
        """Ranked ``(query_id, id, score, rank)`` of ``queries (query_id, hashes, ...)``.

        Hits are counted by segment; those a newer segment supersedes are dropped before
        the floor, the ranking and the limit, so they take no result's place.
        """
        asked = batch(queries, options or SearchOptions())
        hits = self.postings().join(asked.probe_rows("query_id"), "hash").groupBy("query_id", "id", "commit_id").agg(F.sum("n").cast("bigint").alias("score"))
        live = self._current(hits, self.docs(), self._sources()).join(asked.settings("query_id", "min_score"), "query_id")
        return ranked(live.where("score >= min_score").select("query_id", "id", "score"), asked)

    def matching(self, hashes: list[int], rows: DataFrame | None = None) -> DataFrame:
        """Postings of the hashes of one query; row groups without any of them aren't read if they are few."""
        rows = self.postings() if rows is None else rows
        if len(hashes) <= MOST_PUSHED:
            return rows.where(f"hash IN ({', '.join(map(str, hashes))})")
        return rows.join(F.broadcast(self.index.spark.createDataFrame([(h,) for h in hashes], "hash bigint")), "hash")

    def _remembered(self, hashes: list[int]) -> tuple[Counter[int], set[int]]:
        """(scores of the live documents in memory, all ids it mentions)."""
        scores, seen = Counter(), set()
        for segment in reversed(self.memory):
            for h in hashes:
                for i, n in segment.postings.get(h, ()):
                    if i not in seen:
                        scores[i] += n
            seen |= segment.docs.keys()
        return scores, seen

    def _best(self, hits: DataFrame, docs: DataFrame, sources: int, limit: int) -> list[tuple[int, int]]:
        """The best ``limit`` of ``hits (id, commit_id, score)`` that are current."""
        most = 2 * limit + 16
        order = F.desc("score"), F.asc("id"), F.desc("commit_id")
        if 1 < sources and most <= MOST_PUSHED:
            # Few documents are replaced, so the first hits mostly hold the best current ones: two small jobs, the second for a few ids.
            first = hits.orderBy(*order).limit(most).collect()
            if not first:
                return []
            named = docs.where(f"id IN ({', '.join(str(r.id) for r in first)})")
            alive = {(r.id, r.commit_id) for r in _newest(named).where("alive").select("id", "commit_id").collect()}
            kept = [(r.id, r.score) for r in first if (r.id, r.commit_id) in alive]
            if len(kept) >= limit or len(first) < most:
                return kept[:limit]
        found = self._current(hits, docs, sources).orderBy(*order).limit(limit).collect()
        return [(r.id, r.score) for r in found]

    def search_one(self, query: list[int], options: SearchOptions) -> list[tuple[int, int]]:
        """``(id, score)`` of one query in order, without staging: the driver holds the query anyway.

        The segments take one job, from which the best ``limit`` come back; commits in memory are scored in the driver.
        """
        limit, floor = options.bounds(len(query))
        hashes = sorted({h & U32_MAX for h in query})
        if not hashes or limit < 1:
            return []
        found: list[tuple[int, int]] = []
        if self.memory is None:
            hits, docs, sources, seen = self.matching(hashes), self.docs(), self._sources(), set()
        else:
            hits, docs, sources = self.matching(hashes, self._stored_postings), self.stored_docs, len(self.infos)
            scores, seen = self._remembered(hashes)
            found = [(i, n) for i, n in scores.items() if n >= floor]
        if sources:
            hits = hits.groupBy("id", "commit_id").agg(F.sum("n").alias("score")).where(f"score >= {floor}")
            if seen:
                hits = hits.where(f"id NOT IN ({', '.join(map(str, seen))})") if len(seen) <= MOST_PUSHED else hits.join(
                    F.broadcast(self.index.spark.createDataFrame([(i,) for i in seen], "id bigint")), "id", "left_anti"
                )
            found += self._best(hits, docs, sources, limit)
        found = sorted(found, key=lambda x: (-x[1], x[0]))[:limit]
        cut = max(floor, found[0][1] * options.score_pct // 100) if found else 0
        return [x for i, x in enumerate(found) if i == 0 or x[1] >= cut]


def _newest(docs: DataFrame) -> DataFrame:
    """``(id, alive, commit_id, version)`` of each id's newest mention."""
    return docs.groupBy("id").agg(F.max_by(F.struct("alive", "version"), "commit_id").alias("d"), F.max("commit_id").alias("commit_id")).select("id", "d.alive", "commit_id", "d.version")


class Index:
    def __init__(self, spark: SparkSession, path: str, generation: int = 1, name: str = "", options: IndexOptions | None = None, metrics: Metrics | None = None) -> None:
        self.spark, self.path, self.generation, self.name = spark, path.rstrip("/"), generation, name
        self.options, self.metrics = options or IndexOptions(), metrics or Metrics()
        self.data = f"{self.path}/data"
        self.oplog = Oplog(spark, f"{self.path}/oplog")
        self._lock, self._write = threading.RLock(), threading.RLock()
        #: Names of segments and ids of logged commits that readers hold.
        self._leases: Counter[str | int] = Counter()
        self._frames: dict[tuple, tuple[DataFrame, DataFrame]] = {}
        self._load()

    def _load(self) -> None:
        manifest = files.read_json(self.spark, f"{self.data}/manifest.json") or {"segments": []}
        infos = manifest["segments"]
        for info in infos:
            segments.check_segment(self.spark, self.data, info)
        file_commit = max((i["commit_id"] + i["merges"] for i in infos), default=0)
        versions = [i["version"] for i in infos if i["version"] is not None]
        tail = self.oplog.read(file_commit).agg(F.max("commit_id").alias("c"), F.max("version").alias("v")).first()
        with self._lock:
            self.infos, self.file_commit_id = infos, file_commit
            self.commit_id = max(file_commit, tail.c or 0)
            self.upstream = max([*versions, *([tail.v] if tail.v is not None else [])], default=None)
            self.logged_items, self.logged_since = 0, time.monotonic()
            self._memory: tuple[MemorySegment, ...] | None = () if self.commit_id == file_commit else None
        # Files of commits after a torn one were never acknowledged: their ids are used again.
        for torn in [c for c in self.oplog.commits() if c > self.commit_id]:
            files.delete(self.spark, f"{self.oplog.path}/{torn:016x}.xlog")

    def _stored(self, infos: list[dict]) -> tuple[DataFrame, DataFrame]:
        """(docs, postings) of segments; their files never change, so they are listed once."""
        names = tuple(i["name"] for i in infos)
        if names not in self._frames:
            if len(self._frames) > 8:
                self._frames.clear()
            self._frames[names] = segments.read_docs(self.spark, self.data, infos), segments.read_postings(self.spark, self.data, infos)
        return self._frames[names]

    # Watermarks

    @property
    def version(self) -> int:
        return self.commit_id if self.upstream is None else self.upstream

    @property
    def file_version(self) -> int:
        """The position a snapshot of this index stands at."""
        return max((i["version"] if i["version"] is not None else i["commit_id"] + i["merges"] for i in self.infos), default=0)

    def status(self) -> dict:
        return {"generation": self.generation, "version": self.version, "file_version": self.file_version}

    # Writes

    def _next(self, expected_version: int | None, version: int | None) -> int:
        if expected_version is not None and expected_version != self.version:
            raise errors.VersionMismatch(f"at {self.version}, not {expected_version}")
        if version is None and self.upstream is not None:
            raise errors.VersionRequired("this index follows a feed")
        if version is not None and self.upstream is not None and version < self.upstream:
            raise errors.VersionWentBackwards(f"{version} after {self.upstream}")
        return self.commit_id + 1

    def _committed(self, commit: int, version: int | None, items: int, changes: list[dict] | None = None) -> int:
        with self._lock:
            self.commit_id = commit
            if changes is None or self._memory is None or self.logged_items + items + len(changes) > MEMORY_ITEMS:
                self._memory = None  # read from the log until the next checkpoint
            else:
                self._memory = (*self._memory, MemorySegment.of(commit, version, changes))
            if version is not None:
                self.upstream = version
            if not self.logged_items:
                self.logged_since = time.monotonic()
            self.logged_items += items
        self.metrics.add("updates", self.name)
        return self.version

    def update(self, changes: list[dict], metadata: dict[str, str] | None = None, expected_version: int | None = None, version: int | None = None) -> int:
        """Commit one batch of ``insert``, ``delete`` and ``set_metadata``; returns the new version."""
        for change in changes:
            if change["op"] != "set_metadata":
                if not isinstance(change["id"], int) or not 1 <= change["id"] <= U32_MAX:
                    raise errors.InvalidFingerprintId(str(change["id"]))
                if change["op"] == "insert" and any(h is None or not 0 <= h <= U32_MAX for h in change["hashes"]):
                    raise errors.BadRequest("a hash is no unsigned 32-bit number")
        if metadata:
            changes = [*changes, set_metadata(metadata)]
        with self._write:
            commit = self._next(expected_version, version)
            if not self.oplog.append(commit, version, changes):
                raise errors.VersionMismatch(f"commit {commit} was taken by another writer")
            return self._committed(commit, version, sum(len(c["hashes"] or ()) for c in changes), changes)

    def update_frame(self, changes: DataFrame, expected_version: int | None = None, version: int | None = None) -> int:
        """Commit a DataFrame ``(ordinal, op, id, hashes, entries)`` as one batch, whatever its size."""
        wrong = (op_kind(F.col("op")) != "s") & (F.col("id").isNull() | ~F.col("id").between(1, U32_MAX))
        checks = changes.agg(F.count(F.when(wrong, 1)).alias("bad"), F.sum(F.coalesce(F.size("hashes"), F.lit(0))).alias("items")).first()
        if checks.bad:
            raise errors.InvalidFingerprintId(f"{checks.bad} changes")
        clean = changes.withColumn("hashes", u32_bag(F.col("hashes")))
        with self._write:
            commit = self._next(expected_version, version)
            if not self.oplog.append_frame(commit, version, clean):
                raise errors.VersionMismatch(f"commit {commit} was taken by another writer")
            return self._committed(commit, version, max(checks.items or 0, 0))

    def insert(self, doc_id: int, hashes: Iterable[int]) -> int:
        return self.update([insert(doc_id, hashes)])

    def delete(self, doc_id: int) -> int:
        return self.update([delete(doc_id)])

    # Reads

    def reader(self) -> Reader:
        return Reader(self)

    def get(self, doc_id: int) -> dict:
        """Version of a live document."""
        with self.reader() as r:
            found = r.mention(doc_id)
        if found is None or not found[0]:
            raise errors.FingerprintNotFound(str(doc_id))
        return {"version": found[1]}

    def exists(self, doc_id: int) -> bool:
        try:
            self.get(doc_id)
        except errors.FingerprintNotFound:
            return False
        return True

    def doc_info(self, doc_id: int) -> dict | None:
        with self.reader() as r:
            found = r.mention(doc_id)
        return None if found is None else {"version": found[1], "deleted": not found[0]}

    def search(self, query: Iterable[int], options: SearchOptions | None = None, timeout_ms: int = 0) -> list[dict]:
        """Ranked results of one query; the deadline cancels its Spark jobs (0: none)."""
        query = list(query)
        options = options or SearchOptions()
        began = time.monotonic()
        self.metrics.add("searches", self.name)
        with self.reader() as r:
            rows = self._in_time(lambda: r.search_one(query, options), min(timeout_ms, MOST_TIMEOUT_MS))
        self.metrics.add("search_hits" if rows else "search_misses", self.name)
        self.metrics.observe("search_duration_seconds", time.monotonic() - began, self.name)
        if self.metrics.due("scanned_docs_per_hash", self.options.scan_metrics_every):
            threading.Thread(target=self.observe_scan, args=(query,), daemon=True).start()
        return [{"id": i, "score": score} for i, score in rows]

    def observe_scan(self, query: list[int]) -> None:
        """Count the documents that each hash of a query leads to in each segment: a job of its own, so for some searches only."""
        hashes = sorted({h & U32_MAX for h in query})[:MOST_PUSHED]
        if not hashes:
            return
        try:
            with self.reader() as r:
                counts = r.matching(hashes).groupBy("hash", "commit_id").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("hashes")).collect()
        except Exception:  # noqa: BLE001: figures only, and the session may be ending
            return
        for row in counts:
            self.metrics.observe("scanned_docs_per_hash", row.n, self.name, row.hashes)

    def search_batch(self, queries: DataFrame, options: SearchOptions | None = None) -> DataFrame:
        """Results of many queries on the state of this moment: computed at once, staged, so that nothing stays held."""
        with scratch(self.spark) as keep, self.reader() as r:
            return keep(stage(r.search(queries, options), "results"))

    def _in_time(self, run, timeout_ms: int):
        if not timeout_ms:
            return run()
        tag = f"search-{uuid.uuid4().hex}"
        context, late = self.spark.sparkContext, threading.Event()

        def stop() -> None:
            late.set()
            context.cancelJobsWithTag(tag)

        timer = threading.Timer(timeout_ms / 1000, stop)
        context.addJobTag(tag)
        timer.start()
        try:
            return run()
        except Exception as e:
            if late.is_set():
                raise errors.SearchTimeout(f"{timeout_ms} ms") from e
            raise
        finally:
            timer.cancel()
            context.removeJobTag(tag)

    def info(self) -> dict:
        """Version, metadata and statistics; documents are summed over segments and logged commits."""
        with self.reader() as r:
            fresh = r._logged_docs()
            found = None
            commits = 0
            if fresh is not None:
                found = fresh.agg(F.count("*").alias("n"), F.min("id").alias("least"), F.max("id").alias("most")).first()
                commits = r.commit_id - max((i["commit_id"] + i["merges"] for i in r.infos), default=0)
            least = [i["min_doc_id"] for i in r.infos if i["min_doc_id"]] + ([found.least] if found and found.least else [])
            most = [i["max_doc_id"] for i in r.infos] + ([found.most] if found and found.most else [])
            docs = sum(i["num_docs"] for i in r.infos) + (found.n if found else 0)
            return {
                "version": self.version, "metadata": r.metadata(),
                "stats": {"min_doc_id": min(least, default=0), "max_doc_id": max(most, default=0), "num_segments": len(r.infos) + commits, "num_docs": docs},
            }

    # Maintenance

    def _publish(self, infos: list[dict], forget: bool = False) -> None:
        """``forget``: the new segments hold all logged commits."""
        files.write_json(self.spark, f"{self.data}/manifest.json", {"segments": infos})
        with self._lock:
            self.infos = infos
            self._memory = () if forget else self._memory
            self.file_commit_id = max((i["commit_id"] + i["merges"] for i in infos), default=0)

    def needs_checkpoint(self) -> bool:
        pending = self.commit_id - self.file_commit_id
        if not pending:
            return False
        old = self.options.checkpoint_age_ms and (time.monotonic() - self.logged_since) * 1000 >= self.options.checkpoint_age_ms
        return bool(self.logged_items >= self.options.checkpoint_threshold or old or pending > self.options.most_logged_commits)

    def checkpoint(self, force: bool = False) -> bool:
        """Fold all logged commits into one segment; returns whether there was one to write."""
        with self._write:
            if self.commit_id == self.file_commit_id or not (force or self.needs_checkpoint()):
                return False
            first, last = self.file_commit_id + 1, self.commit_id
            logged = self.oplog.read(self.file_commit_id, last)
            counted = logged.agg(F.max("version").alias("version"), F.sum(F.greatest(F.size("hashes"), F.lit(0))).alias("items"), F.count("entries").alias("entries")).first()
            ops = logged.withColumn("kind", op_kind(F.col("op"))).where("kind in ('i', 'd')")
            latest = Window.partitionBy("id").orderBy(F.desc("commit_id"), F.desc("ordinal"))
            docs = ops.withColumn("_r", F.row_number().over(latest)).where("_r = 1")
            metadata = {}
            if counted.entries:
                entries = logged.where("entries is not null").select("commit_id", "ordinal", F.explode("entries").alias("key", "value"))
                metadata = {x.key: x.value for x in metadata_state(entries).collect()}
            info = {"commit_id": first, "merges": last - first, "version": counted.version, "metadata": metadata}
            rows = docs.selectExpr("id", "kind = 'i' AS alive", f"{last}L AS commit_id", "coalesce(version, commit_id) AS version")
            items = counted_postings(docs.where("kind = 'i'")).selectExpr("hash", "id", "n", f"{last}L AS commit_id")
            written = segments.write_segment(self.spark, self.data, info, rows, items, counted.items or 0)
            self._publish([*self.infos, written], forget=True)
            self._drop_commits()
            self.logged_items = 0
            self.metrics.add("checkpoints")
            if last > first:
                # Each logged commit is a segment of its own to searches; the checkpoint makes one of them.
                self.metrics.add("memory_merges")
            return True

    def _drop_commits(self) -> int:
        """Delete the logged commits that segments cover and no reader holds."""
        with self._lock:
            return self.oplog.truncate(self.file_commit_id, {c for c, n in self._leases.items() if n > 0})

    def merge(self, first: int, end: int) -> dict:
        """Replace the segments ``first`` to ``end`` by one; documents any newer segment mentions are left out."""
        with self._write:
            parts, newer = self.infos[first:end], self.infos[end:]
            for a, b in zip(parts, parts[1:], strict=False):
                if a["commit_id"] + a["merges"] + 1 != b["commit_id"]:
                    raise errors.CorruptSegment("segments to merge must be neighbours")
            docs = segments.read_docs(self.spark, self.data, parts)
            latest = docs.groupBy("id").agg(F.max("commit_id").alias("commit_id"))
            if newer:
                latest = latest.join(segments.read_docs(self.spark, self.data, newer).select("id").distinct(), "id", "left_anti")
            last = parts[-1]["commit_id"] + parts[-1]["merges"]
            kept = docs.join(latest, ["id", "commit_id"], "left_semi").withColumn("commit_id", F.lit(last).cast("bigint"))
            items = segments.read_postings(self.spark, self.data, parts).join(latest, ["id", "commit_id"], "left_semi").withColumn("commit_id", F.lit(last).cast("bigint"))
            versions = [i["version"] for i in parts if i["version"] is not None]
            metadata: dict[str, str] = {}
            for part in parts:
                metadata |= part["metadata"]
            info = {"commit_id": parts[0]["commit_id"], "merges": last - parts[0]["commit_id"], "version": max(versions, default=None), "metadata": metadata}
            written = segments.write_segment(self.spark, self.data, info, kept, items, sum(i["num_items"] for i in parts))
            self._publish([*self.infos[:first], written, *newer])
            self.metrics.add("file_merges")
            return written

    def maintain(self, force: bool = False) -> None:
        """Checkpoint if due (always with ``force``), then merge while the policy asks for it."""
        self.checkpoint(force)
        while chosen := self.options.policy.choose([i["num_items"] + i["num_docs"] for i in self.infos]):
            self.merge(*chosen)

    def vacuum(self) -> int:
        """Delete segment folders that neither the manifest nor a reader holds, and commits that segments cover; returns how many folders."""
        with self._write, self._lock:
            held = {i["name"] for i in self.infos} | {n for n, c in self._leases.items() if c > 0}
            old = [n for n in files.names(self.spark, self.data) if n.endswith(".data") and n not in held]
            for name in old:
                files.delete(self.spark, f"{self.data}/{name}")
            self._drop_commits()
            return len(old)

    # Snapshots

    def export_snapshot(self, target: str) -> dict:
        """Copy the segments of the current manifest (not the log); the header is written last."""
        with self.reader() as r:
            for info in r.infos:
                files.copy(self.spark, f"{self.data}/{info['name']}", f"{target}/{info['name']}")
            header = {"format": SNAPSHOT_FORMAT, "generation": self.generation, "segments": r.infos}
            files.write_json(self.spark, f"{target}/header.json", header)
            return header


    def snapshot_stream(self) -> tuple[int, Iterator[bytes]]:
        """(bytes, their pieces) of a snapshot that needs no shared store: a MessagePack header, then the segments' files one after another.

        The header has the format, the generation and for each segment its info, its bytes and its files with theirs.
        The segments are held until the pieces are read or dropped.
        """
        r = self.reader()
        try:
            listed = [(i, files.sizes(self.spark, f"{self.data}/{i['name']}")) for i in r.infos]
            parts = [{"i": i, "s": sum(n for _, n in found), "f": [list(x) for x in found]} for i, found in listed]
            header = pack({"f": SNAPSHOT_FORMAT, "g": self.generation, "s": parts})
        except BaseException:
            r.close()
            raise

        def pieces() -> Iterator[bytes]:
            with r:
                yield header
                for info, found in listed:
                    for name, _ in found:
                        yield from files.chunks(self.spark, f"{self.data}/{info['name']}/{name}")

        return len(header) + sum(p["s"] for p in parts), pieces()


def receive_snapshot(spark: SparkSession, read: Callable[[int], bytes], target: str) -> dict:
    """Write the snapshot that ``read(most bytes)`` brings, as ``snapshot_stream`` sends it, to ``target``; returns its header."""
    held, parsed = b"", None
    while parsed is None:
        part = read(1 << 16)
        held += part
        try:
            parsed, end = unpack_first(held)
        except ValueError:
            if not part:
                raise errors.CorruptSegment("the snapshot has no header") from None
    if not isinstance(parsed, dict) or parsed.get("f") != SNAPSHOT_FORMAT:
        raise errors.CorruptSegment("no snapshot of a known format")
    held = held[end:]

    def exactly(size: int) -> Iterator[bytes]:
        nonlocal held
        while size:
            part, held = (held[:size], held[size:]) if held else (read(min(size, 1 << 20)), b"")
            if not part:
                raise errors.CorruptSegment("the snapshot ended early")
            size -= len(part)
            yield part

    for segment in parsed["s"]:
        for name, size in segment["f"]:
            if name.startswith("/") or ".." in name.split("/") or "/" in segment["i"]["name"]:
                raise errors.CorruptSegment(name)
            files.write_chunks(spark, f"{target}/{segment['i']['name']}/{name}", exactly(size))
    header = {"format": SNAPSHOT_FORMAT, "generation": parsed["g"], "segments": [s["i"] for s in parsed["s"]]}
    files.write_json(spark, f"{target}/header.json", header)
    return header


def read_snapshot_header(spark: SparkSession, source: str) -> dict:
    header = files.read_json(spark, f"{source}/header.json")
    if header is None or header.get("format") != SNAPSHOT_FORMAT:
        raise errors.CorruptSegment(f"{source} is no snapshot")
    return header


def restore_snapshot(spark: SparkSession, source: str, path: str, generation: int) -> None:
    """Install a snapshot as the lineage at ``path``: copied beside it, checked, then swapped in by renames."""
    header = read_snapshot_header(spark, source)
    if header["generation"] != generation:
        raise errors.VersionMismatch(f"the snapshot is of generation {header['generation']}, not {generation}")
    staging = f"{path}.staging-{uuid.uuid4().hex[:8]}"
    for info in header["segments"]:
        files.copy(spark, f"{source}/{info['name']}", f"{staging}/data/{info['name']}")
        segments.check_segment(spark, f"{staging}/data", info)
    files.write_json(spark, f"{staging}/data/manifest.json", {"segments": header["segments"]})
    install(spark, staging, path)


def install(spark: SparkSession, staging: str, path: str) -> None:
    """Replace a lineage's folder by a complete one."""
    old = f"{path}.old-{uuid.uuid4().hex[:8]}"
    if files.exists(spark, path):
        files.rename(spark, path, old)
    files.rename(spark, staging, path)
    files.delete(spark, old)
