"""Named indexes: lineages (name, generation) under one folder, created, deleted and found again after a restart."""

from __future__ import annotations

import re
import threading
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession

from hashloom import errors
from hashloom.functions.names import INDEX_NAME
from hashloom.index import Index, IndexOptions, install, restore_snapshot
from hashloom.metrics import Metrics
from hashloom.sources import files


class Catalog:
    """``root/<name>/current.json`` names the active generation, whose files are in ``root/<name>/v<generation>``."""

    def __init__(self, spark: SparkSession, root: str, options: IndexOptions | None = None, load_concurrency: int = 8) -> None:
        self.spark, self.root, self.options = spark, root.rstrip("/"), options
        self.metrics = Metrics()
        self._lock = threading.RLock()
        self._open: dict[str, Index] = {}
        self._loading: set[str] = set()
        with ThreadPoolExecutor(max_workers=load_concurrency) as pool:
            found = list(pool.map(self._found, files.names(spark, self.root)))
        self._open.update({index.name: index for index in found if index is not None})

    def _found(self, name: str) -> Index | None:
        """The active lineage of a folder, if it has one."""
        record = self._record(name) if re.match(INDEX_NAME, name) else None
        return self._lineage(name, record["generation"]) if record and not record["deleted"] else None

    def _record(self, name: str) -> dict | None:
        return files.read_json(self.spark, f"{self.root}/{name}/current.json")

    def _redirect(self, name: str, generation: int, deleted: bool) -> None:
        files.write_json(self.spark, f"{self.root}/{name}/current.json", {"name": name, "generation": generation, "deleted": deleted})

    def folder(self, name: str, generation: int) -> str:
        return f"{self.root}/{name}/v{generation:06d}"

    def _lineage(self, name: str, generation: int) -> Index:
        return Index(self.spark, self.folder(name, generation), generation, name, self.options, self.metrics)

    def create(self, name: str, expect_does_not_exist: bool = False, generation: int | None = None) -> dict:
        """Idempotent; a ``generation`` must equal the active one or exceed every earlier one."""
        if not re.match(INDEX_NAME, name):
            raise errors.InvalidIndexName(name)
        with self._lock:
            active = self._open.get(name)
            if active is not None:
                if expect_does_not_exist:
                    raise errors.IndexAlreadyExists(name)
                if generation is not None and generation < active.generation:
                    raise errors.OlderIndexAlreadyExists(f"{name} is at {active.generation}")
                if generation is not None and generation > active.generation:
                    raise errors.NewerIndexAlreadyExists(f"{name} is at {active.generation}")
                return {"version": active.version, "ready": True, "generation": active.generation}
            prior = self._record(name)
            if generation is None:
                generation = prior["generation"] + 1 if prior else 1
            elif prior and generation <= prior["generation"]:
                raise errors.OlderIndexAlreadyExists(f"{name} was at {prior['generation']}")
            self._redirect(name, generation, False)
            self._open[name] = self._lineage(name, generation)
            return {"version": self._open[name].version, "ready": True, "generation": generation}

    def delete(self, name: str, expect_exists: bool = False) -> dict:
        with self._lock:
            active = self._open.pop(name, None)
            if active is None:
                if expect_exists:
                    raise errors.IndexNotFound(name)
                return {"deleted": False}
            self._redirect(name, active.generation, True)
            self.metrics.drop_index(name)
            files.delete(self.spark, active.path)
            return {"deleted": True}

    def get(self, name: str, generation: int | None = None) -> Index:
        """The active index; with a ``generation``, only if that is the active one."""
        with self._lock:
            active = self._open.get(name)
        if active is None or (generation is not None and active.generation != generation):
            raise errors.IndexNotFound(name)
        return active

    def serving(self, name: str) -> Index:
        """As ``get``, but not while the index is being filled."""
        index = self.get(name)
        if name in self._loading:
            raise errors.IndexNotReady(name)
        return index

    def exists(self, name: str) -> bool:
        return name in self._open

    def names(self) -> list[str]:
        with self._lock:
            return sorted(self._open)

    def health(self, name: str) -> str:
        if not self.exists(name):
            return "missing"
        return "loading" if name in self._loading else "ready"

    def set_loading(self, name: str, loading: bool) -> None:
        (self._loading.add if loading else self._loading.discard)(name)

    def render_metrics(self) -> str:
        for name in self.names():
            index = self.get(name)
            self.metrics.set("docs", index.info()["stats"]["num_docs"], name)
            self.metrics.set("version", index.version, name)
        return self.metrics.render()

    def restore(self, name: str, generation: int, snapshot: str) -> Index:
        """Replace a lineage's content by a snapshot of the same generation; it continues at the snapshot's version."""
        with self._lock:
            restore_snapshot(self.spark, snapshot, self.folder(name, generation), generation)
            self._redirect(name, generation, False)
            self._open[name] = self._lineage(name, generation)
            return self._open[name]

    def install_built(self, name: str, generation: int, build) -> Index:
        """Fill a lineage beside the active one: ``build(index)`` writes, then all is flushed and swapped in at once."""
        staging = f"{self.root}/{name}/staging-{uuid.uuid4().hex[:8]}"
        try:
            index = Index(self.spark, staging, generation, name, self.options, self.metrics)
            build(index)
            index.checkpoint(force=True)
            with self._lock:
                install(self.spark, staging, self.folder(name, generation))
                self._redirect(name, generation, False)
                self._open[name] = self._lineage(name, generation)
                return self._open[name]
        finally:
            files.delete(self.spark, staging)
