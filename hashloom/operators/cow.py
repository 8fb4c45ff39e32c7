"""Rebuild current state from an unordered change feed: bucketed copy-on-write.

The base table is hashed by key into buckets; a manifest names the folder and the rows of each
bucket. Applying changes first keeps the last operation of each key (combined map-side, so a key
changed a million times sends one row from each task), routes these by the same hash, reads only the
touched buckets, merges base and changes sorted by (key, position), writes replacement files
and commits a new manifest by an atomic rename. A run that dies before the rename leaves the old table;
its files are never named. When a bucket would hold more than ``rows_per_bucket`` rows on average, the
table is hashed into twice as many, or more, in the same commit, which then rewrites all.

Defined results: the operation with the greatest position decides, so repeated and
out-of-order changes give the same state as ordered ones, also across ``apply`` calls,
because deletes stay as tombstones with their position. Equal positions: an insert
beats a delete, then the greater payload wins, null being least. Changes with a null key column or an
operation other than insert or delete touch nothing. An empty feed commits nothing. Other columns of
the changes are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hashloom.runtime import drop_staged, stage
from hashloom.sources import files

#: A bucket is merged and written by one task, so it must stay this small on average.
ROWS_PER_BUCKET = 1_000_000
LEAST_BUCKETS = 16


class BucketedTable:
    """``keys`` identify a row, ``order`` columns (ascending) order operations, ``payload`` is what an insert stores."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: list[str], payload: list[str], buckets: int | None = None, rows_per_bucket: int = ROWS_PER_BUCKET) -> None:
        """``buckets``: of a new table; None gives one for each ``rows_per_bucket`` rows of its first batch, 16 at least."""
        self.spark, self.path, self.keys, self.order, self.payload = spark, path.rstrip("/"), keys, order, payload
        if clash := {"op", "bucket", "_newest"} & {*keys, *order, *payload}:
            raise ValueError(f"columns {sorted(clash)} have a meaning of their own here")
        manifest = self._manifest()
        self.buckets, self.rows_per_bucket = manifest["buckets"] if manifest else buckets, rows_per_bucket

    def _manifest(self) -> dict | None:
        return files.read_json(self.spark, f"{self.path}/manifest.json")

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _scan(self, manifest: dict, only: list[int] | None) -> DataFrame | None:
        folders = sorted({f for b, f in manifest["folders"].items() if only is None or int(b) in only})
        if not folders:
            return None
        schema = T.StructType.fromJson(manifest["schema"])
        paths = [f"{self.path}/{folder}" for folder in folders]
        return self.spark.read.schema(schema).parquet(*paths)

    def _last(self, rows: DataFrame, *by: str) -> DataFrame:
        """The last operation of each key, one aggregation that combines before its shuffle."""
        rest = [*self.order, "op", *self.payload]
        last = rows.groupBy(*by, *self.keys).agg(F.max(F.struct(*rest)).alias("_newest"))
        return last.select(*by, F.col("_newest.op").alias("op"), *self.keys, *[F.col(f"_newest.{c}").alias(c) for c in [*self.order, *self.payload]])

    def apply(self, changes: DataFrame) -> list[int]:
        """Merge ``changes`` (keys, order, ``op`` of 'i' or 'd', payload); returns the touched buckets."""
        columns = ["op", *self.keys, *self.order, *self.payload]
        todo = stage(self._last(changes.select(*columns).where("op in ('i', 'd')").dropna(subset=self.keys)), "changes")
        fresh = todo.count()
        if not fresh:
            drop_staged(todo)
            return []
        old = self._manifest()
        held = sum((old or {}).get("rows", {}).values())
        if self.buckets is None:
            self.buckets = max(LEAST_BUCKETS, -(-fresh // self.rows_per_bucket))
        grown = self.buckets
        while held + fresh > grown * self.rows_per_bucket:
            grown *= 2
        # A table hashed into more buckets is rewritten as a whole.
        anew = old is not None and grown != self.buckets
        if old is None or anew:
            self.buckets = grown
        routed = todo.withColumn("bucket", self._bucket())
        touched = None if anew else sorted(r[0] for r in routed.select("bucket").distinct().collect())
        base = self._scan(old, touched) if old else None
        if base is not None:
            routed = routed.unionByName(base.withColumn("bucket", self._bucket()))
        # One shuffle by bucket serves the merge (sorted by key in each bucket) and the write.
        merged = self._last(routed.repartition("bucket"), "bucket")
        commit = (old or {"commit": 0})["commit"] + 1
        folder = f"data/{commit:08d}-{uuid.uuid4().hex[:8]}"
        merged.write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        drop_staged(todo)
        written = {r.bucket: r.n for r in self.spark.read.parquet(f"{self.path}/{folder}").groupBy("bucket").agg(F.count("*").alias("n")).collect()}
        kept = {} if anew or old is None else old
        folders = kept.get("folders", {}) | {str(b): f"{folder}/bucket={b}" for b in written}
        rows = kept.get("rows", {}) | {str(b): n for b, n in written.items()}
        files.write_json(
            self.spark, f"{self.path}/manifest.json",
            {"commit": commit, "buckets": self.buckets, "schema": merged.drop("bucket").schema.jsonValue(), "folders": folders, "rows": rows},
        )
        return sorted(written)

    def rows(self) -> DataFrame | None:
        """All rows of the current manifest, tombstones included; None before the first commit."""
        manifest = self._manifest()
        return self._scan(manifest, None) if manifest else None

    def live(self) -> DataFrame | None:
        rows = self.rows()
        return None if rows is None else rows.where("op = 'i'").select(*self.keys, *self.payload, *self.order)

    def vacuum(self) -> int:
        """Delete bucket folders no manifest names; returns how many. Run it when no reader holds an older manifest."""
        manifest = self._manifest()
        named = set(manifest["folders"].values()) if manifest else set()
        dropped = 0
        for commit in files.names(self.spark, f"{self.path}/data"):
            for bucket in files.names(self.spark, f"{self.path}/data/{commit}"):
                if bucket.startswith("bucket=") and f"data/{commit}/{bucket}" not in named:
                    files.delete(self.spark, f"{self.path}/data/{commit}/{bucket}")
                    dropped += 1
        return dropped
