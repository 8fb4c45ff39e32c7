"""Process only partitions whose rows changed since the last successful run.

A source is cut into partitions by a string column. Each partition has a fingerprint:
its row count and the sum of its row hashes, both additive, so a run computes all of
them with one map-side combined aggregation. Only partitions whose fingerprint differs
from the recorded one are computed. Their rows are written through dynamic partition overwrite
below the run's number (``run=N/part=P``), where no reader looks yet; then the new table of
fingerprints, which names the run that each partition's rows are from, is put in place of the old one
by an atomic rename of ``state.json``. Until then readers see the last successful run, whole; after it
the new one. A run that dies before repeats under the same number and overwrites what it left, so
no record is skipped, none appears twice, and what a dead run wrote is never read, also if the source has
gone back to what it was. Rows that a run replaced are deleted by the next one, so a
reader of the state before has a run's time to end.

Defined results: rows redelivered, changed, added or removed change the fingerprint of
their partition; a partition without rows any more leaves the output; rows with a null
partition are left out; an empty source gives an empty output; null values in any column
hash as nulls. Other columns of the
source, whatever their names (but for ``part``, which the caller's expression replaces),
are ignored. One run at a time for each table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hashloom.runtime import drop_staged, small_side, stage
from hashloom.sources import files

#: Raised whenever the files of an output table change their form; older tables are then recomputed.
LAYOUT = 3
#: Partitions that a plan names one by one.
MOST_NAMED = 50_000
#: Replaced partitions deleted after a run; more are left to ``vacuum``.
MOST_DELETED = 10_000

Compute = Callable[[DataFrame], DataFrame]


def partition_fingerprints(source: DataFrame, part: Column, columns: list[str]) -> DataFrame:
    """``(part, rows, hash_sum)``; the sum is exact in DECIMAL(38), not wrapped."""
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0null")) for c in columns]
    hashed = source.select(part.cast("string").alias("part"), F.xxhash64(*cells).cast("decimal(20,0)").alias("h"))
    return hashed.where("part is not null").groupBy("part").agg(F.count("*").alias("rows"), F.sum("h").cast("decimal(38,0)").alias("hash_sum"))


class IncrementalTable:
    """An output table kept in step with a source, one partition directory per source partition."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _state(self) -> dict | None:
        return files.read_json(self.spark, f"{self.path}/state.json")

    def _recorded(self, state: dict) -> DataFrame:
        return self.spark.read.schema("part string, rows bigint, hash_sum decimal(38,0), run bigint").parquet(f"{self.path}/{state['fingerprints']}")

    def run(self, source: DataFrame, part: Column, columns: list[str], compute: Compute, output: T.StructType, version: str = "") -> int:
        """Bring the table up to date; returns how many partitions were computed.

        ``compute`` gets the rows of the changed partitions with their ``part`` and returns
        ``output`` columns plus ``part``. ``version`` names its code: another value recomputes all.
        """
        old = self._state()
        version = hashlib.md5(f"{LAYOUT} {version} {output.json()}".encode()).hexdigest()
        number = 1 if old is None else old["run"] + 1
        known = old is not None and old["version"] == version
        found = partition_fingerprints(source, part, columns)
        if known:
            same = self._recorded(old).select("part", "rows", "hash_sum", F.col("run").alias("kept"))
            found = found.join(same, ["part", "rows", "hash_sum"], "left")
        else:
            found = found.withColumn("kept", F.lit(None).cast("bigint"))
        # The run that each partition's rows are from: this one if it is new or changed.
        now = stage(found.select("part", "rows", "hash_sum", F.coalesce("kept", F.lit(number)).cast("bigint").alias("run")), "fingerprints")
        changed = small_side(now.where(F.col("run") == number).select("part"), "changed")
        count = changed.count()
        # What a dead run of this number left; a partition without a result would not overwrite it.
        files.delete(self.spark, f"{self.path}/rows/run={number}")
        if count:
            todo = source.withColumn("part", part.cast("string")).join(changed, "part", "left_semi")
            result = compute(todo).select("part", *[F.col(f.name) for f in output.fields])
            # One directory per partition and at most eight files in it, whatever the number of tasks.
            spread = F.pmod(F.xxhash64(*[F.col(f.name) for f in output.fields]), F.lit(8))
            result.withColumn("run", F.lit(number)).repartition("part", spread).write.mode("overwrite").option(
                "partitionOverwriteMode", "dynamic"
            ).partitionBy("run", "part").parquet(f"{self.path}/rows")
        recorded = f"fingerprints/{number:08d}"
        now.write.mode("overwrite").parquet(f"{self.path}/{recorded}")
        files.write_json(self.spark, f"{self.path}/state.json", {"run": number, "fingerprints": recorded, "version": version, "before": old and old["fingerprints"]})
        drop_staged(now)
        if old is not None and old.get("before"):
            self._forget(self.spark.read.parquet(f"{self.path}/{old['before']}"), self._recorded(old))
            files.delete(self.spark, f"{self.path}/{old['before']}")
        return count

    def _forget(self, before: DataFrame, after: DataFrame) -> None:
        """Delete the rows that the state before held and the one after replaced."""
        if "run" not in before.columns:
            return
        escaped = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        for row in before.join(after, ["part", "run"], "left_anti").select("part", "run").limit(MOST_DELETED).collect():
            files.delete(self.spark, f"{self.path}/rows/run={row.run}/part={escaped(row.part)}")

    def vacuum(self) -> int:
        """Delete the partition folders that the last two states don't name; returns how many. Run it while no other run is on."""
        state = self._state()
        if state is None:
            return 0
        named = self._recorded(state)
        if state.get("before"):
            named = named.unionByName(self.spark.read.parquet(f"{self.path}/{state['before']}"))
        escaped = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        held = {(r.run, escaped(r.part)) for r in named.select("part", "run").distinct().toLocalIterator()}
        dropped = 0
        for run in files.names(self.spark, f"{self.path}/rows"):
            for name in files.names(self.spark, f"{self.path}/rows/{run}") if run.startswith("run=") else ():
                if name.startswith("part=") and (int(run[4:]), name[5:]) not in held:
                    files.delete(self.spark, f"{self.path}/rows/{run}/{name}")
                    dropped += 1
        return dropped

    def read(self, output: T.StructType) -> DataFrame:
        """Rows of all partitions that the last successful run saw in the source."""
        state = self._state()
        if state is None or not files.exists(self.spark, f"{self.path}/rows"):
            return self.spark.createDataFrame([], output)
        schema = T.StructType([*output.fields, T.StructField("run", T.LongType()), T.StructField("part", T.StringType())])
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/rows")
        live = self._recorded(state).select("part", "run")
        named = live.limit(MOST_NAMED + 1).collect()
        if len(named) <= MOST_NAMED:
            # A filter of folders, so that the plan names no file that a later run deletes.
            place = F.concat_ws("/", F.col("run").cast("string"), "part")
            rows = rows.where(place.isin([f"{r.run}/{r.part}" for r in named]))
        else:
            rows = rows.join(live, ["part", "run"], "left_semi")
        return rows.select(*[f.name for f in output.fields])
