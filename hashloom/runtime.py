"""Shared-folder staging and size-checked broadcasts."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only after its rows were counted and found to be at most this many.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share: the session's ``spark.checkpoint.dir``.

    Only where the session names none and runs in one process (local tests) is a temporary folder set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="hashloom-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


_RUN = uuid.uuid4().hex
_folders: dict[str, object] = {}


def new_folder(spark: SparkSession, label: str) -> str:
    """A new name below this process's own folder, which is deleted when the process ends."""
    root = f"{shared_dir(spark)}/hashloom/run-{_RUN}"
    _folders.setdefault(root, spark.sparkContext._jvm)
    path = f"{root}/{label}-{uuid.uuid4().hex}"
    if (made := getattr(_scratch, "folders", None)) is not None:
        made.append(path)
    return path


_scratch = threading.local()


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Folders that this thread makes inside are deleted at its end, but for those of staged tables given to the block's value."""
    outer, made, kept = getattr(_scratch, "folders", None), [], set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._staged_at)
        return df

    _scratch.folders = made
    try:
        yield keep
    finally:
        _scratch.folders = outer
        for path in made:
            if path not in kept:
                with contextlib.suppress(Exception):
                    _delete(spark.sparkContext, path)
            elif outer is not None:
                outer.append(path)


@atexit.register
def _forget() -> None:
    for root, jvm in _folders.items():
        with contextlib.suppress(Exception):  # the JVM may be gone; then the folder stays
            path = jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)


def stage(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return a scan of it.

    Cuts lineage: everything downstream survives the loss of any executor, and a
    plan that uses the table twice reads it twice instead of computing it twice.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged._staged_at = path
    return staged


def drop_staged(*staged: DataFrame) -> None:
    """Delete the files of staged tables that no later plan reads."""
    for df in staged:
        _delete(df.sparkSession.sparkContext, df._staged_at)


def _delete(context, path: str) -> None:
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def spread(scan: DataFrame) -> DataFrame:
    """A plain scan with fewer splits than the cluster has cores, as of one small file, shuffled to all cores.

    For steps that spend far more on a row than reading it. A scan of many splits is returned as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def small_side(df: DataFrame, label: str, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Stage ``df``; hint a broadcast when its counted rows fit, else leave the join to shuffle.

    Beyond the bound the join is a sort-merge join, whose hot keys adaptive
    execution splits. ``is_small`` of the result tells which it is.
    """
    staged = stage(df, label)
    small = staged.count() <= max_rows
    side = F.broadcast(staged) if small else staged
    side.is_small = small
    return side


class Shared:
    """A value broadcast to executors that don't have this package: its classes travel with it."""

    def __init__(self, spark: SparkSession, value) -> None:
        self._sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self):
        return cloudpickle.loads(self._sent.value)
