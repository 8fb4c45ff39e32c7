"""Write-ahead log: one file (or folder) per commit, named by its commit id; its rename is the commit point.

A line is a CRC-32 of eight hex digits, a blank and a JSON record ``{id, version, base, changes}``.
A batch from Python is one line; a batch from a DataFrame is a folder of lines that Spark
wrote. Reading stops before the first commit with a line whose CRC doesn't match, as after a
torn write, and keeps the prefix.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Container

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hashloom.sources import files

CHANGE = "struct<op:string,id:bigint,hashes:array<bigint>,entries:map<string,string>>"
RECORD = f"id bigint, version bigint, base bigint, changes array<{CHANGE}>"
CHANGES = "commit_id bigint, version bigint, ordinal bigint, op string, id bigint, hashes array<bigint>, entries map<string,string>"


def log_line(record: dict) -> str:
    text = json.dumps(record, separators=(",", ":"))
    return f"{zlib.crc32(text.encode()):08x} {text}\n"


class Oplog:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        #: Commits whose lines were checked or written here.
        self._good: set[int] = set()

    def commits(self) -> list[int]:
        """Ids of all commits whose files are there, valid or not."""
        return sorted(int(n[:16], 16) for n in files.names(self.spark, self.path) if n.endswith(".xlog") and len(n) == 21)

    def _place(self, commit_id: int) -> str:
        return f"{self.path}/{commit_id:016x}.xlog"

    def append(self, commit_id: int, version: int | None, changes: list[dict]) -> bool:
        temp = f"{self.path}/tmp-{uuid.uuid4().hex}"
        files.write_text(self.spark, temp, log_line({"id": commit_id, "version": version, "base": 0, "changes": changes}))
        return self._publish(temp, commit_id)

    def _publish(self, temp: str, commit_id: int) -> bool:
        """Rename into place; False if another writer took this commit id."""
        if not files.publish(self.spark, temp, self._place(commit_id)):
            files.delete(self.spark, temp)
            return False
        self._good.add(commit_id)
        return True

    def append_frame(self, commit_id: int, version: int | None, changes: DataFrame) -> bool:
        """``changes`` has ``ordinal``, ``op``, ``id``, ``hashes`` and ``entries``; nothing goes through the driver."""
        record = F.struct(
            F.lit(commit_id).cast("bigint").alias("id"), F.lit(version).cast("bigint").alias("version"), F.col("ordinal").alias("base"),
            F.array(F.struct("op", "id", "hashes", "entries")).alias("changes"),
        )
        lines = changes.select(F.to_json(record).alias("text")).select(F.concat(F.lpad(F.lower(F.hex(F.crc32(F.col("text").cast("binary")))), 8, "0"), F.lit(" "), "text").alias("value"))
        temp = f"{self.path}/tmp-{uuid.uuid4().hex}"
        lines.write.text(temp)
        return self._publish(temp, commit_id)

    def present(self, after: int = 0, upto: int | None = None) -> list[int]:
        return [c for c in self.commits() if c > after and (upto is None or c <= upto)]

    def read(self, after: int = 0, upto: int | None = None) -> DataFrame:
        """Changes ``(commit_id, version, ordinal, op, id, hashes, entries)`` of valid commits above ``after``.

        Lines are checked once: later reads of the same commits take them as they are.
        """
        found = self.present(after, upto)
        unknown = [c for c in found if c not in self._good]
        if unknown:
            # A bad line has no readable commit id: its file's name tells.
            parsed = self._parsed(unknown).select("r", F.regexp_extract(F.input_file_name(), "([0-9a-f]{16})\\.xlog", 1).alias("file"))
            bad = parsed.where("r is null or r.id is null").agg(F.min("file")).first()[0]
            if bad is not None:
                found = [c for c in found if c < int(bad, 16)]
            self._good.update(found)
        if not found:
            return self.spark.createDataFrame([], CHANGES)
        rows = self._parsed(found).where("r.id is not null").select("r.id", "r.version", "r.base", F.posexplode("r.changes").alias("place", "c"))
        return rows.selectExpr("id AS commit_id", "version", "base + place AS ordinal", "c.op", "c.id", "c.hashes", "c.entries")

    def _parsed(self, commits: list[int]) -> DataFrame:
        lines = self.spark.read.text([self._place(c) for c in commits])
        text = F.substring("value", 10, 2**31 - 1)
        good = F.lower(F.substring("value", 1, 8)) == F.lpad(F.lower(F.hex(F.crc32(text.cast("binary")))), 8, "0")
        return lines.select(F.from_json(F.when(good, text), RECORD).alias("r"))

    def truncate(self, commit_id: int, held: Container[int] = ()) -> int:
        """Delete commits that a checkpoint covers and no reader holds; returns how many."""
        old = [c for c in self.commits() if c <= commit_id and c not in held]
        for c in old:
            files.delete(self.spark, self._place(c))
        self._good.difference_update(old)
        return len(old)
