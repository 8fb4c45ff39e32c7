"""Queries p4, p5 and p6: even per-key counts, new entries only, state from changes."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hashloom.functions.ints import u32
from hashloom.operators.cow import BucketedTable
from hashloom.operators.feeds import active_generations, applied_positions, op_kind, oplog_changes
from hashloom.operators.incremental import IncrementalTable
from hashloom.operators.skew import chunked_counts, key_chunks
from hashloom.runtime import new_folder, shared_dir, small_side

#: Feed positions per incremental partition: a new entry recomputes one block of its lineage.
BLOCK = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p4_query_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per query_id the hits and the distinct ids."""
    counts = chunked_counts(table(spark, sf_dir, "search_hits"), "query_id", "id")
    return counts.select(F.col("key").alias("query_id"), F.col("n").alias("n_hits"), F.col("n_items").alias("n_ids"))


def p4_score_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per score (null is one) the hits and the distinct ids."""
    counts = chunked_counts(table(spark, sf_dir, "search_hits"), "score", "id")
    return counts.select(F.col("key").alias("score"), F.col("n").alias("n_hits"), F.col("n_items").alias("n_ids"))


def p4_hash_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per u32 hash the distinct ids of stored rows that hold it."""
    postings = table(spark, sf_dir, "fingerprints").select("id", F.explode("hashes").alias("h")).where("h is not null")
    counts = chunked_counts(postings.select("id", u32(F.col("h")).alias("hash")), "hash", "id")
    return counts.select(F.col("key").alias("hash"), F.col("n_items").alias("n_ids"))


#: Hits in a chunk of p4_hit_chunks.
CHUNK_HITS = 10_000


def p4_hit_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hits of every query_id in order of id, in chunks of exactly so many rows."""
    chunks = key_chunks(table(spark, sf_dir, "search_hits"), "query_id", "id", CHUNK_HITS)
    return chunks.select(F.col("key").alias("query_id"), "chunk", "n", F.col("n_items").alias("n_ids"), F.col("first_item").alias("first_id"), F.col("last_item").alias("last_id"))


P5_OUTPUT = T.StructType([T.StructField("index_name", T.StringType()), T.StructField("generation", T.LongType()), T.StructField("seq", T.LongType())])


def uncovered_entries(spark: SparkSession, sf_dir: str, target: str) -> tuple[IncrementalTable, int]:
    """Bring the table of entries above the oplog's position up to date in ``target``; returns it and the partitions computed."""
    active = active_generations(table(spark, sf_dir, "meta_feed"))
    applied = applied_positions(table(spark, sf_dir, "oplog"))
    lineages = small_side(active.join(applied, ["index_name", "generation"], "left").select("index_name", "generation", F.coalesce("applied", F.lit(0)).alias("applied")), "lineages")
    # Inactive lineages never reach the fingerprints; the applied position is part of every row's hash.
    source = table(spark, sf_dir, "changelog").select("index_name", "generation", "seq").where("seq is not null").join(lineages, ["index_name", "generation"])
    part = F.concat_ws("~", "index_name", "generation", F.floor(F.col("seq") / BLOCK))

    def compute(rows: DataFrame) -> DataFrame:
        return rows.where("seq > applied").select("part", "index_name", "generation", "seq").distinct()

    out = IncrementalTable(spark, target)
    return out, out.run(source, part, ["index_name", "generation", "seq", "applied"], compute, P5_OUTPUT, version="entries above applied position, 1")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of active generations the oplog doesn't cover, through a table kept by source path: a second run computes changed blocks only."""
    out, _ = uncovered_entries(spark, sf_dir, f"{shared_dir(spark)}/hashloom/p5-{hashlib.md5(sf_dir.encode()).hexdigest()}")
    return out.read(P5_OUTPUT)


P6_KEYS, P6_ORDER = ["index_name", "id"], ["phase", "position", "ordinal"]


def live_fingerprints(spark: SparkSession, sf_dir: str, path: str, payload: list[str]) -> BucketedTable:
    """State table in ``path``: the oplog's commits, then the changelog entries they don't cover."""
    active = small_side(active_generations(table(spark, sf_dir, "meta_feed")), "active")
    state = BucketedTable(spark, path, P6_KEYS, P6_ORDER, payload)
    changes = oplog_changes(table(spark, sf_dir, "oplog")).join(active, ["index_name", "generation"])
    ids = "id is not null and id <> 0"
    hashes = [F.col("change.hashes").alias("hashes")] if "hashes" in payload else []
    commits = changes.select(
        op_kind(F.col("change.op")).alias("op"), "index_name", F.col("change.id").alias("id"), F.lit(0).alias("phase"),
        F.col("commit_id").alias("position"), F.col("ordinal").cast("long").alias("ordinal"), "version", *hashes,
    )
    state.apply(commits.where(ids))
    fresh = uncovered_entries(spark, sf_dir, f"{path}-entries")[0].read(P5_OUTPUT)
    entries = table(spark, sf_dir, "changelog").select("index_name", "generation", "seq", "change").where("change.op is not null and change.id is not null and change.id <> 0")
    routed = entries.join(fresh, ["index_name", "generation", "seq"], "left_semi").select(
        op_kind(F.col("change.op")).alias("op"), "index_name", F.col("change.id").alias("id"), F.lit(1).alias("phase"),
        F.col("seq").alias("position"), F.lit(0).cast("long").alias("ordinal"), F.col("seq").alias("version"), *hashes,
    )
    state.apply(routed)
    return state


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live fingerprints of every active index with the version of their last insert."""
    live = live_fingerprints(spark, sf_dir, new_folder(spark, "p6"), ["version"]).live()
    return live.select("index_name", "id", "version")


QUERIES = {
    "p4_query_hits": p4_query_hits,
    "p4_score_hits": p4_score_hits,
    "p4_hash_ids": p4_hash_ids,
    "p4_hit_chunks": p4_hit_chunks,
    "p5_found": p5_found,
    "p6_found": p6_found,
}

_ACTIVE = """
  last AS (SELECT index_name, max(pos) AS pos FROM meta_feed GROUP BY index_name),
  active AS (SELECT DISTINCT m.index_name, m.pos AS generation FROM meta_feed m JOIN last l ON m.index_name = l.index_name AND m.pos = l.pos WHERE m.kind = 'create'),
  applied AS (SELECT index_name, generation, coalesce(max(version), 0) AS applied FROM oplog WHERE crc_ok GROUP BY 1, 2),
  fresh AS (SELECT DISTINCT c.index_name, c.generation, c.seq FROM changelog c JOIN active a ON c.index_name = a.index_name AND c.generation = a.generation
            LEFT JOIN applied p ON c.index_name = p.index_name AND c.generation = p.generation WHERE c.seq > coalesce(p.applied, 0))
"""

ORACLES = {
    "p4_query_hits": "SELECT query_id, count(*) AS n_hits, count(DISTINCT id) AS n_ids FROM search_hits GROUP BY query_id",
    "p4_score_hits": "SELECT score, count(*) AS n_hits, count(DISTINCT id) AS n_ids FROM search_hits GROUP BY score",
    "p4_hash_ids": "SELECT h & 4294967295 AS hash, count(DISTINCT id) AS n_ids FROM (SELECT id, unnest(hashes) AS h FROM fingerprints) WHERE h IS NOT NULL GROUP BY 1",
    "p4_hit_chunks": f"SELECT query_id, (r - 1) // {CHUNK_HITS} AS chunk, count(*) AS n, count(DISTINCT id) AS n_ids, min(id) AS first_id, max(id) AS last_id FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY id) AS r FROM search_hits) GROUP BY 1, 2",
    "p5_found": f"WITH {_ACTIVE} SELECT index_name, generation, seq FROM fresh",
    "p6_found": f"""
WITH {_ACTIVE},
  commits AS (SELECT o.index_name, o.id AS pos, coalesce(o.version, o.id) AS version, generate_subscripts(o.changes, 1) AS ordinal, unnest(o.changes) AS change
              FROM oplog o JOIN active a ON o.index_name = a.index_name AND o.generation = a.generation WHERE o.crc_ok),
  ops AS (SELECT index_name, 0 AS phase, pos, ordinal, version, change.op AS op, change.id AS id FROM commits
          UNION ALL
          SELECT c.index_name, 1, c.seq, 0, c.seq, c.change.op, c.change.id FROM changelog c JOIN fresh f ON c.index_name = f.index_name AND c.generation = f.generation AND c.seq = f.seq),
  decided AS (SELECT *, row_number() OVER (PARTITION BY index_name, id ORDER BY phase DESC, pos DESC, ordinal DESC) AS rn
              FROM ops WHERE left(op, 1) IN ('i', 'd') AND id IS NOT NULL AND id <> 0)
SELECT index_name, id, version FROM decided WHERE rn = 1 AND left(op, 1) = 'i'
""",
}
