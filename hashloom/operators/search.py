"""Ranked set-overlap search, one query or many, as one lazy plan.

A stored document is a bag of u32 hashes, a query is a set. The score of a document is
the number of its postings whose hash is in the query; documents scoring at least
``min_score`` are ranked by score, then id; a document stays if it is the first or
scores at least ``pct`` percent of the best; the first ``limit`` are returned.

The query side is broadcast only if it was counted and is small; otherwise both sides
shuffle by hash. Postings carry their multiplicity, so a hash that a document repeats
is one row, and partial counts are combined before the shuffle by (query, id).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hashloom.functions.ints import clamp, default_min_score, let, percent_floor, u32_bag
from hashloom.runtime import BROADCAST_ROWS, stage

DEFAULT_LIMIT, LEAST_LIMIT, MOST_LIMIT = 40, 1, 100
DEFAULT_TIMEOUT_MS, MOST_TIMEOUT_MS = 500, 10_000
DEFAULT_PCT = 10


@dataclass(frozen=True)
class SearchOptions:
    """Options of all queries that don't bring their own columns ``limit``, ``min_score`` or ``score_pct``."""

    limit: int | None = None
    min_score: int | None = None
    score_pct: int = DEFAULT_PCT
    #: False: the limit is taken as it is, as sessions of the line protocol do.
    clamped: bool = True
    #: At most so many documents of each hash, those with the smallest ids; None counts all.
    max_docs_per_hash: int | None = None

    def bounds(self, raw_len: int) -> tuple[int, int]:
        """(limit, least score) of one query of so many hashes, repeated ones counted."""
        limit = DEFAULT_LIMIT if self.limit is None else self.limit
        floor = (raw_len + 19) // 20 if self.min_score is None else self.min_score
        return min(max(limit, LEAST_LIMIT), MOST_LIMIT) if self.clamped else limit, max(floor, 1)


def postings(docs: DataFrame, *keep: str) -> DataFrame:
    """``(hash, id, *keep)``: one row for each element of each bag, repeated ones too."""
    return docs.select(F.explode(u32_bag(F.col("hashes"))).alias("hash"), "id", *keep)


def counted_postings(docs: DataFrame, *keep: str) -> DataFrame:
    """``(hash, id, n, *keep)`` with the multiplicity folded inside each row, without a shuffle."""

    def runs(bag: Column) -> Column:
        # Places at which a new hash begins in the sorted bag; each run ends where the next begins.
        begins = lambda i: (i <= F.size(bag)) & ((i == 1) | (F.element_at(bag, i) != F.element_at(bag, F.greatest(i - 1, F.lit(1)))))
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(bag), F.lit(1))), begins)
        return let(starts, lambda s: F.transform(s, lambda at, k: F.struct(F.element_at(bag, at).alias("hash"), (F.coalesce(F.get(s, k + 1), F.size(bag) + 1) - at).cast("bigint").alias("n"))))

    return docs.select("id", *keep, F.inline(let(F.sort_array(u32_bag(F.col("hashes"))), runs))).select("hash", "id", "n", *keep)


def capped_postings(rows: DataFrame, most: int) -> DataFrame:
    """Postings of the ``most`` smallest ids of each hash; a window-group limit drops the rest before the shuffle."""
    ids = rows.select("hash", "id").distinct()
    kept = ids.withColumn("r", F.row_number().over(Window.partitionBy("hash").orderBy("id"))).where(F.col("r") <= most)
    return rows.join(kept.select("hash", "id"), ["hash", "id"], "left_semi")


def prepared_queries(queries: DataFrame, options: SearchOptions, *scope: str) -> DataFrame:
    """``(query_id, *scope, hashes set, limit, min_score, score_pct)`` with defaults and clamps applied."""
    have = queries.columns
    bag = u32_bag(F.col("hashes"))
    limit = F.col("limit").cast("bigint") if "limit" in have else F.lit(options.limit).cast("bigint")
    limit = F.coalesce(limit, F.lit(DEFAULT_LIMIT))
    floor = F.col("min_score").cast("bigint") if "min_score" in have else F.lit(options.min_score).cast("bigint")
    pct = F.coalesce(F.col("score_pct").cast("bigint"), F.lit(options.score_pct)) if "score_pct" in have else F.lit(options.score_pct)
    return queries.select(
        "query_id", *scope, F.array_distinct(bag).alias("hashes"), (clamp(limit, LEAST_LIMIT, MOST_LIMIT) if options.clamped else limit).alias("limit"),
        F.greatest(F.coalesce(floor, default_min_score(F.size(bag))), F.lit(1)).cast("bigint").alias("min_score"), pct.cast("bigint").alias("score_pct"),
    )


@dataclass(frozen=True)
class Batch:
    """Prepared queries, staged, and what was counted of them."""

    frame: DataFrame
    queries: int
    probes: int
    limit: int

    def side(self, df: DataFrame, rows: int) -> DataFrame:
        """``df`` to be broadcast if its counted rows are few, else joined by a shuffle."""
        return F.broadcast(df) if rows <= BROADCAST_ROWS else df

    def probe_rows(self, *columns: str) -> DataFrame:
        return self.side(self.frame.select(*columns, F.explode("hashes").alias("hash")), self.probes)

    def settings(self, *columns: str) -> DataFrame:
        return self.side(self.frame.select(*columns), self.queries)


def batch(queries: DataFrame, options: SearchOptions, *scope: str) -> Batch:
    """Prepare and count ``queries`` once, whatever reads them later."""
    frame = stage(prepared_queries(queries, options, *scope), "queries")
    size = frame.agg(F.count("*").alias("queries"), F.sum(F.greatest(F.size("hashes"), F.lit(0))).alias("probes"), F.max("limit").alias("limit")).first()
    return Batch(frame, size.queries, size.probes or 0, int(size.limit or 0))


def scores(rows: DataFrame, asked: Batch, *scope: str) -> DataFrame:
    """``(query_id, id, score)`` of documents at or above the query's absolute floor."""
    weight = F.col("n") if "n" in rows.columns else F.lit(1)
    hits = rows.join(asked.probe_rows("query_id", *scope, "min_score"), ["hash", *scope]).groupBy("query_id", "id", "min_score").agg(F.sum(weight).cast("bigint").alias("score"))
    return hits.where("score >= min_score").select("query_id", "id", "score")


def ranked(found: DataFrame, asked: Batch) -> DataFrame:
    """``(query_id, id, score, rank)``: limit first, relative cutoff second.

    Survivors of the cutoff are a prefix of the ranking, so the two commute, and the limit alone
    lets the planner drop rows before the shuffle.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= asked.limit)
    best = F.max("score").over(Window.partitionBy("query_id"))
    cut = top.withColumn("best", best).join(asked.settings("query_id", "limit", "min_score", "score_pct"), "query_id")
    kept = cut.where(F.col("rank") <= F.col("limit")).where((F.col("rank") == 1) | (F.col("score") >= F.greatest("min_score", percent_floor(F.col("best"), F.col("score_pct")))))
    return kept.select("query_id", "id", "score", F.col("rank").cast("bigint").alias("rank"))


def qualifying(found: DataFrame, asked: Batch) -> DataFrame:
    """``(query_id, id, score)``: what ``ranked`` gives if no limit cut it, without numbering a query's results."""
    held = stage(found, "found")
    first = held.groupBy("query_id").agg(F.max(F.struct("score", (-F.col("id")).alias("place"))).alias("first"))
    floors = asked.side(first.join(asked.settings("query_id", "min_score", "score_pct"), "query_id"), asked.queries)
    is_first = (F.col("score") == F.col("first.score")) & (F.col("id") == -F.col("first.place"))
    kept = held.join(floors, "query_id").where(is_first | (F.col("score") >= F.greatest("min_score", percent_floor(F.col("first.score"), F.col("score_pct")))))
    return kept.select("query_id", "id", "score")


def search(rows: DataFrame, queries: DataFrame, options: SearchOptions | None = None, scope: tuple[str, ...] = ()) -> DataFrame:
    """Ranked results of ``queries (query_id, hashes, ...)`` over ``rows (hash, id[, n], *scope)``.

    ``scope`` names columns, such as the index, that must be equal on both sides.
    """
    options = options or SearchOptions()
    if options.max_docs_per_hash is not None:
        rows = capped_postings(rows, options.max_docs_per_hash)
    asked = batch(queries, options, *scope)
    return ranked(scores(rows, asked, *scope), asked)
