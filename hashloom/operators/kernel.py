"""Batch search over whole documents: every document meets all queries of its scope at once.

Where the queries are few enough to be sent to every executor, and so are the best rows of all that a
task keeps (their hashes, number and limits are counted first), scoring needs neither postings nor a shuffle of hits: a block of documents and the
queries of a scope form a table of scores, filled by one counting pass over the hashes they
share, and only each query's best rows of a partition leave it.

Batches of more queries than that are dealt to tasks, and each task reads the documents of its scopes, staged
once, piece by piece (``best_of_all``). Hashes that many documents and many queries hold fill its tables of
scores as a product of matrices, the others are added one by one. Cells below a query's least score, which rises
with its best rows so far, are passed over; so a task ends with the final rows of its queries and no hit is shuffled.

Caps of hashes and limits beyond ``MOST_LIMIT`` take the join of ``operators.search``. All ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hashloom.functions.ints import U32_MAX
from hashloom.operators.search import MOST_LIMIT, Batch, SearchOptions, batch, capped_postings, counted_postings, qualifying, ranked, scores
from hashloom.runtime import Shared, small_side, stage

#: Hashes of all queries together that are sent to executors, at most.
MOST_PROBES = 4_000_000
#: Best rows that a task keeps of all queries together, at most: 8 bytes each, a few copies at a time.
MOST_KEPT = 4_000_000
#: Cells of a score table and shared hashes counted in one step.
CELLS = 4_000_000
#: Queries that documents are brought to, at most; more are dealt to tasks that read the documents.
MOST_QUERIES = 3_000
#: Queries and their hashes that one such task takes, about.
TASK_QUERIES, TASK_PROBES = 4_000, 1_000_000
#: Cells of a score table there, which stays in the cache, and documents read at a time.
TABLE_CELLS, READ_DOCS = 1_000_000, 4096
#: A hash has a row in the product of matrices if it is shared by at least this part of all (document, query) pairs; rows at most.
DENSE, MOST_DENSE = 1 / 700, 256


@dataclass
class Probes:
    """Queries of one scope: for each hash (sorted) the queries that hold it."""

    hashes: np.ndarray
    start: np.ndarray
    query: np.ndarray
    query_ids: np.ndarray
    floors: np.ndarray
    #: Best rows of each query that are kept; None keeps all.
    keep: int | None


def _probes(table: pa.Table, most: int | None) -> Probes:
    lists = table.column("hashes").combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    first = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]]) if len(flat) else np.zeros(0, np.int64)
    ids, floors = (table.column(c).to_numpy() for c in ("query_id", "min_score"))
    return Probes(flat[first], np.append(first, len(flat)), owner, ids, floors, most)


def _block(probes: Probes, row: np.ndarray, place: np.ndarray, ids: np.ndarray, top: np.ndarray | None) -> np.ndarray:
    """Best (score, id) of each query so far (all of this block if none is cut), packed so that greater is better; 0 where there is none."""
    queries = len(probes.query_ids)
    counts = probes.start[place + 1] - probes.start[place]
    at = np.repeat(probes.start[place] - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())
    cell = np.repeat(row, counts) * queries + probes.query[at]
    score = np.bincount(cell, minlength=len(ids) * queries).reshape(len(ids), queries)
    packed = np.where(score >= probes.floors, (score << 32) | (U32_MAX - ids)[:, None], 0)
    if probes.keep is None:
        return packed
    both = packed if top is None else np.vstack([top, packed])
    return np.partition(both, -probes.keep, axis=0)[-probes.keep :] if len(both) > probes.keep else both


def _rows(probes: Probes, cells: np.ndarray) -> pa.RecordBatch:
    at, query = np.nonzero(cells)
    packed = cells[at, query]
    return pa.RecordBatch.from_arrays([pa.array(probes.query_ids[query]), pa.array(U32_MAX - (packed & U32_MAX)), pa.array(packed >> 32)], names=["query_id", "id", "score"])


def _score(shared, scopes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_scope: dict[tuple, Probes] = shared.value
        tops: dict[tuple, np.ndarray] = {}
        for rows_in in batches:
            keys = list(zip(*(rows_in.column(2 + i).to_pylist() for i in range(scopes)), strict=True)) if scopes else [()] * rows_in.num_rows
            rows_of: dict[tuple, list[int]] = {}
            for number, key in enumerate(keys):
                if key in by_scope:
                    rows_of.setdefault(key, []).append(number)
            for key, numbers in rows_of.items():
                probes = by_scope[key]
                part = rows_in.take(pa.array(numbers))
                lists = part.column(1)
                flat, parent = lists.flatten(), pc.list_parent_indices(lists)
                valid = flat.is_valid()
                hashes = flat.filter(valid).to_numpy(zero_copy_only=False).astype(np.int64) & U32_MAX
                row = parent.filter(valid).to_numpy(zero_copy_only=False).astype(np.int64)
                place = np.searchsorted(probes.hashes, hashes)
                place[place == len(probes.hashes)] = 0
                met = probes.hashes[place] == hashes if len(probes.hashes) else np.zeros(len(hashes), bool)
                row, place = row[met], place[met]
                ids = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                cost = np.cumsum(probes.start[place + 1] - probes.start[place])
                # Documents without a shared hash take no row of the table.
                docs, row = np.unique(row, return_inverse=True)
                most_docs = max(1, CELLS // max(len(probes.query_ids), 1))
                begin = 0
                while begin < len(docs):
                    first = int(np.searchsorted(row, begin))
                    spent = cost[first - 1] if first else 0
                    end = int(row[min(int(np.searchsorted(cost, spent + CELLS)), len(row) - 1)]) + 1
                    end = min(max(end, begin + 1), begin + most_docs, len(docs))
                    last = int(np.searchsorted(row, end))
                    cells = _block(probes, row[first:last] - begin, place[first:last], ids[docs[begin:end]], tops.get(key))
                    if probes.keep is None:
                        yield _rows(probes, cells)
                    else:
                        tops[key] = cells
                    begin = end
        for key, top in tops.items():
            yield _rows(by_scope[key], top)

    return run


def search_docs(docs: DataFrame, queries: DataFrame, options: SearchOptions | None = None, scope: tuple[str, ...] = (), most_probes: int = MOST_PROBES, ids: DataFrame | None = None) -> DataFrame:
    """Ranked ``(query_id, id, score, rank)`` of ``queries`` over ``docs (id, hashes, *scope)``.

    Query ids are BIGINT and unique. The rows are those of ``search`` over the documents' postings, whichever
    way is taken: several rows of one id (in one scope) are one bag with the elements of all; rows whose id is null
    or no u32 are left out. ``ids (id, *scope)``: the ids of all rows, or more, where they are cheaper to read than ``docs``.
    """
    options = options or SearchOptions()
    asked = batch(queries, options, *scope)
    many = asked.queries > MOST_QUERIES or asked.probes > most_probes or asked.queries * asked.limit > MOST_KEPT
    if many and options.max_docs_per_hash is None and asked.limit <= MOST_LIMIT:
        return best_of_all(whole_documents(docs, scope, ids), asked, scope)
    return ranked(_found(docs, asked, options, scope, most_probes, max(asked.limit, 1), ids), asked)


def search_all_docs(docs: DataFrame, queries: DataFrame, options: SearchOptions | None = None, scope: tuple[str, ...] = (), most_probes: int = MOST_PROBES, ids: DataFrame | None = None) -> DataFrame:
    """As ``search_docs``, but ``(query_id, id, score)`` of every document at or above the floors: no limit is applied."""
    asked = batch(queries, options or SearchOptions(), *scope)
    return qualifying(_found(docs, asked, options or SearchOptions(), scope, most_probes, None, ids), asked)


def whole_documents(docs: DataFrame, scope: tuple[str, ...], ids: DataFrame | None = None) -> DataFrame:
    """``(id, hashes, *scope)`` with one row for each id of a scope.

    Ids are counted (they alone are shuffled); only the rows of those that come more than once are then put together.
    """
    rows = docs.select(F.col("id").cast("bigint").alias("id"), "hashes", *scope).where(f"hashes is not null and id between 0 and {U32_MAX}")
    several = small_side((rows if ids is None else ids).groupBy("id", *scope).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n"), "repeated")
    if several.isEmpty():
        return rows
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in ("id", *scope)]
    alone = rows.alias("r").join(several.alias("s"), same, "left_anti")
    parts = rows.alias("r").join(several.alias("s"), same, "left_semi")
    return alone.unionByName(parts.groupBy("id", *scope).agg(F.flatten(F.collect_list("hashes")).alias("hashes")).select("id", "hashes", *scope))


def _found(docs: DataFrame, asked: Batch, options: SearchOptions, scope: tuple[str, ...], most_probes: int, keep: int | None, ids: DataFrame | None) -> DataFrame:
    """``(query_id, id, score)`` at or above each query's absolute floor; of every partition the best ``keep`` of a query."""
    cells = asked.queries * (keep or 0)
    if options.max_docs_per_hash is not None or asked.probes > most_probes or cells > MOST_KEPT:
        rows = counted_postings(docs.where(f"id between 0 and {U32_MAX}"), *scope)
        if options.max_docs_per_hash is not None:
            rows = capped_postings(rows, options.max_docs_per_hash)
        return scores(rows, asked, *scope)
    table = asked.frame.where(F.size("hashes") > 0).select("query_id", "hashes", "min_score", *scope).toArrow()
    keys = list(zip(*(table.column(c).to_pylist() for c in scope), strict=True)) if scope else [()] * table.num_rows
    rows_of: dict[tuple, list[int]] = {}
    for number, key in enumerate(keys):
        rows_of.setdefault(key, []).append(number)
    by_scope = {key: _probes(table.take(pa.array(numbers)), keep) for key, numbers in rows_of.items() if None not in key}
    found = whole_documents(docs, scope, ids)
    return found.mapInArrow(_score(Shared(docs.sparkSession, by_scope), len(scope)), "query_id bigint, id bigint, score bigint")


class Best:
    """The best rows so far of the queries of one scope, ``table (query_id, hashes, limit, min_score, score_pct)``."""

    def __init__(self, table: pa.Table) -> None:
        self.probes = _probes(table, None)
        self.held = np.diff(self.probes.start)
        self.limit, self.floor = (table.column(c).to_numpy().astype(np.int64) for c in ("limit", "min_score"))
        # Greater ones leave the first row only, as this does; its product with a score fits 64 bits.
        self.pct = np.clip(table.column("score_pct").to_numpy().astype(np.int64), 0, 1 << 30)
        #: What a row must score to get among the best.
        self.least = self.floor.copy()
        self.query, self.packed = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.more: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting, self.tables = 0, 0

    def add(self, docs: pa.RecordBatch) -> None:
        """Documents ``(_scope, id, hashes)``. None scores more than it has elements that the queries hold."""
        probes = self.probes
        sizes = pc.list_value_length(docs.column(2)).to_numpy(zero_copy_only=False)
        long = sizes >= self.least.min()
        if not long.any():
            return
        docs = docs if long.all() else docs.filter(pa.array(long))
        open_ = self.least <= sizes.max()
        ids, lists = docs.column(1).to_numpy(), docs.column(2)
        flat, parent = lists.flatten(), pc.list_parent_indices(lists)
        valid = flat.is_valid()
        hashes = flat.filter(valid).to_numpy(zero_copy_only=False).astype(np.int64) & U32_MAX
        row = parent.filter(valid).to_numpy(zero_copy_only=False).astype(np.int64)
        held = np.flatnonzero(np.logical_or.reduceat(open_[probes.query], probes.start[:-1]))
        known = probes.hashes[held]
        place = np.searchsorted(known, hashes)
        place[place == len(known)] = 0
        met = known[place] == hashes
        row, place = row[met], held[place[met]]
        # Those that share most come first; those that share too little take no row of a table.
        bound = np.bincount(row, minlength=len(ids))
        order = np.argsort(-bound, kind="stable")[: np.count_nonzero(bound >= self.least.min())]
        number = np.full(len(ids), -1)
        number[order] = np.arange(len(order))
        row, place = number[row[number[row] >= 0]], place[number[row] >= 0]
        by_row = np.argsort(row, kind="stable")
        self._add(ids[order], bound[order], row[by_row], place[by_row])

    def _add(self, ids: np.ndarray, bound: np.ndarray, row: np.ndarray, place: np.ndarray) -> None:
        """Documents ``ids`` by how many elements they share, and these: the document's place in ``ids``, ascending, and the hash's place."""
        if not len(row):
            return
        probes, queries = self.probes, len(self.limit)
        shared = np.bincount(place, minlength=len(self.held)) * self.held
        dense = np.flatnonzero(shared >= max(DENSE * len(ids) * queries, 1))
        dense = dense[np.argsort(-shared[dense], kind="stable")[:MOST_DENSE]]
        # Sums of whole numbers below 2**24 are exact in 32 bits.
        kind = np.float32 if bound[0] < 1 << 24 else np.float64
        column = np.full(len(self.held), -1)
        column[dense] = np.arange(len(dense))
        asked = np.zeros((len(dense), queries), kind)
        for at, hash_place in enumerate(dense):
            asked[at, probes.query[probes.start[hash_place] : probes.start[hash_place + 1]]] = 1
        at = column[place]
        bags = np.bincount(row[at >= 0] * len(dense) + at[at >= 0], minlength=len(ids) * len(dense)).reshape(len(ids), len(dense)).astype(kind)
        row, place = row[at < 0], place[at < 0]
        spent = np.r_[0, np.cumsum(self.held[place])]
        begin = 0
        while begin < len(ids):
            # Queries that a document sharing so much may still answer; later ones share less.
            of = np.flatnonzero(self.least <= bound[begin])
            if not len(of):
                break
            turned = np.full(queries, -1)
            turned[of] = np.arange(len(of))
            end = min(begin + max(1, TABLE_CELLS // len(of)), len(ids))
            table = bags[begin:end] @ (asked if len(of) == queries else asked[:, of])
            cells, (at, last) = table.reshape(-1), np.searchsorted(row, [begin, end])
            while at < last:
                upto = min(last, max(at + 1, int(np.searchsorted(spent, spent[at] + TABLE_CELLS, "right")) - 1))
                counts = self.held[place[at:upto]]
                entry = np.repeat(probes.start[place[at:upto]] - (spent[at:upto] - spent[at]), counts) + np.arange(counts.sum())
                query = turned[probes.query[entry]]
                np.add.at(cells, (np.repeat((row[at:upto] - begin) * len(of), counts) + query)[query >= 0], kind(1))
                at = upto
            self._take(table, ids[begin:end], of)
            begin = end

    def _take(self, table: np.ndarray, ids: np.ndarray, of: np.ndarray) -> None:
        """Cells of documents ``ids`` and queries ``of`` that can be among the best."""
        docs, queries = table.shape
        self.tables += 1
        if self.tables == 1:
            # The k-th best of these documents bounds the k-th best of all from below.
            some = np.flatnonzero(self.limit[of] <= docs)
            kth = np.sort(table, axis=0)[docs - self.limit[of[some]], some].astype(np.int64)
            self.least[of[some]] = np.maximum(self.least[of[some]], kth)
        at = np.flatnonzero(table >= self.least[of].astype(table.dtype))
        score, (row, query) = table.reshape(-1)[at].astype(np.int64), np.divmod(at, queries)
        exact = score >= self.least[of[query]]
        self.more.append((of[query[exact]], (score[exact] << 32) | (U32_MAX - ids[row[exact]])))
        self.waiting += len(self.more[-1][0])
        if self.waiting > max(2 * len(self.query), 20_000):
            self._cut()

    def _cut(self) -> np.ndarray:
        """Keep what can be among the best rows; the kept rows' ranks from 0."""
        query, packed = (np.concatenate(x) for x in zip((self.query, self.packed), *self.more, strict=True))
        self.more, self.waiting = [], 0
        order = np.lexsort((-packed, query))
        query, packed = query[order], packed[order]
        first = np.searchsorted(query, np.arange(len(self.limit)))
        rank, score = np.arange(len(query)) - first[query], packed >> 32
        cut = (score[first[query]] * self.pct[query]) // 100
        keep = (rank < self.limit[query]) & ((rank == 0) | (score >= np.maximum(self.floor[query], cut)))
        self.query, self.packed, rank = query[keep], packed[keep], rank[keep]
        score, last = self.packed >> 32, rank == self.limit[self.query] - 1
        self.least[self.query[last]] = np.maximum(self.least[self.query[last]], score[last])
        # A later row may be the new first one, which no percentage cuts off.
        best = np.flatnonzero(rank == 0)
        of = self.query[best]
        self.least[of] = np.maximum(self.least[of], np.minimum(score[best], score[best] * self.pct[of] // 100))
        return rank

    def rows(self) -> pa.RecordBatch:
        rank = self._cut()
        found = (self.probes.query_ids[self.query], U32_MAX - (self.packed & U32_MAX), self.packed >> 32, rank + 1)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["query_id", "id", "score", "rank"])


def _best(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        table = pa.Table.from_batches(parts) if parts else None
        if not table or not table.num_rows:
            return
        numbers = table.column("_scope").to_numpy()
        by_scope = {int(n): Best(table.filter(pa.array(numbers == n))) for n in np.unique(numbers)}
        files, path = pafs.FileSystem.from_uri(folder)
        schema = pa.schema([("_scope", pa.int32()), ("id", pa.int64()), ("hashes", pa.list_(pa.field("element", pa.int64())))])
        docs = ds.dataset(path, schema=schema, filesystem=files, format="parquet")
        wanted = (ds.field("_scope") >= int(numbers.min())) & (ds.field("_scope") <= int(numbers.max()))
        for read in docs.to_batches(filter=wanted, batch_size=READ_DOCS, batch_readahead=1, fragment_readahead=1, use_threads=False):
            of = read.column(0).to_numpy()
            ends = np.append(np.flatnonzero(of[1:] != of[:-1]) + 1, len(of)) if len(of) else []
            begin = 0
            for end in map(int, ends):
                if best := by_scope.get(int(of[begin])):
                    best.add(read.slice(begin, end - begin))
                begin = end
        for best in by_scope.values():
            yield best.rows()

    return run


def best_of_all(docs: DataFrame, asked: Batch, scope: tuple[str, ...]) -> DataFrame:
    """Ranked ``(query_id, id, score, rank)`` over ``docs (id, hashes, *scope)`` with one row for each id of a scope, for any number of queries.

    The documents are staged once, by scope and size; executors read them from the shared folder. The large ones come
    first, so that most queries soon need a score that most of the others are too small for.
    """
    frame = asked.frame.where("query_id is not null and limit > 0 and size(hashes) > 0")
    if scope:
        numbered = frame.select(*scope).distinct().withColumn("_scope", F.row_number().over(Window.orderBy(*scope)))
        scopes = small_side(numbered, "scopes")
        docs, frame = docs.join(scopes, list(scope)), frame.join(scopes, list(scope))
    else:
        docs, frame = (df.withColumn("_scope", F.lit(0)) for df in (docs, frame))
    held = stage(docs.select("_scope", "id", F.col("hashes").cast("array<bigint>").alias("hashes")).repartition("_scope", F.col("id") % 64).sortWithinPartitions("_scope", F.size("hashes").desc()), "documents")
    cores = docs.sparkSession.sparkContext.defaultParallelism
    tasks = max(-(-asked.queries // TASK_QUERIES), -(-asked.probes // TASK_PROBES), min(3 * cores, -(-asked.queries // 256)), 1)
    dealt = frame.select("_scope", "query_id", "hashes", "limit", "min_score", "score_pct").repartitionByRange(tasks, "_scope", "query_id")
    return dealt.mapInArrow(_best(held._staged_at), "query_id bigint, id bigint, score bigint, rank bigint")
