"""Even-load counts, incremental partitions, copy-on-write state and search against plain Python on small cases."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hashloom.operators import merge, state
from hashloom.operators.cow import BucketedTable
from hashloom.operators.incremental import IncrementalTable
from hashloom.operators.search import SearchOptions, counted_postings, postings, search
from hashloom.operators.skew import chunk_states, chunked_counts, key_chunks, number_rows


def expected_counts(rows):
    out = {}
    for key, item in rows:
        n, items = out.setdefault(key, (0, set()))
        out[key] = (n + 1, items | ({item} if item is not None else set()))
    return {k: (n, len(i)) for k, (n, i) in out.items()}


@pytest.mark.parametrize("chunk_rows", [1, 3, 7, 1000])
def test_chunked_counts(spark, chunk_rows):
    rnd = random.Random(chunk_rows)
    rows = [(rnd.choice([1, 1, 1, 1, 2, 3, None]), rnd.choice([None, *range(20)])) for _ in range(600)] + [(9, 4)] * 200
    df = spark.createDataFrame([(k, i, "x") for k, i in rows], "key bigint, item bigint, n string").repartition(5)
    got = {r.key: (r.n, r.n_items) for r in chunked_counts(df, "key", "item", chunk_rows).collect()}
    assert got == expected_counts(rows)


def test_chunked_counts_of_strings_and_nothing(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), (None, None), ("b", None)], "k string, v string")
    assert sorted(map(tuple, chunked_counts(df, "k", "v", 2).collect()), key=str) == sorted([("a", 2, 1), (None, 1, 0), ("b", 1, 0)], key=str)
    assert chunked_counts(df.limit(0), "k", "v").collect() == []


def test_chunks_are_equal_and_numbered(spark):
    df = spark.range(1000).select(F.lit(1).alias("k"), F.col("id").alias("v")).repartition(7)
    states = chunk_states(df, "k", "v", 50).orderBy("first_row").collect()
    assert max(c.n for c in states) <= 50 and sum(c.n for c in states) == 1000
    # The offsets number the rows on over the partitions, and the numbers alone decide where chunks end.
    assert [c.first_row for c in states] == [sum(d.n for d in states[:i]) for i in range(len(states))]
    assert all(c.chunk == c.first_row // 50 for c in states)
    chunks = key_chunks(df, "k", "v", 50).orderBy("chunk").collect()
    assert [(c.chunk, c.n, c.n_items, c.first_item, c.last_item) for c in chunks] == [(i, 50, 50, 50 * i, 50 * i + 49) for i in range(20)]


def test_chunks_of_files_read_in_pieces(spark):
    """The scan of the numbered rows may cut or pack their files."""
    df = spark.createDataFrame([(1 if i % 3 else i, i // 4) for i in range(4000)], "k bigint, v bigint").repartition(6)
    want = expected_counts([tuple(r) for r in df.collect()])
    for size in ("2k", "64m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            assert {r.key: (r.n, r.n_items) for r in chunked_counts(df, "k", "v", 100).collect()} == want
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_nan_is_one_key(spark):
    df = spark.createDataFrame([(float("nan"), 1), (float("nan"), 2), (1.0, 2)], "k double, v bigint")
    assert sorted((str(r.key), r.n, r.n_items) for r in chunked_counts(df, "k", "v", 1).collect()) == [("1.0", 1, 1), ("nan", 2, 2)]


def test_rows_are_numbered_exactly(spark):
    rnd = random.Random(12)
    rows = [(rnd.choice([1, 1, 1, 1, 2, None]), rnd.choice([None, *range(9)]), "x") for _ in range(500)]
    df = spark.createDataFrame(rows, "k bigint, v bigint, row_no string").repartition(6)
    got = {}
    for r in number_rows(df, "k", "v").collect():
        got.setdefault(r.k, []).append((r.row_no, r.v))
    order = lambda v: (v is not None, v or 0)
    for key in (1, 2, None):
        assert [v for _, v in sorted(got[key])] == sorted((v for k, v, _ in rows if k == key), key=order)
        assert [n for n, _ in sorted(got[key])] == list(range(len(got[key])))
    chunks = key_chunks(df, "k", "v", 40)
    assert all(c.n == 40 for c in chunks.collect() if (c.chunk + 1) * 40 <= len(got[c.key]))
    assert number_rows(df.limit(0), "k", "v").collect() == []


OUT = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.LongType())])


def run_incremental(spark, folder, rows, seen):
    df = spark.createDataFrame(rows, "k string, v bigint")

    def compute(part):
        seen.append({r.k for r in part.select("k").distinct().collect()})
        return part.where("v > 0").select("part", "k", "v").distinct()

    table = IncrementalTable(spark, folder)
    n = table.run(df, F.col("k"), ["k", "v"], compute, OUT)
    return n, sorted(map(tuple, table.read(OUT).collect()))


def test_incremental_recomputes_only_changed(spark, folder):
    seen = []
    assert run_incremental(spark, folder, [("a", 1), ("b", 2), ("b", 2)], seen) == (2, [("a", 1), ("b", 2)])
    assert run_incremental(spark, folder, [("b", 2), ("a", 1), ("b", 2)], seen)[0] == 0
    assert run_incremental(spark, folder, [("a", 1), ("b", 2), ("b", 3), ("c", None)], seen) == (2, [("a", 1), ("b", 2), ("b", 3)])
    assert seen[-1] == {"b", "c"}
    # A partition whose rows are gone, and one whose result is empty now.
    assert run_incremental(spark, folder, [("a", -1), ("c", None)], seen) == (1, [])
    assert run_incremental(spark, folder, [], seen) == (0, [])


def test_incremental_repeats_a_run_that_died(spark, folder):
    class Died(Exception):
        pass

    df = spark.createDataFrame([("a", 1)], "k string, v bigint")

    def dies(part):
        raise Died

    table = IncrementalTable(spark, folder)
    with pytest.raises(Died):
        table.run(df, F.col("k"), ["k", "v"], dies, OUT)
    assert table.read(OUT).collect() == []
    assert run_incremental(spark, folder, [("a", 1)], []) == (1, [("a", 1)])


def test_incremental_never_reads_what_a_dead_run_wrote(spark, folder, monkeypatch):
    """The run dies after its rows were written and before its commit; then the source goes back to what it was."""
    from hashloom.operators import incremental

    first, second = [("a", 1), ("b/ c=%", 2)], [("a", 7), ("b/ c=%", 2)]
    assert run_incremental(spark, folder, first, []) == (2, first)
    write = incremental.files.write_json

    def dies(spark, path, value):
        raise OSError(path)

    for _ in range(2):
        monkeypatch.setattr(incremental.files, "write_json", dies)
        with pytest.raises(OSError):
            run_incremental(spark, folder, second, [])
        monkeypatch.setattr(incremental.files, "write_json", write)
        # What was not committed isn't seen, neither now nor after a run on the old source.
        assert sorted(map(tuple, IncrementalTable(spark, folder).read(OUT).collect())) == first
    assert run_incremental(spark, folder, first, []) == (0, first)
    assert run_incremental(spark, folder, second, []) == (1, second)
    assert run_incremental(spark, folder, [*second, ("c", 3)], []) == (1, [*second, ("c", 3)])
    assert run_incremental(spark, folder, second, []) == (0, second)


def test_incremental_deletes_what_was_replaced(spark, folder):
    reader = None
    for v in range(1, 5):
        assert run_incremental(spark, folder, [("a=b", v), ("c", 0)], [])[0] == (2 if v == 1 else 1)
        if reader is not None:  # a reader of the state before a run can still end
            assert reader.collect() == [(("a=b"), v - 1)]
        reader = IncrementalTable(spark, folder).read(OUT)
    assert IncrementalTable(spark, folder).vacuum() <= 1
    assert IncrementalTable(spark, folder).vacuum() == 0
    assert [tuple(r) for r in reader.collect()] == [("a=b", 4)]


CHANGES = "op string, id bigint, pos bigint, v string"


def test_bucketed_table_in_any_order(spark, folder):
    rnd = random.Random(3)
    ops = [(rnd.choice("iiid"), rnd.randint(1, 12), pos, f"v{pos}") for pos in range(80)] + [("x", 1, 999, "?"), (None, 2, 999, "?"), ("i", None, 999, "?")]
    want = {}
    for op, key, _, v in ops[:80]:
        want[key] = v if op == "i" else None
    want = {(k, v) for k, v in want.items() if v}
    rnd.shuffle(ops)
    ops += ops[:30]
    table = BucketedTable(spark, folder, ["id"], ["pos"], ["v"], 4)
    assert table.live() is None
    for start in range(0, len(ops), 40):
        table.apply(spark.createDataFrame(ops[start : start + 40], CHANGES))
    assert {(r.id, r.v) for r in table.live().collect()} == want
    before = table.live()
    touched = table.apply(spark.createDataFrame([("d", 3, 1000, None)], CHANGES))
    assert len(touched) == 1
    assert {r.id for r in table.live().collect()} == {k for k, _ in want} - {3}
    assert {(r.id, r.v) for r in before.collect()} == want  # the older manifest's files are still there
    assert table.vacuum() > 0
    assert {r.id for r in table.live().collect()} == {k for k, _ in want} - {3}
    assert table.apply(spark.createDataFrame([], CHANGES)) == []
    with pytest.raises(ValueError):
        BucketedTable(spark, folder, ["id"], ["pos"], ["bucket"])


def test_bucketed_table_grows_and_leaves_buckets_untouched(spark, folder):
    """A table ten times its first batch is hashed into more buckets; a batch of few keys leaves most of them as they were."""
    table = BucketedTable(spark, folder, ["id"], ["pos"], ["v"], 2, rows_per_bucket=50)
    table.apply(spark.range(80).selectExpr("'i' AS op", "id", "id AS pos", "'a' AS v"))
    assert table.buckets == 2
    assert len(table.apply(spark.range(40, 800).selectExpr("'i' AS op", "id", "id + 1000 AS pos", "'b' AS v"))) == table.buckets == 32
    assert {(r.id, r.v) for r in table.live().collect()} == {(i, "a" if i < 40 else "b") for i in range(800)}
    before = table._manifest()["folders"]
    again = BucketedTable(spark, folder, ["id"], ["pos"], ["v"], rows_per_bucket=50)
    touched = again.apply(spark.createDataFrame([("d", 3, 9000, None), ("i", 4, 1, "late")], CHANGES))
    after = again._manifest()["folders"]
    assert len(touched) <= 2 and {b for b in after if after[b] != before[b]} == {str(b) for b in touched}
    rows = {r.id: r.v for r in again.live().collect()}
    assert 3 not in rows and rows[4] == "a" and len(rows) == 799


def test_bucketed_table_with_a_hot_key(spark, folder):
    """One key changed a million times: one row of each task goes through the shuffle."""
    table = BucketedTable(spark, folder, ["id"], ["pos"], ["v"])
    changes = spark.range(0, 1_000_000, 1, 8).selectExpr("'i' AS op", "if(id % 1000 = 0, id, 7L) AS id", "(id * 7919) % 1000003 AS pos", "cast(id AS string) AS v", "1 AS bucket")
    plan = table._last(changes.select("op", "id", "pos", "v"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Aggregate") == 2 and plan.count("Exchange") == 1 and plan.index("Exchange") < plan.rindex("Aggregate")
    table.apply(changes)
    rows = {r.id: r.pos for r in table.live().collect()}
    assert len(rows) == 1001 and rows[7] == max((i * 7919) % 1000003 for i in range(1_000_000) if i % 1000)


def test_bucketed_table_of_null_payloads_and_no_rows(spark, folder):
    table = BucketedTable(spark, folder, ["id"], ["pos"], ["v"], 3)
    table.apply(spark.createDataFrame([("i", 1, 5, None), ("i", 1, 5, "x"), ("d", 1, 5, "z"), ("i", 2, None, "n"), ("i", 2, 0, "o")], CHANGES))
    assert {(r.id, r.v) for r in table.live().collect()} == {(1, "x"), (2, "o")}
    assert table.apply(spark.createDataFrame([("q", 1, 9, "y"), ("i", None, 9, "y")], CHANGES)) == []


def brute_search(docs, query, limit=40, min_score=None, pct=10):
    floor = max((len(query) + 19) // 20 if min_score is None else min_score, 1)
    found = sorted(((d, sum(h in set(query) for h in hs)) for d, hs in docs.items()), key=lambda x: (-x[1], x[0]))
    found = [f for f in found if f[1] >= floor]
    cut = max(floor, found[0][1] * pct // 100) if found else 0
    return [f for i, f in enumerate(found[:limit]) if i == 0 or f[1] >= cut]


@pytest.mark.parametrize("folded", [True, False])
def test_search_against_brute_force(spark, folded):
    rnd = random.Random(5)
    docs = {d: [rnd.randint(0, 40) for _ in range(rnd.randint(0, 25))] for d in range(1, 80)}
    frame = spark.createDataFrame(list(docs.items()), "id bigint, hashes array<bigint>")
    rows = counted_postings(frame) if folded else postings(frame)
    queries = {q: [rnd.randint(0, 40) for _ in range(rnd.randint(0, 45))] for q in range(12)}
    asked = spark.createDataFrame(list(queries.items()), "query_id bigint, hashes array<bigint>")
    for options in (SearchOptions(), SearchOptions(limit=3, min_score=0, score_pct=60), SearchOptions(limit=500, score_pct=200, clamped=False)):
        got = {}
        for r in search(rows, asked, options).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.id, r.score))
        for q, hashes in queries.items():
            assert got.get(q, []) == brute_search(docs, hashes, options.limit or 40, options.min_score, options.score_pct)


@pytest.mark.parametrize(("most_probes", "cells"), [(10**6, 10**6), (10**6, 40), (0, 0)])
def test_search_docs_equals_search(spark, monkeypatch, most_probes, cells):
    """The score table in one block and in many, and the join beyond the bound of the queries."""
    from hashloom.operators import kernel

    monkeypatch.setattr(kernel, "CELLS", max(cells, 1))
    rnd = random.Random(8)
    bag = lambda n: [rnd.choice([None, -1, *range(12), rnd.randint(0, 2**32 - 1)]) for _ in range(rnd.randint(0, n))]
    docs = [(d, bag(30), rnd.choice(["a", "a", "b", None]), 1) for d in [*range(1, 150), 2**32 - 1]] + [(500, None, "a", 1), (501, [], "b", 1)]
    asked = [(q, bag(30), rnd.choice(["a", "a", "b", "c", None]), rnd.choice([None, 1, 7, 1000]), rnd.choice([None, 0, 4]), rnd.choice([None, 0, 50, 150])) for q in range(40)]
    docs = spark.createDataFrame(docs, "id bigint, hashes array<bigint>, part string, score int").repartition(3)
    asked = spark.createDataFrame(asked + [(90, None, "a", 1, 1, 1)], "query_id bigint, hashes array<bigint>, part string, limit bigint, min_score bigint, score_pct bigint")
    for scope in ((), ("part",)):
        want = sorted(map(tuple, search(counted_postings(docs, *scope), asked, scope=scope).collect()))
        assert want and sorted(map(tuple, kernel.search_docs(docs, asked, scope=scope, most_probes=most_probes).collect())) == want
    assert kernel.search_docs(docs.limit(0), asked, most_probes=most_probes).collect() == []
    assert kernel.search_docs(docs, asked.limit(0), most_probes=most_probes).collect() == []


@pytest.mark.parametrize(("cells", "dense", "task_queries"), [(10**6, 1 / 700, 2000), (1, 0, 7), (500, 2, 2000), (40, 0.02, 7)])
def test_large_batches_keep_hits_in_their_tasks(spark, monkeypatch, cells, dense, task_queries):
    """Many queries with limits aren't joined with postings; all hashes as matrix rows, none and some, one document a table and many."""
    from hashloom.operators import kernel

    def joined(*args):
        raise AssertionError("hits are joined")

    monkeypatch.setattr(kernel, "scores", joined)
    for name, value in (("MOST_KEPT", 10), ("TABLE_CELLS", cells), ("DENSE", dense), ("TASK_QUERIES", task_queries), ("READ_DOCS", 16)):
        monkeypatch.setattr(kernel, name, value)
    rnd = random.Random(9)
    bag = lambda n: [rnd.choice([None, -1, 1, 1, 2, *range(25), rnd.randint(0, 2**32 - 1)]) for _ in range(rnd.randint(0, n))]
    docs = [(d, bag(40), rnd.choice(["a", "a", "b", None])) for d in rnd.sample(range(1000), 300)] + [(2000, None, "a"), (2001, [], "b"), (None, [1], "a"), (5000, [1, 2], "d")]
    asked = [(q, bag(20), rnd.choice(["a", "a", "b", "c", None]), rnd.choice([None, 0, 1, 3, 100, 10**6]), rnd.choice([None, 0, 4, 10**12]), rnd.choice([None, -5, 0, 50, 100, 150, 10**15])) for q in range(60)]
    docs = spark.createDataFrame(docs, "id bigint, hashes array<bigint>, part string").repartition(3)
    asked = spark.createDataFrame([*asked, (90, None, "a", 1, 1, 1)], "query_id bigint, hashes array<bigint>, part string, limit bigint, min_score bigint, score_pct bigint")
    for scope in ((), ("part",)):
        want = sorted(map(tuple, search(counted_postings(docs.where("id is not null"), *scope), asked, scope=scope).collect()))
        assert want and sorted(map(tuple, kernel.search_docs(docs, asked, scope=scope).collect())) == want


@pytest.mark.parametrize(("most_probes", "most_kept"), [(10**6, 10**6), (0, 10**6), (10**6, 10)])
def test_search_docs_with_repeated_and_invalid_ids(spark, monkeypatch, most_probes, most_kept):
    """Rows of one id are one bag and invalid ids are left out, whether scores are tabled or joined."""
    from hashloom.operators import kernel

    monkeypatch.setattr(kernel, "MOST_KEPT", most_kept)
    docs = spark.createDataFrame([(1, [1, 2], "a"), (1, [3, 4, 4], "a"), (2, [1], "a"), (None, [1, 2, 3, 4], "a"), (-5, [1], "a"), (2**32, [1], "a"), (1, None, "a"), (2, [1, 2], "b"), (3, [1], None), (3, [2], None)], "id bigint, hashes array<bigint>, part string").repartition(3)
    asked = spark.createDataFrame([(1, [1, 2, 3, 4], "a"), (2, [1, 2], "b"), (3, [2], None)], "query_id bigint, hashes array<bigint>, part string")
    rows = lambda found: sorted(map(tuple, found.collect()))
    want = [(1, 1, 5, 1), (1, 2, 3, 2), (1, 3, 2, 3), (2, 1, 2, 2), (2, 2, 3, 1), (2, 3, 2, 3), (3, 1, 1, 1), (3, 2, 1, 2), (3, 3, 1, 3)]
    assert rows(kernel.search_docs(docs, asked, most_probes=most_probes)) == want
    assert rows(kernel.search_docs(docs, asked, scope=("part",), most_probes=most_probes)) == [(1, 1, 5, 1), (1, 2, 1, 2), (2, 2, 2, 1)]
    assert rows(kernel.search_all_docs(docs, asked, scope=("part",), most_probes=most_probes)) == [(1, 1, 5), (1, 2, 1), (2, 2, 2)]


@pytest.mark.parametrize(("most_probes", "cells"), [(10**6, 10**6), (10**6, 40), (0, 0)])
def test_search_all_docs_has_no_limit(spark, monkeypatch, most_probes, cells):
    from hashloom.operators import kernel

    monkeypatch.setattr(kernel, "CELLS", max(cells, 1))
    docs = spark.createDataFrame([(i, [1, 2, 3] if i <= 150 else [1, 2] if i <= 200 else [1, 4]) for i in range(1, 251)], "id bigint, hashes array<bigint>").repartition(3)
    asked = spark.createDataFrame([(1, [1, 2, 3], 2, 0), (2, [1, 2, 3], 1, 50), (3, [1, 2], 1, 150), (4, [9], 1, 0)], "query_id bigint, hashes array<bigint>, min_score bigint, score_pct bigint")
    rows = kernel.search_all_docs(docs, asked, most_probes=most_probes).collect()
    assert sorted(map(tuple, rows)) == [
        *((1, i, 3 if i <= 150 else 2) for i in range(1, 201)), *((2, i, 3 if i <= 150 else 2 if i <= 200 else 1) for i in range(1, 251)), (3, 1, 2),
    ]
    assert kernel.search_all_docs(docs.limit(0), asked, most_probes=most_probes).collect() == []


def test_search_nulls_signed_and_empty(spark):
    docs = spark.createDataFrame([(1, [-1, None, 7]), (2, None), (3, [])], "id bigint, hashes array<bigint>")
    asked = spark.createDataFrame([(1, [4294967295, None]), (2, None), (3, [])], "query_id bigint, hashes array<bigint>")
    assert [tuple(r) for r in search(counted_postings(docs), asked).collect()] == [(1, 1, 1, 1)]
    assert search(counted_postings(docs.limit(0)), asked).collect() == []


def test_state_ignores_invalid_ids(spark):
    rows = [(1, 1, "insert", 5, [1]), (1, 2, "d", 5, None), (2, 1, "i", 5, [2]), (2, 2, None, 6, [1]), (3, 1, "insert", 0, [1]), (3, 2, "delete", None, None)]
    changes = spark.createDataFrame(rows, "commit_id bigint, ordinal bigint, op string, id bigint, hashes array<bigint>")
    assert [tuple(r) for r in state.doc_versions(changes).collect()] == [(5, 2, False)]
    assert state.tombstones(changes).collect() == []


def test_delta_round_trip_with_a_hot_hash(spark):
    pairs = {(1, i) for i in range(1, 500)} | {(h, h * 3) for h in range(2, 50)}
    df = spark.createDataFrame(sorted(pairs), "hash bigint, id bigint")
    coded = merge.delta_encoded(df)
    back = merge.delta_decoded(coded.select("hash", F.col("id").alias("place"), "delta"))
    assert {(r.hash, r.id) for r in back.collect()} == pairs
    assert {r.delta for r in coded.where("hash = 1").collect()} == {1}
