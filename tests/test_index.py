"""One lineage: golden cases of search and writes, restarts, torn logs, merges, snapshots."""

import threading

import pytest

from hashloom import errors
from hashloom.catalog import Catalog
from hashloom.index import Index, IndexOptions, delete, insert, restore_snapshot
from hashloom.operators.search import SearchOptions
from hashloom.sources import files


def pairs(found):
    return [(r["id"], r["score"]) for r in found]


def test_insert_replace_delete_and_restart(spark, folder):
    ix = Index(spark, folder)
    assert ix.update([insert(1, [101, 201, 301]), insert(2, [102, 202, 302])]) == 1
    every = [101, 201, 301, 102, 202, 302]
    assert pairs(ix.search([101, 201, 301])) == [(1, 3)]
    assert pairs(ix.search(every)) == [(1, 3), (2, 3)]
    assert ix.update([insert(1, [100, 200, 999])], {"source": "unit", "rev": "1"}) == 2
    assert ix.search([101, 201, 301]) == [] and pairs(ix.search([100, 200, 999])) == [(1, 3)]
    assert ix.get(1) == {"version": 2} and ix.get(2) == {"version": 1}
    again = Index(spark, folder)
    assert again.version == 2 and pairs(again.search([100, 200, 999, 102])) == [(1, 3), (2, 1)]
    assert again.checkpoint(force=True) and not again.checkpoint(force=True)
    assert again.oplog.commits() == []
    assert pairs(again.search([100, 200, 999, 102])) == [(1, 3), (2, 1)]
    again.update([delete(1), delete(2)], {"rev": "2"})
    assert again.search(every) == []
    with pytest.raises(errors.FingerprintNotFound):
        again.get(1)
    assert again.doc_info(1) == {"version": 3, "deleted": True} and again.doc_info(99) is None
    info = again.info()
    assert info["metadata"] == {"source": "unit", "rev": "2"}
    assert info["stats"] == {"min_doc_id": 1, "max_doc_id": 2, "num_segments": 2, "num_docs": 4}


def test_duplicates_in_query_and_document(spark, folder):
    ix = Index(spark, folder)
    ix.insert(1, [100, 200])
    ix.insert(2, [100, 100, 300])
    for _ in range(2):
        assert pairs(ix.search([100, 100])) == [(2, 2), (1, 1)]
        ix.checkpoint(force=True)


def test_last_change_of_a_batch_wins(spark, folder):
    ix = Index(spark, folder)
    ix.update([insert(1, [5]), delete(1), insert(1, [6]), insert(2, [6]), delete(2)])
    assert pairs(ix.search([5, 6])) == [(1, 1)]
    assert ix.doc_info(2) == {"version": 1, "deleted": True}


def test_deletes_survive_merges_and_readers_keep_their_view(spark, folder):
    ix = Index(spark, folder)
    ix.update([insert(i, [100]) for i in range(1, 31)])
    ix.checkpoint(force=True)
    old = ix.reader()
    ix.delete(5)
    ix.checkpoint(force=True)
    ix.update([insert(31, [100])])
    ix.checkpoint(force=True)
    ix.merge(0, 2)
    queries = spark.createDataFrame([(1, [100])], "query_id bigint, hashes array<bigint>")
    options = SearchOptions(limit=100)
    ids = lambda r: {x.id for x in r.search(queries, options).collect()}
    assert ix.vacuum() == 1  # one of the two merged segments is still held by the reader
    assert ids(old) == set(range(1, 31))
    with ix.reader() as now:
        assert ids(now) == set(range(1, 32)) - {5}
    old.close()
    assert ix.vacuum() == 1
    assert pairs(ix.search([100], SearchOptions(limit=1))) == [(1, 1)]
    assert ix.doc_info(5) == {"version": 2, "deleted": True}


def test_a_reader_outlives_checkpoints_and_batches_hold_nothing(spark, folder):
    ix = Index(spark, folder)
    ix.insert(1, [100])
    old = ix.reader()
    ix.update([insert(i, [100]) for i in range(2, 31)])
    later = ix.reader()
    assert ix.checkpoint(force=True)
    ix.delete(5)
    ix.checkpoint(force=True)
    queries = spark.createDataFrame([(1, [100])], "query_id bigint, hashes array<bigint>")
    options = SearchOptions(limit=100)
    found = lambda r: {x.id for x in r.search(queries, options).collect()}
    assert found(old) == {1} and found(later) == set(range(1, 31)) and old.search_one([100], options) == [(1, 1)]
    assert ix.oplog.commits() == [1, 2]
    later.close()
    later.close()
    old.close()
    ix.vacuum()
    assert ix.oplog.commits() == []
    batch = ix.search_batch(queries, options)
    assert not +ix._leases
    ix.insert(7, [1])
    assert {x.id for x in batch.collect()} == set(range(1, 31)) - {5}


def test_searches_leave_no_folder(spark, folder):
    from hashloom import runtime

    ix = Index(spark, folder, options=IndexOptions(scan_metrics_every=0))
    ix.insert(1, [1, 2])
    queries = spark.createDataFrame([(1, [1])], "query_id bigint, hashes array<bigint>")
    root = f"{runtime.shared_dir(spark)}/hashloom/run-{runtime._RUN}"
    before = files.names(spark, root)
    for _ in range(3):
        assert pairs(ix.search([1, 2])) == [(1, 2)]
        runtime.drop_staged(ix.search_batch(queries))
    assert files.names(spark, root) == before


def test_one_query_equals_a_batch(spark, folder):
    """The single search's own plan against the batch's, over segments, a logged commit and all options."""
    import random

    rnd = random.Random(3)
    ix = Index(spark, folder)
    for part in range(3):
        ix.update([insert(rnd.randint(1, 60), [rnd.randint(0, 40) for _ in range(rnd.randint(0, 30))]) if rnd.random() < 0.8 else delete(rnd.randint(1, 60)) for _ in range(50)])
        if part < 2:
            ix.checkpoint(force=True)
    for options in (SearchOptions(), SearchOptions(limit=3, min_score=0, score_pct=60), SearchOptions(limit=0), SearchOptions(limit=0, clamped=False), SearchOptions(limit=500, score_pct=200, clamped=False)):
        query = [rnd.randint(0, 40) for _ in range(rnd.randint(1, 45))]
        rows = ix.search_batch(spark.createDataFrame([(0, query)], "query_id bigint, hashes array<bigint>"), options).orderBy("rank").collect()
        assert pairs(ix.search(query, options)) == [(r.id, r.score) for r in rows]
    assert ix.search([]) == []


def test_most_first_hits_are_replaced(spark, folder):
    """So many of the best hits are of replaced documents that the first look doesn't suffice."""
    ix = Index(spark, folder)
    ix.update([insert(i, [1, 2, 3]) for i in range(1, 200)])
    ix.checkpoint(force=True)
    ix.update([insert(i, [1]) for i in range(1, 190)] + [delete(190)])
    want = [(i, 3) for i in range(191, 200)] + [(1, 1)]
    for _ in range(2):
        assert pairs(ix.search([1, 2, 3], SearchOptions(limit=10))) == want
        assert Index(spark, folder).search([1, 2, 3], SearchOptions(limit=10)) == ix.search([1, 2, 3], SearchOptions(limit=10))
        ix.checkpoint(force=True)
    ix.update([insert(500 + i, range(1000)) for i in range(250)])  # too much to keep in memory
    assert ix._memory is None and pairs(ix.search([1, 2, 3], SearchOptions(limit=1))) == [(191, 3)]


def test_scans_are_observed(spark, folder):
    ix = Index(spark, folder, name="n")
    ix.update([insert(1, [5, 6]), insert(2, [5])])
    ix.insert(3, [5])
    ix.observe_scan([5, 6, 7])
    text = ix.metrics.render()
    assert 'scanned_docs_per_hash_count{index="n"} 3' in text and 'scanned_docs_per_hash_sum{index="n"} 4' in text
    ix.checkpoint(force=True)
    assert ix.metrics.value("memory_merges") == 1


def test_merge_leaves_out_what_newer_segments_replace(spark, folder):
    ix = Index(spark, folder)
    for hashes in ([1, 2], [3], [2, 4]):
        ix.update([insert(7, hashes), insert(len(hashes), [9])])
        ix.checkpoint(force=True)
    ix.merge(0, 2)
    assert ix.infos[0]["num_docs"] == 1 and ix.infos[0]["num_items"] == 1
    assert pairs(ix.search([1, 2, 3, 4, 9])) == [(7, 2), (1, 1), (2, 1)]


def test_versions(spark, folder):
    ix = Index(spark, folder)
    ix.insert(1, [1])
    with pytest.raises(errors.VersionMismatch):
        ix.update([insert(2, [1])], expected_version=0)
    assert ix.update([insert(2, [1])], expected_version=1) == 2
    for bad in (0, -1, 2**32, None):
        with pytest.raises(errors.InvalidFingerprintId):
            ix.update([insert(bad, [1])])
        with pytest.raises(errors.InvalidFingerprintId):
            ix.update([delete(bad)])
    assert ix.version == 2 and ix.doc_info(2)["version"] == 2
    fed = Index(spark, f"{folder}/fed")
    assert fed.update([insert(1, [1])], version=500) == 500
    with pytest.raises(errors.VersionWentBackwards):
        fed.update([insert(1, [1])], version=499)
    assert fed.update([insert(1, [1])], version=500) == 500
    with pytest.raises(errors.VersionRequired):
        fed.insert(1, [1])
    fed.checkpoint(force=True)
    assert Index(spark, f"{folder}/fed").status() == {"generation": 1, "version": 500, "file_version": 500}


def test_torn_log_keeps_the_prefix(spark, folder):
    ix = Index(spark, folder)
    ix.insert(1, [1])
    ix.insert(2, [1])
    ix.insert(3, [1])
    place = f"{ix.oplog.path}/{2:016x}.xlog"
    files.write_text(spark, place, files.read_text(spark, place)[:-9])
    again = Index(spark, folder)
    assert again.version == 1 and pairs(again.search([1])) == [(1, 1)]
    assert again.insert(9, [1]) == 2 and pairs(again.search([1])) == [(1, 1), (9, 1)]


def test_two_writers_cannot_take_one_commit(spark, folder):
    a, b = Index(spark, folder), Index(spark, folder)
    a.insert(1, [1])
    with pytest.raises(errors.VersionMismatch):
        b.insert(2, [1])


def test_frames_checkpoints_and_policy(spark, folder):
    ix = Index(spark, folder, options=IndexOptions(checkpoint_threshold=10, most_logged_commits=2))
    rows = [(i, "insert", i, [i % 7, i % 11], None) for i in range(1, 200)] + [(200, "set_metadata", None, None, {"k": "v"}), (201, "delete", 3, None, None)]
    frame = spark.createDataFrame(rows, "ordinal bigint, op string, id bigint, hashes array<bigint>, entries map<string,string>")
    assert ix.update_frame(frame) == 1
    before = ix.search([3, 5], SearchOptions(limit=100))
    assert ix.needs_checkpoint()
    ix.maintain()
    assert ix.search([3, 5], SearchOptions(limit=100)) == before and ix.info()["metadata"] == {"k": "v"}
    for i in range(3):
        ix.insert(1000 + i, [3])
    assert ix.needs_checkpoint()
    ix.maintain(force=True)
    assert {r["id"] for r in ix.search([3], SearchOptions(limit=100))} >= {1000, 1001, 1002}
    with pytest.raises(errors.InvalidFingerprintId):
        ix.update_frame(spark.createDataFrame([(1, "insert", 0, [1], None)], frame.schema))


def test_deadline(spark, folder):
    ix = Index(spark, folder)
    ix.insert(1, [1])
    slow = threading.Event()

    def run():
        slow.set()
        return spark.range(10**12).selectExpr("sum(id % 7)").collect()

    with pytest.raises(errors.SearchTimeout):
        ix._in_time(run, 1500)
    assert slow.is_set() and pairs(ix.search([1], timeout_ms=10_000)) == [(1, 1)]


def test_snapshots(spark, folder):
    ix = Index(spark, f"{folder}/a", generation=4)
    ix.update([insert(1, [1]), insert(2, [1])])
    ix.checkpoint(force=True)
    ix.insert(3, [1])  # stays in the log, so it is in no snapshot
    ix.export_snapshot(f"{folder}/snap")
    with pytest.raises(errors.VersionMismatch):
        restore_snapshot(spark, f"{folder}/snap", f"{folder}/b", 5)
    restore_snapshot(spark, f"{folder}/snap", f"{folder}/b", 4)
    back = Index(spark, f"{folder}/b", generation=4)
    assert pairs(back.search([1])) == [(1, 1), (2, 1)] and back.version == 1
    with pytest.raises(errors.CorruptSegment):
        restore_snapshot(spark, f"{folder}/nothing", f"{folder}/c", 4)


def test_catalog_lineages(spark, folder):
    cat = Catalog(spark, folder)
    assert cat.create("main", generation=5) == {"version": 0, "ready": True, "generation": 5}
    assert cat.create("main")["generation"] == 5
    with pytest.raises(errors.OlderIndexAlreadyExists):
        cat.create("main", generation=4)
    with pytest.raises(errors.NewerIndexAlreadyExists):
        cat.create("main", generation=6)
    with pytest.raises(errors.IndexAlreadyExists):
        cat.create("main", expect_does_not_exist=True)
    cat.get("main").insert(1, [1])
    assert cat.delete("main") == {"deleted": True} and cat.delete("main") == {"deleted": False}
    with pytest.raises(errors.IndexNotFound):
        cat.delete("main", expect_exists=True)
    with pytest.raises(errors.OlderIndexAlreadyExists):
        cat.create("main", generation=5)
    assert cat.create("main", generation=9)["generation"] == 9
    assert cat.get("main").search([1]) == []
    cat.delete("main")
    assert cat.create("main")["generation"] == 10
    cat.create("other")
    cat.delete("other")
    for bad in ("", "x y", "a" * 256, "../x"):
        with pytest.raises(errors.InvalidIndexName):
            cat.create(bad)
    again = Catalog(spark, folder)
    assert again.names() == ["main"] and again.get("main").generation == 10 and again.health("other") == "missing"
    with pytest.raises(errors.IndexNotFound):
        again.get("main", generation=9)
    again.set_loading("main", True)
    assert again.health("main") == "loading"
    with pytest.raises(errors.IndexNotReady):
        again.serving("main")
    assert 'hashloom_version{index="main"} 0' in again.render_metrics()
