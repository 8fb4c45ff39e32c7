"""Feeds, the streaming consumer and replicas."""

import os

import pytest

from hashloom import errors
from hashloom.catalog import Catalog
from hashloom.index import delete, insert, set_metadata
from hashloom.replica import Peer, Replica
from hashloom.sources.feed import Feed
from hashloom.streaming.consumer import Consumer, apply_entries


def ids(index, hashes):
    return [r["id"] for r in index.search(hashes)]


def test_feed_positions_pages_and_retention(spark, folder):
    feed = Feed(spark, folder)
    assert feed.append("main", 1, [insert(1, [1]), delete(2)]) == 2
    assert feed.append("main", 5, [insert(1, [1])]) == 1
    assert feed.append("main", 1, [set_metadata({"a": "b"})], expected=2) == 3
    assert feed.append("main", 1, []) == 3
    with pytest.raises(errors.VersionMismatch):
        feed.append("main", 1, [delete(1)], expected=2)
    assert [e["seq"] for e in feed.read("main", 1, 1)] == [2, 3] and len(feed.read("main", 1, 0, 2)) == 2
    assert feed.read("main", 1, 3) == [] and feed.read("none", 1) == []
    feed.truncate("main", 1, 2)
    with pytest.raises(errors.BelowRetention):
        feed.read("main", 1, 1)
    assert [e["seq"] for e in feed.read("main", 1, 2)] == [3]
    position, content = feed.bootstrap("main", 1)
    assert position == 3 and {(r.op, r.id) for r in content.collect()} == {("insert", 1), ("set_metadata", None)}
    with pytest.raises(errors.FeedIsReadOnly):
        Feed(spark, folder, read_only=True).append("main", 1, [delete(1)])


def test_meta_feed(spark, folder):
    feed = Feed(spark, folder)
    assert feed.create_index("a") == 1 and feed.create_index("a") == 1
    assert feed.create_index("b") == 2 and feed.delete_index("a") == 3 and feed.delete_index("a") == 3
    assert feed.create_index("a") == 4 and feed.delete_index("none") == 0
    assert [o["pos"] for o in feed.read_meta(1, 2)] == [2, 3]


def test_consumer_applies_once(spark, folder):
    feed, cat = Feed(spark, f"{folder}/feed"), Catalog(spark, f"{folder}/node")
    cat.create("main", generation=1)
    index = cat.get("main")
    feed.append("main", 1, [insert(1, [1]), insert(2, [1]), insert(0, [1])])
    feed.append("main", 1, [delete(2), set_metadata({"k": "v"})])
    consumer = Consumer(spark, feed, index, f"{folder}/checkpoint")
    assert consumer.catch_up() == 5 and ids(index, [1]) == [1] and index.info()["metadata"] == {"k": "v"}
    # The same entries again, as after a crash between the commit and the stream's own checkpoint.
    assert apply_entries(index, feed.entries("main", 1)) == 5 and index.commit_id == 1
    feed.append("main", 1, [insert(3, [1])])
    assert Consumer(spark, feed, index, f"{folder}/checkpoint").catch_up() == 6 and ids(index, [1]) == [1, 3]
    assert Consumer(spark, feed, index, f"{folder}/other-checkpoint").catch_up() == 6 and index.commit_id == 2
    consumer.wait(6)
    with pytest.raises(errors.ReplicationTimeout):
        consumer.wait(7, 0.2)
    running = Consumer(spark, feed, index, f"{folder}/checkpoint")
    running.start("100 milliseconds")
    running.wait(feed.append("main", 1, [insert(4, [1])]), 60)
    running.stop()
    assert ids(index, [1]) == [1, 3, 4]


def test_replicas_follow_bootstrap_and_restore(spark, folder):
    feed = Feed(spark, f"{folder}/feed")
    first = Replica(spark, Catalog(spark, f"{folder}/one"), feed)
    made = first.create_index("main")
    assert made == {"version": 0, "ready": True, "generation": 1}
    with pytest.raises(errors.GenerationNotAllowed):
        first.create_index("x", generation=3)
    assert first.update("main", [insert(1, [1]), insert(2, [1])]) == 2
    assert first.update("main", [delete(2)], expected_version=2) == 3
    with pytest.raises(errors.VersionMismatch):
        first.update("main", [delete(1)], expected_version=2)
    assert ids(first.catalog.get("main"), [1]) == [1]
    # Below the retention floor an empty node takes the feed's corpus; a node without data can't replay.
    feed.truncate("main", 1, 3)
    second = Replica(spark, Catalog(spark, f"{folder}/two"), feed)
    second.catch_up_meta()
    assert second.sync("main") == 3 and ids(second.catalog.get("main"), [1]) == [1]
    assert second.catalog.get("main").file_version == 3
    # A node that fell behind restores itself from the freshest peer and goes on from there.
    first.update("main", [insert(5, [1])])
    third = Replica(spark, Catalog(spark, f"{folder}/three"), feed, [Peer("http://two", second.catalog)])
    third.catch_up_meta()
    third.catalog.get("main").update([insert(9, [1])], version=1)
    assert third.donors("main", 1, 1) == ["http://two"] and third.donors("main", 1, 3) == [] and third.donors("main", 2, 1) == []
    assert third.sync("main") == 4 and ids(third.catalog.get("main"), [1]) == [1, 5]
    lone = Replica(spark, Catalog(spark, f"{folder}/four"), feed)
    lone.catch_up_meta()
    lone.catalog.get("main").update([insert(9, [1])], version=1)
    with pytest.raises(errors.BelowRetention):
        lone.sync("main")


def test_a_stream_goes_on_after_a_restart_and_a_setback(spark, folder):
    feed = Feed(spark, f"{folder}/feed")
    node = Replica(spark, Catalog(spark, f"{folder}/one"), feed)
    node.create_index("main")
    node.update("main", [insert(1, [1])])
    index = node.catalog.get("main")
    index.checkpoint(force=True)
    index.export_snapshot(f"{folder}/snap")
    node.update("main", [insert(2, [1])])
    seen = node.consumers["main"].checkpoint
    again = Replica(spark, Catalog(spark, f"{folder}/one"), feed)
    assert again.add_consumer("main").checkpoint == seen and again.sync("main") == 2
    # Set back to the snapshot: the stream has seen all files, yet they are applied again.
    again.catalog.restore("main", 1, f"{folder}/snap")
    assert again.sync("main") == 2 and ids(again.catalog.get("main"), [1]) == [1, 2]


def test_meta_convergence_and_parked_operations(spark, folder):
    feed = Feed(spark, f"{folder}/feed")
    cat = Catalog(spark, f"{folder}/node")
    cat.create("stale")
    node = Replica(spark, cat, feed)
    feed.create_index("a")
    feed.create_index("b")
    feed.delete_index("a")
    node.catch_up_meta()
    assert cat.names() == ["b"] and set(node.consumers) == {"b"}
    assert node.add_consumer("b") is node.consumers["b"]
    # An operation that can't be applied is kept for later and doesn't stop the next.
    files_op = {"pos": 4, "kind": "create", "index_name": "not valid"}
    node._try_meta(files_op)
    assert node.parked == {"not valid": files_op}
    feed.delete_index("b")
    feed.create_index("b")
    node.follow_meta()
    assert cat.get("b").generation == 5 and "not valid" in node.parked
    assert node.delete_index("b") == {"deleted": True} and cat.names() == []


def test_big_batches_keep_their_order(spark, folder):
    feed = Feed(spark, folder)
    feed.append("big", 1, [insert(7, [7])])
    frame = spark.range(1000, 0, -1).selectExpr("id AS place", "'insert' AS op", "id + 1 AS id", "array(id) AS hashes", "cast(null as map<string,string>) AS entries")
    assert feed.append_frame("big", 1, frame.repartition(5), "place") == 1001
    assert feed.append("big", 1, [delete(2)]) == 1002
    rows = feed.entries("big", 1).orderBy("seq").collect()
    assert [r.seq for r in rows] == list(range(1, 1003)) and [r.id for r in rows] == [7, *range(2, 1002), 2]


def test_files_apply_in_order_of_positions(spark, folder):
    feed, cat = Feed(spark, f"{folder}/feed"), Catalog(spark, f"{folder}/node")
    cat.create("main", generation=1)
    index = cat.get("main")
    for i in range(1, 7):
        feed.append("main", 1, [insert(i, [1]), delete(i - 1) if i % 2 else insert(i, [1, 2])])
    place = feed.folder("main", 1).removeprefix("file://")
    names = sorted(n for n in os.listdir(place) if n.endswith(".json"))
    for name, written in zip(names, (500, 200, 600, 100, 300, 400), strict=True):
        os.utime(f"{place}/{name}", (1_700_000_000 + written,) * 2)
    assert Consumer(spark, feed, index, f"{folder}/checkpoint", files_per_batch=2).catch_up() == 12
    assert ids(index, [1]) == [1, 3, 5, 6] and index.commit_id == 3


def test_missing_positions_are_an_error(spark, folder):
    feed, cat = Feed(spark, f"{folder}/feed"), Catalog(spark, f"{folder}/node")
    cat.create("main", generation=1)
    index = cat.get("main")
    for i in range(1, 4):
        feed.append("main", 1, [insert(i, [1])])
    with pytest.raises(errors.FeedGap):
        apply_entries(index, feed.entries("main", 1).where("seq <> 2"))
    place = feed.folder("main", 1).removeprefix("file://")
    os.remove(f"{place}/{sorted(n for n in os.listdir(place) if n.endswith('.json'))[1]}")
    with pytest.raises(Exception, match="FeedGap"):
        Consumer(spark, feed, index, f"{folder}/checkpoint").catch_up()
    assert index.version == 1 and ids(index, [1]) == [1]
