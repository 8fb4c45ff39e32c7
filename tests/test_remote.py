"""Feeds and peers behind HTTP."""

import io
import threading

import pytest

from hashloom import errors
from hashloom.__main__ import parser
from hashloom.catalog import Catalog
from hashloom.functions.msgpack import pack
from hashloom.index import Index, delete, insert, receive_snapshot, restore_snapshot, set_metadata
from hashloom.replica import Replica
from hashloom.server import FeedServer, IndexServer
from hashloom.sources.feed import Feed
from hashloom.sources.remote import HttpPeer, RemoteFeed, nap_seconds


def test_naps():
    assert nap_seconds(0, None, 0) == 0.05 and nap_seconds(1000, None, 0) == 1.0
    assert nap_seconds(1000, 10.2, 10.0) == pytest.approx(0.2) and nap_seconds(1000, 10.0, 10.0) is None


def test_options():
    options = parser().parse_args(["--port", "9", "--peers", "http://a,http://b"])
    assert options.port == 9 and options.checkpoint_threshold == 100_000 and not options.coordinator


def test_snapshot_streams(spark, folder):
    ix = Index(spark, f"{folder}/a", generation=3)
    ix.update([insert(1, [1, 2]), set_metadata({"k": "v"})])
    ix.checkpoint(force=True)
    ix.insert(2, [1])
    ix.checkpoint(force=True)
    size, pieces = ix.snapshot_stream()
    data = b"".join(pieces)
    assert len(data) == size and not +ix._leases
    receive_snapshot(spark, io.BytesIO(data).read, f"{folder}/snap")
    restore_snapshot(spark, f"{folder}/snap", f"{folder}/b", 3)
    back = Index(spark, f"{folder}/b", generation=3)
    assert back.search([1, 2]) == ix.search([1, 2]) and back.info() == ix.info()
    for bad in (data[:-1], data[:9], b"", pack({"f": 9})):
        with pytest.raises(errors.CorruptSegment):
            receive_snapshot(spark, io.BytesIO(bad).read, f"{folder}/bad")
    with pytest.raises(errors.CorruptSegment):
        receive_snapshot(spark, io.BytesIO(pack({"f": 1, "g": 3, "s": [{"i": {"name": "x"}, "s": 1, "f": [["../y", 1]]}]}) + b"z").read, f"{folder}/bad")


def test_remote_feed_and_replica(spark, folder):
    feed = Feed(spark, f"{folder}/feed")
    with FeedServer(feed, ("127.0.0.1", 0)) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        remote = RemoteFeed(spark, "http://{}:{}".format(*server.server_address))
        node = Replica(spark, Catalog(spark, f"{folder}/node"), remote)
        assert node.create_index("main") == {"version": 0, "ready": True, "generation": 1}
        assert node.update("main", [insert(1, [1]), set_metadata({"a": "b"}), delete(9)]) == 3
        with pytest.raises(errors.VersionMismatch):
            node.update("main", [delete(1)], expected_version=1)
        index = node.catalog.get("main")
        assert index.search([1]) == [{"id": 1, "score": 1}] and index.info()["metadata"] == {"a": "b"}
        assert remote.wait_page("main", 1, 3, timeout_s=0.1) == []
        assert [o["pos"] for o in remote.read_meta()] == [1]
        running = node.consumers["main"]
        running.start()
        running.wait(remote.append("main", 1, [insert(2, [1])]), 60)
        running.stop()
        remote.truncate("main", 1, 4)
        with pytest.raises(errors.BelowRetention):
            remote.page("main", 1, 0)
        # An empty node below the floor takes a peer's snapshot, or the corpus stream without one.
        index.checkpoint(force=True)
        with IndexServer(node.catalog, ("127.0.0.1", 0)) as donor:
            threading.Thread(target=donor.serve_forever, daemon=True).start()
            peers = [HttpPeer("http://127.0.0.1:1"), HttpPeer("http://{}:{}".format(*donor.server_address))]
            second = Replica(spark, Catalog(spark, f"{folder}/second"), remote, peers)
            second.catch_up_meta()
            assert second.sync("main") == 4 and second.catalog.get("main").file_version == 4
            assert {r["id"] for r in second.catalog.get("main").search([1])} == {1, 2}
            donor.shutdown()
        third = Replica(spark, Catalog(spark, f"{folder}/third"), remote)
        third.catch_up_meta()
        assert third.sync("main") == 4 and {r["id"] for r in third.catalog.get("main").search([1])} == {1, 2}
        assert node.delete_index("main") == {"deleted": True}
        server.shutdown()
    with pytest.raises(errors.ReplicationTimeout):
        RemoteFeed(spark, "http://127.0.0.1:1").read_meta()
