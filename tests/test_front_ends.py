"""Line protocol and HTTP."""

import http.client
import json
import socket
import threading

import pytest

from hashloom.catalog import Catalog
from hashloom.functions.msgpack import pack, unpack, unpack_first, unpack_stream
from hashloom.index import insert
from hashloom.server import FeedServer, IndexServer
from hashloom.session import LONGEST_LINE, LineServer, Session
from hashloom.sources.feed import Feed


@pytest.fixture(scope="module")
def catalog(spark, tmp_path_factory):
    cat = Catalog(spark, f"file://{tmp_path_factory.mktemp('front')}")
    cat.create("main")
    return cat


def test_session(catalog):
    s = Session(catalog)
    d = s.dispatch
    assert d("echo hello world") == "OK hello world" and d("") == "OK " and d("frobnicate x") == "ERR unknown command"
    assert d("search notanumber") == "ERR invalid fingerprint" and d("search") == "ERR expected one argument"
    for line in ("insert 1 1,2,3", "commit", "rollback", "optimize", "cleanup", "set attribute a 1"):
        assert d(line) == "ERR not in transaction"
    assert d("begin") == "OK " and d("begin") == "ERR already in transaction"
    assert d("optimize") == "OK " and d("insert x 1") == "ERR invalid document id" and d("insert 1") == "ERR expected two arguments"
    assert d("insert 1001 11000,12000,13000") == "OK " and d("insert 1002 11000,12000,-5") == "OK "
    assert d("set attribute leg_attr 123") == "OK " and d("commit") == "OK "
    assert d("get leg_attr") == "OK 123" and d("get attribute unset") == "OK "
    assert d("search 11000,12000,13000") == "OK 1001:3 1002:2" and d("search 4294967291") == "OK 1002:1"
    assert d("set max_results 1") == "OK " and d("get max_results") == "OK 1" and d("set timeout x") == "ERR invalid value"
    assert d("search 11000,12000") == "OK 1001:2"
    assert d("begin") == "OK " and d("insert 6001 61000") == "OK " and d("rollback") == "OK " and d("search 61000") == "OK "
    assert d("begin") == "OK " and d("insert 0 5") == "OK " and d("commit") == "ERR commit failed" and d("rollback") == "OK "
    assert Session(catalog, read_only=True).dispatch("begin") == "ERR read-only replica"


def test_line_server(catalog):
    with LineServer(catalog, ("127.0.0.1", 0)) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        with socket.create_connection(server.server_address) as sock, sock.makefile("rwb") as f:
            f.write(b"echo a\r\nset idle_timeout 200\r\n")
            f.flush()
            assert [f.readline(), f.readline(), f.readline()] == [b"OK a\r\n", b"OK \r\n", b"ERR timeout\r\n"]
        with socket.create_connection(server.server_address) as sock, sock.makefile("rwb") as f:
            f.write(b"x" * (LONGEST_LINE + 10) + b"\n")
            f.flush()
            assert f.readline() == b"ERR line too long\r\n"
        server.shutdown()


def ask(server, method, path, body=None, **headers):
    con = http.client.HTTPConnection(*server.server_address, timeout=120)
    con.request(method, path, body, {k.replace("_", "-"): v for k, v in headers.items()})
    answer = con.getresponse()
    data = answer.read()
    con.close()
    return answer.status, data


JSON = {"Content_Type": "application/json"}
PACK = {"Content_Type": "application/msgpack"}


def test_index_api(catalog):
    with IndexServer(catalog, ("127.0.0.1", 0)) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()

        def as_json(method, path, body=None, **more):
            status, data = ask(server, method, path, None if body is None else json.dumps(body), **(JSON | more))
            return status, json.loads(data or b"null")

        assert ask(server, "GET", "/_health") == (200, b"OK\n")
        assert as_json("PUT", "/web") == (200, {"version": 0, "ready": True, "generation": 1})
        assert as_json("PUT", "/web", {"expect_does_not_exist": True}) == (409, {"error": "IndexAlreadyExists"})
        assert as_json("PUT", "/no%20name") == (400, {"error": "InvalidIndexName"})
        assert ask(server, "HEAD", "/web")[0] == 200 and ask(server, "HEAD", "/none")[0] == 404
        assert ask(server, "GET", "/web/_health") == (200, b"OK\n") and ask(server, "GET", "/none/_health")[0] == 404
        changes = [{"insert": {"id": 1, "hashes": [101, 201]}}, {"insert": {"id": 2, "hashes": [101]}}]
        assert as_json("POST", "/web/_update", {"changes": changes, "metadata": {"a": "b"}}) == (200, {"version": 1})
        assert as_json("POST", "/web/_update", {"changes": changes, "expected_version": 0}) == (409, {"error": "VersionMismatch"})
        assert as_json("POST", "/web/_update", {"changes": [{"delete": {"id": 0}}]}) == (400, {"error": "InvalidFingerprintId"})
        assert as_json("POST", "/web/_search", {"query": [101, 201], "limit": 0}) == (200, {"results": [{"id": 1, "score": 2}]})
        assert as_json("POST", "/web/_search", {"query": "x"}) == (400, {"error": "BadRequest"})
        assert as_json("POST", "/web/_search") == (400, {"error": "BadRequest"})
        assert as_json("POST", "/none/_search", {"query": [1]}) == (404, {"error": "IndexNotFound"})
        assert ask(server, "POST", "/web/_search", "x", Content_Type="text/xml")[0] == 415
        status, data = ask(server, "POST", "/web/_search", pack({"q": [101, 201]}), **PACK)
        assert status == 200 and unpack(data) == {"r": [{"i": 1, "s": 2}, {"i": 2, "s": 1}]}
        status, data = ask(server, "POST", "/web/_search", pack({"q": [201]}))  # a body without a type is MessagePack
        assert unpack(data) == {"r": [{"i": 1, "s": 1}]}
        status, data = ask(server, "POST", "/web/_search", pack({"q": [201]}), Accept="application/json", **PACK)
        assert json.loads(data) == {"results": [{"id": 1, "score": 1}]}
        assert as_json("PUT", "/web/3", {"hashes": [7]}) == (200, {}) and as_json("GET", "/web/3") == (200, {"version": 2})
        assert ask(server, "HEAD", "/web/3")[0] == 200 and as_json("DELETE", "/web/3") == (200, {})
        assert as_json("GET", "/web/3") == (404, {"error": "FingerprintNotFound"}) and as_json("GET", "/web/x")[0] == 400
        status, data = ask(server, "GET", "/web", Accept="application/msgpack")
        assert unpack(data) == {"v": 3, "m": {"a": "b"}, "s": {"min_doc_id": 1, "max_doc_id": 3, "num_segments": 3, "num_docs": 4}}
        assert as_json("GET", "/web/_status") == (200, {"generation": 1, "version": 3, "file_version": 0})
        assert b'hashloom_searches_total{index="web"}' in ask(server, "GET", "/_metrics")[1]
        assert ask(server, "GET", "/none/_snapshot")[0] == 404
        for segments in (0, 1):  # nothing is in a segment at first
            status, data = ask(server, "GET", "/web/_snapshot")
            header, end = unpack_first(data)
            assert status == 200 and (header["f"], header["g"], len(header["s"])) == (1, 1, segments)
            assert end + sum(x["s"] for x in header["s"]) == len(data)
            catalog.get("web").checkpoint(force=True)
        assert as_json("DELETE", "/web") == (200, {"deleted": True})
        assert as_json("DELETE", "/web", {"expect_exists": True}) == (404, {"error": "IndexNotFound"})
        assert ask(server, "PATCH", "/web")[0] == 501 and ask(server, "GET", "/a/b/c")[0] == 404
        server.shutdown()


def test_feed_api(spark, folder):
    feed = Feed(spark, folder)
    with FeedServer(feed, ("127.0.0.1", 0)) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        call = lambda *a, **k: (lambda s, d: (s, unpack(d) if s == 200 else d))(*ask(server, *a, **k))
        assert call("PUT", "/_index/main") == (200, {"g": 1})
        assert call("POST", "/_changelog/main/1", pack({"c": [{"i": {"i": 1, "h": [5]}}, {"d": {"i": 2}}]})) == (200, {"i": 2})
        assert call("POST", "/_changelog/main/1", pack({"c": [], "e": 9}))[0] == 409
        assert call("GET", "/_changelog/main/1?after=1") == (200, {"e": [{"i": 2, "c": {"d": {"i": 2}}}], "r": 1000})
        assert call("GET", "/_changelog/main/1?max=1")[1]["r"] == 0
        assert call("GET", "/_meta?after=0") == (200, {"o": [{"p": 1, "k": "create", "i": "main"}], "r": 1000})
        assert call("POST", "/_truncate/main/1?floor=1") == (200, {}) and call("GET", "/_changelog/main/1")[0] == 410
        assert call("POST", "/_truncate/main/1")[0] == 400
        status, data = ask(server, "GET", "/_bootstrap/main/1")
        assert list(unpack_stream(data)) == [{"p": 2}, [{"i": {"i": 1, "h": [5]}}], []]
        assert call("DELETE", "/_index/main") == (200, {"p": 2})
        server.shutdown()


def test_replica_writes_go_through_the_feed(spark, folder):
    from hashloom.replica import Replica

    cat = Catalog(spark, f"{folder}/node")
    node = Replica(spark, cat, Feed(spark, f"{folder}/feed"))
    with IndexServer(cat, ("127.0.0.1", 0), node) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        assert json.loads(ask(server, "PUT", "/main", **JSON)[1])["generation"] == 1
        body = json.dumps({"changes": [{"insert": {"id": 4, "hashes": [1]}}], "metadata": {"x": "y"}})
        assert json.loads(ask(server, "POST", "/main/_update", body, **JSON)[1]) == {"version": 2}
        assert cat.get("main").info()["metadata"] == {"x": "y"} and cat.get("main").get(4) == {"version": 2}
        server.shutdown()


def test_big_insert_is_kept_whole(catalog):
    catalog.create("big")
    index = catalog.get("big")
    index.update([insert(1, range(5000))])
    assert index.search(range(0, 5000, 2)) == [{"id": 1, "score": 2500}]
