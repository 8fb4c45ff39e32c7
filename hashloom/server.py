"""HTTP front ends over the standard library: the index API (JSON or MessagePack) and the feed API (MessagePack)."""

from __future__ import annotations

import contextlib
import json
import re
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from hashloom import errors
from hashloom.catalog import Catalog
from hashloom.functions.ints import U32_MAX
from hashloom.functions.msgpack import pack, unpack
from hashloom.index import delete, insert
from hashloom.operators.search import DEFAULT_LIMIT, DEFAULT_PCT, MOST_TIMEOUT_MS, SearchOptions
from hashloom.sources.feed import BATCH, Feed

MOST_BODY = 16 * 1024 * 1024
JSON, MSGPACK = "application/json", "application/msgpack"
#: Maps whose keys are whole names in MessagePack, as their first letters would clash, and user maps.
_WHOLE = {"stats", "metadata"}


def shorten(value, parent: str = ""):
    """Keys by their first letter, as the binary form has them."""
    if isinstance(value, dict):
        return {k if parent in _WHOLE else k[0]: shorten(v, k) for k, v in value.items()}
    if isinstance(value, list):
        return [shorten(v, parent) for v in value]
    return value


def lengthen(value: dict, names: tuple[str, ...]) -> dict:
    by_letter = {n[0]: n for n in names}
    return {by_letter.get(k, k): v for k, v in value.items()}


def _need(ok: bool) -> None:
    if not ok:
        raise errors.BadRequest("malformed body")


def _is_u32(value) -> bool:
    return isinstance(value, int) and not isinstance(value, bool) and 0 <= value <= U32_MAX


def search_request(body: dict, default_timeout_ms: int) -> tuple[list[int], SearchOptions, int]:
    body = lengthen(body, ("query", "timeout", "limit", "min_score", "score_pct"))
    query = body.get("query")
    _need(isinstance(query, list) and all(map(_is_u32, query)))
    numbers = {k: body.get(k) for k in ("timeout", "limit", "min_score", "score_pct")}
    _need(all(v is None or _is_u32(v) for v in numbers.values()))
    options = SearchOptions(
        limit=DEFAULT_LIMIT if numbers["limit"] is None else numbers["limit"], min_score=numbers["min_score"],
        score_pct=DEFAULT_PCT if numbers["score_pct"] is None else numbers["score_pct"],
    )
    return query, options, default_timeout_ms if numbers["timeout"] is None else numbers["timeout"]


def parsed_change(value: dict) -> dict:
    _need(isinstance(value, dict) and len(value) == 1)
    kind, content = next(iter(value.items()))
    kind = {"i": "insert", "d": "delete", "s": "set_metadata"}.get(kind, kind)
    _need(isinstance(content, dict) and kind in ("insert", "delete", "set_metadata"))
    content = lengthen(content, ("id", "hashes", "entries"))
    if kind == "set_metadata":
        return {"op": kind, "id": None, "hashes": None, "entries": content.get("entries") or {}}
    _need(_is_u32(content.get("id")))
    if kind == "delete":
        return delete(content["id"])
    _need(isinstance(content.get("hashes"), list) and all(map(_is_u32, content["hashes"])))
    return insert(content["id"], content["hashes"])


def packed_change(op: str, doc_id, hashes, entries) -> dict:
    kind = op[0]
    return {kind: {"e": dict(entries or {})} if kind == "s" else {"i": doc_id, "h": list(hashes or ())} if kind == "i" else {"i": doc_id}}


class _Handler(BaseHTTPRequestHandler):
    protocol_version = "HTTP/1.1"
    routes: list[tuple[str, str, str]] = []

    def log_message(self, *_) -> None:
        pass

    def _raw(self) -> bytes | None:
        size = int(self.headers.get("Content-Length") or 0)
        if size > MOST_BODY:
            raise errors.BadRequest("body too large")
        return self.rfile.read(size) if size else None

    def _kind(self) -> str:
        """Form of the request: its Content-Type, else MessagePack with a body and JSON without."""
        named = (self.headers.get("Content-Type") or "").split(";")[0].strip().lower()
        if not named:
            return MSGPACK if int(self.headers.get("Content-Length") or 0) else JSON
        if named in (MSGPACK, "application/x-msgpack", "application/vnd.msgpack"):
            return MSGPACK
        if named != JSON:
            raise errors.UnsupportedMediaType(named)
        return JSON

    def _body(self, required: bool = True) -> dict:
        raw = self._raw()
        if raw is None:
            _need(not required)
            return {}
        kind = self._kind()
        try:
            value = unpack(raw) if kind == MSGPACK else json.loads(raw)
        except (ValueError, UnicodeDecodeError):
            raise errors.BadRequest("malformed body") from None
        _need(isinstance(value, dict))
        return value

    def _answer(self, value, status: int = 200) -> None:
        accept = (self.headers.get("Accept") or "").split(";")[0].strip().lower()
        try:
            kind = MSGPACK if "msgpack" in accept else JSON if accept == JSON else self._kind()
        except errors.UnsupportedMediaType:
            kind = JSON
        self._send(pack(shorten(value)) if kind == MSGPACK else json.dumps(value).encode(), kind, status)

    def _send(self, data: bytes, kind: str, status: int = 200) -> None:
        self.send_response(status)
        self.send_header("Content-Type", kind)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        if self.command != "HEAD":
            self.wfile.write(data)

    def _route(self) -> None:
        url = urlsplit(self.path)
        self.query = {k: v[-1] for k, v in parse_qs(url.query).items()}
        for method, pattern, name in self.routes:
            found = re.fullmatch(pattern, url.path)
            if found and method == self.command:
                try:
                    getattr(self, name)(*[unquote(g) for g in found.groups()])
                except errors.EngineError as e:
                    self._failed(e)
                except Exception:  # noqa: BLE001
                    self._failed(errors.EngineError("internal"))
                return
        self._send(b"", "text/plain", 404)

    def _failed(self, e: errors.EngineError) -> None:
        self._answer({"error": e.name}, e.status)

    do_GET = do_PUT = do_POST = do_DELETE = do_HEAD = _route


class IndexHandler(_Handler):
    routes = [
        ("GET", "/_metrics", "metrics"), ("GET", "/_health", "alive"), ("HEAD", "/_health", "alive"),
        ("GET", "/([^/]+)/_health", "health"), ("HEAD", "/([^/]+)/_health", "health"),
        ("POST", "/([^/]+)/_search", "search"), ("POST", "/([^/]+)/_update", "update"),
        ("GET", "/([^/]+)/_snapshot", "snapshot"), ("GET", "/([^/]+)/_status", "status"),
        ("HEAD", "/([^/]+)/([^/_][^/]*)", "has_doc"), ("GET", "/([^/]+)/([^/_][^/]*)", "get_doc"), ("PUT", "/([^/]+)/([^/_][^/]*)", "put_doc"), ("DELETE", "/([^/]+)/([^/_][^/]*)", "delete_doc"),
        ("HEAD", "/([^/]+)", "has_index"), ("GET", "/([^/]+)", "get_index"), ("PUT", "/([^/]+)", "put_index"), ("DELETE", "/([^/]+)", "delete_index"),
    ]

    @property
    def catalog(self) -> Catalog:
        return self.server.catalog

    def _id(self, text: str) -> int:
        if not text.isascii() or not text.isdigit() or int(text) > U32_MAX:
            raise errors.BadRequest(text)
        return int(text)

    def metrics(self) -> None:
        self._send(self.catalog.render_metrics().encode(), "text/plain; version=0.0.4; charset=utf-8")

    def alive(self) -> None:
        self._send(b"OK\n", "text/plain")

    def health(self, name: str) -> None:
        state = self.catalog.health(name)
        self._send({"ready": b"OK\n", "loading": b"LOADING\n", "missing": b""}[state], "text/plain", {"ready": 200, "loading": 503, "missing": 404}[state])

    def search(self, name: str) -> None:
        query, options, timeout = search_request(self._body(), self.server.default_timeout_ms)
        self._answer({"results": self.catalog.serving(name).search(query, options, timeout)})

    def update(self, name: str) -> None:
        body = lengthen(self._body(), ("changes", "metadata", "expected_version"))
        _need(isinstance(body.get("changes"), list))
        changes = [parsed_change(c) for c in body["changes"]]
        writer = self.server.replica or self.catalog.get(name)
        if self.server.replica:
            if body.get("metadata"):
                changes.append({"op": "set_metadata", "id": None, "hashes": None, "entries": body["metadata"]})
            version = writer.update(name, changes, body.get("expected_version"))
        else:
            version = writer.update(changes, body.get("metadata"), body.get("expected_version"))
        self._answer({"version": version})

    def _write_one(self, name: str, change: dict) -> None:
        if self.server.replica:
            self.server.replica.update(name, [change])
        else:
            self.catalog.get(name).update([change])
        self._answer({})

    def has_doc(self, name: str, doc: str) -> None:
        self._send(b"", "text/plain", 200 if self.catalog.get(name).exists(self._id(doc)) else 404)

    def get_doc(self, name: str, doc: str) -> None:
        self._answer(self.catalog.get(name).get(self._id(doc)))

    def put_doc(self, name: str, doc: str) -> None:
        body = lengthen(self._body(), ("hashes",))
        self._write_one(name, parsed_change({"insert": {"id": self._id(doc), "hashes": body.get("hashes")}}))

    def delete_doc(self, name: str, doc: str) -> None:
        self._write_one(name, delete(self._id(doc)))

    def has_index(self, name: str) -> None:
        self._send(b"", "text/plain", 200 if self.catalog.exists(name) else 404)

    def get_index(self, name: str) -> None:
        self._answer(self.catalog.get(name).info())

    def put_index(self, name: str) -> None:
        body = lengthen(self._body(False), ("expect_does_not_exist", "generation"))
        made = self.server.replica.create_index(name, body.get("generation")) if self.server.replica else self.catalog.create(name, bool(body.get("expect_does_not_exist")), body.get("generation"))
        self._answer(made, 200 if made["ready"] else 202)

    def delete_index(self, name: str) -> None:
        body = lengthen(self._body(False), ("expect_exists",))
        self._answer(self.server.replica.delete_index(name) if self.server.replica else self.catalog.delete(name, bool(body.get("expect_exists"))))

    def status(self, name: str) -> None:
        self._answer(self.catalog.get(name).status())

    def snapshot(self, name: str) -> None:
        """The snapshot as one stream: MessagePack header, then the segments' bytes."""
        size, pieces = self.catalog.get(name).snapshot_stream()
        self.send_response(200)
        self.send_header("Content-Type", "application/octet-stream")
        self.send_header("Content-Length", str(size))
        self.end_headers()
        with contextlib.closing(pieces):
            for piece in pieces:
                self.wfile.write(piece)


class FeedHandler(_Handler):
    routes = [
        ("POST", "/_changelog/([^/]+)/([0-9]+)", "append"), ("GET", "/_changelog/([^/]+)/([0-9]+)", "read"), ("PUT", "/_index/([^/]+)", "create"), ("DELETE", "/_index/([^/]+)", "drop"),
        ("GET", "/_meta", "meta"), ("GET", "/_bootstrap/([^/]+)/([0-9]+)", "bootstrap"), ("POST", "/_truncate/([^/]+)/([0-9]+)", "truncate"),
    ]

    @property
    def feed(self) -> Feed:
        return self.server.feed

    def _failed(self, e: errors.EngineError) -> None:
        self._send(e.name.encode(), "text/plain", e.status)

    def _number(self, name: str, default: int | None = None) -> int:
        value = self.query.get(name)
        if value is None and default is not None:
            return default
        _need(value is not None and value.isdigit())
        return int(value)

    def _packed(self, value) -> None:
        self._send(pack(value), MSGPACK)

    def append(self, name: str, generation: str) -> None:
        raw = self._raw()
        _need(raw is not None)
        try:
            body = lengthen(unpack(raw), ("changes", "expected"))
        except (ValueError, AttributeError):
            raise errors.BadRequest("malformed body") from None
        self._packed({"i": self.feed.append(name, int(generation), [parsed_change(c) for c in body["changes"]], body.get("expected"))})

    def read(self, name: str, generation: str) -> None:
        most = min(self._number("max", BATCH), 1024)
        found = self.feed.read(name, int(generation), self._number("after", 0), most)
        rows = [{"i": e["seq"], "c": packed_change(e["op"], e["id"], e["hashes"], e["entries"])} for e in found]
        self._packed({"e": rows, "r": self.feed.retry_after_ms(len(rows), most)})

    def create(self, name: str) -> None:
        self._packed({"g": self.feed.create_index(name)})

    def drop(self, name: str) -> None:
        self._packed({"p": self.feed.delete_index(name)})

    def meta(self) -> None:
        most = min(self._number("max", BATCH), 1024)
        found = self.feed.read_meta(self._number("after", 0), most)
        self._packed({"o": [{"p": o["pos"], "k": o["kind"], "i": o["index_name"]} for o in found], "r": self.feed.retry_after_ms(len(found), most)})

    def bootstrap(self, name: str, generation: str) -> None:
        """Header with the position, then arrays of changes, then an empty array; chunked, as rows arrive."""
        position, content = self.feed.bootstrap(name, int(generation))
        self.send_response(200)
        self.send_header("Content-Type", MSGPACK)
        self.send_header("Transfer-Encoding", "chunked")
        self.end_headers()

        def chunk(value) -> None:
            data = pack(value)
            self.wfile.write(f"{len(data):x}\r\n".encode() + data + b"\r\n")

        chunk({"p": position})
        batch: list[dict] = []
        for row in content.toLocalIterator():
            batch.append(packed_change(row.op, row.id, row.hashes, row.entries))
            if len(batch) == BATCH:
                chunk(batch)
                batch = []
        if batch:
            chunk(batch)
        chunk([])
        self.wfile.write(b"0\r\n\r\n")

    def truncate(self, name: str, generation: str) -> None:
        self.feed.truncate(name, int(generation), self._number("floor"))
        self._packed({})


class IndexServer(ThreadingHTTPServer):
    daemon_threads = True

    def __init__(self, catalog: Catalog, address: tuple[str, int], replica=None, default_timeout_ms: int = MOST_TIMEOUT_MS) -> None:
        """``default_timeout_ms`` holds for searches that name none; a search is a Spark job, so it is the greatest allowed."""
        self.catalog, self.replica, self.default_timeout_ms = catalog, replica, default_timeout_ms
        super().__init__(address, IndexHandler)


class FeedServer(ThreadingHTTPServer):
    daemon_threads = True

    def __init__(self, feed: Feed, address: tuple[str, int]) -> None:
        self.feed = feed
        super().__init__(address, FeedHandler)
