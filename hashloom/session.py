"""The line protocol: one session per connection, searching and writing the index ``main``."""

from __future__ import annotations

import re
import socketserver

from hashloom import errors
from hashloom.catalog import Catalog
from hashloom.functions.ints import U32_MAX
from hashloom.index import insert
from hashloom.operators.search import SearchOptions

INDEX = "main"
LONGEST_LINE = 256 * 1024
_NUMBER = re.compile(r"[+-]?[0-9]+")


class _Refused(Exception):
    pass


def parse_hashes(text: str) -> list[int]:
    """Comma-separated signed decimals as u32."""
    if not text:
        raise _Refused("empty fingerprint")
    found = []
    for item in text.split(","):
        if not _NUMBER.fullmatch(item) or not -(2**63) <= int(item) < 2**63:
            raise _Refused("invalid fingerprint")
        found.append(int(item) & U32_MAX)
    return found


def _u32(text: str, message: str) -> int:
    if not text.isascii() or not text.isdigit() or int(text) > U32_MAX:
        raise _Refused(message)
    return int(text)


class Session:
    def __init__(self, catalog: Catalog, read_only: bool = False) -> None:
        self.catalog, self.read_only = catalog, read_only
        self.attributes = {"max_results": 500, "top_score_percent": 10, "timeout": 0, "idle_timeout": 60_000}
        self.changes: list[dict] | None = None
        self.pending: dict[str, str] = {}
        self._commands = {
            "echo": lambda a: " ".join(a), "search": self._search, "insert": self._insert, "begin": self._begin, "commit": self._commit,
            "rollback": self._rollback, "optimize": self._in_transaction, "cleanup": self._in_transaction, "get": self._get, "set": self._set,
        }

    def dispatch(self, line: str) -> str:
        """The answer to one line, without its line end."""
        parts = [p for p in line.rstrip("\r\n").split(" ") if p]
        if not parts:
            return "OK "
        command = self._commands.get(parts[0])
        if command is None:
            return "ERR unknown command"
        try:
            return f"OK {command(parts[1:])}"
        except _Refused as e:
            return f"ERR {e}"

    def _in_transaction(self, _: list[str] | None = None) -> str:
        if self.changes is None:
            raise _Refused("not in transaction")
        return ""

    def _search(self, args: list[str]) -> str:
        if len(args) != 1:
            raise _Refused("expected one argument")
        query = parse_hashes(args[0])
        options = SearchOptions(limit=self.attributes["max_results"], min_score=1, score_pct=self.attributes["top_score_percent"], clamped=False)
        try:
            found = self.catalog.serving(INDEX).search(query, options, self.attributes["timeout"])
        except errors.SearchTimeout:
            raise _Refused("timeout exceeded") from None
        except errors.EngineError:
            raise _Refused("search failed") from None
        return " ".join(f"{r['id']}:{r['score']}" for r in found)

    def _insert(self, args: list[str]) -> str:
        self._in_transaction()
        if len(args) != 2:
            raise _Refused("expected two arguments")
        self.changes.append(insert(_u32(args[0], "invalid document id"), parse_hashes(args[1])))
        return ""

    def _begin(self, _: list[str]) -> str:
        if self.read_only:
            raise _Refused("read-only replica")
        if self.changes is not None:
            raise _Refused("already in transaction")
        self.changes, self.pending = [], {}
        return ""

    def _commit(self, _: list[str]) -> str:
        self._in_transaction()
        if self.changes or self.pending:
            try:
                self.catalog.get(INDEX).update(self.changes, self.pending or None)
            except errors.EngineError:
                # The transaction stays open.
                raise _Refused("commit failed") from None
        self.changes, self.pending = None, {}
        return ""

    def _rollback(self, _: list[str]) -> str:
        self._in_transaction()
        self.changes, self.pending = None, {}
        return ""

    def _get(self, args: list[str]) -> str:
        if len(args) == 2 and args[0] == "attribute":
            args = args[1:]
        if len(args) != 1:
            raise _Refused("expected one argument")
        if args[0] in self.attributes:
            return str(self.attributes[args[0]])
        try:
            return self.catalog.get(INDEX).info()["metadata"].get(args[0], "")
        except errors.EngineError:
            return ""

    def _set(self, args: list[str]) -> str:
        if len(args) == 3 and args[0] == "attribute":
            args = args[1:]
        if len(args) != 2:
            raise _Refused("expected two arguments")
        name, value = args
        if name in self.attributes:
            self.attributes[name] = _u32(value, "invalid value")
            return ""
        self._in_transaction()
        self.pending[name] = value
        return ""


class _Handler(socketserver.StreamRequestHandler):
    def handle(self) -> None:
        session = Session(self.server.catalog, self.server.read_only)
        while True:
            self.connection.settimeout(session.attributes["idle_timeout"] / 1000)
            try:
                line = self.rfile.readline(LONGEST_LINE + 1)
            except TimeoutError:
                self.wfile.write(b"ERR timeout\r\n")
                return
            if not line:
                return
            if len(line) > LONGEST_LINE:
                self.wfile.write(b"ERR line too long\r\n")
                return
            self.wfile.write(f"{session.dispatch(line.decode('utf-8', 'replace'))}\r\n".encode())


class LineServer(socketserver.ThreadingTCPServer):
    """Serves sessions; creates the index ``main`` if there is none."""

    allow_reuse_address = True
    daemon_threads = True

    def __init__(self, catalog: Catalog, address: tuple[str, int], read_only: bool = False) -> None:
        catalog.create(INDEX)
        self.catalog, self.read_only = catalog, read_only
        super().__init__(address, _Handler)
