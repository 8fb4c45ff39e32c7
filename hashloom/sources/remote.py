"""Clients of the HTTP front ends: a feed kept by another process, and peers that hand out snapshots."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession

from hashloom import errors
from hashloom.functions.msgpack import pack, unpack, unpack_stream
from hashloom.index import receive_snapshot
from hashloom.operators.changelog import DEFAULT_ENTRIES
from hashloom.sources.feed import FLAT

LEAST_NAP_MS = 50
PROBE_TIMEOUT_S = 5.0
_BY_STATUS = {404: errors.IndexNotFound, 409: errors.VersionMismatch, 410: errors.BelowRetention, 403: errors.FeedIsReadOnly}


def nap_seconds(hint_ms: int, until: float | None, now: float) -> float | None:
    """How long to wait before the next poll: the hint, 50 ms at least, within the time left; None when none is left."""
    nap = max(hint_ms, LEAST_NAP_MS) / 1000
    if until is None:
        return nap
    return min(nap, until - now) if until > now else None


def packed_change(change: dict) -> dict:
    kind = change["op"][0]
    return {kind: {"e": change["entries"]} if kind == "s" else {"i": change["id"], "h": change["hashes"]} if kind == "i" else {"i": change["id"]}}


def flat_change(value: dict) -> tuple:
    """(op, id, hashes, entries) of a change as it travels."""
    kind, content = next(iter(value.items()))
    return {"i": "insert", "d": "delete", "s": "set_metadata"}[kind], content.get("i"), content.get("h"), content.get("e")


class RemoteFeed:
    """The feed interface over HTTP; pages are read with at most 1024 entries each."""

    def __init__(self, spark: SparkSession, base_url: str, timeout_s: float = 30) -> None:
        self.spark, self.base_url, self.timeout_s = spark, base_url.rstrip("/"), timeout_s

    def _call(self, method: str, path: str, body=None) -> bytes:
        request = urllib.request.Request(self.base_url + path, None if body is None else pack(body), {"Content-Type": "application/msgpack"}, method=method)
        try:
            with urllib.request.urlopen(request, timeout=self.timeout_s) as answer:
                return answer.read()
        except urllib.error.HTTPError as e:
            raise _BY_STATUS.get(e.code, errors.EngineError)(f"{method} {path}: {e.code}") from None
        except OSError as e:
            raise errors.ReplicationTimeout(f"{method} {path}: {e}") from None

    def create_index(self, name: str) -> int:
        return unpack(self._call("PUT", f"/_index/{quote(name)}"))["g"]

    def delete_index(self, name: str) -> int:
        return unpack(self._call("DELETE", f"/_index/{quote(name)}"))["p"]

    def read_meta(self, after: int = 0, most: int = DEFAULT_ENTRIES) -> list[dict]:
        found: list[dict] = []
        while len(found) < most:
            page = unpack(self._call("GET", f"/_meta?after={after}&max={min(most - len(found), 1024)}"))["o"]
            if not page:
                break
            found += [{"pos": o["p"], "kind": o["k"], "index_name": o["i"]} for o in page]
            after = found[-1]["pos"]
        return found

    def meta_frame(self) -> DataFrame:
        return self.spark.createDataFrame([(o["pos"], o["kind"], o["index_name"]) for o in self.read_meta(0, 10**9)], "pos bigint, kind string, index_name string")

    def append(self, name: str, generation: int, changes: list[dict], expected: int | None = None) -> int:
        body = {"c": [packed_change(c) for c in changes]} | ({} if expected is None else {"e": expected})
        return unpack(self._call("POST", f"/_changelog/{quote(name)}/{generation}", body))["i"]

    def truncate(self, name: str, generation: int, floor: int) -> None:
        self._call("POST", f"/_truncate/{quote(name)}/{generation}?floor={floor}")

    def page(self, name: str, generation: int, after: int, most: int = DEFAULT_ENTRIES) -> tuple[list[tuple], int]:
        """(entries ``(seq, op, id, hashes, entries)``, milliseconds to wait before asking again)."""
        answer = unpack(self._call("GET", f"/_changelog/{quote(name)}/{generation}?after={after}&max={min(most, 1024)}"))
        return [(e["i"], *flat_change(e["c"])) for e in answer["e"]], answer["r"]

    def wait_page(self, name: str, generation: int, after: int, most: int = DEFAULT_ENTRIES, timeout_s: float | None = None) -> list[tuple]:
        """The next page that isn't empty, or none within the time."""
        until = None if timeout_s is None else time.monotonic() + timeout_s
        while True:
            found, hint = self.page(name, generation, after, most)
            if found:
                return found
            nap = nap_seconds(hint, until, time.monotonic())
            if nap is None:
                return []
            time.sleep(nap)

    def bootstrap(self, name: str, generation: int) -> tuple[int, DataFrame]:
        """(position, content ``(ordinal, op, id, hashes, entries)``); a stream without its end is an error."""
        parts = list(unpack_stream(self._call("GET", f"/_bootstrap/{quote(name)}/{generation}")))
        if len(parts) < 2 or parts[-1] != []:
            raise errors.CorruptSegment("the corpus stream ended early")
        rows = [(i, *flat_change(c)) for i, c in enumerate((c for batch in parts[1:-1] for c in batch), 1)]
        return parts[0]["p"], self.spark.createDataFrame(rows, FLAT.replace("seq", "ordinal", 1))


class HttpPeer:
    """A donor behind the index API; its snapshots travel as streams of bytes."""

    def __init__(self, base_url: str, timeout_s: float = PROBE_TIMEOUT_S, transfer_timeout_s: float | None = None) -> None:
        self.base_url, self.timeout_s, self.transfer_timeout_s = base_url.rstrip("/"), timeout_s, transfer_timeout_s

    def _json(self, path: str, timeout_s: float | None) -> dict:
        request = urllib.request.Request(self.base_url + path, headers={"Accept": "application/json"})
        with urllib.request.urlopen(request, timeout=timeout_s) as answer:
            return json.load(answer)

    def probe(self, name: str) -> tuple:
        try:
            status = self._json(f"/{quote(name)}/_status", self.timeout_s)
        except OSError:
            return (self.base_url, 0, 0, False)
        return (self.base_url, status["generation"], status["file_version"], True)

    def snapshot(self, name: str, spark: SparkSession, target: str) -> dict:
        """Write the donor's snapshot to ``target`` as it arrives; returns its header. The deadline holds for the whole transfer."""
        end = None if self.transfer_timeout_s is None else time.monotonic() + self.transfer_timeout_s
        with urllib.request.urlopen(f"{self.base_url}/{quote(name)}/_snapshot", timeout=self.transfer_timeout_s) as answer:

            def read(most: int) -> bytes:
                if end is not None and time.monotonic() > end:
                    raise errors.ReplicationTimeout(f"the snapshot of {name} takes too long")
                return answer.read(most)

            return receive_snapshot(spark, read, target)
