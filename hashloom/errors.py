"""Errors of the engine with the status an HTTP front end answers."""

from __future__ import annotations


class EngineError(Exception):
    status = 500

    @property
    def name(self) -> str:
        return type(self).__name__


def _kind(name: str, status: int) -> type[EngineError]:
    return type(name, (EngineError,), {"status": status, "__module__": __name__})


BadRequest = _kind("BadRequest", 400)
InvalidIndexName = _kind("InvalidIndexName", 400)
GenerationNotAllowed = _kind("GenerationNotAllowed", 400)
InvalidFingerprintId = _kind("InvalidFingerprintId", 400)
FeedIsReadOnly = _kind("FeedIsReadOnly", 403)
IndexNotFound = _kind("IndexNotFound", 404)
FingerprintNotFound = _kind("FingerprintNotFound", 404)
VersionMismatch = _kind("VersionMismatch", 409)
IndexAlreadyExists = _kind("IndexAlreadyExists", 409)
OlderIndexAlreadyExists = _kind("OlderIndexAlreadyExists", 409)
NewerIndexAlreadyExists = _kind("NewerIndexAlreadyExists", 409)
BelowRetention = _kind("BelowRetention", 410)
UnsupportedMediaType = _kind("UnsupportedMediaType", 415)
NotImplemented_ = type("NotImplemented", (EngineError,), {"status": 501, "__module__": __name__})
IndexNotReady = _kind("IndexNotReady", 503)
SearchTimeout = _kind("SearchTimeout", 503)
ReplicationTimeout = _kind("ReplicationTimeout", 503)
VersionRequired = _kind("VersionRequired", 500)
VersionWentBackwards = _kind("VersionWentBackwards", 500)
CorruptSegment = _kind("CorruptSegment", 500)
FeedGap = _kind("FeedGap", 500)
