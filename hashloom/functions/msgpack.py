"""MessagePack (public specification) for nil, booleans, integers, floats, strings, bytes, arrays and maps."""

from __future__ import annotations

import struct


def pack(value) -> bytes:
    out = bytearray()
    _pack(value, out)
    return bytes(out)


def _sized(out: bytearray, size: int, fix: tuple[int, int] | None, kinds: tuple[tuple[int, str, int], ...]) -> None:
    if fix and size < fix[1]:
        out.append(fix[0] | size)
        return
    for limit, form, code in kinds:
        if size < limit:
            out.append(code)
            out += struct.pack(form, size)
            return
    raise ValueError("too long for MessagePack")


def _pack(value, out: bytearray) -> None:
    if value is None:
        out.append(0xC0)
    elif isinstance(value, bool):
        out.append(0xC3 if value else 0xC2)
    elif isinstance(value, int):
        if 0 <= value < 128:
            out.append(value)
        elif value >= 0:
            for limit, form, code in ((2**8, ">B", 0xCC), (2**16, ">H", 0xCD), (2**32, ">I", 0xCE), (2**64, ">Q", 0xCF)):
                if value < limit:
                    out.append(code)
                    out += struct.pack(form, value)
                    return
            raise ValueError("integer too large")
        elif value >= -32:
            out.append(value & 0xFF)
        else:
            for low, form, code in ((-(2**7), ">b", 0xD0), (-(2**15), ">h", 0xD1), (-(2**31), ">i", 0xD2), (-(2**63), ">q", 0xD3)):
                if value >= low:
                    out.append(code)
                    out += struct.pack(form, value)
                    return
            raise ValueError("integer too small")
    elif isinstance(value, float):
        out.append(0xCB)
        out += struct.pack(">d", value)
    elif isinstance(value, str):
        data = value.encode()
        _sized(out, len(data), (0xA0, 32), ((2**8, ">B", 0xD9), (2**16, ">H", 0xDA), (2**32, ">I", 0xDB)))
        out += data
    elif isinstance(value, (bytes, bytearray)):
        _sized(out, len(value), None, ((2**8, ">B", 0xC4), (2**16, ">H", 0xC5), (2**32, ">I", 0xC6)))
        out += value
    elif isinstance(value, (list, tuple)):
        _sized(out, len(value), (0x90, 16), ((2**16, ">H", 0xDC), (2**32, ">I", 0xDD)))
        for item in value:
            _pack(item, out)
    elif isinstance(value, dict):
        _sized(out, len(value), (0x80, 16), ((2**16, ">H", 0xDE), (2**32, ">I", 0xDF)))
        for key, item in value.items():
            _pack(key, out)
            _pack(item, out)
    else:
        raise TypeError(f"{type(value)} has no MessagePack form")


_NUMBERS = {0xCA: ">f", 0xCB: ">d", 0xCC: ">B", 0xCD: ">H", 0xCE: ">I", 0xCF: ">Q", 0xD0: ">b", 0xD1: ">h", 0xD2: ">i", 0xD3: ">q"}
_SIZES = {0xC4: ">B", 0xC5: ">H", 0xC6: ">I", 0xD9: ">B", 0xDA: ">H", 0xDB: ">I", 0xDC: ">H", 0xDD: ">I", 0xDE: ">H", 0xDF: ">I"}


def unpack(data: bytes):
    value, end = _unpack(data, 0)
    if end != len(data):
        raise ValueError("bytes after the value")
    return value


def unpack_first(data: bytes) -> tuple:
    """(the value that ``data`` begins with, where it ends)."""
    return _unpack(data, 0)


def unpack_stream(data: bytes):
    at = 0
    while at < len(data):
        value, at = _unpack(data, at)
        yield value


def _take(data: bytes, at: int, size: int) -> tuple[bytes, int]:
    if at + size > len(data):
        raise ValueError("truncated MessagePack")
    return data[at : at + size], at + size


def _unpack(data: bytes, at: int):
    if at >= len(data):
        raise ValueError("truncated MessagePack")
    code, at = data[at], at + 1
    if code < 0x80:
        return code, at
    if code >= 0xE0:
        return code - 256, at
    if code in (0xC0, 0xC2, 0xC3):
        return {0xC0: None, 0xC2: False, 0xC3: True}[code], at
    if code in _NUMBERS:
        raw, at = _take(data, at, struct.calcsize(_NUMBERS[code]))
        return struct.unpack(_NUMBERS[code], raw)[0], at
    if code in _SIZES:
        raw, at = _take(data, at, struct.calcsize(_SIZES[code]))
        size = struct.unpack(_SIZES[code], raw)[0]
    elif code < 0x90 or code < 0xA0:
        size = code & 0x0F
    elif code < 0xC0:
        size = code & 0x1F
    else:
        raise ValueError(f"MessagePack code {code:#x} isn't supported")
    if 0xA0 <= code < 0xC0 or code in (0xD9, 0xDA, 0xDB):
        raw, at = _take(data, at, size)
        return raw.decode(), at
    if code in (0xC4, 0xC5, 0xC6):
        return _take(data, at, size)
    if 0x90 <= code < 0xA0 or code in (0xDC, 0xDD):
        out = []
        for _ in range(size):
            item, at = _unpack(data, at)
            out.append(item)
        return out, at
    result = {}
    for _ in range(size):
        key, at = _unpack(data, at)
        result[key], at = _unpack(data, at)
    return result, at
