"""Variable-byte integer coding and fixed-size posting blocks, vectorised over whole arrays.

Parquet's own encodings store the engine's segments; this codec serves archives of
postings outside Parquet and byte-size estimates. Four values share a control byte of
two bits each, which tell a value's width; widths come from one of two ladders. A block
starts with its least hash, its number of items and the place of its id section.
"""

from __future__ import annotations

import struct

import numpy as np

#: Bytes by control code: values that are often 0, and values that are not.
LADDERS = {"0124": np.array([0, 1, 2, 4]), "1234": np.array([1, 2, 3, 4])}
BLOCK_BYTES = 512
_HEADER = struct.Struct("<IHH")


def _codes(values: np.ndarray, ladder: str) -> np.ndarray:
    limits = [256 ** int(w) for w in LADDERS[ladder][:3]]
    return np.searchsorted(np.array(limits, np.int64), values.astype(np.int64), side="right").astype(np.uint8)


def encoded_size(values: np.ndarray, ladder: str) -> int:
    """Bytes of ``values`` coded in groups of four, the last one filled with zeros."""
    padded = np.zeros(-(-len(values) // 4) * 4, np.int64)
    padded[: len(values)] = values
    return len(padded) // 4 + int(LADDERS[ladder][_codes(padded, ladder)].sum())


def encode(values: np.ndarray, ladder: str) -> bytes:
    """Control bytes of all groups, then the data bytes, least significant first."""
    padded = np.zeros(-(-len(values) // 4) * 4, np.int64)
    padded[: len(values)] = values
    codes = _codes(padded, ladder)
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1).astype(np.uint8)
    widths = LADDERS[ladder][codes]
    as_bytes = padded.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control.tobytes() + as_bytes[np.arange(4) < widths[:, None]].tobytes()


def decode(data: bytes, count: int, ladder: str) -> tuple[np.ndarray, int]:
    """(values, bytes read)."""
    groups = -(-count // 4)
    control = np.frombuffer(data, np.uint8, groups)
    codes = (control[:, None] >> np.array([0, 2, 4, 6], np.uint8) & 3).ravel()
    widths = LADDERS[ladder][codes]
    end = groups + int(widths.sum())
    if end > len(data):
        raise ValueError("truncated block")
    out = np.zeros((groups * 4, 4), np.uint8)
    out[np.arange(4) < widths[:, None]] = np.frombuffer(data, np.uint8, end - groups, groups)
    return out.view("<u4").ravel()[:count].astype(np.int64), end


def deltas(hashes: np.ndarray, ids: np.ndarray, least_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash gaps, and id gaps within each hash's run, which starts over above ``least_id``."""
    gaps = np.diff(hashes, prepend=hashes[:1])
    steps = np.diff(ids, prepend=ids[:1])
    first = np.r_[True, gaps[1:] > 0]
    return gaps, np.where(first, ids - least_id, steps)


def encode_blocks(hashes: np.ndarray, ids: np.ndarray, least_id: int = 0, size: int = BLOCK_BYTES) -> list[bytes]:
    """Postings in order of (hash, id) as zero-filled blocks of ``size`` bytes, each with as many groups of four items as fit."""
    blocks, start = [], 0
    while start < len(hashes):
        low, high = 1, -(-(len(hashes) - start) // 4)
        high = min(high, size)
        best = 0
        while low <= high:
            middle = (low + high) // 2
            end = min(start + 4 * middle, len(hashes))
            gaps, steps = deltas(hashes[start:end], ids[start:end], least_id)
            if _HEADER.size + encoded_size(gaps, "0124") + encoded_size(steps, "1234") <= size:
                best, low = middle, middle + 1
            else:
                high = middle - 1
        if not best:
            raise ValueError("a block can't hold four items")
        end = min(start + 4 * best, len(hashes))
        gaps, steps = deltas(hashes[start:end], ids[start:end], least_id)
        coded = encode(gaps, "0124")
        block = _HEADER.pack(int(hashes[start]), end - start, _HEADER.size + len(coded)) + coded + encode(steps, "1234")
        blocks.append(block.ljust(size, b"\0"))
        start = end
    return blocks


def decode_block(block: bytes, least_id: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ids) of one block."""
    least, count, at = _HEADER.unpack_from(block)
    gaps, _ = decode(block[_HEADER.size : at], count, "0124")
    steps, _ = decode(block[at:], count, "1234")
    first = np.r_[True, gaps[1:] > 0] if count else np.zeros(0, bool)
    run = np.cumsum(first) - 1
    total = np.cumsum(steps)
    before = np.r_[0, total[:-1]][first]
    return least + np.cumsum(gaps), total - before[run] + least_id
